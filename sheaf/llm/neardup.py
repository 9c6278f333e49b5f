"""Near-duplicate documents by SuperMinHash.

1. Every text becomes its set of word shingles; texts with the same set are one
   class with one signature.
2. Signatures are cut into bands.  Classes that share a band are joined to the
   smallest of the band, a star and not all pairs; what hangs together is a
   family.  A pair of similarity 0.8 shares a band with a probability of
   1 - 5e-8, and is then in one family, whichever the star's centre is.
3. Inside a family every link is decided on the full sets.  An index of the
   rarest shingles of each set leads from a set to those it can be linked with
   (of two linked sets, the first fifths by rarity must meet); union-find skips
   pairs that hang together already.  A family larger than a task may hold is
   cut into blocks, and pairs of blocks are compared.
4. The links' components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sheaf.functions.session import arrow_batches, materialise
from sheaf.llm.common import batch_of, free_name, members_of, run_hashes, texts_of, word_hashes
from sheaf.llm.components import components
from sheaf.llm.superminhash import bands, signature

#: Similarity in percent, signature positions, and positions of a band.
PERCENT, SIZE, ROWS = 80, 128, 4
#: Shingles of one block of a family.
BLOCK_SHINGLES = 500_000


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of the runs of words, sorted; lower-cased A-Z, words parted by ASCII white space."""
    return np.unique(run_hashes(word_hashes(text.encode().lower().split()), words)) if text else np.empty(0, np.uint64)


SIGNED = "n_shingles long, set1 long, set2 long, bands array<long>"


def signed(text: Column, words: int) -> Column:
    """Size and 128-bit hash of a text's shingle set, and the bands of its signature; no bands without words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for body in texts_of(batch):
                own = shingles(body, words)
                key = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                rows.append((len(own), int(key[0]), int(key[1]), bands(signature(own, SIZE), ROWS).view(np.int64).tolist() if len(own) else []))
            yield batch_of(rows, SIGNED)

    return arrow_udf(run, SIGNED)(text)


def shingle_set(text: Column, words: int) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(body, words).tobytes() for body in texts_of(batch)], pa.binary())

    return arrow_udf(run, "binary")(text)


def _linked(a: int, b: int, shared: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)


def links_within(ids: list[int], sets: list[np.ndarray], blocks: list[int]) -> list[tuple[int, int]]:
    """Links that join what hangs together by sets of enough similarity; across blocks if there are two."""
    n = len(sets)
    across = len(set(blocks)) > 1
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    value, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(value))
    token = rank[token]
    shared_token = np.empty(len(value), bool)
    shared_token[rank] = df > 1
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    start = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(len(token)) - start[owner]
    by_rank = [token[start[i] : start[i + 1]] for i in range(n)]
    # the first tokens by rarity, of which linked sets share one
    least = -(-PERCENT * size // 100)
    head = (place <= (size - least)[owner]) & shared_token[token]
    token, owner, place = token[head], owner[head], place[head]
    order = np.lexsort((owner, token))
    token, owner, place = token[order], owner[order], place[order]
    cuts = np.flatnonzero(np.diff(token)) + 1
    block = np.array(blocks)
    root, tried, out = np.arange(n), set(), []
    for who, at in zip(np.split(owner, cuts), np.split(place, cuts)):
        if len(who) < 2 or (root[who] == root[who[0]]).all():
            continue
        left = size[who] - at  # tokens from here on
        for k in range(len(who) - 1):
            i = int(who[k])
            rest = who[k + 1 :]
            need = -(-PERCENT * (size[i] + size[rest]) // (100 + PERCENT))
            can = (np.minimum(left[k], left[k + 1 :]) >= need) & (root[rest] != root[i])
            if across:
                can &= block[rest] != block[i]
            for j in rest[can].tolist():
                if root[i] == root[j] or (i, j) in tried:
                    continue
                tried.add((i, j))
                if _linked(size[i], size[j], len(np.intersect1d(by_rank[i], by_rank[j], assume_unique=True))):
                    out.append((ids[i], ids[j]))
                    low, high = sorted((int(root[i]), int(root[j])))
                    root[root == high] = low
    return out


_LINKS = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def _compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, sets, blocks = [], [], []
    for batch in batches:
        ids += batch.column("node").to_pylist()
        blocks += batch.column("block").to_pylist()
        sets += [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
    links = links_within(ids, sets, blocks)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=_LINKS)


def groups(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest linked id, its own included), kept, text_hash.

    Null and empty texts have no shingles and are linked with nothing.  An id
    with several texts links what each of them is linked with.  A row with a
    null id is not linked and has null component and kept.  Ids must be whole
    numbers.  Other columns are not read; an empty table gives no rows.
    """
    with arrow_batches(docs.sparkSession):
        return _groups(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), words)


def _groups(texts: DataFrame, words: int) -> DataFrame:
    signs = materialise(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), signed(F.col("text"), words).alias("s")).select("doc_id", "text_hash", "s.*"))
    named = signs.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialise(named.groupBy("set1", "set2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")))

    # stars around the smallest class of each band; bands differ by number already
    in_bands = classes.select("node", F.explode("bands").alias("band"))
    centres = in_bands.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    stars = in_bands.join(centres, "band").filter("node <> centre").select(F.col("node").alias("x"), F.col("centre").alias("y")).distinct()
    near = components(stars)
    families = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct())

    sized = families.join(classes.select("node", "set1", "set2", "n_shingles"), "node")
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = sized.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a block meets itself, or, where there are several, every other one (and so itself)
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    meetings = placed.select(
        "component", "node", "set1", "set2", "block", F.explode(other).alias("with")
    ).withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with"))
    members = families.select(F.col("node").alias("k"))
    own = members_of(texts, members, ["doc_id"], ["k"]).groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    sets = own.select("doc_id", shingle_set(F.col("text"), words).alias("shingles")).filter(F.length("shingles") > 0)
    links = (
        meetings.join(sets, F.col("node") == F.col("doc_id"))
        .groupBy("component", "low", "high").applyInArrow(_compare, "x long, y long")
    )
    joined = components(links)

    at = classes.select("set1", "set2", "node").join(joined, "node", "left").select("set1", "set2", F.coalesce("component", "node").alias("component"))
    found = signs.join(at, ["set1", "set2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the smallest id, with the columns of ``docs``.

    Rows with a null id stay, and null and empty texts, which are like nothing.
    Of several rows with a kept id one stays: the least by the hash of its text,
    then by all columns.  Columns may have any names; an empty table stays empty.
    """
    name, digest, count, whole = (free_name(docs, c) for c in ("__id", "__hash", "__n", "__row"))
    kept = groups(docs, words, id_col, text_col).filter("kept").groupBy(F.col("doc_id").alias(name), F.col("text_hash").alias(digest)).agg(F.count(F.lit(1)).alias(count))
    kept = kept.groupBy(name).agg(F.min(digest).alias(digest), F.min_by(count, digest).alias(count))
    key = (F.col(f"`{id_col}`").cast("long") == F.col(name)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(digest))
    once = docs.join(kept.filter(F.col(count) == 1), key, "left_semi")
    several = docs.join(kept.filter(F.col(count) > 1), key, "left_semi").groupBy(F.col(f"`{id_col}`")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(whole))
    several = several.select(*[F.col(whole)[c].alias(c) for c in docs.columns])
    return once.unionByName(several).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
