"""Katz backoff: word bigrams over Good-Turing discounted counts.

``P(w | h) = d(c) c(hw) / c(h)`` for a bigram seen in training, else
``alpha(h) P(w)``; ``P(w)`` is discounted in the same way, and what it leaves
goes to the one class of unknown words.  ``alpha(h)`` makes the probabilities
that follow ``h`` sum to one exactly.

Texts are cut into chunks of a few million tokens, written once.  N-grams are
64-bit hashes; a chunk sends each of its distinct ones once, sorted and packed,
to the table part of its hash range, and gets the corpus count back in the same
order.  So what is shuffled follows the distinct n-grams of a chunk, no part
grows with the corpus, and an n-gram that is everywhere is one entry a chunk.
Beyond ``FAN`` parts the lists go there in several steps: the lists of ``FAN`` senders
for one range become one, which is cut to finer ranges, and answers come back the
same way.  So a sender has at most ``FAN`` rows a step, and rows are linear in the
corpus, not chunks times parts.  Of the chunks that hold an n-gram, one owns it and
adds it to its context's sums, from which the backoff weights come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.session import arrow_batches, materialise
from sheaf.llm.common import ODD, doc_crc, mixed, word_hashes

#: Tokens of a chunk, and entries of a part of the count tables.
CHUNK_TOKENS, PART_ENTRIES = 1_500_000, 2_000_000
#: Ranges to which a sorted list is cut at once, and lists that are merged at once.
FAN = 128
#: Counts up to this one are discounted.
CUTOFF = 5
ROW_BITS = 24  # documents of a chunk, as each has a token at least
# no word holds a blank
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(m)) for m in (b" <s>", b" </s>"))


# ---- packing of number columns ----

def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


# ---- chunks ----

CHUNK = "chunk long, n_tokens long, ids array<long>, lengths array<int>, trains array<boolean>, words binary, stream binary"
_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ("trains", pa.list_(pa.bool_())), ("words", pa.binary()), ("stream", pa.binary()),
])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids, trains, tokens, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        hashes = np.concatenate(tokens)
        words, where, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(words), "<u4")
        rank[order] = np.arange(len(words), dtype="<u4")
        row = [(part << 12) + number, len(hashes), ids, [len(t) for t in tokens], trains, words[order].tobytes(), _pack(rank[where])]
        return pa.RecordBatch.from_pylist([dict(zip(_CHUNK.names, row))], _CHUNK)

    for batch in batches:
        for doc, text, trained in zip(*(batch.column(c).to_pylist() for c in range(3))):
            ids.append(doc)
            trains.append(trained)
            tokens.append(np.append(word_hashes(text.encode().lower().split()) if text else np.empty(0, np.uint64), END))
            size += len(tokens[-1])
            if size >= CHUNK_TOKENS:
                yield flush()
                number, ids, trains, tokens, size = number + 1, [], [], [], 0
    if tokens:
        yield flush()


class Chunk:
    """The tokens of one chunk, with its distinct words and bigrams in the order of their hashes."""

    def __init__(self, row: dict):
        self.number, self.ids = row["chunk"], row["ids"]
        lengths = np.array(row["lengths"])
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.lengths, self.trains = lengths, np.array(row["trains"], bool)
        words = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words = words[order]
        self.word = place[_unpack(row["stream"], "<u4")]
        starts = np.cumsum(lengths) - lengths
        before = np.roll(self.word, 1)
        before[starts] = len(words)  # the begin mark
        self.context = before
        context_hash = np.append(self.words, BEGIN)
        self.bigrams, first, self.bigram = np.unique(
            mixed(context_hash[before] * ODD + self.words[self.word]), return_index=True, return_inverse=True
        )
        self.bigram_context, self.bigram_word = before[first], self.word[first]
        self.context_hash = context_hash

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hashes, training counts) of words and of bigrams."""
        trained = self.trains[self.doc]
        return [
            (keys, np.bincount(where[trained], minlength=len(keys)))
            for keys, where in ((self.words, self.word), (self.bigrams, self.bigram))
        ]


def _factors(parts: int) -> list[int]:
    """The numbers of ranges, step by step, that make at least ``parts`` parts."""
    steps = []
    while parts > FAN:
        steps.append(FAN)
        parts = -(-parts // FAN)
    return [*steps, parts]


def _part_ends(keys: np.ndarray, parts: int, of: range | None = None) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes, or some of them, ends in sorted keys."""
    ends = [-(-((p + 1) << 64) // parts) - 1 for p in of or range(parts)]
    return np.searchsorted(keys, np.array(ends, np.uint64), side="right")


# ---- count tables ----

SENT = "part int, kind int, asker long, keys binary, counts binary"
_SENT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("asker", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _cut(asker: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int, of: range) -> pa.RecordBatch:
    """A sorted list as one row for each of the parts ``of`` in which it has entries."""
    rows, start = [], 0
    for part, end in zip(of, _part_ends(keys, parts, of)):
        if end > start:
            rows.append({"part": part, "kind": kind, "asker": asker, "keys": _pack_sorted(keys[start:end]), "counts": _pack(counts[start:end].astype("<u8"))})
        start = end
    return pa.RecordBatch.from_pylist(rows, _SENT)


def _send(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.slice(i, 1).to_pylist()[0])
                for kind, (keys, counts) in enumerate(chunk.tables()):
                    yield _cut(chunk.number, kind, keys, counts, parts, range(parts))

    return run


class Met:
    """The lists that reached one task: their distinct keys, and the place of each entry among them."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        asked = sorted((r["asker"], r["keys"], r["counts"]) for b in batches for r in b.select(["asker", "keys", "counts"]).to_pylist())
        self.askers = [a for a, _, _ in asked]
        keys = [_unpack_sorted(k) for _, k, _ in asked]
        self.sizes = [len(k) for k in keys]
        self.counts = np.concatenate([_unpack(c, "<u8") for _, _, c in asked])
        self.keys, self.where = np.unique(np.concatenate(keys), return_inverse=True)

    def totals(self) -> np.ndarray:
        return np.bincount(self.where, self.counts, len(self.keys)).astype(np.int64)

    def answers(self, part: int, kind: int, totals: np.ndarray, owned: np.ndarray) -> list[dict]:
        """For each asker, in its order: the totals, and which n-grams are its own: of those that are
        owned here, the ones that it is the first to have seen in training."""
        seen = np.flatnonzero(self.counts)
        own = np.zeros(len(self.counts), bool)
        own[seen[np.unique(self.where[seen], return_index=True)[1]]] = True
        own &= owned[self.where]
        rows, start = [], 0
        for asker, size in zip(self.askers, self.sizes):
            at = slice(start, start + size)
            rows.append({"asker": asker, "part": part, "totals": _pack(totals[self.where[at]].astype("<u8")), "owned": np.packbits(own[at]).tobytes(), "stats": None, "kind": kind})
            start = at.stop
        return rows


def _merge(factor: int, parts: int):
    """The lists of a group of askers for one range, as one list of the group for ``factor`` finer ranges."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kind, group = (k.as_py() for k in key)
        met = Met(batches)
        yield _cut(group, kind, met.keys, met.totals(), parts, range(part * factor, (part + 1) * factor))

    return run


COUNTED = "asker long, part int, totals binary, owned binary, stats array<long>, kind int"
_COUNTED = pa.schema([
    ("asker", pa.int64()), ("part", pa.int32()), ("totals", pa.binary()), ("owned", pa.binary()), ("stats", pa.list_(pa.int64())), ("kind", pa.int32()),
])


def _count(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corpus counts of one part: an answer for each asker in the order it asked, and counts of counts."""
    part, kind = key[0].as_py(), key[1].as_py()
    met = Met(batches)
    totals = met.totals()
    rows = met.answers(part, kind, totals, np.ones(len(totals), bool))
    stats = [int((totals > 0).sum()), int(totals.sum()), *(int((totals == r).sum()) for r in range(1, CUTOFF + 2))]
    rows.append({"asker": -1, "part": part, "totals": None, "owned": None, "stats": stats, "kind": kind})
    yield pa.RecordBatch.from_pylist(rows, _COUNTED)


def _joined(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(totals, owned) of a whole list out of the answers for its parts, given in their order."""
    totals = [_unpack(r["totals"], "<u8").astype(np.int64) for r in rows]
    owned = [np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=len(t)).astype(bool) for r, t in zip(rows, totals)]
    return np.concatenate(totals), np.concatenate(owned)


def _hand_down(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """What a group was answered, for each of its askers."""
    part, kind = key[0].as_py(), key[1].as_py()
    rows = Met(left.to_batches()).answers(part, kind, *_joined(sorted(right.to_pylist(), key=lambda r: r["finer"])))
    return pa.Table.from_pylist(rows, _COUNTED)


def _counts(chunks: DataFrame, n_chunks: int, parts: int) -> tuple[DataFrame, dict[int, list[int]]]:
    """The answers for all chunks, and counts of counts by kind."""
    first, *finer = _factors(parts)
    sent, askers, parts, steps = chunks.mapInArrow(_send(first), SENT), n_chunks, first, []
    for factor in finer:
        askers, parts = -(-askers // FAN), parts * factor
        sent = materialise(sent.withColumn("group", F.pmod(F.xxhash64("asker"), F.lit(askers))))
        steps.append((sent, factor))
        sent = sent.groupBy("part", "kind", "group").applyInArrow(_merge(factor, parts), SENT)
    counted = materialise(sent.groupBy("part", "kind").applyInArrow(_count, COUNTED), "kind")
    sums = counted.filter("asker < 0").groupBy("kind").agg(*[F.sum(F.col("stats")[i]) for i in range(CUTOFF + 3)]).collect()
    answers = counted.filter("asker >= 0")
    for sent, factor in reversed(steps):
        of = F.floor(F.col("part") / factor).cast("int").alias("part")
        given = answers.select(of, "kind", F.col("asker").alias("group"), F.col("part").alias("finer"), "totals", "owned")
        answers = sent.groupBy("part", "kind", "group").cogroup(given.groupBy("part", "kind", "group")).applyInArrow(_hand_down, COUNTED)
    return answers.select(F.col("asker").alias("chunk"), "kind", "part", "totals", "owned"), {r[0]: list(r[1:]) for r in sums}


def discounts(n: list[int]) -> np.ndarray:
    """Factors of counts 0 to CUTOFF + 1 (the last stands for all higher ones), from counts of counts n1, n2, ...

    Katz's form of Good-Turing; where a count of counts is missing or a factor
    would not lie between 0 and 1, one absolute discount instead.
    """
    out = np.ones(CUTOFF + 2)
    r = np.arange(1, CUTOFF + 1)
    n_r, n_next = np.array(n[:CUTOFF], float), np.array(n[1 : CUTOFF + 1], float)
    if n_r.all() and n_next.all():
        common = (CUTOFF + 1) * n[CUTOFF] / n[0]
        if common < 1:
            turing = ((r + 1) * n_next / (r * n_r) - common) / (1 - common)
            if ((turing > 0) & (turing < 1)).all():
                out[1:-1] = turing
                return out
    off = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out[1:-1] = (r - off) / r
    return out


class Unigrams:
    """P(w) by count; ``unknown`` for count 0."""

    def __init__(self, stats: list[int]):
        self.types, self.tokens, *n = stats
        self.factor = discounts(n)
        left = sum(n[r - 1] * r * (1 - self.factor[r]) for r in range(1, CUTOFF + 1))
        self.total = self.tokens + (left == 0)  # something must be left for unknown words
        self.unknown = (left + (left == 0)) / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.factor[np.minimum(counts, CUTOFF + 1)] * counts / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


SCORED = (
    "ids array<long>, rows array<long>, trains array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, score array<double>, "
    "contexts array<long>, totals array<long>, lefts array<double>, seen array<double>, gap_rows array<long>, gap_contexts array<long>, n_seen array<long>, n_unseen array<long>"
)


def _score(unigram_stats: list[int], bigram_stats: list[int]):
    one, factor = Unigrams(unigram_stats), discounts(bigram_stats[2:])

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(left.to_pylist()[0])
        answers = sorted(right.to_pylist(), key=lambda r: r["part"])
        (c_word, _), (c_bigram, owned) = (_joined([r for r in answers if r["kind"] == kind]) for kind in (0, 1))
        p_word, docs = one.p(c_word), len(chunk.ids)
        # a context is followed by a token each time; a text begins as often as one ends
        c_context = np.append(c_word, c_word[np.searchsorted(chunk.words, END)])
        d_bigram = factor[np.minimum(c_bigram, CUTOFF + 1)]

        def per_doc(values: np.ndarray, where: np.ndarray | slice = slice(None)) -> np.ndarray:
            return np.bincount(chunk.doc[where], values[where] if len(values) else values, docs)

        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.log10(d_bigram * c_bigram / c_context[chunk.bigram_context])
        by_bigram = np.where(c_bigram > 0, known, np.log10(p_word)[chunk.bigram_word])
        score = per_doc(by_bigram[chunk.bigram])

        # what the bigrams that this chunk owns leave over, and the probability of the words they end in
        own = np.flatnonzero(owned)
        at, n = chunk.bigram_context[own], len(chunk.context_hash)
        lefts, seen = np.bincount(at, c_bigram[own] * (1 - d_bigram[own]), n), np.bincount(at, p_word[chunk.bigram_word[own]], n)
        has = np.flatnonzero(np.bincount(at, minlength=n))

        # tokens whose probability waits for the weight of their context: after a known context, unseen ones,
        # and seen ones where nothing here shows that the context leaves something over
        leaves = np.bincount(chunk.bigram_context, (c_bigram > 0) & (d_bigram < 1), n) > 0
        unseen = (c_bigram == 0)[chunk.bigram]
        wait = np.flatnonzero((c_context[chunk.context] > 0) & (unseen | ~leaves[chunk.context]))
        pair, which = np.unique(chunk.doc[wait] * n + chunk.context[wait], return_inverse=True)
        n_unseen = np.bincount(which, unseen[wait], len(pair))
        n_all = np.bincount(which, minlength=len(pair))
        rows = (np.int64(chunk.number) << ROW_BITS) + np.arange(docs)
        values = [
            chunk.ids, rows, chunk.trains, chunk.lengths, per_doc((c_word > 0)[chunk.word].astype(float)).astype(np.int64),
            per_doc(one.base(c_word)[chunk.word]), score,
            chunk.context_hash[has].view(np.int64), c_context[has], lefts[has], seen[has],
            rows[pair // n], chunk.context_hash[pair % n].view(np.int64), n_all - n_unseen.astype(np.int64), n_unseen.astype(np.int64),
        ]
        kinds = [pa.bool_() if i == 2 else pa.float64() if i in (5, 6, 9, 10) else pa.int64() for i in range(len(values))]
        names = [c.split()[0] for c in SCORED.split(", ")]
        return pa.table({name: pa.array([list(v)], pa.list_(kind)) if name == "ids" else _one_list(v, kind) for name, v, kind in zip(names, values, kinds)})

    return run


def _one_list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def scores(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    ``trains`` tells which rows the model learns from.  Tokens are words (lower-cased
    A-Z, parted by ASCII white space) and one end.  Null and empty texts are one
    end.  Each row counts, repeated rows too; ids may be null; other columns are
    not read.  Without training rows every token is unknown and the unknown
    class has probability one.  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    with arrow_batches(docs.sparkSession):
        chunks = materialise(texts.mapInArrow(_chunks, CHUNK))
    n_chunks, tokens = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    answers, stats = _counts(chunks, n_chunks, max(1, -(-tokens // PART_ENTRIES)))
    none = [0] * (CUTOFF + 3)
    scored = materialise(
        chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(stats.get(0, none), stats.get(1, none)), SCORED)
    )

    def each(**columns: str) -> DataFrame:
        rows = scored.select(F.explode(F.arrays_zip(*columns.values())).alias("x"))
        return rows.select(*[F.col("x")[c].alias(name) for name, c in columns.items()])

    total, left = F.max("total"), F.sum("left")
    weights = (
        each(context="contexts", total="totals", left="lefts", seen="seen").groupBy("context")
        .agg(total.alias("total"), left.alias("left"), F.sum("seen").alias("seen"))
        .select(
            F.col("context").alias("h"),
            # a context that leaves nothing over is counted once more, so that something is left
            F.when(F.col("left") > 0, 0.0).otherwise(F.log10(F.col("total") / (F.col("total") + 1))).alias("smaller"),
            F.log10(F.when(F.col("left") > 0, F.col("left") / F.col("total")).otherwise(1 / (F.col("total") + 1)) / (1 - F.col("seen"))).alias("alpha"),
        )
    )
    gaps = each(row="gap_rows", context="gap_contexts", n_seen="n_seen", n_unseen="n_unseen")
    late = gaps.join(weights, F.col("context") == F.col("h")).groupBy("row").agg(F.sum(F.col("n_seen") * F.col("smaller") + F.col("n_unseen") * F.col("alpha")).alias("late"))
    found = each(doc_id="ids", row="rows", trained="trains", n_tokens="n_tokens", n_known="n_known", base_score="base", score="score")
    return found.join(late, "row", "left").select(
        "doc_id", "trained", "n_tokens", "n_known", F.lit(stats.get(0, none)[1]).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("late", F.lit(0.0))).alias("score"),
    )


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows by a model of those whose crc32 of the id is no multiple of 10."""
    out = F.pmod(doc_crc(id_col), F.lit(10)) == 0
    return scores(docs, ~out, id_col, text_col).select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
