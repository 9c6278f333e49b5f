"""Inverted file over vectors: coarse cells, posting lists by cell, a few probes per query (RET-02, SRC-10, SRC-12).

Cells are the Voronoi cells of centres fitted on a bounded sample; every vector
is posted in the few cells whose centres are nearest.  A query visits cells from
the nearest on while their postings stay within a share of the table, so what
it is compared with is bounded whatever the cells' sizes; a pair that shares
several visited cells is compared once.  How large a share the asked recall
needs is measured on a few queries against the exact search.

Postings lie in folders of neighbouring cell numbers; the folders a search
visits prune the table when it is read.  Cells of any size are cut into parts
and their queries into blocks, and part and block meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions.session import materialise
from sheaf.operators.retrieval import best_hits, cosine_topk, unit_rows

#: Vectors that the centres are fitted on, those with the smallest hashes of their ids; centres at most.
SAMPLE, MOST_CELLS = 16_384, 4_096
#: Cells that a vector is posted in.
SPILL = 2
#: Postings and queries that one task compares.
PART_ROWS, BLOCK_QUERIES = 20_000, 2_000
#: Scores that a task holds at once, beside those of its best hits.
STEP_SCORES = 1_000_000
#: Queries that the share is measured on.
MEASURED = 64


@dataclass(frozen=True)
class InvertedFile:
    """``postings(folder, cell, cells, id, e)`` and what the driver keeps of it, at most MOST_CELLS centres and sizes."""

    postings: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    n: int

    @property
    def folders(self) -> int:
        return folders_of(int(self.sizes.sum()), len(self.centres))


def folders_of(postings: int, cells: int) -> int:
    return max(1, min(cells, -(-postings // PART_ROWS)))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of spherical k-means over unit rows, the first ones spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def nearest_cells(rows: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells of each row with the nearest centres, best first."""
    out = np.empty((len(rows), min(n, len(centres))), np.int32)
    for at in _steps(len(rows), len(centres)):
        out[at] = np.argsort(-(rows[at] @ centres.T), axis=1, kind="stable")[:, :n]
    return out


def _steps(rows: int, width: int) -> list[slice]:
    """Runs of rows whose scores against ``width`` others are held at once, however many rows a batch has."""
    step = max(1, STEP_SCORES // max(1, width))
    return [slice(at, at + step) for at in range(0, rows, step)]


def build(vectors: DataFrame, vector_id: str = "id", embedding: str = "embedding", cells: int | None = None, spill: int = SPILL) -> InvertedFile:
    """Posts every vector; null vectors are left out.  Half as many cells as vectors if not given, MOST_CELLS at most."""
    rows = vectors.select(F.col(vector_id).alias("id"), F.col(embedding).alias("e")).filter(F.col("e").isNotNull())
    n = rows.count()
    spark = vectors.sparkSession
    schema = f"folder int, cell int, cells array<int>, id {rows.schema['id'].dataType.simpleString()}, e {rows.schema['e'].dataType.simpleString()}"
    if not n:
        return InvertedFile(spark.createDataFrame([], schema), np.zeros((0, 1)), np.zeros(0, np.int64), 0)
    sample = unit_rows(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["e"])
    n_cells = max(1, min(cells or -(-n // 2), MOST_CELLS, len(sample)))
    centres = fit_centres(sample, n_cells)
    spill = min(spill, n_cells)

    @F.pandas_udf("array<int>")
    def own_cells(e: pd.Series) -> pd.Series:
        return pd.Series(list(nearest_cells(unit_rows(e), centres, spill)))

    n_folders = folders_of(n * spill, n_cells)
    posted = rows.withColumn("cells", own_cells("e")).withColumn("cell", F.explode("cells"))
    folder = F.floor(F.col("cell") * n_folders / n_cells).cast("int").alias("folder")
    postings = materialise(posted.select(folder, "cell", "cells", "id", "e").repartition("folder"), "folder").select("folder", "cell", "cells", "id", "e")
    return _described(postings, centres, n)


def _described(postings: DataFrame, centres: np.ndarray, n: int) -> InvertedFile:
    sizes = np.zeros(len(centres), np.int64)
    for row in postings.groupBy("cell").count().collect():  # one row a cell
        sizes[row["cell"]] = row["count"]
    return InvertedFile(postings, centres, sizes, n)


def save(index: InvertedFile, path: str) -> None:
    """Writes postings by folder, and the centres."""
    spark = index.postings.sparkSession
    index.postings.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    rows = [(i, [float(x) for x in c], index.n) for i, c in enumerate(index.centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def load(spark: SparkSession, path: str) -> InvertedFile:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    centres = np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 1))
    postings = spark.read.parquet(f"{path}/postings").select("folder", "cell", "cells", "id", "e")
    return _described(postings, centres, rows[0]["n"] if rows else 0)


# ---- probes ----

def _probes(index: InvertedFile, k: int, share: float):
    """For unit rows, the cells to visit, one bit a cell, and their folders.

    Cells are visited from the nearest on within the share, but until k vectors are met.
    """
    centres, sizes, room = index.centres, index.sizes, share * index.n
    least, n_cells = k * SPILL, len(index.centres)
    folder = np.arange(n_cells) * index.folders // max(1, n_cells)

    def visit(rows: np.ndarray) -> pd.DataFrame:
        bits, folders = [], []
        for at in _steps(len(rows), n_cells):
            order = nearest_cells(rows[at], centres, n_cells)
            upto = np.cumsum(sizes[order], axis=1)
            enough = (upto < least).sum(1) + 1  # k different vectors have at most ``least`` postings
            number = np.maximum((upto <= room).sum(1), enough)
            seen = np.empty(order.shape, bool)
            np.put_along_axis(seen, order, np.arange(n_cells) < number[:, None], 1)
            bits += [b.tobytes() for b in np.packbits(seen, axis=1)]
            folders += [np.unique(folder[own]).astype(np.int32) for own in seen]
        return pd.DataFrame({"visited": bits, "folders": folders})

    return visit


def share_for(index: InvertedFile, queries: DataFrame, vectors: DataFrame, k: int, recall: float, query_id: str, vector_id: str, embedding: str) -> float:
    """The share of postings within which a few queries, those with the smallest hashes, find ``recall`` of their exact hits."""
    asked = queries.filter(F.col(embedding).isNotNull()).orderBy(F.xxhash64(query_id)).limit(MEASURED).select(query_id, embedding)
    own = asked.toPandas()
    if not len(own) or not index.n:
        return 0.0
    given = queries.sparkSession.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(own[embedding])], "query_id int, embedding array<double>")
    exact = cosine_topk(given, vectors.withColumnRenamed(embedding, "embedding"), k, vector_id=vector_id)
    posted = index.postings.select("id", "cells").distinct()
    hits = exact.join(posted, "id").select("query_id", "cells").collect()  # MEASURED * k rows
    order = nearest_cells(unit_rows(own[embedding]), index.centres, len(index.centres))
    upto = np.empty(order.shape)
    np.put_along_axis(upto, order, np.cumsum(index.sizes[order], axis=1).astype(float), 1)
    needed = [min(upto[h["query_id"], c] for c in h["cells"]) / index.n for h in hits]
    return float(np.quantile(needed, recall, method="higher"))


# ---- search ----

def search(index: InvertedFile, queries: DataFrame, k: int, share: float, query_id: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank, candidates): the best ``k`` vectors of the cells that each query visits, by exact cosine.

    ``candidates`` is how many vectors the query was compared with, at most
    ``share`` of all unless fewer than ``k`` were met.  A share of the number
    of cells a vector is posted in visits everything, which is exact.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("q")).filter(F.col("q").isNotNull())
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(asked, 'query_id')}, id {kind(index.postings, 'id')}, score double, met long"
    spark = queries.sparkSession
    if not index.n:
        return spark.createDataFrame([], schema.replace("met long", "rank int, candidates long"))
    visit, n_cells, n_folders = _probes(index, k, share), len(index.centres), index.folders

    @F.pandas_udf("visited binary, folders array<int>")
    def probes(q: pd.Series) -> pd.DataFrame:
        return visit(unit_rows(q))

    spread = materialise(asked.withColumn("p", probes("q")).select("query_id", "q", "p.visited", "p.folders"))
    wanted = spread.select("query_id", "q", "visited", F.explode("folders").alias("q_folder"))
    blocks = {r["q_folder"]: -(-r["count"] // BLOCK_QUERIES) for r in wanted.groupBy("q_folder").count().collect()}  # one row a folder
    held = np.bincount(np.arange(n_cells) * n_folders // n_cells, index.sizes, n_folders).astype(int)
    plan = spark.createDataFrame([(f, max(1, -(-int(held[f]) // PART_ROWS)), b) for f, b in blocks.items()], "p_folder int, parts int, blocks int")
    number = lambda c, most: F.pmod(F.xxhash64(c), most).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), most - 1))
    # folders are at most as many as cells; those not visited are not read
    right = index.postings.filter(F.col("folder").isin(sorted(blocks))).join(F.broadcast(plan), F.col("folder") == F.col("p_folder")).select(
        "folder", "cell", "cells", "id", "e", number("id", F.col("parts")).alias("part"), every(F.col("blocks")).alias("block")
    )
    left = wanted.join(F.broadcast(plan), F.col("q_folder") == F.col("p_folder")).select(
        F.col("q_folder").alias("folder"), "query_id", "q", "visited", number("query_id", F.col("blocks")).alias("block"), every(F.col("parts")).alias("part")
    )

    def meet(own: pd.DataFrame, posted: pd.DataFrame) -> pd.DataFrame:
        return _met(own, posted, n_cells, k)

    met = left.groupBy("folder", "part", "block").cogroup(right.groupBy("folder", "part", "block")).applyInPandas(meet, schema)
    one = Window.partitionBy("query_id")
    ranked = met.withColumn("candidates", F.sum("met").over(one)).withColumn("rank", F.row_number().over(one.orderBy(F.col("score").desc(), "id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "id", "score", "rank", "candidates")


def _met(own: pd.DataFrame, posted: pd.DataFrame, n_cells: int, k: int) -> pd.DataFrame:
    """The best k of what each query meets in a part, and how many it met (beside its first hit)."""
    empty = pd.DataFrame({"query_id": own["query_id"].iloc[:0], "id": posted["id"].iloc[:0], "score": [], "met": []})
    if not len(own) or not len(posted):
        return empty
    posted = posted.sort_values("cell", kind="stable")
    wanted, rows = unit_rows(own["q"]), unit_rows(posted["e"])
    names, cells = posted["id"].to_numpy(), np.array(posted["cells"].tolist())
    names = names.astype(str) if names.dtype == object else names
    bits = np.frombuffer(b"".join(own["visited"]), np.uint8).reshape(len(own), -1)
    visited = np.unpackbits(bits, axis=1, count=n_cells).view(bool)
    cell = posted["cell"].to_numpy()
    met, kept = np.zeros(len(own), np.int64), None
    for whole in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
        here = cell[whole[0]]
        asking = np.flatnonzero(visited[:, here])
        if not len(asking):
            continue
        for step in _steps(len(whole), len(asking)):
            at = whole[step]
            # met where the vector's first cell that the query visits is this one
            fresh, earlier = np.ones((len(asking), len(at)), bool), np.ones(len(at), bool)
            for t in range(cells.shape[1]):
                earlier &= cells[at, t] != here
                if not earlier.any():
                    break
                fresh &= ~(visited[np.ix_(asking, cells[at, t])] & earlier)
            met[asking] += fresh.sum(1)
            score = np.where(fresh, np.round(wanted[asking] @ rows[at].T, 9), -np.inf)
            found, col = np.nonzero(fresh & (score >= (np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else -np.inf)))
            new = (asking[found], names[at][col], score[found, col])
            kept = best_hits(k, *(new if kept is None else map(np.concatenate, zip(kept, new))))
    if kept is None or not len(kept[0]):
        return empty
    first = np.concatenate(([True], np.diff(kept[0]) != 0))
    return pd.DataFrame({"query_id": own["query_id"].to_numpy()[kept[0]], "id": kept[1], "score": kept[2], "met": np.where(first, met[kept[0]], 0)})


def near_topk(
    queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "id", embedding: str = "embedding",
    share: float = 0.1, recall: float | None = 0.92, cells: int | None = None,
) -> DataFrame:
    """``cosine_topk`` for any number of queries: approximate in its candidates, exact in its scores.

    (query_id, id, score, rank, candidates).  A query is compared with at most
    ``share`` of the vectors, more only where the measured recall asks for it:
    vectors without any clusters cannot be found by cells, and the share then
    grows towards all of them.  With ``recall`` None the share stays as given.
    """
    index = build(vectors, vector_id, embedding, cells)
    if recall is not None:
        share = max(share, share_for(index, queries, vectors, k, recall, query_id, vector_id, embedding))
    return search(index, queries, k, share, query_id, embedding)
