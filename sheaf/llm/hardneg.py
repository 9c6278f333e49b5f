"""Hard negatives of anchors, found by bounds along a spanning tree of the anchors.

For an anchor ``c`` at distance ``d`` of its parent ``p`` in the tree, the score
of a candidate ``x`` lies within ``score(p, x) - d |x|`` and ``score(p, x) + d |x|``.
So a walk from the root knows an interval for each candidate before it scores
any, and computes the inner product only where the interval overlaps what the
anchor asks for: the best of its own label, then the windows below its
positives' scores.  Exact scores narrow the intervals of the children.

Anchors are cut into blocks of bounded size, each with a tree of shortest edges
(Prim), candidates into parts; every block meets every part once, as the query
set of the join, and keeps no more than the rows asked for of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.session import materialise

#: Anchors of a block, and candidates of a part.
BLOCK_ANCHORS, PART_ROWS = 2048, 4096
#: Vectors with a longer integer norm than 2 ** 30 take no part: their scores need not fit a long.
MOST_SQUARED = 2.0**60


# ---- vectors ----

def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    length = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < length[:, None]] = lists.flatten().to_numpy()
    return out


def widths(*lists: pa.Array) -> int:
    import pyarrow.compute as pc

    return max([0, *(pc.max(pc.list_value_length(x)).as_py() or 0 for x in lists if len(x))])


def spanning_tree(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, parent's place, edge length) of the shortest spanning tree's nodes, parents before children; the root has parent -1."""
    n = len(q)
    near, parent, joined = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    order, now = [], 0
    for _ in range(n):
        joined[now] = True
        order.append(now)
        away = np.sqrt(((q - q[now]).astype(np.float64) ** 2).sum(1))
        closer = ~joined & (away < near)
        near[closer], parent[closer] = away[closer], now
        now = int(np.argmin(np.where(joined, np.inf, near)))
    order = np.array(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    above = parent[order]
    return order, np.where(above < 0, -1, place[above]), np.where(above < 0, 0.0, near[order])


TREES = "block int, seq int, parent int, edge double, anchor_id long, label long, q array<long>"


def _tree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("vec_id")
    order, parent, edge = spanning_tree(matrix(table.column("q"), widths(table.column("q"))))
    own = table.take(pa.array(order))
    return pa.table({
        "block": pa.array([key[0].as_py()] * len(order), pa.int32()), "seq": pa.array(range(len(order)), pa.int32()), "parent": pa.array(parent, pa.int32()),
        "edge": pa.array(edge), "anchor_id": own.column("vec_id"), "label": own.column("label"), "q": own.column("q"),
    })


# ---- the walk ----

class Candidates:
    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("vec_id")  # ties go by id
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.q = matrix(table.column("q"), width)
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(1))
        self.longest = self.norm.max(initial=0.0)
        self.real = self.q.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products: in floating point where every partial sum is a whole number below 2 ** 52."""
        if length * self.longest < 2.0**52:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.q[rows] @ anchor


Wanted = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def walk(anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, found: Candidates, wanted: Wanted, all_at_root: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows of candidates, their scores) in tree order, for the rows that ``wanted`` picks by their intervals.

    ``wanted(anchor, low, high)`` is given bounds that hold for every candidate.
    The root's scores are computed for all candidates, so that the bounds below it have a start.
    """
    waiting = np.bincount(parent[parent >= 0], minlength=len(anchors))
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    everything = np.arange(len(found.ids))
    for i, anchor in enumerate(anchors):
        length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        if parent[i] < 0:
            exact = found.scores(everything, anchor, length)
            low, high = exact.astype(np.float64), exact.astype(np.float64)
            rows = np.flatnonzero(wanted(i, low, high))
            scores = exact[rows]
        else:
            up = int(parent[i])
            low, high = bounds[up]
            # a little more than the edge allows, for the rounding of lengths and large scores
            reach = edge[i] * found.norm * (1 + 1e-9) + 1e-6
            low, high = low - reach - np.abs(low) * 1e-12, high + reach + np.abs(high) * 1e-12
            waiting[up] -= 1
            if not waiting[up]:
                del bounds[up]
            rows = np.flatnonzero(wanted(i, low, high))
            scores = found.scores(rows, anchor, length)
            low[rows] = high[rows] = scores
        if waiting[i]:
            bounds[i] = (low, high)
        yield i, rows, scores


def best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; rows ascend by id, which decides between equal ones."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return keep[np.argsort(-scores[keep], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


POSITIVES = "anchor_id long, positive_id long, positive_score long, met long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _anchor_columns(right: pa.Table) -> tuple:
    right = right.sort_by("seq")
    return right, right.column("parent").to_numpy(), right.column("edge").to_numpy(), right.column("anchor_id").to_numpy(), right.column("label").to_numpy()


def _long_table(columns: dict[str, list]) -> pa.Table:
    return pa.table({name: pa.array(np.concatenate(c) if c else [], pa.int64()) for name, c in columns.items()})


def _positives(k: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c.split()[0]: [] for c in POSITIVES.split(", ")}
        if left.num_rows and right.num_rows:
            width = widths(left.column("q"), right.column("q"))
            found = Candidates(left, width)
            right, parent, edge, ids, labels = _anchor_columns(right)

            def wanted(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                same = (found.labels == labels[i]) & (found.ids != ids[i])
                if same.sum() > k:  # k others have at least this score
                    same &= high >= np.partition(low[same], -k)[-k]
                return same

            for i, rows, scores in walk(matrix(right.column("q"), width), parent, edge, found, wanted):
                top = best(rows, scores, k)
                for name, values in zip(out, (np.full(len(top), ids[i]), found.ids[rows[top]], scores[top], np.full(len(top), len(rows)))):
                    out[name].append(values)
        return _long_table(out)

    return run


def _negatives(k: int, low_percent: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c.split()[0]: [] for c in NEGATIVES.split(", ")}
        if left.num_rows and right.num_rows:
            width = widths(left.column("q"), right.column("q"))
            found = Candidates(left, width)
            right, parent, edge, ids, labels = _anchor_columns(right)
            positives = [[(p["positive_id"], p["positive_score"]) for p in own or ()] for own in right.column("positives").to_pylist()]

            def wanted(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                inside = np.zeros(len(low), bool)
                for score in {s for _, s in positives[i] if s >= 0}:
                    room = score * 1e-12 + 1e-6
                    inside |= (high >= low_percent * score / 100 - room) & (low <= score + room)
                return inside & (found.labels != labels[i])

            for i, rows, scores in walk(matrix(right.column("q"), width), parent, edge, found, wanted):
                for positive, score in positives[i]:
                    # low_percent * score <= 100 * s in whole numbers
                    at = np.flatnonzero((scores <= score) & (scores >= -(-low_percent * score // 100)))
                    top = at[best(rows[at], scores[at], k)]
                    n = len(top)
                    for name, values in zip(out, (np.full(n, ids[i]), np.full(n, positive), np.full(n, score), found.ids[rows[top]], scores[top])):
                        out[name].append(values)
        return _long_table(out)

    return run


def whole_vectors(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, q): the rows that take part, components times ``scale`` rounded down."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x")).filter(
        "vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL"
    ).filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    squared = F.aggregate("x", F.lit(0.0), lambda a, v: a + (F.abs(v * scale) + 1) * (F.abs(v * scale) + 1))
    own = own.filter(squared < MOST_SQUARED).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q"))
    return own.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def hard_negatives(
    vectors: DataFrame, label: Column, anchors: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the vectors' components times ``scale``, rounded
    down.  Positives are the best other rows of the anchor's label; negatives the
    best rows of other labels that score between ``low_percent`` of the positive's
    score and the score itself; ties go by the smaller id.  ``anchors`` is a
    condition on vec_id.

    Rows with a null id, label or vector, and with null or non-finite components
    take no part, nor do vectors longer than 2 ** 30 after scaling.  Of several
    rows with one id the least by label, then vector stands.  Shorter vectors end
    in zeros, an empty one scores 0.  A positive with a negative score has no
    window.  Anchors without positives, and empty tables, give no rows.  Other
    columns are not read.
    """
    rows = materialise(whole_vectors(vectors, label, scale, id_col, vector_col))
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count(F.when(anchors, 1))).first()
    parts, blocks = max(1, -(-n // PART_ROWS)), max(1, -(-n_anchors // BLOCK_ANCHORS))
    number = lambda seed, most: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(most)).cast("int")
    trees = materialise(rows.filter(anchors).withColumn("block", number(1, blocks)).groupBy("block").applyInArrow(_tree, TREES))
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    candidates = rows.withColumn("part", number(2, parts)).withColumn("block", every(blocks)).groupBy("part", "block")

    def meet(own: DataFrame, run: Callable, schema: str) -> DataFrame:
        return candidates.cogroup(own.withColumn("part", every(parts)).groupBy("part", "block")).applyInArrow(run, schema)

    def top(found: DataFrame, keys: list[str], score: str, name: str, k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), name)
        return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)

    near = materialise(top(meet(trees, _positives(positives), POSITIVES), ["anchor_id"], "positive_score", "positive_id", positives))
    own = near.groupBy(F.col("anchor_id").alias("a")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = trees.join(own, F.col("anchor_id") == F.col("a"), "left").drop("a")
    hard = top(meet(asked, _negatives(negatives, low_percent), NEGATIVES), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_label() -> Column:
    """The label of ``embeddings``, moved on by one where 7 divides the id."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
