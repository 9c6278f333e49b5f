"""Jaccard self-join of word n-gram sets by signature trees.

1. Every text becomes its set of hashed shingles; texts with the same set are
   one class.  Classes that share a band of their signature hang together, and
   what hangs together is a family, the root of a tree.  A pair of similarity
   0.85 shares one of 32 bands of 4 with a probability of 1 - 6e-11.
2. A family of more sets than a task should hold is cut into subtrees by size:
   sets whose sizes fall into ranges that are not next to each other cannot be
   linked, and only the other subtrees meet.
3. In a task the sets are the leaves of a signature tree.  Each node holds the
   OR of the token bitmaps below it, the range of set sizes, and the most tokens
   of a set that fall on a bit already taken.  Two trees, or one with itself, are
   descended together: a pair of nodes goes no further if the common bits, plus
   the tokens they may hide, cannot reach the overlap that its smallest sets
   need, or if all sets below hang together already.
4. Pairs of sets that are left are decided on the full sets; the components of
   the links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.session import arrow_batches, materialise
from sheaf.llm.common import members_of
from sheaf.llm.components import components
from sheaf.llm.neardup import shingle_set, signed

#: Sets below a node of the lowest level, and nodes below one of the others.
LEAF_SETS, FANOUT = 16, 8
#: Shingles and sets of one subtree.
TREE_SHINGLES, TREE_SETS = 500_000, 2_000
#: Bits of a bitmap at most; sets may be larger, the bound allows for it.
MOST_BITS = 1 << 16


def reaches(overlap, a, b, percent: int):
    """Whether sets of ``a`` and ``b`` elements with such an overlap are linked (numbers or arrays)."""
    return 100 * overlap >= percent * (a + b - overlap)


class Tree:
    """Sets in the order of their smallest hashes, so that like sets are neighbours, and the nodes above them."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], bits: int):
        order = sorted(range(len(sets)), key=lambda k: (sets[k][:4].tolist(), len(sets[k]), ids[k]))
        self.ids = [ids[k] for k in order]
        self.sets = [sets[k] for k in order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.maps = np.zeros((len(order), bits // 64), np.uint64)
        for k, s in enumerate(self.sets):
            marks = np.zeros(bits, bool)
            marks[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            self.maps[k] = np.packbits(marks, bitorder="little").view(np.uint64)
        #: tokens that add no bit; for a part of the set they can only be fewer
        self.hidden = self.size - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        # levels from the leaves up: first and last set, OR, sizes, hidden tokens
        cuts, step = np.arange(0, len(order), LEAF_SETS), LEAF_SETS
        self.levels = []
        maps, low, high, hidden = self.maps, self.size, self.size, self.hidden
        while True:
            maps, low = np.bitwise_or.reduceat(maps, cuts, axis=0), np.minimum.reduceat(low, cuts)
            high, hidden = np.maximum.reduceat(high, cuts), np.maximum.reduceat(hidden, cuts)
            self.levels.append((step, maps, low, high, hidden))
            if len(maps) == 1:
                break
            cuts, step = np.arange(0, len(maps), FANOUT), step * FANOUT

    def span(self, level: int, k: int) -> slice:
        step = self.levels[level][0]
        return slice(k * step, min((k + 1) * step, len(self.ids)))

    def children(self, level: int, k: int) -> range:
        return range(k * FANOUT, min((k + 1) * FANOUT, len(self.levels[level - 1][1])))


class Join:
    """Links that join what hangs together, between the sets of two trees or of one with itself."""

    def __init__(self, left: Tree, right: Tree, percent: int):
        self.left, self.right, self.percent = left, right, percent
        self.same = left is right
        n = len(left.ids)
        self.root_left = np.arange(n)
        self.root_right = self.root_left if self.same else np.arange(n, n + len(right.ids))
        self.links: list[tuple[int, int]] = []
        #: pairs of nodes met, pairs of sets decided on the full sets
        self.met = self.decided = 0

    def run(self) -> list[tuple[int, int]]:
        top_left, top_right = len(self.left.levels) - 1, len(self.right.levels) - 1
        if self.same:
            self.within(top_left, 0)
        else:
            self.across(top_left, 0, top_right, 0)
        return self.links

    def within(self, level: int, k: int) -> None:
        if level == 0:
            return self.compare(self.left.span(0, k), self.left.span(0, k))
        below = self.left.children(level, k)
        for a in below:
            self.within(level - 1, a)
        for a in below:
            for b in range(a + 1, below.stop):
                self.across(level - 1, a, level - 1, b)

    def across(self, level_a: int, a: int, level_b: int, b: int) -> None:
        left, right = self.left.span(level_a, a), self.right.span(level_b, b)
        self.met += 1
        roots_a, roots_b = self.root_left[left], self.root_right[right]
        if roots_a[0] == roots_b[0] and (roots_a == roots_a[0]).all() and (roots_b == roots_a[0]).all():
            return
        if not self.possible(level_a, a, level_b, b):
            return
        if level_a == level_b == 0:
            return self.compare(left, right)
        if level_a >= level_b:
            for child in self.left.children(level_a, a):
                self.across(level_a - 1, child, level_b, b)
        else:
            for child in self.right.children(level_b, b):
                self.across(level_a, a, level_b - 1, child)

    def possible(self, level_a: int, a: int, level_b: int, b: int) -> bool:
        """Whether some set below one node may be linked with some set below the other."""
        _, maps_a, low_a, high_a, hidden_a = self.left.levels[level_a]
        _, maps_b, low_b, high_b, hidden_b = self.right.levels[level_b]
        la, ha, lb, hb = int(low_a[a]), int(high_a[a]), int(low_b[b]), int(high_b[b])
        if 100 * ha < self.percent * lb or 100 * hb < self.percent * la:
            return False
        most = int(np.bitwise_count(maps_a[a] & maps_b[b]).sum(dtype=np.int64)) + int(min(hidden_a[a], hidden_b[b]))
        return bool(reaches(min(most, ha, hb), la, lb, self.percent))

    def compare(self, left: slice, right: slice) -> None:
        """Sets of two lowest nodes (or of one): bounds of all pairs at once, then the full sets."""
        x, y = self.left, self.right
        size_x, size_y = x.size[left, None], y.size[None, right]
        most = np.bitwise_count(x.maps[left, None] & y.maps[None, right]).sum(2, dtype=np.int64) + np.minimum(x.hidden[left, None], y.hidden[None, right])
        can = reaches(np.minimum(most, np.minimum(size_x, size_y)), size_x, size_y, self.percent)
        can &= self.root_left[left, None] != self.root_right[None, right]
        if left is right or (self.same and left == right):
            can = np.triu(can, 1)
        for i, j in np.argwhere(can).tolist():
            i, j = left.start + i, right.start + j
            if self.root_left[i] == self.root_right[j]:
                continue
            self.decided += 1
            shared = len(np.intersect1d(x.sets[i], y.sets[j], assume_unique=True))
            if reaches(shared, len(x.sets[i]), len(y.sets[j]), self.percent):
                self.links.append((x.ids[i], y.ids[j]))
                low, high = sorted((int(self.root_left[i]), int(self.root_right[j])))
                self.root_left[self.root_left == high] = low
                if not self.same:
                    self.root_right[self.root_right == high] = low


def bits_for(sets: list[np.ndarray]) -> int:
    """Twice the largest set, as a power of two, within limits."""
    return min(MOST_BITS, max(256, 1 << (2 * max(map(len, sets))).bit_length()))


_LINKS = pa.schema([("x", pa.int64()), ("y", pa.int64())])


def _joined(percent: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple[int, int], dict] = {}
        for batch in batches:
            for node, block, data in zip(*(batch.column(c).to_pylist() for c in ("node", "block", "shingles"))):
                sides.setdefault(block, {})[node, data] = None  # equal rows are one set
        links = []
        if len(sides) == 2 or key[1] == key[2]:
            own = [([node for node, _ in side], [np.frombuffer(data, np.uint64) for _, data in side]) for side in sides.values()]
            bits = bits_for([s for _, sets in own for s in sets])
            trees = [Tree(ids, sets, bits) for ids, sets in own]
            links = Join(trees[0], trees[-1], percent).run()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=_LINKS)

    return run


def _meetings(members: DataFrame, percent: int) -> DataFrame:
    """Adds to each set of a family (component, n_shingles) the subtrees' meetings it takes part in: ``block``, ``low``, ``high``.

    A family that fits one subtree meets itself.  Otherwise ranges of sizes are
    made so wide that linked sets fall into one or two that are neighbours, each
    is cut by a hash into subtrees, and each subtree meets itself, the others of
    its range and those of the next.
    """
    sizes = F.floor(F.ln(F.col("n_shingles")) / F.lit(max(float(np.log(100 / percent)), 0.01) * 1.01)).cast("long")
    sets, shingles = F.count(F.lit(1)), F.sum("n_shingles")
    pieces = F.greatest(F.ceil(shingles / TREE_SHINGLES), F.ceil(sets / TREE_SETS)).cast("long")
    marked = members.withColumn("range", sizes)
    ranges = marked.groupBy("component", "range").agg(pieces.alias("pieces"), sets.alias("sets"), shingles.alias("shingles"))
    families = ranges.groupBy(F.col("component").alias("family")).agg(
        ((F.sum("sets") <= TREE_SETS) & (F.sum("shingles") <= TREE_SHINGLES)).alias("whole"),
        F.map_from_entries(F.collect_list(F.struct("range", "pieces"))).alias("cut"),
    )
    placed = marked.join(families, F.col("component") == F.col("family"))
    cut = F.when(F.col("whole"), F.lit(1).cast("long")).otherwise(F.element_at("cut", F.col("range")))
    placed = placed.withColumn("range", F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("range"))).withColumn(
        "piece", F.pmod(F.xxhash64("node", "set1"), cut)
    )
    # a subtree's number: range and piece; ranges are few
    number = lambda at, piece: at * F.lit(1 << 40) + piece
    pieces_of = lambda at: F.when(~F.col("whole"), F.try_element_at("cut", at))
    others = lambda at, n: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda p: number(at, p))).otherwise(F.array().cast("array<bigint>"))
    own = F.when(F.col("whole"), F.array(F.lit(0).cast("long"))).otherwise(others(F.col("range"), pieces_of(F.col("range"))))
    below, above = F.col("range") - 1, F.col("range") + 1
    meet = F.concat(own, others(below, F.coalesce(pieces_of(below), F.lit(0))), others(above, F.coalesce(pieces_of(above), F.lit(0))))
    return placed.withColumn("block", number(F.col("range"), F.col("piece"))).withColumn("with", F.explode(meet)).withColumn(
        "low", F.least("block", "with")
    ).withColumn("high", F.greatest("block", "with"))


def similar_groups(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two texts link if ``100 * intersection >= percent * union`` of their sets of
    ``words``-word shingles (lower-cased A-Z, words parted by ASCII white space;
    a text of fewer words is one shingle).  ``percent`` is 80 or more, as the
    candidates are found for that.

    Null texts, and texts without words, have no shingles and link with nothing.
    An id of several texts links what each of them links with; repeated rows are
    rows of the result each.  A row with a null id links with nothing and has a
    null component.  Other columns are not read; an empty table gives no rows.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    with arrow_batches(docs.sparkSession):
        return _similar(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), words, percent)


def _similar(texts: DataFrame, words: int, percent: int) -> DataFrame:
    signs = materialise(texts.select("doc_id", F.xxhash64("text").alias("text_hash"), signed(F.col("text"), words).alias("s")).select("doc_id", "text_hash", "s.*"))
    named = signs.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # one row a class, with the text that stands for it
    classes = materialise(named.groupBy("set1", "set2").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles")).alias("least"), F.max("bands").alias("bands")).select(
        "set1", "set2", F.col("least.doc_id").alias("node"), F.col("least.text_hash").alias("text_hash"), "least.n_shingles", "bands"
    ))
    in_bands = classes.select("node", F.explode("bands").alias("band"))
    centres = in_bands.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("band").alias("b"), "centre")
    stars = in_bands.join(centres, F.col("band") == F.col("b")).filter("node <> centre").select(F.col("node").alias("x"), F.col("centre").alias("y")).distinct()
    near = components(stars)
    families = near.unionByName(near.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("k"), "component")
    members = materialise(classes.drop("bands").join(families, F.col("node") == F.col("k")).drop("k"))

    meetings = _meetings(members, percent).select("component", "low", "high", "block", "node", F.col("text_hash").alias("h"))
    sets = _sets(texts, members, words)
    links = (
        meetings.join(sets, (F.col("node") == F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).select("component", "low", "high", "block", "node", "shingles")
        .groupBy("component", "low", "high").applyInArrow(_joined(percent), "x long, y long")
    )
    joined = components(links).select(F.col("node").alias("k"), "component")
    at = classes.join(joined, F.col("node") == F.col("k"), "left").select(F.col("set1").alias("s1"), F.col("set2").alias("s2"), F.coalesce("component", "node").alias("component"))
    found = signs.join(at, (F.col("set1") == F.col("s1")) & (F.col("set2") == F.col("s2")), "left")
    component: Column = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def _sets(texts: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, shingles) of the members' texts; other texts are not shuffled."""
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    own = members_of(hashed, members.select(F.col("node").alias("m_id"), F.col("text_hash").alias("m_hash")), ["doc_id", "text_hash"], ["m_id", "m_hash"])
    own = own.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    return materialise(own.select("doc_id", "text_hash", shingle_set(F.col("text"), words).alias("shingles")))
