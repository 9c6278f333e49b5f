"""Merkle manifest of a table, its leaf coordinates found by ranks in bitmaps.

1. Every row becomes a leaf, a digest of its fields; rows are hashed where they
   are read and only (group, id, digest) goes on.
2. The ids of each group become bitmap words of 64 ids.  Tasks build partial
   words and they are merged by OR; words without a bit are not stored.  A
   directory keeps the number of rows before each word, from popcounts summed
   over a few levels of word prefixes.  The rank of an id, and so the place of
   its leaf, is the directory's count plus the popcount of the lower bits: no
   group is sorted.  Ids of several rows carry how many more there are.
3. Leaves go, by place, into slot arrays of 1,024; each array is reduced ten
   levels at once to one node, and the nodes again, up to the group's root.  The
   groups' roots, in the order of the groups, are the leaves of the last tree.
4. On the way down every slot array meets the path above it, so each row gets
   its siblings without a table of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.session import materialise
from sheaf.llm.common import doc_crc

#: Levels that one slot array reduces; it has up to 2 ** LEVELS slots.
LEVELS = 10
#: Bits of a word's number that each level of the directory resolves; its windows hold at most 2 ** bits words.
DIRECTORY = (10, 16, 16)

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """The 32 bytes of a row's digest."""
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)), 256))


# ---- coordinates ----

def _starts(nodes: DataFrame, bits: Sequence[int]) -> DataFrame:
    """Adds to (grp, node, rows) ``start``, the rows of smaller nodes in the group, and ``n``, all rows of the group."""
    before = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    if not bits:
        whole = before.partitionBy("grp")
        return nodes.withColumn("start", F.coalesce(F.sum("rows").over(whole), F.lit(0))).withColumn("n", F.sum("rows").over(Window.partitionBy("grp")))
    marked = nodes.withColumn("up", F.shiftright("node", bits[0]))
    upper = _starts(marked.groupBy("grp", F.col("up").alias("node")).agg(F.sum("rows").alias("rows")), bits[1:])
    upper = upper.select(F.col("grp").alias("g"), F.col("node").alias("u"), F.col("start").alias("s"), "n")
    inside = F.coalesce(F.sum("rows").over(before.partitionBy("grp", "up")), F.lit(0))
    return (
        marked.withColumn("inside", inside).join(upper, (F.col("grp") == F.col("g")) & F.col("up").eqNullSafe(F.col("u")))
        .withColumn("start", F.col("s") + F.col("inside")).drop("up", "inside", "g", "u", "s")
    )


def coordinates(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the place from 0 of each row in its group by id, and ``n``, the rows of the group.

    ``rows`` is a written table of (grp, id, leaf, bent), ``grp`` not null.  Null
    ids come first.  Rows of one id are placed by leaf; equal leaves are one
    class that is counted and spread again, so no task holds all rows of an id.
    """
    place = F.col("id").bitwiseAND(F.lit(63).cast("long")).cast("int")
    one = F.lit(1).cast("long")
    marked = rows.withColumn("word", F.shiftright("id", 6)).withColumn("place", place)
    ids = marked.groupBy("grp", "id", "word", "place").agg(F.count(F.lit(1)).alias("k"))
    words = materialise(ids.groupBy("grp", F.col("word").alias("node")).agg(
        F.bit_or(F.call_function("shiftleft", one, F.col("place"))).alias("bits"), F.sum("k").alias("rows"),
        F.collect_list(F.when(F.col("k") > 1, F.struct("place", (F.col("k") - 1).alias("more")))).alias("repeated"),
    ))
    starts = _starts(words.select("grp", "node", "rows"), DIRECTORY)
    directory = words.select(F.col("grp").alias("g"), F.col("node").alias("w"), "bits", "repeated", F.col("rows").alias("own")).join(
        starts.select(F.col("grp").alias("sg"), F.col("node").alias("sw"), "start", "n"), (F.col("g") == F.col("sg")) & F.col("w").eqNullSafe(F.col("sw"))
    ).drop("sg", "sw")
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("place")))
    lower = F.bit_count(F.col("bits").bitwiseAND(below))
    more = F.aggregate(F.filter("repeated", lambda x: x["place"] < F.col("place")), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    tied = F.when(F.col("id").isNull(), F.col("own") > 1).otherwise(F.exists("repeated", lambda x: x["place"] == F.col("place")))
    ranked = marked.join(directory, (F.col("grp") == F.col("g")) & F.col("word").eqNullSafe(F.col("w"))).select(
        "grp", "id", "leaf", "bent", "n", (F.col("start") + F.coalesce(lower, F.lit(0)) + F.coalesce(more, F.lit(0))).alias("pos"), tied.alias("tied")
    )
    single = ranked.filter("NOT tied").drop("tied")
    if not words.filter((F.size("repeated") > 0) | (F.col("node").isNull() & (F.col("rows") > 1))).limit(1).count():
        return single
    # ids of several rows: by leaf, in ranges of its first two bytes
    classes = ranked.filter("tied").groupBy("grp", "id", "leaf").agg(
        F.count(F.lit(1)).alias("copies"), F.min("bent").alias("bent"), F.min("n").alias("n"), F.min("pos").alias("pos")
    ).withColumn("range", F.hex(F.substring("leaf", 1, 2)))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = classes.groupBy(F.col("grp").alias("g"), F.col("id").alias("i"), F.col("range").alias("r")).agg(F.sum("copies").alias("all"))
    ranges = ranges.withColumn("skip", F.coalesce(F.sum("all").over(before.partitionBy("g", "i").orderBy("r")), F.lit(0))).drop("all")
    inside = F.coalesce(F.sum("copies").over(before.partitionBy("grp", "id", "range").orderBy("leaf")), F.lit(0))
    spread = (
        classes.withColumn("inside", inside)
        .join(ranges, (F.col("grp") == F.col("g")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("range") == F.col("r")))
        .withColumn("pos", F.col("pos") + F.col("skip") + F.col("inside"))
        # copies of one row, a few thousand to a task
        .withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(4096).cast("long")))).repartition("leaf", "at")
        .withColumn("at", F.explode(F.sequence("at", F.least(F.col("at") + 4095, F.col("copies") - 1))))
        .select("grp", "id", "leaf", "bent", "n", (F.col("pos") + F.col("at")).alias("pos"))
    )
    return single.unionByName(spread)


# ---- trees ----

def digest(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def slot_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """A slot array and what each level above makes of it: two nodes become one, the last of an odd number alone too."""
    out = [nodes]
    for _ in range(levels):
        low = out[-1]
        out.append([digest(*low[k : k + 2]) for k in range(0, len(low), 2)])
    return out


def _height(n: int) -> int:
    return (n - 1).bit_length()


def _slots(table: pa.Table) -> tuple[list[int], list[str]]:
    """Row numbers of a slot array's table, by place, and the nodes there."""
    pos = table.column("pos").to_pylist()
    order = sorted(range(len(pos)), key=pos.__getitem__)
    nodes = table.column("node").to_pylist()
    return order, [nodes[k].hex() for k in order]


NODES = "tree string, n long, pos long, node binary"


def _reduced(base: int, levels: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        top = slot_levels(_slots(table)[1], max(0, min(levels, _height(n) - base)))[-1]
        return pa.table({"tree": [key[0].as_py()], "n": pa.array([n], pa.int64()), "pos": pa.array([key[1].as_py()], pa.int64()), "node": [bytes.fromhex(top[0])]})

    return run


def _array(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("slots", F.shiftright("pos", LEVELS))


def tree_levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The nodes of every LEVELS-th level of each tree up to its root; ``most`` is the largest number of leaves."""
    out = [nodes]
    for _ in range(max(1, -(-_height(max(most, 1)) // LEVELS))):
        base = (len(out) - 1) * LEVELS
        low = out[-1].select("tree", "n", "pos", "node")
        out.append(materialise(_array(low).groupBy("tree", "slots").applyInArrow(_reduced(base, LEVELS), NODES)))
    return out


def siblings(levels: list[list[str]], at: int) -> tuple[str, str]:
    """Sides (L, R, or N for none) and digests of the siblings of a slot, level by level."""
    sides, nodes = [], []
    for level in levels[:-1]:
        other = at ^ 1
        if other < len(level):
            sides.append("L" if other < at else "R")
            nodes.append(level[other])
        else:
            sides.append("N")
        at >>= 1
    return "".join(sides), "".join(nodes)


def fold(node: str, sides: str, path: str) -> str:
    """The root that a node and its siblings lead to."""
    at = 0
    for side in sides:
        if side == "N":
            node = digest(node)
            continue
        other = path[at : at + 64]
        at += 64
        node = digest(other, node) if side == "L" else digest(node, other)
    return node


PATHS = "tree string, pos long, sides string, path string, subroot string, root string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _placed(base: int, height: int, low: pa.Table, above: pa.Table):
    """(row number, sides, path) of each slot of an array, and the row above."""
    up = above.to_pylist()[0]
    order, nodes = _slots(low)
    levels = slot_levels(nodes, max(0, min(height, _height(low.column("n")[0].as_py()) - base)))
    for at, row in enumerate(order):
        sides, path = siblings(levels, at)
        yield row, nodes[at], sides + up["sides"], path + up["path"], up


def _paths(base: int, height: int):
    def run(key: tuple[pa.Scalar, ...], low: pa.Table, above: pa.Table) -> pa.Table:
        pos = low.column("pos").to_pylist()
        rows = [(key[0].as_py(), pos[row], sides, path, up["subroot"], up["root"]) for row, _, sides, path, up in _placed(base, height, low, above)]
        return pa.table(dict(zip([c.split()[0] for c in PATHS.split(", ")], [pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(zip(*rows))])))

    return run


def _proofs(base: int, height: int):
    def run(key: tuple[pa.Scalar, ...], low: pa.Table, above: pa.Table) -> pa.Table:
        ids, bent = low.column("id").to_pylist(), low.column("bent").to_pylist()
        rows = []
        for row, node, sides, path, up in _placed(base, height, low, above):
            folded = fold(bent[row].hex(), sides, path)
            rows.append((ids[row], node, up["subroot"], up["root"], digest(path), folded, folded == up["root"]))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        return pa.table(dict(zip([c.split()[0] for c in PROOFS.split(", ")], [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)])))

    return run


def _down(levels: list[DataFrame], above: DataFrame, last: Callable, schema: str) -> DataFrame:
    """From the roots' paths to those of the lowest level; ``last`` makes the rows there."""
    for j in range(len(levels) - 2, -1, -1):
        run, kind = (last(0, LEVELS), schema) if j == 0 else (_paths(j * LEVELS, LEVELS), PATHS)
        above = _array(levels[j]).groupBy("tree", "slots").cogroup(above.groupBy("tree", "pos")).applyInArrow(run, kind)
    return above


def _in_order(roots: DataFrame) -> DataFrame:
    """Adds ``pos`` from 0 by ``lang``, null first, by sorted ranges of it: there may be very many groups."""
    parts = materialise(roots.repartitionByRange("lang").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("lang")) - 1
    return parts.withColumn("place", place).join(starts, F.col("part") == F.col("p")).withColumn("pos", F.col("start") + F.col("place")).drop("part", "p", "start", "place")


def manifest(docs: DataFrame, bent: Column | None = None, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of ``fields``; ``bent`` is the leaf (32 bytes) that is
    held against the manifest, the row's own if not given.  Leaves of a group
    ascend by id, null ids first, rows of one id by leaf; every two consecutive
    nodes become one, and so do the groups' roots, null first, then by the bytes
    of their name.  ``folded_root`` is computed from the bent leaf and the
    siblings, ``verified`` whether it is the root.

    Nulls in any field are part of the digest, and a null group is a group.
    Equal rows are a leaf each.  Empty and long texts are fields like any other.
    Columns besides ``fields`` are not read.  An empty table gives no rows.
    """
    own = leaf([F.col(f"`{c}`") for c in fields])
    rows = materialise(docs.select(
        encoded(F.col(f"`{group_col}`")).alias("grp"), F.col(f"`{group_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").cast("long").alias("id"),
        own.alias("leaf"), (own if bent is None else bent).alias("bent"),
    ))
    leaves = materialise(coordinates(rows.drop("lang")).select(F.col("grp").alias("tree"), "n", "pos", F.col("leaf").alias("node"), "bent", "id"))
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        return leaves.sparkSession.createDataFrame([], PROOFS)
    levels = tree_levels(leaves, most)
    groups = rows.groupBy(F.col("grp").alias("g")).agg(F.min("lang").alias("lang"))
    roots = _in_order(levels[-1].join(groups, F.col("tree") == F.col("g")).select("lang", "node", F.col("tree").alias("grp")))
    upper = materialise(roots.select(F.lit("").alias("tree"), "pos", "node", "grp"))
    n = upper.count()
    top = tree_levels(upper.withColumn("n", F.lit(n).cast("long")), n)
    hexed = F.lower(F.hex("node"))
    peak = top[-1].select("tree", "pos", F.lit("").alias("sides"), F.lit("").alias("path"), F.lit("").alias("subroot"), hexed.alias("root"))
    paths = _down(top, peak, _paths, PATHS)
    above = upper.select("grp", "node", F.col("pos").alias("at")).join(paths, F.col("at") == F.col("pos")).select(
        F.col("grp").alias("tree"), F.lit(0).cast("long").alias("pos"), "sides", "path", hexed.alias("subroot"), "root"
    )
    return _down(levels, materialise(above), _proofs, PROOFS)


def changed_size(docs: DataFrame) -> Column:
    """The leaf of a ``documents`` row whose n_chars is one too high where 7 divides the id's crc32; null ids and sizes stay."""
    hit = (F.pmod(doc_crc("doc_id"), F.lit(7)) == 0) & F.col("doc_id").isNotNull()
    more = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return leaf([more if c == "n_chars" else F.col(c) for c in FIELDS])
