"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels.  At each level every child draws
``-ln(u) / weight`` with ``u`` from a hash of the key and the child's own name,
and the smallest draw wins (weighted rendezvous).  A child's draw does not
depend on its siblings, so when the weight of a subtree grows, rows move only
into that subtree, and when it shrinks only out of it; all other rows keep
their place.

All of it is column expressions over the tree, which is fixed data of a few
dozen nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks per shard in which rows are numbered; each is one window group.
SLOT_BLOCKS = 1024


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def planned_tree(shards: int, base: int = 40, racks: int = 2, per_rack: int = 5) -> list[Leaf]:
    """Up to ``base`` shards in racks of ``per_rack``, then one region for each further shard.

    A further shard is a region of its own, so growing past ``base`` moves rows
    only into the new shard.
    """
    per_region = racks * per_rack
    out = []
    for s in range(shards):
        if s < base:
            region, rest = divmod(s, per_region)
            out.append(Leaf(s, f"region{region}", f"region{region}/rack{rest // per_rack}"))
        else:
            out.append(Leaf(s, f"added{s}", f"added{s}/rack0"))
    return out


def _draw(key: Column, child: Column) -> Column:
    # 52 bits of the hash, never 0 and never 1
    u = (F.shiftrightunsigned(F.xxhash64(key, child["name"]), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(u) / child["weight"]


def _winner(key: Column, children: Column) -> Column:
    """The child with the smallest draw, of an array of (name, weight); equal draws by name."""
    return F.array_min(F.transform(children, lambda c: F.struct(_draw(key, c).alias("draw"), c["name"].alias("name"))))["name"]


def _nodes(children: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in children.items()])


def _below(level: dict[str, dict[str, float]]) -> Column:
    return F.create_map(*[x for parent, children in level.items() for x in (F.lit(parent), _nodes(children))])


def shard_of(key: Column, tree: Sequence[Leaf]) -> Column:
    """The shard of a key.  Null is a key like any other (the text 'null').

    Leaves without weight take no rows; a tree without weight is an error.
    """
    leaves = [x for x in tree if x.weight > 0]
    if not leaves or len({x.shard for x in leaves}) < len(leaves):
        raise ValueError("a tree needs leaves with weight, each shard once")
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[str, float]] = {}
    for x in leaves:
        regions[x.region] = regions.get(x.region, 0) + x.weight
        own = racks.setdefault(x.region, {})
        own[x.rack] = own.get(x.rack, 0) + x.weight
        shards.setdefault(x.rack, {})[f"shard{x.shard}"] = x.weight
    key = F.coalesce(key.cast("string"), F.lit("null"))
    region = _winner(key, _nodes(regions))
    rack = _winner(key, F.element_at(_below(racks), region))
    return F.substring(_winner(key, F.element_at(_below(shards), rack)), 6, 9).cast("int")


def with_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str, blocks: int = SLOT_BLOCKS) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps.

    A shard is cut into hash blocks; rows are numbered inside their block and
    the sizes of the blocks before are added, so no task holds a whole shard.
    """
    block, start = "__block", "__start"
    marked = df.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    sizes = marked.groupBy(shard, block).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(shard).alias("__s"), F.col(block).alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start)
    )
    inside = F.row_number().over(Window.partitionBy(shard, block).orderBy(*order)) - 1
    numbered = marked.withColumn(slot, inside.cast("long"))
    return (
        numbered.join(starts, (F.col(shard) == F.col("__s")) & (F.col(block) == F.col("__b")))
        .withColumn(slot, F.col(slot) + F.col(start))
        .drop(block, start, "__s", "__b")
    )


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", base: int = 40) -> DataFrame:
    """Places documents in shards by their id; law ``key``.

    ``base`` is the number of shards planned at first and stays when ``shards``
    grows past it, so that rows move only into the new shard.  Below ``base`` a
    region fills up, and rows may also move to old shards of it.

    Returns doc_id, size (UTF-8 bytes, null none, plus 16), text_crc32, law,
    shard, slot and grown_shard (the shard once there is one more).  Each row is
    placed, repeated rows too (one slot each); rows with equal ids share a shard.
    Other columns are not read.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col(id_col)
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, planned_tree(shards, base=base)).alias("shard"),
        shard_of(key, planned_tree(shards + 1, base=base)).alias("grown_shard"),
    )
    return with_slots(placed, "shard", ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
