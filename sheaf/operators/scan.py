"""Running computations over long ordered groups.

A window partitioned by the group key puts a whole group into one task.  These
operators cut each group into blocks by its order, run the window inside the
blocks, and carry one summary row per block forward.  Rows are shuffled once,
by (key, block), so a group with a third of all rows is spread over many
tasks.  For groups that fit in one block nothing is carried, and adaptive
execution drops the empty carry join.

``block`` is any expression that never decreases along ``order``.  Key columns
must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.presets import SCAN_BLOCK

_BLOCK = "__block"


def blocks(order: str | Column, size: int = SCAN_BLOCK) -> Column:
    """Block number of an integer order column."""
    return F.floor((F.col(order) if isinstance(order, str) else order) / size)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | str,
    /,
    **outs: tuple[str, Column],
) -> DataFrame:
    """Several running values at once, each ``name=(kind, value)``.

    Kinds: ``sum`` and ``max`` of the values so far, ``last`` non-null value so
    far, ``previous`` value of the row just before.  A block given as a column
    name is used as it is, so a chain of calls over it shuffles only once.
    """
    keys = list(keys)
    own_block = block if isinstance(block, str) else _BLOCK
    marked = df if isinstance(block, str) else df.withColumn(_BLOCK, block)
    for name, (kind, value) in outs.items():
        marked = marked.withColumn(f"__v_{name}", F.struct(value.alias("v")) if kind == "previous" else value)
    inside = Window.partitionBy(*keys, own_block).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(own_block).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    local, summary, carry = [], [], []
    for name, (kind, _) in outs.items():
        v = F.col(f"__v_{name}")
        if kind in ("sum", "max"):
            fold = {"sum": F.sum, "max": F.max}[kind]
            local.append(fold(v).over(so_far).alias(name))
            summary.append(fold(v).alias(name))
            carry.append(fold(name).over(before).alias(f"__c_{name}"))
        else:
            local.append(
                (F.lag(v).over(inside) if kind == "previous" else F.last(v, ignorenulls=True).over(so_far)).alias(name)
            )
            summary.append(F.max_by(v, F.when(v.isNotNull(), position)).alias(name))
            carry.append(F.last(name, ignorenulls=True).over(before).alias(f"__c_{name}"))

    # Rows of a first block have no earlier block and need no carry row.
    earlier = marked.groupBy(*keys, own_block).agg(*summary).select(
        *keys, own_block, F.row_number().over(Window.partitionBy(*keys).orderBy(own_block)).alias("__n"), *carry
    )
    joined = (
        marked.select(*dict.fromkeys([*df.columns, own_block]), *local)
        .join(earlier.filter("__n > 1").drop("__n"), [*keys, own_block], "left")
    )
    final = []
    for name, (kind, _) in outs.items():
        here, carried = F.col(name), F.col(f"__c_{name}")
        if kind == "sum":
            value = F.coalesce(here + carried, here, carried)
        elif kind == "max":
            value = F.greatest(here, carried)
        else:
            value = F.coalesce(here, carried)
        final.append((value["v"] if kind == "previous" else value).alias(name))
    return joined.select(*df.columns, *final)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    out: str,
    start: int = 1,
) -> DataFrame:
    """Position of each row in its group."""
    counted = running(df, keys, order, block, **{out: ("sum", F.lit(1).cast("bigint"))})
    return counted if start == 1 else counted.withColumn(out, F.col(out) + (start - 1))


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, out: str
) -> DataFrame:
    """Latest non-null ``value`` at or before each row."""
    return running(df, keys, order, block, **{out: ("last", value)})


def join_ordered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, sep: str, out: str, **sums: Column
) -> DataFrame:
    """Ordered text of each group, and sums over it: one row per group.

    The text is joined block by block first, so a long group is put together
    by many tasks and the last step sees one text a block.  ``block`` never
    decreases along ``order``.
    """
    place = F.struct(*order)
    inner = df.select(*keys, block.alias(_BLOCK), place.alias("p"), value.alias("v"), *[c.alias(n) for n, c in sums.items()])
    texts = F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda x: x["v"])
    parts = inner.groupBy(*keys, _BLOCK).agg(F.array_join(texts, sep).alias("t"), *[F.sum(n).alias(n) for n in sums])
    whole = F.transform(F.sort_array(F.collect_list(F.struct(F.col(_BLOCK).alias("b"), "t"))), lambda x: x["t"])
    return parts.groupBy(*keys).agg(F.array_join(whole, sep).alias(out), *[F.sum(n).alias(n) for n in sums])
