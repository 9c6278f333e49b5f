"""Sum-of-squares packing of token pieces into sequences.

The state is the number of open sequences per residual gap.  A piece goes where
the sum of the squares of these numbers becomes smallest, so that no gap is
common and for every later size some gap is left.  Pieces come in order of
decreasing size and open a sequence only where none has room: over the sizes of
a whole table this is what uses fewest sequences (README.md has figures).

Only sizes matter, so pieces are dealt to groups by a hash of their row and the
groups are packed apart; each loses about one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.session import materialise
from sheaf.llm.tokens import token_pieces

CAPACITY = 2048
#: Pieces packed together in one task.
GROUP = 40_000


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; sizes from 1 to the capacity.

    Equal sizes are placed in the given order; equal sums of squares go to the
    tightest gap.
    """
    n = len(sizes)
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a full one is not open
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_sequences = 0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        # gaps s, s + 1, ...: moving one sequence from gap g to gap g - s changes the sum by 2 (count[g - s] - count[g] + 1),
        # and filling it up (g = s) by 1 - 2 count[g]
        now = count[s:capacity]
        change = 2 * (count[: capacity - s] - now + 1)
        if len(change):
            change[0] = 1 - 2 * now[0]
        fits = np.flatnonzero(now)
        if len(fits):
            gap = s + int(fits[np.argmin(change[fits])])
            place = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, place = capacity, n_sequences
            n_sequences += 1
        sequence[i], offset[i] = place, capacity - gap
        if gap > s:
            open_[gap - s].append(place)
            count[gap - s] += 1
    return sequence, offset


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack_group(capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("no").combine_chunks()
        sequence, offset = pack(rows["length"].to_numpy(), capacity)
        out = [rows[c] for c in names] + [pa.array((key[0].as_py() << 32) + sequence), pa.array(offset)]
        yield from pa.table(out, names=[*names, "sequence_id", "offset"]).to_batches()

    return run


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP
) -> DataFrame:
    """Every document's token pieces and their places.

    Returns doc_id (long), piece, start, length, ids_crc32, sequence_id, offset.
    A document is its text's ids and one end id, so null and empty texts have
    length 1; only documents longer than ``capacity`` are cut.  Repeated rows
    are documents of their own, null ids stay null, other columns are not read,
    an empty table gives no rows.  Pieces that fill a sequence alone are not
    dealt to a group.
    """
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), token_pieces(F.col(text_col), path, capacity).alias("p"))
    each = cut.select("doc_id", F.posexplode(F.arrays_zip("p.starts", "p.lengths", "p.crcs")).alias("piece", "x"))
    # the row number is fixed by writing the table, so that a lost task deals its pieces as before
    pieces = materialise(
        each.select(
            "doc_id", "piece", F.col("x.starts").alias("start"), F.col("x.lengths").alias("length"), F.col("x.crcs").alias("ids_crc32"),
            F.monotonically_increasing_id().alias("no"),
        )
    )
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, round(short.count() / group))
    packed = (
        short.withColumn("group", F.pmod(F.xxhash64("no"), F.lit(groups)))
        .groupBy("group").applyInArrow(_pack_group(capacity), PACKED)
    )
    full = pieces.filter(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)
