"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

A_TO_Z, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Rows whose results a worker holds before it hands them on.
PART_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(value: Callable[[str | None], tuple | None], schema: str, setup: Callable | None = None) -> Callable[[Column], Column]:
    """A struct column computed from one text at a time.

    Only the text goes to Python, in Arrow batches that Spark bounds by bytes;
    all other columns stay where they are.  ``setup`` runs once per task and
    its result is the second argument of ``value``.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = (setup(),) if setup else ()
        for batch in batches:
            # results go on in small parts, so those of a whole batch are not held as Python objects and once more as arrays
            for at in range(0, max(1, len(batch)), PART_ROWS):
                yield batch_of([value(text, *state) for text in texts_of(batch.slice(at, PART_ROWS))], schema)

    return lambda text: arrow_udf(run, schema)(text)


def texts_of(batch: pa.Array) -> Iterator[str | None]:
    """The texts of a batch, few of them as Python objects at a time.

    What earlier batches of this worker took, tens of megabytes with long texts,
    goes back to the system first; idle workers would hold it beside the next stage.
    """
    pa.default_memory_pool().release_unused()
    for at in range(0, len(batch), 128):
        yield from batch.slice(at, 128).to_pylist()


def batch_of(rows: list[tuple | None], schema: str) -> pa.Array:
    """Rows as one Arrow struct array of a schema given as text."""
    kind = arrow_type(schema)
    cols = list(zip(*rows)) or [[] for _ in kind]
    return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kind)], fields=list(kind))


def arrow_type(schema: str) -> pa.StructType:
    simple = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
        "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    }
    return pa.struct([pa.field(name, simple[kind]) for name, kind in (part.strip().split(" ", 1) for part in schema.split(","))])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (every bit of the input moves every bit of the output)."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive words; of all words if there are fewer, none if there are none."""
    n = min(n, len(h))
    if not n:
        return h
    size = len(h) - n + 1
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mixed(out * ODD + h[k : k + size])
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` is called so (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def doc_crc(doc_id: str | Column) -> Column:
    """crc32 of the id as text; of the empty text for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


#: Bits of the bitmap that thins out rows before they are shuffled; as 64-bit words it is at most 131,072 rows, whatever the number of members.
MEMBER_BITS = 1 << 23


def members_of(rows: DataFrame, members: DataFrame, keys: list[str], member_keys: list[str]) -> DataFrame:
    """Rows whose keys are among those of ``members``, a written table with few of them.

    A bitmap of the members' hashed keys, of a fixed size, goes to all tasks and
    drops most other rows where they are read; a join decides on the rest.
    So long columns of rows that are no members are not shuffled.  Null keys
    are no members.
    """
    def slot(names: list[str]) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(MEMBER_BITS))

    def bit(names: list[str]) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), slot(names).bitwiseAND(F.lit(63).cast("long")).cast("int"))

    word, mark = free_name(rows, "__word"), free_name(rows, "__marks")
    marks = members.groupBy(F.shiftright(slot(member_keys), 6).alias(word)).agg(F.bit_or(bit(member_keys)).alias(mark))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    likely = rows.join(F.broadcast(marks), F.shiftright(slot(keys), 6) == F.col(word)).filter(F.col(mark).bitwiseAND(bit(keys)) != 0).select(*columns)
    # an inner join: a semi-join would be moved below the bitmap
    wanted = members.select(*[F.col(m).alias(f"__member{i}") for i, m in enumerate(member_keys)]).distinct()
    return likely.join(wanted, [F.col(k) == F.col(f"__member{i}") for i, k in enumerate(keys)]).select(*columns)
