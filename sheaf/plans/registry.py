"""Named queries over the given tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.plans.inputs import Inputs, with_inputs


@dataclass(frozen=True)
class Query:
    ids: str
    run: Callable[[Inputs], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}
# expected tables that several comparison queries share
EXPECTED: dict[str, str] = {}


def query(name: str, ids: str, oracle: str | None = None):
    def add(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} defined twice")
        QUERIES[name] = Query(ids, fn, with_inputs(oracle, EXPECTED) if oracle else None)
        return fn

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so both engines show the same types."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name) for f in df.schema])


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(QUERIES[name].run(Inputs(spark, sf_dir)))

    run.__name__ = name
    return run
