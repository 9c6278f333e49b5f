"""The hash tree against a plain descent with the same draws."""

import math

import pytest
import xxhash
from pyspark.sql import functions as F

from sheaf.llm import sharding


def plain_shard(key, tree):
    """Region, rack and shard by the smallest -ln(u) / weight, u from the hash of key and child."""
    text = "null" if key is None else str(key)

    def pick(children):
        draws = []
        for name, weight in children.items():
            h = xxhash.xxh64_intdigest(name.encode(), seed=xxhash.xxh64_intdigest(text.encode(), seed=42))
            draws.append((-math.log(((h >> 12) + 0.5) / (1 << 52)) / weight, name))
        return min(draws)[1]

    def weights(name, leaves):
        out = {}
        for x in leaves:
            out[name(x)] = out.get(name(x), 0) + x.weight
        return out

    leaves = [x for x in tree if x.weight > 0]
    region = pick(weights(lambda x: x.region, leaves))
    leaves = [x for x in leaves if x.region == region]
    rack = pick(weights(lambda x: x.rack, leaves))
    leaves = [x for x in leaves if x.rack == rack]
    return int(pick(weights(lambda x: f"shard{x.shard}", leaves))[5:])


@pytest.mark.parametrize("tree", [
    sharding.planned_tree(40), sharding.planned_tree(41),
    [sharding.Leaf(s, f"r{s % 3}", f"r{s % 3}/k{s % 2}", [0.0, 0.5, 1.0, 4.0][s % 4]) for s in range(13)],
])
def test_descent_equals_a_plain_one(spark, tree):
    keys = [*range(-5, 400), 2**62, None]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.shard_of(F.col("k"), tree).alias("shard")).collect()
    assert {r["k"]: r["shard"] for r in rows} == {k: plain_shard(k, tree) for k in keys}
    assert not {x.shard for x in tree if not x.weight} & {r["shard"] for r in rows}
