"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from brute import plain_negatives
from pyspark.sql import functions as F

from sheaf.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, part int, block string, q int"


def found(spark, rows, parts=3):
    frame = spark.createDataFrame([(i, v, label, 1, "b", 2) for i, label, v in rows], SCHEMA).repartition(parts)
    out = hardneg.hard_negatives(frame, F.col("label"), F.col("vec_id") % 100 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def whole(rows):
    return [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows]


def clustered(seed, n, dim=8, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for k in range(n):
        label = rng.randrange(labels)
        near = centres[label if rng.random() < 0.7 else rng.randrange(labels)]
        rows.append((k * 10, label, [x + rng.gauss(0, 0.1) for x in near]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_products(spark, monkeypatch, seed):
    monkeypatch.setattr(hardneg, "BLOCK_ANCHORS", 12)
    monkeypatch.setattr(hardneg, "PART_ROWS", 90)
    rows = clustered(seed, 400)
    rows += [(4001 + k, k % 3, rows[5][2]) for k in range(40)]  # ties
    want = plain_negatives(whole(rows))
    assert len(want) > 300 and found(spark, rows) == want


def test_rows_that_take_no_part(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.8, 0.2]), (3, 2, [0.85]), (4, 3, []), (100, 2, [-1.0, 0.0]), (101, 2, [1.0, 1.0]), (200, 7, [1.0, 1.0])]
    none = [(5, None, [1.0, 0.0]), (6, 2, None), (7, 2, [0.9, None]), (8, 2, [float("nan"), 0.0]), (9, 2, [float("inf"), 0.0]), (None, 2, [0.9, 0.0]), (10, 2, [3e37, 3e37])]
    again = [(2, 5, [0.9, 0.0]), (3, 2, [0.85])]  # the least by label stands
    want = plain_negatives(whole(rows))
    assert want and found(spark, rows + none + again) == want
    assert found(spark, []) == [] and found(spark, none) == [] and found(spark, rows[1:5]) == []


def test_large_scores_stay_exact(spark):
    rng = random.Random(4)
    rows = [(50 * k, k % 2, [rng.uniform(2**20, 2**21) * rng.choice([1, 1, -1]) for _ in range(3)]) for k in range(60)]
    assert found(spark, rows) == plain_negatives(whole(rows))


def test_intervals_hold_and_spare_products():
    rng = np.random.default_rng(3)
    q = np.floor(256 * (rng.normal(size=(4, 16))[rng.integers(0, 4, 300)] + rng.normal(scale=0.02, size=(300, 16)))).astype(np.int64)
    order, parent, edge = hardneg.spanning_tree(q[:50])
    assert sorted(order) == list(range(50)) and parent[0] == -1 and all(parent[1:] < np.arange(1, 50))
    import pyarrow as pa

    found = hardneg.Candidates(pa.table({"vec_id": pa.array(range(300)), "label": pa.array([0] * 300), "q": pa.array(list(q))}), 16)
    tree, scored = q[:50][order], 0
    exact = tree @ q.T

    def wanted(i, low, high):
        assert (low <= exact[i] + 1e-6).all() and (high >= exact[i] - 1e-6).all()
        return high >= np.partition(low, -5)[-5]

    for i, rows, scores in hardneg.walk(tree, parent, edge, found, wanted):
        assert (scores == exact[i, rows]).all()
        assert sorted(scores)[-5:] == sorted(exact[i])[-5:]
        scored += len(rows)
    assert scored < 0.5 * exact.size  # near anchors bound each other's candidates
