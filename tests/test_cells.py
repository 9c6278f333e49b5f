"""The inverted file against the exact search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import cells, retrieval


def table(spark, rows, kind="long"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"id {kind}, embedding array<double>").repartition(5)


def clustered(n=900, dim=16, centres=30, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(i, middle[i % centres] + rng.normal(size=dim) / 3) for i in range(n)]


def hits(df):
    return {(r["query_id"], r["id"]): (r["score"], r["rank"]) for r in df.collect()}


def asked_of(vectors, condition="id % 50 = 0"):
    return vectors.filter(condition).withColumnRenamed("id", "query_id")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_share_of_the_given_vectors(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    found = cells.near_topk(asked_of(vectors), vectors, 4).collect()
    exact = hits(retrieval.cosine_topk(asked_of(vectors), vectors, 4))
    near = {(r["query_id"], r["id"]): r["score"] for r in found}
    assert len(near) == len(exact) and len(set(near) & set(exact)) >= 0.9 * len(exact)
    assert all(near[key] == exact[key][0] for key in set(near) & set(exact))
    assert max(r["candidates"] for r in found) <= 0.1 * vectors.count()


def test_every_cell_visited_is_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 200)
    monkeypatch.setattr(cells, "BLOCK_QUERIES", 3)
    rows = clustered()
    rows += [(2000 + k, rows[7][1]) for k in range(6)] + [(3000, np.zeros(16))]
    vectors = table(spark, rows)
    index = cells.build(vectors, cells=40)
    assert index.folders > 5 and index.sizes.sum() == cells.SPILL * len(rows)
    found = cells.search(index, asked_of(vectors), 4, float(cells.SPILL))
    assert hits(found) == hits(retrieval.cosine_topk(asked_of(vectors), vectors, 4))
    assert {r["candidates"] for r in found.collect()} == {len(rows)}  # each pair once


def test_a_share_bounds_the_candidates(spark):
    vectors = table(spark, clustered())
    index = cells.build(vectors, cells=200)
    for share in (0.05, 0.2):
        rows = cells.search(index, asked_of(vectors), 4, share).collect()
        assert len(rows) == 4 * 18 and max(r["candidates"] for r in rows) <= share * 900
    exact = hits(retrieval.cosine_topk(asked_of(vectors), vectors, 4))
    near = hits(cells.search(index, asked_of(vectors), 4, 0.2))
    assert len(set(near) & set(exact)) >= 0.9 * len(exact)


def test_unclustered_vectors_get_the_share_they_need(spark):
    rng = np.random.default_rng(4)
    vectors = table(spark, [(i, rng.normal(size=48)) for i in range(1200)])
    found = cells.near_topk(asked_of(vectors, "id % 20 = 0"), vectors, 5, share=0.01, cells=30)
    exact = hits(retrieval.cosine_topk(asked_of(vectors, "id % 20 = 0"), vectors, 5))
    assert len(set(hits(found)) & set(exact)) >= 0.9 * len(exact)
    assert 0.01 * 1200 < max(r["candidates"] for r in found.collect()) < 1200


def test_few_null_and_text_ids(spark):
    rows = [(f"v{i}", v) for i, v in clustered(12, 4, 3)]
    vectors = table(spark, rows, "string").unionByName(spark.createDataFrame([("none", None)], "id string, embedding array<double>"))
    for k in (3, 20):
        found = cells.near_topk(asked_of(vectors, "id >= 'v'"), vectors, k, share=0.0, recall=None)
        assert {r["rank"] for r in found.filter("query_id = 'v3'").collect()} == set(range(1, min(k, 12) + 1))
    assert hits(found) == hits(retrieval.cosine_topk(asked_of(vectors, "id >= 'v'"), vectors, 20))
    assert cells.near_topk(asked_of(vectors, "id = 'none'"), vectors, 3).count() == 0
    assert cells.near_topk(asked_of(vectors, "id >= 'v'"), vectors.filter("id = 'none'"), 3).count() == 0


def test_a_stored_index_reads_the_visited_folders_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 100)
    vectors = table(spark, clustered())
    built = cells.build(vectors, cells=30)
    cells.save(built, str(tmp_path / "index"))
    index = cells.load(spark, str(tmp_path / "index"))
    assert index.n == 900 and (index.sizes == built.sizes).all() and np.allclose(index.centres, built.centres)
    asked = asked_of(vectors, "id < 3")
    found = cells.search(index, asked, 4, 0.05)
    assert hits(found) == hits(cells.search(built, asked, 4, 0.05))
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#", plan)
    assert 0 < found.join(built.postings.select("id", "folder"), "id").select("folder").distinct().count() < index.folders


def test_memory_of_a_batch_is_bounded():
    """Scores of a batch against all centres are never held whole."""
    import tracemalloc

    rng = np.random.default_rng(5)
    centres, rows = rng.normal(size=(2000, 8)), rng.normal(size=(6000, 8))
    index = cells.InvertedFile(None, centres, np.full(2000, 2), 2000)
    whole = 6000 * 2000 * 8
    for run in (lambda: cells.nearest_cells(rows, centres, 2), lambda: cells._probes(index, 4, 0.1)(rows)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < whole / 2
