"""Sources, sinks, optional branches and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from forms import BASE, ITEM, SERVICE, Bundles
from sheaf import schemas
from sheaf.operators import classify, report, scan
from sheaf.plans import review
from sheaf.sources import tables
from sheaf.streaming import review_stream


@pytest.fixture(scope="module")
def bundle():
    b = Bundles()
    b.f01("a")
    b.f02("a", cells={"I4": "低"}, answers=BASE | {"UC-01": "Y"})
    b.f03("a", items=(ITEM, ITEM | {"A": "1-2", "L": "R09"}))
    b.f02("b", cells={"I4": "低"})
    return b


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_cells_round_trip(spark, tmp_path, bundle, fmt):
    _, cells = bundle.tables(spark)
    path = str(tmp_path / "cells")
    writer = cells.write.option("header", "true")
    writer.csv(path) if fmt == "csv" else writer.format(fmt).save(path)
    back = tables.read_cells(spark, path, fmt)
    assert back.count() == cells.count()
    assert back.filter(f"value = '{SERVICE}'").count() == 1


def test_cells_by_sheet(spark, tmp_path, bundle):
    _, cells = bundle.tables(spark)
    tables.write_cells(cells, str(tmp_path / "c"))
    back = tables.read_cells(spark, str(tmp_path / "c"))
    assert sorted(map(str, back.select(*cells.columns).collect())) == sorted(map(str, cells.collect()))


def test_manifest(spark, tmp_path):
    (tmp_path / "small.pdf").write_bytes(b"x" * 10)
    (tmp_path / "large.pdf").write_bytes(b"x" * 100)
    ok, rejected = tables.read_manifest(spark, str(tmp_path), max_bytes=50)
    assert [r["filename"] for r in ok.collect()] == ["small.pdf"] and [r["filename"] for r in rejected.collect()] == ["large.pdf"]


def test_page_lines(spark, tmp_path):
    (tmp_path / "R01.txt").write_text("甲\n乙\f丙\r\n丁", encoding="utf-8")
    got = tables.read_page_lines(spark, str(tmp_path)).orderBy("page_no", "line_no").collect()
    assert [(r["doc_id"], r["page_no"], r["line_no"], r["line"]) for r in got] == [
        ("R01.txt", 0, 0, "甲"), ("R01.txt", 0, 1, "乙"), ("R01.txt", 1, 0, "丙"), ("R01.txt", 1, 1, "丁"),
    ]


def _whole(spark, path):
    docs = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc_id"), F.col("value").alias("text"))
    return sorted(map(tuple, tables.page_lines(docs).select("doc_id", "page_no", "line_no", "line").collect()))


@pytest.mark.parametrize("split_bytes", [7, 64, 1000, 1 << 20])
def test_page_lines_over_splits(spark, tmp_path, split_bytes):
    """Numbers go on over splits, wherever these cut; the rows are those of whole texts."""
    draw = random.Random(3)
    pieces = ["甲", "ab", " ", "\n", "\n", "\r\n", "\r", "\f", "\f", "長" * 30]
    fixed = ["a", "a\n", "a\r", "a\r\n", "a\f", "a\f\n", "\n", "\f", "\f\f", "\r\f\n", "\n\f\r", "\r\r\n", "a\n\n\n"]
    for i, text in enumerate(fixed + ["".join(draw.choices(pieces, k=draw.choice([5, 40, 200]))) + draw.choice(["", "x", "\n"]) for _ in range(12)]):
        (tmp_path / f"t{i}.txt").write_bytes(text.encode())
    got = tables.read_page_lines(spark, str(tmp_path), split_bytes=split_bytes)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "string"), ("page_no", "int"), ("line_no", "int"), ("line", "string")]
    assert sorted(map(tuple, got.collect())) == _whole(spark, str(tmp_path))


def test_page_lines_read_in_many_splits(spark, tmp_path):
    """One large file is the work of many tasks, and an empty one gives no rows."""
    (tmp_path / "large.txt").write_text("".join(f"line {i}\n" + ("\f" if i % 97 == 0 else "") for i in range(20_000)))
    (tmp_path / "none.txt").write_text("")
    splits = spark.read.text(str(tmp_path), lineSep="\n").select(F.col("_metadata.file_block_start").alias("b"))
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = tables.read_page_lines(spark, str(tmp_path), split_bytes=10_000)
    assert spark.conf.get(key) == before
    spark.conf.set(key, 10_000)
    try:
        assert splits.distinct().count() > 15
    finally:
        spark.conf.set(key, before)
    rows = {(r["page_no"], r["line_no"]): r["line"] for r in got.collect()}
    assert len(rows) == 20_000 + 207 + 1 and got.select("doc_id").distinct().count() == 1
    assert rows[(1, 1)] == "line 2" and rows[(1, 97)] == "" and rows[(207, 0)] == f"line {206 * 97 + 1}"


def test_page_lines_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfa\nb\n")
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfa\nb")
    got = sorted((r["doc_id"], r["line_no"], r["line"]) for r in tables.read_page_lines(spark, str(tmp_path)).collect())
    assert got == [("a.txt", 0, "a"), ("a.txt", 1, "b"), ("a.txt", 2, ""), ("b.txt", 0, "a"), ("b.txt", 1, "b")]


def test_audit_keeps_identifiers_and_counts_only(spark, tmp_path, bundle):
    files, cells = bundle.tables(spark)
    done = review.review_bundles(files, cells)
    path = str(tmp_path / "audit")
    reports = done["reports"].withColumn("evidence", F.lit("secret"))
    for _ in range(2):
        tables.append_audit(reports, path, event_date="2024-01-01", enable_llm=False)
    back = spark.read.json(path)
    assert back.count() == 4 and "evidence" not in back.columns and "risk_score" not in back.columns
    with pytest.raises(ValueError):
        tables.append_audit(reports, path, note="free text")


def test_audit_runs_count_once_and_only_when_whole(spark, tmp_path):
    path = str(tmp_path / "audit")
    reports = spark.createDataFrame([("b1", 2), ("b2", None)], "bundle_id string, error_count long")
    rows = lambda: sorted((r["run_id"] or "", r["bundle_id"], str(r["error_count"]), r["event_date"]) for r in tables.read_audit(spark, path).collect())
    for _ in range(2):
        tables.append_audit(reports, path, event_date="2024-01-01", run_id="r1")
    one = [("r1", "b1", "2", "2024-01-01"), ("r1", "b2", "None", "2024-01-01")]
    assert rows() == one
    # an attempt that was cut off: rows without a commit
    cut = reports.selectExpr("'review_done' AS event", "*", "'r2' AS run_id", "'x' AS attempt", "'2024-01-01' AS event_date")
    cut.limit(1).write.mode("append").partitionBy("event_date").json(path)
    assert rows() == one
    tables.append_audit(reports, path, event_date="2024-01-02", run_id="r2")
    # two jobs of one run that did not see each other
    late = reports.selectExpr("'review_done' AS event", "*", "'r2' AS run_id", "'y' AS attempt", "'2024-01-02' AS event_date")
    late.write.mode("append").partitionBy("event_date").json(path)
    spark.sql("SELECT 'r2' AS run_id, 'y' AS attempt, '2024-01-02' AS event_date, current_timestamp() AS committed_at").write.mode("append").json(f"{path}/_commits")
    two = one + [("r2", "b1", "2", "2024-01-02"), ("r2", "b2", "None", "2024-01-02")]
    assert rows() == two
    # a run without reports, and rows without a run
    tables.append_audit(reports.limit(0), path, event_date="2024-01-02", run_id="r3")
    tables.append_audit(reports, path, event_date="2024-01-02")
    assert rows() == sorted(two + [("", "b1", "2", "2024-01-02"), ("", "b2", "None", "2024-01-02")])
    day = tables.read_audit(spark, path).filter("event_date = '2024-01-01'")
    assert day.count() == 2
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_views(spark, bundle):
    files, _ = bundle.tables(spark)
    tables.register_views({"files": classify.classify_files(files)}, "t_")
    assert spark.sql("SELECT count(*) FROM t_files WHERE kind = 'f02'").first()[0] == 2


def judge(prompt):
    items = json.loads(prompt[prompt.index("[") : prompt.rindex("]") + 1])
    return json.dumps({"results": [{"item_id": i["item_id"], "verdict": "gap", "difference": {"flag": True, "summary": "差異"}} for i in items]})


def test_review_with_judges(spark, tmp_path, bundle):
    section = {"reg_code": "R03", "section_path": "五/(二)/2", "title": "標題", "excerpt": "摘", "score": None, "origin": "curated"}
    entry = {"item_id": "1-1", "canonical_description": ITEM["D"], "canonical_ref_raw": ITEM["L"], "refs": [], "sections": [section]}
    doc = {
        "schema_version": 1, "built_at": "x", "embedding_model": "m",
        "f03_items": {"1-1": entry, "1-2": entry | {"item_id": "1-2"}},
        "f02_questions": {"UC-01": {"qid": "UC-01", "sections": [section]}},
    }
    (tmp_path / "map.json").write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    files, cells = bundle.tables(spark)
    bundles = files.select("bundle_id").distinct()
    judges, extra = review.with_retrieval_map(bundles, str(tmp_path / "map.json"), review.Judges(evidence=judge, compliance=judge))
    assert extra is None
    done = review.review_bundles(files, cells, judges=judges)
    rows = report.order_findings(done["findings"].filter("bundle_id = 'a'")).orderBy("seq").collect()
    assert [r["code"] for r in rows] == [
        "F03.LLM_DIFF", "F03.LLM_DIFF", "F03.TEMPLATE_REF_MODIFIED", "F03.RAG_GAP", "F03.RAG_GAP",
        "CLASSIFY.SUMMARY", "F03.LLM_TABLE", "F03.LLM_SUMMARY", "F03.RAG_TABLE", "F03.RAG_SUMMARY", "F02.REG_REF_NOTE", "F02.REG_REF_SUMMARY",
    ]
    note = next(r["message"] for r in rows if r["code"] == "F02.REG_REF_NOTE")
    assert "F02 風險題 UC-01 答案為「Y」" in note and "R03 五、(二) 2（標題）" in note
    only_f02 = {r["code"] for r in done["findings"].filter("bundle_id = 'b'").collect()}
    assert "F02.REG_REF_SUMMARY" in only_f02 and "F03.LLM_SUMMARY" not in only_f02

    plain = review.review_bundles(files, cells)["findings"]
    off = review.review_bundles(files, cells, judges=review.Judges())["findings"]
    assert sorted(map(str, plain.collect())) == sorted(map(str, off.collect()))


def test_broken_map_skips(spark, tmp_path, bundle):
    files, cells = bundle.tables(spark)
    judges, extra = review.with_retrieval_map(files.select("bundle_id").distinct(), str(tmp_path / "none.json"), review.Judges())
    found = review.review_bundles(files, cells, judges=judges, extra=extra)["findings"]
    skipped = found.filter("code = 'RAG.SKIPPED'").collect()
    assert len(skipped) == 2 and "（RetrievalMapError）" in skipped[0]["message"] and skipped[0]["severity"] == "info"


def test_stream_equals_batch(spark, tmp_path, bundle):
    files, cells = bundle.tables(spark)
    # bundle a comes in two batches, the second one with b and with its first file once more
    for part in (F.expr("bundle_id = 'a' AND file_idx = 0"), F.expr("bundle_id = 'b' OR file_idx >= 0 AND bundle_id = 'a'")):
        files.filter(part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    tables.write_cells(cells, str(tmp_path / "cells"))
    stream = review_stream.read_files(spark, str(tmp_path / "in"), max_files=1)
    review_stream.review_stream(stream, str(tmp_path / "cells"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "reports")).count() == 3
    got = review_stream.latest(spark, str(tmp_path / "out"), "findings")
    want = review.review_bundles(files, cells)["findings"]
    key = ["bundle_id", "code", "location", "message"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


def test_lists_are_joined_whole(spark):
    rows = [("a", i, str(i)) for i in range(7)] + [("b", 0, "x")]
    df = spark.createDataFrame(rows, "k string, pos int, v string").repartition(4)
    got = scan.join_ordered(df, ["k"], ["pos"], scan.blocks("pos", 3), F.col("v"), ",", "t", n=F.lit(1)).orderBy("k").collect()
    assert [(r["k"], r["t"], r["n"]) for r in got] == [("a", "0,1,2,3,4,5,6", 7), ("b", "x", 1)]


def test_routing_prefers_files_with_a_path(spark):
    b = Bundles()
    b.file("x", "no_path.xlsm", ["AI系統固有風險分級評估表"], file_id=False)
    b.f02("x", name="first.xlsm")
    b.f02("x", name="second.xlsm")
    files, _ = b.tables(spark)
    routed = {r["filename"]: r["role"] for r in classify.route(classify.classify_files(files)).collect()}
    assert routed == {"no_path.xlsm": None, "first.xlsm": "winner", "second.xlsm": "duplicate"}


def test_schema_texts(spark):
    assert spark.createDataFrame([], schemas.CHUNKS).columns[-1] == "chunk_id"


def test_stream_reads_its_partitions_only(spark, tmp_path, bundle):
    files, cells = bundle.tables(spark)
    day = F.when(F.col("bundle_id") == "a", "d1").otherwise("d2")
    for name in ("a", "b"):
        files.filter(F.col("bundle_id") == name).withColumn("day", day).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    cells.withColumn("day", day).write.partitionBy("day").parquet(str(tmp_path / "cells"))
    stream = spark.readStream.schema(schemas.FILES + ", day string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    review_stream.review_stream(stream, str(tmp_path / "cells"), str(tmp_path / "out"), str(tmp_path / "state"), partition="day").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "findings"))
    want = review.review_bundles(files, cells)["findings"]
    assert sorted(r[0] for r in got.select("code").collect()) == sorted(r[0] for r in want.select("code").collect())


def test_name_lists_are_whole(spark):
    from sheaf.operators import rules

    names = spark.createDataFrame([("x", i, f"P{i}") for i in range(5)], "bundle_id string, row_index int, project_name string")
    subs = spark.createDataFrame([("x", "資料", 0, 4, "Q"), ("x", "模型", 1, 4, "p1")], "bundle_id string, sheet string, sheet_seq int, row_index int, corr_project_name string")
    got = rules.internal_name_findings(subs, names).collect()
    assert [(r["location"], r["expected"]) for r in got] == [("主表 / 資料第4列", "P0、P1、P2、P3、P4")]


def test_intermediate_tables_are_removed(spark, tmp_path):
    import os
    from urllib.parse import urlparse

    from sheaf.functions import session

    mark = session.written_tables()
    kept = session.materialise(spark.range(5)).inputFiles()
    places = [urlparse(f).path for f in kept]
    assert session.written_tables() == mark + 1 and all(map(os.path.exists, places))
    session.drop_tables(spark, mark)
    assert session.written_tables() == mark and not any(map(os.path.exists, places))
