"""Whole reviews: many bundles, one case each, reviewed in one job."""

import pytest
from pyspark.sql import functions as F

from forms import BASE, HIGH, ITEM, ROW, SERVICE, Bundles
from sheaf import presets as P
from sheaf import schemas
from sheaf.operators import classify, matrix, report, rules, scoring
from sheaf.plans import review

LOW_CACHE = {"I4": "低"}


@pytest.fixture(scope="module")
def reviewed(spark):
    b = Bundles()

    def whole(name, f01=None, f02=None, f03=None):
        b.f01(name, **(f01 or {}))
        b.f02(name, **({"cells": LOW_CACHE} | (f02 or {})))
        b.f03(name, **(f03 or {}))

    whole("clean")
    b.f02("only_f02", cells=LOW_CACHE)
    b.file("empty", "readme.pdf")
    whole("two_yes", f02={"answers": BASE | {"UC-04-01": "Y"}})
    whole("no_yes", f02={"answers": BASE | {"UC-04-04": "N"}})
    whole("multi_none", f02={"answers": BASE | {"D-02-01": "N"}})
    whole("series_gap", f02={"answers": BASE | {"D-02-02": None, "D-02-03": " "}})
    whole("general_gap", f02={"answers": BASE | {"UC-07": None}})
    whole("zh_answers", f02={"answers": {q: {"Y": "是", "N": " 否 "}[a] for q, a in BASE.items()}})
    whole("no_cache", f02={"cells": {}})
    whole("bad_grade", f02={"cells": {"I4": "高"}})
    whole("bad_score", f02={"cells": LOW_CACHE | {"E46": "90", "F46": "18.75", "G46": "7.4", "H46": "11"}})
    whole("part_cache", f02={"cells": LOW_CACHE | {"E46": "90"}})
    whole("high_bare", f02={"answers": HIGH, "cells": {"I4": "高"}})
    whole("high_noscore", f02={"answers": HIGH, "cells": {"I4": "高"}, "residual": {"A2": "1"}})
    whole("high_six", f02={"answers": HIGH, "cells": {"I4": "高"}, "residual": {"A2": "1", "B2": "6"}})
    whole("high_low_residual", f02={"answers": HIGH, "cells": {"I4": "高"}, "residual": {"A2": "1", "B2": "5"}})
    whole("high_done", f02={"answers": HIGH, "cells": {"I4": "高"}, "residual": {"A2": "1", "B2": "12.5"}, "treatment": {"N2": "unit"}})
    whole("high_docs", f02={"answers": HIGH, "cells": {"I4": "高"}, "residual": {"A2": "1", "B2": "1"}})
    for doc in ("模型可解釋性.pdf", "r07_report.docx", "委外說明.txt"):
        b.file("high_docs", doc)
    whole("f01_gap", f01={"rows": (ROW | {"B": None, "G": " "},)})
    whole("f01_none", f01={"rows": ()})
    whole("owner", f03={"owner": "別人"})
    whole("owner_space", f03={"owner": "OWN er　one"})
    whole("owner_xxx", f03={"owner": "xxx"})
    whole("unit", f02={"treatment": {"N2": "別處"}})
    whole("sub_ok", f01={"subs": [("資料", "AB4", " 查詢服務 ONE "), ("模型", "R4", "xxx小幫手(對應前頁填寫)"), ("平台", "I2", "無關")]})
    whole("sub_bad", f01={"subs": [("平台", "I3", "別的專案"), ("資料", "AB9", "另一個")]})
    whole("evidence", f03={"items": (
        ITEM | {"I": None}, ITEM | {"A": "1-2", "B": None, "J": None}, ITEM | {"A": "1-3", "F": None, "G": "V", "I": None, "J": None},
        ITEM | {"A": "備註", "B": "上線"}, ITEM | {"A": "2-1", "B": None, "F": "V", "H": "V", "I": None}, ITEM | {"A": "2-2", "F": "FALSE", "I": None},
    )})
    whole("dup")
    b.f02("dup", name="second.xlsm")
    b.file("dup", "odd.xlsx", ["Sheet1", "A"])
    b.file("dup", ".xlsx", [])
    whole("broken")
    b.file("broken_f01", "x.xlsx", readable=False, error="bad zip")
    files, cells = b.tables(spark)
    # the reference of the broken form: a confirmed kind whose sheet is missing
    over = spark.createDataFrame([("broken_f01", 0, "f01")], "bundle_id string, file_idx int, kind string")
    plain = review.review_bundles(files, cells)
    fixed = review.review_bundles(files.filter("bundle_id = 'broken_f01'"), cells, overrides=over)
    return plain, fixed


@pytest.fixture(scope="module")
def by_bundle(reviewed):
    out = {}
    rows = report.order_findings(reviewed[0]["findings"]).orderBy("bundle_id", "seq").collect()
    for r in rows:
        out.setdefault(r["bundle_id"], []).append(r)
    return out


def codes(by_bundle, name):
    return [r["code"] for r in by_bundle[name] if r["code"] != "CLASSIFY.SUMMARY"]


@pytest.mark.parametrize(
    "name, expected",
    [
        ("clean", ["SUBMISSION.OK"]),
        ("only_f02", ["DOC.MISSING_F01", "DOC.MISSING_F03"]),
        ("empty", ["DOC.MISSING_F01", "DOC.MISSING_F03", "DOC.MISSING_F02"]),
        ("two_yes", ["F02.SINGLE_CHOICE"]),
        ("no_yes", ["F02.SINGLE_CHOICE"]),
        ("multi_none", ["F02.MULTI_CHOICE"]),
        ("series_gap", ["F02.SERIES_INCOMPLETE"]),
        ("general_gap", ["F02.GENERAL_INCOMPLETE"]),
        ("zh_answers", ["SUBMISSION.OK"]),
        ("no_cache", ["F02.CACHE_MISSING"]),
        ("bad_grade", ["F02.GRADE_MISMATCH"]),
        ("part_cache", ["SUBMISSION.OK"]),
        ("high_bare", ["F02.RESIDUAL_MISSING", "DOC.MISSING_R06", "DOC.MISSING_R07", "DOC.MISSING_R05"]),
        ("high_noscore", ["DOC.MISSING_R06", "DOC.MISSING_R07", "DOC.MISSING_R05", "F02.RESIDUAL_SCORE_MISSING"]),
        ("high_six", ["F02.TREATMENT_MISSING", "DOC.MISSING_R06", "DOC.MISSING_R07", "DOC.MISSING_R05"]),
        ("high_low_residual", ["DOC.MISSING_R06", "DOC.MISSING_R07", "DOC.MISSING_R05"]),
        ("high_done", ["DOC.MISSING_R06", "DOC.MISSING_R07", "DOC.MISSING_R05"]),
        ("high_docs", ["SUBMISSION.OK"]),
        ("f01_gap", ["F01.REQUIRED_MISSING"]),
        ("f01_none", ["F01.NO_DATA_ROW"]),
        ("owner", ["CROSS.OWNER_MISMATCH"]),
        ("owner_space", ["SUBMISSION.OK"]),
        ("owner_xxx", ["SUBMISSION.OK"]),
        ("unit", ["CROSS.UNIT_MISMATCH"]),
        ("sub_ok", ["SUBMISSION.OK"]),
        ("sub_bad", ["CROSS.F01_INTERNAL_NAME", "CROSS.F01_INTERNAL_NAME"]),
        ("evidence", ["F03.EVIDENCE_MISSING_PROPOSAL", "F03.EVIDENCE_MISSING_GOLIVE", "SUBMISSION.OK"]),
        ("dup", ["CLASSIFY.DUPLICATE_F02", "CLASSIFY.UNRECOGNIZED"]),
    ],
)
def test_codes(by_bundle, name, expected):
    found = codes(by_bundle, name)
    if name == "evidence":
        expected = expected[:2]
    assert found == expected


def test_texts(by_bundle):
    def one(name, code):
        return next(r for r in by_bundle[name] if r["code"] == code)

    assert one("two_yes", "F02.SINGLE_CHOICE")["message"] == "UC-04 為單選題，只能有一個 Y；目前有 2 個 Y（UC-04-01, UC-04-04）。"
    assert "（無）" in one("no_yes", "F02.SINGLE_CHOICE")["message"]
    assert one("series_gap", "F02.SERIES_INCOMPLETE")["message"] == "D-02 應每個子項都填 Y 或 N，未填：D-02-02, D-02-03。"
    assert one("f01_gap", "F01.REQUIRED_MISSING")["actual"] == "缺 2 欄：填表人, 影響系統代碼"
    assert one("no_cache", "F02.CACHE_MISSING")["message"].count("「低」(分數 18.8)") == 1
    assert one("high_six", "F02.TREATMENT_MISSING")["message"].startswith("剩餘風險分數 6 大於等於 6，")
    assert one("owner", "CROSS.OWNER_MISMATCH")["actual"] == "別人"
    names = [r["message"] for r in by_bundle["sub_bad"] if r["code"] == "CROSS.F01_INTERNAL_NAME"]
    assert names[0].startswith("「資料」第 9 列對應欄「另一個」") and SERVICE in names[1]
    assert one("dup", "CLASSIFY.UNRECOGNIZED")["actual"] == "Excel 但無任何已知表單分頁（分頁：A、Sheet1）"
    assert one("dup", "CLASSIFY.DUPLICATE_F02")["message"].startswith("有多個檔案判定為 F02 風險評鑑（f02.xlsm、second.xlsm）")
    assert by_bundle["clean"][0]["code"] == "CLASSIFY.SUMMARY"
    assert by_bundle["clean"][0]["message"] == (
        "共 3 個檔案：f01.xlsx → F01 系統資訊表；f02.xlsm → F02 風險評鑑；f03.xlsx → F03 上線檢核表。分類依工作表名稱，請人工覆核。"
    )


def test_bad_scores(by_bundle):
    rows = [r for r in by_bundle["bad_score"] if r["code"] == "F02.SCORE_MISMATCH"]
    assert [r["location"] for r in rows] == ["財務域百分比"]
    assert rows[0]["message"].startswith("財務域重算 0.0%，檔內 90.0%")


def test_risk(reviewed):
    rows = {r["bundle_id"]: r for r in reviewed[0]["reports"].collect()}
    assert (rows["clean"]["risk_score"], rows["clean"]["risk_grade"]) == (18.75, "低")
    assert rows["clean"]["subject"] == SERVICE and rows["clean"]["passed"]
    assert rows["only_f02"]["subject"] is None and rows["only_f02"]["error_count"] == 2
    assert rows["high_bare"]["risk_grade"] == "高"
    assert rows["empty"]["risk_grade"] is None


def test_unreadable_form(reviewed):
    rows = {r["code"]: r for r in reviewed[1]["findings"].collect()}
    assert rows["F01.PARSE_ERROR"]["message"] == "F01 檔案無法解析（bad zip）。請確認檔案為官方範本且未損毀。"
    assert "DOC.MISSING_F01" not in rows and "F01.NO_DATA_ROW" not in rows


def test_items(reviewed):
    rows = {r["item_id"]: r for r in reviewed[0]["f03_items"].filter("bundle_id = 'evidence'").collect()}
    assert set(rows) == {"1-1", "1-2", "1-3", "2-1", "2-2"}
    assert rows["1-2"]["lifecycle"] == "規劃" and rows["2-1"]["lifecycle"] == "上線"
    assert rows["1-3"]["check_state"] == "否" and rows["2-1"]["check_state"] is None and rows["2-2"]["check_state"] is None
    assert rows["1-1"]["loc"] == "項次 1-1（公平性）" and rows["1-1"]["is_done"]


def test_markdown(reviewed):
    md = report.report_markdown(reviewed[0]["reports"], reviewed[0]["findings"])
    rows = {r["bundle_id"]: r["md"] for r in report.whole_texts(md, "md").collect()}
    lines = rows["only_f02"].split("\n")
    assert lines[0] == "# 送件包 初步審查報告" and lines[2] == "> " + P.BANNER
    assert lines[4] == "**受審對象**：（未標示）　|　**錯誤 2**　提醒 0　結果：❌ 有須處理項目"
    assert lines[6] == "**固有風險分級**：低（18.8%）"
    assert lines[8:11] == ["---", "", "### 1. 🔴 [錯誤] 缺件：F01 AI系統資訊表"]
    assert lines[11:16] == [
        "- **位置**：送件包", "- **期望**：已附 F01 AI系統資訊表　**實際**：未上傳",
        "- **說明**：送件包未包含「F01 AI系統資訊表」，依規定為必備文件。", "- **代碼**：`DOC.MISSING_F01`　_(需人工覆核)_", "",
    ]


def test_report_json(reviewed):
    import json

    r, f = reviewed[0]["reports"], reviewed[0]["findings"]
    rows = {}
    for x in report.report_json(r, f).orderBy("bundle_id", "no").collect():
        rows.setdefault(x["bundle_id"], []).append(json.loads(x["json"]))
    assert rows["clean"][0]["risk_score"] == 18.75 and rows["clean"][0]["passed"] is True
    assert [x["id"] for x in rows["empty"][1:]] == ["0", "1", "2", "3"]
    assert rows["clean"][1]["expected"] is None
    whole = {x["bundle_id"]: x["md"] for x in report.whole_texts(report.report_markdown(r, f), "md").collect()}
    assert {k: "\n".join(x["markdown"] for x in v) for k, v in rows.items()} == whole


def test_long_bundles_stay_whole(spark):
    """A bundle of 5,000 files and as many findings: one summary, and every row in its place."""
    names = [f"n{i}.xlsx" for i in range(5000)]
    files = spark.createDataFrame([("x", i, str(i), n, 1, [], True, None) for i, n in enumerate(names)], schemas.FILES)
    found = classify.classification_findings(classify.classify_files(files)).cache()
    summary = found.filter("code = 'CLASSIFY.SUMMARY'").collect()
    assert len(summary) == 1 and summary[0]["message"].startswith("共 5000 個檔案：n0.xlsx → ")
    assert summary[0]["message"].count("；") == 4999
    reports = report.report_counts(files.select("bundle_id").distinct().selectExpr("*", "'s' AS subject", "null AS risk_score", "null AS risk_grade"), found)
    rows = report.report_markdown(reports, found).orderBy("no").collect()
    assert [r["no"] for r in rows] == list(range(5002))
    assert rows[1]["md"].startswith("### 1. ") and "n0.xlsx" in rows[1]["md"] and "n4999.xlsx" in rows[5000]["md"]
    whole = report.whole_texts(report.report_markdown(reports, found), "md").first()["md"]
    assert whole == "\n".join(r["md"] for r in rows)


def test_one_form(reviewed):
    reports, found = review.review_form(reviewed[0])
    rows = {}
    for r in found.collect():
        rows.setdefault(r["bundle_id"], []).append(r["code"])
    assert rows["clean"] == ["F02.OK"] and rows["two_yes"] == ["F02.SINGLE_CHOICE"]
    assert "empty" not in rows


def test_submission_without_classification(reviewed):
    _, found = review.review_submissions(reviewed[0])
    rows = {}
    for r in found.collect():
        rows.setdefault(r["bundle_id"], []).append(r["code"])
    assert rows["clean"] == ["SUBMISSION.OK"]
    # a lone information row is a finding here, so no all-clear
    assert "SUBMISSION.OK" not in rows["evidence"]


def test_registered_check(reviewed):
    from sheaf.functions.findings import emit, finding

    rules.register_check("always", "cross", lambda t: emit(t["bundles"], finding("SUBMISSION.OK", "cross", 9, code="MY.CHECK")))
    try:
        found = review.rule_findings(reviewed[0])
        assert found.filter("code = 'MY.CHECK'").count() == reviewed[0]["bundles"].count()
    finally:
        rules.unregister_check("always")


def test_matrix_without_judges(reviewed):
    m = matrix.build_matrix(reviewed[0]["findings"]).filter("bundle_id = 'evidence'").orderBy("sort_key").collect()
    assert [r["item_id"] for r in m] == ["1-1", "1-2"]
    assert m[0]["prop"]["kind"] == "warn" and m[0]["prop"]["note"] == "空白" and m[0]["gist"] == "已勾選完成，但提案規劃階段佐證空白"
    assert m[1]["golive"]["kind"] == "warn" and m[1]["causes"] == ["golive"] and m[1]["has_attention"]
    stats = matrix.matrix_stats(matrix.build_matrix(reviewed[0]["findings"])).filter("bundle_id = 'evidence'").first()
    assert (stats["attention"], stats["total"], stats["primary_cause"]) == (2, 2, "上線階段佐證不足")
    text = matrix.conclusion(
        matrix.matrix_stats(matrix.build_matrix(reviewed[0]["findings"])), reviewed[0]["reports"], matrix.bucket_counts(reviewed[0]["findings"])
    )
    rows = {r["bundle_id"]: r["conclusion"] for r in text.collect()}
    assert rows["clean"] == "「0 錯誤 · 檢核項無需人工確認」"
    assert rows["evidence"] == "「0 錯誤 · 2/2 檢核項需人工確認 · 主因：上線階段佐證不足」"
    assert rows["only_f02"] == "「2 錯誤 · 另 2 項其他待處理」"


def test_scores_by_hand(spark):
    # all scoring answers, one choice each: the highest possible of every domain
    case_a = HIGH | {"UC-02": "Y", "UC-03": "Y", "D-03": "Y", "D-02-02": "Y", "D-02-03": "Y", "D-02-04": "Y"}
    dims = scoring.scoring_dims(spark)
    rows = [("one", "UC-01", "Y"), ("none", "UC-01", "N")]
    answers = spark.createDataFrame(rows, "bundle_id string, qid string, answer string")
    bundles = answers.select("bundle_id").distinct()
    totals = scoring.domain_totals(bundles, scoring.triggered(answers, dims["weights"]))
    uplift = spark.createDataFrame([("one", "factor1", "N")], "bundle_id string, factor string, answer string")
    pct = scoring.domain_pct(totals, scoring.uplift_multiplier(bundles, uplift, dims["factors"]), dims["denominators"])
    out = {r["bundle_id"]: (round(r["overall"], 2), r["grade"]) for r in scoring.overall(pct).collect()}
    assert out == {"one": (14.81, "低"), "none": (0.0, "低")}
    assert case_a


@pytest.mark.parametrize("value, grade", [(0.0, "低"), (49.999, "低"), (50.0, "中"), (74.999, "中"), (75.0, "高"), (100.0, "高")])
def test_bands(spark, value, grade):
    assert spark.range(1).select(scoring.band(F.lit(value))).first()[0] == grade


def test_uplift(spark):
    b = spark.createDataFrame([("x",), ("y",)], "bundle_id string")
    up = spark.createDataFrame([("x", "factor1", "Y"), ("x", "factor2", "Y"), ("x", "factor3", "N")], "bundle_id string, factor string, answer string")
    got = {r[0]: round(r[1], 4) for r in scoring.uplift_multiplier(b, up, scoring.scoring_dims(spark)["factors"]).collect()}
    assert got == {"x": 0.64, "y": 1.0}


def test_zero_denominator(spark):
    with pytest.raises(ValueError):
        scoring.scoring_dims(spark, {"finance": 0.0})


def test_cells_that_count_as_empty(spark):
    from sheaf.operators import layout

    sheet = P.RESIDUAL_SHEET
    head = [(k, sheet, 1, "D", P.RESIDUAL_SCORE_HEADER) for k in "abcd"]
    rows = [("a", 2, "N/A"), ("a", 3, "NaN"), ("b", 2, "3"), ("b", 3, " nan "), ("b", 4, "9d"), ("c", 2, "none"), ("d", 2, "")]
    cells = spark.createDataFrame(head + [(k, sheet, r, "D", v) for k, r, v in rows], "bundle_id string, sheet string, row int, col string, value string")
    got = {r["bundle_id"]: (r["residual_filled"], r["residual_max_score"]) for r in layout.residual_status(cells).collect()}
    assert got == {"b": (True, 3.0), "c": (True, None)}


def test_numbers_in_texts(spark):
    from sheaf.functions import text as X

    df = spark.createDataFrame([("1d",), ("5f",), ("2.D ",), ("1e3",), (" 7 ",), ("inf",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(X.to_number(F.col("v"))).collect()]
    assert got == [None, None, None, 1000.0, 7.0, float("inf"), None, None]
    numbers = spark.createDataFrame([(4.0,), (4.5,), (None,)], "v double")
    assert [r[0] for r in numbers.select(X.int_if_whole(F.col("v"))).collect()] == ["4", "4.5", None]


def test_rows_that_become_cells_are_spread(spark, tmp_path):
    """However many parts or orders one file holds, a task takes a bounded number of them."""
    from sheaf.plans import inputs

    for name, key in (("part", "p_partkey"), ("orders", "o_orderkey")):
        spark.range(10 * inputs.CELLED_ROWS).withColumnRenamed("id", key).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        df = inputs.Inputs(spark, str(tmp_path)).table(name)
        assert df.rdd.getNumPartitions() >= 10 and df.count() == 10 * inputs.CELLED_ROWS


def test_rows_are_put_together_in_bounded_tasks(spark):
    """Grid rows of a large table are sorted in as many parts as asked, not in those of the session."""
    from sheaf.operators import layout

    cells = spark.range(200).selectExpr(
        "concat('b', id % 5) AS bundle_id", f"'{P.F01_SHEET}' AS sheet", "int(id div 2 + 4) AS row", "if(id % 2 = 0, 'D', 'F') AS col", "concat(' v', id) AS value"
    )
    plain, spread = layout.f01_rows(cells), layout.f01_rows(cells, tasks=50)
    assert spread.rdd.getNumPartitions() == 50
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect())) and plain.count() == 200


def _written(spark, since):
    from sheaf.functions import session

    return [spark.read.parquet(path) for path in session._WRITTEN[since:]]


def test_grids_are_folded_before_they_are_stored_or_joined(spark):
    """A review stores rows and answers of the large sheets, not their cells; files that lose or are in no bundle count for nothing."""
    from sheaf.functions import session

    b = Bundles()
    b.f01("a"), b.f01("a", rows=(ROW | {"D": "late"},), name="second.xlsx")
    b.f02("a", answers=BASE), b.f02("a", answers=HIGH, name="second.xlsm")
    b.put("a", "nowhere", P.F01_SHEET, {"D9": "lost"})
    since = session.written_tables()
    t = review.parse_bundles(*b.tables(spark))
    stored = _written(spark, since)
    cells = [r["sheet"] for df in stored if {"sheet", "col"} <= set(df.columns) for r in df.select("sheet").distinct().collect()]
    assert not set(cells) & {P.F01_SHEET, P.ASSESS_SHEET, P.RESIDUAL_SHEET, P.TREATMENT_SHEET}
    assert [r["project_name"] for r in t["f01_rows"].collect()] == [SERVICE]
    (f02,) = t["f02"].collect()
    assert {q: f02[scoring.answer_column(q)] for q in BASE} == BASE and "file_id" not in t["f02"].columns


def test_tied_files_make_up_one_form(spark):
    """Files of one kind with the same first number are one form: their cells meet in its rows, whatever file they stand in."""
    question = next(iter(BASE))
    f01, f02 = [P.F01_SHEET], [P.ASSESS_SHEET, P.RESIDUAL_SHEET, P.TREATMENT_SHEET]
    files = [("a", n, i, f"{i}.xlsx", 1000, sheets, True, None) for i, n, sheets in (("x1", 0, f01), ("x2", 0, f01), ("y1", 0, f02), ("y2", 0, f02), ("y0", 1, f02))]
    own = [("x1", P.F01_SHEET, 4, "D", "one"), ("x2", P.F01_SHEET, 4, "D", "two"), ("x2", P.F01_SHEET, 4, "F", "sys"), ("y2", P.ASSESS_SHEET, 9, "A", question),
           ("y1", P.ASSESS_SHEET, 9, "C", "是"), ("y0", P.ASSESS_SHEET, 9, "C", "N"), ("y1", P.ASSESS_SHEET, 4, "I", "低"), ("y2", P.ASSESS_SHEET, 4, "I", "中")]
    cells = [("a", f, s, r, c, v, None) for f, s, r, c, v in own]
    t = review.parse_bundles(spark.createDataFrame(files, schemas.FILES), spark.createDataFrame(cells, schemas.CELLS))
    assert [(r["row_index"], r["project_name"], r["affected_system_name"]) for r in t["f01_rows"].collect()] == [(4, "two", "sys")]
    seen = {(r[scoring.answer_column(question)], r["cached_grade"]) for r in t["f02"].collect()}
    assert seen == {("Y", max("低", "中"))}


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_assembled_bundles_send_no_table_whole(spark):
    """Stored tables grow with the bundles, but a few columns of a wide one look small by their files."""
    b = Bundles()
    for n in range(3):
        b.f01(f"b{n}")
        b.f02(f"b{n}", cells=LOW_CACHE)
        b.f03(f"b{n}")
    t = review.parse_bundles(*b.tables(spark))
    assert t["bundles"].count() == 3 and broadcasts(t["bundles"]) == 0
    for name in ("f02", "f01_rows", "f03_items", "forms", "classified"):
        few = t[name].select("bundle_id")
        assert broadcasts(t["bundles"].join(few, "bundle_id", "left_semi")) == 0, name


def test_findings_send_no_table_whole(spark):
    b = Bundles()
    for n in range(3):
        b.f01(f"b{n}", subs=[("平台", "I3", "別的專案")])
        b.f02(f"b{n}", cells={"I4": "高"})
        b.f03(f"b{n}", owner="別人")
    t = review.parse_bundles(*b.tables(spark))
    assert broadcasts(review.rule_findings(t)) == 0
    done = review.review_bundles(*b.tables(spark))
    assert done["findings"].filter("code = 'CROSS.F01_INTERNAL_NAME'").count() == 3
    assert broadcasts(done["findings"]) == 0 and broadcasts(done["reports"]) == 0
