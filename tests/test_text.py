"""Cleaning, chunking, references: fixed cases and plain-Python comparisons."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.operators import chunking, refs, scan
from sheaf.sources import tables

HEAD, FOOT = "頁首甲", "頁尾乙"


def page_table(spark, pages, doc="d"):
    rows = [(doc, p, i, line) for p, lines in enumerate(pages) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, line string")


def in_order(df):
    return [r["line"] for r in df.orderBy("line_no").collect()]


def test_clean_pages(spark):
    """Repeated head and foot lines and page numbers go; lines that end no sentence go on with the next."""
    bodies = [["第一條 長句由上一行", "接到下一行。"], ["完整一句。", "- 7 -"], ["沒有句點", "第八條 自成一行。"], ["冒號後換行：", "新的一行。", "12 / 40"], ["　第 9 頁", "第十條 前有空白。", ""]]
    lines = page_table(spark, [[HEAD, *body, FOOT] for body in bodies])
    docs = spark.createDataFrame([("d", len(bodies))], "doc_id string, n_pages int")
    assert in_order(chunking.clean_pages(lines, docs)) == [
        "第一條 長句由上一行接到下一行。", "完整一句。", "沒有句點", "第八條 自成一行。", "冒號後換行：", "新的一行。", "第十條 前有空白。",
    ]


def test_boilerplate_needs_three_pages(spark):
    lines = page_table(spark, [[HEAD, "甲。"], [HEAD, "乙。"]])
    docs = spark.createDataFrame([("d", 2)], "doc_id string, n_pages int")
    assert in_order(chunking.clean_pages(lines, docs)) == [HEAD + "甲。", HEAD + "乙。"]


def docs_of(spark, code, title="測試辦法", doc="d"):
    return spark.createDataFrame([(doc, code, title, 1)], "doc_id string, reg_code string, reg_title string, n_pages int")


def line_table(spark, lines, doc="d"):
    return spark.createDataFrame([(doc, i, l) for i, l in enumerate(lines)], "doc_id string, line_no int, line string")


def test_articles(spark):
    lines = ["封面", "第一條 為規範導入。", "第二條　", "次行一。", "次行二。", "第十一條 施行。"]
    got = chunking.chunk_articles(line_table(spark, lines), docs_of(spark, "R01")).orderBy("order").collect()
    assert [(r["section_path"], r["order"]) for r in got] == [("第一條", 0), ("第二條", 1), ("第十一條", 2)]
    assert got[1]["text"] == "【R01 測試辦法|第二條】\n次行一。\n次行二。"
    assert got[0]["chunk_id"] == "R01:第一條:0"


LONG = "甲" * 300 + "。"


def marked_outline(rng, n):
    """Headings of three levels between lines that each carry a mark of their own."""
    lines = []
    for k in range(n):
        mark = f"[{k}]"
        filler = rng.choice(["短句。", "無句號" * rng.randint(1, 60), LONG * rng.randint(1, 4), "中。中。"])
        lines.append(rng.choices(
            ["一二三四"[k % 4] + "、標題", f"（{'一二三'[k % 3]}）" + "節" * rng.choice([0, 40]), f"{k % 12 + 1}. {mark}{filler}", mark + filler, "  "],
            [1, 2, 3, 6, 1],
        )[0])
    return lines


def test_outline_keeps_every_line_once(spark):
    rng = random.Random(7)
    cases = {f"d{i}": marked_outline(rng, 80) for i in range(12)}
    lines = docs = None
    for doc, text in cases.items():
        a, b = line_table(spark, text, doc), docs_of(spark, "R03", doc=doc)
        lines, docs = (a, b) if lines is None else (lines.unionAll(a), docs.unionAll(b))
    runs = []
    for block in (P.SCAN_BLOCK, 7):
        got = {}
        for r in chunking.chunk_outline(lines, docs, block=block).orderBy("doc_id", "order").collect():
            got.setdefault(r["doc_id"], []).append((r["section_path"], r["chunk_seq"], r["text"].split("】\n", 1)[1]))
        runs.append(got)
    assert runs[0] == runs[1]
    for doc, text in cases.items():
        chunks = runs[0].get(doc, [])
        first = next((k for k, line in enumerate(text) if re.match("[一二三四]、", line)), len(text))
        section = None
        for k, line in enumerate(text):
            if re.match("[一二三四]、", line):
                section = line[0]
            if f"[{k}]" in line:
                holders = [path for path, _, body in chunks if f"[{k}]" in body]
                assert [p.split("/")[0] for p in holders] == ([section] if k > first else [])
        marks = [int(m) for _, _, body in chunks for m in re.findall(r"\[(\d+)\]", body)]
        assert len(marks) == len(set(marks))
        for k, (path, seq, body) in enumerate(chunks):
            assert len(body) <= 800 or body.count("。") <= 1 or "/" not in path
            if seq:  # a piece goes on with its section and was cut because both together are too long
                before = chunks[k - 1]
                assert before[:2] == (path, seq - 1) and len(before[2]) + len(re.match("[^。]*。?", body)[0]) > 800


def test_outline_by_example(spark):
    lines = ["前言", "一、總則", "引言。", "（一）", "（二）範圍", "說明。", "1. 甲", "續甲", "2、乙", "二、附則", "（一）" + "長" * 30]
    got = chunking.chunk_outline(line_table(spark, lines), docs_of(spark, "R03")).orderBy("order").collect()
    assert [(r["section_path"], r["text"].split("】\n", 1)[1]) for r in got] == [
        ("一", "引言。\n（一）"), ("一/(二)", "說明。\n1. 甲\n續甲\n2、乙"), ("二/(一)", ""),
    ]


def test_outline_breadcrumbs(spark):
    lines = ["一、總則 ", "（一）名詞定義", LONG * 2, "1. " + LONG, "二、(空)", "（一）" + "長" * 30]
    got = chunking.chunk_outline(line_table(spark, lines), docs_of(spark, "R03")).orderBy("order").collect()
    assert [r["text"].split("\n")[0] for r in got] == [
        "【R03 測試辦法|一、總則>(一)名詞定義】", "【R03 測試辦法|一、總則>(一)名詞定義>1.】", "【R03 測試辦法|二、(空)>(一)" + "長" * 30 + "】",
    ]
    assert got[1]["title"] == "名詞定義"


def test_sentences_are_lossless(spark):
    texts = ["", "甲。乙", "。。甲。", "甲" * 900 + "。乙。", LONG * 5, "x" * 20]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chunking.split_sentences(F.col("t")).alias("s"), chunking.pack_sentences(F.col("t")).alias("p")).collect():
        assert "".join(r["s"]) == r["t"] == "".join(r["p"])
        assert all(len(p) <= 800 or p.count("。") <= 1 for p in r["p"])


REF_CASES = [
    ("R03/五/(二)/2", [("R03", "五/(二)/2")], 0),
    ("R03&R07/五/(二)/2", [("R03", "五/(二)/2"), ("R07", "五/(二)/2")], 0),
    ("R03、R07/五", [("R03", "五"), ("R07", "五")], 0),
    ("Ｒ０３／五／（二）／２", [("R03", "五/(二)/2")], 0),
    (" R03 / 五 / (二) ", [("R03", "五/(二)")], 0),
    ("R03/五\nR04/三/(一)", [("R03", "五"), ("R04", "三/(一)")], 0),
    ("R03/五;R04/三", [("R03", "五"), ("R04", "三")], 0),
    ("R03/五；R04/三", [("R03", "五;R04/三")], 0),
    ("R01/第一條", [("R01", "第一條")], 0),
    ("R06", [("R06", "")], 0),
    ("R06（適用全部）", [("R06", "")], 0),
    ("R03 & R07/五", [("R03", "")], 0),
    ("（請自行補充）", [], 1),
    ("R03/五\n（備註）", [("R03", "五")], 1),
    ("", [], 0),
    (None, [], 0),
]


def test_parse_refs(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(REF_CASES)], "k int, raw string")
    got = {}
    for r in refs.parse_refs(df, ["k"], "raw").orderBy("k", "ref_idx").collect():
        got.setdefault(r["k"], []).append((r["reg_code"], r["section_path_prefix"]))
    dropped = {r["k"]: r["dropped"] for r in refs.dropped_refs(df, ["k"], "raw").collect()}
    for i, (_, want, n) in enumerate(REF_CASES):
        assert (got.get(i, []), dropped[i]) == (want, n), REF_CASES[i]


MATCH_CASES = [
    ("R03", "五/(二)/2", "R03", "五/(二)/2", True),
    ("R03", "五/(二)", "R03", "五/(二)/2", True),
    ("R03", "五/(二)/2", "R03", "五/(二)", True),
    ("R06", "", "R06", "三/(一)", True),
    ("R03", "五", "R07", "五", False),
    ("R03", "五/(二)/2", "R03", "五/(二)/3", False),
    ("R03", "五/(二)", "R03", "五/(二十)", False),
]


def test_prefix_match(spark):
    ref = spark.createDataFrame([(str(i), c[0], c[1]) for i, c in enumerate(MATCH_CASES)], "k string, reg_code string, section_path_prefix string")
    chunk = spark.createDataFrame([(str(i), i, c[2], c[3]) for i, c in enumerate(MATCH_CASES)], "chunk_id string, `order` int, reg_code string, section_path string")
    hit = {(r["k"], r["chunk_id"]) for r in refs.first_matches(ref, chunk, ["k"], 99).collect()}
    for i, c in enumerate(MATCH_CASES):
        assert ((str(i), str(i)) in hit) == c[4], c
    counts = {r["k"]: r["n_chunks"] for r in refs.match_counts(ref, chunk, ["k"]).collect()}
    assert counts == {k: sum(k == a for a, _ in hit) for k in {a for a, _ in hit}}


def test_first_chunks_per_ref(spark):
    paths = ["五/(一)", "五/(二)", "五/(二)/1", "五/(二)/2", "五/(三)"]
    chunk = spark.createDataFrame([("R03", p, 10 + i, p) for i, p in enumerate(paths)], "reg_code string, section_path string, `order` int, chunk_id string")
    ref = spark.createDataFrame([("x", "R03", "五")], "k string, reg_code string, section_path_prefix string")
    got = tables.lookup(chunk, ref).orderBy("pos").collect()
    assert [(r["section_path"], r["n_chunks"]) for r in got] == [(p, 5) for p in paths[:3]]


def test_reference_numbers_do_not_meet(spark):
    """More codes in an entry, and more entries, than a thousand."""
    raw = "、".join(["R03"] * 1500) + "\n" + "\n".join(["R04/一"] * 1200)
    df = spark.createDataFrame([(1, raw)], "k int, raw string")
    got = [r["reg_code"] for r in refs.parse_refs(df, ["k"], "raw").orderBy("ref_idx").collect()]
    assert got == ["R03"] * 1500 + ["R04"] * 1200


@pytest.mark.parametrize("code, path, shown", [("R03", "五/(二)/2", "R03 五、(二) 2"), ("R01", "第一條", "R01 第一條"), ("R06", "", "R06"), ("R03", "五/2", "R03 五、2"), ("R03", "五/(二)", "R03 五、(二)")])
def test_display_ref(spark, code, path, shown):
    assert spark.range(1).select(X.display_ref(F.lit(code), F.lit(path))).first()[0] == shown


def test_running_values_do_not_depend_on_blocks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, rng.randint(0, 9)])) for k in "abc" for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "k string, i int, v int")

    def run(size):
        out = scan.running(df, ["k"], ["i"], scan.blocks("i", size), s=("sum", F.col("v")), m=("max", F.col("v")), l=("last", F.col("v")), p=("previous", F.col("v")))
        return sorted(out.collect())

    assert run(4) == run(1000) == run(1)


def test_number_formats(spark):
    for value, one, zero, g in [(18.75, "18.8", "19", "18.75"), (11.25, "11.2", "11", "11.25"), (0.0, "0.0", "0", "0"), (12.5, "12.5", "13", "12.5"), (100.0, "100.0", "100", "100"), (6.0, "6.0", "6", "6")]:
        row = spark.range(1).select(X.fixed1(F.lit(value)), X.fixed0(F.lit(value)), X.general(F.lit(value))).first()
        assert tuple(row) == (one, zero, g)


def test_tokens(spark):
    row = spark.range(1).select(X.estimate_tokens(F.lit("中文ab　cdefg")), X.match_key(F.lit(" Ａ B　ß ")), X.suffix(F.lit("a.b.XLSX")), X.suffix(F.lit(".xlsx")), X.clip(F.lit("a  b" * 30), 5)).first()
    assert tuple(row) == (4, "ａbss", ".xlsx", "", "a ba …")


def test_boilerplate_needs_no_shuffle_of_the_lines(spark):
    """Frequent lines are few and go to all tasks."""
    rows = [("d", p, n, "head" if n == 0 else f"line {p} {n}") for p in range(8) for n in range(5)]
    lines = spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, line string")
    docs = spark.createDataFrame([("d", 8)], "doc_id string, n_pages int")
    kept = chunking.drop_boilerplate(lines.repartition(3), docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["line"] for r in kept.collect()) == sorted(r[3] for r in rows if r[2])
