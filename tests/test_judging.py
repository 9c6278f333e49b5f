"""Judge flow with canned answers, and retrieval."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf import schemas
from sheaf.operators import judging, layout, matrix, refs, report, retrieval
from sheaf.plans import index as index_plan
from sheaf.plans import queries_texts  # noqa: F401
from sheaf.plans.inputs import Inputs
from sheaf.plans.registry import QUERIES
from sheaf.sources import tables


def payload_list(prompt):
    return json.loads(prompt[prompt.index("[") : prompt.rindex("]") + 1])


SECTION = "reg_code string, section_path string, title string, excerpt string, score double, origin string"


def items_of(spark, rows):
    schema = "bundle_id string, row_index int, item_id string, topic string, description string, evidence_proposal string, evidence_golive string, regulation_ref_raw string, check_state string"
    return layout.with_item_columns(spark.createDataFrame(rows, schema))


def item(bundle, i, item_id, topic="議題", desc="描述", prop="提案", golive="上線", ref="R03&R07/五/(二)/2"):
    return (bundle, i, item_id, topic, desc, prop, golive, ref, "是")


@pytest.fixture(scope="module")
def canonical(spark):
    s = [("R03", "五/(二)/2", "標題", "摘" * 400, None, "curated"), ("R07", "五/(二)/2", "標題二", "錄", None, "curated")]
    rows = [("1-1", "描述", "R03&R07/五/(二)/2", s), ("1-2", "描述", "R03&R07/五/(二)/2", s)]
    return spark.createDataFrame(
        rows, f"item_id string, canonical_description string, canonical_ref_raw string, sections array<struct<{SECTION.replace(' string', ':string').replace(' double', ':double')}>>"
    )


def verdicts(*rows):
    return json.dumps({"results": [dict(zip(("item_id", "verdict", "gap_refs", "reason"), r)) for r in rows]}, ensure_ascii=False)


COLUMNS = [c.split()[0] for c in schemas.FINDINGS.split(", ")]
COVERED = ("1-2", "covered", [], "已對應")
CASES = {
    "covered": (verdicts(("1-1", "covered", [], "已對應"), COVERED), [], "審閱 2 項，缺口 0 項、無法判定 0 項，待人工覆核。"),
    "gap": (verdicts(("1-1", "gap", ["R03 五、(二) 2"], "未涵蓋"), COVERED), [("F03.RAG_GAP", "佐證未涵蓋下列條文要求：R03 五、(二) 2。請補充佐證後送人工覆核。（未涵蓋）")], "審閱 2 項，缺口 1 項"),
    "gap_all": (verdicts(("1-1", "gap", ["別的"], ""), COVERED), [("F03.RAG_GAP", "佐證未涵蓋下列條文要求：R03 五、(二) 2、R07 五、(二) 2。請補充佐證後送人工覆核。")], "缺口 1 項"),
    "wide": (verdicts(("1-1", "gap", ["Ｒ０７　五、（二） ２"], ""), COVERED), [("F03.RAG_GAP", "佐證未涵蓋下列條文要求：R07 五、(二) 2。請補充佐證後送人工覆核。")], "缺口 1 項"),
    "undetermined": (verdicts(("1-1", "undetermined", [], "不足"), COVERED), [("F03.RAG_UNDETERMINED", "無法判定佐證是否涵蓋條文要求，請人工覆核。（不足）")], "無法判定 1 項"),
    "illegal": (verdicts((" 1-1 ", "maybe", [], ""), COVERED), [("F03.RAG_UNDETERMINED", "無法判定佐證是否涵蓋條文要求，請人工覆核。")], "無法判定 1 項"),
    "missing": (verdicts(("1-1", "covered", [], "")), [("F03.RAG_ITEM_ERROR", "LLM 批次回應未涵蓋此項，已略過；其餘項目不受影響。")], "審閱 1 項，缺口 0 項、無法判定 0 項，待人工覆核。（1 項判讀失敗）"),
    "not_json": ("抱歉，無法回覆。", [("F03.RAG_ITEM_ERROR", "本批 2 項 RAG 符合性判讀失敗，已略過續審其餘批次（項次 1-1（議題）、項次 1-2（議題））。")], "審閱 0 項，缺口 0 項、無法判定 0 項，待人工覆核。（2 項判讀失敗）"),
    "fenced": ("好的：```json\n" + verdicts(("1-1", "covered", [], ""), COVERED) + "\n``` 以上", [], "審閱 2 項"),
    "a_list": ("[" + verdicts(("1-1", "covered", [], ""), COVERED) + "]", [("F03.RAG_ITEM_ERROR", None)], "（2 項判讀失敗）"),
    "no_results": ('{"other": 1}', [("F03.RAG_ITEM_ERROR", None)], "（2 項判讀失敗）"),
    "last_wins": (json.dumps({"results": [{"item_id": "1-1", "verdict": "gap"}, 7, {"item_id": "1-1", "verdict": "covered"}, {"item_id": "1-2", "verdict": "covered"}]}), [], "審閱 2 項，缺口 0 項"),
}


@pytest.fixture(scope="module")
def compliance(spark, canonical):
    rows = [item(name, i, f"1-{i + 1}") for name in CASES for i in range(2)]
    answers = {name: c[0] for name, c in CASES.items()}

    # the judge knows the bundle only through its evidence text
    rows = [(*r[:5], r[0], *r[6:]) for r in rows]

    def judge(prompt):
        return answers[payload_list(prompt)[0]["proposal"]]

    return judging.compliance_review(items_of(spark, rows), canonical, judge, "判讀 {items_json}").collect()


@pytest.mark.parametrize("name", CASES)
def test_compliance(compliance, name):
    found = sorted((r for r in compliance if r["bundle_id"] == name), key=lambda r: (r["rule_seq"], r["row_seq"]))
    special = [r for r in found if r["code"] not in ("F03.RAG_TABLE", "F03.RAG_SUMMARY")]
    want = CASES[name][1]
    assert [r["code"] for r in special] == [c for c, _ in want]
    for r, (_, text) in zip(special, want):
        assert text is None or r["message"] == text
    assert [r["code"] for r in found][-2:] == ["F03.RAG_TABLE", "F03.RAG_SUMMARY"]
    assert CASES[name][2] in found[-1]["message"]
    assert {r["source"] for r in found} == {"llm"}


def test_matrix_from_table(spark, compliance):
    df = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in compliance], schemas.FINDINGS)
    rows = {(r["bundle_id"], r["item_id"]): r for r in matrix.build_matrix(df).collect()}
    assert rows["gap", "1-1"]["rag"]["kind"] == "warn" and rows["gap", "1-1"]["refs"] == "R03 五、(二) 2"
    assert rows["gap", "1-2"]["rag"]["note"] == "已涵蓋" and not rows["gap", "1-2"]["has_attention"]
    assert rows["not_json", "1-2"]["rag"]["kind"] == "err" and rows["undetermined", "1-1"]["rag"]["kind"] == "undet"
    cause = {r["bundle_id"]: r["primary_cause"] for r in matrix.primary_cause(matrix.build_matrix(df)).collect()}
    assert cause["gap"] == "法規符合性缺口" and cause["undetermined"] == "—"


def test_template_drift(spark, canonical):
    rows = [
        item("same", 0, "1-1", ref="Ｒ03&R07/五/（二）/2 "), item("ref", 0, "1-1", ref="R04"), item("desc", 0, "1-1", desc="別的"),
        item("blank", 0, "1-1", ref=None, desc=None), item("unknown", 0, "9-9", ref="R04"),
    ]
    got = {r["bundle_id"] for r in judging.template_drift(items_of(spark, rows), canonical).collect()}
    assert got == {"ref", "desc"}


def evidence_answer(payload):
    return {
        "item_id": payload["item_id"],
        "difference": {"flag": payload["golive"] == "（空白）", "summary": "上線  未說明\n差異" * 20},
        "proposal": {"vague": payload["proposal"] == "OK", "reason": ""},
        "golive": {"vague": False, "reason": ""},
    }


def test_evidence(spark):
    rows = [item("x", 0, "1-1", golive=None), item("x", 1, "1-2", prop="OK", topic=None), item("x", 2, "1-3"), item("x", 3, "1-4", prop=None, golive=None)]

    def judge(prompt):
        return json.dumps({"results": [evidence_answer(p) for p in payload_list(prompt)]}, ensure_ascii=False)

    got = judging.evidence_review(items_of(spark, rows), judge, "{items_json}").orderBy("rule_seq", "row_seq").collect()
    assert [r["code"] for r in got] == ["F03.LLM_DIFF", "F03.LLM_VAGUE_PROPOSAL", "F03.LLM_TABLE", "F03.LLM_SUMMARY"]
    assert got[1]["message"] == P.VAGUE_DEFAULT and got[1]["location"] == "項次 1-2"
    lines = got[2]["message"].split("\n")
    assert lines[0] == "| 項次 | 管理議題 | 提案↔上線差異 | 提案佐證 | 上線佐證 |" and len(lines) == 5
    assert lines[2].startswith("| 1-1 | 議題 | 🟡 上線 未說明 差異上線 未說明 差異") and lines[2].endswith("… | ✅ | — |")
    assert lines[3] == "| 1-2 | — | — | 🟡 過於空泛 | ✅ |"
    assert got[3]["message"] == "LLM 佐證審查：審閱 3 項，標示 2 項待人工覆核。"


def test_breaker_and_caps(spark):
    rows = [item("x", i, f"1-{i}") for i in range(40)]
    calls = spark.sparkContext.accumulator(0)

    def judge(prompt):
        calls.add(1)
        first = payload_list(prompt)[0]["item_id"]
        if first == "1-4":
            return json.dumps({"results": [{"item_id": f"1-{i}"} for i in range(4, 8)]})
        raise judging.JudgeError(first)

    got = judging.evidence_review(items_of(spark, rows), judge, "{items_json}", max_items=30, batch=4).orderBy("rule_seq", "row_seq").collect()
    assert [r["code"] for r in got] == ["F03.LLM_ITEM_ERROR"] * 3 + ["F03.LLM_ERROR", "F03.LLM_TABLE", "F03.LLM_SUMMARY"]
    assert got[3]["message"].startswith("連續 3 批呼叫 LLM 端點失敗") and "已審 4 項" in got[3]["message"]
    assert got[3]["location"] == "項次 1-16（議題）"
    assert got[5]["message"].endswith("（16 項判讀失敗；超過單次上限 30，未送審 10 項；端點異常已中止）")
    assert calls.value == 5  # the other batches were never called


def test_ledger_and_fatal_errors(spark, tmp_path):
    """Each prompt is asked once over several jobs; what is not the client's own skips its bundle alone."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def note(prompt):
        with open(asked / prompt.replace("|", "_"), "a") as f:
            f.write("x")

    def judge(prompt):
        note(prompt)
        bundle, no = prompt.split("|")
        if bundle == "bad" and no == "1":
            raise KeyError(no)
        if bundle == "down":
            raise judging.JudgeError("503")
        return '{"results": []}'

    rows = spark.createDataFrame([(b, n, f"{b}|{n}") for b in ("a", "bad", "down", "z") for n in range(5)], "bundle_id string, batch_no int, prompt string")
    want = {
        **{(b, n): ('{"results": []}', None, False) for b in "az" for n in range(5)},
        **{("down", n): (None, "JudgeError" if n < 3 else "not called", False) for n in range(5)},
        ("bad", 0): ('{"results": []}', None, False), ("bad", 1): (None, "KeyError", True), **{("bad", n): (None, "not called", False) for n in (2, 3, 4)},
    }

    def run(fn, rows):
        out = judging.run_judge(rows, fn, own_errors=(judging.JudgeError,), ledger=str(tmp_path / "ledger"), calls_per_commit=6).collect()
        return {(r["bundle_id"], r["batch_no"]): (r["response"], r["error"], r["fatal"]) for r in out}

    assert run(judge, rows.filter("bundle_id IN ('a', 'down')")) == {k: v for k, v in want.items() if k[0] in ("a", "down")}
    assert run(judge, rows) == want and run(judge, rows) == want  # a job that runs again
    times = {f.name: len(f.read_text()) for f in asked.iterdir()}
    assert times.pop("bad_1") == 2  # a fatal call is not kept
    assert set(times.values()) == {1} and len(times) == 5 + 1 + 3 + 5
    good, broken = judging.isolated(judging.run_judge(rows, judge, own_errors=(judging.JudgeError,)))
    assert [tuple(r) for r in broken.collect()] == [("bad", "KeyError")] and good.count() == 15 and "fatal" not in good.columns
    every = judging.run_judge(rows.filter("bundle_id <> 'bad'"), judge, stop_after=None, own_errors=(judging.JudgeError,)).collect()
    assert sum(r["error"] == "JudgeError" for r in every) == 5


def test_one_broken_bundle_loses_only_itself(spark):
    rows = [item(b, i, f"1-{i + 1}", topic=b) for b in ("x", "y", "z") for i in range(2)]
    rows = [(*r[:5], r[0], *r[6:]) for r in rows]  # the judge knows the bundle only through its evidence text

    def judge(prompt):
        if payload_list(prompt)[0]["proposal"] == "y":
            raise ZeroDivisionError
        return json.dumps({"results": [evidence_answer(p) for p in payload_list(prompt)]}, ensure_ascii=False)

    def found(some):
        got = judging.evidence_review(items_of(spark, some), judge, "{items_json}")
        return sorted((r["bundle_id"], r["code"], r["message"]) for r in got.collect())

    whole = found(rows)
    assert [r for r in whole if r[0] == "y"] == [("y", "F03.LLM_SKIPPED", "無法初始化或執行 LLM 判讀（ZeroDivisionError）；其餘規則檢查不受影響。")]
    assert [r for r in whole if r[0] != "y"] == found([r for r in rows if r[0] != "y"])


def test_budget_split(spark):
    rows = [("x", i, i // 2, n) for i, n in enumerate([10, 10, 4000, 3000, 9000, 1, 9000])]
    df = spark.createDataFrame(rows, "bundle_id string, pos int, batch_no int, tokens int")
    got = judging.split_over_budget(df, overhead=100).orderBy("pos").collect()
    assert [r["batch_no"] for r in got] == [0, 0, 1, 2, 3, 4, 5]


def test_payload_tokens(spark, canonical):
    rows = [item("x", 0, "1-1", prop='引"號\n換行')]
    got = judging.payloads(items_of(spark, rows), canonical, 2, 300).first()
    payload = json.loads(got["payload"])
    text = json.dumps(payload, ensure_ascii=False)
    wide = sum(0x4E00 <= ord(c) <= 0x9FFF or 0x3000 <= ord(c) <= 0x30FF for c in text)
    assert got["tokens"] == wide + (len(text) - wide) // 4
    assert len(payload["sections"][0]["excerpt"]) == 300 and got["clipped"] == 1 and got["dropped"] == 0
    assert got["refs"] == ["R03 五、(二) 2", "R07 五、(二) 2"]


def test_branch_off_or_broken(spark):
    bundles = spark.createDataFrame([("x",)], "bundle_id string")
    assert judging.optional_branch(False, bundles, lambda: 1 / 0, "F03.LLM_SKIPPED", "evidence") is None
    got = judging.optional_branch(True, bundles, lambda: 1 / 0, "F03.LLM_SKIPPED", "evidence").collect()
    assert [r["message"] for r in got] == ["無法初始化或執行 LLM 判讀（ZeroDivisionError）；其餘規則檢查不受影響。"]


# ---- retrieval -------------------------------------------------------------


def test_topk_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(500, 8))
    v[10] = v[11] = v[12]
    df = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>").repartition(7)
    q = df.filter("id % 25 = 0 or id = 11").withColumnRenamed("id", "query_id")
    got = {}
    for r in retrieval.cosine_topk(q, df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    assert got == {int(i): [int(j) for j in np.lexsort((np.arange(500), -s[i]))[:4]] for i in got}
    assert len(got) == 21
    with pytest.raises(ValueError, match="near_topk"):
        retrieval.cosine_topk(q, df, 4, max_query_values=40)


def test_topk_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    assert retrieval.cosine_topk(df.withColumnRenamed("id", "query_id").filter("query_id < 0"), df, 3).count() == 0


def fake_embedder(texts):
    # direction by length and first character: deterministic and cheap
    return [[float(len(t)), float(ord(t[0])) if t else 0.0, 1.0] for t in texts]


def test_embed_checks_the_count(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, text string")
    with pytest.raises(Exception, match="1 vectors|vectors"):
        retrieval.embed(df, "text", lambda t: [[1.0]] if len(t) > 1 else []).collect()
    got = retrieval.embed(df, "text", lambda t: 1 / 0, isolate=True).collect()
    assert {r["error"] for r in got} == {"ZeroDivisionError"} and got[0]["embedding"] is None


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    lines = [("a.txt", 0, i, t) for i, t in enumerate(["第一條 甲乙丙。", "第二條 丁。"])]
    lines += [("b.txt", 0, i, t) for i, t in enumerate(["一、總則：", "引言。", "（一）定義：", "內容。", "（二）程序：", "步驟。"])]
    page_lines = spark.createDataFrame(lines, "doc_id string, page_no int, line_no int, line string")
    docs = spark.createDataFrame([("a.txt", "R01", "辦法甲", 1), ("b.txt", "R03", "辦法乙", 1), ("c.txt", "X99", "無關", 1)], "doc_id string, reg_code string, reg_title string, n_pages int")
    sources = spark.createDataFrame([("a.pdf", bytearray(b"abc"))], "filename string, content binary")
    table = index_plan.build_index(page_lines, docs, sources, fake_embedder, path, "fake", 3)
    return path, table


def test_index(spark, built):
    path, table = built
    got = [(r["reg_code"], r["section_path"], r["order"]) for r in table.orderBy("reg_code", "order").collect()]
    assert got == [("R01", "第一條", 0), ("R01", "第二條", 1), ("R03", "一", 0), ("R03", "一/(一)", 1), ("R03", "一/(二)", 2)]
    meta = spark.read.schema(schemas.INDEX_META).json(f"{path}/meta").collect()
    assert {r["name"]: r["chunks"] for r in meta if r["kind"] == "chunks"} == {"R01": 2, "R03": 3}
    assert {r["name"]: r["sha256"] for r in meta if r["kind"] == "source"} == {"a.pdf": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}
    for model, dim in (("other", 3), ("fake", 4)):
        with pytest.raises(tables.IndexMismatch):
            tables.open_index(spark, path, model, dim)
    with pytest.raises(tables.IndexMismatch):
        tables.open_index(spark, path + "/none", "fake", 3)


def test_index_update_embeds_changed_codes_only(spark, tmp_path):
    lines = {
        "a.txt": ["第一條 甲乙丙。", "第二條 丁。"], "b.txt": ["一、總則：", "引言。"], "c.txt": ["第一條 戊。"], "d.txt": ["第一條 己。"],
    }
    titles = {"a.txt": ("R01", "辦法甲"), "b.txt": ("R03", "辦法乙"), "c.txt": ("R02", "辦法丙"), "d.txt": ("R04", None), "x.txt": ("X99", "無關")}
    registry = {"R01": "article", "R02": "article", "R03": "chapter", "R04": "article", "R 5/": "article"}

    def given(lines, titles):
        rows = [(d, 0, i, t) for d, ls in lines.items() for i, t in enumerate(ls)]
        return (
            spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, line string"),
            spark.createDataFrame([(d, *t, 1) for d, t in titles.items()], "doc_id string, reg_code string, reg_title string, n_pages int"),
            spark.createDataFrame([(d, bytearray(str(ls).encode())) for d, ls in lines.items()], "filename string, content binary"),
        )

    def build_of(n):
        return lambda texts: [[float(n), float(len(t))] for t in texts]

    def rows(table, vectors=True):
        return sorted((r["reg_code"], r["order"], r["text"], r["embedding"][1], r["embedding"][0] if vectors else 0) for r in table.collect())

    path = str(tmp_path / "index")
    # nothing stored: the first update is a whole build
    table = index_plan.update_index(*given(lines, titles), build_of(1), path, "m", 2, registry)
    assert {(r[0], r[4]) for r in rows(table)} == {(c, 1.0) for c in ("R01", "R02", "R03", "R04")}
    # nothing changed, lines in another order: no call
    def never(texts):
        raise AssertionError("called")

    page_lines, docs, sources = given(lines, titles)
    same = index_plan.update_index(page_lines.orderBy(F.desc("line_no")), docs, sources, never, path, "m", 2, registry)
    assert rows(same) == rows(table)
    # one changed, one gone, one without lines, one new, with a name that needs escapes
    new_lines = {"a.txt": ["第一條 甲乙。", "第二條 丁。"], "b.txt": lines["b.txt"], "e.txt": ["第一條 庚。"]}
    new_titles = {"a.txt": titles["a.txt"], "b.txt": titles["b.txt"], "d.txt": titles["d.txt"], "e.txt": ("R 5/", "辦法戊")}
    updated = index_plan.update_index(*given(new_lines, new_titles), build_of(2), path, "m", 2, registry)
    assert {(r[0], r[4]) for r in rows(updated)} == {("R01", 2.0), ("R03", 1.0), ("R 5/", 2.0)}
    whole = index_plan.build_index(*given(new_lines, new_titles), build_of(3), str(tmp_path / "whole"), "m", 2, registry)
    assert rows(updated, False) == rows(whole, False)
    meta = [spark.read.schema(schemas.INDEX_META).json(f"{p}/meta").drop("built_at") for p in (path, str(tmp_path / "whole"))]
    assert sorted(map(str, meta[0].collect())) == sorted(map(str, meta[1].collect()))
    # an update that fails on its way is made up for, also when the sources have gone back since
    with pytest.raises(Exception, match="called"):
        index_plan.update_index(*given(lines, titles), never, path, "m", 2, registry)
    back = index_plan.update_index(*given(new_lines, new_titles), build_of(4), path, "m", 2, registry)
    assert {(r[0], r[4]) for r in rows(back)} == {("R01", 4.0), ("R03", 1.0), ("R 5/", 4.0)}
    # another model: everything again
    other = index_plan.update_index(*given(new_lines, new_titles), build_of(5), path, "n", 2, registry)
    assert {r[4] for r in rows(other)} == {5.0}
    # no documents at all
    none = index_plan.update_index(page_lines.limit(0), docs.limit(0), sources.limit(0), never, path, "n", 2, registry)
    assert none.count() == 0


def test_retrieval_map(spark, built, tmp_path):
    _, table = built
    items = spark.createDataFrame(
        [("1-1", "議題", "描述", "R03/一;R01/第一條"), ("1-2", None, "無", None)],
        "item_id string, topic string, description string, canonical_ref_raw string",
    )
    questions = spark.createDataFrame([("UC-01", "問題"), ("UC-02", "")], "qid string, question_text string")
    got, asked = index_plan.build_retrieval_map(table, items, questions, fake_embedder, str(tmp_path / "map"), "fake", 5, threshold=None)
    rows = {r["item_id"]: r for r in got.collect()}
    assert [(s["section_path"], s["origin"]) for s in rows["1-1"]["sections"]] == [("一", "curated"), ("一/(一)", "curated"), ("一/(二)", "curated")]
    assert [(r["reg_code"], r["section_path_prefix"]) for r in rows["1-1"]["refs"]] == [("R03", "一"), ("R01", "第一條")]
    assert {s["origin"] for s in rows["1-2"]["sections"]} == {"semantic"} and len(rows["1-2"]["sections"]) == 3
    assert [r["qid"] for r in asked.collect()] == ["UC-01"]
    recall, scores = index_plan.evaluate(table, items, fake_embedder, 5)
    assert recall.first()["refs"] == 2 and recall.first()["recalled"] == 2
    assert scores.first()["hit_max"] <= 1.0


@pytest.mark.parametrize(
    "text",
    [
        "not json", "[1]", '{"schema_version": 999, "built_at": "x", "embedding_model": "m"}',
        '{"schema_version": "1", "built_at": "x", "embedding_model": "m"}',
        '{"schema_version": 1, "embedding_model": "m"}', '{"schema_version": 1, "built_at": "x", "embedding_model": "m", "more": 1}',
        '{"schema_version": 1, "built_at": "x", "embedding_model": "m", "f03_items": {"a": {"bad": 1}}}',
        '{"schema_version": 1, "built_at": "x", "embedding_model": "m", "f02_questions": {"a": {"qid": "a", "sections": [{"reg_code": "R01"}]}}}',
        '{"schema_version": 1, "built_at": "x", "embedding_model": "m", "f02_questions": {"a": {"qid": "a", "sections": [{"reg_code": "R01", "section_path": "", "title": "", "excerpt": "", "origin": "other"}]}}}',
    ],
)
def test_bad_maps(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text, encoding="utf-8")
    with pytest.raises(tables.RetrievalMapError):
        tables.load_retrieval_map(spark, str(tmp_path / "m.json"))
    with pytest.raises(tables.RetrievalMapError):
        tables.load_retrieval_map(spark, str(tmp_path / "none.json"))


def test_large_map(spark, tmp_path):
    """Twelve thousand items: written and read by rows, in several files."""
    items = spark.range(12_000, numPartitions=6).selectExpr("cast(id as string) AS item_id", "'t' AS topic", "'d' AS description", "'R03' AS canonical_ref_raw")
    parsed = refs.parse_refs(items, ["item_id"], "canonical_ref_raw")
    none = spark.createDataFrame([], "qid string, question_text string")
    sections = spark.createDataFrame([], "key string, pos long, reg_code string, section_path string, title string, excerpt string, score double, origin string")
    tables.write_retrieval_map(*retrieval.nest_sections(items, parsed, sections, none, sections), str(tmp_path / "map"), "m")
    loaded, _ = tables.load_retrieval_map(spark, str(tmp_path / "map"))
    assert loaded.select("item_id").distinct().count() == 12_000 and loaded.rdd.getNumPartitions() > 1


def test_map_over_several_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n"schema_version": 1,\n"built_at": "x", "embedding_model": "m",\n"f03_items": {"1-1":\n{"item_id": "1-1"}}}\n')
    assert tables.load_retrieval_map(spark, str(tmp_path / "m.json"))[0].count() == 1


def test_minimal_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"schema_version": 1, "built_at": "x", "embedding_model": "m", "f03_items": {"1-1": {"item_id": "1-1"}}}')
    items, questions = tables.load_retrieval_map(spark, str(tmp_path / "m.json"))
    assert items.first()["sections"] == [] and questions.count() == 0


def test_drop_related(spark):
    sem = spark.createDataFrame([("k", i, "R03", p, "", "", 0.5, "semantic") for i, p in enumerate(["五", "五/(二)", "五/(二)/1", "五/(二十)", "六"])], "key string, pos long, reg_code string, section_path string, title string, excerpt string, score double, origin string")
    cur = sem.filter("section_path = '五/(二)'").withColumn("origin", F.lit("curated"))
    left = retrieval.drop_related(sem, cur)
    assert sorted(r["section_path"] for r in left.collect()) == ["五/(二十)", "六"]
    merged = retrieval.merge_sections(cur, left, 2).orderBy("pos").collect()
    assert [r["section_path"] for r in merged] == ["五/(二)", "五/(二十)"]


def test_short_notes(spark):
    cases = {"上線階段沒有提供任何佐證": "沒有提供任何佐證", "佐證為空白，無法判斷": "佐證為空白", "一二三四五六七八九": "一二三四五六七八…", None: ""}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(matrix.short_note(F.col("c"))).collect()] == list(cases.values())


def test_findings_report_order(spark, compliance):
    df = report.order_findings(spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in compliance], schemas.FINDINGS))
    gap = [r["code"] for r in df.filter("bundle_id = 'gap'").orderBy("seq").collect()]
    assert gap == ["F03.RAG_GAP", "F03.RAG_TABLE", "F03.RAG_SUMMARY"]


def test_any_text_is_true(spark):
    from sheaf.operators.judging import _truthy

    flags = ['"false"', "false", '""', "0", "null", "[]", '"0"', "true", "1", '"x"']
    rows = [(i, '{"difference":{"summary":"a \\"flag\\":\\"x\\"","flag":%s}}' % f) for i, f in enumerate(flags)] + [(99, "{}")]
    df = spark.createDataFrame(rows, "i int, raw string")
    got = {r[0]: r[1] for r in df.select("i", _truthy("difference.flag")).collect()}
    assert [got[i] for i in range(len(flags))] == [True, False, False, False, False, False, True, True, True, True] and got[99] is False


def test_prompt_budget_counts_the_template():
    from sheaf.operators.judging import template_tokens

    assert template_tokens("審查 abcd{items_json}") == 2 + (5 + 12) // 4


def test_evidence_texts_stay_out_of_verdict_tables(spark, canonical):
    """What meets the answers and is written down holds no evidence texts, however long they are."""
    import pathlib
    import random

    from sheaf.functions import session

    draw = random.Random(3)
    long = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)) for _ in range(16)]
    rows = [item(f"b{i}", j, f"1-{j}", prop=long[2 * i + j - 1], golive=None if j == 1 else long[2 * i + j - 1]) for i in range(8) for j in (1, 2)]
    items = items_of(spark, rows).localCheckpoint()
    said = json.dumps({"results": [{"item_id": "1-1"}, {"item_id": "1-2", "verdict": "covered"}]})
    mark = session.written_tables()
    evidence = judging.evidence_review(items, lambda prompt: said, "{items_json}").collect()
    compliance = judging.compliance_review(items, canonical, lambda prompt: said, "{items_json}").collect()
    size = sum(f.stat().st_size for path in session._WRITTEN[mark:] for f in pathlib.Path(path.removeprefix("file:")).rglob("*.parquet"))
    assert size < sum(map(len, long))
    table = next(r["message"] for r in evidence if r["bundle_id"] == "b0" and r["code"] == "F03.LLM_TABLE")
    assert table.split("\n")[2:] == ["| 1-1 | 議題 | — | ✅ | — |", "| 1-2 | 議題 | — | ✅ | ✅ |"]
    assert sum(r["code"] == "F03.RAG_TABLE" for r in compliance) == 8


def test_a_wave_reads_its_own_folder(spark, tmp_path, monkeypatch):
    """The ledger and the prompts are not read again by every wave."""
    tables_read = []
    run = judging.materialise
    monkeypatch.setattr(judging, "materialise", lambda df, *by: tables_read.append(by) or run(df, *by))
    rows = spark.createDataFrame([(f"b{b}", n, f"{b}|{n}") for b in range(12) for n in range(2)], "bundle_id string, batch_no int, prompt string")
    for _ in range(2):
        out = judging.run_judge(rows, lambda prompt: '{"a":1}', ledger=str(tmp_path / "ledger"), calls_per_commit=4).collect()
        assert sorted((r["bundle_id"], r["batch_no"], r["response"]) for r in out) == sorted((f"b{b}", n, '{"a":1}') for b in range(12) for n in range(2))
    assert tables_read == [(), ("__wave",)] * 2


def test_no_evidence_text_is_shuffled_for_verdicts(spark, canonical):
    """Items are numbered and batched for the answers by marks of their texts; token counts are those of whole payloads."""
    from sheaf.functions import text as X

    def windows(node) -> list[list[str]]:
        below = [w for i in range(node.children().size()) for w in windows(node.children().apply(i))]
        own = [node.output().apply(i).name() for i in range(node.output().size())]
        return [own, *below] if node.nodeName() == "Window" else below

    rows = [item("b", j, f"1-{j}", prop="證據 “a” " * j, golive=None if j == 1 else "x\n\\y") for j in (1, 2)]
    items = items_of(spark, rows)
    capped, _ = judging.cap_items(judging.judge_targets(items))
    for batched in (judging.evidence_payloads(capped), judging.payloads(capped, canonical)):
        found = windows(judging.verdict_rows(batched)._jdf.queryExecution().optimizedPlan())
        assert found and all("row_index" in w and not {"evidence_proposal", "evidence_golive"} & set(w) for w in found)
    for r in judging.evidence_payloads(capped).withColumn("whole", X.estimate_tokens(F.col("payload"))).collect():
        given = json.loads(r["payload"])
        assert list(given) == ["item_id", "description", "proposal", "golive"] and r["tokens"] == r["whole"]
        assert given["golive"] == ("（空白）" if r["item_id"] == "1-1" else "x\n\\y")
    for r in judging.payloads(capped, canonical).collect():
        given = json.loads(r["payload"])
        assert list(given) == ["item_id", "description", "sections", "proposal", "golive"]
        whole = spark.range(1).select(judging.payload_tokens(F.lit(r["payload"]), F.lit(len(given["sections"]))))
        assert r["tokens"] == whole.first()[0]
