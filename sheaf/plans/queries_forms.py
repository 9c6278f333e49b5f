"""Queries over forms: cells, classification, scoring, rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.functions.findings import emit
from sheaf.functions.session import checkpoint_dir, materialise
from sheaf.operators import chunking, classify, layout, rules, scan, scoring
from sheaf.plans.inputs import Inputs
from sheaf.plans.registry import EXPECTED, query
from sheaf.plans.review import QUESTION_IDS, f02_scored
from sheaf.sources import tables

KEY = "bundle_id"
WIDE = "　"

# ---- expected tables -------------------------------------------------------

_CLEAN = f"nullif(trim({{0}}, ' {WIDE}'), '')"
_ANSWER = "CASE upper(trim({0}, ' " + WIDE + "')) WHEN 'Y' THEN 'Y' WHEN '是' THEN 'Y' WHEN 'N' THEN 'N' WHEN '否' THEN 'N' END"
_WEIGHTS = ", ".join(f"({i}, '{q[0]}', '{q[1]}', {', '.join(f'CAST({v} AS DOUBLE)' for v in q[2:])})" for i, q in enumerate(P.QUESTIONS))
_DOMAINS = P.DOMAINS
_BAND = "CASE WHEN {0} < 50 THEN '低' WHEN {0} < 75 THEN '中' ELSE '高' END"
_LABEL = "CASE kind WHEN 'f01' THEN 'F01 系統資訊表' WHEN 'f02' THEN 'F02 風險評鑑' WHEN 'f03' THEN 'F03 上線檢核表' WHEN 'supporting' THEN '佐證文件' WHEN 'unknown' THEN '無法辨識' ELSE kind END"

EXPECTED.update(
    weights_x=f"SELECT * FROM (VALUES {_WEIGHTS}) AS w(q_seq, qid, score_on, finance, operation, reputation, compliance)",
    answers_x=f"""
        SELECT bundle_id, qid, {_ANSWER.format("raw")} AS answer
        FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, qid ORDER BY row DESC) AS k FROM f02_lines) WHERE k = 1""",
    forms_x=f"""
        SELECT bundle_id, {_ANSWER.format("factor1")} AS u1, {_ANSWER.format("factor2")} AS u2, {_ANSWER.format("factor3")} AS u3,
               TRY_CAST(finance AS DOUBLE) AS n1, TRY_CAST(operation AS DOUBLE) AS n2,
               TRY_CAST(reputation AS DOUBLE) AS n3, TRY_CAST(trim(compliance) AS DOUBLE) AS n4,
               TRY_CAST(overall AS DOUBLE) AS cached_overall, {_CLEAN.format("grade")} AS cached_grade, {_CLEAN.format("filing_unit")} AS filing_unit
        FROM f02_fixed""",
    scored_x="""
        SELECT bundle_id, t1 * m / 9 * 100 AS finance, t2 * m / 16 * 100 AS operation, t3 * m / 13.5 * 100 AS reputation, t4 * m / 9 * 100 AS compliance,
               greatest(t1 * m / 9 * 100, t2 * m / 16 * 100, t3 * m / 13.5 * 100, t4 * m / 9 * 100) AS overall
        FROM (SELECT f.bundle_id, coalesce(sum(w.finance), 0) AS t1, coalesce(sum(w.operation), 0) AS t2, coalesce(sum(w.reputation), 0) AS t3,
                     coalesce(sum(w.compliance), 0) AS t4,
                     CAST(max(CASE WHEN u1 = 'Y' THEN 0.8 ELSE 1 END) AS DOUBLE) * CAST(max(CASE WHEN u2 = 'Y' THEN 0.8 ELSE 1 END) AS DOUBLE)
                     * CAST(max(CASE WHEN u3 = 'Y' THEN 1.2 ELSE 1 END) AS DOUBLE) AS m
              FROM forms_x f LEFT JOIN answers_x a USING (bundle_id) LEFT JOIN weights_x w ON w.qid = a.qid AND w.score_on = a.answer
              GROUP BY f.bundle_id)""",
    members_x="SELECT b.bundle_id, w.q_seq, w.qid, a.answer FROM (SELECT DISTINCT bundle_id FROM f02_fixed) b CROSS JOIN weights_x w LEFT JOIN answers_x a ON a.bundle_id = b.bundle_id AND a.qid = w.qid",
    items_x=f"""
        SELECT * FROM (
          SELECT bundle_id, row AS row_index, item_id, last_value(lifecycle IGNORE NULLS) OVER (PARTITION BY bundle_id ORDER BY row) AS lifecycle,
                 topic, description,
                 CASE WHEN (CASE WHEN y THEN 1 ELSE 0 END) + (CASE WHEN n THEN 1 ELSE 0 END) + (CASE WHEN a THEN 1 ELSE 0 END) <> 1 THEN NULL
                      WHEN y THEN '是' WHEN n THEN '否' ELSE '不適用' END AS check_state,
                 {_CLEAN.format("evidence_proposal")} AS evidence_proposal, {_CLEAN.format("evidence_golive")} AS evidence_golive, regulation_ref_raw
          FROM (SELECT *, mark_yes = 'V' AS y, mark_no = 'x' AS n, coalesce(mark_na = 'v', false) AS a FROM f03_wide))
        WHERE item_id <> '備註'""",
    kinds_x=f"""
        SELECT *, CASE WHEN NOT (lower(filename) LIKE '%.xlsx' OR lower(filename) LIKE '%.xlsm' OR lower(filename) LIKE '%.xltx') THEN 'supporting'
                       WHEN NOT readable THEN 'unknown'
                       WHEN list_contains(string_split(sheet_list, '|'), '{P.ASSESS_SHEET}') THEN 'f02'
                       WHEN list_contains(string_split(sheet_list, '|'), '{P.F01_SHEET}') THEN 'f01'
                       WHEN list_contains(string_split(sheet_list, '|'), '{P.F03_SHEET}') THEN 'f03' ELSE 'unknown' END AS kind
        FROM event_files""",
    winners_x="SELECT bundle_id, kind, min(file_idx) AS winner_idx FROM kinds_x WHERE kind IN ('f01','f02','f03') AND file_id IS NOT NULL GROUP BY bundle_id, kind",
)


# ---- cells -----------------------------------------------------------------


@query(
    "read_cells", "SRC-01 SRC-03",
    f"""SELECT sheet, count(*) AS n_cells, count(DISTINCT bundle_id) AS n_bundles, sum(length(value))::BIGINT AS n_chars FROM (
          SELECT bundle_id, '{P.F03_SHEET}' AS sheet, unnest([item_id, lifecycle, topic, description, mark_yes, mark_no, mark_na, evidence_proposal, evidence_golive, regulation_ref_raw]) AS value FROM f03_wide
          UNION ALL SELECT bundle_id, '{P.F03_SHEET}', owner FROM f03_owner
          UNION ALL SELECT bundle_id, sheet, value FROM f01_subs) WHERE value IS NOT NULL GROUP BY sheet""",
)
def read_cells(x: Inputs) -> DataFrame:
    """Derived grids written by sheet and read back with the fixed schema."""
    import uuid

    path = f"{checkpoint_dir(x.spark)}/cells-{uuid.uuid4()}"
    subs = x.get("f01_subs").select(KEY, "sheet", F.col("row").cast("bigint"), "col", "value")
    cells = x.f03_cells().unionByName(subs)
    typed = cells.select(
        F.col(KEY).cast("string"), F.lit("f").alias("file_id"), "sheet", F.col("row").cast("int"), "col", "value",
        F.lit(None).cast("string").alias("formula"),
    )
    tables.write_cells(typed, path)
    return tables.read_cells(x.spark, path).groupBy("sheet").agg(
        F.count(F.lit(1)).alias("n_cells"), F.countDistinct(KEY).alias("n_bundles"), F.sum(F.length("value")).alias("n_chars")
    )


@query(
    "sheet_directory", "SRC-03",
    f"""SELECT bundle_id, string_agg(DISTINCT sheet, '|' ORDER BY sheet) AS sheets
        FROM (SELECT bundle_id, sheet FROM f01_subs WHERE value IS NOT NULL UNION ALL SELECT bundle_id, '{P.F01_SHEET}' FROM f01_wide WHERE coalesce(c_a,c_b,c_c,c_d,c_e,c_f,c_g,c_h,c_i,c_j,c_k,c_l) IS NOT NULL) GROUP BY bundle_id""",
)
def sheet_directory(x: Inputs) -> DataFrame:
    found = tables.sheet_directory(x.f01_cells(), (KEY,))
    return found.select(KEY, F.array_join("sheets", "|").alias("sheets"))


_F01_CLEAN = ", ".join(f"{_CLEAN.format('c_' + c.lower())} AS {n}" for c, n in P.F01_COLUMNS.items())
EXPECTED["f01_x"] = f"SELECT * FROM (SELECT bundle_id, row AS row_index, {_F01_CLEAN} FROM f01_wide) WHERE coalesce({', '.join(P.F01_COLUMNS.values())}) IS NOT NULL"


@query("pivot_cells", "PRJ-01 PRJ-02", "SELECT * FROM f01_x")
def pivot_cells(x: Inputs) -> DataFrame:
    return layout.f01_rows(x.f01_cells(), tasks=x.celled_tasks("orders"))


EXPECTED["subs_x"] = f"SELECT bundle_id, sheet, row AS row_index, {_CLEAN.format('value')} AS corr_project_name FROM f01_subs WHERE {_CLEAN.format('value')} IS NOT NULL AND value NOT LIKE '%對應前頁填寫%'"


@query("sub_sheet_refs", "PRJ-03", "SELECT * FROM subs_x")
def sub_sheet_refs(x: Inputs) -> DataFrame:
    return layout.f01_sub_refs(x.f01_cells()).drop("sheet_seq")


@query("bundle_subject", "PRJ-04", "SELECT bundle_id, arg_min(coalesce(project_name, '~'), row_index) AS subject FROM f01_x GROUP BY bundle_id")
def bundle_subject(x: Inputs) -> DataFrame:
    return layout.f01_subject(layout.f01_rows(x.f01_cells())).withColumn("subject", F.coalesce("subject", F.lit("~")))


@query("answers_last_row", "PRJ-05 PRJ-06", "SELECT * FROM answers_x")
def answers_last_row(x: Inputs) -> DataFrame:
    return layout.f02_answers(x.f02_cells(), QUESTION_IDS)


@query(
    "fixed_cells", "PRJ-07",
    f"SELECT bundle_id, {', '.join(_CLEAN.format(n) + ' AS ' + n for n, *_ in P.F02_FIXED_CELLS)} FROM f02_fixed",
)
def fixed_cells(x: Inputs) -> DataFrame:
    return layout.fixed_cells(x.f02_fixed_cells())


@query(
    "cached_scores", "PRJ-08",
    """SELECT bundle_id, CASE WHEN ok THEN n1 END AS cached_finance, CASE WHEN ok THEN n2 END AS cached_operation,
              CASE WHEN ok THEN n3 END AS cached_reputation, CASE WHEN ok THEN n4 END AS cached_compliance, cached_overall, cached_grade
       FROM (SELECT *, n1 IS NOT NULL AND n2 IS NOT NULL AND n3 IS NOT NULL AND n4 IS NOT NULL AS ok FROM forms_x)""",
)
def cached_scores(x: Inputs) -> DataFrame:
    return layout.cached_scores(layout.fixed_cells(x.f02_fixed_cells()))


@query(
    "residual_status", "PRJ-09",
    """SELECT bundle_id, true AS residual_filled, TRY_CAST(residual_a AS DOUBLE) AS residual_max_score
       FROM f02_fixed WHERE coalesce(residual_a <> 'N/A', false) OR coalesce(residual_b <> 'NA', false)""",
)
def residual_status(x: Inputs) -> DataFrame:
    return layout.residual_status(x.f02_fixed_cells())


@query(
    "treatment_status", "PRJ-10",
    f"SELECT bundle_id, true AS treatment_filled FROM f02_fixed WHERE treatment IS NOT NULL OR {_CLEAN.format('filing_unit')} IS NOT NULL",
)
def treatment_status(x: Inputs) -> DataFrame:
    return layout.treatment_status(x.f02_fixed_cells())


@query(
    "checklist_owner", "PRJ-11",
    "SELECT c_custkey AS bundle_id, CASE WHEN owner <> 'xxx' THEN trim(owner) END AS system_owner, owner IS NOT NULL AS sheet_present FROM customer LEFT JOIN f03_owner ON bundle_id = c_custkey",
)
def checklist_owner(x: Inputs) -> DataFrame:
    return layout.f03_identity(x.f03_cells(), x.table("customer").select(F.col("c_custkey").alias(KEY)))


@query(
    "checklist_items", "PRJ-12 PRJ-13 PRJ-14 PRJ-15",
    """SELECT *, coalesce(check_state = '是', false) AS is_done,
              '項次 ' || item_id || coalesce('（' || topic || '）', '') AS loc FROM items_x""",
)
def checklist_items(x: Inputs) -> DataFrame:
    return layout.f03_items(x.f03_cells())


@query(
    "forward_fill", "PRJ-13",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
              OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""",
)
def forward_fill(x: Inputs) -> DataFrame:
    events = x.table("events").select("event_id", "user_id", "event_type", "value")
    known = F.when(F.col("event_type") == "purchase", F.col("value"))
    return scan.fill_forward(events, ["user_id"], ["event_id"], scan.blocks("event_id", 4096), known, "carried").select("event_id", "user_id", "carried")


@query(
    "one_hot_state", "PRJ-14",
    """SELECT state, count(*) AS n FROM (SELECT CASE WHEN (CASE WHEN a THEN 1 ELSE 0 END) + (CASE WHEN b THEN 1 ELSE 0 END) + (CASE WHEN c THEN 1 ELSE 0 END) <> 1 THEN 'none'
         WHEN a THEN 'returned' WHEN b THEN 'open' ELSE 'large' END AS state
       FROM (SELECT l_returnflag = 'R' AS a, l_linestatus = 'O' AS b, l_quantity > 40 AS c FROM lineitem)) GROUP BY state""",
)
def one_hot_state(x: Inputs) -> DataFrame:
    marks = {
        "returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "large": F.col("l_quantity") > 40,
    }
    state = F.coalesce(layout.one_hot_label(marks), F.lit("none"))
    return x.table("lineitem").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def _template(x: Inputs) -> DataFrame:
    """Question rows, their formulas and the reference table of each part."""
    index = F.array_position(F.array(*[F.lit(q) for q in QUESTION_IDS]), F.col("qid")).cast("bigint") + 1
    rows = x.get("f02_lines").groupBy(KEY, "qid").agg(F.max("raw").alias("raw")).withColumn("r", index)
    # row 66 of the reference sheet holds the totals
    rows = rows.filter(F.col("r") + 50 != P.DENOMINATOR_ROW)
    formula = X.fill('=IF($C{r}="{a}", 固有風險分數參照表!T${ref}, 0)', r=F.col("r"), a=F.when(F.col("r") % 4 == 0, "N").otherwise("Y"), ref=F.col("r") + 50)

    def cell(sheet, row, col, value=None, formula=None):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(sheet).alias("sheet"), row.alias("row"), F.lit(col).alias("col"), (none if value is None else value.cast("string")).alias("value"), (none if formula is None else formula).alias("formula"))

    r = F.col("r")
    ref = [cell(P.REFERENCE_SHEET, r + 50, c, (F.col("r") + i * F.col(KEY)) % 5) for i, c in enumerate(P.REFERENCE_COLUMNS)]
    cells = rows.select(
        KEY,
        F.inline(F.array(cell(P.ASSESS_SHEET, r, "A", F.col("qid")), cell(P.ASSESS_SHEET, r, "B", F.concat(F.lit("題 "), F.col("raw"))), cell(P.ASSESS_SHEET, r, "E", formula=formula), *ref)),
    )
    parts = x.table("part").select(F.col("p_partkey").alias(KEY))
    uplift = X.fill('=IF($C{r}="Y",固有風險分數參照表!$T${ref},1)', r=F.lit(42), ref=F.col(KEY) % 20 + 53)
    fixed = parts.select(
        KEY,
        F.inline(
            F.array(
                *[cell(P.ASSESS_SHEET, F.lit(r).cast("bigint"), "E", formula=uplift) for r in (42, 43, 44)],
                *[cell(P.REFERENCE_SHEET, F.lit(P.DENOMINATOR_ROW).cast("bigint"), c, F.col(KEY) % 10 + i) for i, c in enumerate(P.REFERENCE_COLUMNS)],
            )
        ),
    )
    return cells.unionByName(fixed)


# row 66 holds the totals; the question of that reference row is left to them
EXPECTED["template_x"] = f"SELECT bundle_id, qid, max(raw) AS raw, list_position([{', '.join(repr(q) for q in QUESTION_IDS)}], qid) + 1 AS r FROM f02_lines GROUP BY bundle_id, qid"
_TOTALS_ROW = P.DENOMINATOR_ROW - 50


@query(
    "question_texts", "SRC-18",
    f"SELECT bundle_id, qid, rtrim('題 ' || raw, ' {WIDE}') AS question_text FROM template_x WHERE r <> {_TOTALS_ROW}",
)
def question_texts(x: Inputs) -> DataFrame:
    return layout.question_texts(_template(x), QUESTION_IDS)


@query(
    "extract_weights", "PRJ-16",
    f"""SELECT bundle_id, CAST(r AS BIGINT) AS q_seq, qid, CASE WHEN r % 4 = 0 THEN 'N' ELSE 'Y' END AS score_on,
           CASE WHEN r + 50 = 66 THEN 0 ELSE CAST(r % 5 AS DOUBLE) END AS finance, CAST((r + bundle_id) % 5 AS DOUBLE) AS operation,
           CAST((r + 2 * bundle_id) % 5 AS DOUBLE) AS reputation, CAST((r + 3 * bundle_id) % 5 AS DOUBLE) AS compliance
        FROM template_x WHERE r <> {_TOTALS_ROW}""",
)
def extract_weights(x: Inputs) -> DataFrame:
    return layout.extract_weights(_template(x))


@query(
    "extract_factors", "PRJ-17",
    f"""SELECT p.p_partkey AS bundle_id, 'multiplier' AS what, f.name, coalesce(CAST((t.r) % 5 AS DOUBLE), 0) AS value
        FROM part p CROSS JOIN (VALUES ('factor1'), ('factor2'), ('factor3')) AS f(name)
        LEFT JOIN template_x t ON t.bundle_id = p.p_partkey AND t.r + 50 = p.p_partkey % 20 + 53 AND t.r <> {_TOTALS_ROW}
        WHERE p.p_partkey % 20 + 53 <> 66
        UNION ALL
        SELECT p_partkey, 'multiplier', f.name, CAST(p_partkey % 10 AS DOUBLE) FROM part CROSS JOIN (VALUES ('factor1'), ('factor2'), ('factor3')) AS f(name)
        WHERE p_partkey % 20 + 53 = 66
        UNION ALL
        SELECT p_partkey, 'denominator', d.name, CAST(p_partkey % 10 + d.i AS DOUBLE)
        FROM part CROSS JOIN (VALUES ('finance', 0), ('operation', 1), ('reputation', 2), ('compliance', 3)) AS d(name, i)""",
)
def extract_factors(x: Inputs) -> DataFrame:
    return layout.extract_factors(_template(x))


@query(
    "canonical_items", "SRC-17",
    """SELECT bundle_id, row AS row_index, item_id, topic, description, regulation_ref_raw AS canonical_ref_raw FROM f03_wide
       WHERE item_id <> '備註' AND row < 35""",
)
def canonical_items(x: Inputs) -> DataFrame:
    return layout.canonical_items(x.f03_cells())


@query(
    "config_tables", "SRC-06",
    """SELECT o_orderstatus AS domain, d.denom, count(*) AS n FROM orders JOIN
       (VALUES ('F', 'finance', 9.0::DOUBLE), ('O', 'operation', 16.0::DOUBLE), ('P', 'reputation', 13.5::DOUBLE)) AS d(s, domain, denom) ON d.s = o_orderstatus GROUP BY ALL""",
)
def config_tables(x: Inputs) -> DataFrame:
    """Configuration as broadcast dimensions joined to a fact table."""
    dims = scoring.scoring_dims(x.spark)
    names = X.lookup_map({"F": "finance", "O": "operation", "P": "reputation"})
    orders = x.table("orders").select("o_orderstatus", names[F.col("o_orderstatus")].alias("domain"))
    return (
        orders.join(F.broadcast(dims["denominators"]), "domain")
        .groupBy(F.col("o_orderstatus").alias("domain"), "denom")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "registry_styles", "SRC-05",
    f"""SELECT 'R' || lpad(CAST(n AS VARCHAR), 2, '0') AS reg_code, CASE n WHEN 1 THEN 'article' WHEN 9 THEN 'none' ELSE 'chapter' END AS style, count(c.chunk_id) AS n_chunks
        FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 9]) AS n) LEFT JOIN reg_chunks c ON c.reg_code = 'R' || lpad(CAST(n AS VARCHAR), 2, '0') GROUP BY n""",
)
def registry_styles(x: Inputs) -> DataFrame:
    """The document registry as a table: chunks of each registered code, and a code without any."""
    registry = tables.registry_dim(x.spark, {**P.REGULATIONS, "R09": "none"})
    chunks = x.get("reg_chunks")
    counted = chunks.join(registry, "reg_code").groupBy("reg_code", "style").agg(F.count(F.lit(1)).alias("n_chunks"))
    missing = chunking.missing_documents(chunks, registry)
    return counted.unionByName(missing.select("reg_code", "style", F.lit(0).cast("bigint").alias("n_chunks")))


@query(
    "review_config", "SRC-07",
    " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) FILTER ({P.F01_COLUMNS[c]} IS NULL) AS missing, count(*) AS n FROM f01_x" for c, label in P.F01_REQUIRED),
)
def review_config(x: Inputs) -> DataFrame:
    """The required columns as a table, joined to the rows' columns by name."""
    names = list(P.F01_COLUMNS.values())
    long = layout.f01_rows(x.f01_cells()).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])))
    required = tables.review_dims(x.spark)["required_columns"]
    return long.join(required, "name").groupBy("label").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count(F.lit(1)).alias("n"))


@query(
    "own_weights", "SCR-02 SRC-06",
    """SELECT p_partkey AS bundle_id, 5.0 * coalesce(max(CASE WHEN qid = 'UC-01' AND answer = 'N' THEN 2 END), 0) + 5.0 * coalesce(max(CASE WHEN qid = 'D-03' AND answer = 'Y' THEN 3 END), 0) AS overall
       FROM part LEFT JOIN answers_x a ON a.bundle_id = p_partkey GROUP BY p_partkey""",
)
def own_weights(x: Inputs) -> DataFrame:
    """The questionnaire scored with a caller's questions, denominators and no uplift."""
    bundles = x.table("part").select(F.col("p_partkey").alias(KEY))
    questions = [("UC-01", "N", 2, 0, 0, 0), ("D-03", "Y", 3, 0, 0, 0)]
    answers = layout.f02_wide_answers(x.f02_cells(), ["UC-01", "D-03"])
    scored = scoring.score_columns(bundles.join(answers, KEY, "left"), {d: 20.0 for d in P.DOMAINS}, questions, {})
    return scored.select(KEY, F.round("overall", 9).alias("overall"))


# ---- classification --------------------------------------------------------


_REASON = f"""CASE kind WHEN 'supporting' THEN '非 Excel 檔，視為佐證文件'
            WHEN 'f02' THEN '含 F02 評估表分頁「{P.ASSESS_SHEET}」' WHEN 'f01' THEN '含 F01 主表分頁「{P.F01_SHEET}」' WHEN 'f03' THEN '含 F03 檢核表分頁「{P.F03_SHEET}」'
            ELSE CASE WHEN NOT readable THEN '無法開啟（bad zip）'
                 ELSE 'Excel 但無任何已知表單分頁（分頁：' || CASE WHEN sheet_list = '' THEN '（無分頁）' ELSE array_to_string(list_sort(string_split(sheet_list, '|')), '、') END || '）' END END"""


@query(
    "classify_priority", "CLS-01 CLS-02 CLS-03",
    f"""SELECT bundle_id, file_idx, filename, kind,
          CASE kind WHEN 'f02' THEN '{P.ASSESS_SHEET}' WHEN 'f01' THEN '{P.F01_SHEET}' WHEN 'f03' THEN '{P.F03_SHEET}' END AS matched_sheet,
          {_REASON} AS reason
        FROM kinds_x""",
)
def classify_priority(x: Inputs) -> DataFrame:
    return classify.classify_files(x.files()).select(KEY, "file_idx", "filename", "kind", "matched_sheet", "reason")


EXPECTED["chosen_x"] = """
    SELECT k.bundle_id, k.file_idx, k.filename, coalesce(o.kind, CASE WHEN k.kind = 'unknown' THEN 'ignore' ELSE k.kind END) AS kind
    FROM kinds_x k LEFT JOIN event_overrides o USING (bundle_id, file_idx)"""
EXPECTED["confirmed_x"] = "SELECT * FROM chosen_x WHERE kind <> 'ignore'"


@query("apply_overrides", "CLS-04", "SELECT bundle_id, file_idx, filename, kind FROM confirmed_x")
def apply_overrides(x: Inputs) -> DataFrame:
    chosen = classify.apply_overrides(classify.classify_files(x.files()), x.get("event_overrides"))
    return chosen.select(KEY, "file_idx", "filename", "kind")


@query(
    "route_first_wins", "CLS-05",
    """SELECT k.bundle_id, k.file_idx, k.kind, winner_idx, CASE WHEN file_idx = winner_idx THEN 'winner' WHEN file_idx > winner_idx THEN 'duplicate' END AS role
       FROM kinds_x k LEFT JOIN winners_x w ON w.bundle_id = k.bundle_id AND w.kind = k.kind WHERE k.kind IN ('f01','f02','f03')""",
)
def route_first_wins(x: Inputs) -> DataFrame:
    return classify.route(classify.classify_files(x.files())).select(KEY, "file_idx", "kind", "winner_idx", "role")


@query(
    "duplicate_findings", "CLS-06 CLS-11",
    f"""SELECT k.bundle_id, 'CLASSIFY.DUPLICATE_' || upper(k.kind) AS code, '偵測到多份 ' || {_LABEL.replace('kind', 'k.kind')} AS title,
           f.filename || '、' || k.filename AS actual,
           '有多個檔案判定為 ' || {_LABEL.replace('kind', 'k.kind')} || '（' || f.filename || '、' || k.filename || '）；採用第一份「' || f.filename || '」，請確認「' || k.filename || '」是否誤放或為不同送件。' AS message
       FROM kinds_x k JOIN winners_x w ON w.bundle_id = k.bundle_id AND w.kind = k.kind AND k.file_idx > w.winner_idx
       JOIN event_files f ON f.bundle_id = k.bundle_id AND f.file_idx = w.winner_idx""",
)
def duplicate_findings(x: Inputs) -> DataFrame:
    routed = classify.route(classify.classify_files(x.files()))
    return classify.duplicate_findings(routed).select(KEY, "code", "title", "actual", "message")


@query(
    "unrecognized_findings", "CLS-07",
    "SELECT bundle_id, filename AS location, '檔案「' || filename || '」是 Excel 但不含任何已知表單分頁，未納入審查。請確認是否為官方範本，或應改列為佐證文件。' AS message FROM kinds_x WHERE kind = 'unknown'",
)
def unrecognized_findings(x: Inputs) -> DataFrame:
    return classify.unrecognized_findings(classify.classify_files(x.files())).select(KEY, "location", "message")


@query(
    "classification_summary", "CLS-08",
    f"""SELECT bundle_id, '共 ' || count(*) || ' 個檔案：' || string_agg(filename || ' → ' || {_LABEL}, '；' ORDER BY file_idx) || '。分類依工作表名稱，請人工覆核。' AS message
        FROM kinds_x GROUP BY bundle_id""",
)
def classification_summary(x: Inputs) -> DataFrame:
    return classify.classification_summary(classify.classify_files(x.files())).select(KEY, "message")


@query(
    "preview_flags", "CLS-09",
    """SELECT bundle_id, file_idx, CASE WHEN kind = 'unknown' THEN 'unknown' WHEN kind <> 'supporting' AND row_number() OVER (PARTITION BY bundle_id, kind ORDER BY file_idx) > 1 THEN 'dup' END AS flag FROM kinds_x""",
)
def preview_flags(x: Inputs) -> DataFrame:
    return classify.preview_flags(classify.classify_files(x.files())).select(KEY, "file_idx", "flag")


@query("kind_counts", "CLS-10", "SELECT bundle_id, kind, count(*) AS n FROM chosen_x GROUP BY bundle_id, kind")
def kind_counts(x: Inputs) -> DataFrame:
    return classify.kind_counts(classify.confirmed_kinds(classify.classify_files(x.files()), x.get("event_overrides")))


@query(
    "size_gate", "SRC-02",
    "SELECT n_chars <= 5000 AS accepted, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1",
)
def size_gate(x: Inputs) -> DataFrame:
    docs = x.table("documents").select("doc_id", F.col("n_chars").alias("length"))
    ok, rejected = tables.size_gate(docs, 5000)
    both = ok.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    return both.groupBy("accepted").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"))


@query(
    "file_manifest", "SRC-02",
    "SELECT source, sum(strlen(text) + 1)::BIGINT AS length, true AS accepted FROM documents GROUP BY source",
)
def file_manifest(x: Inputs) -> DataFrame:
    """Documents as text files, a folder for each source: names and lengths, contents not read."""
    path = f"{checkpoint_dir(x.spark)}/files-{uuid.uuid4()}"
    x.table("documents").select("source", "text").write.partitionBy("source").text(path)
    ok, rejected = tables.read_manifest(x.spark, path, max_bytes=1 << 40, glob="*.txt")
    both = ok.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
    folder = F.regexp_extract("path", "source=([^/]+)/", 1)
    return both.groupBy(folder.alias("source"), "accepted").agg(F.sum("length").alias("length"))


# ---- scoring ---------------------------------------------------------------


def _bundles(x: Inputs) -> DataFrame:
    return x.table("part").select(F.col("p_partkey").alias(KEY))


def _answers(x: Inputs) -> DataFrame:
    return layout.f02_answers(x.f02_cells(), QUESTION_IDS)


def _uplift(x: Inputs) -> DataFrame:
    fixed = layout.fixed_cells(x.f02_fixed_cells())
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), layout.norm_answer(F.col(f)).alias("answer")) for f in P.UPLIFT_FACTORS])
    return fixed.select(KEY, F.inline(pairs))


def _long_pct(x: Inputs) -> DataFrame:
    dims = scoring.scoring_dims(x.spark)
    totals = scoring.domain_totals(_bundles(x), scoring.triggered(_answers(x), dims["weights"]))
    return scoring.domain_pct(totals, scoring.uplift_multiplier(_bundles(x), _uplift(x), dims["factors"]), dims["denominators"])


@query(
    "weighted_score_grade", "SCR-01 SCR-02 SCR-03 SCR-04 SCR-05 SCR-06 SCR-07",
    f"SELECT bundle_id, round(overall, 6) AS overall, {_BAND.format('round(overall, 9)')} AS grade FROM scored_x",
)
def weighted_score_grade(x: Inputs) -> DataFrame:
    out = scoring.overall(_long_pct(x))
    # bands compare rounded sums: the engines add doubles in another order
    return out.select(KEY, F.round("overall", 6).alias("overall"), scoring.band(F.round("overall", 9)).alias("grade"))


@query(
    "triggered_answers", "SCR-01",
    "SELECT a.bundle_id, a.qid, a.answer, w.q_seq::BIGINT AS q_seq FROM answers_x a JOIN weights_x w ON w.qid = a.qid AND w.score_on = a.answer",
)
def triggered_answers(x: Inputs) -> DataFrame:
    return rules.triggered_questions(_answers(x), scoring.scoring_dims(x.spark)["weights"]).select(KEY, "qid", "answer", "q_seq")


@query(
    "domain_percentages", "SCR-02 SCR-03 SCR-04",
    " UNION ALL ".join(f"SELECT bundle_id, '{d}' AS domain, round({d}, 6) AS pct FROM scored_x" for d in _DOMAINS),
)
def domain_percentages(x: Inputs) -> DataFrame:
    return _long_pct(x).withColumn("pct", F.round("pct", 6))


@query(
    "wide_scores", "SCR-02 SCR-04 SCR-06 PRJ-19",
    f"""SELECT bundle_id, {', '.join(f'round({d}, 6) AS {d}' for d in _DOMAINS)}, round(overall, 6) AS risk_score FROM scored_x""",
)
def wide_scores(x: Inputs) -> DataFrame:
    out = f02_scored(x.f02_cells(), _bundles(x))
    return out.select(KEY, *[F.round(f"pct_{d}", 6).alias(d) for d in _DOMAINS], F.round("risk_score", 6).alias("risk_score"))


@query(
    "score_tolerance_diff", "SCR-08 RUL-12",
    """SELECT o_orderkey, o_totalprice AS stored, round(s, 6) AS computed FROM orders JOIN
       (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(5, 2))) * (1 + CAST(l_tax AS DECIMAL(5, 2)))) AS DOUBLE) AS s
        FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE abs(s - o_totalprice) > 0.5""",
)
def score_tolerance_diff(x: Inputs) -> DataFrame:
    """Order totals against their lines, summed as exact decimals."""
    stored = x.table("orders").select("o_orderkey", F.col("o_totalprice").alias("value"))

    def exact(c: str, digits: int):
        return F.col(c).cast(f"decimal({digits}, 2)")

    price = exact("l_extendedprice", 12) * (1 - exact("l_discount", 5)) * (1 + exact("l_tax", 5))
    computed = x.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(price).cast("double").alias("value"))
    out = rules.within_tolerance(stored, computed, ["o_orderkey"])
    return out.select("o_orderkey", "stored", F.round("computed", 6).alias("computed"))


# ---- rules -----------------------------------------------------------------


@query(
    "missing_documents", "RUL-01 RUL-02",
    """SELECT c_custkey AS bundle_id, d.code, d.severity FROM customer CROSS JOIN
       (VALUES ('1-URGENT', 'DOC.URGENT', 'error'), ('2-HIGH', 'DOC.HIGH', 'error'), ('5-LOW', 'DOC.LOW', 'warn')) AS d(role, code, severity)
       WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = d.role)""",
)
def missing_documents(x: Inputs) -> DataFrame:
    bundles = x.table("customer").select(F.col("c_custkey").alias(KEY))
    present = x.table("orders").select(F.col("o_custkey").alias(KEY), F.col("o_orderpriority").alias("kind"))
    required = [("1-URGENT", "DOC.URGENT", "urgent", "error"), ("2-HIGH", "DOC.HIGH", "high", "error"), ("5-LOW", "DOC.LOW", "low", "warn")]
    return rules.require_role(bundles, present, required).select(KEY, "code", "severity")


@query(
    "conditional_documents", "RUL-03",
    """SELECT bundle_id, code, message FROM (
       SELECT s.bundle_id, d.code, '本案風險為「' || grade || '」，依規定可能需附「' || d.label || '」；佐證清單未見相關關鍵字（' || d.words || '），請人工確認是否已提供。' AS message,
              NOT EXISTS (SELECT 1 FROM review_files f WHERE f.bundle_id = s.bundle_id AND f.file_idx = 3 AND regexp_matches(lower(f.filename), d.pat)) AS lacking
       FROM (SELECT bundle_id, CASE WHEN round(overall, 9) < 50 THEN '低' WHEN round(overall, 9) < 75 THEN '中' ELSE '高' END AS grade FROM scored_x) s
       CROSS JOIN (VALUES ('DOC.MISSING_R06', 'R06 可解釋性說明', '可解釋, 解釋性, R06', '可解釋|解釋性|r06'),
                          ('DOC.MISSING_R07', 'R07 公平性測試報告/人為監督說明', '公平性, 人為監督, R07', '公平性|人為監督|r07'),
                          ('DOC.MISSING_R05', 'R05 受委託機構技術文件（如涉及委外）', '委外, 委託, R05', '委外|委託|r05')) AS d(code, label, words, pat)
       WHERE grade IN ('中', '高')) WHERE lacking""",
)
def conditional_documents(x: Inputs) -> DataFrame:
    graded = scoring.overall(_long_pct(x)).select(KEY, scoring.band(F.round("overall", 9)).alias("risk_grade"))
    supporting = classify.classify_files(x.files("review_files")).filter(F.col("kind") == "supporting")
    return rules.conditional_document_findings(graded, supporting).select(KEY, "code", "message")


@query(
    "require_any_row", "RUL-04",
    "SELECT p_partkey AS bundle_id, 'F01.NO_DATA_ROW' AS code FROM part WHERE p_partkey NOT IN (SELECT bundle_id FROM f01_x)",
)
def require_any_row(x: Inputs) -> DataFrame:
    return rules.require_any_row(_bundles(x), layout.f01_rows(x.f01_cells())).select(KEY, "code")


_REQUIRED = ", ".join(f"CASE WHEN {P.F01_COLUMNS[c]} IS NULL THEN '{label}' END" for c, label in P.F01_REQUIRED)
EXPECTED["required_x"] = f"SELECT * FROM (SELECT bundle_id, row_index, list_filter([{_REQUIRED}], lambda v: v IS NOT NULL) AS gone FROM f01_x) WHERE len(gone) > 0"


@query(
    "required_fields", "RUL-05",
    """SELECT bundle_id, '主表第 ' || row_index || ' 列必填欄未填：' || array_to_string(gone, ', ') || '。' AS message,
              '缺 ' || len(gone) || ' 欄：' || array_to_string(gone, ', ') AS actual FROM required_x""",
)
def required_fields(x: Inputs) -> DataFrame:
    required = [(P.F01_COLUMNS[c], label) for c, label in P.F01_REQUIRED]
    return rules.require_columns(layout.f01_rows(x.f01_cells()), required).select(KEY, "message", "actual")


def _line_state(x: Inputs) -> DataFrame:
    """Order lines 1..7 as members: returned lines say Y, others N."""
    answers = x.table("lineitem").select(
        F.col("l_suppkey").alias(KEY), F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("member"),
        F.when(F.col("l_returnflag") == "R", "Y").when(F.col("l_returnflag") == "N", "N").alias("answer"),
    )
    sizes = x.table("orders").select(F.col("o_orderkey").alias("group"), (F.col("o_orderkey") % 3 + 1).alias("n"))
    return rules.group_state(answers, sizes)


EXPECTED["line_state_x"] = """
    SELECT k AS bundle_id, g AS "group", answered, yes, n FROM (
      SELECT k, g, count(*) FILTER (a) AS answered, count(*) FILTER (y) AS yes FROM (
        SELECT l_suppkey AS k, l_orderkey AS g, l_linenumber, bool_or(l_returnflag = 'R') AS y, bool_or(l_returnflag IN ('R', 'N')) AS a FROM lineitem GROUP BY ALL) GROUP BY k, g)
    JOIN (SELECT o_orderkey, o_orderkey % 3 + 1 AS n FROM orders) ON o_orderkey = g"""


@query("group_completeness", "RUL-06 RUL-07", 'SELECT bundle_id, "group", n - answered AS missing FROM line_state_x WHERE answered < n')
def group_completeness(x: Inputs) -> DataFrame:
    return rules.complete_group(_line_state(x))


@query("exactly_one", "RUL-08", 'SELECT bundle_id, "group", yes FROM line_state_x WHERE answered = n AND yes <> 1')
def exactly_one(x: Inputs) -> DataFrame:
    return rules.exactly_n(_line_state(x))


@query("at_least_one", "RUL-09", 'SELECT bundle_id, "group", yes FROM line_state_x WHERE answered > 0 AND yes < 1')
def at_least_one(x: Inputs) -> DataFrame:
    return rules.at_least_n(_line_state(x))


def _group_rule(prefix: str, n: int, kind: str) -> str:
    ids = ", ".join(f"'{m}'" for m in rules.members(prefix, n))
    state = f"SELECT bundle_id, count(*) FILTER (answer IS NULL) AS gone, count(*) FILTER (answer = 'Y') AS yes, string_agg(CASE WHEN answer IS NULL THEN qid END, ', ' ORDER BY q_seq) AS gone_ids, string_agg(CASE WHEN answer = 'Y' THEN qid END, ', ' ORDER BY q_seq) AS yes_ids FROM members_x WHERE qid IN ({ids}) GROUP BY bundle_id"
    if kind == "series":
        return f"SELECT bundle_id, 'F02.SERIES_INCOMPLETE' AS code, '{prefix} 應每個子項都填 Y 或 N，未填：' || gone_ids || '。' AS message FROM ({state}) WHERE gone > 0"
    if kind == "single":
        return f"SELECT bundle_id, 'F02.SINGLE_CHOICE' AS code, '{prefix} 為單選題，只能有一個 Y；目前有 ' || yes || ' 個 Y（' || coalesce(yes_ids, '無') || '）。' AS message FROM ({state}) WHERE gone = 0 AND yes <> 1"
    return f"SELECT bundle_id, 'F02.MULTI_CHOICE' AS code, '{prefix} 為複選題，至少需有一個 Y，目前全為 N。' AS message FROM ({state}) WHERE gone < {n} AND yes = 0"


_GENERAL = ", ".join(f"('{q}', {i})" for i, q in enumerate(P.GENERAL_QUESTIONS))
_CHOICE = " UNION ALL ".join(
    [_group_rule(p, n, "series") for p, n in {**P.SINGLE_CHOICE, **P.MULTI_CHOICE}.items()]
    + [_group_rule(p, n, "single") for p, n in P.SINGLE_CHOICE.items()]
    + [_group_rule(p, n, "multi") for p, n in P.MULTI_CHOICE.items()]
    + [
        f"""SELECT bundle_id, 'F02.GENERAL_INCOMPLETE' AS code, '一般題應每題皆填 Y 或 N，未填：' || string_agg(qid, ', ' ORDER BY i) || '。留空會導致風險分數被低估。' AS message
            FROM members_x JOIN (VALUES {_GENERAL}) AS g(qid, i) USING (qid) WHERE answer IS NULL GROUP BY bundle_id"""
    ]
)
EXPECTED["graded_x"] = """SELECT bundle_id, n1, n2, n3, n4, cached_grade, filing_unit, finance, operation, reputation, compliance, overall, residual_filled, residual_max_score,
       treatment_filled OR filing_unit IS NOT NULL AS treatment_filled, """ + _BAND.format("round(overall, 9)") + """ AS grade
    FROM forms_x JOIN scored_x USING (bundle_id) JOIN f02_state USING (bundle_id)"""
EXPECTED["choice_x"] = _CHOICE
_OK4 = "n1 IS NOT NULL AND n2 IS NOT NULL AND n3 IS NOT NULL AND n4 IS NOT NULL"
EXPECTED["score_rules_x"] = " UNION ALL ".join(
    [
        "SELECT bundle_id, 'F02.CACHE_MISSING' AS code, '分級' AS location FROM graded_x WHERE cached_grade IS NULL",
        "SELECT bundle_id, 'F02.GRADE_MISMATCH', '分級' FROM graded_x WHERE cached_grade <> grade",
    ]
    + [
        f"SELECT bundle_id, 'F02.SCORE_MISMATCH', '{P.DOMAIN_LABELS[d]}域百分比' FROM graded_x WHERE cached_grade IS NOT NULL AND {_OK4} AND abs({d} - n{i + 1}) > 0.5"
        for i, d in enumerate(_DOMAINS)
    ]
)
EXPECTED["follow_x"] = """
    SELECT bundle_id, code FROM (SELECT bundle_id, CASE WHEN NOT residual_filled THEN 'F02.RESIDUAL_MISSING' WHEN residual_max_score IS NULL THEN 'F02.RESIDUAL_SCORE_MISSING'
      WHEN residual_max_score >= 6 AND NOT treatment_filled THEN 'F02.TREATMENT_MISSING' END AS code FROM graded_x WHERE grade IN ('中', '高')) WHERE code IS NOT NULL"""


def _f02_scored(x: Inputs) -> DataFrame:
    return f02_scored(x.f02_cells(), _bundles(x)).withColumn("grade", scoring.band(F.round("overall", 9)))


@query("choice_rules", "RUL-06 RUL-07 RUL-08 RUL-09", "SELECT * FROM choice_x")
def choice_rules(x: Inputs) -> DataFrame:
    answers = _bundles(x).join(layout.f02_wide_answers(x.f02_cells(), QUESTION_IDS), KEY, "left")
    return emit(answers, *rules.choice_findings()).select(KEY, "code", "message")


@query("stored_score_rules", "RUL-10 RUL-11 RUL-12", "SELECT * FROM score_rules_x")
def stored_score_rules(x: Inputs) -> DataFrame:
    return emit(_f02_scored(x), *rules.score_findings()).select(KEY, "code", "location")


@query("follow_up_chain", "RUL-13 RUL-14 RUL-15", "SELECT * FROM follow_x")
def follow_up_chain(x: Inputs) -> DataFrame:
    return emit(_f02_scored(x), *rules.follow_up_findings()).select(KEY, "code")


EXPECTED["evidence_x"] = """
    SELECT bundle_id, 'F03.EVIDENCE_MISSING_PROPOSAL' AS code, '項次 ' || item_id || coalesce('（' || topic || '）', '') AS location, row_index FROM items_x WHERE check_state = '是' AND evidence_proposal IS NULL
    UNION ALL SELECT bundle_id, 'F03.EVIDENCE_MISSING_GOLIVE', '項次 ' || item_id || coalesce('（' || topic || '）', ''), row_index FROM items_x WHERE check_state = '是' AND evidence_golive IS NULL"""


@query("evidence_presence", "RUL-16 RUL-17", "SELECT bundle_id, code, location FROM evidence_x")
def evidence_presence(x: Inputs) -> DataFrame:
    return rules.evidence_presence(layout.f03_items(x.f03_cells())).select(KEY, "code", "location")


@query(
    "sets_overlap", "RUL-18",
    """SELECT n_regionkey::BIGINT AS bundle_id FROM nation GROUP BY n_regionkey HAVING count(*) > 0
       AND EXISTS (SELECT 1 FROM customer JOIN nation n ON n.n_nationkey = c_nationkey WHERE n.n_regionkey = nation.n_regionkey)
       AND EXISTS (SELECT 1 FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey WHERE n.n_regionkey = nation.n_regionkey)
       AND NOT EXISTS (SELECT 1 FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN supplier ON s_nationkey = c_nationkey
                       WHERE n.n_regionkey = nation.n_regionkey AND round(s_acctbal) = round(c_acctbal))""",
)
def sets_overlap(x: Inputs) -> DataFrame:
    """Regions where no customer and supplier of a nation have equal balances."""
    nation = x.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias(KEY))

    def side(name: str, p: str) -> DataFrame:
        t = x.table(name).select(F.col(f"{p}_nationkey").alias("k"), F.round(f"{p}_acctbal").alias("b"))
        return t.join(nation, "k").select(KEY, X.fill(" N{k} : {b}", k=F.col("k"), b=F.col("b")).alias("value"))

    return rules.sets_overlap(side("customer", "c"), side("supplier", "s"))


EXPECTED["owner_x"] = """
    SELECT f.bundle_id, o.v AS actual FROM (SELECT bundle_id, list(DISTINCT lower(replace(system_owner, ' ', ''))) AS vs FROM f01_x WHERE system_owner IS NOT NULL GROUP BY bundle_id) f
    JOIN (SELECT bundle_id, trim(owner) AS v FROM f03_owner WHERE owner <> 'xxx') o USING (bundle_id) WHERE NOT list_contains(vs, lower(replace(o.v, ' ', '')))"""
EXPECTED["unit_x"] = """
    SELECT f.bundle_id, o.filing_unit AS actual FROM (SELECT bundle_id, list(DISTINCT lower(replace(filing_unit, ' ', ''))) AS vs FROM f01_x WHERE filing_unit IS NOT NULL GROUP BY bundle_id) f
    JOIN (SELECT bundle_id, filing_unit FROM forms_x WHERE filing_unit IS NOT NULL) o USING (bundle_id) WHERE NOT list_contains(vs, lower(replace(o.filing_unit, ' ', '')))"""


@query(
    "owner_and_unit", "RUL-18",
    f"""SELECT x.bundle_id, 'CROSS.OWNER_MISMATCH' AS code, string_agg(system_owner, '、' ORDER BY row_index) AS expected, any_value(actual) AS actual
        FROM owner_x x JOIN f01_x f ON f.bundle_id = x.bundle_id AND system_owner IS NOT NULL GROUP BY x.bundle_id
        UNION ALL
        SELECT x.bundle_id, 'CROSS.UNIT_MISMATCH', string_agg(filing_unit, '、' ORDER BY row_index), any_value(actual)
        FROM unit_x x JOIN f01_x f ON f.bundle_id = x.bundle_id AND filing_unit IS NOT NULL GROUP BY x.bundle_id""",
)
def owner_and_unit(x: Inputs) -> DataFrame:
    rows = materialise(layout.f01_rows(x.f01_cells()))
    identity = layout.f03_identity(x.f03_cells(), x.get("f03_owner"))
    fixed = layout.fixed_cells(x.f02_fixed_cells())
    owner = rules.comparison_findings(
        rows.select(KEY, "row_index", F.col("system_owner").alias("value")), identity.select(KEY, F.col("system_owner").alias("value")),
        "CROSS.OWNER_MISMATCH", P.OWNER_COMPARISON, 0,
    )
    unit = rules.comparison_findings(
        rows.select(KEY, "row_index", F.col("filing_unit").alias("value")), fixed.select(KEY, F.col("filing_unit").alias("value")),
        "CROSS.UNIT_MISMATCH", P.UNIT_COMPARISON, 1,
    )
    return owner.unionByName(unit).select(KEY, "code", "expected", "actual")


EXPECTED["unresolved_x"] = f"""
    SELECT s.bundle_id, s.sheet, s.row_index, s.corr_project_name FROM subs_x s
    JOIN (SELECT bundle_id, list(lower(replace(project_name, ' ', ''))) AS names FROM f01_x WHERE project_name IS NOT NULL GROUP BY bundle_id) n USING (bundle_id)
    WHERE NOT list_contains(names, lower(replace(replace(s.corr_project_name, ' ', ''), '{WIDE}', '')))"""


@query(
    "references_resolve", "RUL-19",
    """SELECT u.bundle_id, '主表 / ' || u.sheet || '第' || u.row_index || '列' AS location, names AS expected, corr_project_name AS actual
       FROM unresolved_x u JOIN (SELECT bundle_id, string_agg(project_name, '、' ORDER BY r) AS names FROM
         (SELECT bundle_id, project_name, min(row_index) AS r FROM f01_x WHERE project_name IS NOT NULL GROUP BY ALL) GROUP BY bundle_id) USING (bundle_id)""",
)
def references_resolve(x: Inputs) -> DataFrame:
    cells = x.f01_cells()
    rows = materialise(layout.f01_rows(cells))  # as in a review, where several rules read them
    found = rules.internal_name_findings(layout.f01_sub_refs(cells), rows)
    return found.select(KEY, "location", "expected", "actual")




def _question_sections(x: Inputs) -> DataFrame:
    """Sections of each question id that occurs: one or two, or none."""
    seq = F.array_position(F.array(*[F.lit(q) for q in QUESTION_IDS]), F.col("qid")).cast("int") - 1
    seen = x.get("f02_lines").select("qid").distinct().withColumn("q", seq).filter(F.col("q") % 3 > 0)
    return seen.select("qid", F.explode(F.sequence(F.lit(1), F.col("q") % 3)).alias("pos"), "q").select(
        "qid", "pos", F.lit("R03").alias("reg_code"), X.fill("五/(二)/{p}", p=F.col("pos")).alias("section_path"),
        F.when(F.col("q") % 2 == 0, X.fill("T{q}", q=F.col("q"))).otherwise("").alias("title"),
    )


EXPECTED["cited_x"] = """
    SELECT qid, q_seq, q_seq % 3 AS cited, 'R03 五、(二) 1' || t || CASE WHEN q_seq % 3 = 2 THEN '、R03 五、(二) 2' || t ELSE '' END AS refs
    FROM (SELECT *, CASE WHEN q_seq % 2 = 0 THEN '（T' || q_seq || '）' ELSE '' END AS t FROM weights_x WHERE q_seq % 3 > 0)"""


@query(
    "regulation_notes", "RUL-20",
    """SELECT a.bundle_id, a.qid AS location, 'F02 風險題 ' || a.qid || ' 答案為「' || a.answer || '」（觸發風險評分），對應法規條文引用：' || c.refs || '。請確認相關法規要求已納入管控措施，送治理人員人工覆核。' AS message
       FROM answers_x a JOIN weights_x w ON w.qid = a.qid AND w.score_on = a.answer JOIN cited_x c ON c.qid = a.qid""",
)
def regulation_notes(x: Inputs) -> DataFrame:
    hits = rules.triggered_questions(_answers(x), scoring.scoring_dims(x.spark)["weights"])
    return rules.triggered_refs(hits, _question_sections(x)).select(KEY, "location", "message")


@query(
    "regulation_summary", "RUL-21",
    """SELECT p.p_partkey AS bundle_id, 'F02 法規查表：觸發題 ' || count(w.qid) || ' 道，共引用 ' || coalesce(sum(c.cited), 0)::BIGINT || ' 條條文；僅供初步參考，請人工覆核。' AS message
       FROM part p LEFT JOIN answers_x a ON a.bundle_id = p.p_partkey LEFT JOIN weights_x w ON w.qid = a.qid AND w.score_on = a.answer LEFT JOIN cited_x c ON c.qid = w.qid GROUP BY p.p_partkey""",
)
def regulation_summary(x: Inputs) -> DataFrame:
    hits = rules.triggered_questions(_answers(x), scoring.scoring_dims(x.spark)["weights"])
    return rules.triggered_refs_summary(_bundles(x), hits, _question_sections(x)).select(KEY, "message")




@query(
    "parse_errors", "PRJ-20 RUL-22",
    f"""SELECT bundle_id, upper(kind) || '.PARSE_ERROR' AS code, upper(kind) || ' 檔案無法解析（' || why || '）。請確認檔案為官方範本且未損毀。' AS message FROM (
          SELECT bundle_id, kind, CASE WHEN NOT readable THEN 'bad zip'
             WHEN kind = 'f01' AND sheet_list NOT LIKE '%{P.F01_SHEET}%' THEN '''Worksheet {P.F01_SHEET} does not exist.'''
             WHEN kind = 'f02' AND sheet_list NOT LIKE '%{P.ASSESS_SHEET}%' THEN '''Worksheet {P.ASSESS_SHEET} does not exist.'''
             WHEN kind = 'f02' THEN 'Worksheet named ''{P.RESIDUAL_SHEET}'' not found' END AS why
          FROM (SELECT f.*, c.kind FROM confirmed_x c JOIN event_files f USING (bundle_id, file_idx))
          WHERE kind IN ('f01', 'f02', 'f03')) WHERE why IS NOT NULL""",
)
def parse_errors(x: Inputs) -> DataFrame:
    """Every confirmed form file, duplicates too, checked for its sheets."""
    chosen = classify.apply_overrides(classify.classify_files(x.files()), x.get("event_overrides"))
    forms = chosen.filter(F.col("kind").isin("f01", "f02", "f03"))
    found = rules.parse_error_findings(forms)
    return found.filter(F.col("code") != "F03.CHECKLIST_PARSE_ERROR").select(KEY, "code", "message")


@query(
    "all_clear", "RUL-23",
    """SELECT p_partkey AS bundle_id, 'none' AS mode FROM part WHERE p_partkey NOT IN (SELECT bundle_id FROM choice_x UNION ALL SELECT bundle_id FROM follow_x)
       UNION ALL SELECT c_custkey, 'no_problem' FROM customer WHERE c_custkey NOT IN (SELECT bundle_id FROM evidence_x WHERE code = 'F03.EVIDENCE_MISSING_PROPOSAL')""",
)
def all_clear(x: Inputs) -> DataFrame:
    found = emit(_f02_scored(x), *rules.choice_findings(), *rules.follow_up_findings())
    none = rules.all_clear(_bundles(x), found, "none", "F02.OK").select(KEY, F.lit("none").alias("mode"))
    customers = x.table("customer").select(F.col("c_custkey").alias(KEY))
    evidence = rules.evidence_presence(layout.f03_items(x.f03_cells()))
    problem = rules.all_clear(customers, evidence, "no_problem").select(KEY, F.lit("no_problem").alias("mode"))
    return none.unionByName(problem)


@query(
    "registered_check", "RUL-24",
    "SELECT p_partkey AS bundle_id, 'MY.CHECK' AS code, p_brand AS location FROM part WHERE p_retailprice > 950",
)
def registered_check(x: Inputs) -> DataFrame:
    """A user's own check through the registry."""
    from sheaf.functions.findings import emit, finding

    def check(t: dict[str, DataFrame]) -> DataFrame:
        dear = t["parts"].filter(F.col("p_retailprice") > 950).withColumnRenamed("p_partkey", KEY)
        return emit(dear, finding("CLASSIFY.UNRECOGNIZED", "cross", 9, code="MY.CHECK", filename=F.col("p_brand"), reason=F.lit("")))

    rules.register_check("dear_parts", "cross", check)
    try:
        return rules.registered_findings({"parts": x.table("part")})[-1].select(KEY, "code", "location")
    finally:
        rules.unregister_check("dear_parts")


