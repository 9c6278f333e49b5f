"""Review inputs derived from the given tables.

Each entry is one SELECT that both Spark SQL and the comparison engine read
the same way.  They map the tables to bundles, forms, files and texts, and
cover every row of their source: parts, customers, users and conversations
are bundles; order lines are questionnaire rows; orders are system rows;
events are files; conversation turns are checklist items.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import presets as P

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


_LARGE = {"lineitem", "orders", "documents", "events"}
# tables of which a row becomes a dozen cells, and the rows of them that one task takes
_CELLED, CELLED_ROWS = {"orders", "part"}, 50_000
# inputs whose long texts most queries only look at where they are read: splits for half of the cores will do, as spreading shuffles all texts
_NARROWED = {"judge_items"}


def _case(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _n(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_DIGITS = "一二三四五六七八九十"
_QIDS = [q[0] for q in P.QUESTIONS]

INPUTS: dict[str, str] = {
    # ---- questionnaire: one grid row per order line of a part ----
    "f02_lines": f"""
        SELECT bundle_id, row, {_case("q", _QIDS)} AS qid, {_case("a", ["  ", "N", "否", "n", " 是　", "Y"])} AS raw FROM (
          SELECT l_partkey AS bundle_id, l_orderkey * 10 + l_linenumber AS row, max((l_orderkey + l_suppkey) % 29) AS q,
                 max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 5 WHEN l_returnflag = 'R' THEN 4
                          WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 3 WHEN l_returnflag = 'N' THEN 2
                          WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS a
          FROM lineitem GROUP BY l_partkey, l_orderkey * 10 + l_linenumber)""",
    # fixed cells and follow-up sheets: one part each, as cell texts
    "f02_fixed": f"""
        SELECT p_partkey AS bundle_id,
               CASE WHEN p_size % 3 = 0 THEN '是' ELSE 'N' END AS factor1,
               CASE WHEN p_size % 4 = 0 THEN 'y' ELSE '' END AS factor2,
               CASE WHEN p_size % 5 = 0 THEN 'Y' ELSE '無' END AS factor3,
               {_n("p_partkey % 100")} AS finance,
               {_n("p_partkey % 90")} || '.5' AS operation,
               CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE {_n("p_partkey % 80")} END AS reputation,
               ' ' || {_n("p_partkey % 70")} AS compliance,
               {_n("p_partkey % 100")} AS overall,
               {_case("p_size % 4", ["", "低", "中", "高"])} AS grade,
               CASE WHEN p_size % 6 = 0 THEN '  ' ELSE 'unit' || {_n("p_partkey % 8")} END AS filing_unit,
               CASE WHEN p_size % 16 = 0 THEN 'N/A' WHEN p_size % 8 = 0 THEN 'none' WHEN p_size % 2 = 0 THEN {_n("p_size % 11")} END AS residual_a,
               CASE WHEN p_size % 16 = 0 THEN 'NA' WHEN p_size % 8 = 4 THEN ' nan ' WHEN p_size % 8 = 2 THEN '9d' WHEN p_size % 8 = 6 THEN 'x' END AS residual_b,
               CASE WHEN p_size % 3 = 1 THEN '處理' END AS treatment
        FROM part""",
    # stored scores and follow-up state as typed columns
    "f02_state": """
        SELECT p_partkey AS bundle_id, p_size % 2 = 0 AND p_size % 16 <> 0 AS residual_filled,
               CASE WHEN p_size % 2 = 0 AND p_size % 8 <> 0 THEN CAST(p_size % 11 AS DOUBLE) END AS residual_max_score,
               p_size % 3 = 1 AS treatment_filled
        FROM part""",
    # ---- system rows: one grid row per order of a customer ----
    "f01_wide": f"""
        SELECT o_custkey AS bundle_id, o_orderkey + 4 AS row,
               CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 11 <> 0 THEN 'Unit ' || {_n("o_custkey % 7")} END AS c_a,
               CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS c_b,
               CASE WHEN o_orderkey % 17 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE '　' END AS c_c,
               CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 13 <> 0 THEN 'Project ' || {_n("o_custkey % 50")} END AS c_d,
               CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END AS c_e,
               CASE WHEN o_orderkey % 17 <> 0 THEN 'Sys ' || {_n("o_orderkey % 100")} END AS c_f,
               CASE WHEN o_orderkey % 17 <> 0 THEN '  C' || {_n("o_orderkey % 100")} || '　' END AS c_g,
               CASE WHEN o_orderkey % 17 <> 0 THEN 'Owner ' || {_n("(o_custkey + o_orderkey % 2) % 9")} END AS c_h,
               CASE WHEN o_orderkey % 17 <> 0 AND o_orderstatus <> 'P' THEN 'AP' END AS c_i,
               CASE WHEN o_orderkey % 17 <> 0 THEN o_orderpriority END AS c_j,
               CASE WHEN o_orderkey % 17 <> 0 THEN 'goal' END AS c_k,
               CASE WHEN o_orderkey % 34 = 1 THEN 'LLM' END AS c_l
        FROM orders""",
    "f01_subs": f"""
        SELECT o_custkey AS bundle_id, o_orderkey + 3 AS row,
               CASE o_orderstatus WHEN 'F' THEN '資料' WHEN 'O' THEN '模型' ELSE '平台' END AS sheet,
               CASE o_orderstatus WHEN 'F' THEN 'AB' WHEN 'O' THEN 'R' ELSE 'I' END AS col,
               CASE WHEN o_orderkey % 10 = 0 THEN 'xxx小幫手(對應前頁填寫)'
                    WHEN o_orderkey % 10 = 1 THEN ' '
                    ELSE 'PROJECT　' || {_n("(o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) % 50")} END AS value
        FROM orders""",
    # ---- checklist: one grid row per conversation turn ----
    "f03_wide": f"""
        SELECT conv_id AS bundle_id, turn + 5 AS row,
               CASE WHEN role = 'system' THEN '備註'
                    ELSE {_n("CAST(floor(turn / 4) AS BIGINT) + 1")} || '-' || {_n("turn % 4 + 1")} END AS item_id,
               CASE WHEN turn % 3 = 0 THEN 'Phase ' || {_n("turn")} END AS lifecycle,
               CASE WHEN turn % 6 <> 5 THEN role END AS topic,
               role || ' check' AS description,
               CASE WHEN length(text) % 3 = 0 THEN 'V' ELSE 'FALSE' END AS mark_yes,
               CASE WHEN length(text) % 3 = 1 THEN 'x' ELSE '0' END AS mark_no,
               CASE WHEN length(text) % 7 = 0 THEN 'v' END AS mark_na,
               CASE WHEN length(text) % 5 = 0 THEN ' ' ELSE text END AS evidence_proposal,
               CASE WHEN length(text) % 4 = 0 THEN text END AS evidence_golive,
               'R03/五/(二)/' || {_n("turn")} AS regulation_ref_raw
        FROM conversations""",
    "f03_owner": f"""
        SELECT conv_id AS bundle_id, min(CASE WHEN conv_id % 5 = 0 THEN 'xxx' ELSE ' owner' || {_n("conv_id * 2 % 9")} END) AS owner
        FROM conversations GROUP BY conv_id""",
    # ---- files: one per event of a user ----
    "event_files": f"""
        SELECT user_id AS bundle_id, event_id AS file_idx,
               CASE WHEN event_id % 23 <> 0 THEN {_n("event_id")} END AS file_id,
               event_type || '_' || {_n("event_id")} ||
               CASE event_type WHEN 'view' THEN '.xlsx' WHEN 'click' THEN '.v2.XLSM' WHEN 'purchase' THEN '.pdf'
                    WHEN 'signup' THEN '.xltx' ELSE '' END AS filename,
               {_case("event_id % 6", [f"{P.ASSESS_SHEET}|other", P.F01_SHEET, f"{P.F03_SHEET}|{P.F01_SHEET}", "Z|A|M", "", f"x|{P.F03_SHEET}"])} AS sheet_list,
               event_id % 19 <> 0 AS readable,
               CASE WHEN event_id % 19 = 0 THEN 'bad zip' END AS error
        FROM events""",
    "event_overrides": """
        SELECT user_id AS bundle_id, event_id AS file_idx,
               CASE event_id % 3 WHEN 0 THEN 'ignore' WHEN 1 THEN 'f02' ELSE 'supporting' END AS kind
        FROM events WHERE event_type = 'view'""",
    # ---- all files of a review: forms by presence, documents as supporting ----
    "review_files": f"""
        SELECT p_partkey AS bundle_id, CAST(1 AS BIGINT) AS file_idx, 'q' || {_n("p_partkey")} AS file_id,
               'f02_' || {_n("p_partkey")} || '.xlsm' AS filename,
               '{P.ASSESS_SHEET}|{P.RESIDUAL_SHEET}|{P.TREATMENT_SHEET}' AS sheet_list
        FROM part WHERE p_size <> 50
        UNION ALL
        SELECT o_custkey, CAST(0 AS BIGINT), 's' || {_n("o_custkey")}, 'f01_' || {_n("o_custkey")} || '.xlsx', '{P.F01_SHEET}|資料|模型|平台'
        FROM orders GROUP BY o_custkey
        UNION ALL
        SELECT conv_id, CAST(2 AS BIGINT), 'c' || {_n("conv_id")}, 'f03_' || {_n("conv_id")} || '.xlsx', '{P.F03_SHEET}'
        FROM conversations GROUP BY conv_id
        UNION ALL
        SELECT doc_id, CAST(3 AS BIGINT), 'd' || {_n("doc_id")},
               {_case("doc_id % 4", ["可解釋性", "r07 report ", "委託 ", "notes "])} || source || '.' || lang, ''
        FROM documents""",
    # ---- items a judge reads: documents, 25 to a bundle, with their labels ----
    "judge_items": f"""
        SELECT 'b' || {_n("CAST(floor(doc_id / 25) AS BIGINT)")} AS bundle_id, source, doc_id AS row_index, {_n("CAST(floor(doc_id / 10) AS BIGINT) + 1")} || '-' || {_n("doc_id % 10 + 1")} AS item_id,
               CASE WHEN doc_id % 7 <> 0 THEN lang END AS topic, 'desc ' || lang AS description,
               CASE WHEN n_chars % 5 <> 0 THEN text END AS evidence_proposal, CASE WHEN n_chars % 3 = 0 THEN text END AS evidence_golive,
               'R03/五/' || lang AS regulation_ref_raw
        FROM documents""",
    "judge_labels": "SELECT doc_id AS row_index, quality = 0 AS weak, toxic = 1 AS differs FROM labels",
    # answers of all shapes: plain, fenced, a list, prose, another object, cut off
    "answer_texts": f"""
        SELECT event_id, CASE event_id % 6
          WHEN 0 THEN ' {{"results":[{{"item_id":"a","p":' || props || '}}]}} '
          WHEN 1 THEN 'Here: ```json {{"results":[{{"item_id":"a"}},{{"item_id":' || {_n("event_id")} || '}}]}} ``` done }}'
          WHEN 2 THEN '[{{"results":[' || props || ']}}]'
          WHEN 3 THEN event_type || ' without json'
          WHEN 4 THEN '{{"results":"' || event_type || '"}}'
          ELSE '{{"results":[{{"item_id":"a"' END AS answer
        FROM events""",
    # ---- regulation items and sections ----
    "ref_texts": f"""
        SELECT page_id AS item_id,
               CASE page_id % 8
                 WHEN 0 THEN 'R0' || {_n("page_id % 7 + 1")} || '/' || {_n("page_id % 5 + 1")}
                 WHEN 1 THEN 'R0' || {_n("page_id % 7 + 1")} || '&R0' || {_n("page_id % 3 + 1")} || '/' || {_n("page_id % 5 + 1")} || '/(' || {_n("page_id % 3")} || ')'
                 WHEN 2 THEN 'R0' || {_n("page_id % 7 + 1")} || ' / ' || {_n("page_id % 5 + 1")} || ';R0' || {_n("page_id % 6 + 1")}
                 WHEN 3 THEN 'Ｒ０' || {_n("page_id % 7 + 1")} || '／' || {_n("page_id % 5 + 1")} || '／（' || {_n("page_id % 3")} || '）/1'
                 WHEN 4 THEN url
                 WHEN 5 THEN 'R0' || {_n("page_id % 7 + 1")} || '（' || url || '）'
                 WHEN 6 THEN url || ';R0' || {_n("page_id % 7 + 1")} || '、R0' || {_n("page_id % 4 + 1")} || '/' || {_n("page_id % 5 + 1")}
               END AS raw
        FROM pages""",
    "reg_chunks": f"""
        SELECT vec_id AS chunk_id, 'R0' || {_n("label % 7 + 1")} AS reg_code,
               {_n("vec_id % 5 + 1")} || CASE WHEN vec_id % 3 > 0 THEN '/(' || {_n("vec_id % 3")} || ')' ELSE '' END
               || CASE WHEN vec_id % 3 > 0 AND vec_id % 4 > 0 THEN '/' || {_n("vec_id % 4")} ELSE '' END AS section_path,
               'Title ' || {_n("label")} AS title, 'Section text ' || {_n("vec_id")} AS text, vec_id AS "order"
        FROM embeddings""",
}


def _needed(sql: str, known: dict[str, str]) -> list[str]:
    """Names of entries a text uses, each after the ones it builds on."""
    out: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)):
            if word in known and word not in out:
                visit(known[word])
                if word not in out:
                    out.append(word)

    visit(sql)
    return out


def with_inputs(sql: str, more: dict[str, str] | None = None) -> str:
    """The query with the common table expressions it uses in front."""
    known = {**INPUTS, **(more or {})}
    names = _needed(sql, known)
    head = ",\n".join(f"{n} AS ({known[n]})" for n in names)
    if not head:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{sql.lstrip()[len('WITH RECURSIVE'):]}"
    if sql.lstrip().upper().startswith("WITH"):
        return f"WITH {head},\n{sql.lstrip()[len('WITH'):]}"
    return f"WITH {head}\n{sql}"


class Inputs:
    """The given tables of one folder, and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str, enough: int | None = None) -> DataFrame:
        """A given table, spread over the cores if it has fewer splits than those, or than ``enough``."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        # one small file is one split: spread it, so that not one core does all
        # the work; a table of many splits is read as it is
        wanted = cores if name in _LARGE and len(df.inputFiles()) < cores else 0
        # rows that become many cells are sorted as cells where they are read, so their number per task is bounded
        if name in _CELLED:
            wanted = max(wanted, -(-df.count() // CELLED_ROWS))
        return df.repartition(wanted) if wanted and df.rdd.getNumPartitions() < (wanted if enough is None else enough) else df

    def celled_tasks(self, name: str) -> int:
        """Tasks that keep the cells of a table at those of CELLED_ROWS rows each."""
        return -(-self.spark.read.parquet(f"{self.dir}/{name}.parquet").count() // CELLED_ROWS)

    def get(self, name: str) -> DataFrame:
        half = -(-self.spark.sparkContext.defaultParallelism // 2)
        for t in _needed(with_inputs(INPUTS[name]), {t: "" for t in TABLES}):
            self.table(t, half if name in _NARROWED else None).createOrReplaceTempView(t)
        return self.spark.sql(with_inputs(INPUTS[name]).replace('"order"', "`order`"))

    # ---- grids ----

    def grid(self, wide: DataFrame, sheet: str, letters: dict[str, str], row=None, keys=("bundle_id",)) -> DataFrame:
        """Cells of one sheet out of columns: one pass over the source."""
        row = F.col("row") if row is None else F.lit(row)
        pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(name).cast("string").alias("value")) for c, name in letters.items()])
        return wide.select(*keys, F.lit(sheet).alias("sheet"), row.cast("bigint").alias("row"), F.inline(pairs)).filter(
            F.col("value").isNotNull()
        )

    def f01_cells(self) -> DataFrame:
        letters = {c: f"c_{c.lower()}" for c in P.F01_COLUMNS}
        subs = self.get("f01_subs").select("bundle_id", "sheet", F.col("row").cast("bigint"), "col", "value")
        return self.grid(self.get("f01_wide"), P.F01_SHEET, letters).unionByName(subs)

    def f02_cells(self) -> DataFrame:
        cells = self.grid(self.get("f02_lines"), P.ASSESS_SHEET, {"A": "qid", "C": "raw"})
        # the question rows of the derived grid start far below the fixed cells
        cells = cells.withColumn("row", F.col("row") + 1000)
        return cells.unionByName(self.f02_fixed_cells())

    def f02_fixed_cells(self) -> DataFrame:
        fixed = self.get("f02_fixed")
        spots = F.array(
            *[
                F.struct(F.lit(s).alias("sheet"), F.lit(r).cast("bigint").alias("row"), F.lit(c).alias("col"), F.col(n).alias("value"))
                for n, s, r, c in P.F02_FIXED_CELLS
            ],
            *[
                F.struct(F.lit(s).alias("sheet"), F.lit(r).cast("bigint").alias("row"), F.lit(c).alias("col"), v.alias("value"))
                for s, r, c, v in [
                    (P.RESIDUAL_SHEET, 1, "A", F.lit("編號")),
                    (P.RESIDUAL_SHEET, 1, "D", F.lit("剩餘風險　評鑑分數\n")),
                    (P.RESIDUAL_SHEET, 2, "D", F.col("residual_a")),
                    (P.RESIDUAL_SHEET, 3, "D", F.col("residual_b")),
                    (P.TREATMENT_SHEET, 1, "N", F.lit("*填表單位")),
                    (P.TREATMENT_SHEET, 3, "A", F.col("treatment")),
                ]
            ],
        )
        return fixed.select("bundle_id", F.inline(spots)).filter(F.col("value").isNotNull())

    def f03_cells(self) -> DataFrame:
        letters = {c: n for c, n in P.F03_COLUMNS.items()}
        owner = self.grid(self.get("f03_owner"), P.F03_SHEET, {"B": "owner"}, row=1)
        return self.grid(self.get("f03_wide"), P.F03_SHEET, letters).unionByName(owner)

    def cells(self) -> DataFrame:
        """All form cells with the file they belong to."""

        def of(cells: DataFrame, mark: str) -> DataFrame:
            return cells.withColumn("file_id", F.concat(F.lit(mark), F.col("bundle_id").cast("string")))

        return of(self.f01_cells(), "s").unionByName(of(self.f02_cells(), "q")).unionByName(of(self.f03_cells(), "c"))

    # ---- files ----

    def files(self, name: str = "event_files") -> DataFrame:
        sheets = F.filter(F.split("sheet_list", r"\|"), lambda s: s != "")
        out = self.get(name).withColumn("sheets", sheets).drop("sheet_list")
        if "readable" not in out.columns:
            out = out.withColumn("readable", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
        return out

    # ---- texts ----

    def page_lines(self) -> DataFrame:
        """Sources as documents, documents as pages."""
        docs = self.table("documents")
        return docs.select(
            F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
        )

    def page_docs(self) -> DataFrame:
        return self.table("documents").groupBy(F.col("source").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_pages"))

    def headed_lines(self) -> DataFrame:
        """The page lines with outline headings by position."""
        one = F.substr(F.lit(_DIGITS), (F.col("page_no") % 10 + 1).cast("int"), F.lit(1))
        two = F.substr(F.lit(_DIGITS), (F.col("line_no") % 7 + 1).cast("int"), F.lit(1))
        line = (
            F.when(F.col("line_no") == 0, F.concat(one, F.lit("、"), F.col("line")))
            .when(F.col("line_no") % 9 == 4, F.concat(F.lit("（"), two, F.lit("）"), F.col("line")))
            .when(F.col("line_no") % 4 == 2, F.concat(F.col("line_no").cast("string"), F.lit(". "), F.col("line")))
            .otherwise(F.col("line"))
        )
        return self.page_lines().withColumn("line", line)

    def outline_lines(self) -> DataFrame:
        """All headed lines of a source in one stream."""
        return self.headed_lines().select("doc_id", (F.col("page_no") * 100000 + F.col("line_no")).alias("line_no"), "line")
