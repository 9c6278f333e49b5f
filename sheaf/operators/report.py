"""Findings -> ordered reports (REP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.operators import rules, scan

KEY = "bundle_id"
ORDER = ["severity_rank", "stage_seq", "rule_seq", "row_seq"]
SHOWN = ["severity", "code", "title", "message", "location", "expected", "actual", "source"]


def union_findings(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_findings(findings: DataFrame, start: int = 0, out: str = "seq") -> DataFrame:
    """Position of each finding in its bundle's report.

    By severity, then by the order the checks ran in.  The order columns are
    cut into blocks, so a bundle with very many findings is numbered by many
    tasks.
    """
    block = F.struct("severity_rank", "stage_seq", "rule_seq", F.floor(F.col("row_seq") / (1 << 20)).alias("b"))
    return scan.number_rows(findings, [KEY], [*ORDER, "code", "location", "message"], block, out, start=start)


def number_findings(findings: DataFrame, base: int = 0) -> DataFrame:
    """0-based ids for JSON, 1-based numbers for Markdown."""
    return order_findings(findings, start=base, out="no")


def report_counts(bundles: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts per severity; a report passes without errors."""
    counts = findings.groupBy(KEY).agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in P.SEVERITY_RANK]
    )
    names = [f"{s}_count" for s in P.SEVERITY_RANK]
    out = bundles.join(counts, KEY, "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("bigint") for n in names})
    return out.withColumn("passed", F.col("error_count") == 0)


def merge_findings(bundles: DataFrame, findings: DataFrame, class_findings: DataFrame) -> DataFrame:
    """Adds classification findings; the OK row is decided anew."""
    merged = findings.filter(F.col("code") != "SUBMISSION.OK").unionByName(class_findings)
    return merged.unionByName(rules.all_clear(bundles, merged, "no_problem"))


# ---- rendering -------------------------------------------------------------


def _lines(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n")


def markdown_header(reports: DataFrame, form_type: str = P.FORM_TYPE) -> DataFrame:
    subject = F.coalesce(F.nullif(F.col("subject"), F.lit("")), F.lit("（未標示）"))
    passed = F.when(F.col("passed"), "✅ 規則檢查通過").otherwise("❌ 有須處理項目")
    pct = F.when(F.col("risk_score").isNotNull(), X.fill("（{s}%）", s=X.fixed1(F.col("risk_score")))).otherwise("")
    graded = F.coalesce(F.col("risk_grade"), F.lit("")) != ""
    text = _lines(
        F.lit(f"# {form_type} 初步審查報告"), F.lit(""), F.lit(f"> {P.BANNER}"), F.lit(""),
        X.fill(
            "**受審對象**：{subject}　|　**錯誤 {e}**　提醒 {w}　結果：{p}",
            subject=subject, e=F.col("error_count"), w=F.col("warn_count"), p=passed,
        ),
        F.lit(""),
        F.when(graded, X.fill("**固有風險分級**：{g}{p}", g=F.col("risk_grade"), p=pct)),
        F.when(graded, F.lit("")),
        F.lit("---"), F.lit(""),
    )
    return reports.select(KEY, text.alias("md"))


def _or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))


def markdown_finding(number: Column) -> Column:
    """One finding as Markdown lines; a multi-line message leaves the list."""
    icon, label = X.lookup_map(P.ICONS)[F.col("severity")], X.lookup_map(P.SEVERITY_LABELS)[F.col("severity")]
    some = F.col("expected").isNotNull() | F.col("actual").isNotNull()
    message = F.when(
        F.col("message").contains("\n"), X.fill("- **說明**：\n\n{m}\n", m=F.col("message"))
    ).otherwise(X.fill("- **說明**：{m}", m=F.col("message")))
    return _lines(
        X.fill("### {i}. {icon} [{label}] {t}", i=number, icon=icon, label=label, t=F.col("title")),
        F.when(F.coalesce(F.col("location"), F.lit("")) != "", X.fill("- **位置**：{l}", l=F.col("location"))),
        F.when(some, X.fill("- **期望**：{e}　**實際**：{a}", e=_or_dash(F.col("expected")), a=_or_dash(F.col("actual")))),
        message,
        X.fill("- **代碼**：`{c}`　_(需人工覆核)_", c=F.col("code")),
        F.lit(""),
    )


def report_markdown(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Markdown as rows (key, no, md): the head is 0, findings follow from 1.

    The document is the rows joined by newlines in their order, see
    :func:`whole_texts`.
    """
    pieces = number_findings(findings, 1).select(KEY, "no", markdown_finding(F.col("no")).alias("md"))
    return markdown_header(reports).select(KEY, F.lit(0).cast("bigint").alias("no"), "md").unionByName(pieces)


def report_json(reports: DataFrame, findings: DataFrame, form_type: str = P.FORM_TYPE) -> DataFrame:
    """JSON as rows (key, no, json), each with its part of the Markdown document.

    Row 0 holds the head fields; each finding is a row from 1 on, with its
    0-based id.
    """
    numbered = number_findings(findings, 1)
    entry = F.struct((F.col("no") - 1).cast("string").alias("id"), *SHOWN, markdown_finding(F.col("no")).alias("markdown"))
    head = F.struct(
        F.lit(form_type).alias("form_type"), "subject", "passed", "error_count", "warn_count", "info_count", "risk_score", "risk_grade",
        F.col("md").alias("markdown"),
    )
    heads = reports.join(markdown_header(reports, form_type), KEY)
    keep = {"ignoreNullFields": "false"}
    return heads.select(KEY, F.lit(0).cast("bigint").alias("no"), F.to_json(head, keep).alias("json")).unionByName(
        numbered.select(KEY, "no", F.to_json(entry, keep).alias("json"))
    )


def whole_texts(rows: DataFrame, text: str, sep: str = "\n") -> DataFrame:
    """One text per key out of rows (key, no, text)."""
    return scan.join_ordered(rows, [KEY], ["no"], scan.blocks("no", P.JOIN_BLOCK), F.col(text), sep, text)
