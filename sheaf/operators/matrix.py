"""Findings -> item status matrix (MTX)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.operators.report import order_findings

KEY = "bundle_id"
CELLS = ["prop", "golive", "diff", "rag"]


def item_location(location: Column) -> Column:
    """(item_id, topic) out of a location text, or null."""
    rule = X.pattern(P.ITEM_LOCATION)
    item = F.nullif(F.regexp_extract(location, rule, 1), F.lit(""))
    topic = F.nullif(F.regexp_extract(location, rule, 2), F.lit(""))
    return F.when(item.isNotNull(), F.struct(item.alias("item_id"), topic.alias("topic")))


def triage(findings: DataFrame) -> DataFrame:
    """The bucket of each finding, and its item if it has one."""
    where = item_location(F.col("location"))
    bucket = (
        F.when(F.col("code").isin(P.NOTICE_CODES), "notice")
        .when(where.isNotNull(), "item")
        .when(F.col("severity") != "info", "other")
        .when(F.col("code").isin(P.AGGREGATE_CODES), "aggregate")
        .when(F.col("code").isin(P.REG_REF_CODES), "regref")
        .otherwise("passlog")
    )
    return findings.withColumn("bucket", bucket).withColumn("__at", where).select(
        *findings.columns, "bucket", F.col("__at.item_id").alias("item_id"), F.col("__at.topic").alias("item_topic")
    )


def pipe_table(message: Column) -> Column:
    """Data rows of a pipe table at the start of a text, or null if none is."""
    lines = F.split(message, "\n")
    separator = X.pattern(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")

    def is_row(line: Column) -> Column:
        return X.strip(line).startswith("|")

    def cells(line: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(X.strip(line), r"^\|", ""), r"\|$", "")
        return F.transform(F.split(bare, r"\|"), X.strip)

    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    rest = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    flags = F.transform(rest, lambda l: is_row(l) & ~l.rlike(separator))
    stop = F.array_position(flags, False)
    n = F.when(stop == 0, F.size(rest)).otherwise((stop - 1).cast("int"))
    return F.when(is_row(first) & second.rlike(separator), F.transform(F.slice(rest, F.lit(1), n), cells))


def parse_pipe_table(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(pipe_table(F.col(col))).alias("row_no", "cells"))


def cell_status(c: Column) -> Column:
    """Marker in front -> kind; the rest is the note."""
    s = X.strip(F.coalesce(c, F.lit("")))
    out = F.struct(F.lit("none").alias("kind"), s.alias("note"))
    for mark, kind in reversed(P.CELL_MARKERS):
        rest = X.strip(F.substr(s, F.lit(len(mark) + 1)))
        out = F.when(s.startswith(mark), F.struct(F.lit(kind).alias("kind"), rest.alias("note"))).otherwise(out)
    return F.when((s == "") | (s == P.CELL_EMPTY), F.struct(F.lit("none").alias("kind"), F.lit("").alias("note"))).otherwise(out)


def _table_rows(findings: DataFrame, code: str) -> DataFrame:
    rows = parse_pipe_table(findings.filter(F.col("code") == code), "message", [KEY])
    item = F.get("cells", F.lit(0))
    last = F.max_by("cells", "row_no").alias("cells")
    return rows.filter(F.coalesce(item, F.lit("")) != "").groupBy(KEY, item.alias("item_id")).agg(last)


def evidence_table(findings: DataFrame) -> DataFrame:
    at = lambda i: F.get("cells", F.lit(i))
    return _table_rows(findings, "F03.LLM_TABLE").select(
        KEY, "item_id", at(1).alias("topic"),
        cell_status(at(2)).alias("diff"), cell_status(at(3)).alias("prop"), cell_status(at(4)).alias("golive"),
    )


def compliance_table(findings: DataFrame) -> DataFrame:
    at = lambda i: F.get("cells", F.lit(i))
    refs = F.coalesce(F.nullif(at(3), F.lit(P.CELL_EMPTY)), F.lit(""))
    return _table_rows(findings, "F03.RAG_TABLE").select(
        KEY, "item_id", at(1).alias("topic"), cell_status(at(2)).alias("rag"), refs.alias("refs")
    )


def item_findings(findings: DataFrame) -> DataFrame:
    """Findings of each (bundle, item) as one row: partial aggregates only."""
    ordered = order_findings(triage(findings).filter(F.col("bucket") == "item"))
    causes = [
        F.max(F.col("code").isin([c for c, k in P.CAUSE_CODES.items() if k == cause])).alias(f"code_{cause}")
        for cause in P.CAUSES
    ]
    fallback = [F.max(F.col("code") == code).alias(f"blank_{cell}") for code, cell in P.FALLBACK_CODES.items()]
    return ordered.groupBy(KEY, "item_id").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.min("severity_rank").alias("worst"),
        F.min_by("title", "seq").alias("first_title"),
        F.min_by("item_topic", F.when(F.col("item_topic").isNotNull(), F.col("seq"))).alias("item_topic"),
        *causes,
        *fallback,
    )


def status_matrix(findings: DataFrame, evidence: DataFrame | None = None, compliance: DataFrame | None = None) -> DataFrame:
    """One row per item out of its findings and both summary tables."""
    evidence = evidence_table(findings) if evidence is None else evidence
    compliance = compliance_table(findings) if compliance is None else compliance
    own = item_findings(findings)
    tables = evidence.select(KEY).unionByName(compliance.select(KEY)).distinct().withColumn("has_table", F.lit(True))
    joined = (
        own.join(evidence.withColumnRenamed("topic", "__t1"), [KEY, "item_id"], "full_outer")
        .join(compliance.withColumnRenamed("topic", "__t2"), [KEY, "item_id"], "full_outer")
        .join(tables, KEY, "left")
    )
    none = F.struct(F.lit("none").alias("kind"), F.lit("").alias("note"))
    named = lambda c: F.nullif(F.nullif(F.col(c), F.lit(P.CELL_EMPTY)), F.lit(""))
    raw = lambda c: F.nullif(F.col(c), F.lit(""))
    topic = F.coalesce(named("__t2"), named("__t1"), F.col("item_topic"))
    topic = F.when(F.col("n_findings").isNotNull(), topic).otherwise(F.coalesce(topic, raw("__t1"), raw("__t2")))
    zero = F.lit(False)
    flags = [f"code_{c}" for c in P.CAUSES] + [f"blank_{c}" for c in P.FALLBACK_CODES.values()]
    return joined.select(
        KEY, "item_id", topic.alias("topic"),
        *[F.coalesce(c, none).alias(c) for c in CELLS],
        F.coalesce("refs", F.lit("")).alias("refs"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"), "worst", "first_title",
        *[F.coalesce(f, zero).alias(f) for f in flags],
        F.coalesce("has_table", zero).alias("has_table"),
    )


def with_gist(matrix: DataFrame) -> DataFrame:
    """Difference note, go-live note, gap note, first finding's title."""

    def note(c: str) -> Column:
        return F.nullif(F.col(c)["note"], F.lit(""))

    gap = F.when(F.col("rag")["kind"] == "warn", note("rag"))
    return matrix.withColumn("gist", F.coalesce(note("diff"), note("golive"), gap, F.col("first_title"), F.lit("—")))


def with_rule_fallback(matrix: DataFrame) -> DataFrame:
    """Rule findings fill cells no table filled; call after ``with_gist``."""
    blank = F.struct(F.lit("warn").alias("kind"), F.lit(P.FALLBACK_NOTE).alias("note"))
    cells = {
        c: F.when((F.col(c)["kind"] == "none") & F.col(f"blank_{c}"), blank).otherwise(F.col(c))
        for c in P.FALLBACK_CODES.values()
    }
    return matrix.withColumns(cells)


def with_causes(matrix: DataFrame) -> DataFrame:
    by_cell = {c: ["warn", "err"] if c == "diff" else ["warn"] for c in P.CAUSES}
    causes = F.array(
        *[F.when(F.col(c)["kind"].isin(kinds) | F.col(f"code_{c}"), F.lit(c)) for c, kinds in by_cell.items()]
    )
    return matrix.withColumn("causes", F.filter(causes, lambda c: c.isNotNull()))


def with_attention(matrix: DataFrame) -> DataFrame:
    cell = reduce(lambda a, b: a | b, [F.col(c)["kind"].isin("warn", "err", "undet") for c in CELLS])
    problem = F.coalesce(F.col("worst") < P.SEVERITY_RANK["info"], F.lit(False))
    lone = ~F.col("has_table") & (F.col("n_findings") > 0)
    attention = cell | problem | lone
    error = F.coalesce(F.col("worst") == P.SEVERITY_RANK["error"], F.lit(False))
    severity = F.when(error, "error").when(attention, "warn").otherwise("info")
    return matrix.withColumn("has_attention", attention).withColumn("row_severity", severity)


def build_matrix(findings: DataFrame) -> DataFrame:
    """All matrix steps, with a natural sort key."""
    out = with_attention(with_causes(with_rule_fallback(with_gist(status_matrix(findings)))))
    return out.withColumn("sort_key", X.natural_key(F.col("item_id")))


def primary_cause(matrix: DataFrame) -> DataFrame:
    """The most frequent cause of rows that need attention; ties by fixed order."""
    rows = matrix.filter("has_attention")
    counts = [F.count_if(F.array_contains("causes", c)).alias(f"__{c}") for c in P.CAUSES]
    tally = rows.groupBy(KEY).agg(*counts)
    top = F.greatest(*[F.col(f"__{c}") for c in P.CAUSES])
    label = reduce(
        lambda rest, c: F.when(F.col(f"__{c}") == top, P.CAUSE_LABELS[c]).otherwise(rest), reversed(P.CAUSES), F.lit("—")
    )
    return tally.select(KEY, F.when(top > 0, label).otherwise("—").alias("primary_cause"), top.alias("n"))


def matrix_stats(matrix: DataFrame) -> DataFrame:
    counts = matrix.groupBy(KEY).agg(
        F.count_if("has_attention").alias("attention"), F.count(F.lit(1)).alias("total")
    )
    return (
        counts.join(primary_cause(matrix).select(KEY, "primary_cause"), KEY, "left")
        .withColumn("primary_cause", F.coalesce("primary_cause", F.lit("—")))
        .withColumn("clean", F.col("total") - F.col("attention"))
    )


def bucket_counts(findings: DataFrame) -> DataFrame:
    buckets = ["notice", "item", "other", "aggregate", "regref", "passlog"]
    return (
        triage(findings)
        .groupBy(KEY)
        .agg(*[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in buckets], F.count(F.lit(1)).alias("n_all"))
    )


def conclusion(stats: DataFrame, reports: DataFrame, buckets: DataFrame) -> DataFrame:
    zero = F.lit(0)
    wide = (
        reports.select(KEY, "error_count").join(stats, KEY, "left").join(buckets, KEY, "left")
    )
    attention, others, notices = (F.coalesce(c, zero) for c in ("attention", "n_other", "n_notice"))
    parts = F.array(
        X.fill("{n} 錯誤", n=F.col("error_count")),
        F.when(attention > 0, X.fill("{a}/{t} 檢核項需人工確認", a=attention, t=F.col("total"))),
        F.when(others > 0, X.fill("另 {n} 項其他待處理", n=others)),
        F.when(notices > 0, F.lit("AI 判讀未完整執行")),
        F.when(attention > 0, X.fill("主因：{c}", c=F.col("primary_cause"))),
    )
    text = F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · ")
    action = (attention > 0) | (F.col("error_count") > 0) | (others > 0) | (notices > 0)
    return wide.select(
        KEY,
        action.alias("needs_action"),
        F.when(action, X.fill("「{t}」", t=text)).otherwise("「0 錯誤 · 檢核項無需人工確認」").alias("conclusion"),
    )


def default_bucket(findings: DataFrame) -> DataFrame:
    """First reference bucket that holds a finding."""
    counts = bucket_counts(findings)
    pick = reduce(
        lambda rest, b: F.when(F.col(f"n_{b}") > 0, b).otherwise(rest), reversed(P.REFERENCE_BUCKETS), F.lit("all")
    )
    return counts.select(KEY, pick.alias("bucket"))


def matrix_view(matrix: DataFrame, mode: str = "attention") -> DataFrame:
    return matrix if mode == "all" else matrix.filter("has_attention")


def findings_view(findings: DataFrame, severity: str = "all") -> DataFrame:
    return findings if severity == "all" else findings.filter(F.col("severity") == severity)


def short_note(c: Column) -> Column:
    """Stage prefix off, up to the first punctuation, eight characters."""
    s = F.regexp_replace(X.strip(F.coalesce(c, F.lit(""))), X.pattern(P.NOTE_PREFIX), "")
    s = X.strip(F.regexp_replace(s, "(?s)" + P.NOTE_STOP, ""))
    return F.when(F.length(s) > P.NOTE_CHARS, F.concat(F.substring(s, 1, P.NOTE_CHARS), F.lit("…"))).otherwise(s)
