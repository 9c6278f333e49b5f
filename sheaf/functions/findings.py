"""Building rows of the common ``findings`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions.text import fill

KEY = "bundle_id"


def finding(
    wording: str,
    stage: str,
    rule: int,
    row: Column | int = 0,
    code: Column | str | None = None,
    severity: str | None = None,
    **parts: Column,
) -> Column:
    """One finding as a struct.  ``wording`` names an entry of the text table."""
    text = P.FINDINGS[wording]
    level = severity or text["severity"]
    blank = F.lit(None).cast("string")

    def part(name: str) -> Column:
        return fill(text[name], **parts) if name in text else blank

    return F.struct(
        F.lit(level).alias("severity"),
        F.lit(P.SEVERITY_RANK[level]).alias("severity_rank"),
        (code if isinstance(code, Column) else F.lit(code or wording)).alias("code"),
        part("title").alias("title"),
        part("message").alias("message"),
        part("location").alias("location"),
        part("expected").alias("expected"),
        part("actual").alias("actual"),
        F.lit(text.get("source", "rule")).alias("source"),
        F.lit(True).alias("needs_human"),
        F.lit(P.STAGES[stage]).alias("stage_seq"),
        F.lit(rule).alias("rule_seq"),
        (row if isinstance(row, Column) else F.lit(row)).cast("bigint").alias("row_seq"),
    )


def emit(df: DataFrame, *found: Column, key: str = KEY) -> DataFrame:
    """All non-null finding structs of each row, one output row per finding.

    Several rules over one table cost one pass: no join, no shuffle.
    """
    flat = F.filter(F.array(*found), lambda f: f.isNotNull())
    return df.select(F.col(key), F.inline(flat))


def when(condition: Column, found: Column) -> Column:
    return F.when(condition, found)
