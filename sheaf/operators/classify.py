"""File classification and routing (CLS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.functions.findings import emit, finding
from sheaf.operators import scan

KEY = "bundle_id"
FORM_KINDS = ["f01", "f02", "f03"]


def is_excel(filename: Column) -> Column:
    """Extension gate: anything else is supporting material and never opened."""
    return X.suffix(filename).isin(P.EXCEL_SUFFIXES)


def kind_label(kind: Column) -> Column:
    return F.coalesce(X.lookup_map(P.KIND_LABELS)[kind], kind)


def classify_files(files: DataFrame, signatures: list[tuple] | None = None) -> DataFrame:
    """Kind, matched sheet and reason of each file; a row-wise expression.

    ``sheets`` is the file's sheet list.  Signatures are tried by priority.
    """
    signatures = sorted(P.SIGNATURES if signatures is None else signatures, key=lambda s: s[2])
    names = F.array_sort(F.array_distinct(F.coalesce("sheets", F.array().cast("array<string>"))))
    excel = is_excel(F.col("filename"))
    readable = F.coalesce(F.col("readable"), F.lit(True))

    def pick(hit, other):
        out = other
        for kind, sheet, _, reason in reversed(signatures):
            out = F.when(F.array_contains(F.col("sheets"), sheet), F.lit(hit(kind, sheet, reason))).otherwise(out)
        return out

    listed = F.when(F.size(names) > 0, F.array_join(names, "、")).otherwise(F.lit(P.NO_SHEETS))
    unreadable = X.fill(P.REASON_UNREADABLE, error=F.coalesce(F.col("error"), F.lit("")))
    kind = (
        F.when(~excel, "supporting").when(~readable, "unknown").otherwise(pick(lambda k, s, r: k, F.lit("unknown")))
    )
    matched = F.when(excel & readable, pick(lambda k, s, r: s, F.lit(None).cast("string")))
    reason = (
        F.when(~excel, P.REASON_SUPPORTING)
        .when(~readable, unreadable)
        .otherwise(pick(lambda k, s, r: r.format(sheet=s), X.fill(P.REASON_UNKNOWN, sheets=listed)))
    )
    return files.withColumns({"kind": kind, "matched_sheet": matched, "reason": reason})


def confirmed_kinds(classified: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """A reader's own choice per file replaces the kind.

    Unrecognised files default to ``ignore``.
    """
    default = F.when(F.col("kind") == "unknown", "ignore").otherwise(F.col("kind"))
    if overrides is None:
        return classified.withColumn("kind", default)
    pick = overrides.select(KEY, "file_idx", F.col("kind").alias("__override"))
    return (
        classified.join(pick, [KEY, "file_idx"], "left")
        .withColumn("kind", F.coalesce("__override", default))
        .drop("__override")
    )


def apply_overrides(classified: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Files by their confirmed kinds; ignored ones drop out."""
    return confirmed_kinds(classified, overrides).filter(F.col("kind") != "ignore")


def winners(classified: DataFrame) -> DataFrame:
    """First file of each form kind that has a path: an aggregation, no window."""
    forms = classified.filter(F.col("kind").isin(FORM_KINDS) & F.col("file_id").isNotNull())
    return forms.groupBy(KEY, "kind").agg(
        F.min("file_idx").alias("winner_idx"), F.min_by("filename", "file_idx").alias("winner_filename")
    )


def route(classified: DataFrame, won: DataFrame | None = None) -> DataFrame:
    """Each form file with its role: ``winner`` or ``duplicate`` of an earlier one.

    ``won`` is the table of :func:`winners`, if a stream has kept it already.
    A file without a path neither wins nor counts as a duplicate before the
    winner; after the winner it is a duplicate like any other.
    """
    forms = classified.filter(F.col("kind").isin(FORM_KINDS))
    role = F.when(F.col("file_idx") == F.col("winner_idx"), "winner").when(
        F.col("file_idx") > F.col("winner_idx"), "duplicate"
    )
    return forms.join(winners(classified) if won is None else won, [KEY, "kind"], "left").withColumn("role", role)


def duplicate_findings(routed: DataFrame) -> DataFrame:
    both = X.fill("{a}、{b}", a=F.col("winner_filename"), b=F.col("filename"))
    return emit(
        routed.filter(F.col("role") == "duplicate"),
        finding(
            "CLASSIFY.DUPLICATE", "classify", 1, F.col("file_idx"),
            code=F.concat(F.lit("CLASSIFY.DUPLICATE_"), F.upper("kind")),
            label=kind_label(F.col("kind")), both=both, first=F.col("winner_filename"), dup=F.col("filename"),
        ),
    )


def unrecognized_findings(classified: DataFrame) -> DataFrame:
    return emit(
        classified.filter(F.col("kind") == "unknown"),
        finding(
            "CLASSIFY.UNRECOGNIZED", "classify", 1, F.col("file_idx"),
            filename=F.col("filename"), reason=F.col("reason"),
        ),
    )


def classification_summary(classified: DataFrame) -> DataFrame:
    """File count and ordered ``name → label`` list, first in the report."""
    line = X.fill("{name} → {label}", name=F.col("filename"), label=kind_label(F.col("kind")))
    texts = scan.join_ordered(classified, [KEY], ["file_idx"], scan.blocks("file_idx", P.JOIN_BLOCK), line, "；", "lines", n=F.lit(1))
    return emit(texts, finding("CLASSIFY.SUMMARY", "classify", 0, n=F.col("n"), lines=F.col("lines")))


def classification_findings(classified: DataFrame) -> DataFrame:
    """Summary, then unrecognised and duplicate files in file order."""
    return (
        classification_summary(classified)
        .unionByName(unrecognized_findings(classified))
        .unionByName(duplicate_findings(route(classified)))
    )


def preview_flags(classified: DataFrame) -> DataFrame:
    """``unknown``, or ``dup`` from the second file of a form kind on."""
    first = (
        classified.filter(F.col("kind").isin(FORM_KINDS))
        .groupBy(KEY, "kind")
        .agg(F.min("file_idx").alias("__first"))
    )
    return (
        classified.join(first, [KEY, "kind"], "left")
        .withColumn(
            "flag",
            F.when(F.col("kind") == "unknown", "unknown").when(F.col("file_idx") > F.col("__first"), "dup"),
        )
        .drop("__first")
    )


def kind_counts(files: DataFrame) -> DataFrame:
    """Files per kind; over ``confirmed_kinds`` it counts ignored ones too."""
    return files.groupBy(KEY, "kind").agg(F.count(F.lit(1)).alias("n"))
