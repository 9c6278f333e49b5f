"""Review of many bundles: files and cells -> findings and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions.findings import emit, finding
from sheaf.functions.session import materialise, merged
from sheaf.operators import classify, judging, layout, report, rules, scoring
from sheaf.sources import tables

KEY = "bundle_id"
QUESTION_IDS = [q[0] for q in P.QUESTIONS]
_KIND_SHEETS = {
    "f01": [P.F01_SHEET, *[s for s, _, _ in P.F01_SUB_SHEETS]],
    "f02": [P.ASSESS_SHEET, P.RESIDUAL_SHEET, P.TREATMENT_SHEET],
    "f03": [P.F03_SHEET],
}


@dataclass
class Judges:
    """Optional judge branches.  ``canonical`` and ``question_sections`` come
    from a retrieval map; without them only the evidence judge runs."""

    evidence: judging.Judge | None = None
    compliance: judging.Judge | None = None
    canonical: DataFrame | None = None
    question_sections: DataFrame | None = None
    evidence_template: str = "{items_json}"
    compliance_template: str = "{items_json}"
    overhead: int | None = None


def kind_cells(cells: DataFrame, kind: str) -> DataFrame:
    """Filled cells of the sheets of one form kind, in whatever file they stand."""
    return cells.filter(F.col("sheet").isin(_KIND_SHEETS[kind]) & F.col("value").isNotNull())


def form_cells(cells: DataFrame, forms: DataFrame, kind: str) -> DataFrame:
    """Cells of the winning form files of one kind, only their form's sheets."""
    own = forms.filter(F.col("kind") == kind).select(KEY, "file_id", "kind")
    return kind_cells(cells, kind).join(own, [KEY, "file_id"]).select(KEY, "kind", "sheet", "row", "col", "value")


def lead_files(forms: DataFrame) -> DataFrame:
    """One row per (bundle, kind): the least id of its winning files, and the greatest, which is another one only where files tie."""
    read = forms.filter(F.col("file_id").isNotNull())
    return read.groupBy(KEY, "kind").agg(F.min("file_id").alias("lead"), F.max("file_id").alias("last"))


def lead_cells(cells: DataFrame, forms: DataFrame, leads: DataFrame) -> DataFrame:
    """Cells of tied files go by the id of their bundle's lead file, so that they make up one form; ``forms`` and ``leads`` of one kind."""
    tied = forms.join(leads.filter(F.col("lead") != F.col("last")), KEY).select(KEY, "file_id", "lead").filter(F.col("file_id") != F.col("lead")).distinct()
    return cells.join(tied, [KEY, "file_id"], "left").withColumn("file_id", F.coalesce("lead", "file_id")).drop("lead")


def f02_scored(cells: DataFrame, f02_bundles: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """One wide row per F02 bundle with answers, stored and computed scores."""
    forms = layout.f02_forms(cells, f02_bundles, keys)
    answers = layout.f02_wide_answers(cells, QUESTION_IDS, keys=keys)
    return scoring.risk_columns(scoring.score_columns(forms.join(answers, list(keys), "left")))


def long_answers(scored: DataFrame) -> DataFrame:
    entries = [F.struct(F.lit(q).alias("qid"), F.col(scoring.answer_column(q)).alias("answer")) for q in QUESTION_IDS]
    return scored.select(KEY, F.inline(F.array(*entries)))


def parse_bundles(files: DataFrame, cells: DataFrame, overrides: DataFrame | None = None, confirmed: bool = False) -> dict[str, DataFrame]:
    """Classify, route, and project the cells into form tables.

    ``confirmed`` applies ``overrides`` and ignores unrecognised files, as
    after a reader's confirmation; else the classification counts as it is.
    """
    classified = classify.classify_files(files)
    if confirmed or overrides is not None:
        classified = classify.apply_overrides(classified, overrides)
    # stored tables grow with the bundles, so none of them goes to the tasks whole
    classified = merged(materialise(classified))
    bundles = files.select(KEY).distinct()
    # the tables that many checks read are computed once
    forms = classify.route(classified).filter(F.col("role") == "winner")
    forms = merged(materialise(forms.drop("role", "winner_idx", "winner_filename")))
    present = forms.groupBy(KEY).agg(*[F.max(F.col("kind") == kind).alias(f"has_{kind}") for kind in _KIND_SHEETS])
    flags = {f"has_{kind}": F.coalesce(f"has_{kind}", F.lit(False)) for kind in _KIND_SHEETS}
    ok = {kind: rules.readable_forms(forms, kind).select(KEY) for kind in _KIND_SHEETS}
    # grids are folded by file where they are read, and the folded rows meet the winning files: a dozen cells are one row then
    leads = merged(materialise(lead_files(forms)))
    tied = not leads.filter(F.col("lead") != F.col("last")).isEmpty()
    lead = {kind: leads.filter(F.col("kind") == kind).select(KEY, F.col("lead").alias("file_id")) for kind in _KIND_SHEETS}

    def grids(kind: str) -> DataFrame:
        found = kind_cells(cells, kind).filter(F.col(KEY).isNotNull() & F.col("file_id").isNotNull())
        of_kind = F.col("kind") == kind
        return lead_cells(found, forms.filter(of_kind), leads.filter(of_kind)) if tied else found

    by_file = [KEY, "file_id"]
    rows = merged(materialise(layout.f01_rows(grids("f01"), keys=by_file).join(lead["f01"], by_file, "left_semi").drop("file_id")))
    scored = merged(materialise(f02_scored(grids("f02"), ok["f02"].join(lead["f02"], KEY, "left"), by_file).drop("file_id")))
    # few cells, but stored: else the rules make their texts anew for every test of them
    subs = merged(materialise(form_cells(cells.filter(F.col("sheet").isin([s for s, _, _ in P.F01_SUB_SHEETS])), forms, "f01")))
    f03 = merged(materialise(form_cells(cells, forms, "f03")))
    risk = scored.select(KEY, "risk_score", "risk_grade", "filing_unit")
    return {
        "bundles": bundles.join(layout.f01_subject(rows), KEY, "left").join(risk, KEY, "left").join(present, KEY, "left").withColumns(flags),
        "classified": classified,
        "forms": forms,
        "supporting": classified.filter(F.col("kind") == "supporting").select(KEY, "file_idx", "filename"),
        "f01_bundles": ok["f01"],
        "f02_bundles": ok["f02"],
        "f03_bundles": ok["f03"],
        "f01_rows": rows,
        "f01_sub_refs": layout.f01_sub_refs(subs),
        "f02": scored,
        "f03_identity": merged(layout.f03_identity(f03, ok["f03"])),
        "f03_items": merged(materialise(layout.f03_items(f03).join(ok["f03"], KEY, "left_semi"))),
    }


def rule_findings(t: dict[str, DataFrame]) -> DataFrame:
    """All rule checks in their fixed order, and registered ones."""
    parts = [
        rules.parse_error_findings(t["forms"]),
        rules.required_document_findings(t["bundles"], t["forms"].select(KEY, "kind")),
        rules.conditional_document_findings(t["bundles"], t["supporting"]),
        rules.f01_findings(t["f01_bundles"], t["f01_rows"]),
        rules.f02_findings(t["f02"]),
        rules.evidence_presence(t["f03_items"]),
        rules.cross_findings(t["f01_rows"], t["f01_sub_refs"], t["f03_identity"], t["f02"]),
        *rules.registered_findings(t),
    ]
    return report.union_findings(parts)


def judge_findings(t: dict[str, DataFrame], judges: Judges) -> DataFrame | None:
    parts = []
    items, bundles = t["f03_items"], t["f03_bundles"]
    if judges.evidence:
        parts.append(
            judging.optional_branch(
                True, bundles,
                lambda: judging.evidence_review(items, judges.evidence, judges.evidence_template),
                "F03.LLM_SKIPPED", "evidence",
            )
        )
    if judges.compliance and judges.canonical is not None:
        parts.append(
            judging.optional_branch(
                True, bundles,
                lambda: judging.compliance_review(
                    items, judges.canonical, judges.compliance, judges.compliance_template, overhead=judges.overhead
                ),
                "F03.RAG_FAILED", "compliance", code="F03.RAG_ERROR",
            )
        )
    if judges.question_sections is not None:
        weights = scoring.scoring_dims(items.sparkSession)["weights"]
        hits = rules.triggered_questions(long_answers(t["f02"]), weights)
        parts.append(rules.triggered_refs(hits, judges.question_sections))
        parts.append(rules.triggered_refs_summary(t["f02_bundles"], hits, judges.question_sections))
    return report.union_findings(parts) if parts else None


def with_retrieval_map(bundles: DataFrame, path: str, judges: Judges) -> tuple[Judges, DataFrame | None]:
    """Judges completed from a retrieval map document.

    A map that cannot be read leaves the judges as they are and gives one
    ``RAG.SKIPPED`` finding per bundle, to be passed on as ``extra``.
    """
    try:
        items, questions = tables.load_retrieval_map(bundles.sparkSession, path)
    except tables.RetrievalMapError as exc:
        return judges, emit(bundles, finding("RAG.SKIPPED", "compliance", 0, error=F.lit(type(exc).__name__)))
    canonical = items.select("item_id", "canonical_description", "canonical_ref_raw", "sections")
    return replace(judges, canonical=canonical, question_sections=tables.flat_sections(questions, "qid")), None


def review_bundles(
    files: DataFrame,
    cells: DataFrame,
    overrides: DataFrame | None = None,
    confirmed: bool = False,
    judges: Judges | None = None,
    extra: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Findings and reports of all bundles in one job.

    ``extra`` findings (for instance ``RAG.SKIPPED`` rows) join the others
    before the all-clear decision.
    """
    t = parse_bundles(files, cells, overrides, confirmed)
    found = [rule_findings(t), classify.classification_findings(t["classified"])]
    found += [more for more in (judge_findings(t, judges) if judges else None, extra) if more is not None]
    every = merged(materialise(report.union_findings(found)))
    t["findings"] = every.unionByName(rules.all_clear(t["bundles"], every, "no_problem"))
    t["reports"] = report.report_counts(t["bundles"], t["findings"])
    return t


def review_submissions(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(reports, findings) without the classification findings."""
    found = rule_findings(t)
    found = found.unionByName(rules.all_clear(t["bundles"], found, "none"))
    return report.report_counts(t["bundles"], found), found


def review_form(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(reports, findings) of the risk questionnaire alone."""
    found = rules.f02_findings(t["f02"])
    found = found.unionByName(rules.all_clear(t["f02_bundles"], found, "none", "F02.OK"))
    reports = t["f02"].select(KEY, F.lit(None).cast("string").alias("subject"), "risk_score", "risk_grade")
    return report.report_counts(reports, found), found
