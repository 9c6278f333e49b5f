"""Rule checks (RUL): generic shapes, and the governance preset built on them.

Every check returns findings.  Rules over one table are row-wise expressions
collected in one pass; rules between tables are semi or anti joins on the
bundle key plus the compared value, so a hot bundle is spread by its values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.functions.findings import emit, finding, when
from sheaf.functions.session import materialise, merged
from sheaf.operators import scan, scoring

KEY = "bundle_id"

# ---- plug-in registry ------------------------------------------------------

_CHECKS: dict[str, tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = {}


def register_check(name: str, stage: str, fn: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
    """Add a check: a function from the bundle tables to a findings table."""
    _CHECKS[name] = (stage, fn)


def unregister_check(name: str) -> None:
    _CHECKS.pop(name, None)


def registered_findings(tables: dict[str, DataFrame]) -> list[DataFrame]:
    by_stage = sorted(_CHECKS.values(), key=lambda c: P.STAGES[c[0]])
    return [fn(tables) for _, fn in by_stage]


# ---- generic shapes --------------------------------------------------------


def require_role(bundles: DataFrame, present: DataFrame, required: list[tuple], stage: str = "documents") -> DataFrame:
    """Required roles a bundle lacks.  ``required``: (role, code, label, severity)."""
    flags = present.groupBy(KEY).agg(
        *[F.max(F.col("kind") == role).alias(f"has_{i}") for i, (role, *_) in enumerate(required)]
    )
    wide = bundles.select(KEY).join(flags, KEY, "left")
    return emit(
        wide,
        *[
            when(
                ~F.coalesce(F.col(f"has_{i}"), F.lit(False)),
                finding(
                    "DOC.MISSING" if severity == "error" else "DOC.MISSING_SOFT",
                    stage, i, code=code, severity=severity, label=F.lit(label),
                ),
            )
            for i, (_, code, label, severity) in enumerate(required)
        ],
    )


def require_any_row(bundles: DataFrame, rows: DataFrame, wording: str = "F01.NO_DATA_ROW", stage: str = "f01") -> DataFrame:
    return emit(bundles.select(KEY).join(rows.select(KEY), KEY, "left_anti"), finding(wording, stage, 0))


def missing_labels(required: list[tuple[str, str]], value: Callable[[str], Column] = F.col) -> Column:
    """Labels of the null columns, in the given order."""
    entries = F.array(*[F.when(value(c).isNull(), F.lit(label)) for c, label in required])
    return F.filter(entries, lambda x: x.isNotNull())


def require_columns(
    rows: DataFrame, required: list[tuple[str, str]], row: str = "row_index",
    wording: str = "F01.REQUIRED_MISSING", stage: str = "f01", key: str = KEY,
) -> DataFrame:
    """One finding per row that lacks required columns, listing their labels."""
    marked = rows.select(key, row, missing_labels(required).alias("__missing")).filter(F.size("__missing") > 0)
    return emit(
        marked,
        finding(
            wording, stage, 1, F.col(row),
            line=F.col(row), n=F.size("__missing"), missing=F.array_join("__missing", ", "),
        ),
        key=key,
    )


def members(prefix: str, n: int) -> list[str]:
    return [f"{prefix}-{i:02d}" for i in range(1, n + 1)]


def group_state(answers: DataFrame, groups: DataFrame, member: str = "member", key: str = KEY) -> DataFrame:
    """Per (key, group): size, answered members, Y count.

    ``answers(key, group, member, answer)`` may repeat a member; ``groups``
    gives each group's size.  Answers are counted per member first, so the
    second aggregation is small.
    """
    y, some = F.col("answer") == "Y", F.col("answer").isNotNull()
    one = answers.groupBy(key, "group", member).agg(
        F.max(F.coalesce(y, F.lit(False))).alias("y"), F.max(some).alias("a")
    )
    per = one.groupBy(key, "group").agg(F.count_if("a").alias("answered"), F.count_if("y").alias("yes"))
    return per.join(groups, "group")


def complete_group(state: DataFrame, key: str = KEY) -> DataFrame:
    """Groups with an unanswered member."""
    return state.filter(F.col("answered") < F.col("n")).select(
        key, "group", (F.col("n") - F.col("answered")).alias("missing")
    )


def exactly_n(state: DataFrame, wanted: int = 1, key: str = KEY) -> DataFrame:
    """Fully answered groups whose Y count differs from ``wanted``."""
    return state.filter((F.col("answered") == F.col("n")) & (F.col("yes") != wanted)).select(key, "group", "yes")


def at_least_n(state: DataFrame, wanted: int = 1, key: str = KEY) -> DataFrame:
    """Groups with an answer but fewer than ``wanted`` Y."""
    return state.filter((F.col("answered") > 0) & (F.col("yes") < wanted)).select(key, "group", "yes")


def within_tolerance(stored: DataFrame, computed: DataFrame, keys: list[str], tolerance: float = P.SCORE_TOLERANCE) -> DataFrame:
    return scoring.score_diff(stored, computed, keys, tolerance)


def follow_up_step(steps: list[tuple[Column, str | None]]) -> Column:
    """Name of the first step whose condition holds; a None step ends silently."""
    return reduce(
        lambda rest, s: F.when(s[0], F.lit(s[1])).otherwise(rest), reversed(steps), F.lit(None).cast("string")
    )


def sets_overlap(left: DataFrame, right: DataFrame, key: str = KEY, norm: Callable[[Column], Column] = X.match_key) -> DataFrame:
    """Keys whose two value sets, normalised, are both non-empty and disjoint.

    The match is one shuffle on (key, value) and one on key; no set is
    collected.  Both inputs: (key, value).
    """
    a = left.select(key, norm(F.col("value")).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(key, norm(F.col("value")).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.unionByName(b).filter(F.col("v").isNotNull()).groupBy(key, "v").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    found = sides.groupBy(key).agg(
        F.max("l").alias("has_left"), F.max("r").alias("has_right"), F.max(F.col("l") * F.col("r")).alias("common")
    )
    return found.filter((F.col("has_left") == 1) & (F.col("has_right") == 1) & (F.col("common") == 0)).select(key)


def references_resolve(
    refs: DataFrame, names: DataFrame, key: str = KEY, ref: str = "ref", name: str = "name",
    norm: Callable[[Column], Column] = X.match_key,
) -> DataFrame:
    """References that match no name of their key; keys without names are skipped."""
    known = names.select(key, norm(F.col(name)).alias("__n")).filter(F.col("__n").isNotNull()).distinct()
    wanted = refs.withColumn("__n", norm(F.col(ref))).filter(F.col("__n").isNotNull())
    return (
        wanted.join(known, [key, "__n"], "left_anti")
        .join(known.select(key).distinct(), key, "left_semi")
        .drop("__n")
    )


# ---- documents -------------------------------------------------------------


def required_document_findings(bundles: DataFrame, present: DataFrame, required: list[tuple] | None = None) -> DataFrame:
    """``required`` (role, code, label, severity); the preset by default."""
    if required is None:
        required = [(r, c, label, "error") for r, c, label in P.REQUIRED_DOCS] + [(*P.SOFT_DOC, "warn")]
    return require_role(bundles, present, required)


def conditional_document_findings(bundles: DataFrame, supporting: DataFrame, conditions: list[tuple] | None = None) -> DataFrame:
    """Supporting files asked for by the risk grade, found by name keywords.

    ``bundles(key, risk_grade)``, ``supporting(key, filename)``.
    """
    conditions = P.CONDITIONAL_DOCS if conditions is None else conditions
    name = X.casefold(F.col("filename"))

    def named(keywords: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [name.contains(k.casefold()) for k in keywords])

    flags = supporting.groupBy(KEY).agg(
        *[F.max(named(words)).alias(f"has_{i}") for i, (_, _, _, words) in enumerate(conditions)]
    )
    wide = bundles.select(KEY, "risk_grade").join(flags, KEY, "left")
    return emit(
        wide,
        *[
            when(
                F.col("risk_grade").isin(grades) & ~F.coalesce(F.col(f"has_{i}"), F.lit(False)),
                finding(
                    "DOC.MISSING_CONDITIONAL", "documents", 10 + i, code=code, label=F.lit(label),
                    grade=F.col("risk_grade"), keywords=F.lit(", ".join(words)),
                ),
            )
            for i, (code, label, grades, words) in enumerate(conditions)
        ],
    )


# ---- F01 -------------------------------------------------------------------


def f01_findings(f01_bundles: DataFrame, rows: DataFrame) -> DataFrame:
    required = [(P.F01_COLUMNS[c], label) for c, label in P.F01_REQUIRED]
    return require_any_row(f01_bundles, rows).unionByName(require_columns(rows, required))


# ---- F02: all rules are expressions over one wide row per bundle ------------


def f02_findings(wide: DataFrame) -> DataFrame:
    """Completeness, choice, score and follow-up rules in a single pass.

    ``wide``: question columns, uplift answers, stored scores, follow-up
    status, and the recomputed ``pct_*``, ``overall``, ``grade``.
    """
    return emit(wide, *choice_findings(), *score_findings(), *follow_up_findings())


def choice_findings() -> list[Column]:
    """Unanswered questions, and choices with too many or too few answers; needs the question columns."""
    groups = {**P.SINGLE_CHOICE, **P.MULTI_CHOICE}
    answers = {q: F.col(scoring.answer_column(q)) for g, n in groups.items() for q in members(g, n)}
    answers |= {q: F.col(scoring.answer_column(q)) for q in P.GENERAL_QUESTIONS}

    def those(ids: list[str], test: Callable[[Column], Column]) -> Column:
        return F.filter(F.array(*[F.when(test(answers[q]), F.lit(q)) for q in ids]), lambda x: x.isNotNull())

    gone = {g: those(members(g, n), F.isnull) for g, n in groups.items()}
    yes = {g: those(members(g, n), lambda a: a == "Y") for g, n in groups.items()}
    found = [
        when(F.size(g) > 0, finding("F02.SERIES_INCOMPLETE", "f02", 0, i, prefix=F.lit(prefix), missing=F.array_join(g, ", "), n=F.size(g)))
        for i, (prefix, g) in enumerate(gone.items())
    ]
    general = those(P.GENERAL_QUESTIONS, F.isnull)
    found.append(
        when(F.size(general) > 0, finding("F02.GENERAL_INCOMPLETE", "f02", 1, missing=F.array_join(general, ", "), n=F.size(general)))
    )
    for i, prefix in enumerate(P.SINGLE_CHOICE):
        y = yes[prefix]
        listed = F.when(F.size(y) > 0, F.array_join(y, ", ")).otherwise(F.lit("無"))
        found.append(
            when(
                (F.size(gone[prefix]) == 0) & (F.size(y) != 1),
                finding("F02.SINGLE_CHOICE", "f02", 2, i, prefix=F.lit(prefix), n=F.size(y), yes=listed),
            )
        )
    for i, (prefix, n) in enumerate(P.MULTI_CHOICE.items()):
        found.append(
            when((F.size(gone[prefix]) < n) & (F.size(yes[prefix]) == 0), finding("F02.MULTI_CHOICE", "f02", 3, i, prefix=F.lit(prefix)))
        )
    return found


def score_findings() -> list[Column]:
    """Stored against recomputed grade and percentages; needs a stored grade."""
    stored = F.col("cached_grade")
    score = X.fixed1(F.col("overall"))
    found = [
        when(stored.isNull(), finding("F02.CACHE_MISSING", "f02", 4, grade=F.col("grade"), score=score)),
        when(
            stored.isNotNull() & (stored != F.col("grade")),
            finding("F02.GRADE_MISMATCH", "f02", 4, grade=F.col("grade"), score=score, stored=stored),
        ),
    ]
    for i, d in enumerate(P.DOMAINS):
        now, kept = F.col(f"pct_{d}"), F.col(f"cached_{d}")
        found.append(
            when(
                stored.isNotNull() & kept.isNotNull() & (F.abs(now - kept) > P.SCORE_TOLERANCE),
                finding(
                    "F02.SCORE_MISMATCH", "f02", 4, 1 + i,
                    label=F.lit(P.DOMAIN_LABELS[d]), computed=X.fixed1(now), stored=X.fixed1(kept),
                ),
            )
        )
    return found


def follow_up_findings() -> list[Column]:
    score = F.col("residual_max_score")
    step = follow_up_step(
        [
            (~F.col("grade").isin(P.FOLLOW_UP_GRADES), None),
            (~F.col("residual_filled"), "F02.RESIDUAL_MISSING"),
            (score.isNull(), "F02.RESIDUAL_SCORE_MISSING"),
            ((score >= P.TREATMENT_THRESHOLD) & ~F.col("treatment_filled"), "F02.TREATMENT_MISSING"),
        ]
    )
    parts = {"grade": F.col("grade"), "score": X.general(score), "threshold": F.lit(P.TREATMENT_THRESHOLD)}
    return [
        when(step == code, finding(code, "f02", 5, **parts))
        for code in ("F02.RESIDUAL_MISSING", "F02.RESIDUAL_SCORE_MISSING", "F02.TREATMENT_MISSING")
    ]


# ---- F03 evidence ----------------------------------------------------------


def evidence_presence(items: DataFrame) -> DataFrame:
    done = items.filter(F.col("is_done"))
    row = F.col("row_index").cast("bigint") * 2
    return emit(
        done,
        when(
            F.col("evidence_proposal").isNull(),
            finding("F03.EVIDENCE_MISSING_PROPOSAL", "f03", 0, row, loc=F.col("loc")),
        ),
        when(
            F.col("evidence_golive").isNull(),
            finding("F03.EVIDENCE_MISSING_GOLIVE", "f03", 0, row + 1, loc=F.col("loc")),
        ),
    )


# ---- consistency between forms ---------------------------------------------


def _value_texts(values: DataFrame, order: str, out: str) -> DataFrame:
    return scan.join_ordered(values, [KEY], [order], scan.blocks(order, P.JOIN_BLOCK), F.col("value"), "、", out)


def comparison_findings(left: DataFrame, right: DataFrame, code: str, label: str, rule: int) -> DataFrame:
    """Two value lists of a bundle that share nothing, in one finding.

    ``left(key, row_index, value)`` is listed in row order; ``right(key,
    value)`` has one value per bundle.
    """
    left = left.filter(F.col("value").isNotNull())
    right = right.filter(F.col("value").isNotNull())
    bad = sets_overlap(left, right)
    texts = _value_texts(left.join(bad, KEY, "left_semi"), "row_index", "left")
    return emit(
        texts.join(right.select(KEY, F.col("value").alias("right")), KEY),
        finding("CROSS.MISMATCH", "cross", rule, code=code, label=F.lit(label), left=F.col("left"), right=F.col("right")),
    )


def internal_name_findings(sub_refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Sub-sheet references that match no project name of the main sheet.

    Each finding shows all of the main sheet's names, so its size is that of
    the names; the list itself is made once per bundle.
    """
    names = rows.filter(X.match_key(F.col("project_name")).isNotNull())
    # read for the bundles whose names are listed, and for the findings
    bad = merged(materialise(references_resolve(sub_refs, names, ref="corr_project_name", name="project_name")))
    distinct = (
        names.join(bad.select(KEY).distinct(), KEY, "left_semi")
        .groupBy(KEY, F.col("project_name").alias("value"))
        .agg(F.min("row_index").alias("row_index"))
    )
    shown = _value_texts(distinct, "row_index", "names")
    order = F.col("sheet_seq").cast("bigint") * (1 << 32) + F.col("row_index")
    return emit(
        bad.join(shown, KEY),
        finding(
            "CROSS.F01_INTERNAL_NAME", "cross", 2, order,
            sheet=F.col("sheet"), line=F.col("row_index"), name=F.col("corr_project_name"), names=F.col("names"),
        ),
    )


def cross_findings(f01_rows: DataFrame, sub_refs: DataFrame, identity: DataFrame, f02: DataFrame) -> DataFrame:
    owner = comparison_findings(
        f01_rows.select(KEY, "row_index", F.col("system_owner").alias("value")),
        identity.select(KEY, F.col("system_owner").alias("value")),
        "CROSS.OWNER_MISMATCH", P.OWNER_COMPARISON, 0,
    )
    unit = comparison_findings(
        f01_rows.select(KEY, "row_index", F.col("filing_unit").alias("value")),
        f02.select(KEY, F.col("filing_unit").alias("value")),
        "CROSS.UNIT_MISMATCH", P.UNIT_COMPARISON, 1,
    )
    return owner.unionByName(unit).unionByName(internal_name_findings(sub_refs, f01_rows))


# ---- regulation references of triggered questions --------------------------


def triggered_questions(answers: DataFrame, weights: DataFrame) -> DataFrame:
    """Triggered questions once each.  ``weights`` is a fixed small table."""
    scored = weights.select("q_seq", "qid", F.col("score_on").alias("answer")).distinct()
    return answers.join(F.broadcast(scored), ["qid", "answer"])


def question_refs(sections: DataFrame) -> DataFrame:
    """Display text and count of the sections of each question.

    ``sections(qid, pos, reg_code, section_path, title)``: at most a few per
    question, as the retrieval caps them.
    """
    shown = X.display_ref(F.col("reg_code"), F.col("section_path"))
    titled = F.when(
        F.coalesce(F.col("title"), F.lit("")) != "", F.concat(shown, F.lit("（"), F.col("title"), F.lit("）"))
    ).otherwise(shown)
    ordered = F.sort_array(F.collect_list(F.struct("pos", titled.alias("t"))))
    return sections.groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "、").alias("refs"), F.count(F.lit(1)).alias("cited")
    )


def triggered_refs(hits: DataFrame, sections: DataFrame) -> DataFrame:
    return emit(
        hits.join(question_refs(sections), "qid"),
        finding(
            "F02.REG_REF_NOTE", "references", 0, F.col("q_seq"),
            qid=F.col("qid"), answer=F.col("answer"), refs=F.col("refs"),
        ),
    )


def triggered_refs_summary(f02_bundles: DataFrame, hits: DataFrame, sections: DataFrame) -> DataFrame:
    """Always one summary per F02 bundle."""
    counts = (
        hits.join(question_refs(sections).select("qid", "cited"), "qid", "left")
        .groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("triggered"), F.sum(F.coalesce("cited", F.lit(0))).alias("cited"))
    )
    zero = F.lit(0)
    return emit(
        f02_bundles.select(KEY).join(counts, KEY, "left"),
        finding(
            "F02.REG_REF_SUMMARY", "references", 1,
            triggered=F.coalesce("triggered", zero), cited=F.coalesce("cited", zero),
        ),
    )


# ---- parse errors and all-clear --------------------------------------------


def lacking_sheet(kind: str, sheets: Column, expected: dict[str, list[tuple[str, str]]] | None = None) -> Column:
    """Error text of the first expected sheet that a form file lacks, or null."""
    expected = P.EXPECTED_SHEETS if expected is None else expected
    have = F.coalesce(sheets, F.array().cast("array<string>"))
    return follow_up_step([(~F.array_contains(have, s), text) for s, text in expected.get(kind, [])])


def parse_error_findings(forms: DataFrame, expected: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Winning form files that cannot be read or lack an expected sheet.

    ``forms(key, kind, sheets, readable, error)``.  The other forms of the
    bundle go on.
    """
    unreadable = ~F.coalesce(F.col("readable"), F.lit(True))
    found = []
    for i, kind in enumerate(("f01", "f02", "f03")):
        lacking = lacking_sheet(kind, F.col("sheets"), expected)
        why = F.when(unreadable, F.coalesce("error", F.lit(""))).otherwise(lacking)
        bad = (F.col("kind") == kind) & (unreadable | lacking.isNotNull())
        label = kind.upper()
        found.append(
            when(bad, finding("PARSE_ERROR", "parse", i, code=f"{label}.PARSE_ERROR", form=F.lit(label), error=why))
        )
        if kind == "f03":
            found.append(when(bad, finding("F03.CHECKLIST_PARSE_ERROR", "parse", i, 1, error=why)))
    return emit(forms, *found)


def readable_forms(forms: DataFrame, kind: str) -> DataFrame:
    """Forms of a kind that can be parsed."""
    own = forms.filter((F.col("kind") == kind) & F.coalesce(F.col("readable"), F.lit(True)))
    return own.filter(lacking_sheet(kind, F.col("sheets")).isNull())


def all_clear(bundles: DataFrame, findings: DataFrame, mode: str = "none", wording: str = "SUBMISSION.OK") -> DataFrame:
    """An OK row for bundles without findings (``none``) or without errors and
    warnings (``no_problem``)."""
    if mode not in ("none", "no_problem"):
        raise ValueError(f"unknown mode {mode!r}")
    blocking = findings if mode == "none" else findings.filter(F.col("severity").isin("error", "warn"))
    return emit(bundles.select(KEY).join(blocking.select(KEY), KEY, "left_anti"), finding(wording, "ok", 0))
