"""Cell grids -> typed form tables (PRJ)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.operators import scan
from sheaf.operators.scoring import answer_column

KEY = "bundle_id"


def pivot_rows(cells: DataFrame, columns: dict[str, str], keys: list[str], value: str = "value", tasks: int = 0) -> DataFrame:
    """One row per grid row, one cleaned column per wanted letter.

    The letters are a fixed list, so one aggregation with a map-side combine
    does it; a repeated cell keeps its greatest value.  A row without any value
    is no row; that shows once it is put together, so that each text is cleaned
    once, not for a filter as well.  Texts are put together by sorting, which
    takes memory in proportion to a task's rows: where the session shuffles into
    fewer than ``tasks`` parts, cells are dealt to as many.
    """
    cleaned = X.clean(F.col(value)).alias("__v")
    wanted = cells.filter(F.col("col").isin(list(columns))).select(*keys, "row", "col", cleaned)
    if tasks > int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        wanted = wanted.repartition(tasks, *keys, "row")
    rows = wanted.groupBy(*keys, "row").agg(
        *[F.max(F.when(F.col("col") == letter, F.col("__v"))).alias(name) for letter, name in columns.items()]
    )
    return rows.filter(reduce(or_, [F.col(name).isNotNull() for name in columns.values()]))


# ---- F01 -------------------------------------------------------------------


def f01_rows(
    cells: DataFrame, sheet: str = P.F01_SHEET, columns: dict[str, str] | None = None, start: int = P.F01_START_ROW, tasks: int = 0,
    keys: Sequence[str] = (KEY,),
) -> DataFrame:
    """Main-sheet rows with at least one filled column; ``tasks`` as in :func:`pivot_rows`."""
    columns = columns or P.F01_COLUMNS
    grid = cells.filter((F.col("sheet") == sheet) & (F.col("row") >= start))
    return pivot_rows(grid, columns, list(keys), tasks=tasks).withColumnRenamed("row", "row_index")


def f01_sub_refs(cells: DataFrame, sheets: list[tuple] | None = None, markers: list[str] | None = None) -> DataFrame:
    """Project names that sub-sheets point to, without blanks and placeholders."""
    sheets = P.F01_SUB_SHEETS if sheets is None else sheets
    markers = P.F01_PLACEHOLDERS if markers is None else markers
    place = F.lit(False)
    for name, letter, start in sheets:
        place = place | ((F.col("sheet") == name) & (F.col("col") == letter) & (F.col("row") >= start))
    value = X.clean(F.col("value"))
    hit = F.lit(False)
    for m in markers:
        hit = hit | X.casefold(F.col("corr_project_name")).contains(m.lower())
    order = F.lit(0)
    for i, (name, _, _) in enumerate(sheets):
        order = F.when(F.col("sheet") == name, F.lit(i)).otherwise(order)
    return (
        cells.filter(place)
        .select(
            KEY,
            "sheet",
            order.alias("sheet_seq"),
            F.col("row").alias("row_index"),
            value.alias("corr_project_name"),
        )
        .filter(F.col("corr_project_name").isNotNull() & ~hit)
    )


def f01_subject(rows: DataFrame) -> DataFrame:
    """Project name of each bundle's first row."""
    return rows.groupBy(KEY).agg(F.min_by("project_name", "row_index").alias("subject"))


# ---- F02 -------------------------------------------------------------------


def _answer_text(c: Column) -> Column:
    return F.replace(F.replace(F.upper(c), F.lit("是"), F.lit("Y")), F.lit("否"), F.lit("N"))


def norm_answer(c: Column) -> Column:
    """Y, N or null."""
    s = _answer_text(X.clean(c))
    return F.when(s.isin("Y", "N"), s)


def _answer_rows(cells: DataFrame, question_ids: list[str], sheet: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Question rows: number of the question, row and answer packed in one number.

    Texts become numbers at the cell, so a grid row is put together by a hash
    aggregation, and the greatest number of a question is its last row.  Each
    text is looked up once: a blank or any other one has no number, and rows
    without a question drop out when they are put together.
    """
    ids = sorted(question_ids)  # the greatest id of a row's cells counts, as in a pivot
    value = X.strip(F.col("value"))
    number = X.lookup_map({q: k for k, q in enumerate(ids)})
    code = X.lookup_map({"Y": 2, "N": 1})
    rows = cells.filter((F.col("sheet") == sheet) & F.col("col").isin("A", "C")).groupBy(*keys, "row").agg(
        F.max(F.when(F.col("col") == "A", number[value])).alias("__q"),
        F.max(F.when(F.col("col") == "C", code[_answer_text(value)])).alias("a"),
    )
    packed = F.col("row").cast("bigint") * 4 + F.coalesce("a", F.lit(0))
    return rows.filter(F.col("__q").isNotNull()).select(*keys, "__q", packed.alias("__last"))


def _unpack(last: Column) -> Column:
    return F.when(last % 4 == 2, "Y").when(last % 4 == 1, "N")


def f02_answers(cells: DataFrame, question_ids: list[str], sheet: str = P.ASSESS_SHEET) -> DataFrame:
    """Answer per question id (column A names it, column C answers it).

    A question may stand in several rows: the last row wins, also if blank.
    """
    last = _answer_rows(cells, question_ids, sheet).groupBy(KEY, "__q").agg(F.max("__last").alias("__last"))
    name = F.array(*[F.lit(q) for q in sorted(question_ids)])[F.col("__q")]
    return last.select(KEY, name.alias("qid"), _unpack(F.col("__last")).alias("answer"))


def f02_wide_answers(cells: DataFrame, question_ids: list[str], sheet: str = P.ASSESS_SHEET, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """The same answers, one row per bundle and one column per question."""
    rows = _answer_rows(cells, question_ids, sheet, keys)
    names = {k: answer_column(q) for k, q in enumerate(sorted(question_ids))}
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col("__q") == k, F.col("__last"))).alias(n) for k, n in names.items()])
    return wide.select(*keys, *[_unpack(F.col(answer_column(q))).alias(answer_column(q)) for q in question_ids])


def _at(sheet: str, row: int, col: str) -> Column:
    return (F.col("sheet") == sheet) & (F.col("row") == row) & (F.col("col") == col)


def fixed_cells(cells: DataFrame, spec: list[tuple] | None = None) -> DataFrame:
    """Named single cells of a bundle as columns."""
    spec = P.F02_FIXED_CELLS if spec is None else spec
    few = cells.filter(reduce(or_, [_at(s, r, c) for _, s, r, c in spec])).select(KEY, "sheet", "row", "col", X.clean(F.col("value")).alias("__v"))
    return few.groupBy(KEY).agg(*[F.max(F.when(_at(s, r, c), F.col("__v"))).alias(name) for name, s, r, c in spec])


def _cached() -> list[Column]:
    numbers = {d: X.to_number(F.col(d)) for d in P.DOMAINS}
    complete = reduce(and_, [n.isNotNull() for n in numbers.values()])
    return [
        *[F.when(complete, n).alias(f"cached_{d}") for d, n in numbers.items()],
        X.to_number(F.col("overall")).alias("cached_overall"),
        F.col("grade").alias("cached_grade"),
    ]


def cached_scores(fixed: DataFrame) -> DataFrame:
    """Stored percentages count only if all four are numbers."""
    return fixed.select(KEY, *_cached())


def _form_state(cells: DataFrame, spec: list[tuple], residual: str, header: str, treatment: str, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Fixed cells and the state of both follow-up sheets, from one pass over the grid.

    Cells are folded by (bundle, column) first, because which column of the
    residual sheet holds the scores shows only in its header: the leftmost that
    matches, shorter letters first, then by letter.
    """
    value = X.clean(F.col("value"))
    below = F.col("row") > 1
    head = (F.col("sheet") == residual) & (F.col("row") == 1) & (X.header_key(F.col("value")) == X.header_key(F.lit(header)))
    filled = (F.col("sheet") == residual) & below & ~F.coalesce(F.col("value").isin(P.MISSING_VALUES), F.lit(True))
    treated = (F.col("sheet") == treatment) & below & value.isNotNull()
    fixed = [_at(s, r, c) for _, s, r, c in spec]
    number = X.to_number(value)
    # says less than the places, but a source can be read by it: question rows are not
    near = F.col("sheet").isin(residual, treatment) | F.col("row").isin([r for _, _, r, _ in spec])
    wanted = cells.filter(near & reduce(or_, [*fixed, head, filled, treated]))
    by_column = wanted.groupBy(*keys, "col").agg(
        *[F.max(F.when(at, value)).alias(name) for at, (name, _, _, _) in zip(fixed, spec)],
        F.max(F.when(head, 1)).alias("__head"), F.max(F.when(filled, 1)).alias("__filled"), F.max(F.when(treated, 1)).alias("__treated"),
        F.max(F.when(filled & ~F.isnan(number), number)).alias("__max"),
    )
    place = F.struct(F.length("col").alias("n"), F.col("col").alias("c"), F.col("__max").alias("max"))
    return by_column.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name, _, _, _ in spec],
        F.min(F.when(F.col("__head") == 1, place))["max"].alias("residual_max_score"),
        F.coalesce(F.max("__filled") == 1, F.lit(False)).alias("residual_filled"),
        F.coalesce(F.max("__treated") == 1, F.lit(False)).alias("treatment_filled"),
    )


def residual_status(cells: DataFrame, sheet: str = P.RESIDUAL_SHEET, header: str = P.RESIDUAL_SCORE_HEADER) -> DataFrame:
    """Bundles whose sheet has rows below its header, and the score column's max."""
    state = _form_state(cells.filter(F.col("sheet") == sheet), [], sheet, header, "")
    return state.filter("residual_filled").select(KEY, "residual_filled", "residual_max_score")


def treatment_status(cells: DataFrame, sheet: str = P.TREATMENT_SHEET) -> DataFrame:
    """Whether anything stands below the header row."""
    grid = cells.filter((F.col("sheet") == sheet) & (F.col("row") > 1) & X.clean(F.col("value")).isNotNull())
    return grid.groupBy(KEY).agg(F.lit(True).alias("treatment_filled"))


def f02_forms(cells: DataFrame, f02_bundles: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """One row per F02 bundle: stored scores, uplift answers, follow-up status."""
    state = _form_state(cells, P.F02_FIXED_CELLS, P.RESIDUAL_SHEET, P.RESIDUAL_SCORE_HEADER, P.TREATMENT_SHEET, keys)
    typed = state.select(
        *keys, "filing_unit", *[norm_answer(F.col(f)).alias(f) for f in P.UPLIFT_FACTORS], *_cached(),
        "residual_filled", "residual_max_score", "treatment_filled",
    )
    return (
        f02_bundles.select(*keys)
        .join(typed, list(keys), "left")
        .withColumn("residual_filled", F.coalesce("residual_filled", F.lit(False)))
        .withColumn("treatment_filled", F.coalesce("treatment_filled", F.lit(False)))
    )


# ---- F03 -------------------------------------------------------------------


def f03_identity(cells: DataFrame, f03_bundles: DataFrame, sheet: str = P.F03_SHEET) -> DataFrame:
    """Owner cell without its placeholder, and whether the sheet exists."""
    row, col = P.F03_OWNER_CELL
    grid = cells.filter(F.col("sheet") == sheet)
    owner = F.max(F.when((F.col("row") == row) & (F.col("col") == col), X.clean(F.col("value"))))
    found = grid.groupBy(KEY).agg(owner.alias("__owner"), F.lit(True).alias("__sheet"))
    blank = [v.casefold() for v in P.F03_OWNER_PLACEHOLDERS]
    return f03_bundles.select(KEY).join(found, KEY, "left").select(
        KEY,
        F.when(~X.casefold(F.col("__owner")).isin(blank), F.col("__owner")).alias("system_owner"),
        F.coalesce("__sheet", F.lit(False)).alias("sheet_present"),
    )


def is_marked(c: Column) -> Column:
    s = X.clean(c)
    return s.isNotNull() & ~X.casefold(s).isin(P.UNMARKED_TOKENS)


def one_hot_label(marks: dict[str, Column]) -> Column:
    """Label of the only marked column; none or several marked give null."""
    flags = F.array(*[F.struct(F.lit(k).alias("label"), F.coalesce(m, F.lit(False)).alias("on")) for k, m in marks.items()])
    on = F.filter(flags, lambda x: x["on"])
    return F.when(F.size(on) == 1, on[0]["label"])


def f03_items(cells: DataFrame, sheet: str = P.F03_SHEET, start: int = P.F03_START_ROW) -> DataFrame:
    """Checklist rows; the lifecycle of a merged group is carried down first."""
    grid = cells.filter((F.col("sheet") == sheet) & (F.col("row") >= start))
    rows = pivot_rows(grid, P.F03_COLUMNS, [KEY])
    carried = scan.fill_forward(rows, [KEY], ["row"], scan.blocks("row"), F.col("lifecycle"), "__life")
    items = carried.filter(F.col("item_id").rlike(X.pattern(P.F03_ITEM_PATTERN)))
    state = one_hot_label({label: is_marked(F.col(c)) for c, label in P.CHECK_LABELS.items()})
    return with_item_columns(
        items.select(
            KEY,
            F.col("row").alias("row_index"),
            "item_id",
            F.col("__life").alias("lifecycle"),
            "topic",
            "description",
            state.alias("check_state"),
            "evidence_proposal",
            "evidence_golive",
            "regulation_ref_raw",
        )
    )


def item_loc(item: Column, topic: Column) -> Column:
    return F.concat(F.lit("項次 "), item, F.coalesce(F.concat(F.lit("（"), topic, F.lit("）")), F.lit("")))


def with_item_columns(items: DataFrame) -> DataFrame:
    """``is_done`` and ``loc``."""
    return items.withColumn("is_done", F.coalesce(F.col("check_state") == P.DONE_LABEL, F.lit(False))).withColumn(
        "loc", item_loc(F.col("item_id"), F.col("topic"))
    )


def canonical_items(cells: DataFrame, sheet: str = P.F03_SHEET, start: int = P.F03_START_ROW) -> DataFrame:
    """Checklist items of the official template (its first rows only)."""
    grid = cells.filter(
        (F.col("sheet") == sheet) & (F.col("row") >= start) & (F.col("row") < start + P.F03_TEMPLATE_ROWS)
    )
    rows = pivot_rows(grid, {"A": "item_id", "C": "topic", "D": "description", "L": "canonical_ref_raw"}, [KEY])
    return rows.filter(F.col("item_id").rlike(X.pattern(P.F03_ITEM_PATTERN))).withColumnRenamed("row", "row_index")


def question_texts(cells: DataFrame, question_ids: list[str], sheet: str = P.ASSESS_SHEET) -> DataFrame:
    """Question texts of the scored ids; the last row of an id wins."""
    first, last = P.F02_QUESTION_ROWS
    grid = cells.filter((F.col("sheet") == sheet) & F.col("row").between(first, last))
    rows = pivot_rows(grid, {"A": "qid", "B": "text"}, [KEY]).filter(F.col("qid").isin(question_ids))
    return rows.groupBy(KEY, "qid").agg(F.max_by(F.coalesce("text", F.lit("")), "row").alias("question_text"))


# ---- scoring rules from formulas -------------------------------------------


def _reference_values(cells: DataFrame) -> DataFrame:
    number = F.coalesce(X.to_number(X.clean(F.col("value"))), F.lit(0.0))
    ref = cells.filter((F.col("sheet") == P.REFERENCE_SHEET) & F.col("col").isin(list(P.REFERENCE_COLUMNS)))
    return ref.groupBy(KEY, F.col("row").alias("refrow")).agg(
        *[F.coalesce(F.max(F.when(F.col("col") == c, number)), F.lit(0.0)).alias(d) for c, d in P.REFERENCE_COLUMNS.items()]
    )


def extract_weights(cells: DataFrame) -> DataFrame:
    """Scoring answer and domain scores per question, read from its formula."""
    first, last = P.F02_QUESTION_ROWS
    grid = cells.filter((F.col("sheet") == P.ASSESS_SHEET) & F.col("row").between(first, last))
    rows = grid.groupBy(KEY, "row").agg(
        F.max(F.when(F.col("col") == "A", X.clean(F.col("value")))).alias("qid"),
        F.max(F.when(F.col("col") == "E", F.col("formula"))).alias("formula"),
    )
    rule = X.pattern(P.WEIGHT_FORMULA)
    parsed = rows.filter(F.col("qid").isNotNull() & F.col("formula").rlike(rule)).select(
        KEY,
        "row",
        "qid",
        F.regexp_extract("formula", rule, 1).alias("score_on"),
        F.regexp_extract("formula", rule, 2).try_cast("int").alias("refrow"),
    )
    return parsed.join(_reference_values(cells), [KEY, "refrow"], "left").select(
        KEY, F.col("row").alias("q_seq"), "qid", "score_on", *[F.coalesce(d, F.lit(0.0)).alias(d) for d in P.DOMAINS]
    )


def extract_factors(cells: DataFrame) -> DataFrame:
    """Uplift multipliers and domain denominators, read from formulas."""
    named = {row: name for name, s, row, c in P.F02_FIXED_CELLS if name.startswith("factor")}
    rule = X.pattern(P.FACTOR_FORMULA)
    factors = cells.filter(
        (F.col("sheet") == P.ASSESS_SHEET) & (F.col("col") == "E") & F.col("row").isin(list(named))
    ).select(
        KEY,
        X.lookup_map({str(k): v for k, v in named.items()})[F.col("row").cast("string")].alias("name"),
        F.regexp_extract("formula", rule, 1).try_cast("int").alias("refrow"),
    )
    values = _reference_values(cells)
    multipliers = factors.join(values.select(KEY, "refrow", "finance"), [KEY, "refrow"], "left").select(
        KEY, F.lit("multiplier").alias("what"), "name", F.coalesce("finance", F.lit(0.0)).alias("value")
    )
    totals = values.filter(F.col("refrow") == P.DENOMINATOR_ROW)
    denominators = totals.select(
        KEY, F.inline(F.array(*[F.struct(F.lit("denominator").alias("what"), F.lit(d).alias("name"), F.col(d).alias("value")) for d in P.DOMAINS]))
    )
    return multipliers.unionByName(denominators)
