"""Judge data flow: targets, batches, prompts, verdicts, findings (JDG).

The judge is a callable ``prompt -> response text``.  Items per bundle are
capped before batching, so everything after ``cap_items`` is short per bundle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.functions.findings import emit, finding, when
from sheaf.functions.session import materialise

KEY = "bundle_id"
Judge = Callable[[str], str]


# ---- targets and batches ---------------------------------------------------

# evidence texts with the columns that say whether there is one, and the size of both as JSON
_GIVEN, _SIZE = {"evidence_proposal": "proposal_given", "evidence_golive": "golive_given"}, "evidence_size"


def judge_targets(items: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Items with any evidence, and, if given, with an entry in the map.

    Which evidence texts there are, and how long they are in a payload, is noted
    before anything is shuffled: what needs no more of them, as :func:`verdict_rows`
    and token counts, takes no text through the shuffles.
    """
    some = items.filter(F.col("evidence_proposal").isNotNull() | F.col("evidence_golive").isNotNull())
    some = some.withColumns({**{mark: F.col(c).isNotNull() for c, mark in _GIVEN.items()}, _SIZE: _size(_evidence_json())})
    return some if canonical is None else some.join(canonical.select("item_id").distinct(), "item_id", "left_semi")


def cap_items(targets: DataFrame, n: int = P.MAX_ITEMS, key: str = KEY, order: str = "row_index") -> tuple[DataFrame, DataFrame]:
    """The first ``n`` items of each bundle with ``pos`` from 0, and the number cut off.

    The limit also applies before the shuffle, so a hot bundle sends at most
    ``n`` rows per task.
    """
    place = Window.partitionBy(key).orderBy(order)
    kept = targets.withColumn("pos", F.row_number().over(place)).filter(F.col("pos") <= n)
    total = targets.groupBy(key).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("truncated"))
    return kept.withColumn("pos", F.col("pos") - 1), total


def assign_batches(capped: DataFrame, size: int) -> DataFrame:
    return capped.withColumn("batch_no", F.floor(F.col("pos") / max(1, int(size))).cast("int"))


def payload_tokens(payload: Column, n_sections: Column | None = None) -> Column:
    """Token estimate of a payload text written with blanks after separators."""
    return _size_tokens(_size(payload), n_sections)


def _size(json: Column) -> Column:
    return F.struct(F.length(F.regexp_replace(json, "[^一-鿿　-ヿ]", "")).alias("wide"), F.length(json).alias("length"))


def _size_tokens(size: Column, n_sections: Column | None = None) -> Column:
    """Token estimate of a compliance payload out of its size.

    ``to_json`` writes no blanks, so those of its known shape are added: nine
    for the five fields, seven per section and one between sections.
    """
    n = F.lit(0) if n_sections is None else n_sections
    blanks = 9 + 7 * n + F.greatest(n - 1, F.lit(0))
    return size["wide"] + F.floor((size["length"] - size["wide"] + blanks) / 4)


def _joined_size(head: Column, tail: Column) -> Column:
    # of two braces that meet, one comma is left
    return F.struct((head["wide"] + tail["wide"]).alias("wide"), (head["length"] + tail["length"] - 1).alias("length"))


def _joined_json(head: Column, tail: Column) -> Column:
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substr(tail, F.lit(2)))


def _evidence_json() -> Column:
    return F.to_json(
        F.struct(
            _or(F.col("evidence_proposal"), P.BLANK_EVIDENCE).alias("proposal"), _or(F.col("evidence_golive"), P.BLANK_EVIDENCE).alias("golive")
        )
    )


def _evidence_size(targets: DataFrame) -> Column:
    return F.col(_SIZE) if _SIZE in targets.columns else _size(_evidence_json())


def template_tokens(template: str) -> int:
    """Token estimate of a fixed text."""
    wide = len(re.findall("[一-鿿　-ヿ]", template))
    return wide + (len(template) - wide) // 4


def split_over_budget(batched: DataFrame, tokens: str = "tokens", overhead: int = 0, budget: int = P.PROMPT_BUDGET, key: str = KEY) -> DataFrame:
    """Batches of several items over the budget become one batch per item.

    Batches are renumbered in order.  Items per bundle were capped before, so
    the per-bundle window is short.
    """
    whole = Window.partitionBy(key, "batch_no")
    heavy = (F.count(F.lit(1)).over(whole) > 1) & (F.sum(tokens).over(whole) + overhead > budget)
    sub = batched.withColumn("__sub", F.when(heavy, F.col("pos")).otherwise(F.lit(-1)))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("batch_no", "__sub")) - 1
    return sub.withColumn("batch_no", number).drop("__sub")


# ---- payloads and prompts --------------------------------------------------


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def evidence_payloads(targets: DataFrame) -> DataFrame:
    """Evidence payload per item and its tokens, which are counted by part: no text is needed for them after :func:`judge_targets`."""
    head = F.to_json(F.struct(F.col("item_id"), _or(F.col("description"), P.NOT_PROVIDED).alias("description")))
    size = _joined_size(_size(head), _evidence_size(targets))
    return targets.withColumns(
        {"payload": _joined_json(head, _evidence_json()), "tokens": size["wide"] + F.floor((size["length"] - size["wide"]) / 4)}
    )


def payloads(targets: DataFrame, canonical: DataFrame, n: int = P.MAX_SECTIONS, chars: int = P.EXCERPT_CHARS) -> DataFrame:
    """Compliance payload per item, with how much the caps dropped or clipped.

    ``canonical(item_id, canonical_description, canonical_ref_raw, sections)``.
    """
    # the canonical part of a payload is made and counted before the join, so whole excerpts are not
    # shuffled, and what reads no payload shuffles no excerpts at all
    some = F.slice("sections", 1, n)
    shown = F.transform(
        some,
        lambda s: F.struct(
            s["reg_code"].alias("reg_code"), s["section_path"].alias("section_path"), s["title"].alias("title"),
            F.substring(s["excerpt"], 1, chars).alias("excerpt"),
        ),
    )
    head = F.to_json(F.struct(F.col("item_id"), _or(F.col("canonical_description"), P.NOT_PROVIDED).alias("description"), shown.alias("sections")))
    known = canonical.select(
        "item_id", "canonical_description", "canonical_ref_raw", head.alias("__head"), _size(head).alias("__size"), F.size(some).alias("__n"),
        F.transform(some, lambda s: X.display_ref(s["reg_code"], s["section_path"])).alias("refs"),
        (F.size("sections") - F.size(some)).alias("dropped"),
        F.size(F.filter(some, lambda s: F.length(s["excerpt"]) > chars)).alias("clipped"),
    )
    size = _joined_size(F.col("__size"), _evidence_size(targets))
    out = (
        targets.join(known, "item_id")
        .withColumns({"payload": _joined_json(F.col("__head"), _evidence_json()), "tokens": _size_tokens(size, F.col("__n"))})
        .drop("__head", "__size", "__n")
    )
    counts = ["dropped", "clipped", "refs"]
    return out.select(*[c for c in out.columns if c not in counts], *counts)


def verdict_rows(batched: DataFrame) -> DataFrame:
    """Batched items for the joins with their answers.

    Payloads and evidence texts stay behind, as prompts hold them already: of an
    evidence text only whether there is one, as an empty text.  Marks of
    :func:`judge_targets` tell it without the texts, so these do not go through the
    shuffles that batched the items either.
    """
    given = {c: F.col(mark) if mark in batched.columns else F.col(c).isNotNull() for c, mark in _GIVEN.items() if c in batched.columns}
    return batched.drop("payload").withColumns({c: F.when(there, F.lit("")) for c, there in given.items()}).drop(*_GIVEN.values(), _SIZE)


def template_drift(targets: DataFrame, canonical: DataFrame) -> DataFrame:
    """Uploaded reference or description that differs from the template's.

    A blank upload is not compared.
    """
    known = canonical.select(
        "item_id", F.col("canonical_ref_raw").alias("__ref"), F.col("canonical_description").alias("__desc")
    )
    keyed = targets.join(known, "item_id").select(
        KEY, "item_id", "loc", "row_index",
        X.template_key(F.col("regulation_ref_raw")).alias("r"), X.template_key(F.col("__ref")).alias("rc"),
        X.template_key(F.col("description")).alias("d"), X.template_key(F.col("__desc")).alias("dc"),
    )
    changed = ((F.col("r") != "") & (F.col("r") != F.col("rc"))) | ((F.col("d") != "") & (F.col("d") != F.col("dc")))
    return emit(
        keyed.filter(changed),
        finding("F03.TEMPLATE_REF_MODIFIED", "compliance", 0, F.col("row_index"), item=F.col("item_id"), loc=F.col("loc")),
    )


def prompts(batched: DataFrame, template: str = "{items_json}", key: str = KEY) -> DataFrame:
    """One prompt per batch; the template's ``{items_json}`` takes the payloads."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "payload"))), lambda p: p["payload"])
    listed = F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]"))
    per_batch = batched.groupBy(key, "batch_no").agg(listed.alias("items_json"), F.count(F.lit(1)).alias("n_items"))
    before, _, after = template.partition("{items_json}")
    return per_batch.select(key, "batch_no", "n_items", F.concat(F.lit(before), "items_json", F.lit(after)).alias("prompt"))


# ---- the call --------------------------------------------------------------


class JudgeError(RuntimeError):
    """What a judge raises when the endpoint failed or its answer is unusable."""


_NOT_CALLED = "not called"
# files that the prompts of a wave are spread over
_WAVE_FILES = 16


def run_judge(
    prompt_rows: DataFrame, judge: Judge, stop_after: int | None = P.BREAKER_RUN, key: str = KEY,
    own_errors: tuple[type[Exception], ...] = (Exception,), ledger: str | None = None, calls_per_commit: int = P.CALLS_PER_COMMIT,
) -> DataFrame:
    """Calls the judge once per batch: (key, batch_no, response, error, fatal).

    A failed call is data, not a failed job: its ``error`` is the type's name.
    One of ``own_errors`` fails its batch; any other exception is ``fatal`` and
    ends the calls of its bundle, whose other answers :func:`isolated` leaves
    out.  With ``stop_after`` the batches of a bundle are called in order and
    calls end after that many failed calls in a row; batches not called have the
    error ``not called``.

    ``ledger`` is a folder in which calls are kept by key, batch and hash of the
    prompt.  Calls that it holds are not made again, whatever job made them;
    fatal ones are.  Calls are committed to it in waves of about
    ``calls_per_commit``, so a job that ends early loses one wave at most.  What the
    ledger holds is read when the job begins.
    """
    k = prompt_rows.schema[key].dataType.simpleString()
    schema = f"{key} {k}, batch_no int, prompt_sha string, response string, error string, fatal boolean, called boolean"
    columns = [c.split()[0] for c in schema.split(", ")]

    def call(row) -> tuple[str | None, str | None, bool, bool]:
        if row.known:
            return row.response, row.error, False, False
        try:
            return judge(row.prompt), None, False, True
        except own_errors as exc:
            return None, type(exc).__name__, False, True
        except Exception as exc:
            return None, type(exc).__name__, True, True

    def one_bundle(rows: pd.DataFrame) -> pd.DataFrame:
        out, run, over = [], 0, False
        for row in rows.sort_values("batch_no").itertuples():
            stop = over or (stop_after is not None and run >= stop_after)
            response, error, fatal, called = (None, _NOT_CALLED, False, False) if stop else call(row)
            over |= fatal
            run = 0 if error is None and "{" in (response or "") else run + 1
            out.append((getattr(row, key), row.batch_no, row.prompt_sha, response, error, fatal, called))
        return pd.DataFrame(out, columns=columns)

    def each(frames):
        for frame in frames:
            answers = [call(row) for row in frame.itertuples()]
            yield pd.DataFrame([(getattr(r, key), r.batch_no, r.prompt_sha, *a) for r, a in zip(frame.itertuples(), answers)], columns=columns)

    def called(rows: DataFrame) -> DataFrame:
        # batches per bundle are bounded by the item cap
        return rows.mapInPandas(each, schema) if stop_after is None else rows.groupBy(key).applyInPandas(one_bundle, schema)

    rows = prompt_rows.select(key, "batch_no", "prompt", F.sha2("prompt", 256).alias("prompt_sha"))
    answers = [key, "batch_no", "response", "error", "fatal"]
    none = F.lit(None).cast("string")
    if ledger is None:
        return called(rows.select("*", F.lit(False).alias("known"), none.alias("response"), none.alias("error"))).select(*answers)

    spark, run_id = prompt_rows.sparkSession, uuid.uuid4().hex
    rows = materialise(rows)
    calls = [key, "batch_no", "prompt_sha"]
    waves = max(1, -(-rows.count() // calls_per_commit))
    kept = f"{schema}, run_id string"
    spark.createDataFrame([], kept).write.mode("append").partitionBy("run_id").parquet(ledger)  # an empty one can be read
    made = spark.read.schema(kept).parquet(ledger).filter("called AND NOT fatal")
    made = made.groupBy(*calls).agg(F.min(F.struct("response", "error")).alias("a"), F.lit(True).alias("known"))
    # a bundle is in one wave, so no wave needs what another one writes: the ledger is read once, and each wave reads its own folder
    own = rows.join(made, calls, "left").select(
        key, "batch_no", "prompt", "prompt_sha", F.coalesce("known", F.lit(False)).alias("known"), "a.response", "a.error",
        F.pmod(F.xxhash64(key), F.lit(waves)).alias("__wave"),
    )
    own = materialise(own.repartition("__wave", F.pmod(F.xxhash64(*calls), F.lit(_WAVE_FILES))), "__wave")
    for wave in range(waves):
        asked = own.filter(F.col("__wave") == wave).drop("__wave")
        called(asked).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(ledger)
    return spark.read.schema(kept).parquet(ledger).filter(F.col("run_id") == run_id).select(*answers)


def isolated(answers: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(answers of the other bundles, (key, error) of each bundle with a fatal call)."""
    broken = answers.filter("fatal").groupBy(key).agg(F.min("error").alias("error"))
    return answers.join(broken, key, "left_anti").drop("fatal"), broken


# ---- responses -------------------------------------------------------------


def parse_response(c: Column) -> Column:
    """``results`` elements as JSON texts, or null if the response is unusable.

    The whole text, else the text from its first ``{``, must be an object with
    a ``results`` list.  Prose and code fences around it are tolerated.
    """
    text = X.strip(c)
    inner = F.get_json_object(F.concat(F.lit('{"a":'), text, F.lit("}")), "$.a")
    other_json = inner.isNotNull() & ~text.startswith("{")
    parsed = F.from_json(
        F.regexp_extract(text, r"(?s)(\{.*)", 1), "results array<string>", {"allowSingleQuotes": "false"}
    )["results"]
    return F.when(~F.coalesce(other_json, F.lit(False)), parsed)


def explode_results(responses: DataFrame, key: str = KEY) -> DataFrame:
    """One verdict per (key, batch, item id); the last of duplicates wins."""
    parts = responses.select(key, "batch_no", F.posexplode(parse_response(F.col("response"))).alias("p", "raw"))
    named = parts.withColumn("item_id", X.strip(F.get_json_object("raw", "$.item_id"))).filter(
        F.col("item_id").isNotNull()
    )
    return named.groupBy(key, "batch_no", "item_id").agg(F.max_by("raw", "p").alias("raw"))


def circuit_breaker(outcomes: DataFrame, n: int = P.BREAKER_RUN, key: str = KEY, order: str = "batch_no") -> DataFrame:
    """Where the ``n``-th failure in a row first happens: (key, cut).

    ``outcomes(key, order, failed)`` with a gapless integer order.  A run of
    ``n`` failures ends at a position if that position and the ``n - 1``
    before it failed; each failure votes for the ``n`` positions it can
    belong to, so no ordered window over the group is needed.
    """
    votes = outcomes.filter("failed").select(
        key, F.explode(F.sequence(F.col(order), F.col(order) + (n - 1))).alias("cut")
    )
    ends = votes.groupBy(key, "cut").agg(F.count(F.lit(1)).alias("v")).filter(F.col("v") == n)
    return ends.groupBy(key).agg(F.min("cut").alias("cut"))


def judged_items(batched: DataFrame, responses: DataFrame, breaker: int = P.BREAKER_RUN, key: str = KEY) -> DataFrame:
    """Each item with its verdict text and status.

    ``judged``, ``missing`` (batch answered without it), ``failed`` (batch
    failed), ``aborted`` (in the batch that trips the breaker), ``unsent``.
    """
    parsed = responses.withColumn("__failed", F.col("error").isNotNull() | parse_response(F.col("response")).isNull())
    outcomes = parsed.select(key, "batch_no", F.col("__failed").alias("failed"))
    cuts = circuit_breaker(outcomes, breaker, key)
    verdicts = explode_results(responses.filter(F.col("error").isNull()), key)
    joined = (
        batched.join(outcomes, [key, "batch_no"], "left")
        .join(verdicts, [key, "batch_no", "item_id"], "left")
        .join(cuts, key, "left")
    )
    status = (
        F.when(F.col("batch_no") > F.col("cut"), "unsent")
        .when(F.col("batch_no") == F.col("cut"), "aborted")
        .when(F.coalesce("failed", F.lit(True)), "failed")
        .when(F.col("raw").isNull(), "missing")
        .otherwise("judged")
    )
    return joined.withColumn("status", status).drop("failed")


def _get(path: str) -> Column:
    return F.get_json_object("raw", f"$.{path}")


def _truthy(path: str) -> Column:
    """Whether a member of a JSON object counts as true: any text but the empty one does, "false" too."""
    parent, name = path.rsplit(".", 1)
    text = _get(parent).rlike(rf'[{{,]\s*"{name}"\s*:\s*"[^"]')
    return F.coalesce(text, F.lit(False)) | F.coalesce(~_get(path).isin("false", "0", "0.0", "-0.0", "", "null", "[]", "{}"), F.lit(False))


def _said(path: str, default: str) -> Column:
    return _or(_get(path), default)


# ---- findings --------------------------------------------------------------


def missing_verdicts(judged: DataFrame, wording: str, stage: str) -> DataFrame:
    rows = judged.filter(F.col("status") == "missing")
    return emit(rows, finding(wording, stage, 1, _order(), loc=F.col("loc")))


def _order(sub: int = 0) -> Column:
    # positions go through the batches of a bundle
    return F.col("pos").cast("bigint") * 10 + sub


def failed_batches(judged: DataFrame, wording: str, code: str, stage: str) -> DataFrame:
    """One finding per failed batch that did not trip the breaker."""
    locs = F.sort_array(F.collect_list(F.struct("pos", "loc")))
    rows = (
        judged.filter(F.col("status") == "failed")
        .groupBy(KEY, "batch_no")
        .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), F.transform(locs, lambda x: x["loc"]).alias("locs"))
    )
    return emit(
        rows,
        finding(wording, stage, 1, _order(), code=code, n=F.col("n"), locs=F.array_join("locs", "、"), loc=F.col("locs")[0]),
    )


def aborted_reviews(judged: DataFrame, wording: str, stage: str, run: int = P.BREAKER_RUN) -> DataFrame:
    """The breaker's own finding, one per aborted bundle."""
    rows = (
        judged.groupBy(KEY)
        .agg(
            F.count_if(F.col("status") == "judged").alias("reviewed"),
            F.min_by("loc", F.when(F.col("status") == "aborted", F.col("pos"))).alias("loc"),
            F.max("cut").alias("batch_no"),
            F.min(F.when(F.col("status") == "aborted", F.col("pos"))).alias("pos"),
        )
        .filter(F.col("batch_no").isNotNull())
    )
    return emit(rows, finding(wording, stage, 1, _order(), run=F.lit(run), reviewed=F.col("reviewed"), loc=F.col("loc")))


def evidence_findings(judged: DataFrame) -> DataFrame:
    """Difference and vagueness verdicts as findings."""
    rows = judged.filter(F.col("status") == "judged")
    loc = F.col("loc")
    return emit(
        rows,
        when(_truthy("difference.flag"), finding("F03.LLM_DIFF", "evidence", 1, _order(1), text=_said("difference.summary", P.DIFF_DEFAULT), loc=loc)),
        when(_truthy("proposal.vague"), finding("F03.LLM_VAGUE_PROPOSAL", "evidence", 1, _order(2), text=_said("proposal.reason", P.VAGUE_DEFAULT), loc=loc)),
        when(_truthy("golive.vague"), finding("F03.LLM_VAGUE_GOLIVE", "evidence", 1, _order(3), text=_said("golive.reason", P.VAGUE_DEFAULT), loc=loc)),
    )


def whitelist(c: Column, allowed: list[str], default: str) -> Column:
    s = X.strip(c)
    return F.when(s.isin(allowed), s).otherwise(F.lit(default))


def verdict() -> Column:
    return whitelist(_get("verdict"), P.VERDICTS, "undetermined")


def cited_refs(returned: Column, canonical: Column) -> Column:
    """Returned references that are canonical, in canonical order; none: all."""
    mark = "\x01"

    def keys(a: Column) -> Column:
        joined = F.array_join(F.transform(a, lambda x: F.coalesce(x, F.lit("None"))), mark)
        return F.transform(F.split(X.nfkc(joined), mark), X.squeeze)

    given = F.coalesce(returned, F.array().cast("array<string>"))
    # the wanted keys ride along with each reference: a lambda body may not
    # contain the Python normaliser
    paired = F.arrays_zip(
        canonical.alias("ref"), keys(canonical).alias("key"), F.array_repeat(keys(given), F.size(canonical)).alias("wanted")
    )
    hit = F.transform(F.filter(paired, lambda p: F.array_contains(p["wanted"], p["key"])), lambda p: p["ref"])
    some = (F.size(given) > 0) & (F.size(hit) > 0)
    return F.when(some, hit).otherwise(canonical)


def with_compliance(judged: DataFrame) -> DataFrame:
    """Verdict, reason and cited references of judged items.

    Needs ``refs``: the display texts of the item's canonical sections.
    """
    returned = F.from_json(_get("gap_refs"), "array<string>")
    reason = X.strip(F.coalesce(_get("reason"), F.lit("")))
    judged_row = F.col("status") == "judged"
    return (
        judged.withColumn("verdict", F.when(judged_row, verdict()))
        .withColumn("reason", F.when(judged_row, reason))
        .withColumn("cited", cited_refs(returned, F.col("refs")))
    )


def compliance_findings(compliance: DataFrame) -> DataFrame:
    """Gap and undetermined verdicts as findings; covered gives none."""
    note = F.when(F.col("reason") != "", X.fill("（{r}）", r=F.col("reason"))).otherwise(F.lit(""))
    return emit(
        compliance.filter(F.col("status") == "judged"),
        when(F.col("verdict") == "gap", finding("F03.RAG_GAP", "compliance", 1, _order(), refs=F.array_join("cited", "、"), reason=note, loc=F.col("loc"))),
        when(F.col("verdict") == "undetermined", finding("F03.RAG_UNDETERMINED", "compliance", 1, _order(), reason=note, loc=F.col("loc"))),
    )


# ---- summary tables --------------------------------------------------------


def _shown(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("status").isin("judged", "missing", "failed"))


def _dash(c: Column) -> Column:
    return F.coalesce(c, F.lit(P.CELL_EMPTY))


def evidence_cells(judged: DataFrame) -> DataFrame:
    def warn(path: str, default: str) -> Column:
        said = X.clip(_said(path, default), P.CELL_CHARS)
        return F.concat(F.lit(P.CELL_WARN + " "), F.coalesce(said, F.lit(default)))

    def evidence(text: str, part: str) -> Column:
        filled = F.when(F.col(text).isNotNull(), P.CELL_OK).otherwise(P.CELL_EMPTY)
        return F.when(_truthy(f"{part}.vague"), warn(f"{part}.reason", P.VAGUE_CELL_DEFAULT)).otherwise(filled)

    ok = F.col("status") == "judged"
    diff = F.when(_truthy("difference.flag"), warn("difference.summary", P.DIFF_CELL_DEFAULT)).otherwise(P.CELL_EMPTY)
    empty = F.lit(P.CELL_EMPTY)
    return _shown(judged).select(
        KEY, "batch_no", "pos", "item_id", _dash(F.col("topic")).alias("topic"),
        F.array(
            F.when(ok, diff).otherwise(F.lit(P.CELL_FAILED)),
            F.when(ok, evidence("evidence_proposal", "proposal")).otherwise(empty),
            F.when(ok, evidence("evidence_golive", "golive")).otherwise(empty),
        ).alias("cells"),
    )


def compliance_cells(compliance: DataFrame) -> DataFrame:
    ok = F.col("status") == "judged"
    refs = F.when(F.size("cited") > 0, F.array_join("cited", "；")).otherwise(F.lit(P.CELL_EMPTY))
    return _shown(compliance).select(
        KEY, "batch_no", "pos", "item_id", _dash(F.col("topic")).alias("topic"),
        F.array(
            F.when(ok, X.lookup_map(P.VERDICT_CELLS)[F.col("verdict")]).otherwise(F.lit(P.CELL_FAILED)),
            F.when(ok, refs).otherwise(F.lit(P.CELL_EMPTY)),
        ).alias("cells"),
    )


def verdict_table(cells: DataFrame, header: list[str], wording: str, stage: str) -> DataFrame:
    """A pipe table of all shown items of a bundle, as one finding."""
    row = F.concat(F.array("item_id", "topic"), F.col("cells"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(row, X.table_cell), " | "), F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("batch_no", "pos", line.alias("line")))), lambda x: x["line"])
    head = "| " + " | ".join(header) + " |\n| " + " | ".join("---" for _ in header) + " |\n"
    tables = cells.groupBy(KEY).agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("table"))
    return emit(tables, finding(wording, stage, 2, table=F.col("table")))


def judge_counts(judged: DataFrame, truncated: DataFrame) -> DataFrame:
    """Per bundle: reviewed, errors, truncated, aborted, and verdict counts."""
    error = F.col("status").isin("missing", "failed", "aborted")
    counts = [
        F.count_if(F.col("status") == "judged").alias("reviewed"),
        F.count_if(error).alias("errors"),
        F.max(F.col("cut").isNotNull()).alias("aborted"),
    ]
    if "verdict" in judged.columns:
        counts += [F.count_if(F.col("verdict") == v).alias(v) for v in P.VERDICTS]
    else:
        flags = [_truthy(p).cast("int") for p in ("difference.flag", "proposal.vague", "golive.vague")]
        counts.append(F.sum(F.when(F.col("status") == "judged", flags[0] + flags[1] + flags[2]).otherwise(0)).alias("flagged"))
    return judged.groupBy(KEY).agg(*counts).join(truncated, KEY, "left")


def _notes(cut_text: Column) -> Column:
    parts = F.array(
        F.when(F.col("errors") > 0, X.fill("{n} 項判讀失敗", n=F.col("errors"))),
        F.when(F.col("truncated") > 0, cut_text),
        F.when(F.col("aborted"), F.lit("端點異常已中止")),
    )
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "；")
    return F.when(joined != "", X.fill("（{j}）", j=joined)).otherwise(F.lit(""))


def evidence_summary(counts: DataFrame, limit: int = P.MAX_ITEMS) -> DataFrame:
    cut = X.fill("超過單次上限 {limit}，未送審 {n} 項", limit=F.lit(limit), n=F.col("truncated"))
    return emit(
        counts,
        finding("F03.LLM_SUMMARY", "evidence", 3, reviewed=F.col("reviewed"), flagged=F.col("flagged"), notes=_notes(cut)),
    )


def compliance_summary(counts: DataFrame) -> DataFrame:
    cut = X.fill("未送審 {n} 項", n=F.col("truncated"))
    return emit(
        counts,
        finding(
            "F03.RAG_SUMMARY", "compliance", 3,
            reviewed=F.col("reviewed"), gaps=F.col("gap"), undetermined=F.col("undetermined"), notes=_notes(cut),
        ),
    )


# ---- whole reviews ---------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evidence_review(
    items: DataFrame, judge: Judge, template: str, max_items: int = P.MAX_ITEMS, batch: int = P.EVIDENCE_BATCH, ledger: str | None = None
) -> DataFrame:
    """All findings of the evidence judge.

    A :class:`JudgeError` fails its batch.  Any other exception of the judge
    skips the bundle it happened in: one ``F03.LLM_SKIPPED`` finding instead of
    its others, which no other bundle notices.
    """
    capped, truncated = cap_items(judge_targets(items), max_items)
    batched = assign_batches(evidence_payloads(capped), batch)
    # neither the calls nor the joins repeat for each table made from them
    answers = materialise(run_judge(prompts(batched, template), judge, own_errors=(JudgeError,), ledger=ledger))
    return evidence_answered(batched, answers, truncated, max_items)


def evidence_answered(batched: DataFrame, answers: DataFrame, truncated: DataFrame, max_items: int = P.MAX_ITEMS) -> DataFrame:
    """Findings from the answers of :func:`run_judge`, bundle by bundle."""
    good, broken = isolated(answers)
    judged = materialise(judged_items(verdict_rows(batched).join(broken, KEY, "left_anti"), good))
    skipped = emit(broken, finding("F03.LLM_SKIPPED", "evidence", 0, error=F.col("error")))
    return evidence_outcome(judged, truncated, max_items).unionByName(skipped)


def evidence_outcome(judged: DataFrame, truncated: DataFrame, max_items: int = P.MAX_ITEMS) -> DataFrame:
    return _union(
        [
            evidence_findings(judged),
            missing_verdicts(judged, "F03.LLM_ITEM_ERROR", "evidence"),
            failed_batches(judged, "F03.LLM_BATCH_ERROR", "F03.LLM_ITEM_ERROR", "evidence"),
            aborted_reviews(judged, "F03.LLM_ERROR", "evidence"),
            verdict_table(evidence_cells(judged), P.EVIDENCE_HEADER, "F03.LLM_TABLE", "evidence"),
            evidence_summary(judge_counts(judged, truncated), max_items),
        ]
    )


def compliance_review(
    items: DataFrame, canonical: DataFrame, judge: Judge, template: str,
    max_items: int = P.MAX_ITEMS, batch: int = P.COMPLIANCE_BATCH, overhead: int | None = None, ledger: str | None = None,
) -> DataFrame:
    """All findings of the compliance judge; any exception of it fails its batch.

    ``overhead`` is what the prompt costs besides its payloads; the template's own tokens by default.
    """
    overhead = template_tokens(template) if overhead is None else overhead
    capped, truncated = cap_items(judge_targets(items, canonical), max_items)
    batched = split_over_budget(assign_batches(payloads(capped, canonical), batch), overhead=overhead)
    answers = materialise(run_judge(prompts(batched, template), judge, ledger=ledger)).drop("fatal")
    judged = materialise(with_compliance(judged_items(verdict_rows(batched), answers)))
    return template_drift(capped, canonical).unionByName(compliance_outcome(judged, truncated))


def compliance_outcome(compliance: DataFrame, truncated: DataFrame) -> DataFrame:
    return _union(
        [
            compliance_findings(compliance),
            missing_verdicts(compliance, "F03.RAG_ITEM_ERROR", "compliance"),
            failed_batches(compliance, "F03.RAG_BATCH_ERROR", "F03.RAG_ITEM_ERROR", "compliance"),
            aborted_reviews(compliance, "F03.RAG_ERROR", "compliance"),
            verdict_table(compliance_cells(compliance), P.COMPLIANCE_HEADER, "F03.RAG_TABLE", "compliance"),
            compliance_summary(judge_counts(compliance, truncated)),
        ]
    )


def optional_branch(
    enabled: bool, bundles: DataFrame, fn: Callable[[], DataFrame], skipped: str, stage: str, code: str | None = None
) -> DataFrame | None:
    """Findings of a branch that must never break the review.

    Off: no findings.  A branch that cannot be set up gives one ``skipped``
    finding per bundle, under ``code`` if given; the other checks are unaffected.
    What fails inside a branch for one bundle is that bundle's alone, see
    :func:`evidence_review`.
    """
    if not enabled:
        return None
    try:
        return fn()
    except Exception as exc:
        return emit(bundles, finding(skipped, stage, 0, code=code, error=F.lit(type(exc).__name__)))
