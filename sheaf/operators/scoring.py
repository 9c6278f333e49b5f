"""Weighted risk scores and grades (SCR).

Two shapes of the same computation: long tables joined to small weight tables
(any weights), and ``score_columns`` for answers already wide in one row (no
join at all).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import presets as P

KEY = "bundle_id"


# ---- dimension tables ------------------------------------------------------


def check_denominators(denominators: dict[str, float]) -> dict[str, float]:
    """Reject a zero or missing denominator before any job starts."""
    for domain, value in denominators.items():
        if not value:
            raise ValueError(f"denominator of '{domain}' is 0")
    return denominators


def scoring_dims(spark: SparkSession, denominators: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """The scoring preset as fixed-size tables (at most 116 rows)."""
    denominators = check_denominators(denominators or P.DENOMINATORS)
    weights = [
        (i, q[0], q[1], d, float(q[2 + j])) for i, q in enumerate(P.QUESTIONS) for j, d in enumerate(P.DOMAINS)
    ]
    groups = (
        [("single", k, n) for k, n in P.SINGLE_CHOICE.items()]
        + [("multi", k, n) for k, n in P.MULTI_CHOICE.items()]
        + [("general", q, 1) for q in P.GENERAL_QUESTIONS]
    )
    low = [None] + [t for t, _ in P.GRADES[:-1]]
    return {
        "weights": spark.createDataFrame(weights, "q_seq int, qid string, score_on string, domain string, score double"),
        "denominators": spark.createDataFrame(list(denominators.items()), "domain string, denom double"),
        "factors": spark.createDataFrame(list(P.UPLIFT_FACTORS.items()), "factor string, multiplier_on_yes double"),
        "groups": spark.createDataFrame(groups, "group_kind string, prefix string, n int"),
        "grades": spark.createDataFrame(
            [(g, lo, hi) for lo, (hi, g) in zip(low, P.GRADES)], "grade string, low double, high double"
        ),
    }


# ---- long form -------------------------------------------------------------


def triggered(answers: DataFrame, weights: DataFrame) -> DataFrame:
    """Answers that score, once per domain.  ``weights`` is a fixed small table."""
    on = F.broadcast(weights.withColumnRenamed("score_on", "answer"))
    return answers.join(on, ["qid", "answer"], "inner")


def domain_totals(bundles: DataFrame, hits: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Sum of scores per bundle and domain, 0 where nothing scores."""
    domains = domains or P.DOMAINS
    sums = hits.groupBy(KEY).agg(
        *[F.sum(F.when(F.col("domain") == d, F.col("score")).otherwise(0.0)).alias(d) for d in domains]
    )
    wide = bundles.select(KEY).join(sums, KEY, "left")
    return wide.select(
        KEY,
        F.inline(
            F.array(*[F.struct(F.lit(d).alias("domain"), F.coalesce(d, F.lit(0.0)).alias("total")) for d in domains])
        ),
    )


def uplift_multiplier(bundles: DataFrame, uplift: DataFrame, factors: DataFrame) -> DataFrame:
    """Product of the multipliers whose factor was answered Y."""
    yes = uplift.filter(F.col("answer") == "Y").join(F.broadcast(factors), "factor")
    product = yes.groupBy(KEY).agg(F.product("multiplier_on_yes").alias("multiplier"))
    return bundles.select(KEY).join(product, KEY, "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))


def domain_pct(totals: DataFrame, multiplier: DataFrame, denominators: DataFrame) -> DataFrame:
    return (
        totals.join(F.broadcast(denominators), "domain")
        .join(multiplier, KEY)
        .select(KEY, "domain", (F.col("total") * F.col("multiplier") / F.col("denom") * 100).alias("pct"))
    )


def overall(pct: DataFrame, bands: list[tuple] | None = None) -> DataFrame:
    """Highest domain percentage of each bundle, and its grade."""
    top = pct.groupBy(KEY).agg(F.max("pct").alias("overall"))
    return top.withColumn("grade", band(F.col("overall"), bands))


def band(value: Column, bands: list[tuple] | None = None) -> Column:
    """Half-open bands: the first upper bound above the value names the band."""
    bands = bands or P.GRADES
    return reduce(
        lambda rest, b: F.when(value < b[0], b[1]).otherwise(rest), reversed(bands[:-1]), F.lit(bands[-1][1])
    )


def score_diff(stored: DataFrame, computed: DataFrame, keys: list[str], tolerance: float = P.SCORE_TOLERANCE) -> DataFrame:
    """Rows of two long value tables that differ by more than the tolerance."""
    both = stored.withColumnRenamed("value", "stored").join(computed.withColumnRenamed("value", "computed"), keys)
    return both.filter(F.abs(F.col("computed") - F.col("stored")) > tolerance)


def unpivot_domains(wide: DataFrame, prefix: str = "", value: str = "value") -> DataFrame:
    return wide.select(
        KEY,
        F.inline(
            F.array(*[F.struct(F.lit(d).alias("domain"), F.col(prefix + d).alias(value)) for d in P.DOMAINS])
        ),
    ).filter(F.col(value).isNotNull())


# ---- wide form -------------------------------------------------------------


def answer_column(qid: str) -> str:
    return "q_" + qid.replace("-", "_")


def widen_answers(answers: DataFrame) -> DataFrame:
    """One row per bundle, one column per question.

    Answers are packed in numbers so that the aggregation is a hash
    aggregation with a map-side combine.
    """
    code = F.when(F.col("answer") == "Y", 2).when(F.col("answer") == "N", 1)
    packed = answers.groupBy(KEY).agg(
        *[F.max(F.when(F.col("qid") == q[0], code)).alias(answer_column(q[0])) for q in P.QUESTIONS]
    )
    names = [answer_column(q[0]) for q in P.QUESTIONS]
    return packed.select(KEY, *[F.when(F.col(n) == 2, "Y").when(F.col(n) == 1, "N").alias(n) for n in names])


def score_columns(
    wide: DataFrame, denominators: dict[str, float] | None = None, questions: list[tuple] | None = None, factors: dict[str, float] | None = None
) -> DataFrame:
    """Adds ``pct_<domain>``, ``overall`` and ``grade`` to wide answers.

    Needs the question columns and the uplift answers in the same row.
    ``questions`` are (id, answer that scores, score by domain), ``factors``
    multipliers of uplift answers; the presets by default.
    """
    questions = P.QUESTIONS if questions is None else questions
    factors = P.UPLIFT_FACTORS if factors is None else factors
    denominators = check_denominators(denominators or P.DENOMINATORS)
    multiplier = reduce(
        lambda a, b: a * b, [F.when(F.col(f) == "Y", m).otherwise(1.0) for f, m in factors.items()], F.lit(1.0)
    )
    out = wide
    for j, d in enumerate(P.DOMAINS):
        scores = [
            F.when(F.col(answer_column(q[0])) == q[1], float(q[2 + j])).otherwise(0.0) for q in questions if q[2 + j]
        ]
        out = out.withColumn(f"pct_{d}", reduce(lambda a, b: a + b, scores, F.lit(0.0)) * multiplier / denominators[d] * 100)
    out = out.withColumn("overall", F.greatest(*[F.col(f"pct_{d}") for d in P.DOMAINS]))
    return out.withColumn("grade", band(F.col("overall")))


def risk_columns(forms: DataFrame, recomputed_ok: Column | None = None) -> DataFrame:
    """Score and grade of a bundle, both from the same source.

    The recomputed pair counts if it could be computed, else the stored pair.
    """
    ok = F.col("overall").isNotNull() if recomputed_ok is None else recomputed_ok
    pair = F.when(ok, F.struct(F.col("overall").alias("s"), F.col("grade").alias("g"))).otherwise(
        F.struct(F.col("cached_overall").alias("s"), F.col("cached_grade").alias("g"))
    )
    return forms.withColumn("risk_score", pair["s"]).withColumn("risk_grade", pair["g"])
