"""Embedding, vector top-k, and the curated + semantic section map (RET)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions import text as X
from sheaf.operators import refs as R

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

# Numbers in the query matrix that every task may hold.
MAX_QUERY_VALUES = 4_000_000
_ROWS_PER_BATCH = 4096


def embed(df: DataFrame, text: str, embedder: Embedder, batch: int = P.EMBED_BATCH, out: str = "embedding", isolate: bool = False) -> DataFrame:
    """Adds the vector of each text, asking the model for ``batch`` texts at a time.

    With ``isolate`` a failed call gives null vectors and an ``error`` text
    for its rows, and the others go on; otherwise it fails the job.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, {out} array<float>" + (", error string" if isolate else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                rows = frame.iloc[at : at + batch].copy()
                error = None
                try:
                    vectors = [list(map(float, v)) for v in embedder(rows[text].tolist())]
                    if len(vectors) != len(rows):
                        raise ValueError(f"{len(rows)} texts, {len(vectors)} vectors")
                except Exception as exc:
                    if not isolate:
                        raise
                    vectors, error = [None] * len(rows), type(exc).__name__
                rows[out] = vectors
                if isolate:
                    rows["error"] = error
                yield rows

    return df.mapInPandas(run, schema)


def unit_rows(rows: pd.Series) -> np.ndarray:
    m = np.array(rows.tolist(), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def best_hits(k: int, query: np.ndarray, names: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k highest scores of each query; equal scores go by id."""
    order = np.lexsort((names, -score, query))
    query, names, score = query[order], names[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return tuple(c[place < k] for c in (query, names, score))


def _nearest(frames: Iterator[pd.DataFrame], wanted: np.ndarray, k: int) -> tuple[np.ndarray, ...] | None:
    """(query number, id, score) of the best k of each query over frames of (id, e), kept batch by batch."""
    step = max(64, min(_ROWS_PER_BATCH, 8_000_000 // len(wanted)))
    kept = None
    for frame in frames:
        for at in range(0, len(frame), step):
            rows = frame.iloc[at : at + step]
            score = np.round(wanted @ unit_rows(rows["e"]).T, 9)
            if score.shape[1] > k:
                query, col = np.nonzero(score >= np.partition(score, -k, axis=1)[:, -k, None])
            else:
                query, col = np.indices(score.shape).reshape(2, -1)
            names = rows["id"].to_numpy()
            names = names.astype(str) if names.dtype == object else names
            found = (query, names[col], score[query, col])
            kept = best_hits(k, *(found if kept is None else map(np.concatenate, zip(kept, found))))
    return kept


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _hit_schema(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str) -> str:
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return f"query_id {kind(queries, query_id)}, id {kind(vectors, vector_id)}, score double"


def cosine_topk(
    queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "id", embedding: str = "embedding",
    max_query_values: int = MAX_QUERY_VALUES,
) -> DataFrame:
    """The ``k`` nearest vectors of each query: (query_id, id, score, rank).  Exact.

    For a stated set of queries, such as template items or topics: every task
    holds their matrix, so a set of more than ``max_query_values`` numbers is
    refused; :func:`sheaf.operators.cells.near_topk` takes any.  A task multiplies its vectors with
    the matrix batch by batch and keeps a running top-k, so only ``k`` rows per
    query and task are shuffled; no (query, vector) pair list exists.
    """
    schema = _hit_schema(queries, vectors, query_id, vector_id)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(embedding).alias("e")).filter(F.col("e").isNotNull())
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("e")).alias("dim")).first()
    if size["n"] * (size["dim"] or 0) > max_query_values:
        raise ValueError(f"{size['n']} queries are too many for every task; use near_topk")
    stated = q.collect() if size["n"] else []
    if not stated:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    ids, wanted = [r["query_id"] for r in stated], unit_rows(pd.Series([r["e"] for r in stated]))

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _nearest(frames, wanted, k)
        if kept is not None:
            yield pd.DataFrame({"query_id": [ids[i] for i in kept[0]], "id": kept[1], "score": kept[2]})

    rows = vectors.select(F.col(vector_id).alias("id"), F.col(embedding).alias("e")).filter(F.col("e").isNotNull())
    return _ranked(rows.mapInPandas(nearest, schema), k)


def above_threshold(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Hits at or above the threshold; none given keeps all, no score counts 0."""
    if threshold is None:
        return hits
    return hits.filter(F.coalesce("score", F.lit(0.0)) >= threshold)


def excerpt(c: Column, n: int = P.EXCERPT_CHARS) -> Column:
    return F.substring(c, 1, n)


def _section(origin: str, score: Column) -> list[Column]:
    return [
        "reg_code", "section_path", "title", excerpt(F.col("text")).alias("excerpt"),
        score.cast("double").alias("score"), F.lit(origin).alias("origin"),
    ]


def curated_sections(items: DataFrame, chunks: DataFrame, key: str = "item_id", raw: str = "canonical_ref_raw", cap: int = P.PER_REF_CAP) -> DataFrame:
    """Sections an item's reference text names: at most ``cap`` per reference.

    Two references of an item to one section list it twice.
    """
    parsed = R.parse_refs(items, [key], raw)
    found = R.lookup_first(chunks, parsed, cap)
    pos = F.row_number().over(Window.partitionBy(key).orderBy("ref_idx", "pos")).cast("bigint")
    return found.select(F.col(key).alias("key"), pos.alias("pos"), *_section("curated", F.lit(None)))


def semantic_sections(hits: DataFrame, chunks: DataFrame, vector_id: str = "chunk_id", threshold: float | None = P.SCORE_THRESHOLD) -> DataFrame:
    """Hits above the threshold with their chunk texts, in rank order."""
    kept = above_threshold(hits, threshold).withColumnRenamed("id", vector_id)
    found = kept.join(chunks, vector_id)
    return found.select(F.col("query_id").alias("key"), F.col("rank").cast("bigint").alias("pos"), *_section("semantic", F.col("score")))


def drop_related(semantic: DataFrame, curated: DataFrame) -> DataFrame:
    """Semantic sections not on one line of ancestry with a curated one.

    Same path, above, or below: two anti joins on equality, one on the
    section's ancestors and one on the curated paths' ancestors.
    """
    taken = curated.select("key", "reg_code", F.col("section_path").alias("__p")).distinct()
    # curated path equal to the section or above it
    up = semantic.select("key", "reg_code", "section_path", F.explode(X.ancestors(F.col("section_path"))).alias("__p"))
    below_curated = up.join(taken, ["key", "reg_code", "__p"], "left_semi").select("key", "reg_code", "section_path")
    # curated path below the section
    above_curated = taken.select("key", "reg_code", F.explode(X.ancestors(F.col("__p"))).alias("section_path"))
    related = below_curated.unionByName(above_curated).distinct()
    return semantic.join(related, ["key", "reg_code", "section_path"], "left_anti").select(*semantic.columns)


def merge_sections(curated: DataFrame, semantic: DataFrame, n: int = P.MAX_SECTIONS) -> DataFrame:
    """Curated first, then semantic by rank, at most ``n`` per key."""
    rank = F.when(F.col("origin") == "curated", 0).otherwise(1)
    both = curated.unionByName(semantic)
    order = Window.partitionBy("key").orderBy(rank, "pos")
    return both.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)


def top_sections(sections: DataFrame, n: int = P.MAX_SECTIONS) -> DataFrame:
    """The first ``n`` sections of each key, renumbered."""
    order = Window.partitionBy("key").orderBy("pos")
    return sections.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= n)


def question_sections(hits: DataFrame, chunks: DataFrame, vector_id: str = "chunk_id", threshold: float | None = P.SCORE_THRESHOLD, n: int = P.MAX_SECTIONS) -> DataFrame:
    """Semantic sections of questions; nothing curated."""
    return top_sections(semantic_sections(hits, chunks, vector_id, threshold), n)


def item_query_text(topic: Column, description: Column) -> Column:
    return X.fill("{t}:{d}", t=topic, d=description)


def nest_sections(items: DataFrame, refs: DataFrame, item_sections: DataFrame, questions: DataFrame, question_secs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per item and per question one nested entry: (key, value).

    Sections are capped per key and references are those of one text, so each
    collected list is short.
    """

    def listed(df: DataFrame) -> DataFrame:
        s = F.struct("pos", "reg_code", "section_path", "title", "excerpt", "score", "origin")
        entry = F.transform(F.sort_array(F.collect_list(s)), lambda x: x.dropFields("pos"))
        return df.groupBy("key").agg(entry.alias("sections"))

    ref = F.struct("ref_idx", "reg_code", "section_path_prefix")
    ref_lists = refs.groupBy(F.col("item_id").alias("key")).agg(
        F.transform(F.sort_array(F.collect_list(ref)), lambda x: x.dropFields("ref_idx")).alias("refs")
    )
    none_refs = F.array().cast("array<struct<reg_code:string,section_path_prefix:string>>")
    none_secs = F.array().cast(
        "array<struct<reg_code:string,section_path:string,title:string,excerpt:string,score:double,origin:string>>"
    )
    by_item = (
        items.withColumn("key", F.col("item_id")).join(ref_lists, "key", "left").join(listed(item_sections), "key", "left")
    ).select(
        "key",
        F.struct(
            "item_id",
            F.nullif(F.col("topic"), F.lit("")).alias("canonical_topic"),
            F.nullif(F.col("description"), F.lit("")).alias("canonical_description"),
            "canonical_ref_raw",
            F.coalesce("refs", none_refs).alias("refs"),
            F.coalesce("sections", none_secs).alias("sections"),
        ).alias("value"),
    )
    by_question = (
        questions.filter(F.coalesce(F.col("question_text"), F.lit("")) != "")
        .select(F.col("qid").alias("key"))
        .join(listed(question_secs), "key", "left")
        .select("key", F.struct(F.col("key").alias("qid"), F.coalesce("sections", none_secs).alias("sections")).alias("value"))
    )
    return by_item, by_question


# ---- evaluation ------------------------------------------------------------


def match_hits(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """Per reference the best matching hit and the lowest score of its key.

    ``truth(key, ref_idx, reg_code, section_path_prefix)``, ``hits(key,
    reg_code, section_path, score, rank)``; keys whose search gave no answer
    must be left out of ``truth`` by the caller (see ``searched``).  Hits are
    at most k per key, so the join on key stays small.
    """
    lowest = hits.groupBy("key").agg(F.min("score").alias("lowest"))
    pairs = truth.join(hits.withColumnRenamed("reg_code", "__code"), "key", "left")
    match = (F.col("reg_code") == F.col("__code")) & R.path_matches(F.col("section_path_prefix"), F.col("section_path"))
    per_ref = pairs.groupBy("key", "ref_idx").agg(
        F.coalesce(F.max(match), F.lit(False)).alias("matched"),
        F.min_by("score", F.when(match, F.col("rank"))).alias("score"),
    )
    return per_ref.join(lowest, "key", "left")


def recall_at_k(matched: DataFrame) -> DataFrame:
    return matched.agg(
        F.count(F.lit(1)).alias("refs"), F.count_if("matched").alias("recalled"),
    ).withColumn("recall", F.when(F.col("refs") > 0, F.col("recalled") / F.col("refs")).otherwise(0.0))


def score_distribution(matched: DataFrame) -> DataFrame:
    hit = F.when(F.col("matched"), F.col("score"))
    return matched.agg(
        F.min(hit).alias("hit_min"), F.max(hit).alias("hit_max"), F.avg(hit).alias("hit_mean"),
        F.max(F.when(~F.col("matched"), F.col("lowest"))).alias("miss_max"),
    )


def searched(truth: DataFrame, errors: DataFrame | None) -> DataFrame:
    """Truth of keys whose search did not fail.  ``errors(key, error)``."""
    if errors is None:
        return truth
    return truth.join(errors.filter(F.col("error").isNotNull()).select("key"), "key", "left_anti")
