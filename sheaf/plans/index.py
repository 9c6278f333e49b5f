"""Regulation index and retrieval map, from page lines to nested sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import presets as P
from sheaf.functions.session import materialise
from sheaf.operators import chunking, refs, retrieval
from sheaf.sources import tables


def document_state(page_lines: DataFrame, docs: DataFrame, registry: dict[str, str] | None = None) -> DataFrame:
    """(reg_code, n_lines, mark_a, mark_b): what the chunks of each registered code are made from.

    Sums of two salted 64-bit hashes of the lines, the titles, the page numbers
    and the style, so lines may come in any order, a repeated line counts, and a
    document of any size is summed up before the shuffle.  A document without
    lines has a state; a null line differs from an empty one.
    """
    known = chunking.known_documents(docs, registry)
    line = [F.col("page_no"), F.col("line_no"), F.col("line").isNull(), F.col("line")]
    head = [F.col(c) for c in ("doc_id", "reg_title", "n_pages", "style")]

    def mark(salt: str, over: list) -> Column:
        return F.sum(F.xxhash64(F.lit(salt), *over).cast("decimal(20,0)"))

    lines = page_lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), mark("a", line).alias("a"), mark("b", line).alias("b"))
    own = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n_lines", "a", "b")]
    return known.join(lines, "doc_id", "left").groupBy("reg_code").agg(
        F.sum(F.coalesce("n_lines", F.lit(0))).alias("n_lines"),
        *[mark(salt, head + own).cast("string").alias(f"mark_{salt}") for salt in ("a", "b")],
    )


def build_index(
    page_lines: DataFrame, docs: DataFrame, sources: DataFrame, embedder: retrieval.Embedder,
    path: str, model: str, dim: int, registry: dict[str, str] | None = None,
) -> DataFrame:
    """Chunks all registered documents, embeds them, writes table, description and state."""
    spark = page_lines.sparkSession
    state = materialise(document_state(page_lines, docs, registry))
    # until the new table is whole, nothing in it counts as up to date
    tables.write_index_state(state.limit(0), path, model, dim)
    chunks = chunking.chunk_documents(page_lines, docs, registry)
    embedded = retrieval.embed(chunks, "text", embedder)
    tables.write_index(embedded, path)
    return _described(spark, state, sources, path, model, dim)


def update_index(
    page_lines: DataFrame, docs: DataFrame, sources: DataFrame, embedder: retrieval.Embedder,
    path: str, model: str, dim: int, registry: dict[str, str] | None = None,
) -> DataFrame:
    """The index as :func:`build_index` would leave it, embedding changed codes only.

    ``page_lines``, ``docs`` and ``sources`` are the whole present inputs.  A code
    is changed when its :func:`document_state` is not the stored one; its folder
    is replaced, and folders of codes that are gone, or have no chunks any more,
    are removed.  Without a stored state, or with one of another model or
    dimension, every code is changed.  The states of changed and gone codes are dropped
    before their folders are touched and written after, so an update that is cut
    off is made up for by the next one.
    """
    spark = page_lines.sparkSession
    state = materialise(document_state(page_lines, docs, registry))
    before = tables.read_index_state(spark, path, model, dim)
    same = materialise(state.join(before, state.columns, "left_semi"))
    changed = state.join(same, "reg_code", "left_anti").select("reg_code")
    todo = docs.join(changed, "reg_code", "left_semi")
    chunks = materialise(chunking.chunk_documents(page_lines, todo, registry))
    kept = same.select("reg_code").unionByName(chunks.select("reg_code")).distinct()
    tables.write_index_state(same, path, model, dim)
    tables.replace_codes(retrieval.embed(chunks, "text", embedder), kept, path)
    return _described(spark, state, sources, path, model, dim)


def _described(spark: SparkSession, state: DataFrame, sources: DataFrame, path: str, model: str, dim: int) -> DataFrame:
    written = tables.read_chunks(spark, path).select("reg_code")
    tables.write_index_meta(tables.index_meta(written, sources, model, dim), path)
    tables.write_index_state(state, path, model, dim)
    return tables.open_index(spark, path, model, dim)


def build_sections(
    index: DataFrame, items: DataFrame, questions: DataFrame, embedder: retrieval.Embedder,
    top_k: int, threshold: float | None = P.SCORE_THRESHOLD, cap: int = P.MAX_SECTIONS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, item sections, question sections).

    Items and questions are searched together: one pass over the vectors.  A
    text whose embedding fails has no hits.  Index rows are addressed by
    (code, order), as article numbers may repeat.
    """
    index = index.withColumn("row_id", F.concat_ws(":", "reg_code", "order"))
    texts = items.select(
        F.concat(F.lit("i:"), "item_id").alias("query_id"),
        retrieval.item_query_text(F.col("topic"), F.col("description")).alias("text"),
    ).unionByName(
        questions.filter(F.coalesce(F.col("question_text"), F.lit("")) != "").select(
            F.concat(F.lit("q:"), "qid").alias("query_id"), F.col("question_text").alias("text")
        )
    )
    embedded = retrieval.embed(texts, "text", embedder, isolate=True)
    hits = retrieval.cosine_topk(embedded, index, top_k, vector_id="row_id")
    own = F.substr(F.col("query_id"), F.lit(3))

    def of(kind: str) -> DataFrame:
        return hits.filter(F.col("query_id").startswith(kind)).withColumn("query_id", own)

    parsed = refs.parse_refs(items, ["item_id"], "canonical_ref_raw")
    curated = retrieval.curated_sections(items, index)
    semantic = retrieval.semantic_sections(of("i:"), index, "row_id", threshold)
    merged = retrieval.merge_sections(curated, retrieval.drop_related(semantic, curated), cap)
    asked = retrieval.semantic_sections(of("q:"), index, "row_id", threshold)
    return parsed, merged, retrieval.top_sections(asked, cap)


def build_retrieval_map(
    index: DataFrame, items: DataFrame, questions: DataFrame, embedder: retrieval.Embedder,
    path: str, model: str, top_k: int, threshold: float | None = P.SCORE_THRESHOLD, cap: int = P.MAX_SECTIONS,
) -> tuple[DataFrame, DataFrame]:
    """Writes the nested map and reads it back checked."""
    parsed, item_secs, question_secs = build_sections(index, items, questions, embedder, top_k, threshold, cap)
    by_item, by_question = retrieval.nest_sections(items, parsed, item_secs, questions, question_secs)
    tables.write_retrieval_map(by_item, by_question, path, model)
    return tables.load_retrieval_map(index.sparkSession, path)


def evaluate(index: DataFrame, items: DataFrame, embedder: retrieval.Embedder, top_k: int) -> tuple[DataFrame, DataFrame]:
    """(recall, score distribution) of the vector search against curated references."""
    index = index.withColumn("row_id", F.concat_ws(":", "reg_code", "order"))
    texts = items.select(
        F.col("item_id").alias("query_id"),
        retrieval.item_query_text(F.col("topic"), F.col("description")).alias("text"),
    )
    embedded = retrieval.embed(texts, "text", embedder, isolate=True)
    hits = retrieval.cosine_topk(embedded, index, top_k, vector_id="row_id")
    found = hits.join(index.select(F.col("row_id").alias("id"), "reg_code", "section_path"), "id").withColumnRenamed("query_id", "key")
    truth = refs.parse_refs(items, ["item_id"], "canonical_ref_raw").withColumnRenamed("item_id", "key")
    failed = embedded.select(F.col("query_id").alias("key"), "error")
    matched = retrieval.match_hits(retrieval.searched(truth, failed), found)
    return retrieval.recall_at_k(matched), retrieval.score_distribution(matched)
