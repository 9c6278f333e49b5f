"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import chat, decontaminate, hardneg, katz, merkle, neardup, oracles, packing, pii, quality, sharding, sigtree, tokens, toxicity
from sheaf.llm.common import table


VOCABULARY = "byte_bpe_50k.json"


def op1_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.held_out_scores(table(spark, sf_dir, "documents"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), words=4).drop("text_hash")


def op5_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), out="q").select("doc_id", "q.*")


def op8_naive_bayes_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    pieces = chat.format_turns(conv.union(more))
    return chat.digests(pieces, chat.examples(pieces))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def op12_bitmap_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.changed_size(docs))


def op13_spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), hardneg.shifted_label(), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_wu_manber, op2_katz_backoff, op3_pii_spans, op4_superminhash, op5_sum_of_squares, op6_prefix_counts, op7_compression_bands, op8_naive_bayes_ngrams, op9_prefix_targets, op10_hash_tree, op11_signature_tree, op12_bitmap_manifest, op13_spanning_tree)
}
#: The others need hashes, tokenizers, compression or floating sums that SQL does not share; tests/llm has plain versions.
ORACLE_SQL: dict[str, str] = {"op1_wu_manber": oracles.WU_MANBER, "op9_prefix_targets": oracles.PREFIX_TARGETS, "op12_bitmap_manifest": oracles.MANIFEST, "op13_spanning_tree": oracles.HARD_NEGATIVES}
