"""The queries of this subpackage, op1 to op13, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import alignment, bpe, langid, licenses, mixing, ngram_join, oracles, quality, sharding, spelling, suffix_dedup, token_files, toxicity, vectors
from tessella.llm.common import held_out, table


def op1_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.vocabulary_file(None, "byte_bpe_50k.json"))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cascade(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"), 100)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_language_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op8_vector_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op9_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary_file(None, "word_bpe_49k.json"), end_id=2)


def op10_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.interleave(table(spark, sf_dir, "documents"), 16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), damage_one_in=97))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, model = bpe.vocabulary_file(None, "byte_bpe_50k.json"), alignment.piece_model(None, "piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), vocabulary, model)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_curriculum": op1_mix_curriculum,
    "op2_bpe_word_table": op2_bpe_word_table,
    "op3_quality_cascade": op3_quality_cascade,
    "op4_toxicity_trees": op4_toxicity_trees,
    "op5_suffix_array": op5_suffix_array,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_language_softmax": op7_language_softmax,
    "op8_vector_multi_index": op8_vector_multi_index,
    "op9_token_wavelet": op9_token_wavelet,
    "op10_shard_interleave": op10_shard_interleave,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_license_scan": op13_license_scan,
}

#: Where DuckDB can say the same on whole tables.
ORACLES: dict[str, str] = {
    "op1_mix_curriculum": oracles.OP1,
    "op3_quality_cascade": oracles.OP3,
    "op5_suffix_array": oracles.OP5,
    "op6_ngram_jaccard": oracles.OP6,
    "op10_shard_interleave": oracles.OP10,
    "op11_spelling_variants": oracles.OP11,
    "op13_license_scan": oracles.OP13,
}
