"""From documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, mixing, ngram_join, suffix_dedup
from tessella.llm.common import Workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model rejects: no letter, or a score below its threshold.

    Null and empty texts have no letter and go. Repeated rows get the same verdict; a null
    id or language only keeps a row out of training. No rows give none. Columns stay,
    whatever their names.
    """
    found = langid.predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), langid.fit(docs))
    return found.where("not rejected").select("row.*")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group linked by five-word shingles at 0.8.

    Null and empty texts link with nothing and stay, as do null ids; rows that share the kept
    id all stay. No rows give none. Columns stay, whatever their names.
    """
    return ngram_join.one_of_each(docs, k=5, percent=80)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every 100-byte string that starts earlier in the corpus out of the texts.

    Texts that lose everything but white space go; null, empty and short ones stay as they
    are. Rows alike in id and text count as one and are cut alike; a null id counts as the
    smallest. No rows give none. Columns stay, whatever their names; n_chars is counted again.
    """
    return suffix_dedup.without_repeats(docs, 100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum reads them, in training order, once for each pass.

    Texts without words can't be read and go. A null source is a source. Rows alike in id
    and text are read alike. No rows give none. Columns stay, whatever their names.
    """
    return mixing.training_stream(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, their digest, and that of the text they decode to.

    A row for each row: null and empty texts have no ids, a null id stays null, repeated
    rows repeat. No rows give none.
    """
    return bpe.encode(docs, bpe.vocabulary_file(None, "byte_bpe_50k.json"), with_ids=True, block_rows=2_000)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", join_near_duplicates),
    ("suffix_array", cut_repeated_strings),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: The stages train models and sort suffixes, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written before the next reads them."""
    docs, space = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = space.write(docs, name)
        if 0 < k < len(STAGES) - 1:
            space.drop(before)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
