"""A corpus pipeline of five stages, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm import bpe, language_id, mixing, secrets, simhash
from factspark.llm.common import stored, table, text_of


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters know; those without letters or in none of them go."""
    model = language_id.learn(docs)
    return docs.filter(language_id.accepted(F.col("text"), model, spark, language_id.acceptance_levels(docs, model)))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of exact and near copies."""
    return simhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; values of credentials that look live and are not copied widely are masked, and n_chars counts the new text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents with no copy go."""
    sized = mixing.mix(docs.withColumn("_size", mixing.word_count(F.col("text"))), size="_size")
    copies = sized.filter("_copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("_copies").cast("int"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, with their digest and that of the text they decode to."""
    import public_tokenizers

    rows = docs.select("doc_id", "source", "lang", "text", F.sha2(text_of(F.col("text")).cast("binary"), 256).alias("text_sha256"))
    coded = bpe.encode(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return coded.select("doc_id", "source", "lang", "n_tokens", "tokens", "ids_sha256", "text_sha256", "decoded_sha256")


STAGES = [("language_id", identified), ("near_duplicates", deduplicated), ("secrets", without_secrets),
          ("mix", mixed), ("bpe", encoded)]

#: SQL can express neither the bands nor the merges; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; all results but the last are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
