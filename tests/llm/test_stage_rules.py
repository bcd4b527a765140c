"""Rules of the language and secrets stages that plain copies of the given tables do not show."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from factspark.llm import secrets


def test_a_language_that_is_not_learned_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("was", F.col("lang"))
    left_out = docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    kept = collections.Counter(r["was"] for r in corpus_pipeline.identified(spark, left_out, "").collect())
    before = collections.Counter(r["was"] for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect())
    assert kept["es"] == 0 and all(kept[lang] == before[lang] for lang in before if lang != "es")


def test_secrets_of_one_two_and_three_owners(spark):
    value = lambda n: f"q7Rt{n}mZp4Ks9Lx"
    texts = [(f"password = {value(n)} ok", f"s{k}") for n in (1, 2, 3) for k in range(n)]
    inside = ["k9yourP2mQ7sTz", "a0000Qm5tRk8bXz", "b7xxxxTq2LmR9s"]
    whole = ["your_api_key_here", "changeme-placeholder", "xxxxxxxx-your-token", "example.password"]
    texts += [(f"password = {v} ok", "s0") for v in inside + whole]
    got = sorted(r["text"] for r in secrets.redact(spark.createDataFrame(texts, "text string, source string")).collect())
    masked = ["password = [SECRET] ok"] * (1 + 2 + len(inside))
    assert got == sorted(masked + [f"password = {value(3)} ok"] * 3 + [f"password = {v} ok" for v in whole])
