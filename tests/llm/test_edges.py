"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factspark.llm import bpe, chat, embedding_dedup, language_id, mixing, ngram_lm, quality, secrets, simhash, toxicity
from factspark.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon. " * 20_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44), (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
            (2, "The quick brown fox jumps over the lazy dog.", None, "b", 44), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, " \n\t ", "de", "b", 4),
            (None, "Der schnelle braune Fuchs springt.", "de", None, 34), (None, None, None, None, None), (6, LONG, "en", "c", len(LONG)),
            (7, "12345 !!! 67890", "en", "c", 15), (8, "token = abcdefgh18273645 und mehr", "de", "c", 33)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    """The same rows with further columns whose names the operators use themselves."""
    for name in ("score", "lang_pred", "fp", "component_id", "variant", "n_words", "kept", "spans", "base", "n_tokens", "tokens", "start", "end", "kind",
                 "k1", "row", "o", "size", "_salt", "_rid", "rid", "hash", "owner", "value"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_language(docs, empty, odd):
    got = rows(language_id.identify(docs, F.lit(True)))
    assert len(got) == docs.count()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5, 7)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 6)} <= {"en", "de"}
    assert rows(language_id.identify(odd, F.lit(True))) == got
    assert rows(language_id.identify(empty, F.lit(True))) == []
    assert {r["lang_pred"] for r in rows(language_id.identify(docs, F.lit(False)))} == {"und"}


def test_mixing(docs, empty, odd):
    sized = lambda d: d.withColumn("_size", mixing.word_count(F.col("text")))
    got = rows(mixing.mix(sized(docs), size="_size"))
    assert len(got) == docs.count() and all(0 <= r["_copies"] <= 3 for r in got)
    assert {r["source"]: r["_source_size"] for r in got}[None] == 5
    assert rows(mixing.mix(sized(empty), size="_size")) == []
    again = {r["_copies"] for r in rows(mixing.mix(sized(odd), size="_size"))}
    assert again == {r["_copies"] for r in got}


def test_simhash(docs, empty, odd):
    got = rows(simhash.simhash_components(docs))
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[3]["fp"] == by[4]["fp"] == by[5]["fp"] == 0
    assert {r["component_id"] for r in got if r["fp"] == 0} == {3}
    key = lambda r: (str(r["doc_id"]), r["fp"])
    assert sorted(rows(simhash.simhash_components(odd)), key=key) == sorted(got, key=key)
    assert rows(simhash.simhash_components(empty)) == []


def test_near_copies(docs, empty, odd):
    got = rows(simhash.one_of_each(docs))
    assert sorted(str(r["doc_id"]) for r in got) == sorted(["1", "3", "6", "7", "8", "None"])
    assert sorted(str(r["doc_id"]) for r in rows(simhash.one_of_each(odd))) == sorted(str(r["doc_id"]) for r in got)
    assert rows(simhash.one_of_each(empty)) == []


def test_lm(docs, empty, odd):
    held = fold(F.col("doc_id"), 7) == 2
    got = rows(ngram_lm.score_texts(docs, held))
    assert len(got) == docs.count() and all(r["score"] <= 0 and r["n_tokens"] >= 1 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] == 3} == {1}
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {True}
    assert len(rows(ngram_lm.score_texts(odd, held))) == len(got)
    assert rows(ngram_lm.score_texts(empty, held)) == []
    untrained = rows(ngram_lm.score_texts(docs, F.lit(True)))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in untrained)


def test_toxicity(spark, docs, empty, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (6, None), (6, 0)], "doc_id long, toxic int")
    got = rows(toxicity.score_toxicity(docs, labels, F.lit(True)))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len(rows(toxicity.score_toxicity(odd, labels, F.lit(True)))) == len(got)
    assert rows(toxicity.score_toxicity(empty, labels, F.lit(True))) == []
    assert {r["score"] for r in rows(toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)))} <= {0.0, 0.01}


def test_secrets(docs, empty, odd):
    got = rows(secrets.secret_spans(docs))
    assert len(got) == docs.count() and sum(r["n_assign"] for r in got) == 1
    assert [(s["kind"], s["start"], s["end"]) for r in got if r["doc_id"] == 8 for s in r["spans"]] == [("assign", 0, 24)]
    assert sum(r["n_assign"] for r in rows(secrets.secret_spans(odd))) == 1
    assert rows(secrets.secret_spans(empty)) == []
    clean = rows(secrets.redact(docs))
    assert len(clean) == docs.count() and [r["text"] for r in clean if r["doc_id"] == 8] == ["token = [SECRET] und mehr"]
    assert sorted(str(r["text"]) for r in clean if r["doc_id"] != 8) == sorted(str(r["text"]) for r in rows(docs) if r["doc_id"] != 8)


def test_bpe(docs, empty, odd):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = rows(bpe.encode(docs, path))
    assert len(got) == docs.count() and {r["n_tokens"] for r in got if r["text"] in (None, "")} == {0}
    assert all(r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in got)
    assert len(rows(bpe.encode(odd, path))) == len(got) and rows(bpe.encode(empty, path)) == []


def test_quality(docs, empty, odd):
    got = rows(quality.clean_lines(docs))
    assert len(got) == docs.count()
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in got if not (r["text"] or "").strip())
    long = next(r for r in got if r["doc_id"] == 6)
    assert long["n_words"] == 100_000 == long["n_repeat_words"] and not long["kept"]
    assert {c for c in quality.clean_lines(odd).columns} >= {"score", "n_words"} and rows(quality.clean_lines(empty)) == []


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, window string, pos string"
    data = [(1, 0, "user", "a", "x", "y"), (1, 0, "user", "a", "x", "y"), (1, None, None, None, None, None), (None, 3, "assistant", LONG, "x", "y"), (2, 1, "assistant", None, "x", "y")]
    got = {r["conv_id"]: r for r in rows(chat.digests(chat.windows(spark.createDataFrame(data, schema))))}
    assert {k: v["n_turns"] for k, v in got.items()} == {1: 3, None: 1, 2: 1}
    assert got[None]["loss_chars"] == len(LONG) and got[2]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\na\nuser\na\n").hexdigest()
    assert rows(chat.digests(chat.windows(spark.createDataFrame([], schema)))) == []


def test_embeddings(spark):
    schema = "vec_id long, embedding array<float>, vec string, rep string"
    nan = float("nan")
    data = [(1, [1.0, 0.0], "x", "y"), (2, [1.0, 0.0], "x", "y"), (2, [1.0, 0.0], "x", "y"), (3, [2.0, 0.1], "x", "y"), (4, None, "x", "y"), (5, [0.0, 0.0], "x", "y"), (6, [nan, 1.0], "x", "y"),
            (7, [None, 1.0], "x", "y"), (8, [], "x", "y"), (9, [-1.0, 0.0], "x", "y"), (10, [1.0, 0.0, 0.0], "x", "y"), (11, [float("inf"), 1.0], "x", "y"), (None, [0.0, 3.0], "x", "y")]
    got = rows(embedding_dedup.near_duplicates(spark.createDataFrame(data, schema)))
    assert len(got) == len(data)
    assert sorted((r["n_links"], r["component_id"]) for r in got if r["vec_id"] in (1, 2, 3)) == [(3, 1)] * 4
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in got if r["vec_id"] not in (1, 2, 3))
    assert rows(embedding_dedup.near_duplicates(spark.createDataFrame([], schema))) == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, empty, stage):
    name, function = corpus_pipeline.STAGES[stage]
    got = function(spark, docs, "")
    assert stage == 4 or got.columns == docs.columns
    assert got.count() > 0
    assert function(spark, empty, "").count() == 0
    more = docs.withColumn("score", F.lit(1)).withColumn("row", F.lit("r")).withColumn("_n", F.lit(2))
    again = function(spark, more, "")
    assert again.count() == got.count() and (stage == 4 or again.columns == more.columns)
