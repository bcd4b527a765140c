"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The examples are a bounded sample of the labelled rows; their vectors form an inverted index in blocks of
examples, with the greatest weight of every term in every block.  A text visits blocks in the order
of the bound these give, until no block can improve its nearest ``k``: the result is exact.
Similarity-weighted votes, calibrated on the examples themselves (each left out), give the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm.common import fold, stored, table
from factspark.llm.registry import query

TERM_CHARS = 40
PREFIXES = (4, 5, 6)
EDGE = re.compile(r"^\W+|\W+$")


def terms_of(word: str) -> list[str]:
    """A word without marks at its ends, and its first 4, 5 and 6 letters: stems stand in for word forms."""
    word = EDGE.sub("", word)
    return ([word] if 0 < len(word) <= TERM_CHARS else []) + [f"{word[:n]}*" for n in PREFIXES if len(word) > n]


class Vectorizer:
    """Term frequencies over a fixed vocabulary; remembers the terms of frequent words, in bounded memory."""

    def __init__(self, vocabulary: list[str]):
        self.at = {term: i for i, term in enumerate(vocabulary)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[list[int], list[int]]:
        found: Counter = Counter()
        known = self.known
        for word, n in Counter(text.lower().split()).items():
            ids = known.get(word)
            if ids is None:
                ids = tuple(self.at[t] for t in terms_of(word) if t in self.at)
                if len(known) < 500_000 and len(word) <= 64:
                    known[word] = ids
            for i in ids:
                found[i] += n
        order = sorted(found)
        return order, [found[i] for i in order]


class NearestExamples:
    """Block-max inverted index of weighted example vectors."""

    def __init__(self, vectors: list[tuple[list[int], list[int]]], labels: np.ndarray, ids: list, idf: np.ndarray, block: int = 256, k: int = 25):
        self.labels, self.ids, self.idf, self.block, self.k = labels, ids, idf, block, k
        rows, cols, values = [], [], []
        for i, (terms, counts) in enumerate(vectors):
            weight = self.weighted(terms, counts)
            rows += [i] * len(terms)
            cols += terms
            values += weight.tolist()
        order = np.lexsort((rows, cols)) if rows else np.empty(0, dtype=int)
        self.example = np.array(rows, dtype="i4")[order]
        self.value = np.array(values, dtype="f8")[order]
        term = np.array(cols, dtype="i4")[order]
        self.blocks = max(1, -(-len(vectors) // block))
        # Postings of (term, block) lie between cut[term, block] and the next cut.
        cell = term.astype("i8") * self.blocks + self.example // block
        self.cut = np.searchsorted(cell, np.arange(len(idf) * self.blocks + 1)).tolist()
        self.top = np.zeros((len(idf), self.blocks))
        np.maximum.at(self.top, (term, self.example // block), self.value)

    def weighted(self, terms: list[int], counts: list[int]) -> np.ndarray:
        w = (1 + np.log(np.array(counts, dtype="f8"))) * self.idf[terms] if terms else np.empty(0)
        return w / np.linalg.norm(w) if len(w) else w

    def nearest(self, terms: list[int], counts: list[int], skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest examples with a common term and their cosines; ties go to earlier examples."""
        if not terms:
            return np.empty(0, dtype="i8"), np.empty(0)
        weights = self.weighted(terms, counts)
        bound = weights @ self.top[terms]
        best_at, best = np.empty(0, dtype="i8"), np.empty(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == self.k and bound[b] < best[-1] - 1e-12):
                break
            base, sums = b * self.block, np.zeros(self.block)
            for t, w in zip(terms, weights.tolist()):
                i, j = self.cut[t * self.blocks + b], self.cut[t * self.blocks + b + 1]
                if j > i:
                    sums[self.example[i:j] - base] += w * self.value[i:j]
            if base <= skip < base + self.block:
                sums[skip - base] = 0.0
            hit = np.flatnonzero(sums > 0)
            at, cos = np.concatenate([best_at, hit + base]), np.concatenate([best, sums[hit]])
            order = np.lexsort((at, -cos))[:self.k]
            best_at, best = at[order], cos[order]
        return best_at, best

    def vote(self, at: np.ndarray, cos: np.ndarray, share: np.ndarray) -> float:
        """Part of the votes that are toxic, weighted with squared similarity and with the share of labelled
        rows that an example of its label stands for; -1 without neighbours.

        One vote more, of full similarity, has the base rate: distant neighbours alone decide little.
        """
        if not len(at):
            return -1.0
        weight = cos ** 2 * share[self.labels[at]]
        rows = share * np.bincount(self.labels, minlength=2)
        return float((weight[self.labels[at] == 1].sum() + rows[1] / rows.sum()) / (weight.sum() + 1))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps fitted to y by weight (pool adjacent violators): thresholds and values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist()):
        pools.append([a, b * c, c])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]):
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class ToxicityModel:
    """Vocabulary, nearest examples and calibration."""

    def __init__(self, index: NearestExamples, share: np.ndarray):
        self.index, self.share = index, share
        self.low, self.steps, self.values = 0.0, np.zeros(1), np.zeros(1)

    def calibrate(self, vectors: list[tuple[list[int], list[int]]]) -> None:
        """Probabilities of left-out votes; each side gets half a labelled row so that none is 0 or 1."""
        raw = np.array([self.index.vote(*self.index.nearest(*v, skip=i), self.share) for i, v in enumerate(vectors)])
        y, w = self.index.labels.astype("f8"), self.share[self.index.labels]
        none = raw < 0
        total = lambda m: (float((y[m] * w[m]).sum()), float(w[m].sum()))
        s, n = total(none)
        self.low = (s + 0.01) / (n + 1)
        if (~none).any():
            self.steps, self.values = isotonic(np.concatenate([[0.0, 1.0], raw[~none]]), np.concatenate([[0.0, 1.0], y[~none]]),
                                               np.concatenate([[0.5, 0.5], w[~none]]))

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        at, cos = self.index.nearest(terms, counts)
        raw = self.index.vote(at, cos, self.share)
        if raw < 0:
            return self.low, []
        value = float(np.interp(raw, self.steps, self.values))
        shown = [{"doc_id": self.index.ids[a], "cosine": float(c), "toxic": int(self.index.labels[a])} for a, c in zip(at[:5].tolist(), cos[:5].tolist())]
        return min(max(value, 0.0), 1.0), shown


EVIDENCE = "array<struct<doc_id:bigint,cosine:double,toxic:int>>"


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
                   max_examples: int = 4000, max_terms: int = 2048, min_chi2: float = 30.0, min_ratio: float = 4.0,
                   k: int = 25) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1) and evidence (the five nearest examples).

    Examples: at most ``max_examples`` labelled documents of either label with distinct texts, those with
    the smallest hash of their id; ``train`` (over the columns of ``labels``) says which rows may be learned from.
    Vocabulary: at most ``max_terms`` terms of the examples, of up to 40 letters, by their association with
    the label: chi-squared of at least ``min_chi2``, which says that it is no chance, and ``min_ratio`` times as frequent in
    documents of one label as of the other, which does not grow with the sample.  So the index has a fixed bound.  Document
    frequencies count all documents, class shares all labelled rows.

    Null text is empty; a text without a vocabulary term gets the rate of such examples.  Without examples
    every score is 0.  Rows with null id or label are not learned from; a document labelled both ways counts
    as toxic.  Repeated rows keep their rows.
    """
    spark = docs.sparkSession
    known = labels.filter(train & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = stored(known)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_examples) for y in (0, 1)]
    picked = stored(picked[0].unionByName(picked[1]))
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # At most twice max_examples ids: their size has that bound.
    examples = own.join(F.broadcast(picked), "id")
    examples = stored(examples.groupBy(F.sha2("text", 256).alias("h")).agg(F.max(F.struct("y", "id")).alias("m"), F.first("text").alias("text"))
                      .select("m.id", "m.y", "text"))

    @F.pandas_udf("array<string>")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({x for w in set(t.lower().split()) for x in terms_of(w)}))

    sizes = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    a, b = F.col("a"), F.col("b")
    share = (a + b) / F.lit(float(max(n0 + n1, 1)))
    chi2 = (a - share * n1) ** 2 / (share * n1 * (1 - share) + 1e-9) + (b - share * n0) ** 2 / (share * n0 * (1 - share) + 1e-9)
    found = examples.select("y", F.explode(distinct_terms("text")).alias("term")).groupBy("term").agg(
        F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter("a + b >= 3").withColumn("chi2", chi2)
    one, other = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
    telling = (F.col("chi2") >= min_chi2) & (F.greatest(one, other) >= min_ratio * F.least(one, other))
    vocabulary = [r["term"] for r in found.filter(telling).orderBy(F.col("chi2").desc(), "term").limit(max_terms).collect()]

    shipped = spark.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("struct<terms array<int>, counts array<int>>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make = Vectorizer(shipped.value)
        for texts in batches:
            made = [make(t) for t in texts]
            yield pd.DataFrame({"terms": [m[0] for m in made], "counts": [m[1] for m in made]})

    rows = stored(own.select("id", vectors("text").alias("v")).select("id", "v.terms", "v.counts"))
    total = rows.count()
    frequency = np.zeros(len(vocabulary))
    size = len(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, dtype="i8")
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["t", "n"])

    # A task adds up what it reads, so at most tasks x max_terms rows move and max_terms reach the driver.
    for r in rows.select("terms").mapInArrow(counted, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        frequency[r["t"]] = r["n"]
    idf = np.log((1 + total) / (1 + frequency)) + 1

    sample = examples.select("id", "y", vectors("text").alias("v")).select("id", "y", "v.terms", "v.counts").orderBy("y", F.xxhash64("id"), "id").collect()
    made = [(list(r["terms"]), list(r["counts"])) for r in sample]
    y = np.array([r["y"] for r in sample], dtype="i8")
    shares = np.array([counts.get(c, 0) / max(int((y == c).sum()), 1) for c in (0, 1)])
    model = ToxicityModel(NearestExamples(made, y, [r["id"] for r in sample], idf, k=k), shares)
    if len(sample):
        model.calibrate(made)
    learned = spark.sparkContext.broadcast(model)

    @F.pandas_udf(f"score double, evidence {EVIDENCE}")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model, seen = learned.value, {}
        for terms, counts in batches:
            out = []
            for t, c in zip(terms, counts):
                key = tuple(t), tuple(c)
                if key not in seen:
                    if len(seen) >= 50_000:
                        seen.clear()
                    seen[key] = model.score(*map(list, key))
                out.append(seen[key])
            yield pd.DataFrame({"score": [o[0] for o in out], "evidence": [o[1] for o in out]})

    return rows.select(F.col("id").alias("doc_id"), scored("terms", "counts").alias("s")).select("doc_id", "s.score", "s.evidence")


@query("op6_nearest_examples")
def op6_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; of the three folds that with remainder 1 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = score_toxicity(docs, labels, fold(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
