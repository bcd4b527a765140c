"""Language identification by bit-sliced Bloom filters over character trigrams.

Every slot of the filter is a bitmask over languages: probing a trigram's slots and taking AND returns
all languages that contain it.  A text's popcount per language, corrected for the false positives
that the language's fill ratio explains, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm.common import fold, stored, table
from factspark.llm.registry import query

PART = 250_000
PROBES = 3
MAX_LANGUAGES = 1024
TEXTS = 256
UNDETERMINED = "und"


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def slices(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-cased, blank-padded texts in groups of about ``PART`` characters.

    A longer text is cut into slices that share two characters, so that every trigram lies in one.
    """
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        padded = f" {text.lower()} "
        for a in range(0, len(padded) - 2, PART):
            owners.append(i)
            parts.append(padded[a:a + PART + 2])
            size += len(parts[-1])
            if size >= PART:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def some_texts(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, a few at a time: only those are Python strings at once."""
    for a in range(0, len(texts), TEXTS):
        yield texts.slice(a, TEXTS).to_pylist()


def trigrams(owners: list[int], parts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams with a letter in the middle, 21 bits a code point, and the texts they lie in.

    Runs of other characters than letters count as one blank.
    """
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.cumsum([len(p) for p in parts])
    middle = np.ones(len(points), dtype=bool)
    middle[ends - 1] = middle[ends[:-1]] = middle[0] = False
    letter = letters[points]
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    keep[ends[:-1]] = True
    place = np.flatnonzero(keep)
    points, middle = points[place].astype("u8"), (middle & letter)[place]
    at = np.flatnonzero(middle)
    grams = points[at - 1] << np.uint64(42) | points[at] << np.uint64(21) | points[at + 1]
    return grams, np.array(owners)[np.searchsorted(ends, place[at], side="right")]


def slots(grams: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    first = grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
    second = grams * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits) | np.uint64(1)
    for k in range(PROBES):
        yield (first + np.uint64(k) * second) & np.uint64((1 << bits) - 1)


class LanguageFilter:
    """Slots of language masks (64 languages a word) and each language's false positive rate."""

    def __init__(self, languages: list[str], grams: np.ndarray, language: np.ndarray, default: str, bits: int | None = None):
        self.languages, self.default = languages, default
        most = int(np.bincount(language, minlength=1).max()) if len(language) else 1
        self.bits = bits or max(10, int(np.ceil(np.log2(most * 16))))
        self.masks = np.zeros((1 << self.bits, max(1, -(-len(languages) // 64))), dtype="u8")
        one = np.uint64(1) << (language % 64).astype("u8")
        for slot in slots(grams, self.bits):
            np.bitwise_or.at(self.masks, (slot, language // 64), one)
        fill = np.array([(self.masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = np.minimum(fill ** PROBES, 0.999)

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        """A mask per trigram of all languages that contain it (or seem to)."""
        found = None
        for slot in slots(grams, self.bits):
            found = self.masks[slot] if found is None else found & self.masks[slot]
        return found

    def evidence(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams per text, and corrected popcounts by text and language."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for owners, parts in slices(texts):
            grams, owner = trigrams(owners, parts, letters)
            if not len(grams):
                continue
            total += np.bincount(owner, minlength=len(texts))
            masks = self.languages_of(grams)
            for i in range(len(self.languages)):
                has = masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)
                hits[:, i] += np.bincount(owner, weights=has, minlength=len(texts))
        return total, np.maximum((hits - total[:, None] * self.false) / (1 - self.false), 0.0)

    def decide(self, texts: list[str], letters: np.ndarray) -> pd.DataFrame:
        """lang_pred, score (share of the two best popcounts) and coverage (share of trigrams the language has)."""
        total, found = self.evidence(texts, letters)
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0, "coverage": 0.0})
        best = found.argmax(axis=1)
        top = found[np.arange(len(texts)), best]
        rest = found.copy()
        rest[np.arange(len(texts)), best] = 0.0
        second = rest.max(axis=1)
        score = np.where(top > 0, top / np.maximum(top + second, 1e-12), 1.0 / len(self.languages))
        names = np.where(top > 0, np.array(self.languages, dtype=object)[best], self.default)
        known = total > 0
        return pd.DataFrame({"lang_pred": np.where(known, names, UNDETERMINED), "score": np.where(known, score, 0.0).clip(0, 1),
                             "coverage": np.where(known, top / np.maximum(total, 1), 0.0).clip(0, 1)})


def trigram_counts(rows: DataFrame) -> DataFrame:
    """(lang, text) rows to lang, gram, n; each task adds up before it emits, in bounded memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = letter_table(), {}

        def emitted() -> Iterator[pa.RecordBatch]:
            for lang, (grams, n) in sums.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(grams)), "gram": grams.astype("i8"), "n": n.astype("i8")})
            sums.clear()

        def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
            for langs, texts in zip(some_texts(batch.column("lang")), some_texts(batch.column("text"))):
                own = {}
                for lang, text in zip(langs, texts):
                    own.setdefault(lang, []).append(text)
                yield from own.items()

        for batch in batches:
            for lang, own in by_language(batch):
                for owners, parts in slices(own):
                    grams, n = np.unique(trigrams(owners, parts, letters)[0], return_counts=True)
                    if lang in sums:
                        grams, at = np.unique(np.concatenate([sums[lang][0], grams]), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([sums[lang][1], n])).astype("i8")
                    sums[lang] = grams, n
                    if sum(len(g) for g, _ in sums.values()) > 1_000_000:
                        yield from emitted()
        yield from emitted()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", min_rate: float = 1e-5, min_share: float = 0.1) -> LanguageFilter:
    """A filter learned from rows with text and language.

    A language contains a trigram that makes up at least ``min_rate`` of its trigrams and is at least
    ``min_share`` times as frequent as in any other language.  So a language has at most ``1 / min_rate``
    trigrams, whatever the corpus: with at most ``MAX_LANGUAGES`` languages (more are an error) that
    bounds what the driver gets and broadcasts.  Counts cover all rows.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = stored(trigram_counts(rows))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    ordered = totals.orderBy(F.col("total").desc(), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(ordered) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(r["lang"] for r in ordered)
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).filter(F.col("rate") >= min_rate)
    most = rates.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = rates.join(most, "gram").filter(F.col("rate") >= min_share * F.col("most")).select("lang", "gram").toPandas()
    index = {name: i for i, name in enumerate(names)}
    return LanguageFilter(names, kept["gram"].to_numpy(dtype="i8").astype("u8"), kept["lang"].map(index).to_numpy(dtype="i8"),
                          ordered[0]["lang"] if ordered else UNDETERMINED)


def decided_row(found: pd.DataFrame | None) -> pa.Array:
    """``decide``'s frame as an Arrow struct, with no rows for None."""
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "coverage": pa.float64()}
    columns = [pa.array([] if found is None else found[n].tolist(), kind) for n, kind in kinds.items()]
    return pa.StructArray.from_arrays(columns, fields=[pa.field(n, kind) for n, kind in kinds.items()])


def predicted(text: Column, model: LanguageFilter, spark: SparkSession) -> Column:
    """struct(lang_pred, score, coverage) of a text; null counts as empty, which is undetermined."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, coverage double")
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = letter_table()
        for texts in batches:
            yield pa.concat_arrays([decided_row(shipped.value.decide([t or "" for t in some], letters)) for some in some_texts(texts)] or [decided_row(None)])

    return decide(text)


def identify(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, coverage; learned from the rows that ``train`` marks.

    ``und`` with score 0 for texts that are null or hold no letter, and for all texts when there is
    nothing to learn from.  A text with letters none of whose trigrams is known gets the language
    with most training text.  Equal popcounts go to the first language by name.  Rows with null language are
    not learned from; null ids and repeated rows are kept as they are.
    """
    model = learn(docs.filter(train), text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), predicted(F.col(text), model, docs.sparkSession).alias("p"))
    return rows.select("doc_id", "p.lang_pred", "p.score", "p.coverage")


@query("op1_language_masks")
def op1_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; the fifth of the folds that is 0 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, fold(F.col("doc_id"), 5) != 0)
    return found.select("doc_id", (F.coalesce(fold(F.col("doc_id"), 5), F.lit(0)) == 0).alias("held_out"), "lang_pred", "score", "coverage")


def acceptance_levels(docs: DataFrame, model: LanguageFilter, text: str = "text", lang: str = "lang", rate: float = 0.05,
                      share: float = 2 / 3) -> dict[str, float]:
    """Least coverage of a language: ``share`` of the ``rate`` quantile over its labelled texts that the filter gives it.

    The quantile lies low among a language's own texts, and texts of other languages lie well below it.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), predicted(F.col(text), model, docs.sparkSession).alias("p"))
    own = rows.filter((F.col("p.lang_pred") == F.col("lang")) & (F.col("p.coverage") > 0)).groupBy("lang")
    return {r["lang"]: share * r["low"] for r in own.agg(F.percentile_approx("p.coverage", rate).alias("low")).collect()}


def accepted(text: Column, model: LanguageFilter, spark: SparkSession, levels: dict[str, float]) -> Column:
    """Whether a text has a determined language, one of ``levels``, that knows at least that share of its trigrams."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = letter_table()
        for texts in batches:
            kept = []
            for some in some_texts(texts):
                found = shipped.value.decide([t or "" for t in some], letters)
                kept += ((found["lang_pred"] != UNDETERMINED) & (found["coverage"] >= found["lang_pred"].map(levels).astype("f8"))).tolist()
            yield pa.array(kept, pa.bool_())

    return decide(text)
