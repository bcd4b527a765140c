"""SimHash near-duplicates by meet-in-the-middle ball hashing; near copies of texts by min-hash bands.

Two fingerprints within ``2 * half`` bits have a common variant within ``half`` bits of both.  Every
distinct fingerprint therefore emits all its variants within ``half`` bits; variants are the shuffle
key.  A variant's rows are at most its own ball (65 fingerprints of 64 bits for one bit), however
many documents there are, and any two of them are within ``2 * half`` bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspark.llm.common import components, spanning, stored, table, text_of
from factspark.llm.language_id import some_texts
from factspark.llm.registry import query

PART = 50_000


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, most significant first."""
    total = np.zeros(64, dtype="i8")
    for a in range(0, len(values), PART):
        octets = values[a:a + PART].astype(">u8").view("u1").reshape(-1, 8)
        total += np.unpackbits(octets, axis=1).sum(axis=0, dtype="i8")
    return total


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all ``size``-word shingles, A-Z lower-cased, repeats included.

    Fewer words make one shingle; no word makes none.
    """
    import xxhash

    hashed = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="u8")
    if len(words) <= size:
        return np.array([hashed(b" ".join(words), seed)], dtype="u8")
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.fromiter((hashed(s, seed) for s in shingles), dtype="u8", count=len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half the hashes have it; zero without hashes.  Signed 64 bits."""
    ones = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(ones).view(">i8")[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    """The 64-bit SimHash (long) of a text's word shingles; null text counts as empty (zero)."""
    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(shingle_hashes(t or "", size)) for t in texts], dtype="int64")

    return compute(text_of(text))


def masks(bits: int, half: int) -> list[int]:
    """All flips of up to ``half`` of ``bits`` bits, as signed 64-bit masks; no flip first."""
    found = [sum(1 << b for b in flips) for k in range(half + 1) for flips in combinations(range(bits), k)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball_links(prints: DataFrame, fp: str = "fp", bits: int = 64, half: int = 1, band: str | None = None) -> DataFrame:
    """Links a < b between distinct fingerprints that connect all pairs within ``2 * half`` bits.

    In each variant's ball every fingerprint is linked to the ball's smallest and to the one before
    it.  All pairs of a ball would say no more about who is connected.  Links are distinct and verified.
    ``band`` names a column within which alone fingerprints are compared.
    """
    bands = [band] if band else []
    rows = prints.select(*bands, F.col(fp).alias("a")).distinct()
    flips = F.array(*[F.lit(m).cast("long") for m in masks(bits, half)])
    rows = rows.select(*bands, "a", F.explode(flips).alias("flip")).select(*bands, "a", F.col("a").bitwiseXOR(F.col("flip")).alias("variant"))
    ball = Window.partitionBy(*bands, "variant").orderBy("a")
    rows = rows.select(*bands, "a", F.first("a").over(ball).alias("least"), F.lag("a").over(ball).alias("prior"))
    rows = rows.filter("least < a").select(*bands, F.col("a").alias("b"), F.explode(F.array_distinct(F.array("least", "prior"))).alias("a"))
    rows = rows.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2 * half)
    return rows.select(*bands, "a", "b").distinct()


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id.

    ``component_id`` is the smallest doc_id among documents that links within 2 bits reach, the row
    itself included.  Documents without words have fingerprint zero and are linked like any other.
    Null ids are never the smallest; a component with null ids only has a null component_id.
    Repeated rows stay repeated.
    """
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), size).alias("fp")))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = components(ball_links(prints), "a", "b")
    placed = prints.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(smallest, "root").select("fp", "component_id")
    return rows.join(placed, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@query("op3_simhash_balls")
def op3_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


# ---- Near-duplicate texts: bands of min-hashes find candidates, exact Jaccard of shingle hashes decides.

#: Two sets of Jaccard J share a band with J^6, and none of 30 with (1 - J^6)^30: 0.0001 at 0.8.
BANDS, IN_BAND = 30, 6
BLOCK = 256
FACTORS = np.random.default_rng(5).integers(1 << 63, size=BANDS * IN_BAND + IN_BAND, dtype="u8") * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, of the least of its permuted hashes.  Equal without hashes."""
    least = np.full(BANDS * IN_BAND, np.iinfo("u8").max, dtype="u8")
    for a in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[a:a + 512, None] * FACTORS[:BANDS * IN_BAND]).min(axis=0))
    least ^= least >> np.uint64(32)
    keys = (least.reshape(BANDS, IN_BAND) * FACTORS[BANDS * IN_BAND:]).sum(axis=1, dtype="u8") + np.arange(BANDS, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ keys >> np.uint64(29)).view("i8")


def lists_of(batches: Iterator[pa.Array], use) -> Iterator[pa.Array]:
    """``use`` of every text of Arrow batches, arrays of longs: a few texts are strings at once, and their arrays leave before the next."""
    for texts in batches:
        for some in some_texts(texts):
            found = [use(t or "") for t in some]
            ends = np.cumsum([0, *map(len, found)], dtype="i4")
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype("i8", copy=False)))


def hashed(text: Column, size: int, use) -> Column:
    """``use`` of a text's set of shingle hashes, as an array of longs."""
    @F.arrow_udf("array<long>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lists_of(batches, lambda t: use(shingle_set(t, size)))

    return compute(text_of(text))


def prints_and_keys(text: Column, size: int) -> Column:
    """A text's SimHash fingerprint, then its band keys: one pass over the text for both."""
    @F.arrow_udf("array<long>")
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lists_of(batches, lambda t: np.append(simhash(shingle_hashes(t, 3)), band_keys(shingle_set(t, size))))

    return compute(text_of(text))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the left sets shares with each of the right."""
    ends = np.cumsum([len(x) for x in right])
    names, at = np.unique(np.concatenate([*right, np.empty(0, dtype="i8")]), return_inverse=True)
    out = np.zeros((len(left), len(right)), dtype="i8")
    for k, x in enumerate(left):
        has = np.zeros(len(names), dtype="i8")
        has[np.searchsorted(names, x[np.isin(x, names)])] = 1
        total = np.concatenate([[0], np.cumsum(has[at])])
        out[k] = total[ends] - total[ends - [len(y) for y in right]]
    return out


def block_links(rows: DataFrame, similarity: float) -> DataFrame:
    """(key, size, tid, root, set) to verified links a < b of sets with one key and different roots.

    All pairs are compared: a key's sets are dealt into blocks of about ``BLOCK``, and each pair of blocks is a group of
    rows.  Of a group's verified pairs those stay that connect it.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("tid", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "tid", "root", "set")

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        left, right = own[own["own"] == own["i"].iloc[0]], own[own["own"] == own["j"].iloc[0]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        both = shared_counts(left["set"].tolist(), right["set"].tolist())
        union = left["set"].map(len).to_numpy()[:, None] + right["set"].map(len).to_numpy()[None, :] - both
        near = (both / np.maximum(union, 1) >= similarity) & (left["root"].to_numpy()[:, None] != right["root"].to_numpy()[None, :])
        x, y = np.nonzero(near)
        x, y = left["tid"].to_numpy()[x], right["tid"].to_numpy()[y]
        keep = spanning(x, y)
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep]})

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The input without exact and near copies: of every group of texts one row stays, all columns kept.

    Texts whose SimHash fingerprints differ in 2 bits or fewer are copies (``ball_links``).  Fingerprints of close copies often
    differ in more, so texts are also alike from ``similarity`` on: the Jaccard similarity of their sets of ``size``-word shingle hashes,
    which is computed for every link.  Texts that share none of ``BANDS`` keys are not compared; of pairs at 0.8
    that is one in 9,000, of more similar ones fewer.  Groups are connected components.  The row with the smallest id stays
    (null last), one of them if it is repeated.  Null text counts as empty; texts without words are one group.

    All pairs with a common key count.  Each text is first compared with the key's smallest; then all others of a key that
    this has not connected are compared with each other, so one that is like none of them hides no pair.
    """
    k1, k2 = F.xxhash64(text_of(F.col(text))), F.xxhash64(F.lit(1), text_of(F.col(text)))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), order.alias("o"), prints_and_keys(F.col(text), size).alias("marks"))
    texts = rows.groupBy("k1", "k2").agg(F.min("o").alias("o"), F.first("marks").alias("marks"))
    texts = stored(texts.select("k1", "k2", "o", F.get("marks", F.lit(0)).alias("fp"), F.slice("marks", 2, BANDS).alias("keys"), F.monotonically_increasing_id().alias("tid")))

    # Copies by fingerprint: texts of one fingerprint by its smallest, fingerprints by their balls.
    prints = stored(texts.groupBy("fp").agg(F.min("tid").alias("least")))
    same = texts.join(prints, "fp").filter("tid <> least").select(F.col("least").alias("a"), F.col("tid").alias("b"))
    close = ball_links(prints)
    for side in ("a", "b"):
        close = close.join(prints.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}")), side)
    copies = same.union(close.select("least_a", "least_b"))

    banded = texts.select("tid", F.explode("keys").alias("key"))
    groups = banded.groupBy("key").agg(F.min("tid").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(banded.join(groups, "key"))
    # Sets are made for texts with a partner only, from one row of each text.
    wanted = texts.join(members.select("tid").distinct(), "tid").select("k1", "k2", "tid")
    each = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text")).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    sets = stored(each.join(wanted, ["k1", "k2"]).select("tid", hashed(F.col("text"), size, lambda x: x.view("i8")).alias("set")))

    links = members.filter("tid <> rep").select(F.col("rep").alias("a"), F.col("tid").alias("b")).distinct()
    for side in ("a", "b"):
        links = links.join(sets.select(F.col("tid").alias(side), F.col("set").alias(f"set_{side}")), side)
    links = links.withColumn("both", F.size(F.array_intersect("set_a", "set_b"))).withColumn("any", F.size("set_a") + F.size("set_b") - F.col("both"))
    links = stored(links.filter((F.col("any") == 0) | (F.col("both") / F.col("any") >= similarity)).select("a", "b").union(copies))

    reach = components(links, "a", "b").select(F.col("node").alias("tid"), "root")
    rest = members.filter("n > 2 and tid <> rep").join(reach, "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("root"))
    rest = stored(rest)
    apart = rest.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    more = block_links(rest.join(apart.select("key", "size"), "key").join(sets, "tid"), similarity)

    reach = components(links.union(more), "a", "b")
    placed = stored(reach.join(texts.select(F.col("tid").alias("node"), "k1", "k2", "o"), "node"))
    first = placed.groupBy("root").agg(F.min(F.struct("o", "node")).alias("first"))
    gone = placed.join(first, "root").filter(F.col("node") != F.col("first.node")).select("k1", "k2")

    whole = docs.select(k1.alias("k1"), k2.alias("k2"), order.alias("o"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = whole.groupBy("k1", "k2").agg(F.min_by("row", "o").alias("row"))
    return one.join(gone, ["k1", "k2"], "left_anti").select("row.*")
