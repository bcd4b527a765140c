"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of shingles with their places.  Shingles are ordered by how often the documents have
them, rarest first.  A document's stretch that contains a share of a window's shingles has at least one of the
window's ``m - ceil(share * m) + 1`` rarest: only these prefix shingles are joined.  A shared shingle fixes where the window would
lie in the document, which must have the room; its words are then compared over the whole window.

The benchmark meets the documents in joins; a bit map of fixed size tells tasks which shingles are worth
sending.  A document's text is read twice and never moves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factspark.llm.common import stored, table, text_of
from factspark.llm.registry import query

#: Runs of digits, small letters and characters beyond ASCII, in UTF-8 after A-Z are lower-cased.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bits of the map of shingles: 16 MB, whatever the benchmark's size.  A full map costs rows, not results.
MAP_BITS = 1 << 27
PAGE_BITS = 1 << 15
#: Shingles that make more than this part of all that the documents share with the items are dealt to SALTS groups.
HOT_SHARE, SALTS = 1 / 500, 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "replace").lower())


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """A 63-bit hash of every ``size`` consecutive words; hashes of different sizes differ."""
    import xxhash

    one = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype="u8", count=len(words))
    out = np.full(max(len(one) - size + 1, 0), size, dtype="u8")
    for k in range(size):
        out = (out ^ one[k:len(one) - size + 1 + k]) * FACTOR
        out ^= out >> np.uint64(31)
    return (out >> np.uint64(1)).astype("i8")


class Bits:
    """A set of hashes as a bit map made of pages (bucket number from 1, bytes) of Spark's bit map functions."""

    def __init__(self, pages: list[tuple[int, bytes]]):
        self.map = np.zeros(MAP_BITS // 8, dtype="u1")
        for number, page in pages:
            a = (number - 1) * PAGE_BITS // 8
            self.map[a:a + len(page)] = np.frombuffer(page, dtype="u1")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (MAP_BITS - 1)
        return self.map[at >> 3] >> (at & 7).astype("u1") & 1 == 1


def bit_map(hashes: DataFrame) -> Bits:
    """Of the column ``h``; at most ``MAP_BITS`` reach the driver."""
    at = F.col("h").bitwiseAND(MAP_BITS - 1)
    pages = hashes.groupBy(F.bitmap_bucket_number(at + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits"))
    return Bits([(r["page"], bytes(r["bits"])) for r in pages.collect()])


def item_windows(items: DataFrame, item_id: str, text: str, window: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, length, words, hashes, each shingle's size) and which items have them (wid, item_id).

    An item of fewer words than ``window``, but not none, is one window; its shingles are no longer than it is.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, words, lengths = [], [], []
            for k, value in enumerate(batch.column(1)):
                own = terms(value.as_py())
                n = min(window, len(own))
                starts = range(len(own) - n + 1) if own else ()
                words += [b" ".join(own[a:a + n]).decode() for a in starts]
                owner += [k] * len(starts)
                lengths += [n] * len(starts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(lengths, pa.int32()), pa.array(words, pa.string())],
                                             names=["item_id", "length", "words"])

    kind = items.schema[item_id].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("length", T.IntegerType()), T.StructField("words", T.StringType())])
    found = stored(items.select(F.col(f"`{item_id}`").alias("item_id"), text_of(F.col(f"`{text}`")).alias("text")).mapInArrow(cut, schema).distinct())

    @F.arrow_udf("array<bigint>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            own = [v.as_py().encode().split(b" ") for v in batch]
            yield pa.array([shingles(w, min(size, len(w))) for w in own], pa.list_(pa.int64()))

    windows = stored(found.select("length", "words").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("hashes", hashed("words")))
    return windows, found.join(windows.select("words", "wid"), "words").select("wid", "item_id")


def shingle_counts(docs: DataFrame, text: str, wanted: Bits, sizes: list[int]) -> DataFrame:
    """(h, n): how often the documents have the shingles of ``wanted``, added up in every task before they move."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, dtype="i8")]
            for value in batch.column(0):
                words = terms(value.as_py())
                for size in sizes:
                    own = shingles(words, size)
                    found.append(own[wanted.has(own)])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

    return docs.select(text_of(F.col(f"`{text}`")).alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame, share: float) -> DataFrame:
    """(h, wid, place, length, words, need): of every window its rarest shingles, as many as any match must meet."""
    each = windows.select("wid", "length", "words", F.size("hashes").alias("m"), F.posexplode("hashes").alias("place", "h"))
    each = each.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    need = F.ceil(F.lit(share) * F.col("m") - 1e-9)
    # At most ``window`` shingles a window.
    order = F.row_number().over(Window.partitionBy("wid").orderBy("n", "h", "place"))
    each = each.withColumn("need", need).withColumn("rank", order).filter(F.col("rank") <= F.col("m") - F.col("need") + 1)
    return each.filter("n > 0").select("h", "wid", "place", "length", "words", "need", "n")


def placed(docs: DataFrame, text: str, wanted: Bits, hot: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """Rows of ``docs`` without the text, with n_words and hits: h, at (the shingle's place), from (the first word of ``near``), near, salt.

    ``near`` has the words around the shingle that a window over it can cover.
    """
    rest = docs.drop(text)
    hit = T.StructType([T.StructField(n, t) for n, t in (("h", T.LongType()), ("at", T.LongType()), ("from", T.LongType()), ("near", T.StringType()), ("salt", T.IntegerType()))])
    schema = T.StructType([*rest.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit))])
    arrow = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64()), ("from", pa.int64()), ("near", pa.string()), ("salt", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, hits = [], []
            for value in batch.column(0):
                words, own = terms(value.as_py()), []
                for size in sizes:
                    found = shingles(words, size)
                    for at in np.flatnonzero(wanted.has(found)).tolist():
                        h, a = int(found[at]), max(0, at - window + size)
                        salt = (at + len(words)) % SALTS if hot.size and hot[min(np.searchsorted(hot, h), hot.size - 1)] == h else 0
                        own.append({"h": h, "at": at, "from": a, "near": b" ".join(words[a:at + window]).decode(), "salt": salt})
                n_words.append(len(words))
                hits.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n_words, pa.int64()), pa.array(hits, arrow)], names=schema.names)

    return docs.select(text_of(F.col(f"`{text}`")).alias("_text"), *[F.col(f"`{c}`") for c in rest.columns]).mapInArrow(run, schema)


def matching(hits: DataFrame, wanted: DataFrame, share: float, size: int) -> DataFrame:
    """(row, start, length, wid) of the windows that lie in the documents: those with room, compared word by word.

    With a share below 1 the shingles that both have at the same place are counted.
    """
    start = F.col("at") - F.col("place")
    both = hits.join(wanted, ["h", "salt"]).filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    # ``near`` begins at ``from``: the window's words there are items of an array of at most three windows.
    there = F.slice(F.split("near", " "), (start - F.col("from") + 1).cast("int"), F.col("length"))
    if share >= 1:
        same = F.array_join(there, " ") == F.col("words")
    else:
        def grams(words: Column) -> Column:
            width = F.least(F.lit(size), F.col("length"))
            return F.transform(F.sequence(F.lit(1), F.col("length") - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))

        equal = F.zip_with(grams(there), grams(F.split("words", " ")), lambda x, y: (x == y).cast("int"))
        same = F.aggregate(equal, F.lit(0), lambda n, x: n + x) >= F.col("need")
    return both.filter(same).select("row", start.alias("start"), "length", "wid").distinct()


def covered(spans: Column) -> Column:
    """Words that spans (structs start, end) cover; they are sorted first."""
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10,
                 size: int = 3, share: float = 1.0) -> DataFrame:
    """The input's rows without their text, with n_words, n_hit and items.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased.  A window is ``window`` consecutive
    words of an item; an item of fewer words, but not none, is one window.  ``n_hit`` counts the document's words inside any
    occurrence of a window, ``items`` has the ids (as strings, sorted, distinct) of the items whose windows occur.  With ``share``
    below 1 a stretch of the window's length counts that has at least this share of the window's ``size``-word shingles,
    each at its own place.  Null texts have no words; null item ids have windows but are not listed.  Rows are never dropped, repeated rows and
    repeated items stay repeated or count once.  Input columns with the result's names are replaced.
    """
    made = ["n_words", "n_hit", "items"]
    rest = docs.drop(*[c for c in docs.columns if c.lower() in made])
    keep = [c for c in rest.columns if c != text]
    # The input's own columns travel in a struct, so no name of theirs can clash.
    rows = rest.select((F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(True)).alias("own"),
                       F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))

    windows, owners = item_windows(items, item_id, item_text, window, size)
    sizes = sorted(r[0] for r in windows.select(F.least(F.lit(size), "length")).distinct().collect())  # at most ``size`` numbers
    known = windows.select(F.explode("hashes").alias("h")).distinct()
    counts = stored(shingle_counts(rows, "text", bit_map(known), sizes).join(known, "h", "left_semi"))
    wanted = stored(prefixes(windows, counts, share))
    total = wanted.select("h", "n").distinct().agg(F.sum("n")).first()[0] or 0
    hot = np.array(sorted(r[0] for r in wanted.filter(F.col("n") > HOT_SHARE * total).select("h").distinct().collect()), dtype="i8")  # at most 1 / HOT_SHARE

    found = stored(placed(rows, "text", bit_map(wanted.select("h").distinct()), hot, sizes, window))
    hits = found.select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.*")
    salts = F.when(F.col("h").isin(hot.tolist()), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    links = stored(matching(hits, wanted.withColumn("salt", F.explode(salts)), share, size))

    spans = links.select("row", F.struct("start", (F.col("start") + F.col("length")).alias("end")).alias("span")).distinct()
    n_hit = spans.groupBy("row").agg(covered(F.collect_list("span")).alias("n_hit"))
    named = links.select("row", "wid").distinct().join(owners, "wid").select("row", F.col("item_id").cast("string").alias("item"))
    named = named.distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = found.select("row", "own", "n_words").join(n_hit, "row", "left").join(named, "row", "left")
    return out.select(*[F.col("own")[c].alias(c) for c in keep], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


@query("op13_prefix_join", r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[a : a + least(10, len(w)) - 1], ' ') AS g
      FROM b, LATERAL (SELECT unnest(range(1, greatest(0, len(w) - 9) + CASE WHEN len(w) BETWEEN 1 AND 9 THEN 2 ELSE 1 END)) AS a) WHERE len(w) > 0),
o AS (SELECT rid, a, n, array_to_string(w[a : a + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM i), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS a)),
m AS MATERIALIZED (SELECT rid, a, o.n, item_id FROM o JOIN i ON o.g = i.g AND o.n = i.n),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(a, a + n)) AS p FROM (SELECT DISTINCT rid, a, n FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
""")
def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items, and the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
