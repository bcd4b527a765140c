"""Runs of periodically repeated words, found by internal pattern matching.

Every aligned block of ``2**k`` words is looked up in the words before and after it: the suffix array has all
occurrences of a block in one range, and a wavelet tree over that range answers with the next and the previous
one.  Neighbouring occurrences are a progression whose step is the period of what they cover.  A run of period q and
length 4q or more holds an aligned block of more than q and at most 2q words whose neighbour is q words away, so
blocks of one size give the periods of one octave, and no run is missed.  Candidates are then extended both
ways by the ranks of substrings.

Texts are dealt with in groups of about ``GROUP_WORDS`` words within a task; there is no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspark.llm.common import WORD, bound, table, text_of
from factspark.llm.registry import query

GROUP_WORDS = 200_000
MADE = ("n_words", "runs", "collapsed")
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def substring_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """For widths 1, 2, 4, ...: how many suffixes begin with a smaller substring of that width than each position's.

    Equal substrings have equal ranks, and a rank is also where their range of the suffix array begins.  The last array has
    distinct ranks: it is the inverse of the suffix array.  The last symbol must occur once.
    """
    counts = np.bincount(symbols)
    rank = (np.cumsum(counts) - counts)[symbols]
    shared = np.flatnonzero(counts[symbols] > 1)
    levels, width = [rank.astype("i4")], 1
    while len(shared):
        key = rank[shared] * len(symbols) + rank[shared + width]
        order = np.argsort(key, kind="stable")
        key, moved = key[order], shared[order]
        place = np.arange(len(key))
        fresh = np.append(True, key[1:] != key[:-1])
        own = rank[moved]
        first = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), place, 0))
        rank = rank.copy()
        rank[moved] = own + np.maximum.accumulate(np.where(fresh, place, 0)) - first
        part = np.cumsum(fresh) - 1
        shared = np.sort(moved[np.bincount(part)[part] > 1])
        levels.append(rank.astype("i4"))
        width *= 2
    return levels


class WaveletTree:
    """Order statistics of ranges of an array of distinct numbers below its length; all arguments are arrays of queries."""

    def __init__(self, values: np.ndarray):
        self.bits = list(range(int(len(values)).bit_length() - 1, -1, -1))
        self.zeros = []
        for b in self.bits:
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.append(0, np.cumsum(~one)).astype("i4"))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of [lo, hi) are less than x."""
        found = np.zeros(len(x), dtype="i8")
        for b, zeros in zip(self.bits, self.zeros):
            one = (x >> b & 1).astype(bool)
            low, high = zeros[lo], zeros[hi]
            found += np.where(one, high - low, 0)
            lo, hi = np.where(one, zeros[-1] + lo - low, low), np.where(one, zeros[-1] + hi - high, high)
        return found

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of [lo, hi) that k others of it are less than."""
        found = np.zeros(len(k), dtype="i8")
        for b, zeros in zip(self.bits, self.zeros):
            low, high = zeros[lo], zeros[hi]
            one = k >= high - low
            found |= one.astype("i8") << b
            k = k - np.where(one, high - low, 0)
            lo, hi = np.where(one, zeros[-1] + lo - low, low), np.where(one, zeros[-1] + hi - high, high)
        return found

    def neighbours(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The successor and the predecessor of x among the values of [lo, hi), which has x: (which queries have one, its value)."""
        before = self.below(lo, hi, x)
        for place in (before + 1, before - 1):
            has = np.flatnonzero((place >= 0) & (place < hi - lo))
            yield has, self.nth(lo[has], hi[has], place[has])


def extended(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest [start, end) around ``at`` in which every symbol equals the one ``period`` later."""
    size, last = len(levels[0]), len(levels[0]) - 1
    right, left = at.copy(), at.copy()
    for k in range(len(levels) - 2, -1, -1):
        rank, width = levels[k], 1 << k
        there = right + period
        right += width * ((there < size) & (rank[np.minimum(right, last)] == rank[np.minimum(there, last)]))
        here = left - width
        left -= width * ((here >= 0) & (rank[np.maximum(here, 0)] == rank[np.maximum(here, 0) + period]))
    return left, right + period


def runs(symbols: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period: at least ``least`` symbols and ``times`` >= 4 periods long.

    The last symbol must occur once; so no run touches it.
    """
    levels = substring_ranks(symbols)
    size = len(symbols)
    tree, found = None, []
    for k, rank in enumerate(levels[1:-1], 1):
        width = 1 << k
        at = np.arange(0, size - width + 1, width)
        lo = rank[at].astype("i8")
        hi = lo + np.bincount(rank, minlength=size)[lo]
        twice = hi - lo > 1
        at, lo, hi = at[twice], lo[twice], hi[twice]
        if not len(at):
            continue
        if tree is None:
            suffixes = np.empty(size, dtype="i8")
            suffixes[levels[-1]] = np.arange(size)
            tree = WaveletTree(suffixes)
        for has, near in tree.neighbours(lo, hi, at):
            period = np.abs(near - at[has])
            octave = (period >= width // 2) & (period < width)
            found.append(np.stack([np.minimum(near, at[has])[octave], period[octave]]))
    if not found:
        return np.empty((0, 3), dtype="i8")
    at, period = np.concatenate(found, axis=1)
    start, end = extended(levels, at, period)
    long = end - start >= np.maximum(least, times * period)
    # By start, then period: that is how unique() sorts rows.
    return np.unique(np.stack([start, period, end], axis=1)[long], axis=0)[:, [0, 2, 1]]


def group_runs(texts: list[list[bytes]], least: int, times: int) -> list[np.ndarray]:
    """The runs of each text.  A word's number is its text's own, and each text ends with a number of its own: no run crosses texts."""
    numbers = count()
    symbols = np.empty(sum(map(len, texts)) + len(texts), dtype="i8")
    ends, a = [], 0
    for words in texts:
        own = defaultdict(numbers.__next__)
        b = a + len(words)
        symbols[a:b] = list(map(own.__getitem__, words))
        symbols[b] = next(numbers)
        ends.append(b)
        a = b + 1
    found = runs(symbols, least, times)
    at = np.searchsorted(ends, found[:, 0])
    cuts = np.searchsorted(at, np.arange(len(texts) + 1))
    begins = [0] + [e + 1 for e in ends[:-1]]
    return [found[x:y] - [[begin, begin, 0]] for x, y, begin in zip(cuts[:-1], cuts[1:], begins)]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one blank."""
    if not len(found):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype="i8")
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    return b" ".join(map(words.__getitem__, keep.tolist()))


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """The input's rows without their text, with n_words, runs (array of struct start, length, period; by start, then period), collapsed.

    A run is a stretch of words, numbered from 0, with smallest period q, at least ``max(least, times * q)`` words
    long, that neither neighbour extends; ``times`` is 4 or more.  ``collapsed`` has the words that no run holds after its first
    q, joined by one blank.  Null and empty texts have no words and no run.  Input columns of these names are replaced; rows are
    never dropped, repeated rows stay repeated.  A text is read whole in one task, with memory for
    n log n numbers of four bytes, n being the words of its group or of the text if that is longer.
    """
    if times < 4:
        raise ValueError("blocks find runs of four periods or more")
    keep = [c for c in docs.columns if c != text and c.lower() not in MADE]
    # The input's own columns travel in a struct, so no name of theirs can clash.
    own = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(True)
    rest = docs.select(text_of(F.col(f"`{text}`")).alias("text"), own.alias("own"))
    schema = T.StructType([rest.schema["own"], *T.StructType.fromDDL(RESULT).fields])
    kinds = [pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            found = group_runs(texts, least, times)
            spans = np.concatenate([np.empty((0, 3), dtype="i8"), *found])
            spans = pa.StructArray.from_arrays([pa.array(v) for v in (spans[:, 0], spans[:, 1] - spans[:, 0], spans[:, 2])], names=["start", "length", "period"])
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            columns = [pa.array(list(map(len, texts)), kinds[0]), pa.ListArray.from_arrays(offsets, spans),
                       pa.array([collapsed(w, f).decode("utf-8", "replace") for w, f in zip(texts, found)], kinds[2])]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=schema.names)

        for batch in batches:
            group, size, begin = [], 0, 0
            for at, value in enumerate(batch.column(0)):
                words = (value.as_py() or "").encode("utf-8", "replace").split()
                if group and size + len(words) > GROUP_WORDS:
                    yield rows(batch.slice(begin, at - begin), group)
                    group, size, begin = [], 0, at
                group.append(words)
                size += len(words)
            yield rows(batch.slice(begin), group)

    return rest.mapInArrow(run, schema).select(*[F.col("own")[c].alias(c) for c in keep], *MADE)


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text, of whose documents one in ten (by crc32 of the id) repeats a stretch of its words to the end, as the query's contract plants them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w)), " ")

    words = F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))
    return F.when(h % 10 == 0, bound(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))).otherwise(text)


@query("op11_internal_patterns")
def op11_internal_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of every document with planted repeats, and digests of all its runs and of what stays."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text")))
    # Greatest length, then smallest start, then smallest period.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("_top", top)
    period = -F.col("_top.p")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.s")).alias("start"), F.col("_top.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("_top.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
