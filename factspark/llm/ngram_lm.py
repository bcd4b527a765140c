"""Word n-gram language model, compiled per shard into a weighted backoff automaton.

The model is whole (no count is cut off) and so grows with the corpus; no task ever holds it.
Documents are cut into chunks.  A chunk asks, in blocks of sorted hashes, for the counts of the
n-grams it holds; the blocks are shuffled to the buckets of the hash space, where the training counts
of all chunks meet, and the answers go back in the order of the questions.  Each chunk compiles the
smoothed n-grams it needs into states, arcs and failure arcs, and scores its documents in one
left-to-right traversal.

Smoothing: ``P(w|h) = (c(hw) + strength * P(w|h')) / (c(h.) + strength)`` with ``h'`` the shorter history;
at the bottom an absolute discount hands mass to one unknown word, over the same events as the
add-one base (all training tokens and one unknown).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm.common import fold, stored, table, text_of
from factspark.llm.registry import query

#: A chunk is closed once it holds so many tokens; documents are never split.
CHUNK_TOKENS = 1_000_000
START, END = 1, 2


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of every word, A-Z lower-cased, and the end token."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, dtype="u8")
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype="u8", count=len(words))
    out[-1] = END
    return out


def chained(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a history followed by a word."""
    x = history * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, byte planes apart, so that zero and slowly changing planes vanish."""
    return zlib.compress(np.ascontiguousarray(values).view("u1").reshape(-1, values.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype="u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "u8"), dtype="u8")


class Chunk:
    """Documents of one chunk as local numbers of their n-grams, order by order.

    ``grams[k]`` are the sorted hashes of the distinct (k+1)-grams, ``at[k]`` the number of the
    one that ends at each token.  A document's tokens follow a start mark that is no token.
    """

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, order: int):
        self.starts = starts
        first = np.zeros(len(tokens), dtype=bool)
        first[starts[:-1]] = True
        grams, at = np.unique(tokens, return_inverse=True)
        self.grams, self.at = [grams], [at.astype("i4")]
        past = tokens
        for _ in range(order - 1):
            history = np.empty_like(past)
            history[1:] = past[:-1]
            history[first] = START
            past = chained(history, tokens)
            grams, at = np.unique(past, return_inverse=True)
            self.grams.append(grams)
            self.at.append(at.astype("i4"))


class Automaton:
    """Smoothed n-grams as states with failure arcs.

    A state is a history whose n-gram occurs in the chunk; its arcs are the n-grams that the
    training text continues it with, weighted with their log10 probability.  The failure arc leads to
    the shorter history and carries the log10 of the mass left to it.  The empty history is state 0
    and has an arc for every word.
    """

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], stats: dict, starts_seen: int, strength: float):
        n, types, once, twice = stats["tokens"], stats["types"], stats["once"], stats["twice"]
        discount = once / (once + 2 * twice) if once and twice else 0.5
        unknown = discount * types / n if n else 1.0
        plain = np.where(counts[0] > 0, np.maximum(counts[0] - discount, 1e-12) / max(n, 1), max(unknown, 1e-300))
        order, sizes = len(counts), [len(g) for g in chunk.grams]
        self.word = chunk.at[0]
        self.words = sizes[0] + 1
        first = chunk.starts[:-1]
        # States: 0 empty, 1 document start, then the n-grams of each order but the highest.
        base = np.concatenate([[2], 2 + np.cumsum(sizes[:-1])]).astype("i8")
        total = int(base[order - 1])
        self.fail = np.zeros(max(total, 2), dtype="i8")
        self.weight = np.zeros(max(total, 2))
        seen = np.zeros(max(total, 2))
        seen[1] = starts_seen
        probability = [plain]
        self.arcs: dict[int, tuple[float, int]] = {}
        word_of, history_of = [np.arange(sizes[0])], [np.zeros(sizes[0], dtype="i8")]
        # Near its start a text has no history of full length; what stands there is a shorter n-gram again.
        depth, full = np.arange(len(self.word)) - np.repeat(first, np.diff(chunk.starts)), [None]
        for k in range(1, order):
            seen[base[k - 1]:base[k - 1] + sizes[k - 1]] = counts[k - 1]
            at, where = chunk.at[k], np.full(sizes[k], -1, dtype="i8")
            where[at[::-1]] = np.arange(len(at) - 1, -1, -1)  # the first place of each n-gram
            history = np.ones(sizes[k], dtype="i8")
            starts_here = np.isin(where, first)
            history[~starts_here] = base[k - 1] + chunk.at[k - 1][where[~starts_here] - 1]
            full.append(depth[where] >= k - 1)
            word_of.append(chunk.at[0][where])
            history_of.append(history)
            lower = probability[k - 1][chunk.at[k - 1][where]]
            probability.append((counts[k] + strength * lower) / (seen[history] + strength))
            if k < order - 1:
                self.fail[base[k]:base[k] + sizes[k]] = base[k - 1] + chunk.at[k - 1][where]
        live = seen > 0
        self.weight[live] = np.log10(strength / (seen[live] + strength))
        self.weight[0] = 0.0
        for k in range(order):
            # A history of this order continues as the longest state: the n-gram itself, below the highest order.
            target = base[k] + np.arange(sizes[k]) if k < order - 1 else (self.fail_target(chunk, k, base) if order > 1 else np.zeros(sizes[k], dtype="i8"))
            keep = np.flatnonzero((counts[k] > 0) & full[k]) if k else np.arange(sizes[0])
            keys = history_of[k][keep] * self.words + word_of[k][keep]
            self.arcs.update(zip(keys.tolist(), zip(np.log10(probability[k][keep]).tolist(), target[keep].tolist())))

    @staticmethod
    def fail_target(chunk: Chunk, k: int, base: np.ndarray) -> np.ndarray:
        where = np.zeros(len(chunk.grams[k]), dtype="i8")
        where[chunk.at[k][::-1]] = np.arange(len(chunk.at[k]) - 1, -1, -1)
        return base[k - 1] + chunk.at[k - 1][where]

    def score(self, a: int, b: int) -> float:
        """log10 probability of the tokens from a to b, carried from state to state."""
        total, state, arcs, words = 0.0, 1, self.arcs, self.words
        weight, fail = self.weight, self.fail
        for word in self.word[a:b].tolist():
            found = arcs.get(state * words + word)
            while found is None:
                total += weight[state]
                state = int(fail[state])
                found = arcs.get(state * words + word)
            total += found[0]
            state = found[1]
        return total


def chunk_rows(order: int, limit: int = CHUNK_TOKENS):
    """mapInPandas: (doc_id, held_out, text) rows to one row per chunk with all its documents, packed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, ids, held, size = [], [], [], 0

        def close() -> pd.DataFrame:
            tokens = np.concatenate(parts)
            grams, at = np.unique(tokens, return_inverse=True)
            ends = np.cumsum([len(p) for p in parts]).astype("i8")
            null = np.array([i is None for i in ids])
            return pd.DataFrame({"chunk": [int.from_bytes(np.random.default_rng().bytes(7), "little")], "words": [pack_sorted(grams)],
                                 "tokens": [pack(at.astype("u4"))], "ends": [pack(ends)],
                                 "ids": [pack(np.array([i or 0 for i in ids], dtype="i8"))],
                                 "null_ids": [pack(null.astype("u1"))], "held": [pack(np.array(held, dtype="u1"))]})

        for batch in batches:
            for i, out, text in zip(batch["doc_id"].tolist(), batch["held_out"].tolist(), batch["text"].tolist()):
                got = word_hashes(text)
                parts.append(got)
                ids.append(None if i is None or i != i else int(i))
                held.append(bool(out))
                size += len(got)
                if size >= limit:
                    yield close()
                    parts, ids, held, size = [], [], [], 0
        if parts:
            yield close()

    return run


CHUNKS = "chunk long, words binary, tokens binary, ends binary, ids binary, null_ids binary, held binary"


def opened(row, order: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk row as its n-grams, its words' hashes by token, and each document's end, id and fold."""
    words, tokens = unpack_sorted(row.words), unpack(row.tokens, "u4")
    ends = unpack(row.ends, "i8")
    ids = unpack(row.ids, "i8").astype(object)
    ids[unpack(row.null_ids, "u1") > 0] = None
    held = unpack(row.held, "u1") > 0
    hashes = words[tokens]
    return Chunk(hashes, np.concatenate([[0], ends]), order), hashes, ends, ids, held


def asked(order: int, buckets: int, orders: list[int]):
    """mapInPandas: chunk rows to blocks of n-grams by bucket, with their counts in training documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = (1 << 64) // buckets + 1
        for batch in batches:
            for row in batch.itertuples(index=False):
                chunk, _, ends, _, held = opened(row, order)
                trains = np.repeat(~held, np.diff(ends, prepend=0))
                for k in orders:
                    grams = chunk.grams[k]
                    counts = np.bincount(chunk.at[k][trains], minlength=len(grams)).astype("u4")
                    cuts = np.searchsorted(grams, (np.arange(1, buckets, dtype=object) * width).astype("u8"))
                    for bucket, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(grams)])):
                        if b > a:
                            yield pd.DataFrame({"bucket": [bucket * order + k], "chunk": [row.chunk], "k": [k], "part": [bucket],
                                                "grams": [pack_sorted(grams[a:b])], "counts": [pack(counts[a:b])]})

    return run


def answered(blocks: pd.DataFrame) -> pd.DataFrame:
    """All blocks of one bucket and order: the training counts of their n-grams, block by block.

    The bucket's totals (of words: tokens, types, seen once, seen twice) stand in its first row.
    """
    hashes = [unpack_sorted(x) for x in blocks["grams"]]
    sizes = np.cumsum([len(h) for h in hashes])[:-1]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    del hashes
    counts = np.bincount(at, weights=np.concatenate([unpack(x, "u4") for x in blocks["counts"]]), minlength=len(every)).astype("i8")
    out = blocks[["chunk", "k", "part"]].copy()
    out["counts"] = [pack(counts[x].astype("u4")) for x in np.split(at, sizes)]
    for name, value in (("tokens", counts.sum()), ("types", (counts > 0).sum()), ("once", (counts == 1).sum()), ("twice", (counts == 2).sum())):
        out[name] = [int(value)] + [0] * (len(out) - 1)
    return out


ASKED = "bucket long, chunk long, k int, part int, grams binary, counts binary"
ANSWERED = "chunk long, k int, part int, counts binary, tokens long, types long, once long, twice long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = 2,
                strength: float = 500.0, bucket_tokens: int = 4_000_000) -> DataFrame:
    """Scores of all documents by a model learned from those that ``held_out`` does not mark.

    One row per input row: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens,
    base_score (add-one unigrams) and score (log10 probability under the model).  Null text is
    an empty text: the end token alone.  Null ids stay null; null ``held_out`` counts as true, so
    such rows are scored and not learned from.  An empty table gives no rows; with no training
    document every token is the one unknown word of probability 1.

    Counts are exact up to collisions of 64-bit hashes.  Memory of a task: one chunk (about
    1 million tokens, or one longer document), or one bucket (about ``bucket_tokens`` n-grams:
    the number of buckets follows the number of tokens).
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), text_of(F.col(text)).alias("text"))
    chunks = stored(rows.mapInPandas(chunk_rows(order), CHUNKS))
    size = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    packed = chunks.agg(size("tokens").alias("tokens")).first()["tokens"]  # about 2 bytes a token
    buckets = max(8, math.ceil(packed / 2 / bucket_tokens))

    def answers(orders: list[int]) -> DataFrame:
        blocks = chunks.mapInPandas(asked(order, buckets, orders), ASKED)
        return blocks.groupBy("bucket").applyInPandas(answered, ANSWERED)

    found = stored(answers(list(range(order))))
    sums = found.filter("k = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "twice")]).first().asDict()
    seen = docs.select(F.coalesce(held_out, F.lit(True)).alias("h")).filter("not h").count()

    def scored(chunk_rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        outs = []
        for row in chunk_rows.itertuples(index=False):
            chunk, _, ends, ids, held = opened(row, order)
            counts = []
            for k in range(order):
                mine = counted[counted["k"] == k].sort_values("part")
                counts.append(np.concatenate([unpack(x, "u4") for x in mine["counts"]]).astype("f8"))
            automaton = Automaton(chunk, counts, sums, seen, strength)
            base = np.log10((counts[0] + 1) / (sums["tokens"] + sums["types"] + 1))[chunk.at[0]]
            known = (counts[0] > 0)[chunk.at[0]]
            first = np.concatenate([[0], ends[:-1]])
            outs.append(pd.DataFrame({
                "doc_id": pd.array(ids, dtype="Int64"), "held_out": held, "n_tokens": ends - first,
                "n_known": np.add.reduceat(known.astype("i8"), first), "train_tokens": sums["tokens"],
                "base_score": np.add.reduceat(base, first), "score": [automaton.score(a, b) for a, b in zip(first.tolist(), ends.tolist())]}))
        return pd.concat(outs) if outs else pd.DataFrame({c.split()[0]: [] for c in SCORED.split(", ")})

    sides = chunks.groupBy("chunk"), found.select("chunk", "k", "part", "counts").groupBy("chunk")
    return sides[0].cogroup(sides[1]).applyInPandas(scored, SCORED)


@query("op4_backoff_automaton")
def op4_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and model score of every document; the seventh of the folds that is 2 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, fold(F.col("doc_id"), 7) == 2)
