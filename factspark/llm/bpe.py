"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per Spark partition.

Every distinct piece of a partition's texts becomes a row of tokens, byte by byte.  A recursive
query spreads the tokens by position, joins neighbouring pairs with the merge table and contracts
each piece's leftmost pair of least rank, until no piece has a pair left.  Decoding joins tokens
with the vocabulary and aggregates their bytes in order.  Texts are then put together from pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspark.llm.common import table
from factspark.llm.registry import query

CHUNK_CHARS = 2_000_000
MAX_PIECES = 400_000
LONG_PIECE = 512

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The contractions that the public splitting pattern treats as pieces.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

ENCODE = """
WITH RECURSIVE step AS (
  SELECT piece, tokens, false AS done FROM pieces
  UNION ALL
  SELECT s.piece,
         CASE WHEN best IS NULL THEN tokens ELSE list_concat(
           list_append(tokens[:(best & 16777215) - 1], (best >> 24)::INTEGER), tokens[(best & 16777215) + 2:]) END,
         best IS NULL
  FROM (FROM step WHERE NOT done) s
  LEFT JOIN (
    SELECT piece, min((token::BIGINT << 24) | position) AS best
    FROM (SELECT piece, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b, unnest(range(1, len(tokens))) AS position
          FROM step WHERE NOT done)
    JOIN merges ON first = a AND second = b
    GROUP BY piece) USING (piece)
)
SELECT piece, tokens FROM step WHERE done ORDER BY piece
"""
DECODE = """
SELECT piece, unhex(array_to_string(list(hex ORDER BY position), '')) AS bytes
FROM (SELECT piece, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS position FROM coded)
JOIN vocabulary USING (token) GROUP BY piece ORDER BY piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank in every line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def char_classes(letters: str = r"\p{L}", numbers: str = r"\p{N}") -> bytes:
    """A class for every code point, as the splitting pattern sees it."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    classes = np.zeros(0x110000, dtype="u1")
    for kind, pattern in ((LETTER, letters), (NUMBER, numbers), (SPACE, r"\p{White_Space}")):
        for found in regex.finditer(pattern + "+", every):
            classes[found.start():found.end()] = kind
    return classes.tobytes()


def piece_bounds(text: str, classes: np.ndarray) -> np.ndarray:
    """Where the pieces of a non-empty text begin, and its length.

    A piece is a run of letters, of numbers or of other visible characters, each with one blank
    before it if there is one; or a contraction; or white space, of which the last character
    before visible text stands alone (or is that blank).
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = classes[points]
    n = len(points)
    start = np.empty(n + 1, dtype=bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    edge = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
    start[edge] = True
    start[edge[points[edge] == 32] + 1] = False
    for at in np.flatnonzero((points[:-1] == 39) & start[:n - 1] & (kind[1:] == LETTER)).tolist():
        for short in CONTRACTIONS:
            if text.startswith(short, at):
                start[at + 1] = False
                start[at + len(short)] = True
                if len(short) == 3:
                    start[at + 2] = False
                break
    return np.flatnonzero(start)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same contraction for one long piece: a heap of pairs by rank and place."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[a + b], i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
    heapq.heapify(heap)
    alive = [True] * len(parts)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else len(parts)
        if j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(parts) and parts[left] + parts[right] in ranks:
                heapq.heappush(heap, (ranks[parts[left] + parts[right]], left, parts[left], parts[right]))
    return [ranks[p] for p, live in zip(parts, alive) if live]


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes together are a token: first, second, token."""
    rows = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks]
    return tuple(np.array(rows, dtype="i4").reshape(-1, 3).T.copy())


class Coder:
    """The database of one partition and the pieces it has coded so far."""

    def __init__(self, ranks: dict[bytes, int], merges, memory: str = "300MB"):
        import duckdb

        self.ranks = ranks
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], dtype="i4")
        self._put("merges_in", {"first": merges[0], "second": merges[1], "token": merges[2]})
        self.db.execute("CREATE TABLE merges AS FROM merges_in").fetchall()
        self._put("vocabulary_in", {"token": np.array(list(ranks.values()), dtype="i4"), "hex": [t.hex() for t in ranks]})
        self.db.execute("CREATE TABLE vocabulary AS FROM vocabulary_in").fetchall()
        self.clear()

    def _put(self, name: str, columns: dict) -> None:
        self.db.register(name, pa.table(columns))

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.tokens, self.ends, self.decoded = np.empty(0, "i4"), np.zeros(1, "i8"), []

    def add(self, pieces: list[str]) -> None:
        """Code new, distinct, non-empty pieces."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        whole = {i: [self.ranks[b]] for i, b in enumerate(raw) if b in self.ranks}
        long = {i: merge_long(b, self.ranks) for i, b in enumerate(raw) if len(b) > LONG_PIECE and i not in whole}
        rest = [i for i in range(len(raw)) if i not in whole and i not in long]
        found: list = [None] * len(raw)
        for i, tokens in (*whole.items(), *long.items()):
            found[i] = np.array(tokens, dtype="i4")
        if rest:
            joined = np.frombuffer(b"".join(raw[i] for i in rest), dtype="u1")
            offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in rest])]).astype("i4")
            self._put("pieces", {"piece": np.arange(len(rest), dtype="i4"),
                                 "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.byte_rank[joined]))})
            coded = self.db.sql(ENCODE).to_arrow_table().column("tokens").combine_chunks()
            flat, cuts = coded.flatten().to_numpy(), np.concatenate([[0], np.cumsum(coded.value_lengths().to_numpy())])
            for k, i in enumerate(rest):
                found[i] = flat[cuts[k]:cuts[k + 1]]
        lengths = np.array([len(t) for t in found], dtype="i8")
        flat = np.concatenate(found).astype("i4")
        self._put("coded", {"piece": np.arange(len(found), dtype="i4"), "tokens": pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("i4")), pa.array(flat))})
        self.decoded += self.db.sql(DECODE).to_arrow_table().column("bytes").to_pylist()
        at = len(self.index)
        self.index.update(zip(pieces, range(at, at + len(pieces))))
        self.tokens = np.concatenate([self.tokens, flat])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def code(self, texts: list[str], classes: np.ndarray) -> Iterator[tuple[np.ndarray, bytes]]:
        """Tokens and decoded bytes of every text."""
        if len(self.index) > MAX_PIECES:
            self.clear()
        cut = []
        for text in texts:
            bounds = piece_bounds(text, classes).tolist() if text else []
            cut.append([text[a:b] for a, b in zip(bounds, bounds[1:])])
        new = list(dict.fromkeys(p for pieces in cut for p in pieces if p not in self.index))
        if new:
            self.add(new)
        for pieces in cut:
            at = np.fromiter(map(self.index.__getitem__, pieces), dtype="i8", count=len(pieces))
            first, size = self.ends[at], self.ends[at + 1] - self.ends[at]
            total = int(size.sum())
            jump = np.repeat(first - (np.cumsum(size) - size), size)
            yield self.tokens[jump + np.arange(total)], b"".join(map(self.decoded.__getitem__, at.tolist()))


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep_tokens: bool = True) -> DataFrame:
    """Add to every row: n_tokens, ids_sha256, decoded_sha256 and, if asked for, tokens (array of int).

    ``ids_sha256`` digests the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` the
    bytes that the ids decode to.  Null text counts as empty: no tokens.  Input columns with these
    names are replaced; rows are never dropped or merged.  The vocabulary file is read by the driver
    and travels with the tasks; its size is that of a vocabulary, whatever the input.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["tokens"] * keep_tokens
    rest = docs.drop(*[c for c in docs.columns if c.lower() in made])
    ranks = read_ranks(ranks_path)
    context = docs.sparkSession.sparkContext
    shipped = context.broadcast((ranks, merge_table(ranks), char_classes()))
    schema = T.StructType([*rest.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())]
                          + [T.StructField("tokens", T.ArrayType(T.IntegerType()))] * keep_tokens)
    at = rest.columns.index(text)

    def chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) if x else 0 for x in batch.column(at).to_pylist()], dtype="i8")
        part = np.cumsum(sizes) // CHUNK_CHARS
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [len(part)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            if coder is None:
                ranks, merges, classes = shipped.value
                coder, classes = Coder(ranks, merges), np.frombuffer(classes, dtype="u1")
            for rows in chunks(batch):
                n, ids, back, tokens = [], [], [], []
                for got, raw in coder.code([x or "" for x in rows.column(at).to_pylist()], classes):
                    n.append(len(got))
                    ids.append(hashlib.sha256(got.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(raw).hexdigest())
                    if keep_tokens:
                        tokens.append(got)
                columns = [*rows.columns, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
                if keep_tokens:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype("i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens).astype("i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rest.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks_path: str, tokens: str = "tokens") -> DataFrame:
    """Add ``decoded`` (binary), the bytes that an array of ids stands for; null ids give no bytes.

    An id that the vocabulary lacks is an error.
    """
    ranks = read_ranks(ranks_path)
    shipped = rows.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))
    rest = rows.drop("decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = rest.columns.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for whole in batches:
            coder = coder or Coder(*shipped.value)
            known = set(coder.ranks.values())
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                ids = [x or [] for x in batch.column(at).to_pylist()]
                if odd := {i for x in ids for i in x} - known:
                    raise ValueError(f"ids outside the vocabulary: {sorted(odd, key=str)[:5]}")
                coder._put("coded", {"piece": pa.array(range(len(ids)), pa.int32()), "tokens": pa.array(ids, pa.list_(pa.int32()))})
                found = dict(zip(*coder.db.sql(DECODE).to_arrow_table().to_pydict().values()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([found.get(i, b"") for i in range(len(ids))], pa.binary())], names=schema.names)

    return rest.mapInArrow(run, schema)


@query("op8_duckdb_bpe")
def op8_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, counted and digested, and the digest of what they decode to."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_tokens=False)
    return coded.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
