"""Vector codes: parts of integer vectors are replaced by their nearest codebook entry, found in a GNAT over the entries.

A node of the tree has a few split points; every other entry belongs to the child of its nearest one.  A node
stores, for each pair of split point and child, the least and the greatest distance between them.  A query's distances to the split
points then rule out whole children: only strictly, with bounds rounded away from a decision.  What remains is
compared by exact integers, and ties go to the lower index.

Assignments run in tasks over blocks of rows.  A round sends one row per part, entry and component to the
driver, which is the size of the codebooks, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factspark.llm.common import stored, table
from factspark.llm.registry import query

#: Far above the relative error of a square root of a rounded integer.
SLACK = 1e-12
#: Components from here on are out of range, like those that are not finite.
LIMIT = 2.0 ** 50
SCALE = 4096
#: Below this all squares of a part's differences and their sums fit 64 bits; larger ones are Python's integers.
SMALL = 1 << 26


def integers(values: np.ndarray) -> np.ndarray:
    """64-bit integers where all differences, squares and sums of them fit; else Python's, which are exact at any size."""
    fits = not values.size or (max(abs(int(values.min())), abs(int(values.max()))) < SMALL and values.shape[-1] < 256)
    return values if fits else values.astype(object)


def squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one entry."""
    gap = x - entry
    return (gap * gap).sum(axis=1)


def roots(exact: np.ndarray) -> np.ndarray:
    return np.sqrt(exact.astype("f8"))


@dataclass
class Gnat:
    """A node: indices of its split points, the children's nodes (None without further entries) and their ranges, split by child."""

    splits: list[int]
    children: list["Gnat | None"] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @staticmethod
    def build(entries: np.ndarray, own: list[int] | None = None, degree: int = 4) -> "Gnat":
        """Split points are the first entry and then always the one farthest from all chosen (ties: lowest index)."""
        own = list(range(len(entries))) if own is None else own
        points = entries[own]
        chosen, gaps = [0], [squares(points, points[0])]
        while len(chosen) < min(degree, len(own)):
            least = np.min(gaps, axis=0)
            least[chosen] = -1
            chosen.append(int(np.argmax(least)))
            gaps.append(squares(points, points[chosen[-1]]))
        exact = np.stack(gaps)
        home = np.argmin(exact, axis=0)
        home[chosen] = np.arange(len(chosen))
        far = roots(exact)
        members = [np.flatnonzero(home == j) for j in range(len(chosen))]
        node = Gnat([own[c] for c in chosen])
        node.low = np.stack([[far[i, m].min() for m in members] for i in range(len(chosen))]) * (1 - SLACK)
        node.high = np.stack([[far[i, m].max() for m in members] for i in range(len(chosen))]) * (1 + SLACK)
        for j, m in enumerate(members):
            below = [own[k] for k in m if k != chosen[j]]
            node.children.append(Gnat.build(entries, below, degree) if below else None)
        return node

    def search(self, entries: np.ndarray, x: np.ndarray, best: np.ndarray, index: np.ndarray, rows: np.ndarray) -> int:
        """Lower ``best`` (exact squares) and ``index`` of the given rows of ``x``; returns how many distances it took."""
        taken = len(rows) * len(self.splits)
        exact = [squares(x[rows], entries[s]) for s in self.splits]
        for s, found in zip(self.splits, exact):
            better = (found < best[rows]) | ((found == best[rows]) & (s < index[rows]))
            best[rows[better]], index[rows[better]] = found[better], s
        away = np.stack([roots(e) for e in exact])
        for j, child in enumerate(self.children):
            if child is None:
                continue
            gap = np.maximum(self.low[:, j, None] - away * (1 + SLACK), away * (1 - SLACK) - self.high[:, j, None]).max(axis=0)
            alive = rows[gap <= roots(best[rows]) * (1 + SLACK)]
            if len(alive):
                taken += child.search(entries, x, best, index, alive)
        return taken


def nearest(entries: np.ndarray, tree: Gnat, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of every row of ``x``: its nearest entry (ties: lower index) and their exact squared distance; and the distances taken."""
    both = integers(np.concatenate([entries, x]))
    entries, x = both[:len(entries)], both[len(entries):]
    rows = np.arange(len(x))
    best, index = squares(x, entries[0]), np.zeros(len(x), dtype="i8")
    return index, best, tree.search(entries, x, best, index, rows)


class Codebooks:
    """The entries of every part position, with their trees."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.trees = [Gnat.build(integers(e)) for e in entries]

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every part position: that part of the rows, the nearest entries and squared distances."""
        width = self.entries[0].shape[1]
        for k, (entries, tree) in enumerate(zip(self.entries, self.trees)):
            own = x[:, k * width:(k + 1) * width]
            index, exact, _ = nearest(entries, tree, own)
            yield own, index, exact

    def text(self) -> str:
        """All integers by part, entry and position, joined by commas."""
        return ",".join(str(int(v)) for e in self.entries for v in e.ravel())


def fixed_point(vectors: DataFrame, vec: str, scale: int = SCALE) -> DataFrame:
    """Rows with a usable vector, its components x as integers floor(scale * x) (array of long) in place of ``vec``."""
    bad = F.exists(F.col(f"`{vec}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    rows = vectors.filter(F.col(f"`{vec}`").isNotNull()).filter((F.size(f"`{vec}`") > 0) & ~bad)
    return rows.withColumn(vec, F.transform(F.col(f"`{vec}`"), lambda x: F.floor(x.cast("double") * scale).cast("long")))


def numbers(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    """The vectors of an Arrow column, padded by zeros to a multiple of ``parts`` components."""
    found = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    return np.pad(found, ((0, 0), (0, -dim % parts)))


def first_entries(rows: DataFrame, order: list[str], vec: str, entries: int, parts: int) -> tuple[int, Codebooks | None]:
    """Dimension and starting codebooks: the vectors of the first rows by ``order`` (nulls last), then by vector."""
    head = rows.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in order], vec).select(vec).limit(entries).collect()
    if not head:
        return 0, None
    dim = len(head[0][0])
    start = np.array([r[0] for r in head if len(r[0]) == dim], dtype="i8")
    start = np.pad(start, ((0, 0), (0, -dim % parts)))
    return dim, Codebooks(np.split(start, parts, axis=1))


def refined(rows: DataFrame, vec: str, dim: int, books: Codebooks, parts: int) -> Codebooks:
    """One round: every part goes to its nearest entry, every used entry becomes the floor of its parts' mean."""
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = {}, {}
        for batch in batches:
            for k, (own, index, _) in enumerate(books.assign(numbers(batch.column(0), dim, parts))):
                for e in np.unique(index).tolist():
                    mine = own[index == e]
                    counts[k, e] = counts.get((k, e), 0) + len(mine)
                    # Python's integers: a sum over many rows has no bound of its own.
                    sums[k, e] = sums.get((k, e), 0) + integers(mine).sum(axis=0).astype(object)
        keys = [(k, e, p) for k, e in counts for p in range(len(sums[k, e]))]
        yield pa.RecordBatch.from_arrays([
            *[pa.array([key[i] for key in keys], pa.int32()) for i in range(3)], pa.array([counts[k, e] for k, e, _ in keys], pa.int64()),
            pa.array([str(sums[k, e][p]) for k, e, p in keys], pa.string())], names=["part", "entry", "place", "n", "total"])

    found = rows.select(vec).mapInArrow(totals, "part int, entry int, place int, n long, total string")
    found = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    entries = [e.copy() for e in books.entries]
    for r in found.collect():  # one row per part, entry and component
        entries[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return Codebooks(entries)


def coded(rows: DataFrame, vec: str, dim: int, books: Codebooks, parts: int) -> DataFrame:
    """Replace the integer vector by code (two hex digits a part) and error (sum of its squared distances)."""
    rest = rows.drop(vec)
    schema = T.StructType([*rest.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, exact = zip(*[(i, e) for _, i, e in books.assign(numbers(batch.column(0), dim, parts))])
            digits = np.stack(index, axis=1).astype("u1").tobytes().hex()
            code = [digits[a:a + 2 * parts] for a in range(0, len(digits), 2 * parts)]
            error = [v if v < 1 << 63 else None for v in sum(e.astype(object) for e in exact).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code, pa.string()), pa.array(error, pa.int64())], names=schema.names)

    return rows.select(vec, *[F.col(f"`{c}`") for c in rest.columns]).mapInArrow(run, schema)


def compress(vectors: DataFrame, order: list[str] | str = "vec_id", vec: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6,
             scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """The input's usable rows with code and error in place of the vector, and the codebooks they refer to.

    Vectors that are null, empty or hold null or non-finite components are dropped, and so are those with components of
    2**50 or more and those whose length is not that of the first by ``order``.  A component x counts as ``floor(scale *
    x)``.  Vectors are cut into equal parts, after zeros up to a multiple of ``parts``.  Codebooks start from the first
    ``entries`` (at most 256) rows by ``order``, nulls last, ties by vector; fewer rows make fewer entries.  Unused entries stay as
    they are.  Repeated rows stay repeated.  An error beyond 64 bits is null.  Without a usable row there is no
    codebook (None) and no row.  Columns named code and error are replaced.
    """
    rest = vectors.drop(*[c for c in vectors.columns if c.lower() in ("code", "error")])
    rows = stored(fixed_point(rest, vec, scale))
    dim, books = first_entries(rows, [order] if isinstance(order, str) else order, vec, entries, parts)
    if books is None:
        none = rows.drop(vec).withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
        return none.filter("false"), None
    rows = rows.filter(F.size(f"`{vec}`") == dim)
    for _ in range(rounds):
        books = refined(rows, vec, dim, books, parts)
    return coded(rows, vec, dim, books, parts), books


@query("op12_gnat_codes", r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT rid, k, x[k * len(x) // 8 + 1 : (k + 1) * len(x) // 8] AS y FROM v, range(8) AS s(k)),
c0 AS MATERIALIZED (SELECT k, rid - 1 AS e, y AS c FROM p WHERE rid <= 16),
{rounds}
z AS (SELECT rid, k, e, d FROM (
  SELECT rid, p.k, e, list_sum(list_transform(list_zip(y, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d FROM p JOIN c6 USING (k))
  QUALIFY row_number() OVER (PARTITION BY rid, k ORDER BY d, e) = 1),
r AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (rid), h
""".replace("{rounds}", "\n".join(f"""
a{i} AS (SELECT rid, k, e, y FROM (
  SELECT rid, p.k, e, y, list_sum(list_transform(list_zip(y, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS d FROM p JOIN c{i - 1} USING (k))
  QUALIFY row_number() OVER (PARTITION BY rid, k ORDER BY d, e) = 1),
u{i} AS (SELECT k, e, j, count(*) AS n, CAST(sum(y[j]) AS BIGINT) AS s FROM a{i}, range(1, (SELECT max(len(y)) FROM p) + 1) AS g(j) GROUP BY k, e, j),
c{i} AS MATERIALIZED (SELECT k, e, coalesce(m, c) AS c FROM c{i - 1} LEFT JOIN (
  SELECT k, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM u{i} GROUP BY k, e) USING (k, e)),""" for i in range(1, 7))))
def op12_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and errors of every usable embedding, and the digest of the codebooks."""
    rows, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    rows = stored(rows)
    errors = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256((books.text() if books else "").encode()).hexdigest()
    out = rows.join(errors, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
