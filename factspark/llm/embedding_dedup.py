"""Embedding near-duplicates by sorted projection passes.

A pass concatenates the signs of random projections to a key, sorts all vectors by it and compares each
with its next ``window`` neighbours.  Verified pairs of all passes are united.  Within what they
connect, links are then counted exactly, so dense groups lose none to the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm.common import components, ranked, spanning, stored, table
from factspark.llm.registry import query

BLOCK = 512
KEY_BITS = 62


def matrix(values: pd.Series) -> np.ndarray:
    """Unit vectors in double precision."""
    rows = np.stack(values.to_numpy()).astype("f8")
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is not null or empty, not zero, and holds finite numbers only."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).filter(~bad & F.exists(vec, lambda x: x != 0))


def keys(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """(rep, vec) to rep, pass, key: one sortable key a pass.  Vectors of different length never meet."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype="i8")
        for batch in batches:
            for dim, own in batch.groupby(batch["vec"].map(len), sort=False):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, passes * KEY_BITS))
                signs = (matrix(own["vec"]) @ planes[dim] > 0).reshape(len(own), passes, KEY_BITS)
                found = signs.astype("i8") @ weights
                yield pd.DataFrame({"rep": np.repeat(own["rep"].to_numpy(), passes), "dim": dim, "pass": np.tile(np.arange(passes), len(own)), "key": found.ravel()})

    return vectors.mapInPandas(run, "rep long, dim int, pass int, key long")


def window_pairs(vectors: DataFrame, passes: int, window: int, threshold: float, seed: int) -> DataFrame:
    """Verified pairs a < b of distinct vectors that are at most ``window`` apart in a pass's order.

    Of the verified pairs of a block those stay that connect it; at most one for each vector.
    """
    placed = ranked(keys(vectors, passes, seed), ["dim", "pass", "key", "rep"], "place")
    # Blocks of the whole order, each with the first ``window`` rows of the next one.
    width = max(BLOCK, 2 * window)
    block = F.floor(F.col("place") / width).cast("long")
    reach = F.when(F.col("place") % width < window, F.array(block - 1, block)).otherwise(F.array(block))
    rows = placed.join(vectors, "rep").select("dim", "pass", "place", "rep", "vec", F.explode(reach).alias("block"))

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place", kind="stable")
        out = []
        for _, run in own.groupby(["dim", "pass"], sort=False):
            x, rep = matrix(run["vec"]), run["rep"].to_numpy()
            for k in range(1, min(window, len(run) - 1) + 1):
                hit = np.flatnonzero(np.einsum("ij,ij->i", x[:-k], x[k:]) >= threshold)
                out.append(np.stack([rep[hit], rep[hit + k]], axis=1))
        found = np.concatenate(out) if out else np.empty((0, 2), dtype="i8")
        found = found[spanning(found[:, 0], found[:, 1])]
        return pd.DataFrame({"a": found.min(axis=1), "b": found.max(axis=1)})

    return rows.groupBy("block").applyInPandas(compare, "a long, b long").distinct()


def counted_links(members: DataFrame, threshold: float) -> DataFrame:
    """(root, rep, copies, vec) to rep, links: copies of other vectors of the same component within the threshold.

    A component is dealt into blocks of about ``BLOCK`` vectors by their hash; each pair of blocks is one group of
    rows, and only sums leave it.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", "rep", "copies", "vec", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def count(own: pd.DataFrame) -> pd.DataFrame:
        i, j = own["i"].iloc[0], own["j"].iloc[0]
        left, right = own[own["own"] == i], own[own["own"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": []})
        x, y = matrix(left["vec"]), matrix(right["vec"])
        near = (x @ y.T >= threshold).astype("f8")
        if i == j:
            np.fill_diagonal(near, 0.0)
            return pd.DataFrame({"rep": left["rep"], "links": (near @ right["copies"].to_numpy()).astype("i8")})
        return pd.DataFrame({"rep": np.concatenate([left["rep"], right["rep"]]),
                             "links": np.concatenate([near @ right["copies"].to_numpy(), left["copies"].to_numpy() @ near]).astype("i8")})

    return rows.groupBy("root", "i", "j").applyInPandas(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", threshold: float = 0.95, passes: int = 16,
                    window: int = 32, seed: int = 7) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors are one vector with copies.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different length never link.  Only pairs
    whose cosine, in double precision, reaches ``threshold`` are linked.  A pair is lost only if no
    pass brings the two within ``window`` places and no other verified pairs connect them.
    Repeated ids keep their rows; a null id links like any other but is never the smallest.
    """
    rows = stored(vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).cast("array<double>").alias("vec")))
    good = usable(rows, "vec").select("vec_id", F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).alias("vec"))
    classes = good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    pairs = window_pairs(classes.select("rep", "vec"), passes, window, threshold, seed)
    reach = stored(components(pairs, "a", "b"))
    members = classes.join(reach, classes["rep"] == reach["node"]).select("root", "rep", "copies", "vec")
    links = counted_links(members, threshold)
    least = classes.join(reach, classes["rep"] == reach["node"]).groupBy("root").agg(F.min("least").alias("component_id"))
    found = classes.join(reach, classes["rep"] == reach["node"], "left").join(least, "root", "left").join(links, "rep", "left")
    found = found.select(F.col("vec").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("component_id", "least").alias("component_id"))
    key = F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    # Rows that link with nothing have no class of their own here and stay as they are.
    out = rows.withColumn("_k", key).join(found, F.col("_k") == F.col("_v"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op9_projection_passes")
def op9_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding, whatever its label."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
