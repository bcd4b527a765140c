"""What changed between two snapshots, and which packages that touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.functions import paths as P

def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Classify every path of two snapshots.

    ``previous(ws, path, version, size, md5)``, ``current(ws, path, version, size,
    content)``.  The result has ``change`` (unchanged, touched, modified, added,
    removed) and the entry to store next.  Content is hashed before the join, so
    only the digest is shuffled.
    """
    prev = previous.select("ws", "path", F.col("version").alias("old_version"),
                           F.col("size").alias("old_size"), F.col("md5").alias("old_md5"))
    now = current.select("ws", "path", F.col("version").alias("new_version"), F.col("size").alias("new_size"),
                         F.md5(F.col("content").cast("binary")).alias("new_md5"))
    same = F.col("old_version") == F.col("new_version")
    change = (F.when(F.col("new_version").isNull(), "removed")
              .when(F.col("old_version").isNull(), "added")
              .when(same, "unchanged")
              .when(F.col("old_md5") == F.col("new_md5"), "touched")
              .otherwise("modified"))
    joined = prev.join(now, ["ws", "path"], "full_outer").withColumn("change", change)
    carried = F.col("change").isin("unchanged", "touched")
    return joined.select(
        "ws", "path", "change", F.col("new_version").alias("version"),
        F.when(carried, F.col("old_size")).otherwise(F.col("new_size")).alias("size"),
        F.when(carried, F.col("old_md5")).otherwise(F.col("new_md5")).alias("md5"))


def real_changes(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("change").isin("added", "modified", "removed"))


def next_snapshot(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("change") != "removed").select("ws", "path", "version", "size", "md5")


def owners_by_dir(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Owner of each file: the node with the deepest enclosing directory.

    ``files(ws, path)``, ``nodes(ws, id, dir)``.  Each distinct directory is
    resolved once through an equi-join on its ancestors, and the files pick the
    result up by directory; no prefix comparison of pairs takes place.  A node
    whose ``dir`` is '' owns whatever no deeper node owns.
    """
    located = files.withColumn("_dir", P.dirname(F.col("path")))
    dirs = located.select("ws", "_dir").distinct()
    probes = dirs.select("ws", "_dir", F.explode(
        F.array_union(F.array(F.lit("")), P.ancestor_dirs(F.col("_dir")))).alias("_probe"))
    known = nodes.select("ws", F.col("dir").alias("_probe"), F.col("id").alias("_id"))
    owner = (probes.join(known, ["ws", "_probe"])
             .groupBy("ws", "_dir").agg(F.max(F.struct(F.length("_probe"), F.col("_id"))).alias("_best"))
             .select("ws", "_dir", F.col("_best._id").alias("owner")))
    return located.join(owner, ["ws", "_dir"], "left").drop("_dir")


def owners_by_layout(files: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Owner by ``packages/<a>/`` or ``packages/<a>/<b>/`` against the known ids."""
    ids = known_ids.select("ws", "id").distinct()
    seg = (files.withColumn("_pa", F.regexp_extract("path", r"^packages/([^/]+)/", 1))
           .withColumn("_pb", F.regexp_extract("path", r"^packages/[^/]+/([^/]+)/", 1)))
    one = ids.select("ws", F.col("id").alias("_pa"), F.col("id").alias("_a"))
    two = ids.select("ws", F.col("id").alias("_pb"), F.col("id").alias("_b"))
    return (seg.join(one, ["ws", "_pa"], "left").join(two, ["ws", "_pb"], "left")
            .withColumn("owner", F.coalesce("_a", "_b")).drop("_pa", "_pb", "_a", "_b"))


def known_ids(old_ids: DataFrame, new_ids: DataFrame) -> DataFrame:
    return old_ids.select("ws", "id").union(new_ids.select("ws", "id")).distinct()


def id_changes(old_ids: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Ids only in the new set are ``added``, ids only in the old set ``removed``."""
    old, new = old_ids.select("ws", "id"), new_ids.select("ws", "id")
    added = new.subtract(old).withColumn("change", F.lit("added"))
    return added.unionByName(old.subtract(new).withColumn("change", F.lit("removed")))


def changed_packages(diff: DataFrame, old_ids: DataFrame, new_ids: DataFrame,
                     nodes: DataFrame | None = None) -> DataFrame:
    """Distinct ``(ws, id)``: owners of changed files, added ids, removed ids."""
    files = real_changes(diff).select("ws", "path")
    owned = owners_by_layout(files, known_ids(old_ids, new_ids))
    if nodes is not None:
        rest = owners_by_dir(owned.where(F.col("owner").isNull()).select("ws", "path"), nodes)
        owned = owned.where(F.col("owner").isNotNull()).unionByName(rest)
    hit = owned.where(F.col("owner").isNotNull()).select("ws", F.col("owner").alias("id"))
    return hit.union(id_changes(old_ids, new_ids).select("ws", "id")).distinct()
