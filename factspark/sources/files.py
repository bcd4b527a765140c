"""Workspace files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.functions import paths as P

MAX_CHARS = 2147483647


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` as the file system spells the paths below it, without a slash at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString().rstrip("/")


def read_workspaces(spark: SparkSession, root: str, ws_depth: int = 0, cache_dir: str | None = None,
                    names: str | None = None) -> DataFrame:
    """``(ws, path, version, size, content)`` of all tracked files below ``root``.

    The first ``ws_depth`` directories below the root name the workspace; without any it is the root.
    Spark can skip files by name before it opens them: ``names`` is such a glob (``*.{ts,py,java,md}``).
    Files that only their folder rules out are opened and dropped in the scan.
    """
    base = qualified(spark, root)
    # The scheme and slashes of the root as listed may differ from its own spelling (file:/ and file:///).
    bare = F.regexp_replace("path", r"^([a-zA-Z][a-zA-Z0-9+.-]*:)/+", "$1/")
    cut = len(_single_slash(base)) + 2
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", names) if names else reader
    listed = reader.load(root).select(
        F.col("path").alias("full"), F.substring(bare, cut, MAX_CHARS).alias("rel"),
        F.concat_ws("-", F.unix_micros("modificationTime"), "length").alias("version"), F.col("length").alias("size"), "content")
    parts = F.split("rel", "/")
    ws = F.array_join(F.slice(parts, 1, ws_depth), "/") if ws_depth else F.lit(base)
    path = F.array_join(F.slice(parts, F.lit(ws_depth + 1), F.size(parts)), "/")
    kept = listed.withColumn("ws", ws).withColumn("path", path).where(P.is_tracked_file(F.col("path"), cache_dir))
    return kept.select("ws", "path", "version", "size", F.decode("content", "UTF-8").alias("content"))


def _single_slash(path: str) -> str:
    scheme, colon, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if colon and "/" not in scheme else path
