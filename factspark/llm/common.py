"""What the operators share: words, folds, shared folders, ranks and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the text form of ``column``, modulo ``modulus``; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def set_aside(docs: DataFrame, names: set[str], keep: tuple[str, ...] = ()):
    """``docs`` with its columns of these names (case ignored) under other names, and what gives a result the names back.

    Columns in ``keep``, those an operator reads, stay.
    """
    taken, moved = {c.lower() for c in docs.columns}, {}
    for c in docs.columns:
        if c.lower() in names and c not in keep:
            new = f"{c}_own"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            moved[c] = new
    back = {new: c for c, new in moved.items()}
    rows = docs.select(*[F.col(f"`{c}`").alias(moved.get(c, c)) for c in docs.columns]) if moved else docs
    return rows, lambda out: out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns]) if moved else out


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process (tests) a folder of this
    machine is used instead.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there.

    A lost executor costs a read, not a second run of what made the rows.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``, the place (from 0) of every row by ``order``, nulls last, without a single-task sort.

    Rows are dealt by ranges and sorted within them; a range's first place is the number of
    rows in the ranges before it.  One row per range passes through one task.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The low 33 bits of this id count the rows of a range in their order, the high bits are the range.
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(sizes, "_range").withColumn(name, F.col("_before") + F.col("_in")).drop("_range", "_in", "_at", "_before")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes of ``edges`` with the smallest node they reach: columns node, root (both of the edges' type).

    Every round gives a node the smallest root among its own and its neighbours', then follows
    roots once (pointer jumping), until a round changes nothing.  Rows stay distributed; a round
    sends one number to the driver.  Nodes without an edge are not listed.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = stored(both.union(both.select("other", "node")).filter("node <> other").distinct())
    state = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        near = both.join(state.select(F.col("node").alias("other"), "root"), "other").groupBy("node").agg(F.min("root").alias("near"))
        step = state.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        # The root of the root just found; a root that is no node of this table cannot occur.
        jump = state.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = step.join(jump, "next").select("node", "root", F.least("next", "far").alias("next"))
        step = stored(step)
        changed = step.filter("root <> next").limit(1).count()
        state = step.select("node", F.col("next").alias("root"))
        if not changed:
            return state


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs connect what the earlier ones leave apart: the others say nothing new."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    keep = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep[i] = True
    return keep
