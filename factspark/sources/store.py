"""Parquet stores: snapshots, the artifact ledger and usage rows.

Nothing is overwritten in place.  A snapshot becomes visible through a pointer
row that is written after all of its data, so an interrupted job leaves the
previous snapshot current.

The ledger is a log in generations.  A generation begins with a base, the state of every artifact at that time, bucketed by
``(ws, name)``; writes follow in folders of their own and count once they are committed.  Reading takes the newest
generation's base and its committed writes, however long the history before it is.  ``compact_ledger`` starts
the next generation; its pointer is written last.  One job at a time writes a store.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factspark.operators.artifacts import writable

SNAPSHOT = "ws string, path string, version string, size long, md5 string"
POINTER = "ws string, snapshot_id long"
LEDGER = ("ws string, name string, kind string, lang string, v long, deps array<string>, requires array<string>, "
          "payload string, written_at long, seq long, gone boolean, keys_only boolean")
BASE = "ws string, name string, kind string, lang string, v long, deps array<string>, requires array<string>, payload string, written_at long, seq long"
COMMIT = "write long, stream string, batch long"
GENERATION = "gen long, buckets int, streams map<string,long>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store's table; empty while the store does not exist.  Any other fault is an error."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _order(spark: SparkSession) -> int:
    """Later writes get larger numbers, whatever version they carry."""
    return time.time_ns()


def load_snapshot(spark: SparkSession, store: str) -> DataFrame:
    """Current snapshot of every workspace; empty where none was committed."""
    newest = _read(spark, f"{store}/pointers", POINTER).groupBy("ws").agg(F.max("snapshot_id").alias("snapshot_id"))
    rows = _read(spark, f"{store}/snapshots", SNAPSHOT + ", snapshot_id long")
    return rows.join(newest, ["ws", "snapshot_id"], "left_semi").drop("snapshot_id")


def write_snapshot(rows: DataFrame, store: str, snapshot_id: int) -> None:
    (rows.select("ws", "path", "version", "size", "md5").withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id")
     .parquet(f"{store}/snapshots"))


def commit_snapshot(workspaces: DataFrame, store: str, snapshot_id: int) -> None:
    """Make a written snapshot current.  Call it last."""
    (workspaces.select("ws").distinct().withColumn("snapshot_id", F.lit(snapshot_id).cast("long"))
     .write.mode("append").parquet(f"{store}/pointers"))


def append_artifacts(rows: DataFrame, store: str, at: int) -> None:
    """Append artifacts of a known version; rows of version 0 are left out."""
    _append(writable(rows), store, at, gone=F.lit(False), keys_only=F.lit(False))


def append_states(rows: DataFrame, store: str, at: int, stream: str | None = None, batch: int | None = None) -> None:
    """Append the outcome of an invalidation: what changed, tombstones included, without payloads.

    ``rows`` have the ``action`` that ``invalidate`` names; rows that were kept are not written again, a
    restamped row only carries its new version.  ``stream`` and ``batch`` name the micro-batch that the rows come from.
    """
    moved = rows.where(F.col("action") != "kept").withColumn("payload", F.lit(None).cast("string"))
    _append(moved, store, at, gone=F.lit(False), keys_only=F.col("action") == "restamped", stream=stream, batch=batch)


def remove_artifacts(rows: DataFrame, store: str, at: int) -> None:
    """Append removals: the artifacts ``rows(ws, name)`` are no longer listed."""
    none = {c: F.lit(None).cast(t) for c, t in (("kind", "string"), ("lang", "string"), ("v", "long"), ("deps", "array<string>"),
                                                ("requires", "array<string>"), ("payload", "string"))}
    _append(rows.select("ws", "name").withColumns(none), store, at, gone=F.lit(True), keys_only=F.lit(False))


def _append(rows: DataFrame, store: str, at: int, gone, keys_only, stream: str | None = None, batch: int | None = None) -> None:
    """Write rows into a folder of their own, then commit it.  What was not committed is never read."""
    spark = rows.sparkSession
    seq, now = _order(spark), _generation(spark, store)
    stamped = rows.withColumns({"gone": gone, "keys_only": keys_only, "written_at": F.lit(at).cast("long"), "seq": F.lit(seq).cast("long")})
    stamped.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.parquet(f"{store}/ledger/gen={now.gen}/write={seq}")
    mark = spark.createDataFrame([(seq, stream, batch)], COMMIT)
    mark.coalesce(1).write.mode("append").parquet(f"{store}/commits/gen={now.gen}")


def _generation(spark: SparkSession, store: str) -> Row:
    """The newest generation: gen (0 before the first compaction), buckets, and the last batch of each stream before it."""
    found = _read(spark, f"{store}/generations", GENERATION).orderBy(F.col("gen").desc()).limit(1).collect()
    return found[0] if found else Row(gen=0, buckets=0, streams={})


def last_batch(spark: SparkSession, store: str, stream: str) -> int:
    """The newest committed micro-batch of a stream; -1 before the first."""
    now = _generation(spark, store)
    found = _read(spark, f"{store}/commits/gen={now.gen}", COMMIT).where(F.col("stream") == stream).agg(F.max("batch")).first()[0]
    return max(-1 if found is None else found, (now.streams or {}).get(stream, -1))


def _log(spark: SparkSession, store: str, gen: int) -> DataFrame:
    """Committed writes of a generation; there are as many as were made since its compaction."""
    writes = sorted(r.write for r in _read(spark, f"{store}/commits/gen={gen}", COMMIT).select("write").collect())
    if not writes:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(*[f"{store}/ledger/gen={gen}/write={w}" for w in writes])


def _base(spark: SparkSession, store: str, gen: int, buckets: int) -> DataFrame:
    """The state that a generation began with, as a table bucketed by key: merging the log moves the log only."""
    if not gen:
        return spark.createDataFrame([], BASE)
    name = f"ledger_{hashlib.md5(store.encode()).hexdigest()}_{gen}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({BASE}) USING parquet "
              f"CLUSTERED BY (ws, name) SORTED BY (ws, name) INTO {buckets} BUCKETS LOCATION '{store}/base/gen={gen}'")
    return spark.table(name)


def _resolved(rows: DataFrame, payloads: bool = True) -> DataFrame:
    """Newest facts of every key of a log, and the payload that its newest state goes back to (``whole``: the log has it).

    Without ``payloads`` they are not looked up.
    """
    # Keys are resolved first; a payload moves once, from the write that the newest state goes back to.
    key = F.struct("written_at", "seq")
    facts = ["kind", "lang", "v", "deps", "requires", "gone", "written_at", "seq"]
    newest = rows.groupBy("ws", "name").agg(F.max_by(F.struct(*facts), key).alias("r"), F.max(F.when(~F.col("keys_only"), key)).alias("body"))
    newest = newest.select("ws", "name", "r.*", F.col("body.written_at").alias("_at"), F.col("body.seq").alias("_seq"))
    if not payloads:
        return newest.select("*", F.lit(None).cast("string").alias("payload"), F.col("_at").isNotNull().alias("whole")).drop("_at", "_seq")
    bodies = rows.where(~F.col("keys_only") & F.col("payload").isNotNull()).select(
        "ws", "name", F.col("written_at").alias("_at"), F.col("seq").alias("_seq"), "payload")
    return newest.join(bodies, ["ws", "name", "_at", "_seq"], "left").withColumn("whole", F.col("_at").isNotNull()).drop("_at", "_seq")


def _current(spark: SparkSession, store: str, payloads: bool = True) -> DataFrame:
    now = _generation(spark, store)
    log = _log(spark, store, now.gen)
    # Dealt out like the base's buckets first, the log's keys are resolved where they then meet the base.
    log = _resolved(log.repartition(now.buckets, "ws", "name") if now.gen and not payloads else log, payloads)
    if not now.gen:
        return log.where(~F.col("gone")).select(*[c.split()[0] for c in BASE.split(", ")])
    news = log.select("ws", "name", *[F.col(c).alias(f"_{c}") for c in log.columns if c not in ("ws", "name")])
    # The log is dealt out like the base's buckets, so the base stays where it is.
    both = _base(spark, store, now.gen, now.buckets).join(news.repartition(now.buckets, "ws", "name") if payloads else news, ["ws", "name"], "full_outer")
    told = F.col("_seq").isNotNull()
    out = both.where(~F.coalesce("_gone", F.lit(False)))
    fresh = {c: F.when(told, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("kind", "lang", "v", "deps", "requires", "written_at", "seq")}
    payload = F.when(F.coalesce("_whole", F.lit(False)), F.col("_payload")).otherwise(F.col("payload"))
    return out.withColumns({**fresh, "payload": payload}).select(*[c.split()[0] for c in BASE.split(", ")])


def load_ledger(spark: SparkSession, store: str, history: bool = False, payloads: bool = True) -> DataFrame:
    """Latest state of every artifact, or with ``history`` every state ever written.  Without ``payloads`` the state's are not read but null."""
    if not history:
        rows = _current(spark, store, payloads).drop("written_at", "seq")
        return rows if payloads else rows.withColumn("payload", F.lit(None).cast("string"))
    done = _read(spark, f"{store}/commits", COMMIT).select(F.col("write").alias("seq"))
    return _read(spark, f"{store}/ledger", LEDGER).join(done, "seq", "left_semi").select(*[c.split()[0] for c in LEDGER.split(", ")])


def compact_ledger(spark: SparkSession, store: str, buckets: int | None = None) -> int:
    """Start a new generation from the current state; returns its number.

    The base is written before the pointer: until that is there, readers and writers go on with the generation before.
    """
    before = _generation(spark, store)
    gen = _order(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    streams = {r.stream: r.batch for r in _read(spark, f"{store}/commits/gen={before.gen}", COMMIT)
               .where(F.col("stream").isNotNull()).groupBy("stream").agg(F.max("batch").alias("batch")).collect()}
    rows = _current(spark, store).repartition(buckets, "ws", "name")
    name = f"ledger_{hashlib.md5(store.encode()).hexdigest()}_{gen}"
    rows.write.format("parquet").bucketBy(buckets, "ws", "name").sortBy("ws", "name").option("path", f"{store}/base/gen={gen}").saveAsTable(name)
    pointer = spark.createDataFrame([(gen, buckets, {**(before.streams or {}), **streams})], GENERATION)
    pointer.coalesce(1).write.mode("append").parquet(f"{store}/generations")
    return gen


def append_usage(calls: DataFrame, store: str) -> None:
    calls.write.mode("append").parquet(f"{store}/usage")


def load_usage(spark: SparkSession, store: str, schema: str) -> DataFrame:
    return _read(spark, f"{store}/usage", schema).dropDuplicates(["ws", "call_id"])
