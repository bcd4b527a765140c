"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def build_session(app: str = "factspark", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the jobs expect; ``conf`` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a private one only in local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master == "local" or context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from there.

    The rows go out once, as Parquet: compressed, read by column, with sizes that joins can plan by.  They are not held in
    memory and survive the loss of executors.  Rows with a column of type void, which Parquet has not, are checkpointed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if "void" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any names, repeated ones too
    plain.write.parquet(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)


def bucketed(df: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """``df`` written once to the checkpoint folder as a table bucketed and sorted by ``keys``, in as many buckets as shuffles have partitions.

    Joins and aggregations on the keys read it where it lies; only their other side moves.  Columns ``more`` are added once the
    rows are dealt out, so windows by the keys move nothing.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(parts, *keys).withColumns(more).write.format("parquet").bucketBy(parts, *keys).sortBy(*keys)
     .option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name))
    return spark.table(name)
