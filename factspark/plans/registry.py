"""Registered queries: a Spark callable and, where SQL can say it, an equivalent SQL text."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factspark.operators.dealing import dealt
from factspark.plans.relations import RELATIONS, sql_with
from factspark.session import ensure_checkpoint_dir

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables:
    """The given tables and the relations derived from them, read lazily by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def dealt(self, name: str, row_bytes: int) -> DataFrame:
        """A narrow table, dealt out to all tasks: its rows are about to become texts of so many bytes."""
        return dealt(self.table(name), row_bytes)

    def rel(self, name: str, row_bytes: int | None = None) -> DataFrame:
        """A derived relation, expanded from its SQL text over the tables.

        With ``row_bytes``, about what a row of it holds, the rows it is composed from are dealt out to
        all tasks first.
        """
        text = RELATIONS[name]
        parts = {n: self.rel(n, row_bytes) if n in RELATIONS else self.table(n) for n in self._names(text)}
        if row_bytes:
            parts = {n: d if n in RELATIONS else dealt(d.select(*self._columns(d, text)), row_bytes) for n, d in parts.items()}
        return self.spark.sql(text, **parts)

    @staticmethod
    def _names(text: str) -> list[str]:
        import string
        return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f})

    @staticmethod
    def _columns(rows: DataFrame, text: str) -> list[str]:
        """The columns that the text names: what is dealt out is written, whatever is read of it later."""
        if re.search(r"(SELECT\s+|\.)\*", text):
            return rows.columns
        return [n for n in rows.columns if re.search(rf"\b{re.escape(n)}\b", text)]

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files, be it one file or a folder of them."""
        schema = self.table(name).schema
        # As a pattern: a stream's plain path must be a folder.
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.{{parquet}}")

    def work_dir(self) -> str:
        """A new folder all executors share, below the checkpoint folder."""
        ensure_checkpoint_dir(self.spark)
        return f"{self.spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use relations as ``{name}``."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql_with(sql)
        return fn
    return add
