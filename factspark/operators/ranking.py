"""Bounded and ordered selections.

Each cap is ``row_number() <= n`` straight above its window, so Spark keeps at
most ``n`` rows per group and task *before* the shuffle.  A group that holds a
third of all rows therefore never travels to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspark.session import cut_lineage


def _cols(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def top_n(df: DataFrame, keys, order, n: int | None, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, all of them without ``n``; ``rank`` keeps their position from 1."""
    if n is None:
        return positions(df, keys, order, rank) if rank else df
    pos = rank or "_pos"
    ranked = (df.withColumn(pos, F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))))
              .where(F.col(pos) <= n))
    return ranked.withColumn(pos, F.col(pos).cast("long")) if rank else ranked.drop(pos)


def positions(df: DataFrame, keys, order, rank: str) -> DataFrame:
    """Every row with its position from 1 in its group, without sorting a group in one task.

    Rows are dealt by ranges of group and order.  A window numbers the rows of a group inside one
    range.  Only the group a range begins with may have rows in earlier ranges: those groups, one a
    range at most, hand their sizes on.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    dealt = df.select("*", *[k.alias(n) for k, n in zip(_cols(keys), names)])
    sorting = [*_cols(keys), *_cols(order)]
    # The high bits of this id are the range, the low 33 count its rows in their order.
    dealt = cut_lineage(dealt.repartitionByRange(*sorting).sortWithinPartitions(*sorting).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    inside = Window.partitionBy("_range", *names).orderBy("_at")
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.where(F.col("_at").bitwiseAND((1 << 33) - 1) == 0).select(*[F.col(n).alias(f"{n}b") for n in names]).distinct()
    cut = dealt.select("_range", *names).join(F.broadcast(begins), [F.col(n).eqNullSafe(F.col(f"{n}b")) for n in names], "left_semi")
    sizes = cut.groupBy("_range", *names).agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", *[F.col(n).alias(f"{n}s") for n in names], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = dealt.withColumn("_in", F.row_number().over(inside)).withColumnRenamed("_range", "_own")
    same = [F.col("_own") == F.col("_range"), *[F.col(n).eqNullSafe(F.col(f"{n}s")) for n in names]]
    rows = rows.join(F.broadcast(sizes), same, "left").withColumn(rank, (F.col("_in") + F.coalesce("_before", F.lit(0))).cast("long"))
    return rows.select(*df.columns, rank)


def first_of(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_n(df, keys, order, 1)


def first_seen(df: DataFrame, keys, order: str) -> DataFrame:
    """Distinct keys with the position of their first appearance (``first_ord``)."""
    return df.groupBy(*_cols(keys)).agg(F.min(order).alias("first_ord"))


def batches(df: DataFrame, keys, order, size: int = 40, max_batches: int | None = None) -> DataFrame:
    """Number fixed-size batches (``batch`` from 0); ``max_batches`` keeps the first few."""
    kept = top_n(df, keys, order, max_batches and size * max_batches, rank="_n")
    return kept.withColumn("batch", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def natural_key(name: Column, prefix: str = "dynamic-") -> Column:
    """Sort key: numbered ids by number first, then the rest by name."""
    digits = F.regexp_extract(name, rf"^{prefix}(\d+)$", 1)
    number = F.nullif(digits, F.lit("")).cast("long")
    return F.struct(number.isNull().alias("rest"), number.alias("number"), name.alias("name"))


def merge_by_precedence(primary: DataFrame, secondary: DataFrame, keys) -> DataFrame:
    """Rows of ``primary`` override rows of ``secondary`` that have the same key."""
    rest = secondary.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.unionByName(rest)


def next_number(df: DataFrame, keys, name: str, pattern: str) -> DataFrame:
    """``next_no`` = 1 + the largest number in use, deleted rows included."""
    number = F.nullif(F.regexp_extract(F.col(name), pattern, 1), F.lit("")).cast("long")
    return df.groupBy(*_cols(keys)).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def newest_notes(df: DataFrame, keys, target: str, question: str, at: str, n: int | None = None) -> DataFrame:
    """One note per target and first line of the question, then the newest ``n`` of each group."""
    head = F.substring_index(F.col(question), "\n", 1)
    tagged = df.withColumn("question_head", head)
    single = first_of(tagged, [*keys, target, "question_head"], [F.col(at)])
    return top_n(single, keys, [F.col(at).desc()], n)


def latest_item(df: DataFrame, keys, at: str, value: str, tie: str) -> DataFrame:
    """Newest row per group as a plain aggregate."""
    return df.groupBy(*_cols(keys)).agg(F.max(F.struct(F.col(at), F.col(tie), F.col(value))).alias("_m")) \
        .select(*keys, F.col(f"_m.{at}").alias(at), F.col(f"_m.{value}").alias(value))
