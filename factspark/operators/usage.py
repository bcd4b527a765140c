"""Model-usage ledger and time-ordered session facts.

Sessions can be long, so anything ordered by time inside one session is cut
into time buckets: a window runs inside each bucket, the buckets hand a small
summary on, and no task ever sorts a whole session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspark.functions.text import token_estimate
from factspark.operators.ranking import top_n


def with_estimates(calls: DataFrame) -> DataFrame:
    """Add character counts and token estimates of ``prompt`` and ``output``."""
    return (calls.withColumn("in_chars", F.length("prompt").cast("long"))
            .withColumn("out_chars", F.length("output").cast("long"))
            .withColumn("est_in", token_estimate(F.col("prompt")))
            .withColumn("est_out", token_estimate(F.col("output"))))


def usage_totals(calls: DataFrame, key: str = "ws") -> DataFrame:
    """Totals per workspace; sums without provider usage count as zero."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("long")
    return calls.groupBy(key).agg(
        F.count("*").alias("calls"), total("est_in").alias("est_in"), total("est_out").alias("est_out"),
        total("usage_in").alias("usage_in"), total("usage_out").alias("usage_out"), total("ms").alias("ms"))


def fold_history(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live and stored calls together, each call once."""
    return live.unionByName(history).dropDuplicates(["ws", "call_id"])


def newest_calls(calls: DataFrame, n: int = 10) -> DataFrame:
    return top_n(calls, ["ws"], [F.col("at").desc(), F.col("call_id").desc()], n)


def first_answers(events: DataFrame, life_seconds: int = 1800, key: str = "session") -> DataFrame:
    """Each request with its first answer inside the request's life.

    ``events(session, ts, kind)`` with kind ``request`` or ``answer``.  A request
    looks ahead in its own life-sized time bucket and at the first answer of the
    next bucket, which covers its whole life; pairs are never formed.
    """
    seconds = F.col("ts").cast("timestamp")
    bucket = F.floor(F.unix_timestamp(seconds) / life_seconds).cast("long")
    staged = events.where(F.col("kind").isin("request", "answer")).withColumn("_b", bucket)
    answer = F.when(F.col("kind") == "answer", F.col("ts"))
    staged = staged.withColumn("_us", F.unix_micros(seconds)).withColumn("_ans", answer)
    ahead = Window.partitionBy(key, "_b").orderBy("_us").rangeBetween(1, Window.unboundedFollowing)
    here = staged.withColumn("_same", F.min("_ans").over(ahead))
    nexts = (staged.where(F.col("kind") == "answer").groupBy(F.col(key), (F.col("_b") - 1).alias("_b"))
             .agg(F.min("ts").alias("_next")))
    joined = (here.where(F.col("kind") == "request").join(nexts, [key, "_b"], "left")
              .withColumn("answer_ts", F.coalesce("_same", "_next")))
    life = F.unix_micros(F.col("answer_ts").cast("timestamp")) - F.col("_us")
    return (joined.where(F.col("answer_ts").isNotNull() & (life <= life_seconds * 1000000))
            .drop("_b", "_us", "_ans", "_same", "_next", "kind"))


COUNTERS = ["uncached", "cache_read", "cache_write", "output"]


def running_total(df: DataFrame, key: str, ts: str, amounts: str | list[str], out: str | list[str],
                  bucket_seconds: int = 86400) -> DataFrame:
    """Inclusive running sums, one row per key and time, in two levels: inside a bucket, then over buckets."""
    amounts, out = ([amounts], [out]) if isinstance(amounts, str) else (amounts, out)
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / bucket_seconds).cast("long")
    # Events of one time count together, so that their order does not matter.
    cut = df.groupBy(key, ts).agg(*[F.sum(a).alias(a) for a in amounts]).withColumn("_b", bucket)
    inside = Window.partitionBy(key, "_b").orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"_part_{a}": F.sum(a).over(inside) for a in amounts})
    carry = cut.groupBy(key, "_b").agg(*[F.sum(a).alias(f"_sum_{a}") for a in amounts])
    carry = carry.select(key, "_b", *[F.coalesce(F.sum(f"_sum_{a}").over(before), F.lit(0)).alias(f"_before_{a}") for a in amounts])
    both = local.join(carry, [key, "_b"])
    return both.select(key, ts, *[(F.col(f"_part_{a}") + F.col(f"_before_{a}")).alias(o) for a, o in zip(amounts, out)])


def as_of(points: DataFrame, counters: DataFrame, key: str, names: list[str], ts: str = "ts", bucket_seconds: int = 86400) -> DataFrame:
    """The last known value of each counter at or before each distinct ``(key, ts)`` of ``points``; null before the first.

    ``counters(key, ts, ...)`` may come at any time, leave counters out (null) and repeat a time; the largest value then
    holds.  Two levels, as in ``running_total``: the last value inside a time bucket, else the last that an earlier
    bucket hands on.  A time of a key is one row before anything is ordered.
    """
    told = counters.select(key, ts, *names, F.lit(False).alias("_asked"))
    asked = points.select(key, ts, *[F.lit(None).cast(counters.schema[n].dataType).alias(n) for n in names], F.lit(True).alias("_asked"))
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / bucket_seconds).cast("long")
    marks = told.union(asked).groupBy(key, ts).agg(*[F.max(n).alias(n) for n in names], F.max("_asked").alias("_asked")).withColumn("_b", bucket)
    inside = Window.partitionBy(key, "_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    local = marks.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names}).where("_asked")
    carry = marks.groupBy(key, "_b").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(ts))).alias(n) for n in names])
    carry = carry.select(key, "_b", *[F.last(n, ignorenulls=True).over(before).alias(f"_before_{n}") for n in names])
    both = local.join(carry, [key, "_b"])
    return both.select(key, ts, *[F.coalesce(n, f"_before_{n}").alias(n) for n in names])


def counter_delta(matches: DataFrame, counters: DataFrame, key: str = "session", names: list[str] | None = None,
                  bucket_seconds: int = 86400) -> DataFrame:
    """Usage between request and answer: each counter as known at the answer minus as known at the request.

    Counters are sampled at times of their own; the last value at or before a moment holds.  Where a counter is not known yet at
    the request, the row is dropped.  Negative differences count as zero; rows whose differences are all zero are dropped.  With
    the four ``COUNTERS`` the result also has ``input``: uncached, cache reads and cache writes together.
    """
    names = names or COUNTERS
    ends = matches.select(key, F.explode(F.array("ts", "answer_ts")).alias("ts"))
    at = as_of(ends, counters, key, names, bucket_seconds=bucket_seconds)
    first = at.select(key, "ts", *[F.col(n).alias(f"_start_{n}") for n in names])
    last = at.select(key, F.col("ts").alias("answer_ts"), *[F.col(n).alias(f"_end_{n}") for n in names])
    both = matches.join(first, [key, "ts"]).join(last, [key, "answer_ts"])
    for n in names:
        both = both.where(F.col(f"_start_{n}").isNotNull())
    deltas = {f"delta_{n}": F.greatest(F.lit(0), F.col(f"_end_{n}") - F.col(f"_start_{n}")) for n in names}
    out = both.withColumns(deltas).where(F.greatest(*[F.col(d) for d in deltas], F.lit(0)) > 0)
    if set(COUNTERS) <= set(names):
        out = out.withColumn("input", F.col("delta_uncached") + F.col("delta_cache_read") + F.col("delta_cache_write"))
    return out.drop(*[f"_start_{n}" for n in names], *[f"_end_{n}" for n in names])
