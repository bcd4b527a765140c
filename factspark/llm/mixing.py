"""Mixing sources to target weights by entropy balancing.

The rates closest to one in relative entropy that meet the token targets are ``min(cap, exp(l * size / mean))``
with one dual variable ``l`` a source.  The dual is convex; Newton steps, kept inside a bracket, solve it
for all sources at once over the histogram of sizes.  Rates become copies by systematic rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspark.llm.common import WORD, ranked, set_aside, stored, table, text_of
from factspark.llm.registry import query

#: Rows of equal source and size are dealt to so many groups, so that a large set of copies is split.
SALTS = 64
#: Starting points that systematic rounding tries for every source.
OFFSETS = 16


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size) to source, source_size, target.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a
    target stops at ``cap`` times its source's size, and the excess is shared again by weight
    until none is above.  Each round sends two sums to the driver.
    """
    placed = ranked(sizes, ["source"], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    placed = stored(placed.select("source", "source_size", weight.alias("weight")))
    total = placed.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    limit, level = cap * F.col("source_size"), None
    free, open_weight = float(total), placed.agg(F.sum("weight").alias("w")).first()["w"] or 1.0
    while True:
        new = free / open_weight if open_weight else level
        if level is not None and new <= level:
            break
        level = new
        above = F.lit(level) * F.col("weight") >= limit
        sums = placed.agg(F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)).alias("full"),
                          F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        free, open_weight = total - sums["full"], sums["open"]
        if not open_weight:
            break
    return placed.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), limit).alias("target"))


def tilts(histogram: DataFrame, targets: DataFrame, cap: float, rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """The dual variable of every source: source, mean, tilt (null: all documents at the cap).

    A round is one aggregation of the histogram by source.  A Newton step that leaves the bracket
    is replaced by its middle.  It ends when every source is within ``tolerance`` of its target;
    after ``rounds`` rounds without that it fails.
    """
    rows = histogram.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("full"))
    state = targets.join(rows, targets["source"].eqNullSafe(rows["source"])).drop(rows["source"])
    state = state.filter("source_size > 0").withColumn("mean", F.col("source_size") / F.col("full"))
    state = stored(state.select("source", "mean", "target", (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("top"),
                                F.lit(0.0).alias("tilt"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), F.lit(False).alias("done")))
    hist = histogram.filter("size > 0")
    for _ in range(rounds):
        h = hist.join(state.filter("not top").select(F.col("source").alias("_s"), "mean", "tilt"), F.col("source").eqNullSafe(F.col("_s")))
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        rate = F.least(F.lit(cap), raw)
        sums = h.groupBy("_s").agg(F.sum(F.col("n") * rate * F.col("size")).alias("got"),
                                   F.sum(F.when(raw < cap, F.col("n") * raw * F.col("size") * x).otherwise(0.0)).alias("slope"))
        s = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        over = F.col("got") - F.col("target")
        done = F.col("top") | (F.abs(over) <= tolerance * F.col("target"))
        low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        # The step on the logarithm of the sum: that is nearly straight where the sum is exponential.
        step = F.col("tilt") - F.log(F.col("got") / F.col("target")) * F.col("got") / F.col("slope")
        inside = F.coalesce((step > low) & (step < high), F.lit(False)) & (F.col("slope") > 0) & (F.col("got") > 0)
        state = stored(s.select("source", "mean", "target", "top", F.when(done, F.col("tilt")).when(inside, step).otherwise((low + high) / 2).alias("tilt"),
                                low.alias("low"), high.alias("high"), F.coalesce(done, F.lit(False)).alias("done")))
        if not state.filter("not done").limit(1).count():
            return state.select("source", "mean", F.when(~F.col("top"), F.col("tilt")).alias("tilt"))
    raise RuntimeError(f"no balance within {rounds} rounds")


RESULT = {"_source_size", "_target", "_copies"}
#: Columns that rows get on the way.
WORKING = {"_salt", "_k", "_s", "_z", "_at", "_each", "_extra"}


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, source: str = "source", doc_id: str = "doc_id",
        size: str = "size") -> DataFrame:
    """Add to every row: _source_size, _target (its source's) and _copies (0 to ``cap``).

    Rounding is systematic: by source in the order of sizes, the running sum of rates is rounded
    down at every size, from the starting point (of ``OFFSETS``) whose tokens come nearest to the target;
    any of them is off by less than the source's longest document.  Among rows of one source and size those with the smallest hash of their id are taken once
    more.  Null sources are one source; rows without words have rate one; null ids and repeated rows are
    rows like any other.  Reruns agree.  An empty table stays empty.  Input columns of the result's names are replaced.
    """
    docs, named = set_aside(docs.drop(*[c for c in docs.columns if c.lower() in RESULT]), WORKING, (source, doc_id, size))
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int"))
    counts = stored(salted.groupBy(F.col(source).alias("source"), F.col(size).cast("long").alias("size"), "_salt").agg(F.count(F.lit(1)).alias("n")))
    histogram = stored(counts.groupBy("source", "size").agg(F.sum("n").alias("n")))
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = stored(source_targets(sizes, weights, float(cap)))
    tilt = tilts(histogram, targets, float(cap))

    # Copies of each (source, size): differences of the rounded running sum of rates.
    h = histogram.join(tilt.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    run = Window.partitionBy("source").orderBy(F.col("size").desc())
    h = h.withColumn("rate", rate).withColumn("upto", F.sum(F.col("n") * F.col("rate")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    h = stored(h.withColumn("prior", F.coalesce(F.lag("upto").over(run), F.lit(0.0))).drop("tilt", "mean", "_s"))
    rounded = lambda u: F.floor(F.col("upto") + u + 1e-9) - F.floor(F.col("prior") + u + 1e-9)
    starts = [F.lit((k + 0.5) / OFFSETS) for k in range(OFFSETS)]
    tried = h.groupBy("source").agg(*[F.sum(rounded(u) * F.col("size")).alias(f"got{k}") for k, u in enumerate(starts)])
    tried = tried.join(targets.select(F.col("source").alias("_t"), "target"), F.col("source").eqNullSafe(F.col("_t")))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"got{k}") - F.col("target")).alias("off"), u.alias("start")) for k, u in enumerate(starts)]))
    h = h.join(tried.select("_t", "target", best["start"].alias("start")), F.col("source").eqNullSafe(F.col("_t")))
    h = h.withColumn("all", F.least(F.greatest(rounded(F.col("start")), F.lit(0)), cap * F.col("n")))
    # One copy more or less, of the size that fits what is left, where that helps.
    left = h.groupBy("source").agg((F.first("target") - F.sum(F.col("all") * F.col("size"))).alias("left")).select(F.col("source").alias("_l"), "left")
    h = h.drop("_t", "target").join(left, F.col("source").eqNullSafe(F.col("_l")))
    more = F.when(F.col("all") < cap * F.col("n"), F.struct(F.abs(F.col("left") - F.col("size")).alias("off"), F.col("size").alias("_z"), F.lit(1).alias("by")))
    less = F.when(F.col("all") > 0, F.struct(F.abs(F.col("left") + F.col("size")).alias("off"), F.col("size").alias("_z"), F.lit(-1).alias("by")))
    none = F.struct(F.abs(F.col("left")).alias("off"), F.lit(-1).cast("long").alias("_z"), F.lit(0).alias("by"))
    step = h.groupBy("source").agg(F.min(F.array_min(F.filter(F.array(none, more, less), lambda x: x.isNotNull()))).alias("step"))
    h = h.drop("_l").join(step.select(F.col("source").alias("_l"), "step"), F.col("source").eqNullSafe(F.col("_l")))
    h = h.withColumn("all", F.col("all") + F.when(F.col("step._z") == F.col("size"), F.col("step.by")).otherwise(0))
    h = h.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.floor(F.col("all") / F.col("n")).cast("long").alias("_each"),
                 (F.col("all") % F.col("n")).cast("long").alias("_more"))
    # The remainder goes to the salts in turn.
    c = counts.join(h, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_s", "_z").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.select("_s", "_z", F.col("_salt").alias("_k"), "_each", F.least(F.greatest(F.col("_more") - before, F.lit(0)), F.col("n")).alias("_extra"))
    t = targets.select(F.col("source").alias("_t"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    c = stored(c.join(t, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t"))

    # Plain equality of a key that is never null: the join keeps the window's partitioning, and rows move once.
    key = lambda column: F.coalesce(F.concat(F.lit("="), column), F.lit(""))
    c = c.withColumn("_s", key(F.col("_s")))
    rows = salted.withColumn("_s", key(F.col(source).cast("string"))).withColumn("_z", F.col(size).cast("long")).withColumnRenamed("_salt", "_k")
    order = Window.partitionBy("_s", "_z", "_k").orderBy(F.xxhash64(F.col(doc_id), F.lit(1)), F.col(doc_id))
    rows = rows.withColumn("_at", F.row_number().over(order)).join(c, ["_s", "_z", "_k"])
    copies = F.col("_each") + (F.col("_at") <= F.col("_extra")).cast("long")
    return named(rows.select(*[F.col(f"`{x}`") for x in docs.columns], "_source_size", "_target", copies.alias("_copies")))


@query("op2_entropy_balance")
def op2_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mix(docs)
    return mixed.select("doc_id", "size", F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"),
                        (F.col("_copies") * F.col("size")).cast("long").alias("taken"))
