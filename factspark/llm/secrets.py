"""Secret scans with corpus-wide ownership of the candidates.

DataFrame functions only.  Candidates of every text are hashed; a hash is counted by distinct
repositories and owners.  What many owners hold is a copied example; what looks live and belongs to one
owner is a secret.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspark.llm.common import bound, set_aside, stored, table, text_of
from factspark.llm.registry import query


@dataclass(frozen=True)
class Kind:
    """A kind of candidate: its pattern, the group that is the value, the characters that a span or
    value must have, and how many characters of a match follow the value."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    after: int = 0


#: The base kinds, in their order.  The least lengths of access and hex stand in the patterns too: a
#: run of their characters matches as a whole or not at all, so short runs need not be listed to be dropped.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds that count only when their owner is the only one.  A scheme or first part starts where its characters do and is read
#: once: a pattern that may start again at each letter of a long run takes the square of its length.
OWNED = (
    Kind("login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D:/@]+:([^\x20\x09-\x0D:/@]{8,})@", 1, 8, 1),
    Kind("issued", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|sk-|glpat-|AIza)[A-Za-z0-9_-]{16,}", 0, 20),
    Kind("signed", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 20),
    Kind("mixed", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
KINDS = BASE + OWNED
#: A text without a match of this holds no candidate.
ANY = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}|://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]{8,}@"""
       r"""|(?:gh[pousr]_|xox[abprs]-|sk_live_|sk-|glpat-|AIza)[A-Za-z0-9_-]{16}|eyJ[A-Za-z0-9_-]{8}|[A-Za-z0-9+/_=-]{20}""")
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234567"
#: A value that is nothing but such words and separators; one with more in it may be a credential.
PLACEHOLDER_PART = (r"(?i)example|sample|dummy|change|placeholder|your|my|the|insert|enter|here|api|access|secret|private|key|token|password|passwd|me"
                    r"|x{3,}|0{3,}|1234567[0-9]*|[+/_.=-]+")


def matches(text: Column, kind: Kind, number: int) -> Column:
    """Matches of one kind: structs of kind, i, gap (characters since the last match), n, value."""
    def zipped(parts: Column) -> Column:
        return F.transform(parts["m"], lambda m, i: F.struct(
            F.lit(number).alias("kind"), i.alias("i"), F.char_length(F.get(parts["gaps"], i)).alias("gap"), F.char_length(m).alias("n"),
            F.get(parts["v"], i).alias("value")))

    every = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else every
    return bound(F.struct(every.alias("m"), value.alias("v"), F.split(text, kind.pattern, -1).alias("gaps")), zipped)


def candidates(rows: DataFrame, text: str, repo: str, owner: str) -> DataFrame:
    """One row per candidate of rows with a unique ``_rid``: _rid, kind, start, end, value, repo, owner.

    Matches are leftmost and do not overlap within a kind; start and end count code points.
    """
    every = F.flatten(F.array(*[matches(text_of(F.col(text)), k, n) for n, k in enumerate(KINDS)]))
    found = rows.select("_rid", F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.explode(every).alias("c")).select("_rid", "repo", "owner", "c.*")
    upto = Window.partitionBy("_rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).withColumn("start", F.col("end") - F.col("n"))
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    return found.filter(F.char_length("value") >= least).select("_rid", "kind", "start", "end", "value", "repo", "owner")


def has_placeholder(value: Column) -> Column:
    return value.rlike(PLACEHOLDER)


def is_placeholder(value: Column) -> Column:
    """Nothing but placeholder words, each with separators after it."""
    return (value != "") & ~value.rlike("^[+/_.=-]") & (F.regexp_replace(value, PLACEHOLDER_PART, "") == "")


def looks_live(value: Column, kind: Column, placeholder=has_placeholder) -> Column:
    """At least 8 distinct characters, not a ``placeholder``; a mixed one has small and large letters and digits."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return varied & ~placeholder(value) & ((kind != len(KINDS) - 1) | mixed)


def judged(found: DataFrame, copied: int = 3) -> DataFrame:
    """Add to every candidate: owners and repos (distinct, of its value in the whole corpus), verdict.

    ``live``: one owner, and it looks live.  ``copied``: at least ``copied`` owners.  Otherwise ``unclear``.
    An unknown (null) owner is one owner of its own.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    found = found.withColumn("hash", F.sha2(F.col("value"), 256))
    # Two steps, so that a value that a third of all rows hold is one row a task and owner before it moves.
    owned = found.select("hash", known("owner").alias("owner"), known("repo").alias("repo")).distinct()
    owned = owned.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    verdict = F.when(F.col("owners") >= copied, "copied").when((F.col("owners") == 1) & looks_live(F.col("value"), F.col("kind")), "live").otherwise("unclear")
    return found.join(owned, "hash").withColumn("verdict", verdict)


def added(found: DataFrame) -> DataFrame:
    """Base candidates, and those of the other kinds that are live and overlap no base one."""
    base = F.col("kind") < len(BASE)
    own = Window.partitionBy("_rid")
    before = F.max(F.when(base, F.col("end"))).over(own.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(own.orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0))
    rows = found.filter(base | (F.col("verdict") == "live")).withColumn("_b", before).withColumn("_a", after)
    apart = (F.coalesce("_b", F.lit(0)) <= F.col("start")) & (F.col("_a").isNull() | (F.col("_a") >= F.col("end")))
    return rows.filter(base | apart).drop("_a", "_b")


#: Columns that rows get on the way.
WORKING = {"_rid", "_all", "_cuts"}


def split_rows(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may hold a candidate, stored, with a unique ``_rid``; and all others as they are."""
    hit = text_of(F.col(text)).rlike(ANY)
    return stored(docs.filter(hit).withColumn("_rid", F.monotonically_increasing_id())), docs.filter(~hit)


def secret_spans(docs: DataFrame, text: str = "text", repo: str = "source", owner: str = "source") -> DataFrame:
    """The input's rows with n_assign, n_access, n_hex, base (array of struct kind, start, end) and spans (the same, all).

    Rows without a candidate have zeros and empty arrays; null text is empty.  Rows are never dropped and
    repeated rows stay repeated.  Columns with these names are replaced.
    """
    made = ["n_assign", "n_access", "n_hex", "base", "spans"]
    rest, named = set_aside(docs.drop(*[c for c in docs.columns if c.lower() in made]), WORKING, (text, repo, owner))
    rows, others = split_rows(rest, text)
    found = added(judged(candidates(rows, text, repo, owner)))
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", name.alias("name"), "end")
    by_row = found.groupBy("_rid").agg(*[F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{k.name}") for n, k in enumerate(BASE)],
                                       F.sort_array(F.collect_list(span)).alias("_all"))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["name"].alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    by_row = by_row.withColumn("base", plain(F.filter("_all", lambda s: s["kind"] < len(BASE)))).withColumn("spans", plain(F.col("_all")))
    keep = [F.col(f"`{c}`") for c in rest.columns]
    filled = [F.coalesce(f"n_{k.name}", F.lit(0)).cast("long").alias(f"n_{k.name}") for k in BASE] + [F.coalesce(c, empty).alias(c) for c in ("base", "spans")]
    none = [F.lit(0).cast("long").alias(f"n_{k.name}") for k in BASE] + [empty.alias("base"), empty.alias("spans")]
    return named(rows.join(by_row, "_rid", "left").select(*keep, *filled).unionByName(others.select(*keep, *none)))


def redact(docs: DataFrame, text: str = "text", repo: str = "source", owner: str = "source", mark: str = "[SECRET]",
           copied: int = 3) -> DataFrame:
    """The input's rows and columns; values of any kind that look live and have fewer than ``copied`` owners are replaced by ``mark``.

    So a value that two owners hold goes in both, and one with a placeholder word inside goes too.  Copied values and those that
    are placeholders as a whole stay, and so does every row.  Overlapping values are replaced once.
    """
    docs, named = set_aside(docs, WORKING, (text, repo, owner))
    rows, others = split_rows(docs, text)
    found = judged(candidates(rows, text, repo, owner), copied).filter((F.col("owners") < copied) & looks_live(F.col("value"), F.col("kind"), is_placeholder))
    after = F.element_at(F.array(*[F.lit(k.after) for k in KINDS]), F.col("kind") + 1)
    found = found.select("_rid", (F.col("end") - after).alias("b"), (F.col("end") - after - F.char_length("value")).alias("a"))
    order = Window.partitionBy("_rid").orderBy("a", "b")
    new = F.coalesce(F.col("a") >= F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    found = found.withColumn("_n", new.cast("long"))
    found = found.withColumn("_island", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = found.groupBy("_rid", "_island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    cuts = cuts.groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_cuts"))
    whole = F.col(f"`{text}`")
    cast = lambda c: c.cast("int")

    def piece(cut: Column, i: Column) -> Column:
        begin = F.when(i > 0, F.get(F.col("_cuts"), i - 1)["b"]).otherwise(0)
        return F.concat(F.substring(whole, cast(begin) + 1, cast(cut["a"] - begin)), F.lit(mark))

    last = F.substring(whole, cast(F.element_at("_cuts", -1)["b"]) + 1, F.char_length(whole))
    clean = F.when(F.col("_cuts").isNull(), whole).otherwise(F.concat(F.array_join(F.transform("_cuts", piece), ""), last))
    keep = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return named(rows.join(cuts, "_rid", "left").select(*keep).unionByName(others))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op7_secret_ownership")
def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document.  A source and language are the repository, a source is the owner."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.struct("source", "lang").alias("repo"))
    found = secret_spans(docs, repo="repo", owner="source")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
