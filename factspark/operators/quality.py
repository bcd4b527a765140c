"""Check prose against known packages, files and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.functions import markdown as M
from factspark.functions.rows import exploded
from factspark.functions.text import trimmed
from factspark.operators.ranking import first_of, top_n
from factspark.session import cut_lineage

# File suffixes that make a token a file reference.
FILE_SUFFIXES = "ts|tsx|js|mjs|cjs|jsx|py|java|json|md|ya?ml|toml|go|rs|kt|swift|c|cpp|h|hpp"
FILE_EXT = rf"\.({FILE_SUFFIXES})\b"
# What counts as a scoped package, a bare path and a quoted token; results must agree exactly.
SCOPED_PACKAGE = r"(?i)^@[a-z0-9][a-z0-9_.-]*/[a-z0-9][a-z0-9_.-]*$"
# A bare path: names joined by single slashes, the last one with a file suffix.  Runs of its characters are found first, so no
# pattern repeats a group: that costs the JVM's regular expressions a stack frame a name.
PATH_RUN = r"[\w@./-]+"
BARE_PATH = rf"^/?([\w@.-]+/[\w@./-]*[\w@.-]\.(?:{FILE_SUFFIXES})\b)"
QUOTED = r"`([^`\n]+)`"


def ground_truth(nodes: DataFrame, packages: DataFrame, entities: DataFrame, calls: DataFrame,
                 edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(packages(ws, name), files(ws, path), edges(ws, src, dst))``.

    ``nodes(ws, id, short)``; entry files are relative to their package and are
    moved under its path.
    """
    names = (nodes.select("ws", F.explode(F.array("id", "short")).alias("name"))
             .union(packages.select("ws", "pkg_id")).where(F.col("name") != "").distinct())
    entries = packages.select("ws", "path", F.explode("entry_files").alias("e")).select(
        "ws", F.when(F.col("path") == "", F.col("e")).otherwise(F.concat_ws("/", "path", "e")).alias("path"))
    files = (entities.select("ws", F.col("file").alias("path")).union(entries)
             .union(calls.select("ws", F.col("from_file").alias("path")))
             .select("ws", F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path"))
             .where(F.col("path") != "").distinct())
    return names, files, edges.select("ws", "src", "dst").distinct()


def _part(word: Column, length: Column, index: Column, shift: Column) -> Column:
    """Key of the third ``index`` that a word of ``length`` has, read ``shift`` characters off in ``word``.

    Null where the word ends before.  Words of one or two characters have a single, empty part.
    """
    third = F.floor(length / 3).cast("int")
    size = F.when(length < 3, 0).when(index == 2, length - 2 * third).otherwise(third)
    start = index * third + shift
    inside = (start >= 0) & (start + size <= F.length(word)) & ((length >= 3) | ((index == 0) & (shift == 0)))
    return F.when(inside, F.xxhash64(length, index, F.substring(word, start + 1, size)))


def _own_parts(word: Column) -> Column:
    thirds = F.array(*[F.lit(i) for i in range(3)])
    return F.filter(F.transform(thirds, lambda i: _part(word, F.length(word), i, F.lit(0))), lambda k: k.isNotNull())


def _near_parts(word: Column) -> Column:
    """Keys of all thirds that words within edit distance two of ``word`` may have kept: 75 at most.

    Two edits touch two of three parts; the third stands at most two characters off.
    """
    near = F.array(*[F.lit(i) for i in range(-2, 3)])
    thirds = F.array(*[F.lit(i) for i in range(3)])
    keys = F.flatten(F.flatten(F.transform(near, lambda d: F.transform(thirds, lambda i: F.transform(
        near, lambda shift: F.when(F.length(word) + d > 0, _part(word, F.length(word) + d, i, shift)))))))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def _prefixes(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(word, F.lit(1), n))


def nearest_known(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Best suggestion ``(ws, token, suggestion)`` for each distinct token that has one.

    ``known(ws, name, ord)``.  The first known value that equals, starts or
    continues the token wins; otherwise the smallest edit distance up to two,
    the earlier one on a tie.  Both rules are equi-joins (prefixes, thirds of
    words), so tokens are never compared with all known values.
    """
    asked = tokens.select("ws", "token").where(F.length("token") > 0).distinct()
    names = known.where(F.length("name") > 0).groupBy("ws", "name").agg(F.min("ord").alias("ord"))
    entry = F.struct("ord", "name")
    starts = (names.select("ws", F.explode(_prefixes(F.col("name"))).alias("token"), entry.alias("_k"))
              .groupBy("ws", "token").agg(F.min("_k").alias("_k")))
    continued = asked.join(starts, ["ws", "token"])
    extended = (asked.select("ws", "token", F.explode(_prefixes(F.col("token"))).alias("name"))
                .join(names, ["ws", "name"]).groupBy("ws", "token").agg(F.min(entry).alias("_k")))
    by_prefix = continued.union(extended).groupBy("ws", "token").agg(F.min("_k").alias("_k"))
    rest = asked.join(by_prefix, ["ws", "token"], "left_anti")
    left = exploded(rest, ["ws", "token"], _near_parts(F.col("token")), "_s")
    right = exploded(names, ["ws", "name", "ord"], _own_parts(F.col("name")), "_s")
    pairs = left.join(right, ["ws", "_s"]).select("ws", "token", "name", "ord").distinct()
    distance = F.levenshtein(F.col("token"), F.col("name"), 2)
    by_distance = (pairs.withColumn("_d", distance).where(F.col("_d") >= 0)
                   .groupBy("ws", "token").agg(F.min(F.struct("_d", "ord", "name")).alias("_k"))
                   .select("ws", "token", F.struct("_k.ord", "_k.name").alias("_k")))
    return by_prefix.union(by_distance).select("ws", "token", F.col("_k.name").alias("suggestion"))


def bare_paths(prose: Column) -> Column:
    """Unquoted file paths in a text, in order; names that an empty one stands between belong to different paths."""
    found = F.regexp_extract_all(F.regexp_replace(prose, "/{2,}", " "), F.lit(PATH_RUN), 0)
    return F.filter(F.transform(F.filter(found, lambda r: F.contains(r, F.lit("/"))), lambda r: F.regexp_extract(r, BARE_PATH, 1)), lambda r: r != "")


def claims(docs: DataFrame) -> DataFrame:
    """Every checkable reference of ``docs(ws, doc, text)``.

    ``(ws, doc, ord, kind, token, path, src, dst)``: back-quoted tokens first,
    then bare paths, then table rows, which is the order they are reported in.
    """
    prose = docs.select("ws", "doc", M.strip_fences(F.col("text")).alias("prose"))
    shaped = M.call_table_edges(prose, "prose")
    none = F.lit(None).cast("string")

    def item(group: int, kind: Column, token: Column, path: Column, src: Column, dst: Column, at: Column) -> Column:
        return F.struct((F.lit(group * 10_000_000) + at).cast("long").alias("ord"), kind.alias("kind"),
                        token.alias("token"), path.alias("path"), src.alias("src"), dst.alias("dst"))

    def as_path(token: Column) -> Column:
        return F.regexp_replace(F.replace(token, F.lit("\\"), F.lit("/")), r"^(?:\./)++", "")
    quoted = F.transform(F.regexp_extract_all("prose", F.lit(QUOTED), 1), lambda t, i: F.struct(trimmed(t).alias("t"), i.alias("i")))
    is_path = lambda t: F.contains(t, F.lit("/")) & t.rlike(FILE_EXT)
    marked = F.transform(
        F.filter(quoted, lambda q: is_path(q["t"]) | q["t"].rlike(SCOPED_PACKAGE)),
        lambda q: item(0, F.when(is_path(q["t"]), "file").otherwise("package"), q["t"], as_path(q["t"]), none, none, q["i"]))
    bare = F.transform(bare_paths(F.col("prose")),
                       lambda t, i: item(1, F.lit("file"), t, as_path(t), none, none, i))
    rows = F.transform("table_edges", lambda e, i: item(
        2, F.lit("edge"), F.concat(e["src"], F.lit(" → "), e["dst"]), none, e["src"], e["dst"], i))
    return exploded(shaped, ["ws", "doc"], F.concat(marked, bare, rows), "c").select("ws", "doc", "c.*")


def unknown_files(found: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select("ws", F.lower("path").alias("_k")).distinct()
    return (found.where(F.col("kind") == "file").withColumn("_k", F.lower("path"))
            .join(known, ["ws", "_k"], "left_anti")
            .select("ws", "doc", "ord", "kind", "token", F.lit("unknown file").alias("reason"),
                    F.lit(None).cast("string").alias("suggestion")))


def unknown_packages(found: DataFrame, packages: DataFrame) -> DataFrame:
    names = packages.select("ws", F.col("name").alias("token")).distinct()
    wrong = found.where(F.col("kind") == "package").join(names, ["ws", "token"], "left_anti")
    ranked = packages.select("ws", "name", "ord") if "ord" in packages.columns else \
        packages.select("ws", "name", F.col("name").alias("ord"))
    near = nearest_known(wrong.select("ws", "token"), ranked)
    return (wrong.join(near, ["ws", "token"], "left")
            .select("ws", "doc", "ord", "kind", "token", F.lit("unknown package").alias("reason"), "suggestion"))


def wrong_edges(found: DataFrame, edges: DataFrame) -> DataFrame:
    real = edges.select("ws", "src", "dst").distinct()
    back = real.select("ws", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_rev"))
    wrong = (found.where(F.col("kind") == "edge").join(real, ["ws", "src", "dst"], "left_anti")
             .join(back, ["ws", "src", "dst"], "left"))
    return wrong.select(
        "ws", "doc", "ord", "kind", "token",
        F.when(F.col("_rev"), "reversed").otherwise("absent").alias("reason"),
        F.when(F.col("_rev"), F.concat("dst", F.lit(" → "), "src")).alias("suggestion"))


def violation_report(docs: DataFrame, packages: DataFrame, files: DataFrame, edges: DataFrame,
                     cap: int | None = None) -> DataFrame:
    """All violations of each document, or the first ``cap`` in order, made distinct."""
    found = cut_lineage(claims(docs))  # written once, read by three checks; the prose is not in it
    rows = (unknown_files(found, files).unionByName(unknown_packages(found, packages))
            .unionByName(wrong_edges(found, edges)))
    kept = rows if cap is None else top_n(rows, ["ws", "doc"], ["ord"], cap)
    return first_of(kept, ["ws", "doc", "kind", "token"], ["ord"])


def cited_packages(docs: DataFrame, packages: DataFrame) -> DataFrame:
    """Real packages a document quotes, with their first position."""
    prose = M.strip_fences(F.col("text"))
    quoted = docs.select("ws", "doc", F.posexplode(F.regexp_extract_all(prose, F.lit(QUOTED), 1)).alias("ord", "t"))
    seen = (quoted.select("ws", "doc", trimmed(F.col("t")).alias("name"), "ord")
            .groupBy("ws", "doc", "name").agg(F.min("ord").cast("long").alias("first_ord")))
    return seen.join(packages.select("ws", "name").distinct(), ["ws", "name"], "left_semi")


def accept_drafts(drafts: DataFrame, violations: DataFrame) -> DataFrame:
    """The draft to keep of each document.

    ``drafts(ws, doc, round, text)``, ``violations(ws, doc, round, ...)``.  A
    later draft replaces the first only with strictly fewer violations; a
    document that still has some is degraded and must not be stored.
    """
    counts = violations.groupBy("ws", "doc", "round").agg(F.count("*").alias("n"))
    scored = drafts.join(counts, ["ws", "doc", "round"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    best = first_of(scored, ["ws", "doc"], ["n", "round"])
    return best.withColumn("degraded", F.col("n") > 0)
