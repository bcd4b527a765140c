"""Package graphs: resolve calls and imports, aggregate edges, walk and select.

Edges are plain DataFrames ``edges(ws, src, dst, edge_ord)``.  Specifiers are
matched by equi-joins on exploded candidates, after the specifiers have been
made distinct, so that a name used everywhere costs one probe, not one per use.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspark.functions import paths as P
from factspark.operators.ranking import top_n
from factspark.session import bucketed, cut_lineage

MAX_CHARS = 2147483647
EDGE = ["ws", "src", "dst"]


def text_key(*names: str) -> Column:
    """A number made from columns, to stand before them among the keys of joins and groups: sorts then compare numbers.

    Sorts see the first eight bytes of their first key at once.  Behind a workspace or a common folder nearly every comparison
    reads both rows whole instead, so its cost grows faster than the rows.
    """
    return F.xxhash64(*names)


# ---------------------------------------------------------------- resolution

def file_packages(entities: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """``(ws, file, pkg_id)`` of every file that declares or imports something.

    A file claimed twice goes to the package declared last.
    """
    claimed = (entities.select("ws", P.norm_path(F.col("file")).alias("file"), "pkg_id")
               .union(imports.select("ws", P.norm_path(F.col("from_file")).alias("file"), "pkg_id")))
    order = packages.select("ws", "pkg_id", "pkg_ord")
    return (claimed.join(order, ["ws", "pkg_id"])
            .groupBy("ws", "file").agg(F.max(F.struct("pkg_ord", "pkg_id")).alias("_p"))
            .select("ws", "file", F.col("_p.pkg_id").alias("pkg_id")))


def bound_imports(imports: DataFrame) -> DataFrame:
    """``(ws, file, binding, spec)``: the first import of a file that binds the name."""
    return (imports.select("ws", P.norm_path(F.col("from_file")).alias("file"), "spec", "imp_ord",
                           F.explode("names").alias("binding"))
            .groupBy("ws", "file", "binding").agg(F.min(F.struct("imp_ord", "spec")).alias("_i"))
            .select("ws", "file", "binding", F.col("_i.spec").alias("spec")))


def without_prefix(name: Column, prefix: str) -> Column:
    """``name`` without a literal ``prefix``."""
    return F.when(F.startswith(name, F.lit(prefix)), F.substring(name, len(prefix) + 1, MAX_CHARS)).otherwise(name) if prefix else name


def bare_spellings(spec: Column, id_prefix: str = "") -> Column:
    """The ways a bare specifier may spell a package id."""
    stripped = F.regexp_replace(spec, r"^@[^/]+/", "")
    short = without_prefix(stripped, id_prefix)
    return F.array_distinct(F.array(spec, stripped, F.substring_index(spec, "/", -1), short))


def resolve_modules(requests: DataFrame, files: DataFrame, packages: DataFrame,
                    id_prefix: str = "", mode: str = "reference") -> DataFrame:
    """Package of each distinct ``(ws, file, spec)``; unresolved requests are dropped.

    ``mode='resolve'`` also resolves ``..`` segments, which the default leaves as written.
    """
    bare = requests.where(~_relative(F.col("spec"))).select("ws", "file", "spec").distinct()
    named = named_targets(requests, packages, id_prefix)
    return local_targets(requests, files, mode).unionByName(bare.join(named, ["ws", "spec"]).select("ws", "file", "spec", "pkg_id"))


def _relative(spec: Column) -> Column:
    return spec.rlike(r"^\.\.?/")


def local_targets(requests: DataFrame, files: DataFrame, mode: str = "reference") -> DataFrame:
    """``(ws, file, spec, pkg_id)`` of the relative specifiers that lead to a file."""
    relative = requests.where(_relative(F.col("spec"))).select("ws", "file", "spec").distinct()
    base = F.concat(F.regexp_replace("file", r"[^/]*$", ""), F.col("spec"))
    path = P.resolve_dots(base) if mode == "resolve" else base
    tried = F.array(*[F.concat(path, F.lit(s)) for s in P.MODULE_SUFFIXES])
    probes = (relative.select("ws", "file", "spec", F.posexplode(tried).alias("_pos", "_c"))
              .withColumn("_c", P.norm_path(F.col("_c"))))
    return (probes.join(files.select("ws", F.col("file").alias("_c"), "pkg_id"), ["ws", "_c"])
            .groupBy("ws", "file", "spec").agg(F.min(F.struct("_pos", "pkg_id")).alias("_p"))
            .select("ws", "file", "spec", F.col("_p.pkg_id").alias("pkg_id")))


def named_targets(requests: DataFrame, packages: DataFrame, id_prefix: str = "") -> DataFrame:
    """``(ws, spec, pkg_id)`` of the bare specifiers that spell a package, whatever files use them."""
    return (requests.where(~_relative(F.col("spec"))).select("ws", "spec").distinct()
            .select("ws", "spec", F.explode(bare_spellings(F.col("spec"), id_prefix)).alias("pkg_id"))
            .join(packages.select("ws", "pkg_id", "pkg_ord"), ["ws", "pkg_id"])
            .groupBy("ws", "spec").agg(F.min(F.struct("pkg_ord", "pkg_id")).alias("_p"))
            .select("ws", "spec", F.col("_p.pkg_id").alias("pkg_id")))


def resolve_calls(calls: DataFrame, imports: DataFrame, entities: DataFrame, packages: DataFrame,
                  id_prefix: str = "", mode: str = "reference") -> DataFrame:
    """Cross-package calls ``(ws, ord, src, dst, sym, file)``; test callers are left out."""
    files = file_packages(entities, imports, packages)
    made = calls.select("ws", P.norm_path(F.col("from_file")).alias("file"), F.col("call_ord").alias("ord"),
                        F.col("callee").alias("sym"), F.coalesce("root", "callee").alias("binding")).where(~P.is_test_call(F.col("file")))
    # Calls meet the bindings where these are reduced; bare specifiers are resolved by themselves, not file by file.
    asked = imports.where(F.size("names") > 0).select("ws", P.norm_path(F.col("from_file")).alias("file"), "spec")
    named = named_targets(asked, packages, id_prefix).withColumnRenamed("pkg_id", "_named")
    local = local_targets(asked, files, mode).withColumnRenamed("pkg_id", "_local")
    hits = (made.join(bound_imports(imports), ["ws", "file", "binding"]).join(named, ["ws", "spec"], "left")
            .join(local, ["ws", "file", "spec"], "left").withColumn("dst", F.coalesce("_named", "_local")).where("dst IS NOT NULL"))
    return (hits.join(files.withColumnRenamed("pkg_id", "src"), ["ws", "file"]).where(F.col("src") != F.col("dst"))
            .select("ws", "ord", "src", "dst", "sym", "file"))


def import_edges(imports: DataFrame, packages: DataFrame, id_prefix: str = "",
                 mode: str = "reference") -> DataFrame:
    """Package edges of the imports, external modules and self-edges dropped.

    A relative specifier goes to the first known id among its path segments, a
    bare one to the first declared package whose id is a segment or starts the
    first segment.
    """
    def short(s: Column) -> Column:
        return without_prefix(s, id_prefix)
    # Only relative specifiers need their folder.  Written once: extraction must not run again for every use below.
    folder = F.when(F.startswith("spec", F.lit(".")), P.dirname(F.col("from_file")))
    uses = cut_lineage(imports.groupBy("ws", "pkg_id", "spec", folder.alias("dir")).agg(F.min("imp_ord").alias("ord")))
    relative = uses.where(F.startswith("spec", F.lit(".")))
    if mode == "resolve":
        segments = F.split(P.join_path(F.col("dir"), F.col("spec")), "/")
    else:
        segments = F.filter(F.concat(F.split("dir", "/"), F.filter(F.split("spec", "/"), lambda s: ~s.isin(".", ".."))),
                            lambda s: s != "")
    ids = packages.select("ws", F.col("pkg_id").alias("dst"), "pkg_ord")
    near = (relative.select("ws", "pkg_id", "spec", "dir", "ord", F.posexplode(segments).alias("_pos", "_seg"))
            .where(F.col("_pos") > 0)
            .withColumn("dst", F.explode(F.array_distinct(F.array(F.col("_seg"), short(F.col("_seg"))))))
            .join(ids, ["ws", "dst"])
            .groupBy("ws", "pkg_id", "spec", "dir").agg(F.min(F.struct("_pos", "_seg", "ord")).alias("_m"))
            .select("ws", F.col("pkg_id").alias("src"), short(F.col("_m._seg")).alias("dst"), F.col("_m.ord").alias("ord")))
    bare = uses.where(~F.startswith("spec", F.lit("."))).drop("dir")
    parts = F.split("spec", "/")
    lead = F.get(parts, F.lit(0))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(lead), F.lit(1))),
                         lambda n: F.substring(lead, F.lit(1), n))
    owner = (bare.select("ws", "spec").distinct()
             .select("ws", "spec", F.explode(F.array_union(F.transform(parts, short), starts)).alias("dst"))
             .join(ids, ["ws", "dst"])
             .groupBy("ws", "spec").agg(F.min(F.struct("pkg_ord", "dst")).alias("_m"))
             .select("ws", "spec", F.col("_m.dst").alias("dst")))
    far = bare.join(owner, ["ws", "spec"]).select("ws", F.col("pkg_id").alias("src"), "dst", "ord")
    return (near.union(far).where(F.col("src") != F.col("dst"))
            .groupBy("ws", "src", "dst").agg(F.min("ord").alias("edge_ord")))


def match_folded(requests: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None,
                 name: str = "artifact") -> DataFrame:
    """Dependency edges by id or alias, whatever their case and separators.

    ``requests(ws, src, artifact)``, ``nodes(ws, id, ord)``, ``aliases(ws, id, alias)``.
    """
    spelled = nodes.select("ws", "id", "ord", P.fold_id(F.col("id")).alias("_k"))
    if aliases is not None:
        named = aliases.join(nodes.select("ws", "id", "ord"), ["ws", "id"])
        spelled = spelled.union(named.select("ws", "id", "ord", P.fold_id(F.col("alias")).alias("_k")))
    first = (spelled.groupBy("ws", "_k").agg(F.min(F.struct("ord", "id")).alias("_n"))
             .select("ws", "_k", F.col("_n.id").alias("dst")))
    asked = requests.select("ws", "src", P.fold_id(F.col(name)).alias("_k")).distinct()
    return asked.join(first, ["ws", "_k"]).where(F.col("src") != F.col("dst")).select("ws", "src", "dst").distinct()


def declared_targets(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges from declared remote clients to the first node with that id or directory name."""
    spelled = (nodes.select("ws", "id", "ord", F.explode(F.array_distinct(F.array(
        P.fold_id(F.col("id")), P.fold_id(P.basename(F.col("path")))))).alias("_k")))
    # The first two candidates are enough: at most one of them is the caller itself.
    two = top_n(spelled, ["ws", "_k"], ["ord", "id"], 2)
    asked = targets.select("ws", "src", P.fold_id(F.col("target")).alias("_k")).distinct()
    found = (asked.join(two, ["ws", "_k"]).where(F.col("id") != F.col("src"))
             .groupBy("ws", "src", "_k").agg(F.min(F.struct("ord", "id")).alias("_n"))
             .select("ws", "src", F.col("_n.id").alias("dst")).distinct())
    return found.join(edges.select("ws", "src", "dst"), ["ws", "src", "dst"], "left_anti")


# --------------------------------------------------------------- aggregation

def aggregate_edges(calls: DataFrame, evidence: int | None = None) -> DataFrame:
    """One row per edge: calls, distinct symbols, first file, its symbols in order.

    Calls are first reduced to ``(edge, symbol)``, so the list of an edge is as long as the
    interface that it uses; ``evidence`` keeps its first symbols.  One aggregation gives totals and list.
    """
    return keyed_edges(calls.withColumn("key", text_key(*EDGE)), evidence).drop("key")


def keyed_edges(calls: DataFrame, evidence: int | None = None) -> DataFrame:
    """``aggregate_edges`` of calls that have the ``key`` of their edge; the edges keep it and are dealt out by it."""
    per_sym = calls.groupBy("key", *EDGE, "sym").agg(
        F.count("*").alias("n"), F.min("ord").alias("ord"), F.min(F.struct("ord", "file")).alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "sym"))), lambda x: x["sym"])
    return per_sym.repartition("key").groupBy("key", *EDGE).agg(
        F.sum("n").alias("calls"), F.count("*").alias("symbols"), F.min("ord").alias("edge_ord"),
        F.min("first")["file"].alias("file"), (F.slice(listed, 1, evidence) if evidence else listed).alias("syms"))


def edge_set(calls: DataFrame) -> DataFrame:
    """Distinct edges with their first position."""
    return calls.groupBy("ws", "src", "dst").agg(F.min("ord").alias("edge_ord"))


def degrees(edges: DataFrame) -> DataFrame:
    """``cited_by`` and ``cites`` of every node, from one aggregation over both ends."""
    ends = edges.select("ws", F.explode(F.array(
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("ws", F.col("e.id").alias("id")).agg(
        F.sum("e.i").alias("cited_by"), F.sum("e.o").alias("cites"))


def role_of(hub: int = 2, entry: int = 2) -> Column:
    return (F.when(F.col("cited_by") >= hub, "hub")
            .when((F.col("cited_by") == 0) & (F.col("cites") >= entry), "entry").otherwise("leaf"))


def roles(edges: DataFrame, hub: int = 2, entry: int = 2) -> DataFrame:
    return degrees(edges).withColumn("role", role_of(hub, entry))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """How many directions each pair is connected in."""
    one = edges.select("ws", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src").distinct()
    return one.groupBy("ws", "a", "b").agg(F.count("*").alias("directions"))


def dependents(edges: DataFrame, cap: int | None = None) -> DataFrame:
    """Reverse adjacency ``(ws, id, dependent, pos)`` in declaration order, the first ``cap`` per node."""
    back = edges.select("ws", F.col("dst").alias("id"), F.col("src").alias("dependent"), "edge_ord")
    return top_n(back, ["ws", "id"], ["edge_ord", "dependent"], cap, rank="pos").drop("edge_ord")


def most_cited(edges: DataFrame, k: int = 8) -> DataFrame:
    cited = edges.groupBy("ws", F.col("dst").alias("id")).agg(
        F.count("*").alias("cited_by"), F.min("edge_ord").alias("first_ord"))
    return top_n(cited, ["ws"], [F.col("cited_by").desc(), F.col("first_ord"), F.col("id")], k, rank="pos")


# ----------------------------------------------------------------- selection

def core_subgraph(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Edges with both ends in ``core(ws, id)``."""
    ids = core.select("ws", "id").distinct()
    return (edges.join(ids.withColumnRenamed("id", "src"), ["ws", "src"], "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), ["ws", "dst"], "left_semi")
            .select("ws", "src", "dst", "edge_ord"))


def edges_touching(edges: DataFrame, ids: DataFrame, cap: int | None = None) -> DataFrame:
    """Edges with an end in ``ids(ws, id)``, the first ``cap`` of each workspace."""
    some = ids.select("ws", "id").distinct()
    out = edges.join(some.withColumnRenamed("id", "src"), ["ws", "src"], "left_semi").select(*edges.columns)
    into = edges.join(some.withColumnRenamed("id", "dst"), ["ws", "dst"], "left_semi").select(*edges.columns)
    return top_n(out.union(into).distinct(), ["ws"], ["edge_ord", "src", "dst"], cap)


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seeds and everything one edge away, either way."""
    some = seeds.select("ws", "id").distinct()
    out = edges.join(some.withColumnRenamed("id", "src"), ["ws", "src"], "left_semi").select("ws", F.col("dst").alias("id"))
    into = edges.join(some.withColumnRenamed("id", "dst"), ["ws", "dst"], "left_semi").select("ws", F.col("src").alias("id"))
    return some.union(out).union(into).distinct()


def pair_evidence(pairs: DataFrame, calls: DataFrame, by_symbol: int | None = None,
                  by_package: int | None = None) -> DataFrame:
    """Calls that support a labelled pair.

    ``pairs(ws, pair_id, src, dst, symbols)``, ``calls(ws, ord, src, caller, callee, file)``.
    Calls that mention one of the symbols come first; a pair without any gets the
    calls made by its two packages.  With caps, candidates are cut per symbol and per
    package before they meet the pairs, which loses nothing a pair could show.

    Without caps the rows of pairs and calls are made once and move no further: symbols alone tell which pairs have no call,
    and a call that mentions two symbols of a pair is dropped where it meets the second one.
    """
    cols = ["ws", "pair_id", "ord", "caller", "callee", "file"]
    named = calls.select("ws", "ord", "caller", "callee", "file",
                         F.explode(F.array_distinct(F.array("caller", "callee"))).alias("sym"))
    labels = pairs.select("ws", "pair_id", F.explode("symbols").alias("sym")).groupBy("ws", "pair_id").agg(F.collect_set("sym").alias("symbols"))
    wanted = labels.select("ws", "pair_id", "symbols", F.explode("symbols").alias("sym"))
    again = (F.col("sym") != F.col("caller")) & F.array_contains("symbols", F.col("caller"))
    hits = wanted.join(top_n(named, ["ws", "sym"], ["ord", "callee"], by_symbol), ["ws", "sym"]).where(~F.coalesce(again, F.lit(False))).select(*cols)
    first = top_n(hits, ["ws", "pair_id"], ["ord", "callee"], by_symbol).withColumn("via", F.lit("symbol"))
    found = named.select("ws", "sym").join(wanted.select("ws", "sym").distinct(), ["ws", "sym"], "left_semi").distinct()
    bare = pairs.join(wanted.join(found, ["ws", "sym"], "left_semi").select("ws", "pair_id").distinct(), ["ws", "pair_id"], "left_anti")
    owns = bare.select("ws", "pair_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("src")).distinct()
    own = owns.join(top_n(calls, ["ws", "src"], ["ord", "callee"], by_package), ["ws", "src"]).select(*cols)
    rest = top_n(own, ["ws", "pair_id"], ["ord", "callee"], by_package).withColumn("via", F.lit("package"))
    return first.unionByName(rest)


def evidence_classes(pairs: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``pair_evidence`` lists, without the product of pairs and calls.

    Calls with a symbol, and calls of a package, are a class; a pair refers to classes.  The first result has one row a pair and class,
    ``(ws, pair_id, via, key, calls)`` with the number of calls, the second one row a class and call, ``(ws, via, key, ord,
    caller, callee, file)``, of the classes that pairs refer to.  Joined on ``(ws, via, key)`` and made distinct they are the
    rows of ``pair_evidence``; by themselves they are as many as there are symbols of pairs and calls.
    """
    rest = ["ord", "caller", "callee", "file"]
    named = calls.select("ws", F.lit("symbol").alias("via"), F.explode(F.array_distinct(F.array("caller", "callee"))).alias("key"), *rest)
    members = named.unionByName(calls.select("ws", F.lit("package").alias("via"), F.col("src").alias("key"), *rest)).where("key IS NOT NULL")
    sizes = members.groupBy("ws", "via", "key").agg(F.count("*").alias("calls"))
    wanted = pairs.select("ws", "pair_id", F.lit("symbol").alias("via"), F.explode(F.array_distinct("symbols")).alias("key")).distinct()
    first = wanted.join(sizes, ["ws", "via", "key"])
    bare = pairs.join(first.select("ws", "pair_id").distinct(), ["ws", "pair_id"], "left_anti")
    owns = bare.select("ws", "pair_id", F.lit("package").alias("via"), F.explode(F.array_distinct(F.array("src", "dst"))).alias("key")).distinct()
    links = first.unionByName(owns.join(sizes, ["ws", "via", "key"])).select("ws", "pair_id", "via", "key", "calls")
    return links, members.join(links.select("ws", "via", "key").distinct(), ["ws", "via", "key"], "left_semi").select("ws", "via", "key", *rest)


def first_tier(df: DataFrame, key: str = "ws", tier: str = "tier") -> DataFrame:
    """Per workspace only the rows of the best tier present."""
    best = df.groupBy(key).agg(F.min(tier).alias("_t"))
    return df.join(best, key).where(F.col(tier) == F.col("_t")).drop("_t")


def usable_tiers(sources: list[DataFrame], minimum: int = 3) -> DataFrame:
    """The first source with at least ``minimum`` rows, chosen per workspace."""
    out = None
    for n, source in enumerate(sources):
        enough = source.groupBy("ws").agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).select("ws")
        kept = source.join(enough, "ws", "left_semi").withColumn("tier", F.lit(n).cast("long"))
        out = kept if out is None else out.unionByName(kept)
    return first_tier(out)


def path_entities(entities: DataFrame, messages: DataFrame, packages: DataFrame, cap: int | None = None) -> DataFrame:
    """Types and functions of the packages that appear in the messages."""
    ends = messages.select("ws", F.explode(F.array("src", "dst")).alias("pkg_id")).distinct()
    top = (entities.where(~F.col("kind").isin("field", "method"))
           .join(ends, ["ws", "pkg_id"], "left_semi")
           .join(packages.select("ws", "pkg_id", "pkg_ord"), ["ws", "pkg_id"]))
    return top_n(top, ["ws"], ["pkg_ord", "pkg_id", "ord"], cap)


def core_tiers(packages: DataFrame, proposals: DataFrame, edges: DataFrame, entries: DataFrame,
               minimum: int = 4, maximum: int | None = None) -> DataFrame:
    """Core packages: all of a small workspace, else valid proposals, else entries and neighbours.

    ``proposals(ws, ord, id)`` may hold unknown and repeated ids.
    """
    sizes = packages.groupBy("ws").agg(F.count("*").alias("_n"))
    small = sizes.where(F.col("_n") < minimum).select("ws")
    all_ids = packages.join(small, "ws", "left_semi").select("ws", F.col("pkg_id").alias("id"), F.lit(0).alias("tier"))
    valid = valid_ids(proposals, packages, maximum)
    enough = valid.groupBy("ws").agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).select("ws")
    proposed = valid.join(enough, "ws", "left_semi").select("ws", "id", F.lit(1).alias("tier"))
    near = neighbours(edges, entries).select("ws", "id", F.lit(2).alias("tier"))
    out = first_tier(all_ids.union(proposed).union(near))
    return out.withColumn("tier", F.col("tier").cast("long"))


def valid_ids(proposals: DataFrame, packages: DataFrame, cap: int | None = None) -> DataFrame:
    """Known ids, each once at its first place, the first ``cap`` of each workspace."""
    seen = proposals.where(F.col("id").isNotNull()).groupBy("ws", "id").agg(F.min("ord").alias("ord"))
    known = packages.select("ws", F.col("pkg_id").alias("id"))
    return top_n(seen.join(known, ["ws", "id"], "left_semi"), ["ws"], ["ord", "id"], cap, rank="pos")


# ----------------------------------------------------------------- traversal

def adjacency(edges: DataFrame, *columns: str) -> DataFrame:
    """Edges written once, bucketed by ``(ws, src)``: a frontier that is dealt out alike meets them where they are."""
    return bucketed(edges.select("ws", "src", "dst", *columns), ["ws", "src"])


def bfs_depths(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distance of every node reachable from ``seeds(ws, id)``; ``max_depth`` ends the walk early.

    Edges move once, before the first level; after that only frontiers do.  Each level is checkpointed,
    so the plan stays short and a lost executor costs one level.
    """
    links = adjacency(edges.select("ws", "src", "dst").distinct())
    level = cut_lineage(seeds.select("ws", "id").distinct().withColumn("depth", F.lit(0).cast("long")))
    seen = level
    for depth in range(1, max_depth + 1) if max_depth else count(1):
        step = (level.select("ws", F.col("id").alias("src")).join(links, ["ws", "src"])
                .select("ws", F.col("dst").alias("id")).distinct()
                .join(seen.select("ws", "id"), ["ws", "id"], "left_anti"))
        level = cut_lineage(step.withColumn("depth", F.lit(depth).cast("long")))
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def bfs_messages(edges: DataFrame, entries: DataFrame, packages: DataFrame,
                 cap: int | None = None, minimum: int = 3) -> DataFrame:
    """The edges met, or the first ``cap`` of them, when each workspace is walked breadth first.

    The walk starts at the entry packages in order, or at all packages by
    in-degree where there is no entry.  Every popped package emits all of its
    edges; a workspace with fewer than ``minimum`` messages yields none.

    A package that emits nothing cannot matter and each other one emits at least
    one edge, so with a ``cap`` as many packages per workspace and level suffice.

    Only packages are walked: a package waits at the number of the first message of its level that names it, and messages are numbered
    from the sums of the edges popped before.  Edges are listed once, at the end, without a sort of them all.
    """
    nth = F.row_number().over(Window.partitionBy("ws", "src").orderBy("edge_ord", "dst"))
    links = bucketed(edges.select("ws", "src", "dst", "edge_ord"), ["ws", "src"], nth=nth)
    outs = bucketed(links.groupBy("ws", F.col("src").alias("id")).agg(F.count("*").alias("degree")), ["ws", "id"])
    packages = cut_lineage(packages.select("ws", F.col("pkg_id").alias("id"), "pkg_ord"))
    entries = cut_lineage(entries.select("ws", "id").distinct())
    by_entry = entries.join(packages, ["ws", "id"]).select("ws", "id", F.lit(0).cast("long").alias("_in"), "pkg_ord")
    rest = packages.join(entries.select("ws").distinct(), "ws", "left_anti")
    cited = (links.join(entries.select("ws").distinct(), "ws", "left_anti")
             .groupBy("ws", F.col("dst").alias("id")).agg(F.count("*").alias("_in")))
    by_degree = rest.join(cited, ["ws", "id"], "left").select("ws", "id", F.coalesce("_in", F.lit(0)).alias("_in"), "pkg_ord")
    seeds = by_entry.union(by_degree).join(outs, ["ws", "id"])
    queue = cut_lineage(top_n(seeds, ["ws"], [F.col("_in").desc(), F.col("pkg_ord"), F.col("id")], cap, rank="at")
                        .select("ws", "id", F.lit(0).cast("long").alias("level"), "at", "degree"))
    popped = queue
    for level in range(1, cap) if cap else count(1):
        found = (messages_before(queue).select("ws", F.col("id").alias("src"), "before").join(links, ["ws", "src"])
                 .groupBy("ws", F.col("dst").alias("id")).agg(F.min(F.col("before") + F.col("nth")).alias("at"))
                 .join(outs, ["ws", "id"])
                 .join(popped.select("ws", "id"), ["ws", "id"], "left_anti"))
        if cap:
            full = popped.groupBy("ws").agg(F.sum("degree").alias("_n")).where(F.col("_n") >= cap).select("ws")
            found = top_n(found.join(full, "ws", "left_anti"), ["ws"], ["at"], cap)
        queue = cut_lineage(found.select("ws", "id", F.lit(level).cast("long").alias("level"), "at", "degree"))
        if queue.isEmpty():
            break
        popped = popped.union(queue)
    told = popped.groupBy("ws").agg(F.sum("degree").alias("_n"))
    enough = told.where((F.least("_n", F.lit(cap)) if cap else F.col("_n")) >= minimum).select("ws")
    listed = (messages_before(popped).join(enough, "ws", "left_semi").select("ws", F.col("id").alias("src"), "before")
              .join(links, ["ws", "src"]).withColumn("msg_ord", F.col("before") + F.col("nth")))
    return (listed.where(F.col("msg_ord") <= cap) if cap else listed).select("ws", "msg_ord", "src", "dst", "edge_ord")


#: Waiting packages are summed up in spans of so many places (two to that power).
SPAN_BITS = 16


def messages_before(queue: DataFrame) -> DataFrame:
    """``queue(ws, id, level, at, degree)`` with ``before``, how many edges those have that are popped before, by level and place.

    No workspace passes through one task: a window sums up a span of places, another one the spans' sums.
    """
    keys = ["ws", "level", "_span"]
    spans = queue.withColumn("_span", F.shiftright("at", SPAN_BITS))
    earlier = Window.partitionBy("ws").orderBy("level", "_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.groupBy(*keys).agg(F.sum("degree").alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = spans.withColumn("_in", F.coalesce(F.sum("degree").over(inside), F.lit(0)))
    return own.join(sums, keys).withColumn("before", F.col("_earlier") + F.col("_in")).select(*queue.columns, "before")


def reference_messages(edges: DataFrame, packages: DataFrame, cap: int | None = None, minimum: int = 3) -> DataFrame:
    """Reference edges in package order, all or the first ``cap`` of each workspace."""
    order = packages.select("ws", F.col("pkg_id").alias("src"), "pkg_ord")
    listed = top_n(edges.join(order, ["ws", "src"]), ["ws"], ["pkg_ord", "src", "edge_ord", "dst"], cap, rank="msg_ord")
    enough = listed.groupBy("ws").agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).select("ws")
    return listed.join(enough, "ws", "left_semi").select("ws", "msg_ord", "src", "dst")


def node_metadata(messages: DataFrame, packages: DataFrame, entities: DataFrame) -> DataFrame:
    """Role, degrees and path of every listed node.

    The path is the first entry file, else the first file with an entity, else
    the package directory.
    """
    met = roles(messages.select("ws", "src", "dst"))
    return met.join(node_paths(packages, entities), ["ws", "id"], "left").select(
        "ws", "id", "role", "cited_by", "cites", F.coalesce("path", F.lit("")).alias("path"))


def node_paths(packages: DataFrame, entities: DataFrame) -> DataFrame:
    """``(ws, id, path)``: the first entry file, else the first file with an entity, else the package directory."""
    files = (entities.where(F.col("file") != "").groupBy("ws", F.col("pkg_id").alias("id"))
             .agg(F.min(F.struct("ord", "file")).alias("_f")))
    own = packages.select("ws", F.col("pkg_id").alias("id"), F.get("entry_files", F.lit(0)).alias("_e"), "path")
    return own.join(files, ["ws", "id"], "full_outer").select("ws", "id", F.coalesce("_e", P.norm_path(F.col("_f.file")), "path").alias("path"))
