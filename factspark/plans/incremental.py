"""Call graph of many workspaces, kept up to date by signed changes.

State: the calls of every file, calls per edge and symbol, edges, degrees.  After an edit the calls of changed files leave with -1
and those extracted anew enter with +1; what cancels out is dropped from the sums.  Sums are merged, and only edges that
have calls which go or come are computed again, from the calls of those edges alone.  Nothing else is extracted or recomputed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.operators.graph import EDGE, degrees, keyed_edges, text_key
from factspark.operators.snapshot import real_changes
from factspark.session import cut_lineage

CALL = ["ws", "file", "ord", "src", "dst", "sym"]
FILE = ["ws", "file"]


@dataclass
class GraphState:
    """``calls(ws, file, ord, src, dst, sym)``, ``counts(ws, src, dst, sym, n)``, ``edges`` as ``keyed_edges`` gives them, ``degrees``."""

    calls: DataFrame
    counts: DataFrame
    edges: DataFrame
    degrees: DataFrame

    def kept(self) -> "GraphState":
        """The state with its lineage cut: the next change starts from what is written."""
        return GraphState(**{f.name: cut_lineage(getattr(self, f.name)) for f in fields(self)})


def graph_state(calls: DataFrame) -> GraphState:
    """The state of a whole set of calls, computed in full."""
    rows = calls.select(*CALL)
    edges = keyed_edges(rows.withColumn("key", text_key(*EDGE)))
    return GraphState(rows, rows.groupBy(*EDGE, "sym").agg(F.count("*").alias("n")), edges, degrees(edges))


def changed_files(diff: DataFrame) -> DataFrame:
    """``(key, ws, file)`` of the files that a snapshot diff adds, modifies or removes; ``key`` is a number that joins sort by."""
    files = real_changes(diff).select("ws", F.col("path").alias("file"))
    return files.select(text_key(*FILE).alias("key"), *FILE).distinct()


def signed_calls(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Calls of the changed files with ``sign`` -1 (gone) or +1 (new); repeated ones have their number.  Calls that stay are not listed."""
    old = gone.select(*CALL, F.lit(-1).cast("long").alias("sign"))
    both = old.unionByName(new.select(*CALL, F.lit(1).cast("long").alias("sign")))
    return both.groupBy(*CALL).agg(F.sum("sign").alias("sign")).where("sign <> 0")


def merged_counts(counts: DataFrame, delta: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts with a difference added; rows whose values are all zero are dropped."""
    moved = delta.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    both = counts.join(moved, keys, "full_outer")
    sums = {v: F.coalesce(v, F.lit(0)) + F.coalesce(f"_{v}", F.lit(0)) for v in values}
    some = F.greatest(*[F.abs(F.col(v)) for v in values], F.lit(0)) > 0
    return both.select(*keys, *[s.cast("long").alias(v) for v, s in sums.items()]).where(some)


def edge_ends(edges: DataFrame, sign: int) -> DataFrame:
    """Degrees that distinct edges add or take."""
    found = degrees(edges)
    return found.select("ws", "id", (F.col("cited_by") * sign).alias("cited_by"), (F.col("cites") * sign).alias("cites"))


def updated(state: GraphState, diff: DataFrame, calls_of_files: Callable[[DataFrame], DataFrame]) -> GraphState:
    """The state after the files of ``diff(ws, path, change)`` changed.

    ``calls_of_files(files)`` extracts and resolves the calls of ``files(ws, file)``, which are the changed files only; removed
    files are among them and give none.  Resolution may look at a file and at the packages; when packages come or go, files
    that name them count as changed.  ``diff`` is read for it and for the calls that go, and may name a file more than once.
    """
    changed = changed_files(diff)
    after = cut_lineage(calls_of_files(changed.select(*FILE)).select(*CALL))
    # One join tells which calls go; the difference and the calls that stay both read its result.
    placed = state.calls.select(*CALL).withColumn("key", text_key(*FILE)).join(changed.withColumn("_gone", F.lit(True)), ["key", *FILE], "left")
    placed = cut_lineage(placed.drop("key"))
    gone = placed.where("_gone").select(*CALL)
    calls = placed.where("_gone IS NULL").select(*CALL).unionByName(after)

    per_symbol = signed_calls(gone, after).groupBy(*EDGE, "sym").agg(F.sum("sign").alias("n"))
    counts = merged_counts(state.counts, per_symbol, [*EDGE, "sym"], ["n"])
    # Touched edges are told by their number alone.  Should two edges share one, both leave and both are computed again.
    touched = gone.unionByName(after).select(text_key(*EDGE).alias("key")).distinct()
    # First places and symbol order cannot be taken back from sums: those of touched edges come from their calls.
    # Not written here: degrees need their ends alone.
    again = keyed_edges(calls.withColumn("key", text_key(*EDGE)).join(touched, "key", "left_semi"))
    was = state.edges.join(touched, "key", "left_semi")
    edges = state.edges.join(touched, "key", "left_anti").unionByName(again)
    moved = edge_ends(again, 1).unionByName(edge_ends(was, -1)).groupBy("ws", "id").agg(F.sum("cited_by").alias("cited_by"), F.sum("cites").alias("cites"))
    return GraphState(calls, counts, edges, merged_counts(state.degrees, moved, ["ws", "id"], ["cited_by", "cites"]))


def node_rows(state: GraphState, packages: DataFrame, entities: DataFrame) -> DataFrame:
    """Role, degrees and path of every node, from the degrees kept rather than from the edges."""
    from factspark.operators.graph import node_paths, role_of
    met = state.degrees.withColumn("role", role_of())
    return met.join(node_paths(packages, entities), ["ws", "id"], "left").select(
        "ws", "id", "role", "cited_by", "cites", F.coalesce("path", F.lit("")).alias("path"))
