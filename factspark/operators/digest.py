"""Text summaries of workspace facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.operators.ranking import top_n


def _listed(rows: DataFrame, keys: list[str], value: str, order: list[str], cap: int | None, name: str) -> DataFrame:
    kept = top_n(rows, keys, order, cap)
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["_v"]), ", ").alias(name))


def package_lines(packages: DataFrame, entities: DataFrame, deps: DataFrame, max_packages: int | None = None,
                  max_entities: int | None = None, max_deps: int | None = None) -> DataFrame:
    """One line per package: its language, first dependencies and first entities.

    ``packages(ws, pkg_id, pkg_ord, language)``, ``entities(ws, pkg_id, ord, name, kind)``,
    ``deps(ws, pkg_id, ord, dep)``.  Lists are as long as a package's
    own entities and dependencies; bounds cut them before they are collected.
    """
    shown = top_n(packages, ["ws"], ["pkg_ord", "pkg_id"], max_packages, rank="pos")
    tops = entities.where(~F.col("kind").isin("method", "field")).join(shown, ["ws", "pkg_id"], "left_semi")
    named = _listed(tops, ["ws", "pkg_id"], "name", ["ord", "name"], max_entities, "_e")
    needs = _listed(deps.join(shown, ["ws", "pkg_id"], "left_semi"), ["ws", "pkg_id"], "dep", ["ord", "dep"], max_deps, "_d")
    none = F.lit("none")
    line = F.concat(F.lit("- "), F.col("pkg_id"), F.lit(" ("), F.col("language"), F.lit("); deps: "), F.coalesce("_d", none),
                    F.lit("; entities: "), F.coalesce("_e", none))
    return (shown.join(named, ["ws", "pkg_id"], "left").join(needs, ["ws", "pkg_id"], "left")
            .select("ws", "pos", line.alias("line")))


def workspace_digest(lines: DataFrame) -> DataFrame:
    """The package lines of each workspace as one text; for large workspaces keep the lines as rows."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("ws").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("digest"))
