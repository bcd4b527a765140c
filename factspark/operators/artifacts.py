"""Versioned ledger of derived artifacts.

``ledger(ws, name, kind, lang, v, deps, requires, payload)``.  ``deps`` NULL means
"depends on every package", an empty array "on nothing".  ``v = 0`` marks a
tombstone, ``v`` NULL a row from before versions existed.  The ledger is
append-only: invalidation produces the next state, older payloads stay readable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.functions.text import target_key_endpoints

# Drill-down kinds and the family they die with.
DRILL_PARENT = {"seq-edge": "sequence", "flow-subgraph": "flow", "overview": "overview"}
# Kinds that belong to users or to the system itself.
ASSET_KINDS = ["draw"]
SYSTEM_KINDS = ["graph", "manifest", "index", "stats", "progress"]
# Figure kinds in their rebuild order.
FIGURE_KINDS = ["duties", "concepts", "core", "seq", "flow-event", "flow-pipeline", "interaction"]
# Kinds whose content each chapter consumes.
CHAPTER_REQUIRES = {
    "concepts": ["concepts"],
    "seq": ["seq"],
    "flow": ["flow-event", "flow-pipeline", "seq"],
    "interaction": ["interaction", "seq"],
    "deps": ["core"],
    "er": ["core", "seq"],
    "catalog": ["core"],
}
# Chapters that cannot exist without their figure.
FIGURE_DRIVEN = ["concepts", "seq", "flow", "interaction"]


KIND = "kind string, role string, parent string, figure_ord long, deps_rule string, requires array<string>"
# Which packages a figure of a kind depends on.
DEPS_RULES = {"seq": "endpoints", "interaction": "parties", "core": "ids", "duties": "keys", "flow-event": "none if from a document",
              "flow-pipeline": "none if from a document"}


def kind_table(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """The registry of artifact kinds, one row a kind: role (entity, drill, asset, system), the family that a drill-down falls with (its own
    kind: always), place among the figures to rebuild, rule of its dependencies, and the kinds it consumes.

    ``more`` are further rows, which replace those of the same kind.  What is not listed is an entity that depends on what it records.
    """
    rows = {k: [k, "drill", family, None, None, None] for k, family in DRILL_PARENT.items()}
    for role, kinds in (("asset", ASSET_KINDS), ("system", SYSTEM_KINDS), ("entity", FIGURE_KINDS), ("entity", [f"doc-{k}" for k in CHAPTER_REQUIRES])):
        rows.update({k: [k, role, None, None, None, None] for k in kinds})
    for at, kind in enumerate(FIGURE_KINDS):
        rows[kind][3:5] = at, DEPS_RULES.get(kind)
    for chapter, needs in CHAPTER_REQUIRES.items():
        rows[f"doc-{chapter}"][5] = needs
    rows.update({r[0]: list(r) for r in more})
    return spark.createDataFrame([tuple(r) for r in rows.values()], KIND)


def _kinds(df: DataFrame, kinds: DataFrame | None) -> DataFrame:
    return kind_table(df.sparkSession) if kinds is None else kinds


def _lasting(kinds: DataFrame) -> DataFrame:
    """Kinds that belong to users or to the system."""
    return kinds.where(F.col("role").isin("asset", "system")).select("kind")


def with_requires(rows: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Artifacts about to be written, with the kinds that their own consumes as ``requires``."""
    known = _kinds(rows, kinds).select("kind", F.coalesce("requires", F.array().cast("array<string>")).alias("requires"))
    return rows.drop("requires").join(known, "kind", "left")


def facts_version(snapshots: DataFrame) -> DataFrame:
    """Newest facts version per workspace; 0 while nothing is known."""
    return snapshots.groupBy("ws").agg(F.coalesce(F.max("generated_at"), F.lit(0)).cast("long").alias("facts_v"))


def writable(rows: DataFrame) -> DataFrame:
    """Rows that may be stored: a known version, distinct deps and requires."""
    return (rows.where(F.col("v") > 0)
            .withColumn("deps", F.array_distinct("deps")).withColumn("requires", F.array_distinct("requires")))


def current(ledger: DataFrame, versions: DataFrame) -> DataFrame:
    """Artifacts that may be served: written for the current, known facts version."""
    now = versions.where(F.col("facts_v") > 0).select("ws", F.col("facts_v").alias("v"))
    return ledger.where(F.trim(F.col("payload")) != "").join(now, ["ws", "v"], "left_semi")


def valid_index(index_rows: DataFrame, versions: DataFrame, language: Column) -> DataFrame:
    """Stored indexes of the current version and language that hold packages."""
    now = versions.where(F.col("facts_v") > 0).select("ws", F.col("facts_v").alias("v"))
    ok = (F.col("language") == language) & (F.col("n_packages") > 0)
    return index_rows.where(ok).join(now, ["ws", "v"], "left_semi")


def stale_priors(ledger: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest readable older payload per artifact, as a draft to revise."""
    old = (ledger.join(versions, "ws")
           .where((F.col("facts_v") > 0) & (F.col("v") > 0) & (F.col("v") != F.col("facts_v")) & F.col("payload").isNotNull()))
    return (old.groupBy("ws", "name").agg(F.max(F.struct("v", "payload")).alias("_p"))
            .select("ws", "name", F.col("_p.v").alias("v"), F.col("_p.payload").alias("payload")))


def _touched(ledger: DataFrame, changed: DataFrame) -> DataFrame:
    """Keys of artifacts with at least one changed dependency."""
    return (ledger.select("ws", "name", F.explode("deps").alias("id"))
            .join(changed.select("ws", "id"), ["ws", "id"], "left_semi").select("ws", "name").distinct())


def _stamped(rows: DataFrame, hit: Column, version: Column) -> DataFrame:
    blank = F.lit(None)
    return (rows.withColumn("action", F.when(hit, "invalidated").otherwise("restamped"))
            .withColumn("v", F.when(hit, F.lit(0)).otherwise(version).cast("long"))
            .withColumn("deps", F.when(hit, blank).otherwise(F.col("deps")))
            .withColumn("requires", F.when(hit, blank).otherwise(F.col("requires")))
            .withColumn("payload", F.when(hit, blank).otherwise(F.col("payload"))))


def invalidate(ledger: DataFrame, changed: DataFrame, new_version: Column, kinds: DataFrame | None = None) -> DataFrame:
    """Next ledger state after the packages ``changed(ws, id)`` moved.

    Entity artifacts fall when a dependency changed or none is recorded; drill-downs
    also fall with their family, and overviews always.  All others are restamped
    (``requires`` is kept, so later cascades still reach them).  Assets, system rows
    and unversioned entity rows stay as they are.  Dependency overlap is one
    exploded semi-join for both passes.  ``kinds`` is the registry that says which kind is what.
    """
    roles = _kinds(ledger, kinds).select("kind", F.col("role").alias("_role"), F.col("parent").alias("_parent"))
    touched = _touched(ledger, changed).withColumn("_dep", F.lit(True))
    flagged = ledger.join(touched, ["ws", "name"], "left").join(roles, "kind", "left").withColumn(
        "_own", F.col("deps").isNull() | F.coalesce("_dep", F.lit(False))).drop("_dep")
    drill = F.coalesce(F.col("_role") == "drill", F.lit(False))
    fixed = F.coalesce(F.col("_role").isin("asset", "system"), F.lit(False)) | (F.col("v").isNull() & ~drill)
    entity = flagged.where(~fixed & ~drill)
    fallen = entity.where("_own").select("ws", F.col("kind").alias("_parent")).distinct()
    first = _stamped(entity, F.col("_own"), new_version).drop("_parent")
    under = flagged.where(drill).join(fallen.withColumn("_fell", F.lit(True)), ["ws", "_parent"], "left")
    hit = F.col("_own") | F.coalesce(F.col("_parent") == F.col("kind"), F.lit(False)) | F.col("v").isNull() | F.coalesce("_fell", F.lit(False))
    second = _stamped(under, hit, new_version).drop("_parent", "_fell")
    kept = flagged.where(fixed).withColumn("action", F.lit("kept")).drop("_parent")
    order = [*ledger.columns, "action"]
    return first.select(*order).unionByName(second.select(*order)).unionByName(kept.select(*order))


def cascade_requires(ledger: DataFrame, rewritten: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Artifacts to tombstone because they consumed a rewritten kind ``(ws, kind)``."""
    node = rewritten.select("ws", F.col("kind").alias("_r")).distinct()
    live = ledger.where(F.col("v") > 0).join(_lasting(_kinds(ledger, kinds)), "kind", "left_anti")
    return (live.select("ws", "name", "kind", F.explode("requires").alias("_r"))
            .join(node, ["ws", "_r"], "left_semi").select("ws", "name", "kind").distinct())


def sweep(ledger: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Drop unversioned leftovers; tombstones, assets and system rows stay."""
    lasting = _lasting(_kinds(ledger, kinds)).withColumn("_lasting", F.lit(True))
    return ledger.join(lasting, "kind", "left").where(F.col("v").isNotNull() | F.col("_lasting")).select(*ledger.columns)


def swept(ledger: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """The leftovers that ``sweep`` drops."""
    return ledger.where(F.col("v").isNull()).join(_lasting(_kinds(ledger, kinds)), "kind", "left_anti").select("ws", "name")


def figure_deps(kind: Column, source: Column, endpoints: Column, parties: Column, ids: Column, keys: Column) -> Column:
    """Packages an artifact depends on, by the rule of its kind; NULL = all of them."""
    rule = F.create_map(*[F.lit(x) for pair in DEPS_RULES.items() for x in pair])[kind]
    return deps_by_rule(rule, source, endpoints, parties, ids, keys)


def deps_by_rule(rule: Column, source: Column, endpoints: Column, parties: Column, ids: Column, keys: Column) -> Column:
    """Packages an artifact depends on, by a ``deps_rule`` of the registry; NULL = all of them, as where there is no rule."""
    everything = F.lit(None).cast("array<string>")

    def listed(names: Column) -> Column:
        real = F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))
        return F.when(F.size(real) > 0, real).otherwise(everything)
    return (F.when((rule == "none if from a document") & (source == "doc"), F.array().cast("array<string>"))
            .when(rule == "endpoints", listed(endpoints))
            .when(rule == "parties", listed(parties))
            .when(rule == "ids", F.filter(ids, lambda n: n.isNotNull()))
            .when(rule == "keys", keys)
            .otherwise(everything))


def drill_deps(drills: DataFrame, ledger: DataFrame) -> DataFrame:
    """Packages a drill-down depends on; NULL = all.

    ``drills(ws, name, kind, target_key, parent)``: an edge takes its endpoints,
    a subgraph the deps of its parent artifact.
    """
    parents = ledger.select("ws", F.col("name").alias("parent"), F.col("deps").alias("_pdeps"))
    ends = target_key_endpoints(F.col("target_key"))
    return (drills.join(parents, ["ws", "parent"], "left").withColumn(
        "deps", F.when((F.col("kind") == "seq-edge") & (F.size(ends) > 0), ends)
        .when(F.col("kind") == "flow-subgraph", F.col("_pdeps"))).drop("_pdeps"))


def rebuild_plan(ledger: DataFrame, versions: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """``(ws, kind, ord, state)``: skip a figure kind that has a current artifact, rebuild the rest."""
    figures = _kinds(ledger, kinds).where("figure_ord IS NOT NULL").orderBy("figure_ord").select("kind").collect()  # one row a kind
    specs = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(r.kind).alias("kind")) for i, r in enumerate(figures)])
    wanted = versions.select("ws", "facts_v", F.explode(specs).alias("s")).select("ws", "facts_v", "s.*")
    have = ledger.where(F.col("v") > 0).select("ws", "kind", F.col("v").alias("facts_v")).distinct() \
        .withColumn("_ok", F.lit(True))
    return (wanted.join(have, ["ws", "kind", "facts_v"], "left")
            .select("ws", "kind", "ord", F.when(F.col("_ok"), "skipped").otherwise("rebuild").alias("state")))


def chapter_scopes(messages: DataFrame, events: DataFrame, core: DataFrame, entities: DataFrame,
                   workspaces: DataFrame) -> DataFrame:
    """Packages each chapter's facts touch ``(ws, chapter, id)``; ``id`` NULL = all.

    ``messages(ws, src, dst)``, ``events(ws, producers, consumers)``, ``core(ws, id)``,
    ``entities(ws, pkg_id)`` already limited to the listed ones.
    """
    path = messages.select("ws", F.explode(F.array("src", "dst")).alias("id"))
    party = events.select("ws", F.explode(F.concat("producers", "consumers")).alias("id"))
    listed = entities.select("ws", F.col("pkg_id").alias("id"))

    def scope(chapter: str, *parts: DataFrame) -> DataFrame:
        out = parts[0].select("ws", "id")
        for part in parts[1:]:
            out = out.union(part.select("ws", "id"))
        return out.where(F.col("id") != "").select("ws", F.lit(chapter).alias("chapter"), "id")
    some = (scope("seq", path).union(scope("interaction", party, path)).union(scope("deps", core))
            .union(scope("er", listed, core, path))).distinct()
    chapters = F.array(*[F.lit(c) for c in CHAPTER_REQUIRES])
    whole = workspaces.select("ws", F.explode(chapters).alias("chapter")).distinct() \
        .join(some.select("ws", "chapter").distinct(), ["ws", "chapter"], "left_anti")
    return some.union(whole.select("ws", "chapter", F.lit(None).cast("string").alias("id")))


def chapter_plan(ledger: DataFrame, versions: DataFrame, clean_explains: DataFrame) -> DataFrame:
    """State of every chapter of every workspace.

    Ledger kinds: ``doc-<chapter>``, ``explain-<chapter>`` and the figure kinds;
    ``clean_explains(ws, chapter)`` are explains without violations.
    """
    needs = F.array(*[F.struct(F.lit(c).alias("chapter"), F.lit(r[0]).alias("figure")) for c, r in CHAPTER_REQUIRES.items()])
    rows = versions.select("ws", F.explode(needs).alias("n")).select("ws", "n.*")
    live = current(ledger, versions).select("ws", "kind").distinct()
    old = (ledger.join(versions, "ws").where((F.col("v") > 0) & (F.col("v") != F.col("facts_v")) & F.col("payload").isNotNull())
           .select("ws", "kind").distinct())

    def mark(src: DataFrame, prefix: str, name: str, key: str = "chapter") -> DataFrame:
        hit = src.where(F.startswith("kind", F.lit(prefix))) if prefix else src
        return hit.select("ws", F.substring(F.col("kind"), F.lit(len(prefix) + 1), F.length("kind")).alias(key),
                          F.lit(True).alias(name)).distinct()
    explain = mark(live, "explain-", "_explain").join(clean_explains.select("ws", "chapter").distinct(), ["ws", "chapter"], "left_semi")
    out = (rows.join(mark(live, "doc-", "_doc"), ["ws", "chapter"], "left")
           .join(explain, ["ws", "chapter"], "left")
           .join(mark(live, "", "_figure", "figure"), ["ws", "figure"], "left")
           .join(mark(old, "doc-", "_prior"), ["ws", "chapter"], "left"))
    state = (F.when(F.col("_doc"), "fresh").when(F.col("_explain"), "from-explain")
             .when(F.col("chapter").isin(FIGURE_DRIVEN) & F.col("_figure").isNull(), "missing-figure")
             .when(F.col("_prior"), "stale-prior").otherwise("generate"))
    return out.select("ws", "chapter", state.alias("state"))
