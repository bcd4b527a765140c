"""Where the packages of a workspace are.

Everything is derived from the file listing ``files(ws, path)``: directories are
path prefixes, so no directory walk is needed and each rule is an aggregation or
an equi-join.  Paths are relative to the workspace; its root directory is ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.functions import manifests as MF
from factspark.functions import paths as P
from factspark.functions.text import first_nonblank, first_paragraph
from factspark.session import cut_lineage

NAME = P.basename


def depth_of(directory: Column) -> Column:
    return F.when(directory == "", F.lit(0)).otherwise(F.size(F.split(directory, "/")))


def _child(directory: Column, path: Column) -> Column:
    """``path`` relative to a directory that encloses it."""
    return F.when(directory == "", path).otherwise(F.substring(path, F.length(directory) + 2, F.length(path)))


def _under(path: Column, n: Column) -> Column:
    return F.get(F.split(path, "/"), n)


def detect_language(files: DataFrame) -> DataFrame:
    """Primary language of each workspace by its root manifests, ``unknown`` without any."""
    rank = F.lit(None).cast("int")
    for i, lang in reversed(list(enumerate(P.LANGUAGE_PRIORITY))):
        rank = F.when(F.col("path").isin(P.MANIFEST_FILES[lang]), F.lit(i)).otherwise(rank)
    names = F.array(*[F.lit(x) for x in P.LANGUAGE_PRIORITY])
    return files.groupBy("ws").agg(F.min(rank).alias("_r")).select(
        "ws", F.coalesce(F.get(names, F.col("_r")), F.lit("unknown")).alias("language"))


def manifest_dirs(files: DataFrame, manifests: list[str], max_depth: int | None = None) -> DataFrame:
    """All directories ``(ws, dir)`` that own a manifest, nested ones included."""
    found = (files.where(NAME(F.col("path")).isin(manifests) & ~P.in_skipped_dir(F.col("path"), P.INDEX_SKIP_DIRS))
             .select("ws", P.dirname(F.col("path")).alias("dir")).distinct())
    return found if max_depth is None else found.where(depth_of(F.col("dir")) <= max_depth)


def topmost(dirs: DataFrame) -> DataFrame:
    """Directories that are not below another one of the set."""
    above = dirs.select("ws", "dir", F.explode(F.array_union(F.array(F.lit("")), P.ancestor_dirs(F.col("dir")))).alias("_up")) \
        .where(F.col("_up") != F.col("dir"))
    inner = above.join(dirs.select("ws", F.col("dir").alias("_up")), ["ws", "_up"], "left_semi").select("ws", "dir").distinct()
    return dirs.join(inner, ["ws", "dir"], "left_anti")


def package_roots(files: DataFrame, languages: DataFrame) -> DataFrame:
    """Package roots ``(ws, dir)`` by the rule of each workspace's language."""
    by_lang = files.join(languages, "ws")
    ts = by_lang.where(F.col("language") == "typescript")
    flat_or_group = (ts.where(F.col("path").rlike(r"^packages/[^/]+(/[^/]+)?/package\.json$"))
                     .select("ws", P.dirname(F.col("path")).alias("dir")).distinct())
    listed = topmost(flat_or_group)
    src = ts.where(F.startswith("path", F.lit("src/"))).select("ws").distinct()
    single = src.join(listed.select("ws").distinct(), "ws", "left_anti").select("ws", F.lit("").alias("dir"))
    rest = None
    for lang in ("python", "java"):
        own = topmost(manifest_dirs(by_lang.where(F.col("language") == lang), P.MANIFEST_FILES[lang]))
        rest = own if rest is None else rest.unionByName(own)
    return listed.unionByName(single).unionByName(rest)


def short_id(directory: Column, ws: Column) -> Column:
    return F.when(directory == "", NAME(ws)).otherwise(NAME(directory))


def root_fallback(workspaces: DataFrame, recognised: DataFrame) -> DataFrame:
    """One root node for every workspace in which nothing was recognised."""
    return (workspaces.select("ws").distinct().join(recognised.select("ws").distinct(), "ws", "left_anti")
            .select("ws", NAME(F.col("ws")).alias("id"), F.lit("").alias("dir")))


def typescript_packages(files: DataFrame, scope: str = "") -> DataFrame:
    """Packages of the ``packages/`` layout with group, blurb and scoped peer dependencies.

    ``files(ws, path, content)``; ``scope`` is the name prefix of workspace packages.
    A workspace without any gets its root package.  A peer dependency counts when
    it carries the scope, which is then removed.
    """
    meta = files.where(F.col("path").rlike(r"^(packages/[^/]+/([^/]+/)?)?package\.json$")).select(
        "ws", P.dirname(F.col("path")).alias("dir"), "content")
    listed = meta.where(F.col("dir") != "")
    listed = listed.join(topmost(listed.select("ws", "dir").distinct()), ["ws", "dir"], "left_semi")
    named = lambda d: d.withColumn("name", F.get_json_object("content", "$.name")).where(F.col("name") != "")
    listed = named(listed)
    root = named(meta.where(F.col("dir") == "")).join(listed.select("ws").distinct(), "ws", "left_anti")
    notes = lambda n, c: files.where(F.endswith("path", F.lit(n))).where(NAME(F.col("path")) == n).select(
        "ws", P.dirname(F.col("path")).alias("dir"), first_paragraph(F.col("content")).alias(c))
    cut = (lambda c: F.when(F.startswith(c, F.lit(scope)), F.substring(c, F.lit(len(scope) + 1), F.length(c))).otherwise(c)) if scope else (lambda c: c)
    peers = F.filter(MF.json_keys(F.col("content"), "peerDependencies"), lambda k: F.startswith(k, F.lit(scope)))
    return (listed.unionByName(root).join(notes("README.md", "_en"), ["ws", "dir"], "left")
            .join(notes("README.zh.md", "blurb_zh"), ["ws", "dir"], "left")
            .select("ws", cut(F.col("name")).alias("id"), "dir",
                    F.when(F.size(F.split("dir", "/")) == 3, _under(F.col("dir"), F.lit(1))).otherwise("").alias("grp"),
                    first_nonblank(F.trim(F.get_json_object("content", "$.description")), F.col("_en")).alias("blurb"),
                    F.coalesce("blurb_zh", F.lit("")).alias("blurb_zh"), F.transform(peers, cut).alias("deps")))


def _levels_below(files: DataFrame, dirs: DataFrame, suffix: str, levels: int) -> DataFrame:
    """Directories with a file of this suffix at most ``levels`` directories down."""
    src = files.where(F.endswith("path", F.lit(suffix)) & ~P.in_skipped_dir(F.col("path"), P.INDEX_SKIP_DIRS))
    own = src.select("ws", P.dirname(F.col("path")).alias("_d")).distinct()
    near = own.select("ws", "_d", F.explode(F.array_union(F.array(F.lit("")), P.ancestor_dirs(F.col("_d")))).alias("dir")) \
        .where(depth_of(F.col("_d")) - depth_of(F.col("dir")) <= levels)
    return dirs.join(near.select("ws", "dir").distinct(), ["ws", "dir"], "left_semi")


def python_units(files: DataFrame) -> DataFrame:
    """Python units ``(ws, dir)``.

    Several distributions with code: one unit each.  A single one at the root:
    its import packages when there are at least two, else the import packages
    inside the only one, else the root itself.
    """
    # Both tables are small (directories, not files) and feed many branches below.
    dists = cut_lineage(manifest_dirs(files, P.MANIFEST_FILES["python"]))
    coded = cut_lineage(_levels_below(files, dists, ".py", 2))
    shape = coded.groupBy("ws").agg(F.count("*").alias("n"), F.max(F.col("dir") == "").alias("root"))
    many = coded.join(shape.where((F.col("n") >= 2) | ~F.col("root")).select("ws"), "ws", "left_semi")
    single = dists.select("ws").distinct().join(many.select("ws").distinct(), "ws", "left_anti")
    lone = shape.where((F.col("n") == 1) & F.col("root")).select("ws")
    py = files.where(F.endswith("path", F.lit(".py")) & ~P.in_skipped_dir(F.col("path"), P.INDEX_SKIP_DIRS)) \
        .join(lone, "ws", "left_semi")
    has_src = files.where(F.startswith("path", F.lit("src/"))).select("ws").distinct().withColumn("_src", F.lit("src"))
    placed = py.join(has_src, "ws", "left").withColumn("_base", F.coalesce("_src", F.lit(""))) \
        .where((F.col("_base") == "") | F.startswith("path", F.lit("src/"))) \
        .withColumn("_rel", F.split(_child(F.col("_base"), F.col("path")), "/"))
    prefix = F.when(F.col("_base") == "", F.lit("")).otherwise("src/")
    tops = cut_lineage(placed.where(F.size("_rel").between(2, 4)).select(
        "ws", F.concat(prefix, F.get("_rel", F.lit(0))).alias("_top"),
        F.when(F.size("_rel") > 2, F.concat(prefix, F.array_join(F.slice("_rel", 1, 2), "/"))).alias("_inner"),
        (F.size("_rel") < 4).alias("_near")).distinct())
    one = tops.where("_near").select("ws", F.col("_top").alias("dir")).distinct()
    two = tops.where(F.col("_inner").isNotNull() & ~F.endswith("_inner", F.lit("/__pycache__"))).select(
        "ws", "_top", F.col("_inner").alias("dir")).distinct()
    n_one = one.groupBy("ws").agg(F.count("*").alias("n"))
    wide = one.join(n_one.where(F.col("n") >= 2).select("ws"), "ws", "left_semi")
    narrow = one.join(n_one.where(F.col("n") == 1).select("ws"), "ws", "left_semi").withColumnRenamed("dir", "_top")
    inner = two.join(narrow, ["ws", "_top"], "left_semi").select("ws", "dir")
    split_ws = inner.groupBy("ws").agg(F.count("*").alias("n")).where(F.col("n") >= 2).select("ws")
    deep = inner.join(split_ws, "ws", "left_semi")
    split = wide.unionByName(deep)
    whole = single.join(split.select("ws").distinct(), "ws", "left_anti").select("ws", F.lit("").alias("dir"))
    return many.unionByName(split).unionByName(whole)


SOURCES = "src/main/java"


def java_units(files: DataFrame) -> DataFrame:
    """Java units ``(ws, id, dir, kind)``; ``files(ws, path, content)``.

    Several modules: one unit each.  One module: its layers below the application
    root, plus an entry unit for classes directly in it.  The application root is
    the directory of the main class, else the deepest directory common to all
    sources, found as the common prefix of the smallest and the largest path.
    """
    java = files.where(F.endswith("path", F.lit(".java")))
    inside = java.where(F.col("path").rlike(rf"(^|/){SOURCES}/")).withColumn(
        "module", F.regexp_replace(F.regexp_replace("path", rf"{SOURCES}/.*$", ""), "/$", ""))
    poms = manifest_dirs(files, ["pom.xml"])
    with_pom = poms.select("ws").distinct()
    mods = inside.select("ws", F.col("module").alias("dir")).distinct()
    by_pom = mods.join(poms, ["ws", "dir"], "left_semi")
    by_tree = mods.join(with_pom, "ws", "left_anti").where(depth_of(F.col("dir")) <= 2)
    modules = cut_lineage(by_pom.unionByName(by_tree))
    counts = modules.groupBy("ws").agg(F.count("*").alias("n"))
    several = modules.join(counts.where(F.col("n") >= 2).select("ws"), "ws", "left_semi") \
        .select("ws", short_id(F.col("dir"), F.col("ws")).alias("id"), "dir", F.lit("module").alias("kind"))
    only = modules.join(counts.where(F.col("n") == 1).select("ws"), "ws", "left_semi")
    src = inside.join(only.withColumnRenamed("dir", "module"), ["ws", "module"], "left_semi").withColumn(
        "rel", F.regexp_extract("path", rf"(?:^|/){SOURCES}/(.*)$", 1)).withColumn("rdir", P.dirname(F.col("rel")))
    is_main = F.contains("content", F.lit("@SpringBootApplication"))
    named = F.when(F.col("rel").rlike(P.JAVA_ENTRY_NAME), 0).otherwise(1)
    span = src.groupBy("ws", "module").agg(
        F.min(F.when(is_main, F.struct(named.alias("n"), F.col("rel"), F.col("rdir")))).alias("main"),
        F.min(F.split("rdir", "/")).alias("lo"), F.max(F.split("rdir", "/")).alias("hi"))
    same = F.transform(F.arrays_zip("lo", "hi"), lambda z: F.coalesce(z["lo"] == z["hi"], F.lit(False)))
    stop = F.array_position(same, F.lit(False)).cast("int")
    common = F.array_join(F.when(stop > 0, F.slice("lo", F.lit(1), stop - 1)).otherwise(F.col("lo")), "/")
    root = cut_lineage(span.select("ws", "module", F.coalesce("main.rdir", common).alias("root")))
    placed = src.join(root, ["ws", "module"])
    below = F.when(F.col("root") == "", F.col("rel")).when(
        F.startswith("rel", F.concat("root", F.lit("/"))), F.substring(F.col("rel"), F.length("root") + 2, F.length("rel")))
    placed = placed.withColumn("_p", F.split(below, "/")).where(F.col("_p").isNotNull())
    placed = cut_lineage(placed.select("ws", "module", "root", "_p"))
    direct = placed.where(F.size("_p") == 1).select("ws", "module", "root").distinct()
    layers = placed.where(F.size("_p").between(2, 5) & (F.get("_p", F.lit(0)) != "src")).select(
        "ws", "module", "root", F.get("_p", F.lit(0)).alias("id")).distinct()
    n_layers = layers.groupBy("ws").agg(F.count("*").alias("n"))
    has_direct = direct.select("ws").distinct()
    enough = n_layers.where(F.col("n") >= 2).select("ws").union(
        n_layers.where(F.col("n") == 1).select("ws").join(has_direct, "ws", "left_anti"))

    def full(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")
    entry = direct.select("ws", short_id(F.col("module"), F.col("ws")).alias("id"),
                          full(F.col("module"), F.lit(SOURCES), F.col("root")).alias("dir"), F.lit("entry").alias("kind"))
    layer = layers.join(enough, "ws", "left_semi").select(
        "ws", "id", full(F.col("module"), F.lit(SOURCES), F.col("root"), F.col("id")).alias("dir"), F.lit("layer").alias("kind"))
    done = entry.select("ws").union(layer.select("ws")).distinct()
    flat = root.join(done, "ws", "left_anti").select(
        "ws", short_id(F.col("module"), F.col("ws")).alias("id"), full(F.col("module"), F.lit(SOURCES)).alias("dir"),
        F.lit("module").alias("kind"))
    return several.unionByName(entry).unionByName(layer).unionByName(flat)
