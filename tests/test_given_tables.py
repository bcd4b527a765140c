"""Queries on tables that differ from the given ones: stored as folders, or with other rows."""

import duckdb
import pytest

from factspark.plans.catalog import ORACLES, QUERIES
from parity import compare

SF = "/root/testdata/sf0.001"


def against_sql(spark, folder, name, **tables):
    """'' if a query over ``tables``, each written as a folder of two files, equals its SQL."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.repartition(2).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return compare(QUERIES[name](spark, str(folder)), con, ORACLES[name])


@pytest.mark.parametrize("name", ["st_usage_totals", "st_capture"])
def test_streams_read_folders(spark, tmp_path, name):
    assert against_sql(spark, tmp_path, name, conversations=spark.read.parquet(f"{SF}/conversations.parquet")) == ""


def test_outlines_of_long_documents(spark, tmp_path):
    """As many headings as the SQL takes: 60 of a document before."""
    docs = spark.createDataFrame([(4, "s", "\n".join(f"line {k}" for k in range(240))), (8, "s", "short")], "doc_id long, source string, text string")
    assert against_sql(spark, tmp_path, "doc_outline", documents=docs) == ""


def test_documents_that_end_within_a_workspace(spark, tmp_path):
    docs = spark.createDataFrame([(k, None if k == 7 else "text") for k in range(12)], "doc_id long, text string")
    assert against_sql(spark, tmp_path, "docset_resolve", documents=docs) == ""


def test_declared_targets_know_all_edges(spark):
    """An edge that is called in either direction of its names is not new."""
    from factspark.plans.registry import Tables

    calls = Tables(spark, SF).rel("nation_calls").select("ws", "src", "dst").distinct()
    found = QUERIES["jn_declared_target"](spark, SF)
    assert found.count() > 0 and found.join(calls, ["ws", "src", "dst"], "left_semi").count() == 0


def test_pairs_list_every_call(spark, tmp_path):
    """A row a pair and call, however many pairs share a symbol; a pair whose symbol is in no call lists those of its package."""
    orders = [(k, k % 90, f"{k % 2 + 1}-X") for k in range(1, 181)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    calls = [(f"w{p[0]}", 4 * k + i, f"n{u % 40}", f"o{k}", callee) for k, u, p in orders
             for i, callee in enumerate((f"b{u % 25}", f"b{(u + 1) % 25}", "launch"))]
    want = []
    for ws, src, label in {(ws, src, callee) for ws, _, src, _, callee in calls}:
        named = [x for x in calls if x[0] == ws and not label.startswith("b1") and label in x[3:]]
        own = [x for x in calls if x[0] == ws and x[2] == src]
        want += [(ws, f"{src}>{label}", ord, caller, callee, "symbol" if named else "package") for _, ord, _, caller, callee in named or own]
    got = QUERIES["jn_pair_evidence"](spark, str(tmp_path)).select("ws", "pair_id", "ord", "caller", "callee", "via")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 10 * len(calls)


def test_packed_trees_read_like_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from factspark.sources.listing import scan_workspaces, write_workspaces

    paths = ["a.ts", "src/b.ts", "src/tests/c.ts", "tests/d.ts", "src/e.spec.ts", "node_modules/f.ts", "deep/" * 60 + "g.ts", "src/é.py"]
    rows = [(ws, p, None if p == "a.ts" else f"{ws} {p} ö\n" * 3) for ws in ("u", "v", "w") for p in paths]
    files = spark.createDataFrame(rows, "ws string, path string, content string").repartition(4)
    for packed in (False, True):
        write_workspaces(files, f"{tmp_path}/{packed}", packed)
    read = lambda packed, cond: sorted(map(tuple, scan_workspaces(spark, f"{tmp_path}/{packed}", ws_depth=1).where(cond).select("ws", "path", "size", "content").collect()))
    for cond in ("true", "ws = 'v'", "path LIKE 'src/%'", "ws IN ('u', 'w') AND path = 'src/b.ts'"):
        assert read(True, cond) == read(False, cond) != []
    assert not [p for p in tmp_path.glob("True/**/*.ts")] and scan_workspaces(spark, f"{tmp_path}/True", ws_depth=1, partitions=1).count() == 12
    listed = scan_workspaces(spark, f"{tmp_path}/True", ws_depth=1, content="false")
    assert listed.where(F.col("content").isNotNull()).count() == 0 and listed.count() == 12


def test_import_edges_extract_once(spark):
    """Imports are made once, however often the edges refer to them."""
    from pyspark.sql import functions as F

    from factspark.operators import graph as G

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(spec):
        seen.add(1)
        return spec

    rows = [("w", f"p{k % 3}", k, f"packages/p{k % 3}/src/f{k}.ts", spec) for k, spec in enumerate(["p0/x", "p1", "../p2/y", "p2", "zz", "p0"])]
    imports = spark.createDataFrame(rows, "ws string, pkg_id string, imp_ord long, from_file string, spec string").withColumn("spec", made("spec"))
    packages = spark.createDataFrame([("w", f"p{k}", k) for k in range(3)], "ws string, pkg_id string, pkg_ord long")
    got = sorted(tuple(r) for r in G.import_edges(imports, packages).select("src", "dst", "edge_ord").collect())
    assert got == [("p0", "p2", 3), ("p2", "p0", 5)] and seen.value == len(rows)


def test_cut_rows_are_read_by_column(spark):
    from factspark.session import cut_lineage
    rows = spark.range(5).selectExpr("id", "id AS id", "cast(id AS string) AS `a b`")
    cut = cut_lineage(rows)
    assert cut.columns == ["id", "id", "a b"] and sorted(tuple(r) for r in cut.collect()) == [(i, i, str(i)) for i in range(5)]
    plan = cut.select("a b")._jdf.queryExecution().toString()
    assert "parquet" in plan and "ReadSchema: struct<c2:string>" in plan
    assert cut_lineage(spark.sql("SELECT 1 AS a, NULL AS b")).collect() == [(1, None)]


def test_degrees_after_an_edit_need_no_symbols(spark):
    from factspark.plans import incremental as I
    calls = spark.createDataFrame([("w", "f", 1, "a", "b", "x"), ("w", "g", 2, "b", "c", "y")], "ws string, file string, ord long, src string, dst string, sym string")
    diff = spark.createDataFrame([("w", "f", "removed")], "ws string, path string, change string")
    state = I.updated(I.graph_state(calls), diff, lambda files: calls.limit(0))
    plan = state.degrees._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_sort" not in plan
    assert sorted(tuple(r) for r in state.degrees.select("id", "cited_by", "cites").collect()) == [("b", 0, 1), ("c", 1, 0)]


def test_touched_edges_move_as_numbers(spark, monkeypatch):
    """Joins with touched edges asked for three texts before; edges that share a number must come out right all the same."""
    from pyspark.sql import functions as F

    from factspark.operators import graph as G
    from factspark.plans import incremental as I
    schema = "ws string, file string, ord long, src string, dst string, sym string"
    rows = [("w", "f", 1, "a", "b", "x"), ("w", "g", 2, "a", "b", "y"), ("w", "g", 3, "b", "c", "y"), ("w", "h", 4, "c", "a", "z"), ("v", "f", 1, "a", "b", "x")]
    new = [("w", "f", 5, "a", "b", "x"), ("w", "n", 6, "c", "d", "x")]
    kept = [r for r in rows if r[:2] not in {("w", "f"), ("w", "h")}]
    # A file may be named twice.
    diff = spark.createDataFrame([("w", f, k) for f, k in (("f", "modified"), ("f", "modified"), ("h", "removed"), ("n", "added"), ("g", "unchanged"))],
                                 "ws string, path string, change string")

    def edges():
        found = I.updated(I.graph_state(spark.createDataFrame(rows, schema)), diff, lambda files: spark.createDataFrame(new, schema))
        whole = I.graph_state(spark.createDataFrame(kept + new, schema))
        for part in ("calls", "counts", "edges", "degrees"):
            got, want = getattr(found, part), getattr(whole, part)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), part
        return found.edges
    plan = edges()._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Left" in line]
    assert len(joins) >= 2 and all("src" not in line and "key" in line for line in joins), plan
    for module in (G, I):  # every edge and file of a workspace has the same number
        monkeypatch.setattr(module, "text_key", lambda *names: F.xxhash64(names[0]))
    edges()


def test_orders_meet_lines_not_texts(spark):
    """The edited call graph made all texts of a call before its join with orders, so they were moved and sorted."""
    from factspark.plans.registry import Tables
    plan = Tables(spark, "/root/testdata/sf0.001").rel("order_calls")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join Inner", 1)
    assert "packages/m" in above and "packages/m" not in below


def test_records_leave_python_in_small_batches(spark):
    """One batch of files was one frame of records before, however many they were."""
    import pyarrow as pa

    from factspark.operators import extract as E
    sent = {}

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            sent["run"] = run
    E.extract_records(Files())
    rows = 3000
    batch = pa.RecordBatch.from_pydict({"ws": ["w"] * rows, "pkg_id": ["p"] * rows, "path": [f"{i}.java" for i in range(rows)], "language": ["java"] * rows,
                                        "content": ["class A {\n  int a, b;\n}"] * rows})
    out = list(sent["run"](iter([batch])))
    counts = [b.num_rows for b in out]
    assert sum(counts) == 3 * rows and max(counts) < 4100


def test_positions_of_groups_over_many_ranges(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from factspark.operators.ranking import positions
    rows = spark.range(4000).select((F.when(F.col("id") < 3000, F.lit(None)).otherwise(F.col("id") % 7)).alias("k"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = positions(rows, ["k"], ["o"], "pos")
        assert "Window" in found._jdf.queryExecution().toString()
        want = rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("long"))
        assert found.exceptAll(want).isEmpty() and found.count() == 4000
        sizes = found._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in sizes  # only groups that a range begins with hand their sizes on
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dealt_tables_hold_what_is_read(spark):
    """Comments and clerks were written with every order before, and places were found by a sort."""
    from factspark.plans.registry import Tables
    rows = Tables(spark, SF).rel("sources", row_bytes=1000)
    assert Tables._columns(spark.read.parquet(f"{SF}/orders.parquet"), "SELECT o_orderkey FROM {orders}") == ["o_orderkey"]
    assert rows.exceptAll(Tables(spark, SF).rel("sources")).isEmpty()


def test_few_texts_are_strings_at_once():
    """All texts of a batch were Python strings at once before."""
    import pyarrow as pa

    from factspark.llm.language_id import TEXTS, some_texts
    batch = pa.array([None, "a", ""] * TEXTS)
    parts = list(some_texts(batch))
    assert sum(parts, []) == batch.to_pylist() and max(map(len, parts)) == TEXTS
    assert list(some_texts(pa.array([], pa.string()))) == []
