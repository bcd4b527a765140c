"""Walks and call resolution against plain versions, and what they write on the way."""

import random
from collections import deque

from factspark.operators import graph as G

EDGES = "ws string, src string, dst string, edge_ord long"


def walked(edges, seeds, cap=None):
    """Messages of one workspace by a queue: every popped package emits all of its edges."""
    out = {}
    for src, dst, n in sorted(edges, key=lambda e: (e[2], e[1])):
        out.setdefault(src, []).append((src, dst, n))
    queue = deque(s for s in seeds if s in out)
    seen, told = set(queue), []
    while queue:
        for src, dst, n in out[queue.popleft()]:
            told.append((src, dst, n))
            if dst in out and dst not in seen:
                seen.add(dst)
                queue.append(dst)
    return told[:cap]


def test_walk_moves_packages_only(spark, monkeypatch):
    """The edges of every level were written, then all sorted for their numbers, before."""
    rng = random.Random(4)
    ids = [f"p{k}" for k in range(40)]
    pairs = {(rng.choice(ids[:30]), rng.choice(ids)) for _ in range(220)}
    rows = [(a, b, rng.randrange(60)) for a, b in pairs if a != b]
    edges = spark.createDataFrame([(w, *r) for w in ("x", "y") for r in rows] + [("z", "p1", "p2", 1)], EDGES)
    packages = spark.createDataFrame([(w, p, k) for w in "xyz" for k, p in enumerate(ids)], "ws string, pkg_id string, pkg_ord long")
    entries = spark.createDataFrame([("x", "p7"), ("x", "p3"), ("x", "p39")], "ws string, id string")
    written = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(G, "SPAN_BITS", 2, raising=False)
    cited = {p: sum(b == p for _, b, _ in rows) for p in ids}
    seeds = {"x": ["p3", "p7"], "y": sorted(ids, key=lambda p: (-cited[p], int(p[1:])))}
    for cap in (None, 25):
        got = {}
        for r in G.bfs_messages(edges, entries, packages, cap).orderBy("ws", "msg_ord").collect():
            got.setdefault(r["ws"], []).append((r["msg_ord"], r["src"], r["dst"], r["edge_ord"]))
        assert got == {w: [(k, *m) for k, m in enumerate(walked(rows, s, cap), 1)] for w, s in seeds.items()}
    assert max(df.count() for df in written) <= packages.count() < edges.count()


def test_calls_are_resolved_with_few_exchanges(spark):
    """Bindings were aggregated three times, and met files, specifiers and calls one after the other, before."""
    rng = random.Random(6)
    files = [f"packages/a{k % 4}/{'tests' if k % 6 == 0 else 'src'}/f{k}.ts" for k in range(24)]
    specs = ["a0", "@x/a1", "@x/lib/a2", "./f3", "./f5", "../src/f9", "none", "./none"]
    imports = [(w, f"a{files.index(f) % 4}", n, f, rng.choice(specs), rng.choice([["b"], ["b", "c"], ["d"], [], None]))
               for n, (w, f) in enumerate((w, rng.choice(files)) for w in "xy" for _ in range(90))]
    calls = [(w, n, rng.choice(files), rng.choice("bcde"), rng.choice([None, None, "b"])) for n, w in enumerate("xy" * 150)]
    packages = [(w, f"a{k}", k) for w in "xy" for k in range(4)]
    owner = {(w, f): f"a{files.index(f) % 4}" for w, _, _, f, _, _ in imports}
    first = {}
    for w, _, n, f, s, names in imports:
        for b in names or []:
            first.setdefault((w, f, b), s)

    def target(w, f, s):
        if s.startswith("."):
            return owner.get((w, f.rsplit("/", 1)[0] + "/" + s[2:] + ".ts")) if s.startswith("./") else None
        return next((p for p in (s, s.split("/")[-1]) if p in ("a0", "a1", "a2")), None)
    want = set()
    for w, n, f, callee, root in calls:
        s = first.get((w, f, root or callee))
        dst = target(w, f, s) if s and "/tests/" not in f else None
        if dst and dst != owner[w, f]:
            want.add((w, n, owner[w, f], dst, callee, f))
    none = spark.createDataFrame([], "ws string, file string, pkg_id string")
    got = G.resolve_calls(spark.createDataFrame(calls, "ws string, call_ord long, from_file string, callee string, root string"),
                          spark.createDataFrame(imports, "ws string, pkg_id string, imp_ord long, from_file string, spec string, names array<string>"),
                          none, spark.createDataFrame(packages, "ws string, pkg_id string, pkg_ord long"))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and any("./" in first[w, f, root or callee] for w, n, f, callee, root in calls if (w, f, root or callee) in first)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(names") == 1


def test_ledger_without_payloads_moves_its_log_once(spark, tmp_path):
    """The log moved by key, by key and write, and by bucket, also where nobody read payloads, before."""
    from factspark.sources import store
    schema = "ws string, name string, kind string, lang string, v long, deps array<string>, requires array<string>, payload string"
    row = lambda name, v, payload="p": ("w", name, "core", "en", v, [name], None, payload)
    folder = f"file://{tmp_path}/store"

    def same():
        whole, bare = store.load_ledger(spark, folder), store.load_ledger(spark, folder, payloads=False)
        assert bare.columns == whole.columns and bare.where("payload IS NOT NULL").isEmpty()
        rows = lambda df: sorted(map(repr, df.drop("payload").collect()))
        assert rows(bare) == rows(whole)
        return bare
    store.append_artifacts(spark.createDataFrame([row(f"a{k}", 100) for k in range(6)], schema), folder, 100)
    same()
    store.compact_ledger(spark, folder, buckets=3)
    store.append_artifacts(spark.createDataFrame([row("a1", 200), row("b", 200)], schema), folder, 200)
    moved = spark.createDataFrame([(*row("a2", 0, None), "tombstoned"), (*row("a3", 300, None), "restamped")], schema + ", action string")
    store.append_states(moved, folder, 300)
    store.remove_artifacts(spark.createDataFrame([("w", "a4")], "ws string, name string"), folder, 400)
    bare = same()
    assert bare._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
