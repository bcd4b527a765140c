"""Queries over snapshots, artifacts, usage and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from factspark.functions import answers as J
from factspark.operators import artifacts as A
from factspark.operators import ranking as R
from factspark.operators import snapshot as S
from factspark.operators import usage as U
from factspark.plans.registry import query
from factspark.plans.rescan import rescan_state
from factspark.session import cut_lineage
from factspark.sources import store
from factspark.streaming import jobs as ST

c = F.col

_DIFF = """diff AS (SELECT coalesce(b.ws, a.ws) AS ws, coalesce(b.path, a.path) AS path,
      CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' WHEN a.version = b.version THEN 'unchanged'
        WHEN md5(a.content) = b.md5 THEN 'touched' ELSE 'modified' END AS change,
      a.version, md5(a.content) AS new_md5, b.md5 AS old_md5, a.size AS new_size, b.size AS old_size
    FROM {files_before} b FULL JOIN {files_after} a ON a.ws = b.ws AND a.path = b.path)"""


@query("snap_diff", f"""WITH {_DIFF}
    SELECT ws, path, change, version, CASE WHEN change IN ('unchanged', 'touched') THEN old_size ELSE new_size END AS size,
      CASE WHEN change IN ('unchanged', 'touched') THEN old_md5 ELSE new_md5 END AS md5 FROM diff""")
def snap_diff(t):
    return S.snapshot_diff(t.rel("files_before"), t.rel("files_after"))


@query("snap_commit", f"""WITH {_DIFF}
    SELECT ws, path, version, CASE WHEN change IN ('unchanged', 'touched') THEN old_size ELSE new_size END AS size,
      CASE WHEN change IN ('unchanged', 'touched') THEN old_md5 ELSE new_md5 END AS md5 FROM diff WHERE change <> 'removed'""")
def _(t):
    """Write a snapshot, commit it, and read it back as the current one."""
    folder = t.work_dir()
    rows = S.next_snapshot(snap_diff(t))
    store.write_snapshot(rows, folder, 1)
    store.commit_snapshot(rows, folder, 1)
    return store.load_snapshot(t.spark, folder)


@query("jn_longest_prefix", """
    WITH d AS (SELECT DISTINCT string_split(path, '/')[1] AS dir FROM {paths} UNION SELECT DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM {paths} WHERE contains(path, '/en/'))
    SELECT page_id, path, (SELECT arg_max(dir, length(dir)) FROM d WHERE starts_with(regexp_replace(path, '(^|/)[^/]*$', '') || '/', dir || '/')) AS owner FROM {paths}""")
def _(t):
    p = t.rel("paths")
    host = F.substring_index("path", "/", 1)
    two = F.substring_index("path", "/", 2)
    nodes = p.select("ws", host.alias("dir")).union(p.where(F.contains("path", F.lit("/en/"))).select("ws", two.alias("dir"))).distinct()
    return S.owners_by_dir(p, nodes.withColumn("id", c("dir"))).select("page_id", "path", "owner")


@query("jn_layout_owner", """
    SELECT path, CASE WHEN pkg_id IN (SELECT 'n' || n_nationkey FROM nation) THEN pkg_id END AS owner FROM {sources}""")
def _(t):
    n = F.concat(F.lit("n"), c("n_nationkey").cast("string"))
    ws = F.array(*[F.lit(f"w{i}") for i in range(1, 6)])
    known = t.table("nation").select(F.explode(ws).alias("ws"), n.alias("id"))
    return S.owners_by_layout(t.rel("sources").select("ws", "path"), known).select("path", "owner")


@query("agg_change_rollup", f"""WITH {_DIFF},
      known AS (SELECT DISTINCT ws, string_split(path, '/')[1] AS id FROM {{files_before}} UNION SELECT DISTINCT ws, string_split(path, '/')[1] FROM {{files_after}})
    SELECT DISTINCT diff.ws, known.id FROM diff JOIN known ON known.ws = diff.ws AND known.id = string_split(diff.path, '/')[1]
      WHERE change IN ('added', 'modified', 'removed')
    UNION (SELECT DISTINCT ws, string_split(path, '/')[1] FROM {{files_after}} EXCEPT SELECT DISTINCT ws, string_split(path, '/')[1] FROM {{files_before}})""")
def _(t):
    """Changed packages with the first directory as the package."""
    pack = lambda d: d.withColumn("path", F.concat(F.lit("packages/"), "path"))
    ids = lambda d: d.select("ws", F.substring_index("path", "/", 1).alias("id")).distinct()
    before, after = t.rel("files_before"), t.rel("files_after")
    return S.changed_packages(S.snapshot_diff(pack(before), pack(after)), ids(before), ids(after))


# --------------------------------------------------------------------- usage

def usage_calls(t):
    u = U.with_estimates(t.rel("usage"))
    used = J.billed_usage(c("input_tokens"), c("output_tokens"), c("cache_read"), c("cache_write"))
    return u.withColumn("u", used).withColumn("usage_in", c("u.in_tokens")).withColumn("usage_out", c("u.out_tokens")).drop("u")


_TOKENS = r"(3 * length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g')) + 8 * (length({0}) - length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g'))) + 11) // 12"
_BILLED = "input_tokens + coalesce(cache_read, 0) + coalesce(cache_write, 0)"
_TOTALS = f"""count(*) AS calls, CAST(sum({_TOKENS.format('prompt')}) AS BIGINT) AS est_in, CAST(sum({_TOKENS.format('output')}) AS BIGINT) AS est_out,
      CAST(coalesce(sum({_BILLED}), 0) AS BIGINT) AS usage_in, CAST(coalesce(sum(output_tokens) FILTER (WHERE input_tokens IS NOT NULL), 0) AS BIGINT) AS usage_out, CAST(sum(ms) AS BIGINT) AS ms"""


@query("usage_totals", f"SELECT ws, {_TOTALS} FROM {{usage}} GROUP BY ws")
def _(t):
    return U.usage_totals(usage_calls(t))


@query("usage_normalize", f"""
    SELECT call_id, {_BILLED} AS in_tokens, CASE WHEN input_tokens IS NOT NULL THEN output_tokens END AS out_tokens FROM {{usage}}""")
def _(t):
    used = J.billed_usage(c("input_tokens"), c("output_tokens"), c("cache_read"), c("cache_write"))
    return t.rel("usage").select("call_id", used.alias("u")).select("call_id", "u.in_tokens", "u.out_tokens")


@query("usage_fold", f"SELECT ws, {_TOTALS} FROM {{usage}} GROUP BY ws")
def _(t):
    """History and live rows overlap; every call counts once."""
    calls = usage_calls(t)
    return U.usage_totals(U.fold_history(calls.where(c("at") >= 2), calls.where(c("at") <= 5).unionByName(calls.where(c("at") > 5))))


@query("win_newest_n", """
    SELECT ws, call_id, "at" FROM {usage} QUALIFY row_number() OVER (PARTITION BY ws ORDER BY "at" DESC, call_id DESC) <= 10""")
def _(t):
    return U.newest_calls(t.rel("usage").select("ws", "call_id", "at"))


_ANSWERED = """r AS (SELECT session, event_id, ts, (SELECT min(a.ts) FROM {session_events} a WHERE a.kind = 'answer' AND a.session = q.session
        AND a.ts > q.ts AND a.ts <= q.ts + INTERVAL 30 MINUTE) AS answer_ts FROM {session_events} q WHERE kind = 'request')"""


@query("jn_interval_answer", f"WITH {_ANSWERED} SELECT session, event_id, ts, answer_ts FROM r WHERE answer_ts IS NOT NULL")
def _(t):
    return U.first_answers(t.rel("session_events").select("session", "event_id", "ts", "kind"))


_RUN = ", ".join(f"sum(CASE WHEN event_id % 4 = {k} THEN cents ELSE 0 END) OVER (PARTITION BY session ORDER BY ts RANGE UNBOUNDED PRECEDING) AS c{k}" for k in range(4))
_GAIN = "greatest(0, b.c{0} - a.c{0})"


@query("jn_asof_delta", f"""
    WITH {_ANSWERED.replace("30 MINUTE", "7 DAY")}, k AS (SELECT DISTINCT session, ts, {_RUN} FROM {{session_events}} WHERE kind NOT IN ('request', 'answer'))
    SELECT r.session, r.event_id, CAST({" + ".join(_GAIN.format(k) for k in range(3))} AS BIGINT) AS input, CAST({_GAIN.format(3)} AS BIGINT) AS output
    FROM r ASOF JOIN k a ON a.session = r.session AND a.ts <= r.ts ASOF JOIN k b ON b.session = r.session AND b.ts <= r.answer_ts
    WHERE answer_ts IS NOT NULL AND ({" OR ".join(f"b.c{k} > a.c{k}" for k in range(4))})""")
def _(t):
    """Counters are sampled at events that are neither request nor answer, so both moments look back."""
    e = t.rel("session_events")
    sampled = e.where(~c("kind").isin("request", "answer"))
    split = sampled.select("session", "ts", *[F.when(c("event_id") % 4 == k, c("cents")).otherwise(0).alias(n) for k, n in enumerate(U.COUNTERS)])
    totals = U.running_total(split, "session", "ts", U.COUNTERS, U.COUNTERS)
    matched = U.first_answers(e.select("session", "event_id", "ts", "kind"), life_seconds=7 * 86400)
    return U.counter_delta(matched, totals).select("session", "event_id", c("input").cast("long").alias("input"), c("delta_output").cast("long").alias("output"))


# -------------------------------------------------------------------- ledger

def ledger_of(t):
    def listed(name):
        return F.when(c(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, ","))
    return t.rel("ledger").select("ws", "name", "kind", "lang", "v", listed("deps_text").alias("deps"),
                                  listed("requires_text").alias("requires"), "payload")


_DEPS = "CASE WHEN deps_text = '' THEN [] ELSE string_split(deps_text, ',') END"
_STATE = f"""l AS (SELECT *, {_DEPS} AS deps FROM {{ledger}}),
    e AS (SELECT l.*, deps_text IS NULL OR EXISTS (SELECT 1 FROM {{changed}} g WHERE g.ws = l.ws AND list_contains(l.deps, g.id)) AS own FROM l),
    fell AS (SELECT DISTINCT ws, kind FROM e WHERE own AND v IS NOT NULL AND kind IN ('concept','sequence','events','flow','core','summaries','analysis')),
    s AS (SELECT e.*, CASE WHEN kind IN ('draw', 'index') THEN 'kept'
        WHEN kind IN ('seq-edge', 'flow-subgraph', 'overview') THEN CASE WHEN own OR kind = 'overview' OR v IS NULL
          OR (ws, CASE kind WHEN 'seq-edge' THEN 'sequence' ELSE 'flow' END) IN (SELECT (ws, kind) FROM fell) THEN 'invalidated' ELSE 'restamped' END
        WHEN v IS NULL THEN 'kept' WHEN own THEN 'invalidated' ELSE 'restamped' END AS action FROM e)"""
_NEXT = "CASE action WHEN 'invalidated' THEN CAST(0 AS BIGINT) WHEN 'restamped' THEN CAST(2100 AS BIGINT) ELSE v END AS v"
_DRILLS = ["seq-edge", "flow-subgraph", "overview"]


def next_state(t):
    return A.invalidate(ledger_of(t), t.rel("changed"), F.lit(2100))


@query("art_selective", f"WITH {_STATE} SELECT ws, name, kind, action, {_NEXT} FROM s WHERE kind NOT IN ('seq-edge', 'flow-subgraph', 'overview')")
def _(t):
    return next_state(t).where(~c("kind").isin(_DRILLS)).select("ws", "name", "kind", "action", "v")


@query("art_cascade_drill", f"WITH {_STATE} SELECT ws, name, kind, action, {_NEXT} FROM s WHERE kind IN ('seq-edge', 'flow-subgraph', 'overview')")
def _(t):
    return next_state(t).where(c("kind").isin(_DRILLS)).select("ws", "name", "kind", "action", "v")


@query("art_requires", """
    SELECT ws, name, kind FROM {ledger} WHERE v > 0 AND kind NOT IN ('draw', 'index')
      AND list_contains(string_split(requires_text, ','), CASE WHEN ws IN ('w1', 'w2') THEN 'seq' WHEN ws = 'w3' THEN 'core' ELSE 'flow-event' END)""")
def _(t):
    kind = F.when(c("ws").isin("w1", "w2"), "seq").when(c("ws") == "w3", "core").otherwise("flow-event")
    return A.cascade_requires(ledger_of(t), t.rel("versions").select("ws", kind.alias("kind")))


@query("art_sweep", "SELECT ws, name, kind FROM {ledger} WHERE v IS NOT NULL OR kind IN ('draw', 'index')")
def _(t):
    return A.sweep(ledger_of(t)).select("ws", "name", "kind")


@query("art_write_guard", f"""
    SELECT ws, name, array_to_string(list_sort(list_distinct({_DEPS})), ',') AS deps FROM {{ledger}} WHERE v > 0""")
def _(t):
    return A.writable(ledger_of(t)).select("ws", "name", F.array_join(F.array_sort("deps"), ",").alias("deps"))


@query("art_ledger_store", f"""WITH {_STATE}
    SELECT ws, name, kind, {_NEXT}, CASE WHEN action <> 'invalidated' AND s.v > 0 THEN payload END AS payload FROM s
    WHERE (v > 0 OR action <> 'kept') AND NOT (ws = 'w3' AND kind = 'overview')""")
def _(t):
    """Artifacts, a compaction, the outcome of an invalidation and removals; then the state that the store gives."""
    folder, led = t.work_dir(), ledger_of(t)
    store.append_artifacts(led, folder, 1)
    store.compact_ledger(t.spark, folder)
    store.append_states(A.invalidate(led, t.rel("changed"), F.lit(2100)), folder, 2)
    store.remove_artifacts(led.where((c("ws") == "w3") & (c("kind") == "overview")), folder, 3)
    return store.load_ledger(t.spark, folder).select("ws", "name", "kind", "v", "payload")


@query("art_facts_version", """
    SELECT source AS ws, CAST(coalesce(max(CASE WHEN quality = 1 THEN n_chars END), 0) AS BIGINT) AS facts_v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def _(t):
    d = t.table("documents").join(t.table("labels"), "doc_id", "left")
    return A.facts_version(d.select(c("source").alias("ws"), F.when(c("quality") == 1, c("n_chars")).alias("generated_at")))


@query("art_current", "SELECT ws, name FROM {ledger} JOIN {versions} USING (ws) WHERE v = facts_v AND v > 0 AND trim(payload) <> ''")
def _(t):
    return A.current(ledger_of(t), t.rel("versions")).select("ws", "name")


@query("art_stale_prior", "SELECT ws, name, v, payload FROM {ledger} JOIN {versions} USING (ws) WHERE v <> facts_v AND v > 0")
def _(t):
    return A.stale_priors(ledger_of(t), t.rel("versions"))


@query("art_valid_index", """
    SELECT s.ws, pkg_id FROM (SELECT ws, pkg_id, language, max(o_orderkey % 5 + 1998) AS v, count(*) AS n FROM {sources} GROUP BY ALL) s
      JOIN {versions} USING (ws) WHERE v = facts_v AND language = 'python' AND n > 0""")
def _(t):
    rows = t.rel("sources").groupBy("ws", "pkg_id", "language").agg(
        F.max(c("o_orderkey") % 5 + 1998).alias("v"), F.count("*").alias("n_packages"))
    return A.valid_index(rows, t.rel("versions"), F.lit("python")).select("ws", "pkg_id")


@query("agg_artifact_deps", """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN '' END
      WHEN 2 THEN array_to_string(list_sort(list_distinct(['n' || (o_custkey % 40), 'n' || (o_custkey % 13)])), ',')
      WHEN 3 THEN 'n' || (o_custkey % 7) ELSE 'n' || (o_custkey % 40) END AS deps FROM orders""")
def _(t):
    n = lambda k: F.concat(F.lit("n"), (c("o_custkey") % k).cast("string"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("concepts", "flow-event", "seq", "interaction", "core")]), (c("o_orderkey") % 5 + 1).cast("int"))
    source = F.when(c("o_custkey") % 2 == 0, "doc").otherwise("flow")
    deps = A.figure_deps(kind, source, F.array(n(40), n(13)), F.array(F.lit(""), n(7)), F.array(n(40)), F.array(n(3)))
    return t.table("orders").select("o_orderkey", F.array_join(F.array_sort(deps), ",").alias("deps"))


@query("art_drill_deps", f"""
    WITH d AS (SELECT ws, name, kind, o_orderkey, {_DEPS} AS deps FROM {{ledger}} WHERE kind IN ('seq-edge', 'flow-subgraph', 'overview')),
      p AS (SELECT ws, o_orderkey, {_DEPS} AS deps FROM {{ledger}} WHERE kind = 'flow')
    SELECT d.ws, name, CASE d.kind WHEN 'seq-edge' THEN 'n' || (d.o_orderkey % 40) || ',n' || (d.o_orderkey % 13) WHEN 'flow-subgraph' THEN array_to_string(p.deps, ',') END AS deps
    FROM d LEFT JOIN p ON p.ws = d.ws AND p.o_orderkey = d.o_orderkey - 5""")
def _(t):
    led = t.rel("ledger").withColumn("deps", F.when(c("deps_text") == "", F.array().cast("array<string>")).otherwise(F.split("deps_text", ",")))
    k = c("o_orderkey")
    drills = led.where(c("kind").isin(_DRILLS)).select(
        "ws", "name", "kind", F.concat(F.lit("seq:n"), (k % 40).cast("string"), F.lit("|n"), (k % 13).cast("string"), F.lit("|go")).alias("target_key"),
        F.concat(F.lit("a"), (k - 5).cast("string")).alias("parent"))
    parents = led.where(c("kind") == "flow").select("ws", "name", "deps")
    return A.drill_deps(drills, parents).select("ws", "name", F.array_join("deps", ",").alias("deps"))


_FIGURES = "['duties','concepts','core','seq','flow-event','flow-pipeline','interaction']"


@query("art_rebuild_plan", f"""
    WITH h AS (SELECT DISTINCT ws, {_FIGURES}[1 + o_orderkey % 7] AS kind, v FROM {{ledger}} WHERE v > 0 AND NOT (ws = 'w2' AND o_orderkey % 7 = 3) AND NOT (ws = 'w4' AND v = 2001)),
      k AS (SELECT ws, facts_v, unnest({_FIGURES}) AS kind, unnest(range(7)) AS ord FROM {{versions}})
    SELECT k.ws, k.kind, ord, CASE WHEN h.ws IS NULL THEN 'rebuild' ELSE 'skipped' END AS state FROM k LEFT JOIN h ON h.ws = k.ws AND h.kind = k.kind AND h.v = facts_v""")
def _(t):
    kinds = F.array(*[F.lit(k) for k in A.FIGURE_KINDS])
    led = t.rel("ledger").withColumn("kind", F.get(kinds, (c("o_orderkey") % 7).cast("int")))
    led = led.where(~((c("ws") == "w2") & (c("kind") == "seq")) & ~((c("ws") == "w4") & F.coalesce(c("v") == 2001, F.lit(False))))
    return A.rebuild_plan(led, t.rel("versions"))


@query("agg_chapter_scope", """
    WITH m AS (SELECT DISTINCT ws, src, dst FROM {nation_calls}),
      path AS (SELECT ws, src AS id FROM m UNION SELECT ws, dst FROM m),
      party AS (SELECT DISTINCT c_mktsegment AS ws, unnest(['n' || c_nationkey, 'x' || (c_custkey % 9)]) AS id FROM customer),
      core AS (SELECT DISTINCT c_mktsegment AS ws, 'n' || (c_custkey % 5) AS id FROM customer WHERE c_mktsegment <> 'BUILDING'),
      ent AS (SELECT DISTINCT c_mktsegment AS ws, 'e' || (c_custkey % 11) AS id FROM customer),
      sm AS (SELECT ws, 'seq' AS chapter, id FROM path UNION SELECT ws, 'interaction', id FROM party UNION SELECT ws, 'interaction', id FROM path
        UNION SELECT ws, 'deps', id FROM core UNION SELECT ws, 'er', id FROM ent UNION SELECT ws, 'er', id FROM core UNION SELECT ws, 'er', id FROM path),
      k AS (SELECT DISTINCT c_mktsegment AS ws, unnest(['concepts','seq','flow','interaction','deps','er','catalog']) AS chapter FROM customer)
    SELECT ws, chapter, id FROM sm UNION ALL SELECT ws, chapter, NULL FROM k WHERE (ws, chapter) NOT IN (SELECT (ws, chapter) FROM sm)""")
def _(t):
    cu = t.table("customer").withColumn("ws", c("c_mktsegment"))
    s = lambda p, e: F.concat(F.lit(p), e.cast("string"))
    messages = cut_lineage(t.rel("nation_calls").select("ws", "src", "dst").distinct())
    events = cu.select("ws", F.array(s("n", c("c_nationkey"))).alias("producers"), F.array(s("x", c("c_custkey") % 9)).alias("consumers"))
    core = cu.where(c("ws") != "BUILDING").select("ws", s("n", c("c_custkey") % 5).alias("id"))
    return A.chapter_scopes(messages, events, core, cu.select("ws", s("e", c("c_custkey") % 11).alias("pkg_id")), cu.select("ws"))


_CHAPTERS = ["doc-concepts", "doc-seq", "explain-flow", "explain-deps", "seq", "interaction", "doc-er", "flow-event"]


@query("art_chapter_plan", f"""
    WITH l AS (SELECT ws, {_CHAPTERS}[1 + o_orderkey % 8] AS kind, CASE WHEN o_orderkey % 8 IN (1, 6) AND ws <> 'w1' THEN v - 50 ELSE v END AS v, payload FROM {{ledger}} WHERE NOT (ws = 'w5' AND o_orderkey % 8 IN (4, 5))),
      cur AS (SELECT DISTINCT ws, kind FROM l JOIN {{versions}} USING (ws) WHERE v = facts_v AND v > 0 AND trim(payload) <> ''),
      old AS (SELECT DISTINCT ws, kind FROM l JOIN {{versions}} USING (ws) WHERE v <> facts_v AND v > 0),
      k AS (SELECT ws, unnest(['concepts','seq','flow','interaction','deps','er','catalog']) AS chapter, unnest(['concepts','seq','flow-event','interaction','core','core','core']) AS figure FROM {{versions}})
    SELECT ws, chapter, CASE WHEN (ws, 'doc-' || chapter) IN (SELECT (ws, kind) FROM cur) THEN 'fresh'
      WHEN (ws, 'explain-' || chapter) IN (SELECT (ws, kind) FROM cur) AND ws <> 'w3' THEN 'from-explain'
      WHEN chapter IN ('concepts','seq','flow','interaction') AND (ws, figure) NOT IN (SELECT (ws, kind) FROM cur) THEN 'missing-figure'
      WHEN (ws, 'doc-' || chapter) IN (SELECT (ws, kind) FROM old) THEN 'stale-prior' ELSE 'generate' END AS state FROM k""")
def _(t):
    kinds = F.array(*[F.lit(k) for k in _CHAPTERS])
    slot = c("o_orderkey") % 8
    led = t.rel("ledger").where(~((c("ws") == "w5") & slot.isin(4, 5))) \
        .withColumn("v", F.when(slot.isin(1, 6) & (c("ws") != "w1"), c("v") - 50).otherwise(c("v"))) \
        .withColumn("kind", F.get(kinds, slot.cast("int")))
    clean = t.rel("versions").where(c("ws") != "w3").select(
        "ws", F.explode(F.array(*[F.lit(k) for k in A.CHAPTER_REQUIRES])).alias("chapter"))
    return A.chapter_plan(led, t.rel("versions"), clean)


@query("art_rescan", f"""
    WITH {_DIFF}, l AS (SELECT source AS ws, 'a' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'src' END AS dep, doc_id % 5 = 0 AS nodeps FROM documents),
      moved AS (SELECT DISTINCT ws, string_split(path, '/')[1] AS id FROM diff WHERE change IN ('added', 'modified', 'removed'))
    SELECT ws, name, CASE WHEN nodeps OR (ws, dep) IN (SELECT (ws, id) FROM moved) THEN 'invalidated' ELSE 'restamped' END AS action FROM l WHERE ws IN (SELECT ws FROM moved)""")
def _(t):
    pack = lambda d: d.withColumn("path", F.concat(F.lit("packages/"), "path"))
    before, after = t.rel("files_before"), t.rel("files_after")
    ids = lambda d: d.select("ws", F.substring_index("path", "/", 1).alias("id")).distinct()
    k = c("doc_id")
    dep = F.when(k % 3 == 0, F.array(F.lit("old"))).otherwise(F.array(F.lit("src")))
    led = t.table("documents").select(
        c("source").alias("ws"), F.concat(F.lit("a"), k.cast("string")).alias("name"), F.lit("core").alias("kind"), F.lit("en").alias("lang"),
        F.lit(7).cast("long").alias("v"), F.when(k % 5 != 0, dep).alias("deps"), F.array().cast("array<string>").alias("requires"), F.lit("p").alias("payload"))
    out = rescan_state(pack(before), pack(after), ids(before), ids(after), led, 9)
    return out["ledger"].select("ws", "name", "action")


# ------------------------------------------------------------------- streams

def run_to_table(t, stream):
    """Run a stream over everything there is and read what it wrote."""
    folder = t.work_dir()
    writer = stream.writeStream.option("checkpointLocation", folder + "/state").trigger(availableNow=True).outputMode("append")
    writer.format("parquet").option("path", folder + "/rows").start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(folder + "/rows")


def updates_of(t, stream, keys):
    """Run a stream of changed keys over everything there is and read the newest row of each."""
    folder = t.work_dir()
    ST.write_updates(stream, folder + "/rows", folder + "/state").awaitTermination()
    schema = stream.schema.add("batch", "long")
    return ST.latest(t.spark.read.schema(schema).parquet(folder + "/rows"), keys)


def with_rocksdb(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")


@query("st_capture", "SELECT conv_id AS session, turn, text FROM conversations WHERE role = 'assistant' AND trim(text) <> ''")
def _(t):
    s = t.stream("conversations").select(
        c("conv_id").alias("session"), c("turn").alias("ts"), F.concat(c("role"), F.lit("/message")).alias("type"),
        F.array(F.struct(F.lit("text").alias("type"), c("text"))).alias("content"))
    return run_to_table(t, ST.answer_events(s)).select("session", c("ts").alias("turn"), "text")


def stream_events(t):
    kind = F.when(c("event_type") == "click", "request").when(c("event_type") == "purchase", "answer")
    return t.stream("events").select(c("user_id").alias("session"), "event_id", c("ts").cast("timestamp").alias("ts"), kind.alias("kind"))


@query("st_interval_join", f"WITH {_ANSWERED} SELECT session, event_id AS request_id, answer_ts FROM r WHERE answer_ts IS NOT NULL")
def _(t):
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = stream_events(t)
    requests = e.where(c("kind") == "request").withColumn("request_id", c("event_id"))
    pairs = run_to_table(t, ST.matched_answers(requests, stream_events(t).where(c("kind") == "answer"), "session"))
    return pairs.groupBy("session", "request_id").agg(F.min("answer_ts").cast("timestamp_ntz").alias("answer_ts"))


@query("st_answered_requests", """
    SELECT event_id AS request_id, ts AS request_ts, ts + to_minutes(event_id % 50) AS answer_ts FROM events
    WHERE event_type = 'click' AND event_id % 50 BETWEEN 1 AND 30""")
def _(t):
    """Requests and answers by id; every request comes twice, some answers after its life."""
    t.spark.conf.set("spark.sql.session.timeZone", "UTC")
    asked = stream_events(t).where(c("kind") == "request").select(c("event_id").alias("request_id"), "ts")
    again = stream_events(t).where(c("kind") == "request").select(c("event_id").alias("request_id"), "ts")
    answers = stream_events(t).where(c("kind") == "request").select(
        c("event_id").alias("request_id"), F.timestamp_seconds(F.unix_micros("ts") / 1000000 + c("event_id") % 50 * 60).alias("ts"))
    found = run_to_table(t, ST.answered_requests(asked.union(again), answers))
    return found.select("request_id", c("request_ts").cast("timestamp_ntz").alias("request_ts"), c("answer_ts").cast("timestamp_ntz").alias("answer_ts"))


#: What the watermark of a stream over all events has passed at its end.
_PASSED = "epoch_us(ts) // 1000 < (SELECT epoch_us(max(ts)) // 1000 FROM {session_events}{0}) - 1800000"


@query("st_pending_slot", f"""
    WITH e AS (SELECT session, event_id, kind, ts, lead(kind) OVER w AS next_kind, lead(ts) OVER w AS next_ts
      FROM {{session_events}} WHERE kind IN ('request', 'answer') AND {_PASSED.replace("{0}", " WHERE kind IN ('request', 'answer')")} WINDOW w AS (PARTITION BY session ORDER BY epoch_us(ts) // 1000, event_id))
    SELECT CAST(session AS VARCHAR) AS session, event_id AS request_id FROM e WHERE kind = 'request' AND next_kind = 'answer'
      AND epoch_us(next_ts) // 1000 - epoch_us(ts) // 1000 <= 1800000""")
def _(t):
    with_rocksdb(t)
    e = stream_events(t).where(c("kind").isNotNull()).select(
        c("session").cast("string").alias("session"), "event_id", "kind", F.unix_millis("ts").alias("at"))
    return run_to_table(t, ST.pending_slots(e)).select("session", "request_id")


@query("st_usage_totals", f"""SELECT 'w' || conv_id AS ws, count(*) AS calls, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE {_TOKENS.format('text')} END) AS BIGINT) AS est_in,
      CAST(sum(CASE WHEN role = 'assistant' THEN {_TOKENS.format('text')} ELSE 0 END) AS BIGINT) AS est_out FROM conversations GROUP BY ALL""")
def _(t):
    said = c("role") == "assistant"
    s = t.stream("conversations").select(
        F.concat(F.lit("w"), c("conv_id").cast("string")).alias("ws"),
        F.when(said, "").otherwise(c("text")).alias("prompt"), F.when(said, c("text")).otherwise("").alias("output"))
    return updates_of(t, ST.running_usage(U.with_estimates(s)), ["ws"])


@query("st_status_changes", f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, CAST(floor(value / 10) AS BIGINT) AS seq, epoch_us(ts) // 1000 AS "at" FROM events
        WHERE {_PASSED.replace("{session_events}{0}", "events")}),
      n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "at", seq) AS i FROM e),
      s AS (SELECT user_id, i, seq, "at", true AS sent FROM n WHERE i = 1 UNION ALL
        SELECT n.user_id, n.i, CASE WHEN fresh THEN n.seq ELSE s.seq END, CASE WHEN fresh THEN n."at" ELSE s."at" END, fresh
        FROM s JOIN n ON n.user_id = s.user_id AND n.i = s.i + 1,
          LATERAL (SELECT n."at" - s."at" >= 604800000 OR (n.seq <> s.seq AND n."at" - s."at" >= 3600000) AS fresh))
    SELECT CAST(user_id AS VARCHAR) AS ws, seq, "at" FROM s WHERE sent""")
def _(t):
    with_rocksdb(t)
    s = t.stream("events").select(c("user_id").cast("string").alias("ws"), (F.floor(c("value") / 10)).cast("long").alias("seq"),
                                  F.unix_millis(c("ts").cast("timestamp")).alias("at"))
    return run_to_table(t, ST.status_changes(s, gap_ms=3_600_000))


@query("st_active_ops", """
    SELECT ws, kind, started_at FROM (SELECT CAST(user_id AS VARCHAR) AS ws, CASE WHEN event_id % 2 = 0 THEN 'figure' ELSE 'docs' END AS kind, ts AS started_at,
      event_type, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type IN ('click', 'view')""")
def _(t):
    s = t.stream("events").select(
        c("user_id").cast("string").alias("ws"), F.when(c("event_id") % 2 == 0, "figure").otherwise("docs").alias("kind"),
        c("ts").alias("at"), c("event_id").alias("seq"), F.when(c("event_type").isin("click", "view"), "enter").otherwise("exit").alias("what"))
    return updates_of(t, ST.active_operations(s), ["ws", "kind"]).where(c("what") == "enter").select("ws", "kind", "started_at")


def _step(i: int) -> str:
    """SQL of one batch: l<i> and the changes of nations i modulo 3 to l<i + 1>."""
    return f"""
    g{i} AS MATERIALIZED (SELECT DISTINCT 'w' || (1 + c_nationkey % 5) AS ws, 'n' || (c_custkey % 3) AS id FROM customer WHERE c_nationkey % 3 = {i}),
    e{i} AS MATERIALIZED (SELECT l.*, deps IS NULL OR EXISTS (SELECT 1 FROM g{i} g WHERE g.ws = l.ws AND list_contains(l.deps, g.id)) AS own FROM l{i} l
      WHERE ws IN (SELECT ws FROM g{i}) AND kind NOT IN ('draw', 'index')),
    f{i} AS (SELECT DISTINCT ws, kind FROM e{i} WHERE own AND kind NOT IN ('seq-edge', 'flow-subgraph', 'overview')),
    s{i} AS (SELECT *, own OR kind = 'overview' OR (kind IN ('seq-edge', 'flow-subgraph')
      AND (ws, CASE kind WHEN 'seq-edge' THEN 'sequence' ELSE 'flow' END) IN (SELECT (ws, kind) FROM f{i})) AS hit FROM e{i}),
    l{i + 1} AS MATERIALIZED (SELECT ws, name, kind, CASE WHEN hit THEN 0 ELSE 2100 + {i} END AS v, CASE WHEN NOT hit THEN deps END AS deps FROM s{i}
      UNION ALL SELECT * FROM l{i} WHERE kind IN ('draw', 'index') OR ws NOT IN (SELECT ws FROM g{i}))"""


@query("st_invalidate", f"""
    WITH l0 AS (SELECT ws, name, kind, CAST(v AS BIGINT) AS v, {_DEPS} AS deps FROM {{ledger}} WHERE v > 0), {", ".join(_step(i) for i in range(3))}
    SELECT ws, name, kind, CAST(v AS BIGINT) AS v FROM l3""")
def _(t):
    """A change stream of three batches applied to a stored ledger: each batch goes on from the state before it."""
    folder = t.work_dir()
    store.append_artifacts(ledger_of(t), folder, 1)
    store.compact_ledger(t.spark, folder)
    change = t.table("customer").select(c("c_nationkey"), F.concat(F.lit("w"), (1 + c("c_nationkey") % 5).cast("string")).alias("ws"),
                                        F.concat(F.lit("n"), (c("c_custkey") % 3).cast("string")).alias("id"))
    for k in range(3):  # the three together are all customers
        change.where(c("c_nationkey") % 3 == k).select("ws", "id").coalesce(1).write.mode("append").parquet(folder + "/changes")
    changes = t.spark.readStream.schema("ws string, id string").option("maxFilesPerTrigger", 1).parquet(folder + "/changes")
    ST.invalidate_ledger(changes, folder, 2100, folder + "/state", compact_every=2).awaitTermination()
    return store.load_ledger(t.spark, folder, payloads=False).select("ws", "name", "kind", "v")
