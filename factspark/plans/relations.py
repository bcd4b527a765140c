"""Relations derived row by row from the given tables.

The tables hold no source code, so packages, calls, files, prose and answers are
composed from their columns.  Each text below is plain SQL that both engines
read; ``{name}`` is a table or another relation.  All but ``nation_calls`` work
on single rows, so deriving them neither shuffles nor groups anything.
"""

from __future__ import annotations

import string

_K = "CAST(o_orderkey AS STRING)"
_WS = "'w' || substr(o_orderpriority, 1, 1)"


def _n(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_A, _B = _n("o_custkey % 25"), _n("(o_custkey + 1) % 25")
_X, _Y = _n("o_custkey % 13"), _n("(o_custkey + 7) % 40")
_P = _n("o_custkey % 40")
_NL = "chr(10)"

_LANG = "CASE o_orderkey % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'java' END"
_DIR = "CASE o_orderkey % 7 WHEN 0 THEN 'tests' WHEN 1 THEN 'dist' ELSE 'src' END"
_FILE = (f"CASE o_orderkey % 15 WHEN 0 THEN 'index.ts' WHEN 10 THEN 'main.py' WHEN 5 THEN 'NApplication.java' "
         f"WHEN 1 THEN 'test_o.py' WHEN 6 THEN 'o.spec.ts' WHEN 11 THEN 'OTest.java' ELSE 'o' || {_K} || "
         f"CASE o_orderkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.java' END END")


def _lines(*parts: str) -> str:
    return f" || {_NL} || ".join(parts)


_TS = _lines(
    f"'import {{{{ b' || {_A} || ', b' || {_B} || ' as other }}}} from ''n' || {_X} || ''''",
    f"'import type {{{{ T' || {_A} || ' }}}} from ''@corp/n' || {_Y} || ''''",
    "'import * as svc from ''./util'''",
    "'/** not a call: ghost() */'",
    f"'export class C' || {_K} || ' {{{{'",
    "'  private total = 0'",
    "'  run(limit: number) {{'",
    f"'    b' || {_A} || '()'",
    "'    this.stop()'",
    "'    svc.inner.launch(limit)'",
    "'    console.log(\"b9()\")'",
    "'  }}'",
    "'  stop() {{}}'",
    "'}}'",
    f"'export function o' || {_K} || '(x: number) {{{{'",
    f"'  b' || {_B} || '(b' || {_A} || '(x))'",
    "'  setTimeout(() => 0, 1)'",
    "'}}'",
    f"'export interface I' || {_K} || ' {{{{ a: string }}}}'")
_PY = _lines(
    "'import os.path'",
    f"'from n' || {_X} || ' import b' || {_A} || ', b' || {_B} || ' as z'",
    "'from . import sibling'",
    "'@decor'",
    f"'class C' || {_K} || ':'",
    "'    def run(self):'",
    f"'        b' || {_A} || '()'",
    "'    def stop(self):'",
    "'        pass'",
    f"'def o' || {_K} || '():'",
    f"'    b' || {_B} || '()'")
_JAVA = _lines(
    f"'import n' || {_X} || '.b' || {_A} || ';'",
    f"'import static n' || {_Y} || '.T.go;'",
    "'@Service'",
    f"'public class C' || {_K} || ' {{{{'",
    "'    private int total, rest = 0;'",
    f"'    public C' || {_K} || '(int a) {{{{ this.total = a; }}}}'",
    f"'    @GetMapping(\"/o' || {_K} || '\")'",
    f"'    public void run() {{{{ b' || {_A} || '.call(); }}}}'",
    "'}}'",
    f"'interface I' || {_K} || ' {{{{ void a(); }}}}'")

_CALL = (f"l_returnflag || l_linestatus AS ws, l_orderkey * 8 + l_linenumber AS ord, 'm' || {_n('l_partkey')} AS src, "
         f"'m' || {_n('l_suppkey')} AS dst, 'f' || {_n('CAST(l_quantity AS INT)')} AS sym, "
         f"'packages/m' || {_n('l_partkey')} || '/src/o' || {_n('l_orderkey')} || '.ts' AS file")
_PAGE = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://(m[.]|blog[.]|www[.])?', ''), '[?#].*$', ''), '/$', '')"
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜß"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyAAAAAACEEEEIIIINOOOOOUUUUs"

RELATIONS: dict[str, str] = {
    # Calls between packages: part -> supplier, few and very large workspaces.
    "calls": f"""
        SELECT {_CALL} FROM {{lineitem}} WHERE l_partkey <> l_suppkey""",
    # The same with the priority of their order; orders meet lines, not the texts made from them.
    "order_calls": f"""
        SELECT {_CALL}, substr(o_orderpriority, 1, 1) AS priority
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey WHERE l_partkey <> l_suppkey""",
    # Calls between nations: the one relation that joins the star schema.
    "nation_calls": f"""
        SELECT c_mktsegment AS ws, l_orderkey * 8 + l_linenumber AS ord,
               'n' || {_n('c_nationkey')} AS src, 'n' || {_n('s_nationkey')} AS dst,
               lower(replace(p_brand, 'Brand#', 'b')) AS sym,
               'packages/n' || {_n('c_nationkey')} || '/src/c' || {_n('c_custkey')} || '.ts' AS file
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
             JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {{part}} ON l_partkey = p_partkey
        WHERE c_nationkey <> s_nationkey""",
    # Packages of the calls relation; the order of declaration is the part number.
    "call_nodes": """
        SELECT ws, id AS pkg_id, MIN(CAST(substr(id, 2) AS BIGINT)) AS pkg_ord
        FROM (SELECT ws, src AS id FROM {calls} UNION ALL SELECT ws, dst FROM {calls}) AS both_ends GROUP BY ws, id""",
    # Model usage: one call per conversation turn.
    "usage": f"""
        SELECT 'w' || {_n('conv_id')} AS ws, conv_id * 1000 + turn AS call_id, turn AS at, role AS kind,
               CASE WHEN role = 'assistant' THEN '' ELSE text END AS prompt,
               CASE WHEN role = 'assistant' THEN text ELSE '' END AS output,
               (conv_id * 7 + turn * 13) % 900 AS ms,
               CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) END AS input_tokens,
               CAST(turn AS BIGINT) AS output_tokens,
               CASE WHEN turn % 2 = 0 THEN CAST(turn * 3 AS BIGINT) END AS cache_read,
               CASE WHEN turn % 3 = 0 THEN CAST(5 AS BIGINT) END AS cache_write
        FROM {{conversations}}""",
    # Links of the pages, accents folded so that both engines measure the same distance.
    "hrefs": f"""
        SELECT page_id, translate(html, '{_ACCENTED}', '{_PLAIN}') AS html FROM {{pages}}""",
    # Two snapshots of the documents: low-quality ones moved, toxic ones edited, some only touched.
    "files_before": f"""
        SELECT source AS ws, 'src/d' || {_n('doc_id')} || '.md' AS path, {_n('n_chars')} || 'a' AS version,
               n_chars AS size, md5(text) AS md5 FROM {{documents}}""",
    "files_after": f"""
        SELECT source AS ws, CASE WHEN quality = 0 THEN 'old/d' ELSE 'src/d' END || {_n('d.doc_id')} || '.md' AS path,
               {_n('n_chars')} || CASE WHEN toxic = 1 THEN 'c' WHEN lang IN ('fr', 'de') THEN 'b' ELSE 'a' END AS version,
               n_chars AS size, CASE WHEN toxic = 1 THEN text || 'x' ELSE text END AS content
        FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id""",
    # File paths of the pages: host/locale/name.
    "paths": f"""
        SELECT 'web' AS ws, page_id, {_PAGE} AS path FROM {{pages}}""",
    # Import specifiers made of part names, in several spellings.
    "specs": f"""
        SELECT 'w' || lower(substr(p_type, 1, 1)) AS ws, split_part(p_name, ' ', 2) AS pkg_id, p_partkey AS imp_ord,
               'packages/' || split_part(p_name, ' ', 2) || '/src/a' || {_n('p_size')} || '.ts' AS from_file,
               CASE p_partkey % 5
                 WHEN 0 THEN '@corp/x-' || split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2)
                 WHEN 1 THEN split_part(p_name, ' ', 1) || 'kit/lib'
                 WHEN 2 THEN '../' || split_part(p_name, ' ', 1) || '/index'
                 WHEN 3 THEN './local' || {_n('p_size')}
                 ELSE '@corp/' || split_part(p_name, ' ', 1) END AS spec,
               false AS type_only
        FROM {{part}}""",
    "spec_packages": """
        SELECT ws, pkg_id, CAST(length(pkg_id) * 1000 + ascii(pkg_id) AS BIGINT) * 1000 + ascii(substr(pkg_id, 2)) AS pkg_ord
        FROM (SELECT DISTINCT 'w' || lower(substr(p_type, 1, 1)) AS ws, split_part(p_name, ' ', 1) AS pkg_id FROM {part}
              UNION SELECT DISTINCT 'w' || lower(substr(p_type, 1, 1)), split_part(p_name, ' ', 2) FROM {part}) AS names""",
    # Artifacts: one per order, with every case of deps and versions.
    "ledger": f"""
        SELECT {_WS} AS ws, CASE o_orderkey % 12 WHEN 10 THEN 'draw-dynamic-' || {_K} WHEN 11 THEN 'idx-' || {_K} ELSE 'a' || {_K} END AS name,
               CASE o_orderkey % 12 WHEN 0 THEN 'concept' WHEN 1 THEN 'sequence' WHEN 2 THEN 'events' WHEN 3 THEN 'flow'
                 WHEN 4 THEN 'core' WHEN 5 THEN 'summaries' WHEN 6 THEN 'analysis' WHEN 7 THEN 'seq-edge'
                 WHEN 8 THEN 'flow-subgraph' WHEN 9 THEN 'overview' WHEN 10 THEN 'draw' ELSE 'index' END AS kind,
               'en' AS lang,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN CAST(0 AS BIGINT)
                 ELSE CAST(extract(year FROM o_orderdate) AS BIGINT) END AS v,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN ''
                 ELSE 'n' || {_n('o_custkey % 25')} || ',n' || {_n('o_orderkey % 25')} || ',n' || {_n('o_custkey % 7')} END AS deps_text,
               CASE o_orderkey % 4 WHEN 0 THEN 'seq' WHEN 1 THEN 'core,seq' WHEN 2 THEN 'flow-event' ELSE '' END AS requires_text,
               CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE 'p' || {_K} END AS payload,
               o_orderkey
        FROM {{orders}}""",
    "changed": f"""
        SELECT DISTINCT {_WS} AS ws, 'n' || {_n('n_nationkey')} AS id
        FROM {{orders}} JOIN (SELECT n_nationkey FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') AS asia
             ON o_custkey % 25 = n_nationkey""",
    "versions": f"""
        SELECT {_WS} AS ws, MAX(CAST(extract(year FROM o_orderdate) AS BIGINT)) AS facts_v FROM {{orders}} GROUP BY {_WS}""",
    # Source files and manifests: one of each per order.
    "sources": f"""
        SELECT {_WS} AS ws, 'n' || {_P} AS pkg_id, o_orderkey, {_LANG} AS language,
               'packages/n' || {_P} || '/' || {_DIR} || '/o' || {_K} || '/' || {_FILE} AS path,
               CASE WHEN o_orderkey % 33 = 1 THEN 'def broken(:'
                 WHEN o_orderkey % 3 = 0 THEN {_TS} WHEN o_orderkey % 3 = 1 THEN {_PY} ELSE {_JAVA} END AS content
        FROM {{orders}}""",
    "source_imports": f"""
        SELECT ws, pkg_id, imp_ord, from_file, spec, split(names, ',') AS names, type_only FROM (
          SELECT {_WS} AS ws, 'n' || {_P} AS pkg_id, CAST(o_orderkey * 4 AS BIGINT) AS imp_ord,
                 'packages/n' || {_P} || '/' || {_DIR} || '/o' || {_K} || '.ts' AS from_file, 'n' || {_X} AS spec,
                 'b' || {_A} || ',b' || {_B} AS names, false AS type_only FROM {{orders}}
          UNION ALL
          SELECT {_WS}, 'n' || {_P}, CAST(o_orderkey * 4 + 1 AS BIGINT),
                 'packages/n' || {_P} || '/' || {_DIR} || '/o' || {_K} || '.ts', '@corp/n' || {_Y},
                 'b' || {_B} || ',svc', false FROM {{orders}}) AS i""",
    "source_calls": f"""
        SELECT {_WS} AS ws, CAST(o_orderkey * 4 AS BIGINT) AS call_ord,
               'packages/n' || {_P} || '/' || {_DIR} || '/o' || {_K} || '.ts' AS from_file,
               'o' || {_K} AS caller, 'b' || {_A} AS callee, CAST(NULL AS STRING) AS root FROM {{orders}}
        UNION ALL
        SELECT {_WS}, CAST(o_orderkey * 4 + 1 AS BIGINT), 'packages/n' || {_P} || '/' || {_DIR} || '/o' || {_K} || '.ts',
               'o' || {_K}, 'b' || {_B}, NULL FROM {{orders}}
        UNION ALL
        SELECT {_WS}, CAST(o_orderkey * 4 + 2 AS BIGINT), 'packages/n' || {_P} || '/' || {_DIR} || '/o' || {_K} || '.ts',
               'o' || {_K}, 'launch', CASE WHEN o_orderkey % 2 = 0 THEN 'svc' ELSE 'console' END FROM {{orders}}""",
    "source_entities": f"""
        SELECT {_WS} AS ws, 'n' || {_P} AS pkg_id, CAST(o_orderkey AS BIGINT) AS ord, 'C' || {_K} AS name,
               CASE o_orderkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'interface' WHEN 2 THEN 'function' WHEN 3 THEN 'method' ELSE 'field' END AS kind,
               'packages/n' || {_P} || '/src/o' || {_K} || '.ts' AS file FROM {{orders}}""",
    "source_packages": f"""
        SELECT DISTINCT {_WS} AS ws, 'n' || {_P} AS pkg_id, CAST(o_custkey % 40 AS BIGINT) AS pkg_ord,
               'packages/n' || {_P} AS path,
               CASE WHEN o_custkey % 8 = 0 THEN 'src/index.ts' ELSE '' END AS entry_text FROM {{orders}}""",
    "manifests": f"""
        SELECT {_WS} AS ws, 'packages/o' || {_K} AS dir, o_orderkey, {_LANG} AS language,
          CASE o_orderkey % 3
            WHEN 0 THEN '{{{{"name":"@corp/o' || {_K} || '","dependencies":{{{{"n' || {_X} || '":"1"}}}},"peerDependencies":{{{{"n' || {_X} || '":"1","@corp/n' || {_Y} || '":"2"}}}}}}}}'
            WHEN 1 THEN '[build-system]' || {_NL} || 'name = "wrong"' || {_NL} || '[project]' || {_NL} || 'name = "o' || {_K} || '"' || {_NL}
                 || 'dependencies = [' || {_NL} || '  "n' || {_X} || '",' || {_NL} || '  "n' || {_Y} || '>=2",' || {_NL} || ']'
            ELSE '<project><parent><artifactId>top</artifactId></parent><artifactId>o' || {_K} || '</artifactId><dependencyManagement><dependencies>'
                 || '<dependency><artifactId>bom</artifactId></dependency></dependencies></dependencyManagement><dependencies><dependency><artifactId>n'
                 || {_X} || '</artifactId></dependency><dependency><artifactId> n' || {_Y} || ' </artifactId></dependency></dependencies></project>' END AS content
        FROM {{orders}}""",
    # Headed documents: every line of a document becomes a heading, a marker or stays text, by its place.
    "headed": f"""
        SELECT source AS ws, CASE WHEN doc_id % 4 = 0 THEN 'docs/design-' ELSE 'docs/usage-' END || {_n('doc_id')} || '.md' AS doc,
               doc_id, text AS raw FROM {{documents}}""",
    # Prose with claims about files, packages and edges: one document per order.
    "prose": f"""
        SELECT {_WS} AS ws, 'o' || {_K} AS doc, o_orderkey, o_custkey,
               'See `packages/n' || {_P} || '/src/o' || {_K} || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END || '.ts` and `@corp/n'
               || {_Y} || CASE WHEN o_orderkey % 6 = 0 THEN 'q' ELSE '' END || '` and `bare`.' || {_NL}
               || 'Also packages/n' || {_P} || '/src/o' || {_K} || CASE WHEN o_orderkey % 7 = 0 THEN 'y' ELSE '' END || '.ts here.' || {_NL}
               || '```' || {_NL} || '`gone/away.ts` `@corp/none`' || {_NL} || '```' || {_NL}
               || '| caller | callee |' || {_NL} || '| --- | --- |' || {_NL}
               || CASE WHEN o_orderkey % 4 = 0 THEN '| n' || {_X} || ' | `n' || {_P} || '` |' ELSE '| `n' || {_P} || '` | n' || {_X} || ' |' END || {_NL}
               || '| n' || {_P} || ' | zzz |' || {_NL} || 'end' AS text
        FROM {{orders}}""",
    # Model answers: one per order.
    "answers": f"""
        SELECT 'c' || {_K} AS id, o_orderkey, o_custkey,
               'Here it is ' || CASE WHEN o_orderkey % 5 = 0 THEN '{{{{curly}}}}' ELSE 'now' END || ':' || {_NL} || CASE WHEN o_orderkey % 3 = 0 THEN '```json' || {_NL} ELSE '' END
               || '{{{{"figId":"c' || {_K} || '","seqMessages":[{{{{"from":"n' || {_P} || '","to":"n' || {_X} || '","label":" go ' || {_A} || ' "}}}},'
               || '{{{{"from":"n' || {_X} || '","to":"zzz","label":"bad"}}}},{{{{"from":"n' || {_X} || '","to":"n' || {_P} || '","label":""}}}}],'
               || '"events":[{{{{"event":"e' || {_A} || '","mode":"' || CASE o_orderkey % 2 WHEN 0 THEN 'serial' ELSE 'odd' END
               || '","producers":["n' || {_P} || '"],"consumers":["n' || {_X} || '","n' || {_Y} || '"]}}}},{{{{"event":" "}}}}]'
               || CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE '}}}}' END
               || CASE WHEN o_orderkey % 3 = 0 THEN {_NL} || '```' ELSE '' END || {_NL} || 'Done.' AS text
        FROM {{orders}}""",
    # Session events: clicks ask, purchases answer.
    "session_events": """
        SELECT user_id AS session, event_id, ts, CASE event_type WHEN 'click' THEN 'request' WHEN 'purchase' THEN 'answer' ELSE event_type END AS kind,
               CAST(round(value * 100) AS BIGINT) AS cents FROM {events}""",
}


def _expand(text: str, seen: dict[str, str]) -> str:
    names = {f for _, f, _, _ in string.Formatter().parse(text) if f}
    for name in sorted(names & set(RELATIONS)):
        if name not in seen:
            seen[name] = ""
            seen[name] = _expand(RELATIONS[name], seen)
            seen[name] = seen.pop(name)
    return text.format(**{n: n if n not in RELATIONS else f"rel_{n}" for n in names})


def sql_with(text: str) -> str:
    """Oracle text with the relations it names put in front as common table expressions."""
    seen: dict[str, str] = {}
    body = _expand(text, seen)
    if not seen:
        return body
    head = ",\n".join(f"rel_{name} AS ({sql})" for name, sql in seen.items())
    recursive = "WITH RECURSIVE " if "RECURSIVE" in body else "WITH "
    body = body.strip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{recursive}{head},\n{body[len(word):]}"
    return f"{recursive}{head}\n{body}"
