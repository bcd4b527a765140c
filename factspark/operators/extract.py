"""Imports, entities and calls of source files.

One ``mapInArrow`` pass yields one tagged row stream for all three record types
(``rec_type``), which the callers split by filter.  Python sources are read with
``ast``; TypeScript and Java have no grammar library here, so small scanners
approximate one: strings and comments are blanked, then brackets are followed.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.functions import paths as P
from factspark.functions.rows import inlined
from factspark.functions.text import NOISE_CALLS
from factspark.operators.ranking import top_n

RECORD = ("ws string, pkg_id string, path string, rec_type string, ord long, parent_ord long, name string, kind string, "
          "line long, modifiers array<string>, spec string, names array<string>, type_only boolean, "
          "caller string, root string")
FIELDS = [f.split()[0] for f in RECORD.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ARROW_RECORD = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in RECORD.split(", "))])
FILES_AT_ONCE, RECORDS_AT_ONCE = 500, 4000

_BLANK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`")
_IMPORT = re.compile(r"(?m)^[ \t]*import\b(\s+type\b(?!\s*,|\s+from\b))?([^;'\"()]*?)(?:\bfrom\s*)?(['\"])")
_DECL = re.compile(r"(?<![.\w$])(abstract\s+class|class|interface|enum|type|function)\b\s*\*?\s*([A-Za-z_$][\w$]*)")
# A name is tried once, from its first letter, and never given back piece by piece.
_CHAIN = re.compile(r"((?<![A-Za-z_$])[A-Za-z_$][\w$]*+(?:\s*[?!]?\.\s*#?[A-Za-z_$][\w$]*+)*+)\s*(?:<[^<>()]*>)?\s*(?:\?\.\s*)?\(|[{}()]|;|=|\n")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return", "super", "import", "typeof", "await",
             "constructor", "with", "new", "async"}
_DOT = re.compile(r"[?!]?\.")
_NOT_CALL = re.compile(r"\b(new|function)\s*\*?$")
_BODY = re.compile(r"\s*(?::\s*[^{};=()]+(?:\{[^{}]*\}[^{};=()]*)?)?\{")
_PAIR = {"{}": re.compile(r"[{}]"), "()": re.compile(r"[()]")}
_STEP = re.compile(r"[{}()\[\];\n]")
_OPEN_END = re.compile(r"[=,|&<:?(+\-*/]\s*$")
_ONLY_MARKS = re.compile(r"\s*(@[\w.]+(\([^()]*\))?\s*)*$")
_TS_KIND = {"class": 0, "abstract class": 1, "interface": 2, "enum": 3, "type": 4, "function": 5}
_DECOR = re.compile(r"@([\w.]+)(?:\([^()]*\))?\s*")
_MEMBER = re.compile(r"^(?:@[\w.]+(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|static|readonly|abstract|override|async|get"
                     r"|set|declare|accessor)\s+)*\*?\s*([A-Za-z_$#][\w$]*)\s*[?!]?\s*(?:<[^(]*?>)?\s*([(:=;]|$)")


def _blank(source: str) -> str:
    """Same text with comments and string contents replaced by spaces; quotes and lines stay."""
    def fill(m: re.Match) -> str:
        t = m.group()
        body = re.sub(r"[^\n]", " ", t)
        return t[0] + body[1:-1] + t[-1] if t[0] in "'\"`" else body
    return _BLANK.sub(fill, source)


def _lines(source: str) -> Callable[[int], int]:
    starts = [m.start() for m in re.finditer("\n", source)]
    return lambda at: bisect.bisect_left(starts, at) + 1


def _close(text: str, at: int, pair: str = "{}") -> int:
    depth = 0
    for m in _PAIR[pair].finditer(text, at):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.start()
    return len(text)


def _chunks(text: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """Members of a class body: pieces between ``;``, closed blocks and line ends at depth 0."""
    depth, begin = 0, start
    for m in _STEP.finditer(text, start, end):
        c, at = m.group(), m.start()
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
        if depth:
            continue
        piece = text[begin:at + 1]
        ended = c == ";" or c == "}" or (c == "\n" and not _OPEN_END.search(piece) and not _ONLY_MARKS.match(piece))
        if ended and piece.strip():
            yield begin + len(piece) - len(piece.lstrip()), piece.strip().rstrip(";").rstrip()
            begin = at + 1
    if text[begin:end].strip():
        piece = text[begin:end]
        yield begin + len(piece) - len(piece.lstrip()), piece.strip()


_LEAD = re.compile(r"((?:@[\w.]+(?:\([^()]*\))?\s*|\b(?:export|default|declare|public|private|protected|final|static|abstract|sealed)\s+)+)$")


def _lead(text: str, at: int) -> tuple[int, list[str]]:
    """Where a declaration's modifiers start, and the decorators among them."""
    block = _LEAD.search(text[max(0, at - 2000):at])
    return (at - len(block.group(1)), _DECOR.findall(block.group(1))) if block else (at, [])


def extract_typescript(source: str) -> Iterator[dict]:
    text, line = _blank(source), _lines(source)
    for n, m in enumerate(_IMPORT.finditer(text)):
        stop = text.find(m.group(3), m.end())
        spec = source[m.end():stop]
        if not spec:
            continue
        clause = m.group(2)
        names = []
        for inner in re.findall(r"\{([^}]*)\}", clause):
            names += [re.sub(r"^type\s+", "", s.strip()).split()[0] for s in inner.split(",") if s.strip()]
        names += re.findall(r"\*\s*as\s+([\w$]+)", clause)
        yield {"rec_type": "import", "ord": n, "spec": spec, "names": names, "type_only": m.group(1) is not None,
               "line": line(m.start())}
    found, blocks = [], {}
    for m in _DECL.finditer(text):
        word, name = re.sub(r"\s+", " ", m.group(1)), m.group(2)
        before = text[max(0, m.start() - 256):m.start()].rstrip()
        if before.endswith("abstract") and word == "class":
            continue
        if word in ("function", "class") and re.search(r"([=(,:?&|!\[]|=>|\breturn)$", re.sub(r"\basync$", "", before).rstrip()):
            continue
        if word == "type" and not re.match(r"\s*(<[^=]*>)?\s*=", text[m.end():m.end() + 400]):
            continue
        body = text.find("{", m.end())
        if word in ("class", "abstract class", "function") and body >= 0:
            if word == "function":
                args = text.find("(", m.end())
                body = text.find("{", _close(text, args, "()")) if args >= 0 else body
            blocks[body] = ("class" if "class" in word else "function", name)
        found.append((_TS_KIND[word], m.start(), word.replace("abstract ", ""), name, body))
    ord_ = 0
    for _, at, kind, name, body in sorted(found):
        own = ord_
        yield {"rec_type": "entity", "ord": own, "name": name, "kind": kind, "line": line(at),
               "modifiers": _lead(text, at)[1]}
        ord_ += 1
        if kind != "class" or body < 0:
            continue
        for where, piece in _chunks(text, body + 1, _close(text, body)):
            hit = _MEMBER.match(piece)
            if hit is None or hit.group(1) == "static" and piece.startswith("static {"):
                continue
            is_method = hit.group(2) == "("
            if is_method and not piece.endswith("}") and "abstract" not in piece:
                continue
            lead = re.match(r"(?:@[\w.]+(?:\([^()]*\))?\s*)*", piece).end()
            yield {"rec_type": "entity", "ord": ord_, "parent_ord": own, "name": hit.group(1),
                   "kind": "method" if is_method else "field", "line": line(where + lead)}
            ord_ += 1
    yield from _typescript_calls(text, line, blocks)


def _typescript_calls(text: str, line: Callable[[int], int], blocks: dict) -> Iterator[dict]:
    scope, parens, last_root, ord_ = [], [], "", 0
    assigned, pending = False, {}
    for m in _CHAIN.finditer(text):
        c = m.group()
        if c == "{":
            scope.append(blocks.get(m.start()) or pending.pop(m.start(), None) or ("", ""))
            assigned = False
        elif c == "}":
            if scope:
                scope.pop()
            assigned = False
        elif c in ";=\n":
            assigned = c == "="
        elif c == "(":
            parens.append("")
        elif c == ")":
            last_root = parens.pop() if parens else ""
        else:
            path = m.group(1)
            chain = [s.strip().lstrip("#") for s in _DOT.split(path)] if "." in path else [path]
            before = text[max(0, m.start() - 256):m.start()].rstrip()[-12:]
            joined = before.endswith(".")
            root = last_root if joined else (chain[0] if chain[0] != "this" else "")
            parens.append(root)
            open_at = m.end() - 1
            if not joined and (len(chain) == 1 and chain[0] in _KEYWORDS - {"constructor"} or _NOT_CALL.search(before)):
                continue
            plain = len(chain) == 1 and not joined
            after = _BODY.match(text, _close(text, open_at, "()") + 1) if plain else None
            in_class = bool(scope) and scope[-1][0] == "class" and not any(parens[:-1])
            if plain and not before.endswith("@") and (
                    (in_class and not assigned) or (after and (before[-1:] in ",{}" or before.endswith("async")))):
                if after:
                    pending[after.end() - 1] = ("function", chain[0])
                continue
            callee = chain[-1]
            if callee in ("super", "this", "") or callee in NOISE_CALLS or root in NOISE_CALLS or callee.startswith("$"):
                continue
            inner = [s[1] for s in scope if s[0] == "function"]
            outer = [s[1] for s in scope if s[0] == "class"]
            yield {"rec_type": "call", "ord": ord_, "name": callee, "line": line(m.start()),
                   "caller": (inner or outer or [None])[-1], "root": root if root and root != callee else None}
            ord_ += 1


def extract_python(source: str) -> Iterator[dict]:
    tree = ast.parse(source)
    nodes = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset))
    plain = [(a.name, []) for n in nodes if isinstance(n, ast.Import) for a in n.names]
    frm = [(n.module, [] if n.names[0].name == "*" else [a.name.split(".")[0] for a in n.names])
           for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
    for i, (spec, names) in enumerate(plain + frm):
        yield {"rec_type": "import", "ord": i, "spec": spec, "names": names, "type_only": False}
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    ord_ = 0
    for c in classes:
        own = ord_
        yield {"rec_type": "entity", "ord": own, "name": c.name, "kind": "class", "line": c.lineno,
               "modifiers": [ast.unparse(d).split("(")[0] for d in c.decorator_list]}
        ord_ += 1
        for m in c.body:
            if isinstance(m, functions):
                yield {"rec_type": "entity", "ord": ord_, "parent_ord": own, "name": m.name, "kind": "method", "line": m.lineno}
                ord_ += 1
    for f in nodes:
        if isinstance(f, functions) and not any(c.lineno < f.lineno <= c.end_lineno for c in classes):
            yield {"rec_type": "entity", "ord": ord_, "name": f.name, "kind": "function", "line": f.lineno,
                   "modifiers": [ast.unparse(d).split("(")[0] for d in f.decorator_list]}
            ord_ += 1


_JAVA_TYPE = re.compile(r"(?<![.\w$])(@?interface|class|enum|record)\s+([A-Za-z_$][\w$]*)")
_JAVA_METHOD = re.compile(r"^(?:@[\w.]+(?:\([^()]*\))?\s*)*(?:[\w.<>\[\],?&\s]*?\s)?([A-Za-z_$][\w$]*)\s*\(")
_JAVA_FIELD = re.compile(r"^(?:@[\w.]+(?:\([^()]*\))?\s*)*[\w.<>\[\],?\s]*?[\w>\]]\s+([A-Za-z_$][\w$]*)\s*(?:\[\])*\s*(?:=|,|$)")


def extract_java(source: str) -> Iterator[dict]:
    text, line = _blank(source), _lines(source)
    for n, m in enumerate(re.finditer(r"(?m)^[ \t]*import\s+(static\s+)?([\w.*]+)\s*;", text)):
        yield {"rec_type": "import", "ord": n, "spec": m.group(2), "names": [], "type_only": False, "line": line(m.start())}
    rank = {"class": 0, "interface": 1, "enum": 2, "record": 3}
    ord_ = 0
    types = [m for m in _JAVA_TYPE.finditer(text) if m.group(1) in rank]
    for m in sorted(types, key=lambda m: (rank[m.group(1)], m.start())):
        own, word = ord_, m.group(1)
        start, marks = _lead(text, m.start())
        yield {"rec_type": "entity", "ord": own, "name": m.group(2), "kind": "class" if word == "record" else word,
               "line": line(start), "modifiers": marks}
        ord_ += 1
        body = text.find("{", m.end())
        if word not in ("class", "record") or body < 0:
            continue
        for where, piece in _chunks(text, body + 1, _close(text, body)):
            method = _JAVA_METHOD.match(piece.split("=")[0])
            if re.search(r"\b(class|interface|enum|record)\s", piece.split("{")[0]):
                continue
            if method:
                names, kind = [method.group(1)], "method"
            else:
                field = _JAVA_FIELD.match(piece)
                more = re.findall(r",\s*([A-Za-z_$][\w$]*)\s*(?:=|,|$)", re.sub(r"<[^<>]*>|\([^()]*\)", "", piece)) if field else []
                names, kind = ([field.group(1), *more] if field else []), "field"
            for name in names:
                yield {"rec_type": "entity", "ord": ord_, "parent_ord": own, "name": name, "kind": kind, "line": line(where)}
                ord_ += 1


Extractor = Callable[[str], Iterator[dict]]
EXTRACTORS: dict[str, Extractor] = {
    "typescript": extract_typescript, "python": extract_python, "java": extract_java}


def extract_records(files: DataFrame, extractors: dict[str, Extractor] | None = None, call_cap: int | None = None) -> DataFrame:
    """Tagged records of ``files(ws, pkg_id, path, language, content)``.

    ``extractors`` adds languages or replaces the reader of one.  A file that cannot be read yields one ``error`` record and
    nothing else.  All calls of a file are listed, or with ``call_cap`` the first so many.
    """
    chosen = {**EXTRACTORS, **(extractors or {})}

    types = ARROW_RECORD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {f: [] for f in FIELDS}

        def emitted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(lists[f.name], f.type) for f in types], schema=types)
            for values in lists.values():
                values.clear()
            return out

        for batch in batches:
            # Few files and records at a time are Python objects, however many a batch has.
            for start in range(0, batch.num_rows, FILES_AT_ONCE):
                some = batch.slice(start, FILES_AT_ONCE).to_pydict()
                for ws, pkg, path, language, content in zip(*[some[n] for n in ("ws", "pkg_id", "path", "language", "content")]):
                    try:
                        rows = list(chosen[language](content)) if language in chosen else []
                    except (SyntaxError, ValueError, RecursionError) as error:
                        rows = [{"rec_type": "error", "ord": 0, "name": type(error).__name__}]
                    if call_cap is not None:
                        rows = [r for r in rows if r["rec_type"] != "call" or r["ord"] < call_cap]
                    for f, own in (("ws", ws), ("pkg_id", pkg), ("path", path)):
                        lists[f].extend([own] * len(rows))
                    for f in FIELDS[3:]:
                        lists[f].extend([r.get(f) for r in rows])
                    if len(lists["ws"]) >= RECORDS_AT_ONCE:
                        yield emitted()
        if lists["ws"]:
            yield emitted()
    return files.select("ws", "pkg_id", "path", "language", "content").mapInArrow(run, RECORD)


def imports_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("rec_type") == "import").select(
        "ws", "pkg_id", F.col("ord").alias("imp_ord"), F.col("path").alias("from_file"), "spec", "names", "type_only")


def entities_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("rec_type") == "entity").select(
        "ws", "pkg_id", "ord", "parent_ord", "name", "kind", F.col("path").alias("file"), "line", "modifiers")


def calls_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("rec_type") == "call").select(
        "ws", "pkg_id", F.col("ord").alias("call_ord"), F.col("path").alias("from_file"), "caller",
        F.col("name").alias("callee"), "root", "line")


def members(entities: DataFrame, cap: int | None = None) -> DataFrame:
    """Methods of each class in order: ``(ws, file, parent_ord, names)``, all or the first ``cap``."""
    own = top_n(entities.where(F.col("kind") == "method"), ["ws", "file", "parent_ord"], ["ord"], cap)
    return own.groupBy("ws", "file", "parent_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))


def collected_sources(files: DataFrame, max_bytes: int | None = None, cap: int | None = None) -> DataFrame:
    """Source files of each package: known suffix, no skipped directory; ``cap`` and then ``max_bytes`` bound them."""
    kept = files.where(P.is_source_file(F.col("path"), F.col("language"))
                       & ~P.in_skipped_dir(F.col("path"), P.INDEX_SKIP_DIRS))
    kept = top_n(kept, ["ws", "pkg_id"], ["path"], cap)
    return kept if max_bytes is None else kept.where(F.col("size") <= max_bytes)


# Annotations that say what a Java class is for.
STEREOTYPES = [
    "SpringBootApplication", "RestController", "Controller", "RestControllerAdvice", "ControllerAdvice", "Service",
    "Component", "Repository", "Configuration", "ConfigurationProperties", "Scheduled", "FeignClient", "KafkaListener",
    "RabbitListener", "StreamListener", "EventListener", "TransactionalEventListener", "Async", "EnableFeignClients",
    "EnableEurekaClient", "Mapper",
]
# Class name endings that are read first.
PRIORITY_FILE = r"(Application|Controller|Service|Client|Listener|Consumer|Producer|Config)\.java$"


def file_rank(path):
    """0 for files with a telling name, 1 for the others."""
    return F.when(path.rlike(PRIORITY_FILE), 0).otherwise(1)


def scan_budget(files: DataFrame, budget: int | None = None) -> DataFrame:
    """The files of each node an annotation scan reads: telling names first, then by name."""
    return top_n(files, ["ws", "node"], [file_rank(F.col("path")), F.col("path")], budget, rank="pos")


def annotation_profile(files: DataFrame, budget: int | None = None, caps: dict[str, int] | None = None) -> DataFrame:
    """``(ws, node, kind, value, ord)`` of ``files(ws, node, path, content)``, distinct.

    ``budget`` bounds the files of a node, ``caps`` the values of a kind.
    """
    text = F.col("content")
    first_per_line = F.filter(F.transform(
        F.split(text, "\n"), lambda l: F.regexp_extract(l, rf"@({'|'.join(STEREOTYPES)})\b", 1)), lambda s: s != "")
    args = F.regexp_extract(text, r"(?s)@FeignClient\s*\((.*?)\)", 1)
    client = F.coalesce(*[F.nullif(F.regexp_extract(args, p, 1), F.lit("")) for p in (
        r"name\s*=\s*[\"']([^\"']+)[\"']", r"value\s*=\s*[\"']([^\"']+)[\"']", r"^\s*[\"']([^\"']+)[\"']")])
    heard = F.flatten(F.transform(
        F.concat(F.regexp_extract_all(text, F.lit(r"(?s)@KafkaListener\s*\((.*?)\)"), 1),
                 F.regexp_extract_all(text, F.lit(r"(?s)@RabbitListener\s*\((.*?)\)"), 1)),
        lambda a: F.regexp_extract_all(a, F.lit(r"[\"']([^\"']+)[\"']"), 1)))
    routes = F.regexp_extract_all(text, F.lit(r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*[\"']([^\"']+)[\"']"), 1)

    def tagged(kind: str, values):
        return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("i")))
    client_list = F.when(client.isNotNull(), F.array(client)).otherwise(F.array().cast("array<string>"))
    found = F.concat(tagged("stereotype", first_per_line), tagged("client", client_list),
                     tagged("listener", heard), tagged("endpoint", routes))
    # Without a budget no file needs its number: what orders the files orders their values.
    telling = file_rank(F.col("path"))
    read = files if budget is None else scan_budget(files, budget)
    rows = inlined(read, ["ws", "node", telling.alias("_rank"), "path"], found, "kind")
    seen = rows.groupBy("ws", "node", "kind", "value").agg(F.min(F.struct("_rank", "path", "i")).alias("at"))
    ranked = top_n(seen, ["ws", "node", "kind"], ["at", "value"], max(caps.values()) if caps else None, rank="ord")
    if caps:
        cap = F.create_map(*[F.lit(x) for p in caps.items() for x in p])[F.col("kind")]
        ranked = ranked.where(F.col("ord") <= cap)
    return ranked.select("ws", "node", "kind", "value", "ord")


def insights(entries: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """What entry sources ``(ws, pkg_id, content)`` provide, listen to and register.

    Only packages with a finding are returned; sources over ``max_bytes`` are left out.
    """
    text = F.col("content")

    def either(pattern: str, *groups: int):
        hits = F.regexp_extract_all(text, F.lit(pattern), 0)
        return F.array_distinct(F.filter(F.transform(hits, lambda h: F.regexp_extract(h, r"'([^']+)'", 1)), lambda v: v != ""))
    read = entries if max_bytes is None else entries.where(F.octet_length(text) <= max_bytes)
    out = read.select(
        "ws", "pkg_id",
        either(r"ctx\.provide\(\s*'[^']+'|super\(\s*ctx\s*,\s*'[^']+'").alias("provides"),
        either(r"ctx\.on(?:ce)?\(\s*'[^']+'|@Remote\(\s*'[^']+'\)").alias("listens"),
        either(r"\.register(?:Tool)?\(\s*(?:defineTool\(\s*)?\{\s*name\s*:\s*'[^']+'|name\s*:\s*'[^']+'").alias("tools"),
        either(r"@Remote\(\s*'[^']+'\)").alias("remotes"))
    return out.where(F.greatest(*[F.size(c) for c in ("provides", "listens", "tools", "remotes")]) > 0)


REGISTRATION = (r"(ctx\.(on|provide|effect|emit|waterfall|serial|parallel|inject)\(|\.register\("
                r"|harness\.(handle|registerTool)\(|@Remote\()")


def key_lines(content, language, cap: int | None = None, width: int | None = None):
    """Registration lines of TypeScript, annotation lines of other languages."""
    rows = F.split(content, "\n")
    hit = lambda l: F.when(language == "typescript", l.rlike(REGISTRATION)).otherwise(l.rlike(r"^\s*@[A-Za-z]"))
    found = F.filter(rows, hit)
    found = F.transform(F.slice(found, 1, cap) if cap else found, lambda l: F.trim(l))
    return F.transform(found, lambda l: F.substring(l, 1, width)) if width else found


def snippet(content, lines: int | None = None, width: int | None = None):
    """The first ``lines`` of a source, each cut to ``width``; all of it by default."""
    rows = F.split(content, "\n")
    rows = F.slice(rows, 1, lines) if lines else rows
    if not width:
        return F.array_join(rows, "\n")
    return F.array_join(F.transform(rows, lambda l: F.when(
        F.length(l) > width, F.concat(F.substring(l, 1, width - 3), F.lit("…"))).otherwise(l)), "\n")
