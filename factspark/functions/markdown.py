"""Line structure of markdown text, resolved inside each row.

A document is one row, so its structure needs no shuffle: the lines are split
once, the headings are kept as an array, and everything else is sliced from
those two arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.functions.text import head, lines_of, trimmed

# The lines that count as headings, fences, messages and diagram parts; results must agree exactly.
HEADING = r"^(#{1,6})\s+(.+)$"
# A heading line, or a whole fenced block (to its closing fence or the end).
HEADING_OR_FENCE = r"(?m)^[ \t]*(?:#{1,6}[ \t]+\S.*|```\S*[ \t]*(?:\n(?s:.*?))(?:^[ \t]*```.*$|\z))"
FENCE_OPEN = r"^\s*```(\S*)\s*"
FENCED = r"(?s)```.*?```"
ARROW_LINE = r"^\s*(?:\d+[.、]\s+)?([^\s:>\-]+)\s*(?:->>|-->>|->|-->|→)\s*([^\s:>\-]+)\s*(?::\s*(.+))?$"
PARTICIPANT = r"^participant\s+([A-Za-z0-9_\-./]+)(?:\s+as\s+(.+))?$"
DIAGRAM_NOISE = r"(?i)^(note|activate|deactivate|loop|alt|else|opt|par|end)\b"
FLOW_SOURCE = r"\b(flowchart|graph)\s+(TD|TB|LR|RL|BT)\b"
SUBGRAPH = r"^\s*subgraph\s+(.+?)\s*$"
NODE_BEFORE_ARROW = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*(?:-->|==>|\.->)"
NODE_AFTER_ARROW = r"(?:-->|==>|\.->)\s*([A-Za-z_][A-Za-z0-9_]*)"
TABLE_RULE = r"^\s*\|[\s:|-]+\|\s*$"
FLOW_EDGE = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:-->|==>|\.->)\s*([A-Za-z_][A-Za-z0-9_]*)"
# Section titles that hold a written concept hierarchy.
CONCEPT_TITLES = ["概念层级", "概念层", "Concept Hierarchy"]


def heading_title(raw: Column, chars: int | None = None) -> Column:
    return cut(F.regexp_replace(trimmed(raw), r"[`*_]", ""), chars)


def with_headings(df: DataFrame, text: str = "text", lines: str = "lines", heads: str = "heads") -> DataFrame:
    """Add the line array and ``heads``: ``struct(at, level, raw)`` per heading, ``at`` from 0."""
    df = df.withColumn(lines, lines_of(F.col(text)))
    found = F.filter(
        F.transform(F.col(lines), lambda l, i: F.struct(i.alias("at"), trimmed(l).alias("line"))),
        lambda h: h["line"].rlike(HEADING))
    return df.withColumn(heads, F.transform(found, lambda h: F.struct(
        h["at"].alias("at"),
        F.length(F.regexp_extract(h["line"], HEADING, 1)).alias("level"),
        F.regexp_extract(h["line"], HEADING, 2).alias("raw"))))


def section_body(title: Column, lines: str = "lines", heads: str = "heads") -> Column:
    """Body of the first level-2 section with this title, to the next heading of level 1 or 2.

    NULL when there is no such section.
    """
    first = F.get(F.filter(F.col(heads), lambda h: (h["level"] == 2) & (trimmed(h["raw"]) == title)), F.lit(0))
    after = F.get(F.filter(F.col(heads), lambda h: (h["at"] > first["at"]) & (h["level"] <= 2)), F.lit(0))
    stop = F.coalesce(after["at"], F.size(lines))
    body = F.slice(F.col(lines), first["at"] + 2, stop - first["at"] - 1)
    return F.when(first.isNotNull(), trimmed(F.array_join(body, "\n")))


def concept_section(lines: str = "lines", heads: str = "heads") -> Column:
    """The first non-empty section among the titles that hold a concept hierarchy."""
    return F.coalesce(*[F.nullif(section_body(F.lit(t), lines, heads), F.lit("")) for t in CONCEPT_TITLES])


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(text, FENCED, "")


def with_flow_block(df: DataFrame, text: str, out: str = "block") -> DataFrame:
    """Add ``struct(kind, body, heading)`` of the first flow diagram or arrow text block.

    The steps are separate columns so that each array is built once per row.
    """
    df = df.withColumn("_parts", F.regexp_extract_all(text, F.lit(HEADING_OR_FENCE), 0))
    df = df.withColumn("_fences", F.filter(
        F.transform("_parts", lambda p, i: F.struct(i.alias("at"), F.regexp_extract(p, FENCE_OPEN, 1).alias("lang"), p.alias("raw"))),
        lambda b: b["raw"].rlike(r"^\s*```") & (
            (b["lang"].isin("mermaid", "") & b["raw"].rlike(FLOW_SOURCE))
            | (b["lang"].isin("text", "txt") & F.contains(b["raw"], F.lit("->"))))))
    df = df.withColumn("_hit", F.get("_fences", F.lit(0)))
    inner = F.regexp_replace(F.regexp_replace(F.col("_hit.raw"), r"^\s*```[^\n]*\n", ""), r"(^|\n)[ \t]*```[^\n]*$", "")
    before = F.filter(F.slice("_parts", F.lit(1), F.coalesce(F.col("_hit.at"), F.lit(0))), lambda p: ~p.rlike(r"^\s*```"))
    df = df.withColumn("_before", F.element_at(F.concat(F.array(F.lit("# ")), before), -1))
    heading = heading_title(F.regexp_replace(trimmed(F.col("_before")), r"^#{1,6}\s*", ""))
    return df.withColumn(out, F.when(F.col("_hit").isNotNull(), F.struct(
        F.when(F.col("_hit.lang").isin("mermaid", ""), "mermaid").otherwise("pseudo").alias("kind"),
        trimmed(inner).alias("body"), heading.alias("heading")))).drop("_parts", "_fences", "_hit", "_before")


def anchor(doc: Column, heading: Column) -> Column:
    name = F.when(heading == "", F.lit("top")).otherwise(F.regexp_replace(heading, r"\s+", "-"))
    return F.concat(doc, F.lit("#"), name)


def cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else head(text, chars)


def with_messages(df: DataFrame, text: str, out: str = "messages", limit: int | None = None,
                  label_chars: int | None = None) -> DataFrame:
    """Add messages ``struct(src, dst, label)`` of a diagram or of plain arrow lines.

    A participant's alias holds from its own line on.  The steps are separate
    columns so that each array is built once per row.
    """
    block = r"(?s)```mermaid\s*\n(.*?)```"
    df = df.withColumn("_in", F.col(text).rlike(block))
    df = df.withColumn("_rows", F.transform(
        lines_of(F.when(F.col("_in"), F.regexp_extract(text, block, 1)).otherwise(F.col(text))),
        lambda l, i: F.struct(i.alias("at"), trimmed(l).alias("line"))))
    df = df.withColumn("_names", F.when(F.col("_in"), F.transform(
        F.filter("_rows", lambda r: r["line"].rlike(PARTICIPANT) & (F.regexp_extract(r["line"], PARTICIPANT, 2) != "")),
        lambda r: F.struct(r["at"].alias("at"), F.regexp_extract(r["line"], PARTICIPANT, 1).alias("id"),
                           trimmed(F.regexp_extract(r["line"], PARTICIPANT, 2)).alias("name"))))
        .otherwise(F.array().cast("array<struct<at:int,id:string,name:string>>")))
    df = df.withColumn("_said", F.transform(
        F.filter("_rows", lambda r: r["line"].rlike(ARROW_LINE) & ~F.startswith(r["line"], F.lit("```"))
                 & ~(F.col("_in") & (r["line"].rlike(PARTICIPANT) | r["line"].rlike(DIAGRAM_NOISE)))),
        lambda r: F.struct(r["at"].alias("at"), F.regexp_extract(r["line"], ARROW_LINE, 1).alias("a"),
                           F.regexp_extract(r["line"], ARROW_LINE, 2).alias("b"),
                           cut(trimmed(F.regexp_extract(r["line"], ARROW_LINE, 3)), label_chars).alias("label"))))

    def named(r: Column, raw: str) -> Column:
        own = F.filter("_names", lambda n: (n["id"] == r[raw]) & (n["at"] < r["at"]))
        return F.element_at(F.concat(F.array(r[raw]), F.transform(own, lambda n: n["name"])), -1)
    found = F.filter(F.transform("_said", lambda r: F.struct(
        named(r, "a").alias("src"), named(r, "b").alias("dst"), r["label"].alias("label"))), lambda m: m["src"] != m["dst"])
    df = df.withColumn(out, found if limit is None else F.slice(found, 1, limit))
    return df.drop("_in", "_rows", "_names", "_said")


def table_cells(line: Column) -> Column:
    """Non-empty cells of a table row; an empty array for other lines."""
    row = trimmed(line)
    inner = F.regexp_replace(F.regexp_replace(row, r"^\|", ""), r"\|$", "")
    cells = F.filter(F.transform(F.split(inner, r"\|"),
                                 lambda c: F.regexp_replace(trimmed(c), r"^`+|`+$", "")), lambda c: c != "")
    return F.when(F.startswith(row, F.lit("|")), cells).otherwise(F.array().cast("array<string>"))


def call_table_edges(df: DataFrame, prose: str, out: str = "table_edges") -> DataFrame:
    """Add ``out``: ``struct(ord, src, dst)`` for each row of each caller/callee table."""
    def first_at(cells: Column, pattern: str) -> Column:
        return F.array_position(F.transform(cells, lambda c: c.rlike(pattern)), F.lit(True)).cast("int")
    df = df.withColumn("_raw", lines_of(F.col(prose)))
    df = df.withColumn("_cells", F.transform("_raw", table_cells))
    df = df.withColumn("_from", F.transform("_cells", lambda c: first_at(c, r"(?i)调用方|caller|from")))
    df = df.withColumn("_to", F.transform("_cells", lambda c: first_at(c, r"(?i)被调用方|callee|to")))
    df = df.withColumn("_tops", F.filter(
        F.transform("_cells", lambda c, i: F.struct(
            i.alias("at"), F.get("_from", i).alias("f"), F.get("_to", i).alias("t"))),
        lambda h: (F.size(F.get("_cells", h["at"])) >= 2) & (h["f"] > 0) & (h["t"] > 0) & (h["f"] != h["t"])
        & F.coalesce(F.get("_raw", h["at"] + 1), F.lit("")).rlike(TABLE_RULE)))

    def rows_of(h: Column) -> Column:
        rest = F.slice("_cells", h["at"] + 3, F.greatest(F.size("_cells") - h["at"] - 2, F.lit(0)))
        short = F.array_position(F.transform(rest, lambda c: F.size(c) < 2), F.lit(True)).cast("int")
        body = F.when(short > 0, F.slice(rest, F.lit(1), short - 1)).otherwise(rest)
        pairs = F.transform(body, lambda c, i: F.struct(
            (h["at"] + 2 + i).alias("ord"), F.get(c, h["f"] - 1).alias("src"), F.get(c, h["t"] - 1).alias("dst")))
        return F.filter(pairs, lambda p: p["src"].isNotNull() & p["dst"].isNotNull())
    return (df.withColumn(out, F.flatten(F.transform("_tops", rows_of)))
            .drop("_raw", "_cells", "_from", "_to", "_tops"))


def subgraph_titles(source: Column) -> Column:
    hits = F.filter(lines_of(source), lambda l: l.rlike(SUBGRAPH))
    return F.transform(hits, lambda l: F.regexp_replace(trimmed(F.regexp_extract(l, SUBGRAPH, 1)), r"[\"']", ""))


def subgraph_block(source: Column, stage: Column) -> Column:
    """The nested block of one stage; the whole source when it cannot be isolated."""
    rows = lines_of(source)
    wanted = F.regexp_replace(trimmed(stage), r"[\"']", "")
    marks = F.transform(rows, lambda l: F.regexp_replace(trimmed(F.regexp_extract(l, SUBGRAPH, 1)), r"[\"']", "") == wanted)
    start = F.array_position(marks, F.lit(True)).cast("int")
    rest = F.slice(rows, start, F.size(rows) - start + 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("stop"))

    def walk(acc: Column, l: Column) -> Column:
        opens = l.rlike(r"^\s*subgraph\b")
        closes = l.rlike(r"^\s*end\s*$")
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        at = acc["at"] + 1
        stop = F.when((acc["stop"] == 0) & closes & (depth == 0), at).otherwise(acc["stop"])
        return F.struct(depth.alias("depth"), at.alias("at"), stop.alias("stop"))
    stop = F.aggregate(rest, zero, walk)["stop"]
    return F.when((stage != "") & (start > 0) & (stop > 0), F.array_join(F.slice(rest, F.lit(1), stop), "\n")).otherwise(source)


def block_node_ids(block: Column) -> Column:
    left = F.regexp_extract_all(block, F.lit(NODE_BEFORE_ARROW), 1)
    right = F.regexp_extract_all(block, F.lit(NODE_AFTER_ARROW), 1)
    return F.array_distinct(F.concat(left, right))


def touching_edges(source: Column, ids: Column, limit: int | None = None) -> Column:
    hits = F.filter(lines_of(source), lambda l: l.rlike(FLOW_EDGE) & F.arrays_overlap(
        ids, F.array(F.regexp_extract(l, FLOW_EDGE, 1), F.regexp_extract(l, FLOW_EDGE, 2))))
    out = F.transform(hits, trimmed)
    return out if limit is None else F.slice(out, 1, limit)
