"""JSON inside model answers: locate it, parse it, keep what is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factspark.functions.text import head, trimmed

# The dispatch modes an event may have.
EVENT_MODES = ["emit", "waterfall", "serial", "parallel"]
MESSAGES_JSON = "array<struct<`from`:string,`to`:string,label:string>>"
EVENTS_JSON = "array<struct<event:string,mode:string,producers:array<string>,consumers:array<string>,note:string>>"
TREE_JSON = ("array<struct<name:string,`desc`:string,children:array<struct<name:string,`desc`:string,"
             "children:array<struct<name:string,`desc`:string>>>>>>")


def json_value(text: Column) -> Column:
    """A text as a variant whose element 0 is its JSON value; NULL unless the text is one value and nothing else.

    The parser stops after a value and takes no notice of what follows.  A second element behind the text shows that all of it was read.
    """
    value = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"end"]')))
    return F.when(F.try_variant_get(value, "$[1]", "string") == "end", value)


def outermost_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` if that is valid JSON, else NULL."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(json_value(F.nullif(body, F.lit(""))).isNotNull(), body)


def outermost_array(text: Column) -> Column:
    body = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(json_value(F.nullif(body, F.lit(""))).isNotNull(), body)


def _object_with_id(body: Column, wanted: Column) -> Column:
    """Whether a text is a JSON object whose ``figId`` is that string.  Texts that cannot have the key are not parsed."""
    def judge(value: Column) -> Column:
        own = F.try_variant_get(value, "$[0].figId", "variant")
        return (F.try_variant_get(value, "$[1]", "string") == "end") & (F.try_variant_get(own, "$", "string") == wanted) & (F.schema_of_variant(own) == "STRING")

    # An array of one, so that the text is parsed once.
    parsed = F.transform(F.array(F.try_parse_json(F.concat(F.lit("["), body, F.lit(',"end"]')))), judge)
    may = F.startswith(body, F.lit("{")) & (F.contains(body, F.lit("figId")) | F.contains(body, F.lit("\\u")))
    return F.when(may, F.coalesce(F.get(parsed, F.lit(0)), F.lit(False))).otherwise(F.lit(False))


def balanced_objects(answers: DataFrame, key: str = "id", text: str = "text", wanted: str = "id", max_starts: int | None = None) -> DataFrame:
    """Add ``found`` to every row: the JSON text of the object in its ``text`` that carries the id ``wanted``; NULL if there is none.

    Fenced blocks are looked at before the whole text, in each the whole before its parts, and of these the one that opens last
    (of the last ``max_starts``).  ``key`` is unique.  Brackets are rows: a running depth gives each its level, and an opening
    bracket closes at the next bracket of its level.  That is one sort of the brackets, however they nest; texts do not take part.
    """
    fenced = F.regexp_extract_all(text, F.lit(r"```(?:json)?\s*\n([\s\S]*?)```"), 1)
    bodies = answers.where(F.col(text).isNotNull()).select(key, F.col(wanted).alias("_wanted"), F.posexplode(F.concat(fenced, F.array(text))).alias("_part", "_body"))
    # Each mark is a bracket and the text up to the next one; their lengths add up to places.
    marks = bodies.select(key, "_part", F.length(F.regexp_extract("_body", r"^[^{}]*", 0)).alias("_lead"),
                          F.posexplode(F.transform(F.regexp_extract_all("_body", F.lit(r"[{}][^{}]*"), 0), lambda m: F.struct(
                              F.startswith(m, F.lit("{")).alias("open"), F.length(m).alias("size")))).alias("_i", "_m"))
    run = Window.partitionBy(key, "_part").orderBy("_i")
    sign = F.when(F.col("_m.open"), 1).otherwise(-1)
    marks = marks.select(key, "_part", "_m.open", (F.col("_lead") + F.sum("_m.size").over(run) - F.col("_m.size") + 1).alias("at"),
                         (F.sum(sign).over(run) + F.when(F.col("_m.open"), 0).otherwise(1)).alias("level"))
    level = Window.partitionBy(key, "_part", "level").orderBy("at")
    spans = marks.withColumn("end", F.lead("at").over(level)).where("open AND end IS NOT NULL")
    spans = spans.groupBy(key, "_part").agg(F.sort_array(F.collect_list(F.struct("at", "end")), asc=False).alias("_spans"))
    whole = trimmed(F.col("_body"))
    shown = F.col("_spans") if max_starts is None else F.slice("_spans", 1, max_starts)
    parts = F.transform(shown, lambda s: F.substring(F.col("_body"), s["at"].cast("int"), (s["end"] - s["at"] + 1).cast("int")))
    tried = F.concat(F.when(F.endswith(whole, F.lit("}")), F.array(whole)).otherwise(F.array().cast("array<string>")), F.coalesce(parts, F.array().cast("array<string>")))
    hits = bodies.join(spans, [key, "_part"], "left").select(key, "_part", "_wanted", tried.alias("_tried"))
    hits = hits.select(key, "_part", F.get(F.filter("_tried", lambda b: _object_with_id(b, F.col("_wanted"))), F.lit(0)).alias("_hit")).where("_hit IS NOT NULL")
    first = hits.groupBy(key).agg(F.min_by("_hit", "_part").alias("found"))
    return answers.join(first, key, "left")


def cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else head(text, chars)


def clean_messages(raw: Column, known_ids: Column, limit: int | None = None, label_chars: int | None = None) -> Column:
    """Messages between known, different ids with a label."""
    ok = F.filter(raw, lambda m: F.array_contains(known_ids, m["from"]) & F.array_contains(known_ids, m["to"])
                  & (m["from"] != m["to"]) & (trimmed(m["label"]) != ""))
    out = F.transform(ok, lambda m: F.struct(
        m["from"].alias("src"), m["to"].alias("dst"), cut(trimmed(m["label"]), label_chars).alias("label")))
    return out if limit is None else F.slice(out, 1, limit)


def clean_events(raw: Column, limit: int | None = None, parties: int | None = None, name_chars: int | None = None,
                 note_chars: int | None = None) -> Column:
    """Named events; an unknown mode becomes ``emit``.  The bounds are for readers with little room."""
    def party(names: Column) -> Column:
        named = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull())
        return named if parties is None else F.slice(named, 1, parties)
    ok = F.filter(raw, lambda e: trimmed(F.coalesce(e["event"], F.lit(""))) != "")
    out = F.transform(ok, lambda e: F.struct(
        cut(trimmed(e["event"]), name_chars).alias("event"),
        F.when(e["mode"].isin(EVENT_MODES), e["mode"]).otherwise("emit").alias("mode"),
        party(e["producers"]).alias("producers"), party(e["consumers"]).alias("consumers"),
        cut(F.coalesce(e["note"], F.lit("")), note_chars).alias("note")))
    return out if limit is None else F.slice(out, 1, limit)


def clean_tree(raw: Column, per_level: int | None = None, name_chars: int | None = None,
               descr_chars: int | None = None) -> Column:
    """Named nodes to depth three, as ``struct(path, depth, name, descr)`` in order."""
    def level(nodes: Column, prefix: Column, depth: int) -> Column:
        numbered = F.transform(nodes, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
        named = F.filter(numbered, lambda x: trimmed(F.coalesce(x["n"]["name"], F.lit(""))) != "")
        named = named if per_level is None else F.slice(named, 1, per_level)

        def one(x: Column) -> Column:
            path = F.concat(prefix, F.lit("-"), F.lit(str(depth)), F.lit("-"), x["i"].cast("string"))
            own = F.array(F.struct(
                path.alias("path"), F.lit(depth).alias("depth"),
                cut(trimmed(x["n"]["name"]), name_chars).alias("name"),
                cut(F.coalesce(x["n"]["desc"], F.lit("")), descr_chars).alias("descr")))
            if depth == 2:
                return own
            below = level(F.coalesce(x["n"]["children"], F.array()), path, depth + 1)
            return F.concat(own, below)
        return F.flatten(F.transform(named, one))
    return level(raw, F.lit("t"), 0)


def clean_ids(raw: Column, known_ids: Column, limit: int | None = None) -> Column:
    out = F.filter(F.array_distinct(raw), lambda i: F.array_contains(known_ids, i))
    return out if limit is None else F.slice(out, 1, limit)


def billed_usage(input_tokens: Column, output_tokens: Column, cache_read: Column, cache_write: Column) -> Column:
    """``struct(in_tokens, out_tokens)``; NULL when the provider reported nothing."""
    zero = F.lit(0)
    return F.when(input_tokens.isNotNull(), F.struct(
        (input_tokens + F.coalesce(cache_read, zero) + F.coalesce(cache_write, zero)).cast("long").alias("in_tokens"),
        output_tokens.cast("long").alias("out_tokens")))
