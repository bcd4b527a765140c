"""Quality rules: clean line by line first, then reject documents that lose too much text.

DataFrame functions only.  Everything happens within a document's row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm.common import WORD, bound, table, text_of
from factspark.llm.registry import query


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; a line that breaks one is removed.

    ``max_symbol_ratio``: symbols of ``[#*$%&|<>]`` per word.  ``min_word_ratio``: distinct words
    per word in lines of ``long_line`` words or more.  ``bare_words``: a line of so many words or more
    must hold a mark of ``.!?:;,`` and the like somewhere (prose of that length has one).
    ``shout_ratio``: share of ``!!`` per word.  ``navigation`` lines consist of link captions and
    separators alone; ``boilerplate`` lines are at most ``boiler_words`` words long and match a phrase.
    ``max_loss``: a document that loses more than this share of its word characters is rejected.
    """

    max_symbol_ratio: float = 0.25
    min_word_ratio: float = 0.2
    long_line: int = 20
    bare_words: int = 40
    shout_ratio: float = 0.5
    boiler_words: int = 30
    max_loss: float = 0.5


MARK = r"[.!?:;,\x{2026}\x{3002}\x{ff01}\x{ff1f}\x{061f}]"
_CAPTION = (r"home|about( us)?|contact( us)?|login|log in|sign (in|up)|register|menu|search|next|previous|back|"
            r"share|site ?map|help|faq|read more|skip to content|top")
_BETWEEN = r"[\s|>/\x{00bb}\x{2022}\x{00b7}-]"
#: A line that begins with a link caption, and captions and separators.  What remains of a navigation line without these is empty; to match the line as a whole would
#: repeat a group, which costs the JVM's regular expressions a stack frame a caption.
CAPTION, NAVIGATION_PART = f"(?i)^{_BETWEEN}*({_CAPTION})", f"(?i){_CAPTION}|{_BETWEEN}+"
NAVIGATION = f"(?i)^{_BETWEEN}*(({_CAPTION}){_BETWEEN}*)+$"
BOILERPLATE = (r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|use(s)? cookies|enable javascript|"
               r"javascript (is )?(disabled|required)|lorem ipsum|subscribe to our newsletter|click here to|powered by wordpress)")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def chars(items: Column) -> Column:
    """Code points in all strings of an array."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda n, w: n + F.char_length(w))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def repeated_words(items: Column) -> Column:
    """Words that lie in a 3-word window found twice or more among the windows of ``items``.

    Windows are compared by their 64-bit hash: sorted with their places, equal neighbours are the
    repeats; the places then cover ``min(3, distance to the next)`` words each.
    """
    def by_windows(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(
            F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")))

        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (
                (k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < F.size(s)) & (F.get(s, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, i: F.struct(
                i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])

        return bound(bound(F.array_sort(windows), places), covered)

    return F.when(F.size(items) < 4, F.lit(0).cast("long")).otherwise(bound(items, by_windows))


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line breaks a punctuation, symbol, repetition, navigation or boilerplate rule."""
    def judge(w: Column) -> Column:
        n = F.size(w)
        symbols = F.char_length(line) - F.char_length(F.regexp_replace(line, "[#*$%&|<>]", ""))
        shouts = (F.char_length(line) - F.char_length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
        return ((symbols > rules.max_symbol_ratio * n)
                | (shouts > rules.shout_ratio * n)
                | ((n >= rules.long_line) & (F.size(F.array_distinct(w)) < rules.min_word_ratio * n))
                | ((n >= rules.bare_words) & ~line.rlike(MARK))
                | (line.rlike(CAPTION) & (F.regexp_replace(line, NAVIGATION_PART, "") == ""))
                | ((n <= rules.boiler_words) & line.rlike(BOILERPLATE)))

    return bound(words(line), judge)


def clean_lines(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Add to every row: clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    ``clean_text`` holds the lines that pass every line rule, in order; of lines that repeat an
    earlier one the first stays.  ``kept`` is false if ``base_failed`` or if the removed lines, repeats
    included, hold more than ``max_loss`` of the document's word characters.  Null text counts as empty: zero words, not kept.
    Input columns of these names are replaced; rows are never dropped, repeated rows stay repeated.
    """
    made = ["clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    whole = text_of(F.col(text))

    def facts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), chars(w).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n"), F.array_distinct(ls).alias("once"))

    rest = docs.drop(*[c for c in docs.columns if c.lower() in made])
    out = rest.withColumn("_w", bound(words(whole), facts)).withColumn("_l", bound(lines_with_words(whole), lines))
    out = out.withColumn("_good", F.filter("_l.once", lambda line: ~line_fails(line, rules)))
    left = bound(F.col("_good"), lambda good: F.struct(
        F.array_join(good, "\n").alias("clean_text"),
        F.aggregate(good, F.lit(0).cast("long"), lambda n, line: n + F.char_length(F.regexp_replace(line, r"[\x20\x09-\x0D]", ""))).alias("chars")))
    out = out.withColumn("_left", left)
    failed = (F.col("_w.n_words") < 50) | (100 * F.col("_w.n_repeat_words") > 50 * F.col("_w.n_words"))
    return out.select(
        *[F.col(f"`{c}`") for c in rest.columns], F.col("_left.clean_text"), "_w.n_words", "_w.word_chars",
        (F.char_length(whole) - F.char_length(F.regexp_replace(whole, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.col("_l.n") - F.size("_l.once")).cast("long").alias("n_dup_lines"), "_w.n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("_left.chars") >= (1 - rules.max_loss) * F.col("_w.word_chars"))).alias("kept"))


_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS win FROM d WHERE len(w) >= 4),
k AS (SELECT rid, unnest(win) AS h, unnest(range(1, len(win) + 1)) AS i FROM g),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM k),
p AS (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS cover FROM c WHERE n > 1),
r AS (SELECT rid, sum(cover) AS n FROM p GROUP BY rid),
l AS (SELECT rid, unnest(list_distinct(ls)) AS line FROM d),
m AS (SELECT rid, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS v, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l),
s AS (SELECT rid, coalesce(sum(chars) FILTER (WHERE NOT (
        length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > 0.25 * len(v)
        OR (length(line) - length(replace(line, '!!', ''))) / 2 > 0.5 * len(v)
        OR (len(v) >= 20 AND len(list_distinct(v)) < 0.2 * len(v))
        OR (len(v) >= 40 AND NOT regexp_matches(line, '{mark}'))
        OR regexp_matches(line, '{navigation}')
        OR (len(v) <= 30 AND regexp_matches(line, '{boilerplate}')))), 0) AS good FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed,
       NOT (len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w)) AND coalesce(s.good, 0) >= 0.5 * length(array_to_string(w, '')) AS kept
FROM d LEFT JOIN r USING (rid) LEFT JOIN s USING (rid)
""".replace("{mark}", MARK).replace("{navigation}", NAVIGATION).replace("{boilerplate}", BOILERPLATE)


@query("op10_line_quality", _SQL)
def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the base counts and verdict, and the verdict after line-first cleaning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
