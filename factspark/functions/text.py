"""Text functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that trimming removes.
WHITESPACE = " \t\n\r\x0b\x0c\u00a0\ufeff"
# Names that start a language switch row.
LANGUAGE_NAMES = ["English", "中文", "简体中文", "繁体中文", "日本語", "한국어",
                  "Deutsch", "Français", "Español", "Русский"]
# Label words that are not symbols.
SYMBOL_STOP_WORDS = ["the", "and", "for", "with", "from", "into", "call", "calls", "via",
                     "using", "this", "that"]
# Call symbols without any signal about structure.
NOISE_CALLS = [
    "console", "require", "process", "Object", "Array", "String", "Number",
    "Boolean", "JSON", "Math", "Date", "Promise", "RegExp", "Map", "Set",
    "Symbol", "Error", "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "parseInt", "parseFloat", "isNaN", "isFinite", "fetch", "structuredClone",
    "queueMicrotask", "encodeURIComponent", "decodeURIComponent",
]
# The texts that count as a link, a note heading and an identifier; results must agree exactly.
INLINE_LINK = r"""(?<!!)\[[^\]]*\]\(\s*<?([^<>()\s]+)>?(?:\s+["'][^"']*["'])?\s*\)"""
NOTE_HEADING = r"^## \[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})?)\] \((.*?)\)(.*)$"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]{2,}"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def head(value: Column, n: int) -> Column:
    return F.substring(value, 1, n)


def first_paragraph(text: Column, limit: int = 220) -> Column:
    """First line that is prose: no heading, comment, fence or language switch."""
    switch = r"^\[?(" + "|".join(LANGUAGE_NAMES) + r")(\]\([^)]*\))?\s*\|"
    kept = F.filter(
        F.transform(lines_of(text), trimmed),
        lambda s: (F.length(s) > 0) & ~s.rlike(r"^(#|<!--|```)") & ~s.rlike(switch))
    return F.coalesce(head(F.get(kept, F.lit(0)), limit), F.lit(""))


def one_line(text: Column, limit: int = 160) -> Column:
    flat = trimmed(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(head(flat, limit), F.lit("…"))).otherwise(flat)


def tail(text: Column, n: int = 300) -> Column:
    return F.right(text, F.lit(n))


def bounded_head(content: Column, size: Column, n: int, max_bytes: int = 262144) -> Column:
    """First ``n`` characters of a file; '' when the file is over the size bound."""
    return F.when(size <= max_bytes, head(content, n)).otherwise(F.lit(""))


def symbols_in(label: Column) -> Column:
    """Distinct identifiers of three characters or more, stop words removed."""
    found = F.regexp_extract_all(label, F.lit(IDENTIFIER), 0)
    return F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin(SYMBOL_STOP_WORDS)))


def djb2_base36(text: Column) -> Column:
    """32-bit djb2 over UTF-16 units of BMP text, in base 36."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.aggregate(chars, F.lit(5381).cast("long"),
                        lambda acc, c: (acc * 33 + F.ascii(c)) % F.lit(4294967296))
    return F.lower(F.conv(total.cast("string"), 10, 36))


def safe_name(name: Column, limit: int = 32) -> Column:
    cleaned = head(F.regexp_replace(name, r"[^A-Za-z0-9_-]", ""), limit)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("default"))


def md_links(text: Column) -> Column:
    """Workspace-relative markdown targets of a document's inline links."""
    raw = F.regexp_extract_all(text, F.lit(INLINE_LINK), 1)

    def clean(target: Column) -> Column:
        bare = F.regexp_replace(target, r"#.*$", "")
        decoded = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
        return F.coalesce(decoded, bare)
    kept = F.filter(
        F.transform(raw, clean),
        lambda t: (t != "") & ~t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") & ~F.startswith(t, F.lit("//"))
        & F.endswith(F.lower(t), F.lit(".md")))
    return F.transform(kept, lambda t: F.regexp_replace(t, r"^/", ""))


def edge_target_key(src: Column, dst: Column, label: Column) -> Column:
    blank = F.lit("")
    return F.concat(F.lit("seq:"), F.coalesce(src, blank), F.lit("|"), F.coalesce(dst, blank),
                    F.lit("|"), F.coalesce(label, blank))


def target_key_endpoints(key: Column) -> Column:
    """Non-empty endpoints of a ``seq:from|to|label`` key."""
    parts = F.slice(F.split(F.regexp_replace(key, r"^seq:", ""), r"\|"), 1, 2)
    return F.filter(parts, lambda p: p != "")


def text_blocks(content: Column) -> Column:
    """Concatenated ``text`` blocks of a message's content array."""
    return F.array_join(
        F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def note_fields(line: Column) -> Column:
    """``struct(time, target, rest)`` of a note heading; NULL for other lines."""
    return F.when(line.rlike(NOTE_HEADING), F.struct(
        F.regexp_extract(line, NOTE_HEADING, 1).alias("time"),
        F.regexp_extract(line, NOTE_HEADING, 2).alias("target"),
        trimmed(F.regexp_extract(line, NOTE_HEADING, 3)).alias("rest")))


def token_estimate(text: Column) -> Column:
    """``ceil(ascii/4 + other/1.5)`` in whole-number arithmetic."""
    ascii_n = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")).cast("long")
    other_n = F.length(text).cast("long") - ascii_n
    return F.floor((3 * ascii_n + 8 * other_n + 11) / 12).cast("long")


def is_noise_call(callee: Column, root: Column) -> Column:
    return (callee.isin(NOISE_CALLS) | F.coalesce(root.isin(NOISE_CALLS), F.lit(False))
            | F.startswith(callee, F.lit("$")))


def first_nonblank(*values: Column) -> Column:
    """The first value that is neither NULL nor ''; '' if there is none."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def symbol_evidence(symbols: Column, total: Column | None = None, shown: int = 3, kept: int | None = None) -> Column:
    """What an edge says about its symbols: some shown, all (or ``kept`` of them) kept, the rest counted."""
    total = F.size(symbols).cast("long") if total is None else total
    return F.struct(
        F.slice(symbols, 1, shown).alias("shown"),
        F.when(total > shown, F.slice(symbols, 1, kept) if kept else symbols).alias("kept"),
        F.greatest(total - shown, F.lit(0)).cast("long").alias("more"))
