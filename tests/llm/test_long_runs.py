"""No pattern ends an executor or stalls on a very long run of one kind, and what patterns mean is unchanged."""

import re
import time

from pyspark.sql import functions as F

from factspark.llm import quality, secrets

SIZE = 1_000_000
PLAIN = " ".join(f"word{i}." for i in range(60))


def test_quality_of_long_lines(spark):
    """60 plain words and a line of captions, of one word, of one letter or of symbols; 1 MB each."""
    lines = ["top " * (SIZE // 4), "home|" * (SIZE // 5), "about us " * (SIZE // 9), "a" * SIZE, "word " * (SIZE // 5), "- " * (SIZE // 2), "top" * (SIZE // 3) + "x"]
    docs = spark.createDataFrame([(i, f"{PLAIN}\n{line}") for i, line in enumerate(lines)], "doc_id int, text string")
    got = {r.doc_id: r for r in quality.clean_lines(docs).select("doc_id", "clean_text", "kept").collect()}
    for i in (0, 1, 2, 4, 5):
        assert got[i].clean_text == PLAIN, i
    assert got[3].clean_text == f"{PLAIN}\n{lines[3]}"  # one long word breaks no rule


def test_navigation_lines(spark):
    lines = ["Home | About us | Contact", "Sign in > Register", "top", "skip to content - Read more", "site map sitemap", "» • ·", "-", "home sweet home", "tops", "x home", "Help FAQ!"]
    want = [bool(re.search(quality.NAVIGATION.replace(r"\x{00bb}", "»").replace(r"\x{2022}", "•").replace(r"\x{00b7}", "·"), x)) for x in lines]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    found = rows.select("i", (F.col("line").rlike(quality.CAPTION) & (F.regexp_replace("line", quality.NAVIGATION_PART, "") == "")).alias("nav")).orderBy("i").collect()
    assert [r.nav for r in found] == want


def test_loss_counts_repeated_lines(spark):
    """40 % of the text in repeats of a line and 20 % in failing lines: 40 % stay, so the document goes; with 10 % failing it stays."""
    once = [f"alpha{i} beta{i} gamma{i} delta{i}, zeta{i}." for i in range(20)] + ["repeated" * 10 + "."]
    again, bad = [once[-1]] * 8, [f"failing{i}line" + "$" * 20 for i in range(10)]
    docs = spark.createDataFrame([(1, "\n".join(once + again + bad)), (2, "\n".join(once + again[:5] + bad[:5]))], "doc_id int, text string")
    got = {r.doc_id: r for r in quality.clean_lines(docs).collect()}
    assert not got[1].base_failed and not got[2].base_failed
    share = {i: len(re.sub(r"\s", "", r.clean_text)) / r.word_chars for i, r in got.items()}
    assert share[1] < 0.5 < share[2]
    assert (got[1].kept, got[2].kept) == (False, True)


def timed(spark, text, use):
    begin = time.perf_counter()
    use(spark.createDataFrame([(text, "a")], "text string, source string")).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def test_secret_scans_take_linear_time(spark):
    spans = lambda d: secrets.secret_spans(d)
    timed(spark, "warm", spans)
    for unit in ("a", "acgt", "eyJ", "sk-", "token ", "a://", "x:y@", "0", "password=", "://a"):
        assert timed(spark, unit * (SIZE // len(unit)), spans) < 40, unit
    for unit in ("change-me-your-", "x", "Ab1-change-me"):
        assert timed(spark, unit * (SIZE // len(unit)), secrets.redact) < 40, unit


def test_login_and_signed_spans(spark):
    live = "Zx9!kQ2pLw7"
    texts = [f"see http://bob:{live}@host and 1https://eve:{live}@h", "eyJhbGciOi9.eyJzdWIiOiI3.Sfl-KxwRJSMe3 xeyJhbGciOi9.eyJzdWIiOiI3.Sfl-KxwRJSMe3"]
    rows = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start:s.end]) for s in r.spans] for r in secrets.secret_spans(rows).collect()}
    assert got[0] == [("login", f"http://bob:{live}@")]
    assert [s for s in got[1] if s[0] == "signed"] == [("signed", "eyJhbGciOi9.eyJzdWIiOiI3.Sfl-KxwRJSMe3")]


def test_placeholders(spark):
    whole = ["change-me", "your_api_key", "XXXX", "password123", "00000000", "example.key", "my-secret-token", "", "-change", "change-me-9fK"]
    old = re.compile(r"(?i)^(?:(?:example|sample|dummy|change|placeholder|your|my|the|insert|enter|here|api|access|secret|private|key|token|password|passwd|me|x{3,}|0{3,}|1234567[0-9]*)[+/_.=-]*)+$")
    rows = spark.createDataFrame(list(enumerate(whole)), "i int, v string")
    assert [r.p for r in rows.select("i", secrets.is_placeholder(F.col("v")).alias("p")).orderBy("i").collect()] == [bool(old.match(v)) for v in whole]
