"""Periodic runs, vector codes and benchmark windows against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factspark.llm import decontamination, periodic_runs, vector_codes
from factspark.llm.catalog import ORACLES, QUERIES

import parity


# ---- periodic runs

def plain_runs(words, least=6, times=4):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            b = i + q
            smaller = any(all(words[k] == words[k + r] for k in range(a, b - r)) for r in range(1, q))
            if b - a >= max(least, times * q) and not smaller:
                found.append((a, b - a, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_words(rng):
    kind = rng.random()
    letters = "ab" if kind < 0.4 else "abcdefgh"
    words = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
    while rng.random() < 0.6:
        part = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        words += part * rng.randint(2, 9) + part[:rng.randint(0, len(part))]
        words += [rng.choice(letters) for _ in range(rng.randint(0, 5))]
    return words


def test_runs_equal_plain_search():
    rng = random.Random(3)
    texts = [some_words(rng) for _ in range(400)] + [["a"] * n for n in range(9)] + [[]]
    got = periodic_runs.group_runs([[w.encode() for w in t] for t in texts], 6, 4)
    for words, found in zip(texts, got):
        assert [(a, b - a, q) for a, b, q in found.tolist()] == plain_runs(words), words


def test_wavelet_tree_neighbours():
    rng = np.random.default_rng(1)
    values = rng.permutation(300)
    tree = periodic_runs.WaveletTree(values)
    lo = rng.integers(0, 299, 500)
    hi = np.minimum(300, lo + rng.integers(1, 40, 500))
    x = values[rng.integers(lo, hi)]
    (has_next, nexts), (has_prior, priors) = tree.neighbours(lo, hi, x)
    for has, found, pick in ((has_next, nexts, lambda own, v: min((o for o in own if o > v), default=None)), (has_prior, priors, lambda own, v: max((o for o in own if o < v), default=None))):
        got = dict(zip(has.tolist(), found.tolist()))
        assert [got.get(k) for k in range(500)] == [pick(values[a:b].tolist(), v) for k, (a, b, v) in enumerate(zip(lo, hi, x))]


def planted(i, words):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_internal_patterns_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(some_words(rng))) for i in range(150)]
    rows += [(i, " ".join(str(rng.randint(0, 10 ** 6)) for _ in range(rng.randint(1, 300)))) for i in range(150, 400)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "a\x0bb c a\x1cb " * 20), (404, "x y " * 30), (404, "x y " * 30), (None, "z " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.asDict() for r in QUERIES["op11_internal_patterns"](spark, str(tmp_path)).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(rows)
    some = 0
    for (i, text), r in zip(rows, got):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words = words if i is None else planted(i, words)
        runs = plain_runs(words)
        some += i is not None and zlib.crc32(str(i).encode()) % 10 == 0 and bool(runs)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["doc_id"], r["n_runs"]) == (i, len(runs))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(plain_kept(words, runs)).encode()).hexdigest()
    assert some > 10


def test_runs_odd_input(spark):
    rows = spark.createDataFrame([("a b " * 6, 1, 5), (None, 2, 6), ("a b " * 6, 1, 5)], "text string, Runs int, _text int")
    got = periodic_runs.periodic_runs(rows).orderBy("_text").collect()
    assert [(r["_text"], r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (5, 12, [(0, 12, 2)], "a b"), (5, 12, [(0, 12, 2)], "a b"), (6, 0, [], "")]
    assert periodic_runs.periodic_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(rows, times=3)


def test_long_text_of_one_word():
    """Work and memory stay near linear in a text of a single word and in one without repeats."""
    assert periodic_runs.group_runs([[b"a"] * 300_000], 6, 4)[0].tolist() == [[0, 300_000, 1]]
    assert not len(periodic_runs.group_runs([[str(i).encode() for i in range(300_000)]], 6, 4)[0])


# ---- vector codes

@pytest.mark.parametrize("size", [1, 2, 5, 16, 200])
@pytest.mark.parametrize("spread", [3, 4000, 1 << 40])
def test_gnat_is_exact(size, spread):
    rng = np.random.default_rng(size)
    entries = rng.integers(-spread, spread, (size, 6))
    entries[size // 2] = entries[0]  # equal entries: the lower index wins
    x = np.concatenate([rng.integers(-spread, spread, (300, 6)), entries])
    index, exact, taken = vector_codes.nearest(entries, vector_codes.Gnat.build(vector_codes.integers(entries)), x)
    every = ((x.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(axis=2)
    assert index.tolist() == [min(range(size), key=lambda e: (row[e], e)) for row in every.tolist()]
    assert exact.tolist() == every.min(axis=1).tolist()
    assert taken <= size * len(x)


def test_gnat_leaves_subtrees_out():
    rng = np.random.default_rng(0)
    entries = np.repeat(rng.integers(-10 ** 6, 10 ** 6, (8, 8)), 32, axis=0) + rng.integers(-50, 50, (256, 8))
    x = entries[rng.integers(0, 256, 1000)] + rng.integers(-5, 5, (1000, 8))
    _, _, taken = vector_codes.nearest(entries, vector_codes.Gnat.build(entries), x)
    assert taken < 0.5 * 256 * 1000


def test_codes_equal_sql_on_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=16).round(2).tolist(), int(i) % 3 if i % 5 else None) for i in range(200)]
    odd = [(-1, None, 1), (-2, [float("nan")] + [0.0] * 15, 1), (-3, [float("inf")] + [0.0] * 15, 2), (-4, [None] + [1.0] * 15, 2), (300, [0.0] * 16, None), (300, [0.0] * 16, None)]
    spark.createDataFrame(good + odd, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    import duckdb
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES["op12_gnat_codes"](spark, str(tmp_path))
    assert parity.compare(df, db, ORACLES["op12_gnat_codes"]) == ""
    assert df.count() == 202


def test_codes_odd_input(spark):
    rows = spark.createDataFrame([(2, [1.0, 2.0], 7), (None, [0.0, 0.0], 8), (1, [1.0, 2.0, 3.0], 9), (3, [], 1)], "vec_id int, embedding array<double>, code int")
    out, books = vector_codes.compress(rows)
    # The first row has three components, so that of two goes; zeros fill up to eight.
    assert [(r.vec_id, r.code, r.error) for r in out.collect()] == [(1, "00" * 8, 0)]
    assert books.text() == "4096,8192,12288,0,0,0,0,0"
    out, books = vector_codes.compress(rows.limit(0))
    assert out.count() == 0 and books is None
    out, _ = vector_codes.compress(spark.createDataFrame([(1, [3e14] * 8), (2, [-3e14] * 8), (3, [1e30] * 8)], "vec_id int, embedding array<double>"), entries=1)
    assert [(r.vec_id, r.error) for r in out.orderBy("vec_id").collect()] == [(1, None), (2, None)]  # beyond 64 bits


# ---- benchmark windows

def plain_windows(text, size=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(words))
    return words, {tuple(words[a:a + n]) for a in range(len(words) - n + 1)} if words else set()


def plain_contaminated(docs, items, size=10):
    own = [(str(i), plain_windows(t, size)[1]) for i, t in items]
    out = []
    for i, text in docs:
        words, _ = plain_windows(text, size)
        hit, names = set(), set()
        for name, windows in own:
            for w in windows:
                for a in range(len(words) - len(w) + 1):
                    if tuple(words[a:a + len(w)]) == w:
                        hit.update(range(a, a + len(w)))
                        names.add(name)
        out.append((i, len(words), len(hit), sorted(names)))
    return out


def some_benchmark(rng):
    letters = ["a", "b", "C", "d9", "é"]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 7, 10, 11, 25])))) for i in range(12)]
    items = [(i, t if len(t) != 1 else t * 4) for i, t in items] + [(12, None), (13, items[5][1]), (2, "zz yy xx ww vv uu tt ss rr qq pp")]
    docs = []
    for i in range(60):
        words = [rng.choice(letters + ["w%d" % rng.randint(0, 300)] * 3) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = (rng.choice(items)[1] or "").split()
        docs.append((i, ", ".join(words)))
    return docs + [(60, None), (60, None), (61, ""), (62, "zz-yy (xx) WW/vv uu.tt ss rr qq")], items


def test_windows_equal_plain_search(spark):
    docs, items = some_benchmark(random.Random(5))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()) == sorted(plain_contaminated(docs, items))
    assert sum(bool(x[2]) for x in plain_contaminated(docs, items)) > 10


def test_hot_shingles_are_dealt_out(spark, monkeypatch):
    """Every shingle hot: the result is the same."""
    monkeypatch.setattr(decontamination, "HOT_SHARE", 0.0)
    docs, items = some_benchmark(random.Random(6))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()) == sorted(plain_contaminated(docs, items))


def test_share_below_one(spark):
    words = [f"t{i}" for i in range(10)]
    near, far = words[:9] + ["other"], words[:4] + ["other"] + words[5:]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 5 + near)), (2, " ".join(far)), (3, " ".join(words[:9]))], "doc_id int, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id int, text string")
    got = {r.doc_id: r.n_hit for r in decontamination.contaminated(docs, items, share=0.8).collect()}
    assert got == {1: 10, 2: 0, 3: 0}  # 7 of 8 shingles, 5 of 8, no room
    got = {r.doc_id: r.n_hit for r in decontamination.contaminated(docs, items, share=0.6).collect()}
    assert got == {1: 10, 2: 10, 3: 0}


def test_windows_odd_input(spark):
    docs = spark.createDataFrame([("a b", 1, 2, 3), (None, 1, 2, 4)], "text string, row int, Items int, own int")
    items = spark.createDataFrame([("B", None), ("b!", 5), (None, 6)], "text string, item_id int")
    got = decontamination.contaminated(docs, items)
    assert sorted(got.columns) == sorted(["row", "own", "n_words", "n_hit", "items"])
    assert [(r.own, r.n_words, r.n_hit, r["items"]) for r in got.orderBy("own").collect()] == [(3, 2, 1, ["5"]), (4, 0, 0, [])]
    assert [(r.n_hit, r["items"]) for r in decontamination.contaminated(docs, items.limit(0)).collect()] == [(0, []), (0, [])]
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in decontamination.contaminated(docs.select("text"), items).orderBy("n_words").collect()] == [0, 1]


@pytest.mark.parametrize("name", ["op12_gnat_codes", "op13_prefix_join"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert parity.compare(QUERIES[name](spark, sf), parity.connect(sf), ORACLES[name]) == ""
