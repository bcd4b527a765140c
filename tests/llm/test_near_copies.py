"""Near copies of texts against all pairs: lone pairs at and about the threshold, and pairs inside a template family."""

import itertools
import random

import numpy as np

from factspark.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def kept(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.one_of_each(rows).collect()}


def expected(texts, similarity=0.8):
    """The least of every component over all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= similarity:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {top(x) for x in range(len(texts))}


def test_lone_pairs(spark):
    rng, texts, alike = random.Random(3), [], []
    # 180 shingles each; 160 in common are exactly 0.8, 159 are less.
    for common in [159] * 100 + [160] * 200 + [163] * 50 + [166] * 50 + [171] * 50:
        words = rng.choices(range(10 ** 9), k=184 + 180 - common)
        texts += [" ".join(f"w{x}" for x in words[:184]), " ".join(f"w{x}" for x in words[:common + 4] + words[184:])]
        alike.append(common >= 160)
    got = kept(spark, texts)
    assert {2 * k for k in range(len(alike))} <= got
    assert [2 * k + 1 in got for k in range(len(alike))] == [not x for x in alike]


def test_pairs_in_a_template_family(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    template = words(104)
    texts = [template + words(15) for _ in range(120)]  # 0.77 to any other of the family
    texts += [t[:108] + words(11) for t in texts[:100]]  # 0.83 to one of them
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    got = kept(spark, texts)
    assert got == expected(texts) and len(got) == 120


def test_all_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    sets = [[10 * k + x for x in range(9)] + [-k] for k in range(1, 20)] + [[190 + x for x in range(9)] + [-30]] + [[10 + x for x in range(10)]]
    rows = spark.createDataFrame([(1, len(sets), k, k, s) for k, s in enumerate(sets)], "key long, size long, tid long, root long, set array<long>")
    assert {(r["a"], r["b"]) for r in simhash.block_links(rows, 0.8).collect()} == {(18, 19), (0, 20)}


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(40, size=n)) for n in (0, 5, 30, 0, 12)]
    assert simhash.shared_counts(sets[1:], sets).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets[1:]]


def test_fingerprints_link_what_sets_do_not(spark):
    """Texts of one fingerprint are copies by SimHash, though most of their distinct shingles differ."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    line = "one two three "
    texts = [line * 200 + " ".join(word() for _ in range(40)) for _ in range(2)] + [" ".join(word() for _ in range(80)) for _ in range(3)]
    prints = [simhash.simhash(simhash.shingle_hashes(t, 3)) for t in texts]
    assert prints[0] == prints[1] and len(set(prints)) == 4
    assert kept(spark, texts) == {0, 2, 3, 4}


def test_few_texts_leave_python_at_once(spark):
    """A batch's sets of shingles were all made before the first left."""
    import pyarrow as pa

    from factspark.llm.language_id import TEXTS
    texts = [None, "", "a b c d e f g"] * TEXTS
    use = lambda t: simhash.shingle_set(t, 5).view("i8")
    parts = list(simhash.lists_of(iter([pa.array(texts, pa.string()), pa.array([], pa.string())]), use))
    assert max(map(len, parts)) == TEXTS and sum((x.to_pylist() for x in parts), []) == [use(t or "").tolist() for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = rows.select("id", simhash.hashed(rows["text"], 5, lambda x: x.view("i8")).alias("s")).orderBy("id").collect()
    assert [r["s"] for r in got] == [use(t or "").tolist() for t in texts]
