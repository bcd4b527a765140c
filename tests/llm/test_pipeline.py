"""Every stage of the pipeline against a plain version of what it decides."""

import collections
import hashlib
import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from factspark.llm.common import stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        results.append(docs.collect())
    return results


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def test_language_keeps_texts_in_known_languages(stages):
    kept = {r["doc_id"] for r in stages[1]}
    assert {r["doc_id"] for r in stages[0] if len(WORD.findall(r["text"] or "")) >= 10 and re.search("[a-z]{2} [a-z]", r["text"])} <= kept


def test_one_of_each_group_stays(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[1]}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = sorted(r["doc_id"] for r in stages[2])
    assert len(kept) == len(set(kept))
    assert not [(a, b) for a, b in itertools.combinations(kept, 2) if alike(a, b) >= 0.9]
    for gone in set(sets) - set(kept):
        assert max(alike(gone, other) for other in sets if other != gone) >= 0.7


def test_secrets_of_one_owner_are_masked(stages):
    before, after = ({r["doc_id"]: r for r in rows} for rows in stages[2:4])
    assert set(before) == set(after)
    found = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})|(AKIA[A-Z0-9]{12,})|([0-9a-f]{32,})""", re.I)
    owners = collections.defaultdict(set)
    for r in before.values():
        for m in found.finditer(r["text"]):
            owners[next(filter(None, m.groups()))].add(r["source"])
    for i, r in before.items():
        values = [next(filter(None, m.groups())) for m in found.finditer(r["text"])]
        for value in values:
            if len(owners[value]) >= 3:
                assert value in after[i]["text"]
        if not values and not re.search(r"[A-Za-z0-9+/_=-]{20}", r["text"]):
            assert after[i]["text"] == r["text"]
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_mix_takes_about_the_targets(stages):
    size = collections.Counter()
    for r in stages[3]:
        size[r["source"]] += len(WORD.findall(r["text"]))
    taken, copies = collections.Counter(), collections.Counter()
    for r in stages[4]:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 3 and abs(sum(taken.values()) - sum(size.values())) <= 0.1 * sum(size.values())
    first = sorted(size)[0]
    assert taken[first] > 1.5 * size[first] or size[first] > 0.1 * sum(size.values())


def test_tokens_are_those_of_the_library(stages):
    import public_tokenizers
    import tiktoken

    from factspark.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {hashlib.sha256(r["text"].encode()).hexdigest(): r["text"] for r in stages[4]}
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r["tokens"] == plain.encode_ordinary(texts[r["text_sha256"]]) and r["decoded_sha256"] == r["text_sha256"]
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["tokens"], dtype="<u4").tobytes()).hexdigest()
