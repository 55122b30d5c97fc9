"""The pipeline's stages, each on what the one before kept, against brute force."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from factline.llm import decontam, substrings
from factline.llm.common import save
from test_operators import BPE, check_packing, ids_of
from tokenizers import Tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, "123 !!", "en", "x", 6)], docs.schema)
    out = [("documents", docs.unionAll(extra))]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, save(stage(spark, out[-1][1], sf), name)))
    return {name: {r.doc_id: r.text for r in df.collect()} if "text" in df.columns else df.collect() for name, df in out} | {"frames": out}


def test_columns(stages):
    for _, df in stages["frames"][:-1]:
        assert df.columns == COLUMNS


def test_language(stages):
    assert stages["documents"].keys() - stages["language_id"].keys() == {10**6, 10**6 + 1, 10**6 + 2}


def test_near_copies(stages):
    before, after = stages["language_id"], stages["simhash_near_dedup"]
    sets = {i: shingles(t) for i, t in before.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(before), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert after.keys() == {find(i) for i in before}
    assert all(after[i] == before[i] for i in after)


def test_repeated_passages(stages):
    before, after = stages["simhash_near_dedup"], stages["substring_dedup"]
    assert before.keys() == after.keys()
    owner: dict = {}
    shared = set()
    for i, t in sorted(before.items()):
        w = words(t)
        for k in range(len(w) - substrings.PASSAGE + 1):
            first = owner.setdefault(tuple(w[k : k + substrings.PASSAGE]), i)
            if first != i:
                shared |= {first, i}
    changed = {i for i in before if before[i] != after[i]}
    assert all(len(words(after[i])) < len(words(before[i])) for i in changed)
    left: dict = {}
    for i, t in after.items():
        w = words(t)
        for k in range(len(w) - substrings.PASSAGE + 1):
            assert left.setdefault(tuple(w[k : k + substrings.PASSAGE]), i) == i
    for i in changed - shared:  # near copies, not equal ones
        gone = set(words(before[i])) - set(words(after[i]))
        assert any(len(gone & set(words(before[j]))) > 0.5 * len(gone) for j in before if j < i)


def test_benchmark(spark, sf, stages):
    before, after = stages["substring_dedup"], stages["benchmark_decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + decontam.WINDOW]) for w in items for k in range(max(1, len(w) - decontam.WINDOW + 1))}
    for i, t in after.items():
        w = words(t)
        assert not any(tuple(w[k : k + decontam.WINDOW]) in windows for k in range(len(w)))
        old = words(before[i])
        if not any(tuple(old[k : k + decontam.WINDOW]) in windows for k in range(len(old))):
            assert t == before[i]


def test_packing(stages):
    tokenizer = Tokenizer.from_file(BPE)
    expected = {i: ids_of(tokenizer, t) for i, t in stages["benchmark_decontamination"].items()}
    total = sum(map(len, expected.values()))
    assert check_packing(stages["packing"], expected, 2048) < 0.05 * total
    assert np.mean([r.length for r in stages["packing"]]) > 100
