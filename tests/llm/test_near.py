"""Operator 7 against brute force, and its parts."""

import random
import re

import numpy as np
import pytest
from strataframe.llm import components as joining
from strataframe.llm import minhash
from strataframe.llm.components import components


def sets_of(rows):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows, percent=85):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and a and b
            if same_id or a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, s in enumerate(sets):
        ids = [x for x in groups[find(i)] if x is not None] if s else [rows[i][0]]
        out.append((rows[i][0], len(s), min((x for x in ids if x is not None), default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1000, 3])
def test_documents(docs, rows_of_corpus, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows_of_corpus)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None and r["n_shingles"])


@pytest.mark.parametrize("size", [1, 3])
def test_slices_joined_before_they_travel(docs, rows_of_corpus, monkeypatch, size):
    """Sets that share a band within a slice travel once; no link is lost for it."""
    want = sorted(tuple(r) for r in minhash.near_duplicates(docs).select("row_key", "component_id", "kept").collect())
    monkeypatch.setattr(minhash, "SLICE_SETS", size)
    monkeypatch.setattr(minhash, "BIN_BYTES", 2000)
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).select("row_key", "component_id", "kept").collect()) == want


def test_one_of_each(docs):
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    texts = [r["text"] for r in out.collect() if r["text"] and len(r["text"].split()) > 100]
    assert len(texts) == len(set(texts))


def test_empty(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.one_of_each(no_docs).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    same = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(same - 1500 / 2500) < 0.05
    assert (minhash.band_keys(minhash.signature(a)) == minhash.band_keys(minhash.signature(a.copy()))).all()


def test_forests():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [base, base[:190], base[10:], np.unique(r.integers(0, 2**63, 200, dtype=np.uint64)), base[:100]]
    links = minhash.exact_forest(sets, 85)
    joined = {frozenset(x) for x in links}
    assert len(links) == 2 and {x for p in joined for x in p} == {0, 1, 2}
    sigs = [minhash.sketch(minhash.signature(s)) for s in sets]
    likely = minhash.bucket_forest(np.array([len(s) for s in sets]), np.array(sigs), 85)
    assert {x for p in likely for x in p} >= {0, 1, 2} and 3 not in {x for p in likely for x in p}


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7), (3, 3), (200, 7)] + [(500, 500 + r.randrange(1, 40)) for _ in range(60)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[200] == got[9] == got[7] == 7
    assert all(got[b] == 500 for a, b in links if a == 500)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("part", [64, 400])
def test_components_of_many_parts(spark, monkeypatch, part):
    """Chains of rising ids, a star and random links over many small parts, against union-find."""
    monkeypatch.setattr(joining, "PART_BYTES", part)
    r = random.Random(6)
    links = [(i, i + 1) for i in range(300)] + [(5000, 5001 + i) for i in range(200)] + [(10_000 + r.randrange(300), 10_000 + r.randrange(300)) for _ in range(260)] + [(-(2**63), 2**63 - 1), (2**62, 2**63 - 1)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    r.shuffle(links)
    got = [(x["node"], x["component"]) for x in components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in {x for a, b in links if a != b for x in (a, b)})


def test_any_ids_and_column_names(spark):
    text, other = "one two three four five six seven", "a b c d e f g h"
    rows = [(2**62, text, 1), (2**63 - 1, text, 2), (None, text, 3), (None, other, 4), (None, other, 4), (-(2**63), None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key long")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(2**62, 2**62, True), (2**63 - 1, 2**62, False), (None, 2**62, False), (None, None, True), (None, None, True), (-(2**63), -(2**63), True)], key=str)
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r["__key"] for r in out.collect()) == [1, 4, 5]


def test_pipeline_stage_joins_copies_at_80(spark):
    import corpus_pipeline

    r = random.Random(8)
    rows = []
    for _ in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(64)]
        k = r.randrange(1, 20)
        # a pair at 75 to 100 %: 60 shingles, of which the copy lacks up to 15
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: 64 - k]))]
    words = [f"v{i}" for i in range(24)]
    rows += [(1000, " ".join(words)), (1001, " ".join(words[:20])), (1002, " ".join(words[:19]))]  # exactly 80 %, then 75 %
    got = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    want, at_85 = ({i for i, n, c in brute(rows, p) if i == c} for p in (80, 85))
    assert got == want != at_85 and 1001 not in got


@pytest.mark.parametrize("percent", [1, 30, 50, 70, 80, 85, 95, 99, 100])
def test_bands_follow_percent(percent):
    bands, rows = minhash.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISS
    sig = minhash.signature(np.arange(50, dtype=np.uint64), minhash.coordinates_for(percent))
    assert len(minhash.band_keys(sig, percent)) == bands and len(minhash.sketch(sig)) == 2


def test_low_percent_is_found(spark):
    rows = []
    for i in range(100):
        words = [f"{i}w{j}" for j in range(84)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:44]))]  # 40 of 80 shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in minhash.near_duplicates(docs, 50).collect())
