"""Operators 1 and 3 against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from strataframe.llm import common, substring_dedup, suffix_dedup, windows
from strataframe.llm.common import word_hashes


def brute_bytes(rows, length):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(x[i : i + length] for _, x in raws for i in range(len(x) - length + 1))
    out = []
    for k, x in raws:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(x), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, length):
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    least = defaultdict(lambda: float("inf"))
    for k, w in split:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            least[key] = min(least[key], float("inf") if k is None else k)
    out = []
    for k, w in split:
        gone = [0] * len(w)
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < (float("inf") if k is None else k):
                gone[i : i + length] = [1] * length
        out.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.drop("spans").collect()), key=str)


@pytest.mark.parametrize("length", [200, 64])
def test_bytes(docs, rows_of_corpus, length):
    assert got(suffix_dedup.repeated_bytes(docs, length)) == brute_bytes(rows_of_corpus, length)


@pytest.mark.parametrize("length", [50, 20])
def test_words(docs, rows_of_corpus, length):
    assert got(substring_dedup.repeated_words(docs, length)) == brute_words(rows_of_corpus, length)


def test_hot_contexts_and_segments(docs, rows_of_corpus, monkeypatch):
    """Every repeated context is hot, texts are cut, and bins and groups are small."""
    for name, v in (("HOT_RUNS", 2), ("SEGMENT", 1000), ("GROUP_BYTES", 3000), ("BIN_BYTES", 4000)):
        monkeypatch.setattr(windows, name, v)
    assert got(suffix_dedup.repeated_bytes(docs)) == brute_bytes(rows_of_corpus, 200)
    assert got(substring_dedup.repeated_words(docs)) == brute_words(rows_of_corpus, 50)


def test_texts_without_repeats(docs, rows_of_corpus):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows_of_corpus)
    want = {(r[0], r[2]): r for r in suffix_dedup.repeated_bytes(docs).collect()}
    assert want
    for r in out.collect():
        assert (r["text"] is None) == (r["n_chars"] is None) and (r["text"] is None or r["n_chars"] == len(r["text"]))
    long = max((r[1] for r in rows_of_corpus if r[1]), key=len)
    assert any(r["text"] == long for r in out.collect())  # unique: untouched


def test_empty_table(no_docs):
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0
    assert substring_dedup.repeated_words(no_docs).count() == 0
    assert suffix_dedup.without_repeats(no_docs).columns == no_docs.columns


def test_radix_groups():
    raw = b"abcdefghijXabcdefghijYabcdefghiZ"
    at = np.array([0, 11, 22])
    assert sorted(suffix_dedup.radix_groups(raw, at, np.zeros(3, int), 10).tolist()) == [0, 1]
    assert sorted(suffix_dedup.radix_groups(raw, at, np.zeros(3, int), 9).tolist()) == [0, 1, 2]
    assert suffix_dedup.radix_groups(raw, at, np.arange(3), 3).tolist() == []


def test_radix_groups_against_counting():
    r = np.random.default_rng(4)
    for length in (3, 8, 20):
        raw = bytes(r.choice([97, 98], 400, p=[0.8, 0.2]).astype(np.uint8))
        at, group, weight = r.integers(0, 400 - length, 150), r.integers(0, 3, 150) * 1000, r.integers(1, 3, 150) % 2 + 1
        times = Counter()
        for a, g, n in zip(at, group, weight):
            times[g, raw[a : a + length]] += n
        want = [i for i, (a, g) in enumerate(zip(at, group)) if times[g, raw[a : a + length]] > 1]
        assert sorted(suffix_dedup.radix_groups(raw, at, group, length, weight).tolist()) == want
    assert suffix_dedup.radix_groups(b"", np.zeros(0, np.int64), np.zeros(0, np.int64), 10).tolist() == []


def test_small_slices_and_many_tasks(docs, rows_of_corpus, monkeypatch):
    monkeypatch.setattr(common, "TASK_BYTES", 5000)
    for name, v in (("SLICE", 2000), ("GROUP_BYTES", 4000), ("BIN_BYTES", 4000)):
        monkeypatch.setattr(windows, name, v)
    assert got(suffix_dedup.repeated_bytes(docs)) == brute_bytes(rows_of_corpus, 200)
    assert got(substring_dedup.repeated_words(docs)) == brute_words(rows_of_corpus, 50)


def test_word_hashes():
    texts = [b"a  bb\tccc", b"", b" \n ", b"longer-than-eight longer-than-eighT", b"w" * 5000 + b" " + b"w" * 5001]
    h, n = word_hashes(texts)
    assert n.tolist() == [3, 0, 0, 2, 2] and len(set(h.tolist())) == 7
    assert word_hashes([b"ABC"], lower=True)[0][0] == word_hashes([b"abc"])[0][0]
