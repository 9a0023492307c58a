"""Operators 4 and 6: exact round trips against the tokenizers library."""

import bisect
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strataframe.llm import packing, token_file
from strataframe.llm.encoders import encoder
from tokenizers import Tokenizer

ODD = ["", " ", "  a  b ", "don't  stop\n\n\nnow ", "naïve ÉCOLE İstanbul ²½ x_y", "a\tb\r\nc", "<|endoftext|> hi", "日本語 text 123 4567", "Σίσυφος ΟΔΟΣ", "é x", "a\x1cb", "x 's 't don's I'LL", "a\x00b c", "end,!! of... it's 12ab"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(vocab, name, rows_of_corpus):
    e = encoder(vocab(name))
    for t in [*ODD, *(r[1] for r in rows_of_corpus if r[1])]:
        assert e.encode(t) == e.by_library(t), t[:60]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_encoder_on_any_text(text):
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(str(public_tokenizers.path(name)))
        assert e.encode(text) == e.by_library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\xa0\u2003\x00aBé'sΣ1½.,-\u0301<|endoftext|>日", max_size=30))
def test_encoder_on_spaces(text):
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(str(public_tokenizers.path(name)))
        assert e.encode(text) == e.by_library(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_cache_is_bounded(vocab, name, monkeypatch):
    from strataframe.llm import encoders

    monkeypatch.setattr(encoders, "CACHE_WORDS", 5)
    e = encoders.Encoder(vocab(name))
    for t in ["a b c d e f g h i j k", "x" * 1000, "a b c"]:
        assert e.encode(t) == e.by_library(t) and len(e.known) <= 5 and "x" * 1000 not in e.known


def ids_of(vocab, name, text, end):
    return np.array([*Tokenizer.from_file(vocab(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(docs, rows_of_corpus, vocab):
    out = packing.pack_documents(docs, vocab("byte_bpe_50k.json"), limit=256).collect()
    want = Counter()
    for r in rows_of_corpus:
        ids = ids_of(vocab, "byte_bpe_50k.json", r[1], 0)
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        want.update((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= best_fit([r["length"] for r in out], 256)


def best_fit(lengths, limit):
    """Sequences that best fit decreasing opens, item by item."""
    free = []
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, x)
        left = free.pop(k) - x if k < len(free) else limit - x
        bisect.insort(free, left)
    return len(free)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_plan(histogram):
    slots, used = packing.plan(histogram, 64)
    fill = {}
    for length, rows in slots.items():
        ends = np.append(rows[1:, 0], histogram[length])
        for (rank, first, offset), end in zip(rows.tolist(), ends.tolist()):
            for k in range(end - rank):
                fill.setdefault(first + k, []).append((offset, length))
    assert len(fill) == used
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert used <= best_fit([k for k, v in histogram.items() for _ in range(v)], 64) * 1.02 + 1


def test_token_file(spark, docs, rows_of_corpus, vocab, tmp_path):
    m = token_file.write_token_file(docs, vocab("word_bpe_49k.json"), f"file://{tmp_path}/t", each=20_000)
    assert m.count() > 3
    out = token_file.read_documents(spark, m).orderBy("start").collect()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert order == sorted(order)
    at, want = 0, Counter()
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    for r in rows_of_corpus:
        ids = ids_of(vocab, "word_bpe_49k.json", r[1], 1)
        want[r[0], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want


def test_one_id_fills_many_shards(spark, vocab, tmp_path, monkeypatch):
    """Null and equal ids, more than a shard holds: still a gapless stream in id order, in shards of bounded size."""
    monkeypatch.setattr(token_file, "PARTS_OF_SUM", 2)
    rows = [(None, f"null {i} " * 20) for i in range(200)] + [(5, "same " * 100)] * 300 + [(7, None), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    m = token_file.write_token_file(docs, vocab("word_bpe_49k.json"), f"file://{tmp_path}/t", each=4000)
    held = m.orderBy("shard").collect()
    assert len(held) > 20 and sum(r["docs"] for r in held) == len(rows) and max(r["docs"] for r in held) < 60
    at = 0
    for r in held:
        assert r["start"] == at
        at += r["tokens"]
    out = token_file.read_documents(spark, m).orderBy("start").collect()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert order == sorted(order) and len(out) == len(rows) and out[-1]["start"] + out[-1]["n_tokens"] == at


def test_random_access():
    r = np.random.default_rng(2)
    ids = r.integers(0, 2 ** r.integers(1, 32, 3000), dtype=np.uint64).astype(np.uint32)
    s = token_file.DacShard(token_file.shard_bytes([5, None], [1000, 2000], ids))
    assert (s.tokens(0, 3000) == ids).all() and [s.token(i) for i in range(0, 3000, 7)] == ids[::7].tolist()
    for a, b in ((0, 0), (5, 6), (511, 513), (1000, 3000), (2999, 3000)):
        assert (s.tokens(a, b) == ids[a:b]).all()
    assert s.doc_ids.tolist() == [5, 0] and s.doc_null.tolist() == [0, 1] and s.starts.tolist() == [0, 1000, 3000]
    with pytest.raises(ValueError):
        token_file.DacShard(b"something else")


def test_empty_tables(spark, no_docs, vocab):
    assert packing.pack_documents(no_docs, vocab("byte_bpe_50k.json")).count() == 0
    assert token_file.read_documents(spark, token_file.write_token_file(no_docs, vocab("word_bpe_49k.json"))).count() == 0
