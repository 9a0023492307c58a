"""Operator 3: substring deduplication by super-k-mers.

Consecutive windows of words that share a minimiser (here: the anchor and its context, see windows.py) travel as
one packed string of words to the minimiser's bucket. There all windows are cut from the strings and sorted, word by
word, so equal windows stand together: each is counted exactly and its smallest document found.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .windows import MARK, Exchange, Windows, covered, intervals

LENGTH = 50  # words of a window
GRAM, CONTEXT = 3, 12
SORT_ROWS = 50_000


def decide_smaller(records: np.ndarray, strings: list[bytes], length: int) -> np.ndarray:
    """MARK records of the first words of windows that also start in a document with a smaller id."""
    sid = records["sid"].astype(np.int64)
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, sid, records["ord"])
    _, one = np.unique(sid, return_index=True)
    heads = records[one]
    _, context, alike = np.unique(heads["h"], return_inverse=True, return_counts=True)
    counts = heads["n"].astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    best = np.repeat(least, counts)  # smallest id of each window of each string
    crowd = np.flatnonzero(alike[context] > 1)
    if len(crowd):
        crowd = crowd[np.argsort(context[crowd], kind="stable")]
        ids: dict[bytes, int] = {}
        tokens = [np.array([ids.setdefault(x, len(ids)) for x in strings[i].split(b" ")], ">u4") for i in crowd.tolist()]
        place = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))[:-1]
        flat, n = np.concatenate(tokens), counts[crowd]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(place, n) + step
        key = np.repeat(context[crowd], n) * 65536 + np.repeat(heads["a"][crowd].astype(np.int64), n) - step
        order = np.argsort(key, kind="stable")
        own = (np.repeat(bounds[crowd], n) + step)[order]
        at, key = at[order], key[order]
        changes = np.flatnonzero(key[1:] != key[:-1]) + 1
        a = 0
        while a < len(key):  # equal windows have equal keys: sort by whole keys
            k = np.searchsorted(changes, a + SORT_ROWS)
            b = int(changes[k]) if k < len(changes) else len(key)
            rows = np.empty((b - a, length + 2), ">u4")
            rows[:, 0], rows[:, 1] = key[a:b] >> 32, key[a:b] & 0xFFFFFFFF
            rows[:, 2:] = flat[at[a:b, None] + np.arange(length)]
            packed = rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel()
            by = np.argsort(packed, kind="stable")
            s = rows[by]
            first = np.concatenate(([0], np.flatnonzero((s[1:] != s[:-1]).any(axis=1)) + 1))
            low = np.minimum.reduceat(best[own[a:b]][by], first)
            best[own[a:b][by]] = np.repeat(low, np.diff(np.append(first, b - a)))
            a = b
    marks = []
    for r in range(len(records)):
        a, b = bounds[sid[r]], bounds[sid[r] + 1]
        part = best[a:b] < records["ord"][r]
        if part.all():
            marks.append((records["k1"][r], records["k2"][r], records["s"][r], b - a))
        elif part.any():
            marks += [(records["k1"][r], records["k2"][r], records["s"][r] + i, m) for i, m in intervals(part)]
    return np.array(marks, MARK)


def repeated_words(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges as "from-to,...").

    A word is removed if a window of `length` words over it also starts in a document with a smaller id, judged on
    the input. Null texts have no words. Rows with equal ids are of one rank, so none removes from another; a null
    id ranks after all others. No rows give no rows. Other columns are not read.
    """
    if length < 16:
        raise ValueError("windows need at least 16 words")
    x = Exchange(docs, Windows(length, GRAM, CONTEXT, True), id_col, text_col)
    marks = x.decided(lambda records, strings: decide_smaller(records, strings, length), smaller=True, merge=True)

    def each(doc, raw, starts, counts):
        words, out, at = raw.split(), [], 0
        spans = covered(starts, counts, length)
        for a, b in spans:
            out += words[at:a]
            at = b
        return doc, len(words), sum(b - a for a, b in spans), hashlib.sha256(b" ".join(out + words[at:])).hexdigest(), ",".join(f"{a}-{b}" for a, b in spans)

    return x.finish(marks, each, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans string")
