"""Operator 1: suffix-array deduplication, depth-limited.

Suffixes are ordered only through `length` bytes, by passes over digits of 8 bytes from the most significant on.
The first digit is the anchored context, dealt over the cluster (see windows.py). In its bin every suffix that was sent
goes through the passes: one alone in its group is unique and leaves; groups still together after the last digit are
exactly the repeated windows. Equal strings of one group of documents are sent once, with a weight that the passes
count; nothing else than the passes decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_at
from .windows import MARK, Exchange, Windows, covered

LENGTH = 200  # bytes of a repeated string
GRAM, CONTEXT = 8, 96


def radix_groups(raw: bytes, at: np.ndarray, group: np.ndarray, length: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Indices of the suffixes at `at` that equal another of the same group through `length` bytes; weight: how often each stands (default once)."""
    w, rest = words_at(raw), np.argsort(group, kind="stable")
    weight = np.ones(len(at), np.int64) if weight is None else weight
    head = np.concatenate(([True], np.diff(group[rest]) != 0))[: len(rest)]  # first of its group

    def together(rest: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without those alone in their group."""
        starts = np.flatnonzero(head)
        if not len(starts):
            return rest, head
        stays = np.add.reduceat(weight[rest], starts) > 1
        if stays.all():
            return rest, head
        stays = np.repeat(stays, np.diff(np.append(starts, len(rest))))
        return rest[stays], head[stays]

    rest, head = together(rest, head)
    place = at[rest]
    for depth in range(0, length, 8):
        digit = w[place + depth]
        if length - depth < 8:
            digit &= np.uint64((1 << (8 * (length - depth))) - 1)
        split = np.concatenate(([False], digit[1:] != digit[:-1])) & ~head if len(rest) else head
        if not split.any():
            continue
        ids = np.cumsum(head) - 1  # only groups whose digits differ are sorted
        mixed = np.zeros(ids[-1] + 1, bool)
        mixed[ids[split]] = True
        where = np.flatnonzero(mixed[ids])
        order = where[np.lexsort((digit[where], ids[where]))]
        rest[where], digit[where] = rest[order], digit[order]
        head = head | np.concatenate(([False], digit[1:] != digit[:-1]))
        rest, head = together(rest, head)
        place = at[rest]
    return rest


def decide_repeats(records: np.ndarray, strings: list[bytes], length: int) -> np.ndarray:
    """MARK records of the first places of windows that occur more than once among all records' strings; a record's `many` stands for another copy."""
    records = records[np.argsort(records["sid"], kind="stable")]  # a record of each string
    counts = records["n"].astype(np.int64)
    ends = np.cumsum(counts)
    place = np.concatenate(([0], np.cumsum([len(x) for x in strings])))[:-1]
    _, context = np.unique(records["h"], return_inverse=True)
    step = np.arange(counts.sum()) - np.repeat(ends - counts, counts)
    at = np.repeat(place, counts) + step
    group = np.repeat(context.astype(np.int64) * 65536 + records["a"], counts) - step
    found = radix_groups(b"".join(strings), at, group, length, np.repeat(1 + records["many"].astype(np.int64), counts))
    flags = np.zeros(len(at) + 1, bool)
    flags[found] = True
    flags[:-1] &= np.repeat(records["own"] > 0, counts)
    edge = np.zeros(len(at) + 1, bool)  # where a string begins
    edge[ends - counts] = edge[-1] = True
    first = np.flatnonzero(flags & (edge | ~np.concatenate(([False], flags[:-1]))))
    last = np.flatnonzero(flags[:-1] & (edge[1:] | ~flags[1:]))
    of = np.searchsorted(ends, first, side="right")
    marks = np.empty(len(first), MARK)
    marks["k1"], marks["k2"], marks["s"], marks["n"] = records["k1"][of], records["k2"][of], records["s"][of] + step[first], last - first + 1
    return marks


def _marks(docs: DataFrame, length: int, id_col: str, text_col: str, carry: bool) -> tuple[Exchange, DataFrame]:
    if length < 32:
        raise ValueError("repeated strings need at least 32 bytes")
    x = Exchange(docs, Windows(length, GRAM, min(CONTEXT, length // 16 * 8), False), id_col, text_col, carry)
    return x, x.decided(lambda records, strings: decide_repeats(records, strings, length), smaller=False, merge=False)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (repeated byte ranges as "from-to,...").

    Every byte in a `length`-byte string that also starts anywhere else is removed, judged on the input; matches
    never cross documents. Null texts are empty; texts shorter than `length` keep everything; rows with equal or
    null ids are documents of their own, so a row that occurs twice repeats itself; no rows give no rows. Other
    columns are not read.
    """
    x, marks = _marks(docs, length, id_col, text_col, False)

    def each(doc, raw, starts, counts):
        spans = covered(starts, counts, length)
        kept, at = hashlib.sha256(), 0
        for a, b in spans:
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        return doc, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), ",".join(f"{a}-{b}" for a, b in spans)

    return x.finish(marks, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with repeated bytes cut from the text; a character stays if any of its bytes does not repeat.

    Edge cases as in `repeated_bytes`; a document may end up with an empty text.
    """
    x, marks = _marks(docs, length, id_col, text_col, True)

    def cut(raw, starts, counts):
        out, at = [], 0
        for a, b in covered(starts, counts, length):
            while a < len(raw) and raw[a] & 0xC0 == 0x80:  # whole characters only
                a += 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            if b > a:
                out.append(raw[at:a])
                at = b
        return b"".join([*out, raw[at:]]).decode()

    out = x.rewrite(marks, cut)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
