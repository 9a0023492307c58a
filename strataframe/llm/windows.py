"""Repeated windows of a fixed length in all documents: what operators 1 and 3 have in common.

A window has an anchor, the place of its smallest hashed k-gram; consecutive windows with the same anchor form
a run. Equal windows have equal anchors, and the context that follows an anchor lies inside each of its windows.

1. `candidates`: every run sends the hash of its anchor's context to a bin; a context that occurs once rules its
   windows out. A context that a slice of text holds several times is known to repeat: its runs stay without asking,
   and one witness with their number goes to the bin, so a very frequent context sends one record a task. Runs that
   stay go to a table in the shared folder, dealt by document.
2. `exchange`: runs that stay travel as packed strings to the bin of their context, where `decide` finds equal
   windows exactly, on the strings themselves. Within a group of documents equal strings are merged first, so a
   passage that a third of all documents share leaves each task once.
3. The decisions go back to the documents.

A context found in more than max(HOT_RUNS, 1e-5 of all runs) runs is hot: its windows travel one by one, to the
bin of the whole window's hash, so that no bin holds all of them. They travel twice: first to a bin of the hash salted
with the group, where equal windows of many groups become one record with a weight, then to the bin of the hash alone;
so a window that is in every group sends the square root of their number to a bin, not one record each. There are at
most 1e5 hot contexts, whatever the input, so their list can be broadcast. Bins and groups hold a fixed number of bytes;
more input, more bins, and more tasks: every exchange is cut into as many as its bytes ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bins_for, by_bin, keyed, materialise, mix64, rows_of, ship, tasks_for, text_bytes, words_at, word_hashes

HOT_RUNS = 20_000
GROUP_BYTES = 2 << 20  # of text in a group of documents
BIN_BYTES = 3 << 20  # of records in a bin
SLICE = 2 << 20  # bytes of text whose contexts are counted before they travel
SEGMENT = 1 << 20  # longer texts are cut for the search of anchors, with overlaps

RUN = np.dtype([("h", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("s", "<i8"), ("n", "<u2"), ("a", "<u2")])
MARK = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("s", "<i8"), ("n", "<i8")])
SENT = np.dtype([("h", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("ord", "<i8"), ("s", "<i8"), ("n", "<u2"), ("a", "<u2"), ("own", "u1"), ("many", "u1"), ("sid", "<u4")])


@dataclass(frozen=True)
class Windows:
    """length: tokens in a window; gram: tokens in a k-gram; context: tokens from the anchor on that are hashed; words: tokens are words, not bytes."""

    length: int
    gram: int
    context: int
    words: bool

    @property
    def reach(self) -> int:
        """k-grams among which a window's anchor is chosen."""
        return self.length - self.context + 1

    def hashed(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash at each token, what contexts are made of at each token, tokens in each text); texts follow each other."""
        if not self.words:
            w = words_at(b"".join(texts))
            h = w * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            return h, w, np.array([len(t) for t in texts], np.int64)
        one, counts = word_hashes(texts)
        g = np.concatenate((one, np.zeros(self.gram, np.uint64)))
        out = g[: len(one)].copy()
        for j in range(1, self.gram):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + g[j : j + len(one)])
        return out, out, counts

    def runs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, windows, anchor - first window, context hash) of every run."""
        h, parts, counts = self.hashed(texts)
        starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        valid = np.maximum(counts - self.length + 1, 0)
        none = np.zeros(0, np.int64)
        if not valid.any():
            return none, none, none, none, none.astype(np.uint64)
        m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
        width = 1
        while 2 * width <= self.reach:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < self.reach:
            m = np.minimum(m[: len(m) - (self.reach - width)], m[self.reach - width :])
        anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.union1d(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, starts[valid > 0])
        text = np.searchsorted(starts + counts, first, side="right")
        end = (starts + valid)[text]
        stop = np.minimum(np.append(first[1:], len(h)), end)
        keep = first < end
        text, first, stop = text[keep], first[keep], stop[keep]
        a = anchor[first]
        context = np.zeros(len(a), np.uint64)
        for j in range(0, self.context, 8 if not self.words else self.gram):
            context = mix64(context * np.uint64(0x9E3779B97F4A7C15) + parts[a + j])
        return text, first - starts[text], stop - first, a - first, context


def _segments(texts: list[bytes], w: Windows) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Long texts of bytes cut so that each window lies in one segment: (segments, text of each, place of each)."""
    if w.words or all(len(t) <= 2 * SEGMENT for t in texts):
        return texts, np.arange(len(texts)), np.zeros(len(texts), np.int64)
    cut = [(t[a : a + SEGMENT + w.length - 1], i, a) for i, t in enumerate(texts) for a in range(0, max(len(t) - w.length + 1, 1), SEGMENT)]
    return [c[0] for c in cut], np.array([c[1] for c in cut]), np.array([c[2] for c in cut])


def _blobs(key: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Records by key, each key's as bytes."""
    order = np.argsort(key, kind="stable")
    key, records = key[order], records[order]
    cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(key[a]), records[a:b].tobytes()


def _batch(rows: list[tuple[int, bytes]], names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=list(names))


def _joined(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _strings_sent(to: np.ndarray, records: np.ndarray, strings: list[bytes]) -> list[tuple[int, bytes]]:
    """SENT records and the strings they name, packed by bin."""
    order = np.argsort(to, kind="stable")
    to, records, rows = to[order], records[order], []
    cuts = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            part = records[a:b].copy()
            ids, part["sid"] = np.unique(part["sid"], return_inverse=True)
            mine = [strings[i] for i in ids.tolist()]
            head = np.array([len(part), len(mine)], "<u4").tobytes()
            rows.append((int(to[a]), head + part.tobytes() + np.array([len(x) for x in mine], "<u4").tobytes() + b"".join(mine)))
    return rows


def _strings_met(blobs: list[bytes], merge: bool) -> tuple[np.ndarray, list[bytes]]:
    """What `_strings_sent` packed: (records, strings); merge: equal strings are one."""
    records, ids, strings = [], {}, []
    for blob in blobs:
        n, m = np.frombuffer(blob, "<u4", 2).tolist()
        part = np.frombuffer(blob, SENT, n, 8).copy()
        lengths = np.frombuffer(blob, "<u4", m, 8 + part.nbytes)
        at, own = 8 + part.nbytes + 4 * m, []
        for size in lengths.tolist():
            if merge:
                own.append(ids.setdefault(blob[at : at + size], len(ids)))
            else:
                own.append(len(strings))
                strings.append(blob[at : at + size])
            at += size
        part["sid"] = np.array(own, "<u4")[part["sid"]]
        records.append(part)
    return np.concatenate(records), list(ids) if merge else strings


def _lighter(records: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
    """(MARK records already known to repeat, the records that still travel) of single windows, equal ones by sid.

    smaller: those of the least document travel, the others repeat; else one of several travels for all, with a weight.
    """
    records = records[np.lexsort((records["ord"], records["sid"]))]
    first = np.concatenate(([True], records["sid"][1:] != records["sid"][:-1]))
    of = np.cumsum(first) - 1
    if smaller:
        on = records["ord"] == records["ord"][first][of]
        known, left = records[~on], records[on]
    else:
        several = (np.bincount(of) > 1)[of]
        known, left = records[several & (records["own"] > 0)], records[first]
        left["own"] &= ~several[first]
        left["many"] |= several[first]
    marks = np.empty(len(known), MARK)
    for name in MARK.names:
        marks[name] = known[name]
    return marks, left


class Exchange:
    """Repeated windows of `docs` (columns id and text): see the module's text."""

    def __init__(self, docs: DataFrame, windows: Windows, id_col: str = "doc_id", text_col: str = "text", carry: bool = False):
        self.spark, self.w = docs.sparkSession, windows
        ship(self.spark)
        _, total = text_bytes(docs, text_col)
        per_run = (windows.reach + 1) / 2 * (6 if windows.words else 1)  # bytes of text a run
        self.n_runs = total / per_run
        self.bins = bins_for(int(self.n_runs * RUN.itemsize), BIN_BYTES)
        self.groups = bins_for(total, GROUP_BYTES)
        self.doc_tasks = tasks_for(total)
        self.columns, self.text_col = docs.schema.fields if carry else [], text_col
        held = keyed(docs, id_col, text_col, [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(self.columns) if f.name != text_col])
        self.docs = held.withColumn("g", F.pmod("k1", F.lit(self.groups)).cast("int"))
        self.by_group = by_bin(self.docs, "g", self.doc_tasks)

    def candidates(self) -> tuple[DataFrame, list[int]]:
        """(table of g and packed runs whose context occurs more than once, hot contexts)."""
        w, bins, groups, hot_at = self.w, self.bins, self.groups, max(HOT_RUNS, int(self.n_runs * 1e-5))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told: list[np.ndarray] = []
            for part, texts in rows_of(batches, most=SLICE):
                cut, text_of, place = _segments(texts, w)
                text, s, n, a, h = w.runs(cut)
                out = np.empty(len(text), RUN)
                k1, k2 = (np.asarray(part.column(i)) for i in (0, 1))
                out["h"], out["k1"], out["k2"], out["s"], out["n"], out["a"] = h, k1[text_of[text]], k2[text_of[text]], s + place[text], n, a
                contexts, index, counts = np.unique(h, return_inverse=True, return_counts=True)
                several = counts[index] > 1
                known = out[several]
                told.append(np.stack((contexts[counts > 1], counts[counts > 1].astype(np.uint64))))
                out = out[~several]
                rows = [(-1 - g, blob) for g, blob in _blobs(known["k1"] % groups, known)]
                yield _batch(rows + list(_blobs(out["h"] % np.uint64(bins), out)), ("bin", "runs"))
            if told:
                contexts, counts = np.concatenate(told, axis=1)
                contexts, index = np.unique(contexts, return_inverse=True)
                out = np.zeros(len(contexts), RUN)
                out["h"], out["s"] = contexts, -1
                np.add.at(out["k1"], index, counts.astype(np.int64))
                yield _batch(list(_blobs(out["h"] % np.uint64(bins), out)), ("bin", "runs"))

        def meet(table: pa.Table) -> pa.Table:
            runs, k = _joined(table.column("runs"), RUN), table.column("bin")[0].as_py()
            if k < 0:
                rows = [(-1 - k, runs.tobytes())]
            else:
                contexts, index = np.unique(runs["h"], return_inverse=True)
                times = np.bincount(index, weights=np.where(runs["s"] < 0, runs["k1"], 1))
                stay = runs[(times[index] > 1) & (runs["s"] >= 0)]
                hot = contexts[times > hot_at]
                rows = [*_blobs(stay["k1"] % groups, stay), *([(-1, hot.tobytes())] if len(hot) else [])]
            return pa.Table.from_batches([_batch(rows, ("g", "runs"))])

        sent = by_bin(self.docs.select("k1", "k2", "text").mapInArrow(send, "bin int, runs binary"), "bin", tasks_for(int(self.n_runs * RUN.itemsize)))
        found = materialise(sent.groupBy("bin").applyInArrow(meet, "g int, runs binary"), "runs")
        hot = [int(x) for r in found.where("g = -1").select("runs").collect() for x in np.frombuffer(r[0], "<u8")]  # at most 1e5
        return found.where("g >= 0"), hot

    def decided(self, decide: Callable, smaller: bool, merge: bool) -> DataFrame:
        """(g, marks): packed MARK records, the first windows that `decide` gives.

        smaller: a window counts as repeated only where a smaller id has it; else wherever it occurs again.
        merge: equal strings of several groups are one string to `decide`; else each comes as it was sent.
        """
        w, bins, groups, salts = self.w, self.bins, self.groups, isqrt(self.groups) + 1
        found, hot = self.candidates()
        hot_sent = self.spark.sparkContext.broadcast(np.array(sorted(hot), "<u8"))

        def send(docs: pa.Table, runs: pa.Table) -> pa.Table:
            runs = _joined(runs.column("runs"), RUN)
            rows: list[tuple[int, bytes]] = []
            if len(runs) and docs.num_rows:
                runs = np.unique(runs)  # rows that repeat an id and a text have sent theirs twice
                held: dict[tuple[int, bytes], list[tuple]] = {}
                hot = hot_sent.value
                order = np.lexsort((runs["k2"], runs["k1"]))
                runs = runs[order]
                keys = list(zip(runs["k1"].tolist(), runs["k2"].tolist(), strict=True))
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                at = {keys[a]: (a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
                is_hot = np.isin(runs["h"], hot) if len(hot) else np.zeros(len(runs), bool)
                top = (1 << 63) - 1
                for k1, k2, doc, text in zip(*(docs.column(c).to_pylist() for c in ("k1", "k2", "doc_id", "text")), strict=True):
                    if (k1, k2) not in at:
                        continue
                    a, b = at[k1, k2]
                    raw, rank = (text or "").encode(), top if doc is None else doc
                    words = raw.split() if w.words else None
                    for h, s, n, anchor, warm in zip(runs["h"][a:b].tolist(), runs["s"][a:b].tolist(), runs["n"][a:b].tolist(), runs["a"][a:b].tolist(), is_hot[a:b].tolist(), strict=True):
                        for first, count in [(s + i, 1) for i in range(n)] if warm else [(s, n)]:
                            stop = first + count - 1 + w.length
                            packed = b" ".join(words[first:stop]) if w.words else raw[first:stop]
                            held.setdefault((h, packed), []).append((rank, k1, k2, first, count, anchor - (first - s)))
                marks, sent, strings = [], [], []
                for (h, packed), refs in held.items():
                    least = min(r[0] for r in refs)
                    known = [r for r in refs if r[0] > least] if smaller else refs if len(refs) > 1 else []
                    marks += [r[1:5] for r in known]
                    mine = [r for r in refs if r[0] == least] if smaller else refs[:1]
                    own = smaller or len(refs) == 1
                    sent += [(h, k1, k2, rank, s, n, a, own, len(refs) > 1, len(strings)) for rank, k1, k2, s, n, a in mine]
                    strings.append(packed)
                if marks:
                    known = np.array(marks, MARK)
                    rows += [(-1 - g, blob) for g, blob in _blobs(known["k1"] % groups, known)]
                sent = np.array(sent, SENT)
                bin_of = sent["h"] % np.uint64(bins)
                salt = docs.column("g")[0].as_py() % salts
                for i in np.flatnonzero(np.isin(sent["h"], hot)).tolist() if len(hot) else ():
                    bin_of[i] = bins + xxhash.xxh3_64_intdigest(strings[sent["sid"][i]], salt) % bins
                rows += _strings_sent(bin_of, sent, strings)
            return pa.Table.from_batches([_batch(rows, ("bin", "sent"))])

        def meet(table: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.Table.from_batches([_batch([], ("g", "marks"))])
            k = table.column("bin")[0].as_py()
            blobs = table.column("sent").to_pylist()
            if k < 0:
                return pa.Table.from_batches([_batch([(-1 - k, b"".join(blobs))], ("g", "marks"))])
            records, strings = _strings_met(blobs, merge or k >= bins)
            if k >= bins:  # hot windows, before their last bin
                marks, records = _lighter(records, smaller)
                to = np.array([xxhash.xxh3_64_intdigest(strings[i]) % bins for i in records["sid"].tolist()], np.int64)
                rows = [*_blobs(marks["k1"] % groups, marks), *((-1 - b, blob) for b, blob in _strings_sent(to, records, strings))]
                return pa.Table.from_batches([_batch(rows, ("g", "marks"))])
            marks = decide(records, strings)
            return pa.Table.from_batches([_batch(list(_blobs(marks["k1"] % groups, marks)), ("g", "marks"))])

        runs = (found.agg(F.sum(F.octet_length("runs"))).first()[0] or 0) // RUN.itemsize
        tasks = tasks_for(int(runs * (SENT.itemsize + (w.length + w.reach / 2) * (6 if w.words else 1))))
        sent = by_bin(self._with(found).applyInArrow(send, "bin int, sent binary"), "bin", tasks)
        marks = sent.groupBy("bin").applyInArrow(meet, "g int, marks binary")
        # once more: marks go through as they are, hot windows meet in their last bin
        left = by_bin(marks.select((-1 - F.col("g")).alias("bin"), F.col("marks").alias("sent")), "bin", tasks)
        return left.groupBy("bin").applyInArrow(meet, "g int, marks binary")

    def _with(self, packed: DataFrame):
        """The documents' groups beside those of a table with a column g."""
        return self.by_group.groupBy("g").cogroup(by_bin(packed, "g", self.doc_tasks).groupBy("g"))

    def finish(self, marks: DataFrame, each: Callable, schema: str) -> DataFrame:
        """Per document each(doc_id, text bytes, first windows marked (sorted pairs of start and count)) as a row of schema."""
        names = [x.split()[0] for x in schema.split(",")]
        types = {"long": pa.int64(), "string": pa.string()}
        kinds = [types[x.split()[1]] for x in schema.split(",")]

        def run(docs: pa.Table, found: pa.Table) -> pa.Table:
            found = np.sort(_joined(found.column("marks"), MARK), order=("k1", "k2", "s"))
            keys = list(zip(found["k1"].tolist(), found["k2"].tolist(), strict=True))
            at: dict[tuple[int, int], list[int]] = {}
            for i, key in enumerate(keys):
                at.setdefault(key, [i, i])[1] = i + 1
            rows = []
            for k1, k2, doc, text in zip(*(docs.column(c).to_pylist() for c in ("k1", "k2", "doc_id", "text")), strict=True):
                a, b = at.get((k1, k2), (0, 0))
                rows.append(each(doc, (text or "").encode(), found["s"][a:b], found["n"][a:b]))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        return self._with(marks).applyInArrow(run, schema)

    def rewrite(self, marks: DataFrame, text_of: Callable) -> DataFrame:
        """The documents with all their columns (carry=True), the text replaced by text_of(text bytes, marked starts, counts); null texts stay."""
        names = [f"c{i}" if f.name != self.text_col else "text" for i, f in enumerate(self.columns)]
        schema = StructType([StructField(n, f.dataType if n != "text" else StringType()) for n, f in zip(names, self.columns, strict=True)])

        def run(docs: pa.Table, found: pa.Table) -> pa.Table:
            found = np.sort(_joined(found.column("marks"), MARK), order=("k1", "k2", "s"))
            at: dict[tuple[int, int], list[int]] = {}
            for i, key in enumerate(zip(found["k1"].tolist(), found["k2"].tolist(), strict=True)):
                at.setdefault(key, [i, i])[1] = i + 1
            texts = docs.column("text").to_pylist()
            for i, key in enumerate(zip(docs.column("k1").to_pylist(), docs.column("k2").to_pylist(), strict=True)):
                if key in at:
                    a, b = at[key]
                    texts[i] = text_of(texts[i].encode(), found["s"][a:b], found["n"][a:b])
            return docs.select([n for n in names if n != "text"]).append_column("text", pa.array(texts, pa.string())).select(names)

        out = self._with(marks).applyInArrow(run, schema)
        return out.select(*[F.col(n).alias(f.name) for n, f in zip(names, self.columns, strict=True)])


def covered(starts: np.ndarray, counts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal [from, to) runs of tokens in windows whose first tokens are start..start+count-1; starts sorted."""
    out: list[list[int]] = []
    for a, n in zip(starts.tolist(), counts.tolist(), strict=True):
        b = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, how many) of the runs of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))
