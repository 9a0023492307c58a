"""Operator 4: best-fit packing planned on a histogram of lengths.

1. Every document is encoded once; documents over the limit are cut (first piece shorter). Only
   (id, piece, start, length, crc) goes on, through a table in the shared folder.
2. The histogram of lengths, at most `limit` rows, goes to the driver. Best fit decreasing runs over
   counts: a group is a number of sequences with the same free space and contents, and a length with
   count c goes into the tightest group in one step, splitting the group if it has more than c sequences.
   The plan's size depends on the limit, not on the number of documents.
3. Pieces take planned slots by rank within their length. The rank is made in two levels (within a
   salted part of a length, plus the sizes of the parts before), so no length is ever one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bins_for, materialise, ship
from .encoders import encoder

LIMIT = 2048
PART_ROWS = 100_000  # pieces in a salted part
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and end_id, cut from the end into pieces of `limit`; the first may be shorter."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = batch.column(1).to_pylist()
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                raw = enc.encode(text or "") + tail
                n = len(raw) // 4
                cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for column, v in zip(out, (doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, _PIECES)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> tuple[dict[int, np.ndarray], int]:
    """Best fit decreasing over counts. Per length an array of (first rank, first sequence, offset) rows in rank order; the number of sequences.

    The r-th piece of a length lies in the last row with first rank <= r, in sequence first sequence + r - first rank.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first sequence, how many)]
    spaces: list[int] = []
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used = 0

    def put(space: int, first: int, n: int) -> None:
        if space not in groups:
            groups[space] = []
            insort(spaces, space)
        mine = groups[space]
        if mine and mine[-1][0] + mine[-1][1] == first:
            mine[-1] = (mine[-1][0], mine[-1][1] + n)
        else:
            mine.append((first, n))

    for length in sorted((x for x, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        rows = slots[length] = []
        while left:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(i)
                take = min(n, left)
                if n > take:
                    put(space, first + take, n - take)
                put(space - length, first, take)
                rows.append((rank, first, limit - space))
            else:  # new sequences, each filled with as many of this length as fit
                fit = limit // length
                take = min(left, max(1, left // fit))
                put(limit - length, used, take)
                rows.append((rank, used, 0))
                used += take
            rank, left = rank + take, left - take
    return {k: np.array(v, np.int64) for k, v in slots.items()}, used


def pack_pieces(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to a (materialised) table of pieces."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `limit` rows
    slots, _ = plan(counts, limit)
    sent = spark.sparkContext.broadcast(slots)  # bounded by the limit
    salts = bins_for(max(counts.values(), default=0), PART_ROWS, 1)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(parts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), table[int(x)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = rows[k, 1] + rank[at] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, _PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = LIMIT, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `limit` tokens.

    Null or empty texts are a single end token. Repeated ids and rows are packed each on its own; a null id
    stays null; an empty table gives no rows. Other columns are not read, so their names cannot clash.
    """
    return pack_pieces(materialise(pieces(docs, vocabulary, limit, end_id, id_col, text_col), "pieces"), limit)
