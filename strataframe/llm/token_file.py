"""Operator 6: token ids as a binary file of directly addressable codes.

An id is cut into 8-bit chunks. Level j of a file holds chunk j of every id that has one, a continuation
bitmap (bit set: the id goes on at level j + 1) and a rank directory (set bits before each 512-bit block).
Token i is found by following ranks from level to level: no block is decoded, any token can be read alone.

Shards hold whole documents and follow each other in ascending id order: the documents are dealt by range,
each partition writes its shards under final names that depend on the partition alone (a rerun task replaces them
with the same bytes). A shard's place in the whole token stream is the sum of those before, made in two levels over
the manifest, a table; nothing that grows passes the driver.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MANY_TASKS, bins_for, materialise, shared_dir, ship, text_bytes
from .encoders import encoder, ids_of

MAGIC = b"SFDAC001"
CHUNK_BITS = 8
RANK_BLOCK = 512
SHARD_BYTES = 12 << 20  # of text a shard
SHARDS_OF_PART = 1 << 20  # numbers for the shards of a range partition
PARTS_OF_SUM = 4096  # range partitions whose tokens are summed first


def dac_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """[(chunks uint8, continuation bits packed little-endian, rank directory uint32)] of ids, one per level."""
    out, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >= (1 << CHUNK_BITS)
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        out.append(((rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, np.concatenate((np.zeros(1, np.uint32), np.cumsum(counts, dtype=np.uint32)))[:-1] if len(counts) else counts))
        if not more.any():
            return out
        rest = rest[more] >> np.uint64(CHUNK_BITS)


class DacShard:
    """One shard in memory: random access to tokens (`token`), ranges (`tokens`) and documents."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        at, heads = 8, []

        def take(kind, n):
            nonlocal at
            x = np.frombuffer(raw, dtype=kind, count=n, offset=at)
            at += x.nbytes
            return x

        n_docs, self.n_tokens, n_levels = map(int, take("<u8", 3))
        self.doc_ids, self.doc_null, self.starts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1)
        for _ in range(n_levels):
            n, = map(int, take("<u8", 1))
            heads.append((take("u1", n), take("u1", (n + 7) // 8), take("<u4", -(-n // RANK_BLOCK))))
        self.levels = heads

    def _rank(self, level: int, i: int) -> int:
        """Set continuation bits of the level before place i."""
        chunks, bits, ranks = self.levels[level]
        if i >= len(chunks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        block = i // RANK_BLOCK
        part = np.unpackbits(bits[block * RANK_BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * RANK_BLOCK]
        return int(ranks[block]) + int(part.sum())

    def token(self, i: int) -> int:
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, shift = self._rank(level, i), shift + CHUNK_BITS
        raise ValueError("a code without an end")

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a..b-1."""
        out, where = np.zeros(b - a, np.uint32), None
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[a:b].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            more = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if not more.any():
                break
            where = np.flatnonzero(more) if where is None else where[more]
            a, b = self._rank(level, a), self._rank(level, b)
        return out


def shard_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels = dac_levels(ids)
    starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u8")
    parts = [MAGIC, np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(), starts.tobytes()]
    for chunks, bits, ranks in levels:
        parts += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(parts)


def _put(uri: str, raw: bytes) -> None:
    """Whole or not at all: under a name of its own first, then moved."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}.tmp") as f:
        f.write(raw)
    store.move(own, path)


def read_shard(uri: str) -> DacShard:
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return DacShard(f.read())


def write_token_file(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", each: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append end_id, write the shards; return their manifest (shard, path, docs, tokens, start).

    Null texts encode as empty, null ids come first; repeated ids stay separate documents, in the order of a hash of
    their text, which also lets the range partitions split them; an empty table writes no shard. Columns of other
    names are not read. The manifest has one row per shard of about `each` bytes of text, with start the tokens of all
    shards before it. A task holds one shard at a time (or one document, if that is longer).
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_dir(spark, "tokens")
    _, total = text_bytes(docs, text_col)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(bins_for(total, each), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail, k, made = encoder(vocabulary), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def put() -> pa.RecordBatch:
            lengths = [len(p) // 4 for p in parts]
            _put(uri := f"{folder}/shard-{k:08d}-{made:06d}.dac", shard_bytes(ids, lengths, ids_of(b"".join(parts))))
            return pa.RecordBatch.from_pydict({"shard": [k * SHARDS_OF_PART + made], "path": [uri], "docs": [len(ids)], "tokens": [sum(lengths)]}, schema=schema)

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and size > 2 * each:  # a range that sampling made too large
                    yield put()
                    made, ids, parts, size = made + 1, [], [], 0
                ids.append(doc)
                parts.append(enc.encode(t or "") + tail)
                size += len(t or "")
        if ids:
            yield put()

    found = materialise(rows.mapInArrow(write, "shard long, path string, docs long, tokens long"), "manifest")
    found = found.withColumn("part", F.floor(F.col("shard") / (SHARDS_OF_PART * PARTS_OF_SUM)))
    sums = found.groupBy("part").agg(F.sum("tokens").alias("sum"))  # a row for PARTS_OF_SUM partitions
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))
    own = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    return found.withColumn("own", own).join(before, "part").select("shard", "path", "docs", "tokens", (F.col("before") + F.col("own")).alias("start"))


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = read_shard(path)
                s = shard.starts.astype(np.int64)
                crc = [zlib.crc32(shard.tokens(a, b).astype("<u4").tobytes()) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids.astype(np.int64), mask=shard.doc_null.astype(bool)), pa.array(s[:-1] + base), pa.array(np.diff(s)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = min(manifest.count(), MANY_TASKS)
    return manifest.select("path", "start").repartition(max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
