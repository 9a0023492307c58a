"""What the operators of this folder share: the shared folder, code shipping, sizing and packed blobs."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application, so workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = Path(tempfile.mkdtemp(prefix="ship-"))
    target = folder / f"strataframe_{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below spark.checkpoint.dir; where it is unset, a local session has one in its temporary folder and a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "strataframe-checkpoints")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, bytes of text): what bins and shards are sized by."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def bins_for(total: int, each: int, least: int = 8) -> int:
    """How many bins of about `each` bytes hold `total`; grows with the input, without an upper bound."""
    return max(least, math.ceil(total / each))


TASK_BYTES, LARGE_TASK, MANY_TASKS = 8 << 20, 128 << 20, 20_000


def tasks_for(total: int) -> int:
    """Tasks for an exchange of `total` bytes: TASK_BYTES each; from MANY_TASKS on, which cost the driver, up to LARGE_TASK each."""
    return max(min(bins_for(total, TASK_BYTES), MANY_TASKS), bins_for(total, LARGE_TASK))


def dealt(df: DataFrame, keys: str | list[str], n: int) -> DataFrame:
    """df by keys in n partitions: for group-bys and joins on them, so that more input makes more tasks, not larger ones."""
    return df.repartition(n, *([keys] if isinstance(keys, str) else keys))


def by_bin(df: DataFrame, key: str, n: int) -> DataFrame:
    """df in n partitions, an int key k in partition k mod n: equal shares of the bins, where hashing would pile several into one task."""
    return df.repartitionById(n, F.col(key))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list | None = None) -> DataFrame:
    """(k1, k2, doc_id, text, *more): k1, k2 identify the pair (id, text), never null.

    Rows that repeat both id and text share the key; each still counts as a document of its own.
    """
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(F.xxhash64(doc, text).alias("k1"), F.coalesce(doc, F.lit(-(2**63) + 1)).alias("k2"), doc.alias("doc_id"), text.alias("text"), *(more or []))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def rows_of(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the Arrow batches holding about `most` bytes of text each, with their texts (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        column = column.cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1, [batch.num_rows]))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j > i:
                yield batch.slice(i, j - i), [v or b"" for v in column.slice(i, j - i).to_pylist()]



SEPARATORS = b" \t\n\v\f\r"  # what ends a word
_IS_WORD = ~np.isin(np.arange(256), list(SEPARATORS))
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)


def words_at(raw: bytes) -> np.ndarray:
    """The 8 bytes at every place of raw as little-endian numbers, zeros past the end."""
    return np.ndarray(shape=(len(raw),), dtype="<u8", buffer=raw + bytes(8), strides=(1,))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of all texts in order, words in each text)."""
    raw = b" ".join([*texts, b""])
    if lower:
        raw = LOWER[np.frombuffer(raw, np.uint8)].tobytes()
    inside = np.concatenate(([False], _IS_WORD[np.frombuffer(raw, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    w = words_at(raw)
    h = mix64((w[starts] & _KEEP[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) << np.uint64(56)))
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more):
        if at > 1024:  # the rest of very long words at once
            for i in more.tolist():
                h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(raw[starts[i] + at : starts[i] + lengths[i]]))
            h[more] = mix64(h[more])
            break
        h[more] = mix64(h[more] * np.uint64(0x9E3779B97F4A7C15) ^ (w[starts[more] + at] & _KEEP[np.minimum(lengths[more] - at, 8)]))
        at += 8
        more = more[lengths[more] > at]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return h, np.diff(np.searchsorted(starts, ends), prepend=0)
