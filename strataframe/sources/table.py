"""Segments: immutable tables in Parquet, with per-column encodings, bloom filters and zone maps beside the data.

Sidecar tables (`_meta`, `_zones`, `_bloom_<column>`) live below the segment's path; Spark's readers skip names that
start with an underscore, so a segment is also a plain Parquet table.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregate, bloom, zonemap
from ..types import logical

#: encoding -> Parquet writer options of a column; version 2 pages have the delta and bit-packed encodings
ENCODINGS = {"plain": {"dictionary": False, "v2": False}, "rle": {"dictionary": True, "v2": False}, "dictionary": {"dictionary": True, "v2": False}, "delta": {"dictionary": False, "v2": True}, "for": {"dictionary": False, "v2": True}, "bitpack": {"dictionary": False, "v2": True}}
INTEGER_ONLY = ("for", "bitpack", "delta")
COMPRESSION = ("none", "zstd", "lz4", "lz4_raw", "snappy", "gzip")


def writer_options(schema: T.StructType, encodings: dict[str, str] | None = None, blooms: list[str] | None = None, compression: str = "zstd") -> dict[str, str]:
    """Parquet options for encodings by column; raises where an encoding does not fit a column's type."""
    if compression not in COMPRESSION:
        raise ValueError(f"no compression {compression}")
    out = {"compression": compression}
    for c, e in (encodings or {}).items():
        kind = logical(schema[c].dataType)
        if e not in ENCODINGS:
            raise ValueError(f"no encoding {e}")
        if e in INTEGER_ONLY and not kind.is_integer or not kind.is_numeric and e not in ("plain", "dictionary", "rle"):
            raise ValueError(f"{e} does not fit {c}: {kind.name}")
        out[f"parquet.enable.dictionary#{c}"] = str(ENCODINGS[e]["dictionary"]).lower()
        if ENCODINGS[e]["v2"]:
            out["parquet.writer.version"] = "PARQUET_2_0"
    for c in blooms or []:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
        out.setdefault(f"parquet.enable.dictionary#{c}", "false")  # a fully dictionary-coded chunk gets no filter
    return out


@dataclass
class SegmentWriter:
    """Collects what a segment is written with; `finish` writes it."""

    spark: SparkSession
    path: str
    row_id: str | None = None
    compression: str = "zstd"
    encodings: dict[str, str] = field(default_factory=dict)
    zones: dict[str, int] = field(default_factory=dict)
    blooms: dict[str, tuple[int, int]] = field(default_factory=dict)
    created_ts: int | None = None

    def encode(self, column: str, encoding: str) -> SegmentWriter:
        self.encodings[column] = encoding
        return self

    def add_zone_map(self, column: str, block_rows: int = zonemap.BLOCK_ROWS) -> SegmentWriter:
        self.zones[column] = block_rows
        return self

    def add_bloom_filter(self, column: str, bits: int = bloom.BITS, hashes: int = bloom.HASHES) -> SegmentWriter:
        self.blooms[column] = (bits, hashes)
        return self

    def finish(self, df: DataFrame, files: int | None = None) -> Segment:
        options = writer_options(df.schema, self.encodings, list(self.blooms), self.compression)
        if len(set(self.zones.values())) > 1:
            raise ValueError("the zone maps of a segment share one block size")
        if self.zones and not self.row_id:
            raise ValueError("zone maps need a row_id column")
        out = df
        if self.row_id:  # row order on disk is row_id order, so page and row-group statistics prune
            out = (df.repartitionByRange(files, self.row_id) if files else df.repartitionByRange(self.row_id)).sortWithinPartitions(self.row_id)
        elif files:
            out = df.coalesce(files)
        out.write.mode("errorifexists").options(**options).parquet(self.path)
        held = self.spark.read.schema(df.schema).parquet(self.path)
        block_rows = next(iter(self.zones.values()), None)
        ts = self.created_ts if self.created_ts is not None else time.time_ns() // 1000
        rows = [(f.name, logical(f.dataType).name, self.encodings.get(f.name, "plain"), self.row_id, block_rows, *(self.blooms.get(f.name, (None, None))), ts, i) for i, f in enumerate(df.schema.fields)]
        self.spark.createDataFrame(rows, "column string, type string, encoding string, row_id string, block_rows int, bloom_bits int, bloom_hashes int, created_ts long, ordinal int").coalesce(1).write.parquet(f"{self.path}/_meta")
        if self.zones:
            zonemap.build_zone_map(held, self.row_id, list(self.zones), block_rows).write.parquet(f"{self.path}/_zones")
        for c, (bits, hashes) in self.blooms.items():
            bloom.build_bloom(held, c, bits, hashes).write(f"{self.path}/_bloom_{c}")
        return Segment(self.spark, self.path)


@dataclass
class Segment:
    """A written segment, read lazily; the schema is the one it was written with."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(spark: SparkSession, path: str, schema: T.StructType, created_ts: int = 0) -> Segment:
        """An empty segment."""
        return SegmentWriter(spark, path, created_ts=created_ts).finish(spark.createDataFrame([], schema))

    @cached_property
    def meta(self) -> list:
        """A row per column, in order (the table has as many rows as the segment has columns)."""
        return self.spark.read.parquet(f"{self.path}/_meta").orderBy("ordinal").collect()

    @cached_property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def name(self, column: str | int) -> str:
        return self.meta[column]["column"] if isinstance(column, int) else column

    @property
    def num_columns(self) -> int:
        return len(self.meta)

    @cached_property
    def num_rows(self) -> int:
        return self.df.count()

    @property
    def created_ts(self) -> int:
        return self.meta[0]["created_ts"]

    def _of(self, column: str | int):
        name = self.name(column)
        return next(r for r in self.meta if r["column"] == name)

    def column_type(self, column: str | int) -> str:
        return self._of(column)["type"]

    def column_encoding(self, column: str | int) -> str:
        return self._of(column)["encoding"]

    def column(self, column: str | int = 0) -> DataFrame:
        return self.df.select(self.name(column))

    def read_values(self, column: str | int, offset: int, count: int) -> DataFrame:
        """Rows offset..offset+count-1 of a column, in row order; by the stored row id if there is one, so only their pages are read."""
        row_id = self.meta[0]["row_id"]
        if row_id:
            return self.df.where((F.col(row_id) >= offset) & (F.col(row_id) < offset + count)).orderBy(row_id).select(self.name(column))
        raise ValueError("a slice needs a segment with a row_id")

    def prefetch(self, *columns: str | int) -> DataFrame:
        """The columns, kept in executor memory and disk once read."""
        return self.df.select(*[self.name(c) for c in columns]).persist()

    def zone_map(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/_zones") if self.meta[0]["block_rows"] else None

    @property
    def block_rows(self) -> int | None:
        return self.meta[0]["block_rows"]

    def bloom_filter(self, column: str | int) -> bloom.Bloom | None:
        """None where the column has none: it then cannot prune."""
        r = self._of(column)
        if r["bloom_bits"] is None:
            return None
        return bloom.read_bloom(self.spark.read.parquet(f"{self.path}/_bloom_{r['column']}"), self.df.schema[r["column"]].dataType.simpleString(), r["bloom_bits"], r["bloom_hashes"])

    def stats(self) -> DataFrame:
        return aggregate.column_stats(self.df, self.df.columns)


def open_segment(spark: SparkSession, path: str) -> Segment:
    return Segment(spark, path)
