"""Scans: filter and projection over one table or many segments, delivery to a callback, statistics and cancelling."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import Bloom
from .predicate import Node, Predicate, Term
from .zonemap import BLOCK_ROWS, block_of, can_match, pruned_scan


@dataclass(frozen=True)
class ScanOptions:
    """columns: the projection (None: all); zones: a zone map to prune with; block_rows: rows of its blocks; row_id: the position column; blooms: sketches of the whole table, by column."""

    columns: tuple[str, ...] | None = None
    row_id: str | None = None
    block_rows: int = BLOCK_ROWS
    zones: DataFrame | None = None
    blooms: dict[str, Bloom] | None = None


def scan(df: DataFrame, pred: Predicate, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Matching rows, projected. The filter and the projection reach the Parquet reader; a table whose sketches deny the predicate is not read."""
    if options.blooms and not segment_can_match_blooms(pred, options.blooms, df.sparkSession, df.columns).first()["keep"]:
        out = df.where(F.lit(False))
    elif options.zones is not None and options.row_id:
        out = pruned_scan(df, options.zones, pred, options.row_id, options.block_rows)
    else:
        out = df.where(pred.column(df))
    return out.select(*options.columns) if options.columns else out


def scan_segments(segments: list[DataFrame], pred: Predicate, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One scan over many segments of one schema: their rows together, in no order; Spark deals the files to tasks."""
    if not segments:
        raise ValueError("a scan needs a segment")
    return scan(reduce(DataFrame.unionByName, segments), pred, options)


def deliver(found: DataFrame, output: Callable[[pa.RecordBatch], None], rows: int = 4096) -> None:
    """Hand matching rows to output(batch) on the executors, at most `rows` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                output(batch.slice(a, rows))
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    found.mapInArrow(run, "n long").count()


def segment_can_match_blooms(pred: Predicate, blooms: dict[str, Bloom], spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
    """One row, keep: whether a segment with these sketches may hold a matching row.

    An equality whose value its column's sketch denies cannot hold; AND needs both sides, OR one; below NOT, and for
    other terms or columns without a sketch, nothing is known.
    """
    out, n = spark.range(1).select(F.lit(True).alias("known")), 0

    def possible(x):
        nonlocal out, n
        if isinstance(x, Node) and x.kind != "not":
            a, b = (possible(p) for p in x.parts)
            return a & b if x.kind == "and" else a | b
        name = (columns[x.column] if isinstance(x.column, int) else x.column) if isinstance(x, Term) and x.kind == "eq" else None
        if name is None or name not in blooms or blooms[name].blocked:
            return F.lit(True)
        n += 1
        one = blooms[name].might_contain(spark.createDataFrame([(x.value,)], f"v {blooms[name].kind}"), "v")
        out = out.crossJoin(one.select(F.col("might_contain").alias(f"t{n}")))  # one row by one row
        return F.col(f"t{n}")

    keep = possible(pred.tree)
    return out.select(keep.alias("keep"))


class CancellableScan:
    """Runs actions under a tag so that another thread can stop them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, f"scan-{uuid.uuid4().hex}"

    def run(self, action: Callable):
        self.spark.addTag(self.tag)
        try:
            return action()
        finally:
            self.spark.removeTag(self.tag)

    def cancel(self) -> list[str]:
        return self.spark.interruptTag(self.tag)


def scan_stats(df: DataFrame, pred: Predicate, row_id: str, zones: DataFrame, block_rows: int = BLOCK_ROWS, blooms: dict[str, Bloom] | None = None) -> DataFrame:
    """One row: blocks_scanned (all), blocks_pruned_zone, blocks_pruned_bloom, rows_scanned (all), rows_filtered (rows of read blocks that do not match), rows_returned.

    A bloom prunes only where the whole predicate is one equality, so no matching row is ever lost.
    """
    keep = zones.select("block_id", "row_count", can_match(pred, zones, df.columns).alias("zone"))
    probe = pred.tree if isinstance(pred.tree, Term) and pred.tree.kind == "eq" else None
    name = (df.columns[probe.column] if isinstance(probe.column, int) else probe.column) if probe else None
    if probe and blooms and name in blooms:
        spark = df.sparkSession
        sketch = blooms[name]
        one = spark.createDataFrame([(probe.value,)], f"v {sketch.kind}")
        if sketch.blocked:
            keep = sketch.might_contain(keep.join(F.broadcast(one)), "v", "block_id").withColumnRenamed("might_contain", "bloom").drop("v")
        else:
            keep = keep.join(F.broadcast(sketch.might_contain(one, "v").select(F.col("might_contain").alias("bloom"))))
    else:
        keep = keep.withColumn("bloom", F.lit(True))
    matches = df.select(block_of(row_id, block_rows).alias("block_id"), pred.column(df).alias("m")).groupBy("block_id").agg(F.count_if("m").alias("matched"))
    read = F.col("zone") & F.col("bloom")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return keep.join(matches, "block_id", "left").agg(
        F.count(F.lit(1)).alias("blocks_scanned"), F.count_if(~F.col("zone")).alias("blocks_pruned_zone"), F.count_if(F.col("zone") & ~F.col("bloom")).alias("blocks_pruned_bloom"),
        zero(F.sum("row_count")).alias("rows_scanned"), zero(F.sum(F.when(read, F.col("row_count") - F.coalesce("matched", F.lit(0))))).alias("rows_filtered"), zero(F.sum(F.when(read, F.col("matched")))).alias("rows_returned"),
    )
