"""Merging segments and folding a change log into a new version of a table."""

from __future__ import annotations

import time
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .delta import latest, payload_columns


@dataclass(frozen=True)
class MergeStats:
    rows_in: int
    rows_out: int
    rows_inserted: int
    rows_deleted: int
    microseconds: int


def merge_segments(spark: SparkSession, segments: list[DataFrame], schema: T.StructType) -> DataFrame:
    """All rows of all segments (by column name); no segments: an empty table; one: itself."""
    return reduce(DataFrame.unionByName, segments) if segments else spark.createDataFrame([], schema)


def ordered_by_ts(segments: list[tuple[DataFrame, int]], row_id: str) -> DataFrame:
    """Segments with a creation time each, as rows with ts, source_ord and pos; ordering by these is the stable merge order."""
    parts = [df.withColumns({"ts": F.lit(ts).cast("long"), "source_ord": F.lit(i), "pos": F.col(row_id).cast("long")}) for i, (df, ts) in enumerate(segments)]
    return reduce(DataFrame.unionByName, parts)


def merge_column(segments: list[tuple[DataFrame, int]], row_id: str, value: str, log: DataFrame | None = None, kind: str = "long") -> DataFrame:
    """(ts, source_ord, pos, value) of segments and of a log's visible inserts after them; sort by the first three for the order.

    No segments and no log: no rows, value of type `kind`.
    """
    if not segments and log is None:
        return SparkSession.active().createDataFrame([], f"ts long, source_ord int, pos long, value {kind}")
    base = ordered_by_ts(segments, row_id).select("ts", "source_ord", "pos", F.col(value).alias("value"), F.col(row_id).cast("long").alias("k")) if segments else None
    if log is None:
        return base.drop("k")
    keys = latest(log)
    live = keys.where("ins_ts is not null and (del_ts is null or del_ts < ins_ts)").select(F.col("ins_ts").alias("ts"), F.lit(len(segments)).alias("source_ord"), F.col("row_id").alias("pos"), F.col(value).alias("value"))
    if base is None:
        return live
    gone = keys.select("row_id", F.greatest("ins_ts", "del_ts").alias("last"))
    kept = base.join(gone, (base["k"] == gone["row_id"]) & (gone["last"] >= base["ts"]), "left_anti").drop("k")
    return kept.unionByName(live)


def apply_log(base: DataFrame, log: DataFrame, key: str = "row_id") -> DataFrame:
    """The base with touched keys taken out and the log's visible rows put in.

    One join on the key; Spark broadcasts the log's keys only if they are small, and splits skewed keys.
    """
    keys = latest(log)
    cols = payload_columns(log)
    live = keys.where("ins_ts is not null and (del_ts is null or del_ts < ins_ts)").select(F.col("row_id").alias(key), *cols)
    kept = base.join(keys.select(F.col("row_id").alias(key)), key, "left_anti").select(key, *cols)
    return kept.unionByName(live)


def compact(base: DataFrame, log: DataFrame, path: str, key: str = "row_id", files: int | None = None, compression: str = "zstd") -> MergeStats:
    """Write base and log as a new table version below path, range-dealt by the key so that its statistics prune; the inputs stay."""
    began = time.perf_counter()
    out = apply_log(base, log, key)
    out = out.repartitionByRange(files, key) if files else out.repartitionByRange(key)
    out.sortWithinPartitions(key).write.mode("errorifexists").option("compression", compression).parquet(path)
    n_in, n_out = base.count(), base.sparkSession.read.parquet(path).count()
    keys = latest(log)
    row = keys.join(base.select(F.col(key).alias("row_id")), "row_id", "left_semi").agg(F.count(F.lit(1)).alias("touched"), F.count_if(F.expr("ins_ts is null or del_ts >= ins_ts")).alias("gone")).first() if n_in else None
    touched, gone = (row["touched"], row["gone"]) if row else (0, 0)
    return MergeStats(n_in, n_out, n_out - (n_in - touched), gone, int((time.perf_counter() - began) * 1e6))


class Merger:
    """Merges in the background: each submitted merge is a Spark job of its own."""

    def __init__(self, spark: SparkSession, workers: int = 4, on_stats=None):
        self.spark, self.pool, self.on_stats, self.last_stats = spark, ThreadPoolExecutor(workers), on_stats, None

    def submit(self, segments: list[DataFrame], schema: T.StructType, path: str, files: int | None = None) -> Future:
        """Future of the merged table's path."""

        def work() -> str:
            began = time.perf_counter()
            out = merge_segments(self.spark, segments, schema)
            (out.coalesce(files) if files else out).write.mode("errorifexists").parquet(path)
            n = self.spark.read.schema(schema).parquet(path).count()
            self.last_stats = MergeStats(n, n, 0, 0, int((time.perf_counter() - began) * 1e6))
            if self.on_stats:
                self.on_stats(self.last_stats)
            return path

        return self.pool.submit(work)

    def stop(self) -> None:
        self.pool.shutdown(wait=True)
