"""Change ingestion with Structured Streaming: files of changes go to the log, the log to new table versions.

The stream only appends; resolving and compaction are the batch operators. Each micro-batch is written below its own
batch id, so a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delta import latest, pending


def ingest(spark: SparkSession, source: str, schema, log_path: str, checkpoint: str, flush_at: int | None = None, on_flush: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Read change files that are there now into log_path/batch=N.

    With flush_at, call on_flush(log) once that many inserts are pending, with the batches since the last flush; these
    are then drained: a one-row table beside the log keeps the last batch that was, so they are not counted or handed
    out again, in this run or a later one.
    """
    changes = spark.readStream.schema(schema).parquet(source)

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
        if flush_at is not None and on_flush is not None:
            log = spark.read.schema(schema).parquet(*[f"{log_path}/batch={b}" for b in range(drained(spark, log_path) + 1, batch_id + 1)])
            if pending(log).first()["pending"] >= flush_at:
                on_flush(log)
                spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{log_path}/_drained")

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(spark: SparkSession, log_path: str) -> int:
    """The last batch that a flush has taken, or -1."""
    try:
        return spark.read.schema("batch long").parquet(f"{log_path}/_drained").first()["batch"]
    except AnalysisException:
        return -1


def read_log(spark: SparkSession, schema, log_path: str) -> DataFrame:
    """All batches of an ingested log."""
    return spark.read.schema(schema).parquet(log_path).select(*schema.names)


def resolved_stream(spark: SparkSession, source: str, schema) -> DataFrame:
    """The log's keys as a stream, for output mode update: row_id, ts, payload of each key that a batch has touched, and whether it is visible now.

    The state has one row a key. A late change counts by its ts, as in the log.
    """
    out = latest(spark.readStream.schema(schema).parquet(source))
    visible = F.coalesce(F.expr("ins_ts is not null and (del_ts is null or del_ts < ins_ts)"), F.lit(False))
    return out.withColumn("visible", visible).withColumnRenamed("ins_ts", "ts").drop("del_ts")
