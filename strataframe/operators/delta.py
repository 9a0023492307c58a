"""A keyed change log: inserts and deletes are appended rows, resolved when read.

Log columns: row_id, ts, seq, op ('I' or 'D') and the payload. One rule everywhere: a key shows its latest insert (by
ts, then seq) unless a delete has the same or a later ts. Resolving is one group-by on the key, with map-side combine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("row_id", "ts", "seq", "op")
FLUSH_AT = 100_000
_STATE = "generation int, flushed long, flushing boolean"


def log_schema(payload: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("row_id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *payload.fields])


def payload_columns(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in KEYS]


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Per key: row_id, ins_ts, del_ts and the latest insert's payload, visible or not."""
    rows = log if as_of is None else log.where(F.col("ts") <= as_of)
    cols = payload_columns(log)
    entry = F.when(F.col("op") == "I", F.struct("ts", "seq", F.struct(*cols, F.lit(0).alias("__")).alias("p")))
    order = F.when(F.col("op") == "I", F.struct("ts", "seq"))
    out = rows.groupBy("row_id").agg(F.max_by(entry, order).alias("e"), F.max(F.when(F.col("op") == "D", F.col("ts"))).alias("del_ts"))
    return out.select("row_id", F.col("e.ts").alias("ins_ts"), "del_ts", *[F.col(f"e.p.`{c}`").alias(c) for c in cols])


def resolve(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Visible rows: row_id, ts, payload. as_of: the log up to that ts."""
    out = latest(log, as_of).where("ins_ts is not null and (del_ts is null or del_ts < ins_ts)")
    return out.withColumnRenamed("ins_ts", "ts").drop("del_ts")


def get(log: DataFrame, row_id: int, as_of: int | None = None) -> DataFrame:
    """The visible row of a key, or none; the key filter comes before the group-by."""
    return resolve(log.where(F.col("row_id") == row_id), as_of)


def get_range(log: DataFrame, start: int, end: int, as_of: int | None = None) -> DataFrame:
    """Visible rows with start <= row_id < end."""
    return resolve(log.where((F.col("row_id") >= start) & (F.col("row_id") < end)), as_of)


def inserts(log: DataFrame) -> DataFrame:
    return log.where("op = 'I'")


def deletes(log: DataFrame) -> DataFrame:
    return log.where("op = 'D'")


def pending(log: DataFrame) -> DataFrame:
    """One row: pending (inserts, overwrites included), deletes, memory (payload bytes + 16 an insert, 16 a delete), last_ts."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")) if isinstance(log.schema[c].dataType, (T.StringType, T.BinaryType)) else F.when(F.col(c).isNotNull(), F.lit(8 if isinstance(log.schema[c].dataType, (T.LongType, T.DoubleType)) else 4)), F.lit(0)) for c in payload_columns(log)), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return log.agg(F.count_if(F.col("op") == "I").alias("pending"), F.count_if(F.col("op") == "D").alias("deletes"), zero(F.sum(F.when(F.col("op") == "I", size + 16).otherwise(16))).cast("long").alias("memory"), F.max("ts").alias("last_ts"))


@dataclass
class DeltaLog:
    """A change log kept as Parquet files below path, in generations: one takes appends, older ones are being flushed.

    Opened on a path that has a log, it goes on from there: the clock and the sequence from the latest row, the newest
    generation, and the flushed count from a one-row table beside the log.
    """

    spark: SparkSession
    path: str
    payload: T.StructType
    flush_at: int = FLUSH_AT
    generation: int = 0
    clock: int = 0
    flushing: bool = False
    flushed: int = 0
    seq: int = 0

    def __post_init__(self) -> None:
        self.schema = log_schema(self.payload)
        last = self.log().agg(F.max("ts"), F.max("seq")).first()
        self.clock, self.seq = max(self.clock, last[0] or 0), max(self.seq, last[1] or 0)
        try:
            state = self.spark.read.schema(_STATE).parquet(f"{self.path}/_state").first()
        except AnalysisException:
            state = None
        if state:
            self.generation, self.flushed, self.flushing = state["generation"], state["flushed"], state["flushing"]

    def _keep_state(self) -> None:
        self.spark.createDataFrame([(self.generation, self.flushed, self.flushing)], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_state")

    def _append(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.mode("append").parquet(f"{self.path}/generation={self.generation}")

    def insert(self, rows: list[tuple] | DataFrame, ts: int = 0) -> None:
        """Rows of (row_id, *payload); ts 0: the next global ts for each row (DataFrames: one for all). Of equal keys and times the later row counts."""
        if isinstance(rows, DataFrame):
            self.clock = max(self.clock + 1, ts) if ts else self.clock + 1
            self._append(rows.withColumns({"ts": F.lit(ts or self.clock), "seq": F.lit(self.seq + 1) + F.monotonically_increasing_id(), "op": F.lit("I")}))
            self.seq = self.log().agg(F.max("seq")).first()[0] or self.seq
            return
        out = []
        for r in rows:
            self.clock, self.seq = self.clock + 1, self.seq + 1
            out.append((r[0], ts or self.clock, self.seq, "I", *r[1:]))
        self.clock = max(self.clock, ts)
        self._append(self.spark.createDataFrame(out, self.schema))

    def delete(self, row_ids: list[int], ts: int = 0) -> None:
        out = []
        for r in row_ids:
            self.clock, self.seq = self.clock + 1, self.seq + 1
            out.append((r, ts or self.clock, self.seq, "D", *[None] * len(self.payload)))
        self.clock = max(self.clock, ts)
        self._append(self.spark.createDataFrame(out, self.schema))

    def log(self, generation: int | None = None) -> DataFrame:
        """All generations, or one."""
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/generation={self.generation if generation is None else generation}") if generation is not None else self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def pending(self) -> int:
        return pending(self.log(self.generation)).first()["pending"] - self.flushed

    def should_flush(self) -> bool:
        return self.pending() >= self.flush_at

    def begin_flush(self) -> None:
        self.flushing = True
        self._keep_state()

    def end_flush(self, rows: int) -> None:
        self.flushed += rows
        self.flushing = False
        self._keep_state()

    def store_for_flush(self) -> DataFrame | None:
        """The active generation if it is due; appends go to the next from now on."""
        if not self.should_flush():
            return None
        self.generation, self.flushed, self.flushing = self.generation + 1, 0, True
        self._keep_state()
        return self.log(self.generation - 1)

    def finish_flush(self, generation: int | None = None) -> None:
        """Drop a drained generation (the last one handed out)."""
        g = self.generation - 1 if generation is None else generation
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation={g}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.flushing = False
        self._keep_state()

    def clear(self) -> None:
        for g in range(self.generation + 1):
            self.finish_flush(g)
