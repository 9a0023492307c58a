"""The logical content of lightweight encodings as tables: what they store, how it is read back, filters on it.

Physical encoding is Parquet's (see sources/table.py). Positional encodings take an explicit unique row_id and work
block by block (row_id div block_rows), so every window has a bounded partition.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .positions import dense_codes

BLOCK_ROWS = 8192


def _block(row_id: str, rows: int) -> Column:
    return F.expr(f"`{row_id}` div {int(rows)}")


def rle_encode(df: DataFrame, row_id: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block_id, run_start, value, run_length): maximal runs of equal values (nulls are equal) within a block; row ids are dense."""
    w = Window.partitionBy("block_id").orderBy("row_id")
    rows = df.select(F.col(row_id).alias("row_id"), F.col(value).alias("value"), _block(row_id, block_rows).alias("block_id"))
    fresh = (F.row_number().over(w) == 1) | ~F.col("value").eqNullSafe(F.lag("value").over(w))
    runs = rows.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("block_id", "run").agg(F.min("row_id").alias("run_start"), F.first("value").alias("value"), F.count(F.lit(1)).alias("run_length")).drop("run")


def rle_decode(runs: DataFrame) -> DataFrame:
    """(row_id, value) of runs."""
    return runs.select(F.explode(F.expr("sequence(run_start, run_start + run_length - 1)")).alias("row_id"), "value")


_OPS = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


def rle_filter(runs: DataFrame, op: str, constant) -> DataFrame:
    """Rows whose value compares true: the comparison is made once a run, survivors are expanded."""
    return rle_decode(runs.where(_OPS[op](F.col("value"), F.lit(constant))))


def rle_size(runs: DataFrame, width: int = 4) -> DataFrame:
    """One row: runs and estimated bytes (a value and a 32-bit length each)."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), (F.count(F.lit(1)) * (width + 4)).alias("bytes"))


def delta_encode(df: DataFrame, row_id: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, block_id, delta): the block's first value as it is, then differences; no nulls."""
    w = Window.partitionBy("block_id").orderBy("row_id")
    rows = df.select(F.col(row_id).alias("row_id"), _block(row_id, block_rows).alias("block_id"), F.col(value).alias("value"))
    return rows.select("row_id", "block_id", (F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0))).alias("delta"))


def delta_decode(deltas: DataFrame) -> DataFrame:
    """(row_id, value)."""
    w = Window.partitionBy("block_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("row_id", F.sum("delta").over(w).alias("value"))


def bit_width(span: Column) -> Column:
    """Bits of a non-negative whole number; 0 for 0."""
    return F.when(span == 0, F.lit(0)).otherwise(F.length(F.bin(span)))


def for_encode(df: DataFrame, row_id: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row_id, block_id, base, residual): frame of reference per block, base the block's minimum."""
    rows = df.select(F.col(row_id).alias("row_id"), _block(row_id, block_rows).alias("block_id"), F.col(value).cast("long").alias("value"))
    w = Window.partitionBy("block_id")
    return rows.withColumn("base", F.min("value").over(w)).select("row_id", "block_id", "base", (F.col("value") - F.col("base")).alias("residual"))


def for_decode(frames: DataFrame) -> DataFrame:
    return frames.select("row_id", (F.col("base") + F.col("residual")).alias("value"))


def for_blocks(df: DataFrame, row_id: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block_id, base, width, n, bytes) of each block, bytes for residuals packed floor(64 / width) to a 64-bit word."""
    v = F.col(value).cast("long")
    out = df.groupBy(_block(row_id, block_rows).alias("block_id")).agg(F.min(v).alias("base"), bit_width(F.max(v) - F.min(v)).alias("width"), F.count(value).alias("n"))
    per = F.floor(F.lit(64) / F.greatest("width", F.lit(1)))
    return out.withColumn("bytes", F.when(F.col("width") == 0, F.lit(0)).otherwise(F.ceil(F.col("n") / per) * 8))


def bitpack(df: DataFrame, value: str) -> DataFrame:
    """One row: base, width, n and packed bytes of a whole column."""
    v = F.col(value).cast("long")
    return df.agg(F.min(v).alias("base"), bit_width(F.max(v) - F.min(v)).alias("width"), F.count(value).alias("n")).withColumn("bytes", F.ceil(F.col("n") * F.col("width") / 64) * 8)


def bitpack_encode(df: DataFrame, row_id: str, value: str) -> DataFrame:
    """(row_id, base, residual) over the whole column; the base comes as one broadcast row."""
    base = df.agg(F.min(F.col(value).cast("long")).alias("base"))
    return df.select(F.col(row_id).alias("row_id"), F.col(value).cast("long").alias("value")).join(F.broadcast(base)).select("row_id", "base", (F.col("value") - F.col("base")).alias("residual"))


def zigzag(x: Column) -> Column:
    """Signed to unsigned order: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    x = x.cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def for_zigzag_encode(df: DataFrame, row_id: str, value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Frame of reference over zigzag values."""
    return for_encode(df.select(F.col(row_id), zigzag(F.col(value)).alias(value)), row_id, value, block_rows)


def for_zigzag_decode(frames: DataFrame) -> DataFrame:
    return frames.select("row_id", unzigzag(F.col("base") + F.col("residual")).alias("value"))


def dictionary_sorted(df: DataFrame, value: str) -> DataFrame:
    """(value, code): distinct non-null values in order; any number of them."""
    return dense_codes(df.select(F.col(value).alias("value")).where("value is not null").distinct(), "value")


def dictionary_first_seen(df: DataFrame, row_id: str, value: str) -> DataFrame:
    """(value, code): distinct non-null values in order of their first row."""
    first = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(row_id).alias("first"))
    return dense_codes(first, "first").drop("first")


def dictionary_encode(df: DataFrame, row_id: str, value: str, codes: DataFrame, strict: bool = False) -> DataFrame:
    """(row_id, code); values outside the dictionary: null, or an error with strict. Spark broadcasts the dictionary if its size allows."""
    code = F.col("code") if not strict else F.when(F.col("code").isNotNull() | F.col("v").isNull(), F.col("code")).otherwise(F.raise_error(F.lit("a value is not in the dictionary")).cast("long"))
    return df.select(F.col(row_id).alias("row_id"), F.col(value).alias("v")).join(codes, F.col("v") == F.col("value"), "left").select("row_id", code.alias("code"))


def dictionary_decode(coded: DataFrame, codes: DataFrame) -> DataFrame:
    """(row_id, value)."""
    return coded.join(codes, "code", "left").select("row_id", "value")


def code_width(cardinality: Column) -> Column:
    """Bytes of a code: 1, 2 or 4."""
    return F.when(cardinality <= 256, F.lit(1)).when(cardinality <= 65536, F.lit(2)).otherwise(F.lit(4))


def dictionary_size(df: DataFrame, value: str, width: int = 4) -> DataFrame:
    """One row: cardinality and estimated bytes (entries and codes)."""
    n = df.agg(F.countDistinct(value).alias("cardinality"), F.count(value).alias("n"))
    return n.select("cardinality", (F.col("cardinality") * width + F.col("n") * code_width(F.col("cardinality"))).alias("bytes"))


def dictionary_write(codes: DataFrame, path: str) -> None:
    """Keep a dictionary's table, sorted by code."""
    codes.repartitionByRange("code").sortWithinPartitions("code").write.mode("errorifexists").parquet(path)


def dictionary_read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
