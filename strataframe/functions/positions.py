"""Ranks and running sums over all rows without a global window: per part first, then the parts' offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAN = 4096


def block_offsets(parts: DataFrame, part: str, value: str) -> DataFrame:
    """(part, before): the sum of value over all smaller parts (integers from 0), in two levels of FAN parts."""
    held = parts.withColumn("__up", F.expr(f"`{part}` div {FAN}"))
    ups = held.groupBy("__up").agg(F.sum(value).alias("__s"))
    ups = ups.select("__up", (F.sum("__s").over(Window.partitionBy(F.expr(f"__up div {FAN}")).orderBy("__up")) - F.col("__s")).alias("__b"), F.expr(f"__up div {FAN}").alias("__top"), "__s")
    tops = ups.groupBy("__top").agg(F.sum("__s").alias("__t"))
    tops = tops.select("__top", (F.sum("__t").over(Window.orderBy("__top")) - F.col("__t")).alias("__tb"))  # a row for FAN * FAN parts
    ups = ups.join(tops, "__top").select("__up", (F.col("__b") + F.col("__tb")).alias("__ub"))
    own = F.sum(value).over(Window.partitionBy("__up").orderBy(part)) - F.col(value)
    return held.withColumn("__o", own).join(ups, "__up").select(part, (F.col("__o") + F.col("__ub")).alias("before"))


def running_sum(df: DataFrame, row_id: str, value: str, out: str, block_rows: int = 8192) -> DataFrame:
    """df with the inclusive running sum of value by row_id: a window per block plus the blocks' offsets."""
    block = F.expr(f"`{row_id}` div {int(block_rows)}")
    held = df.withColumn("__block", block)
    sums = held.groupBy("__block").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__s"))
    offsets = block_offsets(sums, "__block", "__s")
    own = F.sum(value).over(Window.partitionBy("__block").orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("__own", own).join(offsets, "__block").withColumn(out, F.coalesce("__own", F.lit(0)) + F.col("before")).drop("__block", "__own", "before")


def dense_codes(values: DataFrame, by: str, code: str = "code", parts: int = 1024) -> DataFrame:
    """values (distinct rows, a numeric column `by` without nulls) with codes 0, 1, ... in order of `by`.

    Rows are cut into ranges of equal width between the extremes, ranked within each, and shifted by the sizes before.
    """
    ends = values.agg(F.min(by).cast("double").alias("__lo"), F.max(by).cast("double").alias("__hi"))  # one row
    held = values.join(F.broadcast(ends))
    width = F.greatest((F.col("__hi") - F.col("__lo")) / F.lit(float(parts)), F.lit(1e-300))
    held = held.withColumn("__part", F.least(F.floor((F.col(by).cast("double") - F.col("__lo")) / width), F.lit(parts)).cast("long")).drop("__lo", "__hi")
    offsets = block_offsets(held.groupBy("__part").agg(F.count(F.lit(1)).alias("__s")), "__part", "__s")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return held.withColumn("__own", own).join(offsets, "__part").withColumn(code, (F.col("__own") + F.col("before")).cast("long")).drop("__part", "__own", "before")


