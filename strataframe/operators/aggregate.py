"""Aggregates over a scan, and column statistics: one pass, partial sums before the only exchange."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicate import Predicate


def aggregate_scan(df: DataFrame, columns: list[str], pred: Predicate | None = None) -> DataFrame:
    """One row: per column c over matching rows c_sum (double), c_count (non-null), c_min, c_max; no match: null, 0, null, null."""
    rows = df if pred is None else df.where(pred.column(df))
    out: list[Column] = []
    for c in columns:
        out += [F.sum(F.col(c).cast("double")).alias(f"{c}_sum"), F.count(c).alias(f"{c}_count"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return rows.agg(*out)


def column_sum(df: DataFrame, c: str) -> DataFrame:
    """Integers sum in 64 bits."""
    return df.agg(F.sum(c).alias("sum"))


def column_min(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.min(c).alias("min"))


def column_max(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.max(c).alias("max"))


def null_count(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count_if(F.col(c).isNull()).alias("null_count"))


def _typed(df: DataFrame, c: str) -> Column:
    """(column, n, x, s): a value as a long, a double or a string, by the column's type; decimals, dates and others as strings."""
    kind = df.schema[c].dataType
    v = F.col(f"`{c}`")
    whole, broken = isinstance(kind, T.IntegralType), isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType)
    return F.struct(F.lit(c).alias("column"), (v if whole else F.lit(None)).cast("long").alias("n"), (v if broken else F.lit(None)).cast("double").alias("x"), (v if not whole and not broken else F.lit(None)).cast("string").alias("s"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: column, total_count, null_count, distinct_count (exact, without nulls), min, max (numbers, as double), min_value, max_value (exact, as text).

    Values are counted once per column in one group-by over all columns, in their own type, so skewed values meet as
    partial counts and large integers stay apart. Columns that are no numbers have min and max as text only.
    """
    pairs = F.explode(F.array(*[_typed(df, c) for c in columns])).alias("p")
    values = df.select(pairs).select("p.*").groupBy("column", "n", "x", "s").agg(F.count(F.lit(1)).alias("rows"))
    known = F.col("n").isNotNull() | F.col("x").isNotNull() | F.col("s").isNotNull()
    ends = [f(F.coalesce(F.col("n").cast("double"), "x")).alias(name) for name, f in (("min", F.min), ("max", F.max))]
    exact = [F.coalesce(f("n").cast("string"), f("x").cast("string"), f("s")).alias(name) for name, f in (("min_value", F.min), ("max_value", F.max))]
    found = values.groupBy("column").agg(F.sum("rows").alias("total_count"), F.coalesce(F.sum(F.when(~known, F.col("rows"))), F.lit(0)).alias("null_count"), F.count_if(known).alias("distinct_count"), *ends, *exact)
    names = reduce(DataFrame.unionByName, [df.sparkSession.range(1).select(F.lit(c).alias("column")) for c in columns])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return names.join(found, "column", "left").select("column", zero("total_count"), zero("null_count"), zero("distinct_count"), "min", "max", "min_value", "max_value")


def merge_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Statistics of two parts together (min and max grow step by step; distinct counts cannot be merged and are left out)."""
    return a.unionByName(b).groupBy("column").agg(F.sum("total_count").alias("total_count"), F.sum("null_count").alias("null_count"), F.min("min").alias("min"), F.max("max").alias("max"))
