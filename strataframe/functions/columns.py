"""Building columns: tables of row_id (0, 1, ...) and values that grow, shrink and take nulls, as new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def copy_range(df: DataFrame, start: int, count: int, row_id: str = "row_id") -> DataFrame:
    """Rows start..start+count-1, numbered from 0."""
    return df.where((F.col(row_id) >= start) & (F.col(row_id) < start + count)).withColumn(row_id, F.col(row_id) - F.lit(start))


def append(df: DataFrame, more: DataFrame, size: int | None = None, row_id: str = "row_id") -> DataFrame:
    """df and, after its `size` rows (counted if not given), the rows of more, whose numbers start at 0."""
    size = df.count() if size is None else size
    return df.unionByName(more.withColumn(row_id, F.col(row_id) + F.lit(size)))


def append_nulls(df: DataFrame, count: int, size: int | None = None, row_id: str = "row_id") -> DataFrame:
    """df and `count` rows of nulls after it."""
    names = [f for f in df.schema.fields if f.name != row_id]
    nulls = df.sparkSession.range(count).select(F.col("id").cast(df.schema[row_id].dataType).alias(row_id), *[F.lit(None).cast(f.dataType).alias(f.name) for f in names])
    return append(df, nulls, size, row_id)


def resize(df: DataFrame, size: int, row_id: str = "row_id") -> DataFrame:
    """The first `size` rows; where there are fewer, nulls follow."""
    have = df.count()
    return copy_range(df, 0, size, row_id) if have >= size else append_nulls(df, size - have, have, row_id)


def set_null(df: DataFrame, column: str, where: Column) -> DataFrame:
    """The column with nulls where the condition holds."""
    return df.withColumn(column, F.when(~F.coalesce(where, F.lit(False)), F.col(f"`{column}`")))
