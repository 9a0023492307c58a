"""The six logical column types and their Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class LogicalType:
    name: str
    spark: T.DataType
    width: int | None  # bytes; None: variable

    @property
    def is_fixed_size(self) -> bool:
        return self.width is not None

    @property
    def is_integer(self) -> bool:
        return isinstance(self.spark, (T.IntegerType, T.LongType))

    @property
    def is_floating_point(self) -> bool:
        return isinstance(self.spark, (T.FloatType, T.DoubleType))

    @property
    def is_numeric(self) -> bool:
        return self.is_integer or self.is_floating_point

    is_signed = is_numeric


BOOLEAN = LogicalType("boolean", T.BooleanType(), 1)
INT32 = LogicalType("int32", T.IntegerType(), 4)
INT64 = LogicalType("int64", T.LongType(), 8)
FLOAT = LogicalType("float", T.FloatType(), 4)
DOUBLE = LogicalType("double", T.DoubleType(), 8)
VARCHAR = LogicalType("varchar", T.StringType(), None)
ALL = (BOOLEAN, INT32, INT64, FLOAT, DOUBLE, VARCHAR)


def logical(spark_type: T.DataType) -> LogicalType:
    """The logical type of a Spark type; raises for types outside the model."""
    for t in ALL:
        if isinstance(spark_type, type(t.spark)):
            return t
    raise TypeError(f"no logical type for {spark_type.simpleString()}")


def schema(**columns: LogicalType) -> T.StructType:
    """A nullable schema from names and logical types."""
    return T.StructType([T.StructField(n, t.spark) for n, t in columns.items()])
