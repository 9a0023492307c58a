"""Bloom sketches as tables: bitmaps of 32768 bits, built, merged and probed with Spark's bitmap functions.

The i-th position of a value is pmod(h1 + i * h2, bits), with h1, h2 from xxhash64; values are hashed in the type
of the sketch, so negatives, fractions and long strings are all found again. A sketch has at most bits / 8 bytes.
One of a fixed size fills up as values are added, until it answers yes to everything; a rate keeps it sparse.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, HASHES = 1 << 20, 7
BUCKET = 32768  # bits of a bitmap of bitmap_construct_agg
MARGIN = 1.25  # five standard deviations of approx_count_distinct


def positions(value: Column, bits: int = BITS, hashes: int = HASHES) -> Column:
    """The value's bit positions, an array of longs."""
    h1, h2 = F.shiftrightunsigned(F.xxhash64(value), 8), F.shiftrightunsigned(F.xxhash64(value, F.lit(1)), 8)
    return F.array(*[F.pmod(h1 + F.lit(i) * h2, F.lit(bits)) for i in range(hashes)])


@dataclass(frozen=True)
class Bloom:
    """table: (block_id if blocked), bucket, bitmap. An absent bitmap is empty; an absent sketch is None and never prunes."""

    table: DataFrame
    kind: str
    bits: int = BITS
    hashes: int = HASHES
    blocked: bool = False

    def _keys(self) -> list[str]:
        return ["block_id", "bucket"] if self.blocked else ["bucket"]

    def merge(self, other: Bloom) -> Bloom:
        """Bitwise OR of equal-shaped sketches."""
        if (self.kind, self.bits, self.hashes, self.blocked) != (other.kind, other.bits, other.hashes, other.blocked):
            raise ValueError("sketches of different shapes")
        both = self.table.unionByName(other.table)
        return Bloom(both.groupBy(*self._keys()).agg(F.bitmap_or_agg("bitmap").alias("bitmap")), self.kind, self.bits, self.hashes, self.blocked)

    def might_contain(self, probes: DataFrame, column: str, block: str | None = None) -> DataFrame:
        """probes and might_contain; null values: false; an unknown block: false."""
        value = F.col(f"`{column}`").cast(self.kind)
        names = probes.columns
        values = probes.select(value.alias("v"), *([F.col(f"`{block}`").alias("block_id")] if block else [])).where("v is not null").distinct()
        bit = values.withColumn("p", F.explode(positions(F.col("v"), self.bits, self.hashes))).withColumn("bucket", F.expr(f"p div {BUCKET}"))
        byte = F.conv(F.hex(F.expr(f"substring(bitmap, cast((p % {BUCKET}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        is_set = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(p % 8 as int))")) != 0, F.lit(False))
        on = ["block_id", "bucket"] if block else ["bucket"]
        found = bit.join(self.table, on, "left").groupBy("v", *on[:-1]).agg(F.bool_and(is_set).alias("might_contain"))
        right = found.select(F.col("v").alias("__v"), *([F.col("block_id").alias("__b")] if block else []), "might_contain")
        condition = (value == F.col("__v")) & (F.col(f"`{block}`") == F.col("__b")) if block else value == F.col("__v")
        return probes.join(right, condition, "left").select(*[F.col(f"`{c}`") for c in names], F.coalesce("might_contain", F.lit(False)).alias("might_contain"))

    def bits_set(self) -> DataFrame:
        """(block_id,) bits_set, false_positive_rate."""
        n = F.sum(F.bitmap_count("bitmap"))
        out = [n.alias("bits_set"), F.pow(n / F.lit(float(self.bits)), F.lit(float(self.hashes))).alias("false_positive_rate")]
        return self.table.groupBy("block_id").agg(*out) if self.blocked else self.table.agg(*out)

    def write(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)


def bits_for(n: float, rate: float, bits: int = BITS, hashes: int = HASHES) -> int:
    """bits, doubled until at most a share `rate` of other values is expected to pass for one of n values."""
    if not 0 < rate < 1 or bits < 1:
        raise ValueError("a rate between 0 and 1 and at least one bit")
    while (1 - math.exp(-hashes * n / bits)) ** hashes > rate:
        bits *= 2
    return bits


def build_bloom(df: DataFrame, column: str, bits: int = BITS, hashes: int = HASHES, block: Column | None = None, rate: float | None = None) -> Bloom:
    """A sketch of the column's non-null values; with block, one of the full size per block.

    rate: bits is then the least size and doubles with the number of different values (in the fullest block), which
    a pass of its own estimates, so that at most about that share of other values is found.
    """
    kind = df.schema[column].dataType.simpleString()
    if rate is not None:
        each = df.groupBy(*([block.alias("block_id")] if block is not None else [])).agg(F.approx_count_distinct(F.col(f"`{column}`")).alias("n"))
        bits = bits_for(MARGIN * (each.agg(F.max("n")).first()[0] or 0), rate, bits, hashes)
    p = df.where(F.col(f"`{column}`").isNotNull()).select(*([block.alias("block_id")] if block is not None else []), F.explode(positions(F.col(f"`{column}`"), bits, hashes)).alias("p"))
    p = p.withColumn("bucket", F.expr(f"p div {BUCKET}"))
    keys = ["block_id", "bucket"] if block is not None else ["bucket"]
    return Bloom(p.groupBy(*keys).agg(F.bitmap_construct_agg((F.col("p") % BUCKET)).alias("bitmap")), kind, bits, hashes, block is not None)


def read_bloom(df: DataFrame, kind: str, bits: int = BITS, hashes: int = HASHES) -> Bloom:
    return Bloom(df, kind, bits, hashes, "block_id" in df.columns)
