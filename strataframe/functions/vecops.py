"""Element-wise vector operations as column expressions, and positional ones as tables.

Integers are widened to 64 bits first, so 32-bit inputs never overflow; saturating and packing operations clamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .positions import running_sum

INT32 = (-(2**31), 2**31 - 1)


def _long(c: Column) -> Column:
    return c.cast("long")


def widened(c: Column) -> Column:
    """Integers as longs; fractions stay what they are."""
    return c * F.lit(1).cast("long")


def add(a: Column, b: Column) -> Column:
    return widened(a) + b


def sub(a: Column, b: Column) -> Column:
    return widened(a) - b


def mul(a: Column, b: Column) -> Column:
    return widened(a) * b


def div(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def ternary_logic(a: Column, b: Column, c: Column, table: int) -> Column:
    """Bit by bit, bit (a << 2 | b << 1 | c) of an 8-bit truth table."""
    out = F.lit(0).cast("long")
    for i in range(8):
        if table >> i & 1:
            part = None
            for x, on in ((a, i & 4), (b, i & 2), (c, i & 1)):
                x = _long(x) if on else F.bitwise_not(_long(x))
                part = x if part is None else part.bitwiseAND(x)
            out = out.bitwiseOR(part)
    return out


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(_long(a), n)


def shift_right(a: Column, n: int) -> Column:
    """Arithmetic."""
    return F.shiftright(_long(a), n)


def shift_right_logical(a: Column, n: int) -> Column:
    return F.shiftrightunsigned(_long(a), n)


def absolute(a: Column) -> Column:
    return F.abs(a)


def minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def clamp(a: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), a))


def add_saturate(a: Column, b: Column, limits: tuple[int, int] = INT32) -> Column:
    return clamp(_long(a) + _long(b), *limits)


def sub_saturate(a: Column, b: Column, limits: tuple[int, int] = INT32) -> Column:
    return clamp(_long(a) - _long(b), *limits)


def mul_high(a: Column, b: Column) -> Column:
    """The upper 32 bits of the signed 64-bit product of 32-bit numbers."""
    return F.shiftright(_long(a) * _long(b), 32)


def pack_signed16(a: Column) -> Column:
    return clamp(_long(a), -32768, 32767).cast("int")


def pack_unsigned16(a: Column) -> Column:
    return clamp(_long(a), 0, 65535).cast("int")


def pop_count(a: Column) -> Column:
    return F.bit_count(a)


def blend(mask: Column, a: Column, b: Column) -> Column:
    """a where the mask holds, else b."""
    return F.when(mask, a).otherwise(b)


def masked(mask: Column, a: Column) -> Column:
    """A masked load: null where the mask does not hold."""
    return F.when(mask, a)


def permute(lanes: Column, order: Column) -> Column:
    """lanes[order[i]] for each i; places from 0."""
    return F.transform(order, lambda i: F.get(lanes, i))


def insert_lane(lanes: Column, place: int, value: Column) -> Column:
    return F.transform(lanes, lambda x, i: F.when(i == place, value).otherwise(x))


def extract_lane(lanes: Column, place: int) -> Column:
    return F.get(lanes, F.lit(place))


def reduce_lanes(lanes: Column, kind: str) -> Column:
    """add, min or max over an array."""
    if kind == "add":
        return F.aggregate(lanes, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.array_min(lanes) if kind == "min" else F.array_max(lanes)


def compress_lanes(lanes: Column, mask: Column) -> Column:
    """Surviving lanes packed to the left."""
    return F.transform(F.filter(F.arrays_zip(lanes.alias("x"), mask.alias("m")), lambda p: p["m"]), lambda p: p["x"])


def expand_lanes(values: Column, mask: Column) -> Column:
    """Values scattered to the set places of the mask, null elsewhere."""
    upto = lambda i: F.size(F.filter(F.slice(mask, 1, i + 1), lambda m: m))
    return F.transform(mask, lambda m, i: F.when(m, F.get(values, upto(i) - 1)))


def prefix_sum(df: DataFrame, row_id: str, value: str, out: str = "prefix_sum", block_rows: int = 8192) -> DataFrame:
    """Inclusive, over all rows."""
    return running_sum(df, row_id, value, out, block_rows)


def prefix_sum_block(df: DataFrame, row_id: str, value: str, lanes: int, out: str = "prefix_sum") -> DataFrame:
    """Inclusive, restarting every `lanes` rows."""
    w = Window.partitionBy(F.expr(f"`{row_id}` div {int(lanes)}")).orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def compress(df: DataFrame, row_id: str, mask: Column, lanes: int, out: str = "lane") -> DataFrame:
    """Rows where the mask holds, with their place among the survivors of their group of lanes (from 0)."""
    w = Window.partitionBy(F.expr(f"`{row_id}` div {int(lanes)}")).orderBy(row_id)
    return df.where(mask).withColumn(out, (F.row_number().over(w) - 1).cast("int"))


def conflict_detect(df: DataFrame, row_id: str, value: str, lanes: int, out: str = "conflicts") -> DataFrame:
    """How many earlier lanes of the group hold the same value."""
    w = Window.partitionBy(F.expr(f"`{row_id}` div {int(lanes)}"), value).orderBy(row_id)
    return df.withColumn(out, (F.row_number().over(w) - 1).cast("int"))


def shift_left_by(a: Column, n: Column) -> Column:
    """Each lane by a count of its own (0 to 63)."""
    return F.call_function("shiftleft", a, n.cast("int"))


def shift_right_by(a: Column, n: Column) -> Column:
    """Arithmetic, each lane by a count of its own (0 to 63)."""
    return F.call_function("shiftright", a, n.cast("int"))


def mul_high64(a: Column, b: Column) -> Column:
    """The upper 64 bits of the 128-bit product of longs."""
    product, word = a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    return F.call_function("div", product - F.pmod(product, word), word).cast("long")
