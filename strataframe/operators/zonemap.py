"""Zone maps: min, max and null counts of each block of rows, as a table that predicates can be tested against.

Blocks are row_id div block_rows, one group-by of the table. A predicate becomes a pair of expressions over a block's
statistics, whether some row can make it true and whether some row can make it false, so AND, OR and NOT all prune
without ever losing a row. On Parquet itself the same pruning happens in the reader, by row group and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .predicate import Node, Predicate, Term

BLOCK_ROWS = 8192
RANGES = 64


def block_of(row_id: str, block_rows: int = BLOCK_ROWS) -> Column:
    return F.expr(f"`{row_id}` div {int(block_rows)}")


def _fractional(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))


def build_zone_map(df: DataFrame, row_id: str, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """block_id, row_count and, per column c, c_min, c_max (without nulls and NaN), c_nulls and, for fractions, c_nans."""
    out = [F.count(F.lit(1)).alias("row_count")]
    for c in columns:
        v = F.when(~F.isnan(c), F.col(c)) if _fractional(df, c) else F.col(c)
        out += [F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls")]
        if _fractional(df, c):
            out.append(F.count_if(F.isnan(c)).alias(f"{c}_nans"))
    return df.groupBy(block_of(row_id, block_rows).alias("block_id")).agg(*out)


def _possible(x: Term | Node | None, names: set[str], columns: list[str] | None) -> tuple[Column, Column]:
    """(a row can make it true, a row can make it false); both true where nothing is known."""
    yes = F.lit(True)
    if x is None:
        return yes, F.lit(False)
    if isinstance(x, Node):
        parts = [_possible(p, names, columns) for p in x.parts]
        if x.kind == "not":
            return parts[0][1], parts[0][0]
        (a, na), (b, nb) = parts
        return (a & b, na | nb) if x.kind == "and" else (a | b, na & nb)
    c = columns[x.column] if isinstance(x.column, int) else x.column
    if f"{c}_min" not in names:
        return yes, yes
    low, high, nulls = F.col(f"{c}_min"), F.col(f"{c}_max"), F.col(f"{c}_nulls")
    some = nulls < F.col("row_count")
    if x.kind in ("is_null", "is_not_null"):
        return (nulls > 0, some) if x.kind == "is_null" else (some, nulls > 0)
    nan = F.col(f"{c}_nans") > 0 if f"{c}_nans" in names else F.lit(False)
    values = x.value if x.kind in ("in", "not_in") else (x.value,)
    if any(v is None or v != v for v in values):
        return some, some
    # NaN is larger than every number
    known = low.isNotNull()

    def point(v):
        v = F.lit(v)
        return known & (low <= v) & (v <= high), known & ((low != v) | (high != v)) | nan

    if x.kind in ("eq", "ne"):
        t, f = point(values[0])
        return (t, f) if x.kind == "eq" else (f, t)
    if x.kind in ("in", "not_in"):
        t = F.lit(False)
        for v in values:
            t = t | point(v)[0]
        f = point(values[0])[1] if len(values) == 1 else some
        return (t, f) if x.kind == "in" else (f, t)
    v = F.lit(values[0])
    less, most = known & (low < v), known & (low <= v)
    above, least = known & (high > v) | nan, known & (high >= v) | nan
    return {"lt": (less, least), "le": (most, above), "gt": (above, most), "ge": (least, less)}[x.kind]


def can_match(pred: Predicate, zones: DataFrame, columns: list[str] | None = None) -> Column:
    """Whether a block may hold a matching row; columns resolves ordinals."""
    return F.coalesce(_possible(pred.tree, set(zones.columns), columns)[0], F.lit(True))


def pruned_blocks(zones: DataFrame, pred: Predicate, columns: list[str] | None = None) -> DataFrame:
    """block_id and keep of every block."""
    return zones.select("block_id", "row_count", can_match(pred, zones, columns).alias("keep"))


def pruned_scan(df: DataFrame, zones: DataFrame, pred: Predicate, row_id: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that match, read from the blocks that can: the same rows as an unpruned scan.

    The blocks that can match become at most RANGES ranges of row ids, which the reader tests against its row groups'
    and pages' statistics, so on a table in row order the other blocks are not read. Null row ids are in no block.
    """
    return df.where(kept_rows(zones, pred, row_id, block_rows, df.columns)).where(pred.column(df))


def kept_rows(zones: DataFrame, pred: Predicate, row_id: str, block_rows: int = BLOCK_ROWS, columns: list[str] | None = None) -> Column:
    """A filter on row ids that holds in every block that can match: the blocks are cut into RANGES parts of equal width, each with a range from its first to its last such block."""
    keep = pruned_blocks(zones, pred, columns)
    ends = zones.agg(F.min("block_id").alias("a"), F.max("block_id").alias("b"))  # one row
    part = F.floor((F.col("block_id") - F.col("a")) * F.lit(RANGES) / (F.col("b") - F.col("a") + 1))
    found = keep.where("keep").join(F.broadcast(ends)).groupBy(part.alias("part")).agg(F.min("block_id").alias("first"), F.max("block_id").alias("last")).orderBy("first").collect()  # RANGES rows at most
    spans: list[list[int]] = []
    for r in found:
        if spans and r["first"] <= spans[-1][1] + 1:
            spans[-1][1] = r["last"]
        else:
            spans.append([r["first"], r["last"]])
    out, i = F.lit(False), F.col(f"`{row_id}`")
    for a, b in spans:
        out = out | ((i >= F.lit(a * block_rows)) & (i < F.lit((b + 1) * block_rows)))
    return out


def segment_can_match(zones: DataFrame, pred: Predicate, columns: list[str] | None = None) -> DataFrame:
    """One row, keep: whether any block of a segment can match."""
    return zones.agg(F.coalesce(F.bool_or(can_match(pred, zones, columns)), F.lit(False)).alias("keep"))
