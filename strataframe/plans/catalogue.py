"""Named queries over the driver tables and the same queries in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encodings as enc
from ..functions import vecops as vec
from ..operators import aggregate, bloom, delta, merge, zonemap
from ..operators.predicate import Predicate, count_true, mask_and, mask_not, mask_or, predicate
from ..operators.scan import ScanOptions, scan, scan_segments, scan_stats, segment_can_match_blooms
from ..sources.table import SegmentWriter, open_segment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BLOCK = 1024  # rows of a block of events
RATE = 0.001  # of non-members that a sketch may let pass
LINE = ("l_orderkey", "l_linenumber", "l_quantity")
SELECT = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _scan(name: str, pred: Predicate, where: str, columns: tuple[str, ...] = LINE) -> None:
    query(name, f"SELECT {', '.join(columns)} FROM lineitem WHERE {where}")(lambda s, d: scan(table(s, d, "lineitem"), pred, ScanOptions(columns=columns)))


# scans: comparisons, types, boolean algebra
for _name, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _scan(f"scan_{_name}", getattr(predicate(), _name)("l_linenumber", 4).build(), f"l_linenumber {_sign} 4")
_scan("scan_double_lt", predicate().lt("l_discount", 0.05).build(), "l_discount < 0.05", (*LINE, "l_discount"))
_scan("scan_string_eq", predicate().eq("l_returnflag", "R").build(), "l_returnflag = 'R'", (*LINE, "l_returnflag"))
_scan("scan_in", predicate().in_("l_linenumber", 1, 3, 5).build(), "l_linenumber IN (1, 3, 5)")
_scan("scan_not_in", predicate().not_in("l_linenumber", 1, 3, 5).build(), "l_linenumber NOT IN (1, 3, 5)")
_scan("scan_and", predicate().lt("l_orderkey", 500).and_().eq("l_linenumber", 1).build(), "l_orderkey < 500 AND l_linenumber = 1", (*LINE, "l_extendedprice"))
_scan("scan_or", predicate().lt("l_orderkey", 100).or_().eq("l_linenumber", 7).build(), "l_orderkey < 100 OR l_linenumber = 7")
_scan("scan_not", predicate().eq("l_linenumber", 4).not_().build(), "NOT (l_linenumber = 4)")
_scan("scan_chain", predicate().gt("l_quantity", 10.0).and_().lt("l_quantity", 20.0).or_().eq("l_linenumber", 3).not_().build(), "NOT ((l_quantity > 10 AND l_quantity < 20) OR l_linenumber = 3)")
_scan("scan_postfix", predicate().lt("l_orderkey", 1000).ge("l_linenumber", 6).and_().build(), "l_orderkey < 1000 AND l_linenumber >= 6")
_scan("scan_ordinal", predicate().eq(3, 2).build(), "l_linenumber = 2")
_scan("scan_all", predicate().build(), "TRUE")
_scan("project_prune", predicate().ge("l_quantity", 45.0).build(), "l_quantity >= 45", ("l_orderkey", "l_extendedprice"))


def _holed(s, d):
    return table(s, d, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("l_linenumber"), "l_quantity")


_HOLED = "SELECT l_orderkey, NULLIF(l_linenumber, 7) AS l_linenumber, l_quantity FROM lineitem"
query("scan_is_null", f"SELECT * FROM ({_HOLED}) WHERE l_linenumber IS NULL")(lambda s, d: scan(_holed(s, d), predicate().is_null("l_linenumber").build()))
query("scan_is_not_null", f"SELECT * FROM ({_HOLED}) WHERE l_linenumber IS NOT NULL")(lambda s, d: scan(_holed(s, d), predicate().is_not_null("l_linenumber").build()))
query("scan_null_chain", f"SELECT * FROM ({_HOLED}) WHERE NOT (l_linenumber > 3 AND l_linenumber IS NOT NULL)")(lambda s, d: scan(_holed(s, d), predicate().gt("l_linenumber", 3).and_().is_not_null("l_linenumber").not_().build()))


@query("predicate_mask", "SELECT l_orderkey, l_linenumber, l_quantity < 25 AND l_linenumber > 2 AS match FROM lineitem")
def _(s, d):
    return predicate().lt("l_quantity", 25.0).and_().gt("l_linenumber", 2).build().mask(table(s, d, "lineitem")).select("l_orderkey", "l_linenumber", "match")


@query("mask_algebra", "SELECT l_orderkey, l_linenumber, a AND b AS m_and, a OR b AS m_or, NOT a AS m_not FROM (SELECT *, l_quantity < 25 AS a, l_linenumber > 2 AS b FROM lineitem)")
def _(s, d):
    a, b = F.col("l_quantity") < 25, F.col("l_linenumber") > 2
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", mask_and(a, b).alias("m_and"), mask_or(a, b).alias("m_or"), mask_not(a).alias("m_not"))


query("mask_count", "SELECT count(*) FILTER (WHERE l_quantity < 25) AS n FROM lineitem")(lambda s, d: count_true(table(s, d, "lineitem"), F.col("l_quantity") < 25))


@query("mask_bitops", "SELECT l_orderkey, l_linenumber, l_orderkey & 255 AS b_and, l_orderkey | 7 AS b_or, xor(l_orderkey, 85) AS b_xor, ~l_orderkey AS b_not FROM lineitem")
def _(s, d):
    k = F.col("l_orderkey")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", vec.bit_and(k, F.lit(255)).alias("b_and"), vec.bit_or(k, F.lit(7)).alias("b_or"), vec.bit_xor(k, F.lit(85)).alias("b_xor"), vec.bit_not(k).alias("b_not"))


@query("bool_column_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linestatus = 'F') = TRUE")
def _(s, d):
    held = table(s, d, "lineitem").withColumn("done", F.col("l_linestatus") == "F")
    return scan(held, predicate().eq("done", True).build(), ScanOptions(columns=("l_orderkey", "l_linenumber")))


@query("scan_multi_segment", "SELECT event_id, user_id, event_type FROM events WHERE user_id < 20")
def _(s, d):
    e = table(s, d, "events")
    return scan_segments([e.where(F.expr("event_id % 3") == i) for i in range(3)], predicate().lt("user_id", 20).build(), ScanOptions(columns=("event_id", "user_id", "event_type")))


query("column_slice", "SELECT event_id, value FROM events WHERE event_id >= 100 AND event_id < 600")(lambda s, d: scan(table(s, d, "events"), predicate().ge("event_id", 100).and_().lt("event_id", 600).build(), ScanOptions(columns=("event_id", "value"))))
query("column_copy_range", "SELECT event_id, user_id FROM events WHERE event_id < 50 UNION ALL SELECT event_id, user_id FROM events WHERE event_id >= 900 AND event_id < 950")(
    lambda s, d: table(s, d, "events").where("event_id < 50").unionByName(table(s, d, "events").where("event_id >= 900 and event_id < 950")).select("event_id", "user_id")
)

# aggregates
_AGG = "SELECT CAST(sum(CAST(l_linenumber AS DOUBLE)) AS DOUBLE) AS l_linenumber_sum, count(l_linenumber) AS l_linenumber_count, min(l_linenumber) AS l_linenumber_min, max(l_linenumber) AS l_linenumber_max, CAST(sum(CAST(l_orderkey AS DOUBLE)) AS DOUBLE) AS l_orderkey_sum, count(l_orderkey) AS l_orderkey_count, min(l_orderkey) AS l_orderkey_min, max(l_orderkey) AS l_orderkey_max FROM lineitem WHERE "
query("agg_scan", _AGG + "l_quantity < 25")(lambda s, d: aggregate.aggregate_scan(table(s, d, "lineitem"), ["l_linenumber", "l_orderkey"], predicate().lt("l_quantity", 25.0).build()))
query("agg_scan_empty", _AGG + "l_quantity < 0")(lambda s, d: aggregate.aggregate_scan(table(s, d, "lineitem"), ["l_linenumber", "l_orderkey"], predicate().lt("l_quantity", 0.0).build()))
query("column_sum", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS sum FROM lineitem")(lambda s, d: aggregate.column_sum(table(s, d, "lineitem"), "l_orderkey"))
query("column_min", "SELECT min(l_extendedprice) AS min FROM lineitem")(lambda s, d: aggregate.column_min(table(s, d, "lineitem"), "l_extendedprice"))
query("column_max", "SELECT max(l_extendedprice) AS max FROM lineitem")(lambda s, d: aggregate.column_max(table(s, d, "lineitem"), "l_extendedprice"))
query("null_count", f"SELECT count(*) FILTER (WHERE l_linenumber IS NULL) AS null_count FROM ({_HOLED})")(lambda s, d: aggregate.null_count(_holed(s, d), "l_linenumber"))
query(
    "column_stats",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM ({_HOLED})" for c in LINE),
)(lambda s, d: aggregate.column_stats(_holed(s, d), list(LINE)).drop("min_value", "max_value"))
query(
    "column_stats_text",
    "SELECT 'event_type' AS \"column\", count(*) AS total_count, count(*) - count(event_type) AS null_count, count(DISTINCT event_type) AS distinct_count, min(event_type) AS min_value, max(event_type) AS max_value FROM events UNION ALL SELECT 'big', count(*), 0, count(DISTINCT event_id), CAST(min(event_id) + 9007199254740992 AS VARCHAR), CAST(max(event_id) + 9007199254740992 AS VARCHAR) FROM events",
)(lambda s, d: aggregate.column_stats(table(s, d, "events").withColumn("big", F.col("event_id") + F.lit(2**53)), ["event_type", "big"]).drop("min", "max"))


# zone maps
def _zones(s, d, columns=("user_id", "value"), rows=BLOCK):
    return zonemap.build_zone_map(table(s, d, "events"), "event_id", list(columns), rows)


query("zone_map_build", f"SELECT event_id // {BLOCK} AS block_id, count(*) AS row_count, min(user_id) AS user_id_min, max(user_id) AS user_id_max, count(*) - count(user_id) AS user_id_nulls, min(event_id) AS event_id_min, max(event_id) AS event_id_max, count(*) - count(event_id) AS event_id_nulls FROM events GROUP BY 1")(lambda s, d: _zones(s, d, ("user_id", "event_id")))

_KEEP = {"eq": "lo <= 2500 AND hi >= 2500", "ne": "NOT (lo = 2500 AND hi = 2500)", "lt": "lo < 2500", "le": "lo <= 2500", "gt": "hi > 2500", "ge": "hi >= 2500"}
for _name, _rule in _KEEP.items():
    query(f"zone_map_prune_{_name}", f"SELECT event_id // {BLOCK} AS block_id, count(*) AS row_count, bool_and(TRUE) AND (min(event_id) IS NOT NULL) AND ({_rule.replace('lo', 'min(event_id)').replace('hi', 'max(event_id)')}) AS keep FROM events GROUP BY 1")(
        lambda s, d, n=_name: zonemap.pruned_blocks(_zones(s, d, ("event_id",)), getattr(predicate(), n)("event_id", 2500).build())
    )


@query("zone_map_pruned_scan", "SELECT event_id, user_id FROM events WHERE (event_id < 700 OR event_id >= 9000) AND NOT user_id = 3")
def _(s, d):
    pred = predicate().lt("event_id", 700).or_().ge("event_id", 9000).and_().ne("user_id", 3).build()
    return scan(table(s, d, "events"), pred, ScanOptions(("event_id", "user_id"), "event_id", BLOCK, _zones(s, d, ("event_id", "user_id"))))


query("zone_map_segment_match", "SELECT bool_or(lo < 100) AS keep FROM (SELECT min(event_id) AS lo FROM events GROUP BY event_id // 1024)")(lambda s, d: zonemap.segment_can_match(_zones(s, d, ("event_id",)), predicate().lt("event_id", 100).build()))


@query(
    "scan_stats",
    f"""WITH b AS (SELECT event_id // {BLOCK} AS k, count(*) AS n, min(event_id) AS lo, count(*) FILTER (WHERE event_id < 3000 AND user_id = 7) AS m, min(user_id) <= 7 AND max(user_id) >= 7 AND min(event_id) < 3000 AS keep FROM events GROUP BY 1)
    SELECT count(*) AS blocks_scanned, count(*) FILTER (WHERE NOT keep) AS blocks_pruned_zone, CAST(0 AS BIGINT) AS blocks_pruned_bloom, CAST(sum(n) AS BIGINT) AS rows_scanned, CAST(coalesce(sum(n - m) FILTER (WHERE keep), 0) AS BIGINT) AS rows_filtered, CAST(coalesce(sum(m) FILTER (WHERE keep), 0) AS BIGINT) AS rows_returned FROM b""",
)
def _(s, d):
    pred = predicate().lt("event_id", 3000).and_().eq("user_id", 7).build()
    return scan_stats(table(s, d, "events"), pred, "event_id", _zones(s, d, ("event_id", "user_id")), BLOCK)


# encodings as tables; event types become small integers so that runs exist
_TYPED = "SELECT event_id, CAST(length(event_type) AS INTEGER) AS v FROM events"


def _typed(s, d):
    return table(s, d, "events").select("event_id", F.length("event_type").alias("v"))


_RUNS = f"SELECT block_id, min(event_id) AS run_start, any_value(v) AS value, count(*) AS run_length FROM (SELECT *, sum(fresh) OVER (PARTITION BY block_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY block_id ORDER BY event_id) THEN 1 ELSE 0 END AS fresh FROM (SELECT *, event_id // {BLOCK} AS block_id FROM ({_TYPED})))) GROUP BY block_id, run"
query("enc_rle_encode", _RUNS)(lambda s, d: enc.rle_encode(_typed(s, d), "event_id", "v", BLOCK))
query("enc_rle_decode", f"SELECT event_id AS row_id, v AS value FROM ({_TYPED})")(lambda s, d: enc.rle_decode(enc.rle_encode(_typed(s, d), "event_id", "v", BLOCK)))
query("enc_rle_filter", f"SELECT event_id AS row_id, v AS value FROM ({_TYPED}) WHERE v >= 6")(lambda s, d: enc.rle_filter(enc.rle_encode(_typed(s, d), "event_id", "v", BLOCK), "ge", 6))
query("enc_rle_size", f"SELECT count(*) AS runs, count(*) * 8 AS bytes FROM ({_RUNS})")(lambda s, d: enc.rle_size(enc.rle_encode(_typed(s, d), "event_id", "v", BLOCK)))
query("enc_delta_encode", f"SELECT event_id AS row_id, event_id // {BLOCK} AS block_id, user_id - coalesce(lag(user_id) OVER (PARTITION BY event_id // {BLOCK} ORDER BY event_id), 0) AS delta FROM events")(lambda s, d: enc.delta_encode(table(s, d, "events"), "event_id", "user_id", BLOCK))
query("enc_delta_decode", "SELECT event_id AS row_id, user_id AS value FROM events")(lambda s, d: enc.delta_decode(enc.delta_encode(table(s, d, "events"), "event_id", "user_id", BLOCK)))
query("enc_for", f"SELECT event_id AS row_id, event_id // {BLOCK} AS block_id, min(user_id) OVER (PARTITION BY event_id // {BLOCK}) AS base, user_id - min(user_id) OVER (PARTITION BY event_id // {BLOCK}) AS residual FROM events")(lambda s, d: enc.for_encode(table(s, d, "events"), "event_id", "user_id", BLOCK))
query("enc_for_decode", "SELECT event_id AS row_id, user_id AS value FROM events")(lambda s, d: enc.for_decode(enc.for_encode(table(s, d, "events"), "event_id", "user_id", BLOCK)))
_WIDTH = "CAST(CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END AS INTEGER)"
query(
    "enc_for_blocks",
    f"WITH b AS (SELECT event_id // {BLOCK} AS block_id, min(user_id) AS base, {_WIDTH.format('(max(user_id) - min(user_id))')} AS width, count(user_id) AS n FROM events GROUP BY 1) SELECT *, CAST(CASE WHEN width = 0 THEN 0 ELSE ceil(n / floor(64 / greatest(width, 1))) * 8 END AS BIGINT) AS bytes FROM b",
)(lambda s, d: enc.for_blocks(table(s, d, "events"), "event_id", "user_id", BLOCK).withColumn("bytes", F.col("bytes").cast("long")))
query("enc_bitpack_width", f"SELECT base, width, n, CAST(ceil(n * width / 64) * 8 AS BIGINT) AS bytes FROM (SELECT min(l_orderkey) AS base, {_WIDTH.format('(max(l_orderkey) - min(l_orderkey))')} AS width, count(*) AS n FROM lineitem)")(lambda s, d: enc.bitpack(table(s, d, "lineitem"), "l_orderkey").withColumn("bytes", F.col("bytes").cast("long")))
query("enc_bitpack", "SELECT event_id AS row_id, (SELECT min(user_id) FROM events) AS base, user_id - (SELECT min(user_id) FROM events) AS residual FROM events")(lambda s, d: enc.bitpack_encode(table(s, d, "events"), "event_id", "user_id"))
query("enc_dict_sorted", "SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT user_id AS value FROM events)")(lambda s, d: enc.dictionary_sorted(table(s, d, "events"), "user_id"))
query("enc_dict_first_seen", "SELECT value, row_number() OVER (ORDER BY first) - 1 AS code FROM (SELECT user_id AS value, min(event_id) AS first FROM events GROUP BY 1)")(lambda s, d: enc.dictionary_first_seen(table(s, d, "events"), "event_id", "user_id"))
query("enc_dict_encode", "SELECT event_id AS row_id, dense_rank() OVER (ORDER BY user_id) - 1 AS code FROM events")(lambda s, d: enc.dictionary_encode(table(s, d, "events"), "event_id", "user_id", enc.dictionary_sorted(table(s, d, "events"), "user_id"), strict=True))


@query("enc_dict_decode", "SELECT event_id AS row_id, user_id AS value FROM events")
def _(s, d):
    codes = enc.dictionary_first_seen(table(s, d, "events"), "event_id", "user_id")
    return enc.dictionary_decode(enc.dictionary_encode(table(s, d, "events"), "event_id", "user_id", codes), codes)


query("enc_dict_size", "SELECT count(DISTINCT user_id) AS cardinality, count(DISTINCT user_id) * 8 + count(user_id) * CASE WHEN count(DISTINCT user_id) <= 256 THEN 1 WHEN count(DISTINCT user_id) <= 65536 THEN 2 ELSE 4 END AS bytes FROM events")(lambda s, d: enc.dictionary_size(table(s, d, "events"), "user_id", 8))


def _signed(s, d):
    return table(s, d, "events").select("event_id", (F.col("user_id") - 75).alias("x"))


query("enc_zigzag", "SELECT event_id, x, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS z, x AS back FROM (SELECT event_id, user_id - 75 AS x FROM events)")(lambda s, d: _signed(s, d).select("event_id", "x", enc.zigzag(F.col("x")).alias("z"), enc.unzigzag(enc.zigzag(F.col("x"))).alias("back")))
query("enc_for_zigzag", "SELECT event_id AS row_id, user_id - 75 AS value FROM events")(lambda s, d: enc.for_zigzag_decode(enc.for_zigzag_encode(_signed(s, d), "event_id", "x", BLOCK)))


# vector operations on events: a = user_id, b = event_id % 97 - 48
_AB = "(SELECT event_id, user_id AS a, event_id % 97 - 48 AS b, value AS x FROM events)"


def _ab(s, d):
    return table(s, d, "events").select("event_id", F.col("user_id").alias("a"), (F.col("event_id") % 97 - 48).alias("b"), F.col("value").alias("x"))


def _vec(name: str, sql: str, **columns) -> None:
    query(name, f"SELECT event_id, {sql} FROM {_AB}")(lambda s, d: _ab(s, d).select("event_id", *[f().alias(k) for k, f in columns.items()]))


A, B, X = (lambda: F.col("a")), (lambda: F.col("b")), (lambda: F.col("x"))
_vec("vec_add", "a + b AS r", r=lambda: vec.add(A(), B()))
_vec("vec_sub", "a - b AS r", r=lambda: vec.sub(A(), B()))
_vec("vec_mul", "a * b AS r, x * 2 AS rx", r=lambda: vec.mul(A(), B()), rx=lambda: vec.mul(X(), F.lit(2.0)))
_vec("vec_div", "CASE WHEN b = 0 THEN NULL ELSE x / b END AS r", r=lambda: vec.div(X(), B().cast("double")))
_vec("vec_bitwise", "a & b AS r_and, a | b AS r_or, xor(a, b) AS r_xor, ~a AS r_not, (a & b) | (~a & event_id) AS r_ternary", r_and=lambda: vec.bit_and(A(), B()), r_or=lambda: vec.bit_or(A(), B()), r_xor=lambda: vec.bit_xor(A(), B()), r_not=lambda: vec.bit_not(A()), r_ternary=lambda: vec.ternary_logic(A(), B(), F.col("event_id"), 0b11001010))
_vec("vec_shift", "a << 3 AS l, b >> 2 AS r, CASE WHEN b >= 0 THEN b >> 60 ELSE ((b >> 1) & 9223372036854775807) >> 59 END AS u", l=lambda: vec.shift_left(A(), 3), r=lambda: vec.shift_right(B(), 2), u=lambda: vec.shift_right_logical(B(), 60))
_vec("vec_abs", "abs(b) AS r, abs(x) AS rx", r=lambda: vec.absolute(B()), rx=lambda: vec.absolute(X()))
_vec("vec_minmax", "least(a, b) AS lo, greatest(a, b) AS hi", lo=lambda: vec.minimum(A(), B()), hi=lambda: vec.maximum(A(), B()))
_vec("vec_compare", "a = b AS eq, a < b AS lt, a <= b AS le", eq=lambda: A() == B(), lt=lambda: A() < B(), le=lambda: A() <= B())
_vec("vec_popcount", "CAST(bit_count(a) AS INTEGER) AS r", r=lambda: vec.pop_count(A()))
_vec("vec_saturate", "least(greatest(a + b, -32), 64) AS s_add, least(greatest(a - b, -32), 64) AS s_sub, CAST(least(greatest(a * 700, -32768), 32767) AS INTEGER) AS p_signed, CAST(least(greatest(b * 900, 0), 65535) AS INTEGER) AS p_unsigned, (a * 30000000 * 2000000000) >> 32 AS high",
     s_add=lambda: vec.add_saturate(A(), B(), (-32, 64)), s_sub=lambda: vec.sub_saturate(A(), B(), (-32, 64)), p_signed=lambda: vec.pack_signed16(A() * 700), p_unsigned=lambda: vec.pack_unsigned16(B() * 900), high=lambda: vec.mul_high((A() % 150) * 30000000, F.lit(2000000000)))
ORACLES["vec_saturate"] = ORACLES["vec_saturate"].replace("(a * 30000000 * 2000000000) >> 32", "CAST(((a % 150) * 30000000 * 2000000000) // 4294967296 AS BIGINT)")
_vec("vec_blend", "CASE WHEN b > 0 THEN a ELSE b END AS r, CASE WHEN b > 0 THEN a END AS m", r=lambda: vec.blend(B() > 0, A(), B()), m=lambda: vec.masked(B() > 0, A()))
_LANES = "[a, b, a + b, a - b]"
_vec("vec_lanes", f"list_sum({_LANES})::BIGINT AS s, list_min({_LANES}) AS lo, list_max({_LANES}) AS hi, ({_LANES})[3] AS third, ({_LANES})[4] AS swapped",
     s=lambda: vec.reduce_lanes(F.array(A(), B(), A() + B(), A() - B()), "add"), lo=lambda: vec.reduce_lanes(F.array(A(), B(), A() + B(), A() - B()), "min"), hi=lambda: vec.reduce_lanes(F.array(A(), B(), A() + B(), A() - B()), "max"),
     third=lambda: vec.extract_lane(F.array(A(), B(), A() + B(), A() - B()), 2), swapped=lambda: vec.extract_lane(vec.permute(F.array(A(), B(), A() + B(), A() - B()), F.array(*[F.lit(i) for i in (3, 2, 1, 0)])), 0))
query("vec_prefix_sum", "SELECT event_id, user_id, CAST(sum(user_id) OVER (ORDER BY event_id) AS BIGINT) AS prefix_sum FROM events")(lambda s, d: vec.prefix_sum(table(s, d, "events").select("event_id", "user_id"), "event_id", "user_id", block_rows=BLOCK))
query("vec_prefix_sum_block", "SELECT event_id, user_id, CAST(sum(user_id) OVER (PARTITION BY event_id // 16 ORDER BY event_id) AS BIGINT) AS prefix_sum FROM events")(lambda s, d: vec.prefix_sum_block(table(s, d, "events").select("event_id", "user_id"), "event_id", "user_id", 16))
query("vec_conflict_detect", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY event_id // 16, user_id ORDER BY event_id) - 1 AS INTEGER) AS conflicts FROM events")(lambda s, d: vec.conflict_detect(table(s, d, "events").select("event_id", "user_id"), "event_id", "user_id", 16))
query("vec_compress", "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY event_id // 16 ORDER BY event_id) - 1 AS INTEGER) AS lane FROM events WHERE user_id % 2 = 0")(lambda s, d: vec.compress(table(s, d, "events").select("event_id", "user_id"), "event_id", F.col("user_id") % 2 == 0, 16))
query("vec_expand", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id END AS value FROM events")(
    lambda s, d: table(s, d, "events").select("event_id").join(vec.compress(table(s, d, "events"), "event_id", F.col("user_id") % 2 == 0, 16).select("event_id", F.col("user_id").alias("value")), "event_id", "left")
)


# bloom sketches
@query("bloom_probe", "SELECT count(DISTINCT user_id) AS probes, count(DISTINCT user_id) AS hits FROM events")
def _(s, d):
    e = table(s, d, "events")
    found = bloom.build_bloom(e, "user_id", 1 << 16).might_contain(e.select("user_id").distinct(), "user_id")
    return found.agg(F.count(F.lit(1)).alias("probes"), F.count_if("might_contain").alias("hits"))


@query("bloom_merge", "SELECT count(DISTINCT user_id) AS probes, count(DISTINCT user_id) AS hits FROM events")
def _(s, d):
    e = table(s, d, "events")
    both = bloom.build_bloom(e.where("event_id % 2 = 0"), "user_id", 1 << 16).merge(bloom.build_bloom(e.where("event_id % 2 = 1"), "user_id", 1 << 16))
    return both.might_contain(e.select("user_id").distinct(), "user_id").agg(F.count(F.lit(1)).alias("probes"), F.count_if("might_contain").alias("hits"))


@query("bloom_string_probe", "SELECT count(*) AS probes, count(*) AS hits FROM (SELECT DISTINCT p_name FROM part)")
def _(s, d):
    p = table(s, d, "part").select("p_name").distinct()
    return bloom.build_bloom(p, "p_name").might_contain(p, "p_name").agg(F.count(F.lit(1)).alias("probes"), F.count_if("might_contain").alias("hits"))


@query("bloom_blocked_probe", f"SELECT count(*) AS probes, count(*) AS hits FROM (SELECT DISTINCT event_id // {BLOCK} AS b, user_id FROM events)")
def _(s, d):
    e = table(s, d, "events")
    pairs = e.select(zonemap.block_of("event_id", BLOCK).alias("block_id"), "user_id").distinct()
    found = bloom.build_bloom(e, "user_id", 1 << 16, block=zonemap.block_of("event_id", BLOCK)).might_contain(pairs, "user_id", "block_id")
    return found.agg(F.count(F.lit(1)).alias("probes"), F.count_if("might_contain").alias("hits"))


@query("bloom_segment_match", "SELECT TRUE AS keep")
def _(s, d):
    sketch = bloom.build_bloom(table(s, d, "events"), "user_id", 1 << 16)
    pred = predicate().eq("user_id", 7).and_().lt("value", 1e9).or_().eq("user_id", -5).build()
    return segment_can_match_blooms(pred, {"user_id": sketch}, s)


query("bloom_stats")(lambda s, d: bloom.build_bloom(table(s, d, "events"), "user_id", 1 << 16).bits_set())


# change log: users are keys, event ids are times, errors are deletes
def _log(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("row_id"), F.col("event_id").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "D").otherwise("I").alias("op"), F.length("event_type").alias("c0"), F.col("event_id").alias("c1"))


_LOG = "(SELECT user_id AS row_id, event_id AS ts, CASE WHEN event_type = 'error' THEN 'D' ELSE 'I' END AS op, CAST(length(event_type) AS INTEGER) AS c0, event_id AS c1 FROM events)"


def _resolved(log: str = _LOG) -> str:
    return f"SELECT i.row_id, i.ts, i.c0, i.c1 FROM (SELECT row_id, max(ts) AS ts, arg_max(c0, ts) AS c0, arg_max(c1, ts) AS c1 FROM {log} WHERE op = 'I' GROUP BY 1) i LEFT JOIN (SELECT row_id, max(ts) AS ts FROM {log} WHERE op = 'D' GROUP BY 1) x ON x.row_id = i.row_id WHERE x.ts IS NULL OR x.ts < i.ts"


query("delta_resolve", _resolved())(lambda s, d: delta.resolve(_log(s, d)))
query("delta_as_of", _resolved(f"(SELECT * FROM {_LOG} WHERE ts <= 500)"))(lambda s, d: delta.resolve(_log(s, d), 500))
query("delta_get", _resolved() + " AND i.row_id = 7")(lambda s, d: delta.get(_log(s, d), 7))
query("delta_range", _resolved() + " AND i.row_id >= 10 AND i.row_id < 40")(lambda s, d: delta.get_range(_log(s, d), 10, 40))
query("delta_inserts", f"SELECT row_id, ts, c0, c1 FROM {_LOG} WHERE op = 'I'")(lambda s, d: delta.inserts(_log(s, d)).select("row_id", "ts", "c0", "c1"))
query("delta_deletes", f"SELECT row_id, ts FROM {_LOG} WHERE op = 'D'")(lambda s, d: delta.deletes(_log(s, d)).select("row_id", "ts"))
query("delta_pending", f"SELECT count(*) FILTER (WHERE op = 'I') AS pending, count(*) FILTER (WHERE op = 'D') AS deletes, CAST(sum(CASE WHEN op = 'I' THEN 4 + 8 + 16 ELSE 16 END) AS BIGINT) AS memory, max(ts) AS last_ts FROM {_LOG}")(lambda s, d: delta.pending(_log(s, d)))

# merging
query("merge_segments", "SELECT event_id, user_id FROM events")(lambda s, d: merge.merge_segments(s, [table(s, d, "events").select("event_id", "user_id").where(F.expr("event_id % 4") == i) for i in range(4)], None))


def _halves(s, d):
    e = table(s, d, "events").select("event_id", "user_id")
    return [(e.where("event_id % 2 = 0"), 200), (e.where("event_id % 2 = 1"), 100)]


query("merge_column_by_ts", "SELECT CAST(CASE WHEN event_id % 2 = 0 THEN 200 ELSE 100 END AS BIGINT) AS ts, CAST(event_id % 2 AS INTEGER) AS source_ord, event_id AS pos, user_id AS value FROM events")(lambda s, d: merge.merge_column(_halves(s, d), "event_id", "user_id"))


def _base(s, d):
    return s.range(0, 200).select(F.col("id").alias("row_id"), F.lit(-1).alias("c0"), (F.col("id") * 10).alias("c1"))


query(
    "compact_with_delta",
    f"WITH r AS ({_resolved()}) SELECT CAST(b.i AS BIGINT) AS row_id, -1 AS c0, CAST(b.i * 10 AS BIGINT) AS c1 FROM range(0, 200) b(i) WHERE NOT EXISTS (SELECT 1 FROM {_LOG} l WHERE l.row_id = b.i) UNION ALL SELECT row_id, c0, c1 FROM r",
)(lambda s, d: merge.apply_log(_base(s, d), _log(s, d)))


# segments: written, opened again and read in slices
def _place(s: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder; where none is set, a local session has a temporary one and a cluster is an error."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if not base and s.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or 'file://' + tempfile.gettempdir()}/{label}-{uuid.uuid4().hex}"


def _segment(s, d):
    held = table(s, d, "events").select("event_id", "user_id", F.length("event_type").alias("kind"), "value")
    w = SegmentWriter(s, _place(s, "segment"), row_id="event_id", created_ts=7).encode("user_id", "delta").encode("kind", "rle")
    return open_segment(s, w.add_zone_map("user_id", BLOCK).add_zone_map("event_id", BLOCK).add_bloom_filter("user_id", 1 << 16).finish(held).path)


query("segment_reopen", "SELECT event_id, user_id, CAST(length(event_type) AS INTEGER) AS kind, value FROM events")(lambda s, d: _segment(s, d).df)
query("segment_slice", "SELECT value FROM events WHERE event_id >= 300 AND event_id < 350")(lambda s, d: _segment(s, d).read_values("value", 300, 50))
query("segment_zone_map", ORACLES["zone_map_build"])(lambda s, d: _segment(s, d).zone_map())
query("segment_prefetch", "SELECT user_id FROM events")(lambda s, d: _segment(s, d).prefetch("user_id"))
query(
    "segment_metadata",
    "SELECT * FROM (VALUES ('event_id', 'int64', 'plain', 0), ('user_id', 'int64', 'delta', 1), ('kind', 'int32', 'rle', 2), ('value', 'double', 'plain', 3)) t(\"column\", type, encoding, ordinal), (SELECT count(*) AS num_rows, CAST(7 AS BIGINT) AS created_ts FROM events)",
)(lambda s, d: (lambda g: s.createDataFrame([(g.name(i), g.column_type(i), g.column_encoding(i), i, g.num_rows, g.created_ts) for i in range(g.num_columns)], "column string, type string, encoding string, ordinal int, num_rows long, created_ts long"))(_segment(s, d)))
query("segment_stats", "SELECT 'user_id' AS \"column\", count(*) AS total_count, count(*) - count(user_id) AS null_count, count(DISTINCT user_id) AS distinct_count, CAST(min(user_id) AS DOUBLE) AS min, CAST(max(user_id) AS DOUBLE) AS max FROM events")(lambda s, d: _segment(s, d).stats().where(F.col("column") == "user_id").drop("min_value", "max_value"))
query("segment_pruned_scan", "SELECT event_id, value FROM events WHERE event_id >= 200 AND event_id < 260")(
    lambda s, d: (lambda g: scan(g.df, predicate().ge("event_id", 200).and_().lt("event_id", 260).build(), ScanOptions(("event_id", "value"), "event_id", BLOCK, g.zone_map())))(_segment(s, d))
)
query("segment_bloom_scan", "SELECT event_id FROM events WHERE user_id = 7 UNION ALL SELECT event_id FROM events WHERE user_id = -4")(
    lambda s, d: (lambda g: scan(g.df, predicate().eq("user_id", 7).build(), ScanOptions(("event_id",), blooms={"user_id": g.bloom_filter("user_id")})).unionByName(scan(g.df, predicate().eq("user_id", -4).build(), ScanOptions(("event_id",), blooms={"user_id": g.bloom_filter("user_id")}))))(_segment(s, d))
)


# sketches asked for what they do not hold: every member found, of 10,000 others at most 1 %
@query("bloom_nonmembers", "SELECT count(DISTINCT user_id) AS members, count(DISTINCT user_id) AS found, CAST(10000 AS BIGINT) AS others, TRUE AS few FROM events")
def _(s, d):
    sketch = bloom.build_bloom(table(s, d, "events"), "user_id", 1 << 16, rate=RATE)
    inside = sketch.might_contain(table(s, d, "events").select("user_id").distinct(), "user_id").agg(F.count(F.lit(1)).alias("members"), F.count_if("might_contain").alias("found"))
    other = sketch.might_contain(s.range(1, 10_001).select((-F.col("id")).alias("user_id")), "user_id").agg(F.count(F.lit(1)).alias("others"), (F.count_if("might_contain") <= 100).alias("few"))
    return inside.join(F.broadcast(other))  # one row by one row


@query("bloom_string_nonmembers", "SELECT count(*) AS others, TRUE AS few FROM (SELECT DISTINCT p_name FROM part)")
def _(s, d):
    p = table(s, d, "part").select("p_name").distinct()
    return bloom.build_bloom(p, "p_name", rate=RATE).might_contain(p.select(F.concat("p_name", F.lit("#")).alias("p_name")), "p_name").agg(F.count(F.lit(1)).alias("others"), (F.count_if("might_contain") <= F.count(F.lit(1)) * 0.01).alias("few"))


@query("bloom_segment_no_match", "SELECT FALSE AS keep")
def _(s, d):
    sketch = bloom.build_bloom(table(s, d, "events"), "user_id", 1 << 16, rate=RATE)
    return segment_can_match_blooms(predicate().eq("user_id", -5).and_().lt("value", 1e9).build(), {"user_id": sketch}, s)


# a change log on disk: inserts, an overwrite, deletes, opened again, flushed
def _store(s, d):
    held = table(s, d, "events").select(F.col("event_id").alias("row_id"), F.length("event_type").alias("c0"), F.col("user_id").alias("c1")).where("row_id < 500")
    place, payload = _place(s, "changes"), T.StructType([T.StructField("c0", T.IntegerType()), T.StructField("c1", T.LongType())])
    store = delta.DeltaLog(s, place, payload, flush_at=400)
    store.insert(held)
    store.delete(list(range(0, 500, 50)))
    again = delta.DeltaLog(s, place, payload, flush_at=400)
    again.insert([(50, -1, -1), (7, -2, -2)])
    return again


_STORED = "SELECT event_id AS row_id, CASE event_id WHEN 50 THEN -1 WHEN 7 THEN -2 ELSE CAST(length(event_type) AS INTEGER) END AS c0, CASE event_id WHEN 50 THEN -1 WHEN 7 THEN -2 ELSE user_id END AS c1 FROM events WHERE event_id < 500 AND (event_id % 50 <> 0 OR event_id = 50)"
query("delta_store_reopen", _STORED)(lambda s, d: delta.resolve(_store(s, d).log()).drop("ts"))
query("delta_store_clock", "SELECT count(*) + 2 AS pending, CAST(10 AS BIGINT) AS deletes, CAST(13 AS BIGINT) AS last_ts FROM events WHERE event_id < 500")(lambda s, d: delta.pending(_store(s, d).log()).drop("memory"))
query("delta_store_flush", "SELECT count(*) + 2 AS drained, CAST(0 AS BIGINT) AS pending FROM events WHERE event_id < 500")(lambda s, d: (lambda g: (lambda out: s.createDataFrame([(out.where("op = 'I'").count(), g.pending())], "drained long, pending long"))(g.store_for_flush()))(_store(s, d)))
query("merge_column_empty", "SELECT CAST(0 AS BIGINT) AS ts, CAST(0 AS INTEGER) AS source_ord, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS value WHERE FALSE")(lambda s, d: merge.merge_column([], "row_id", "value"))
query(
    "compaction_statistics",
    "SELECT count(*) AS rows_in, count(*) - 3 + 2 AS rows_out, CAST(2 AS BIGINT) AS rows_inserted, CAST(3 AS BIGINT) AS rows_deleted FROM events",
)(
    lambda s, d: (lambda r: s.createDataFrame([(r.rows_in, r.rows_out, r.rows_inserted, r.rows_deleted)], "rows_in long, rows_out long, rows_inserted long, rows_deleted long"))(
        merge.compact(table(s, d, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("c0")), s.createDataFrame([(1, 9, 1, "D", None), (2, 9, 2, "D", None), (3, 9, 3, "D", None), (-1, 9, 4, "I", 5), (-2, 9, 5, "I", 6)], "row_id long, ts long, seq long, op string, c0 long"), _place(s, "compact"))
    )
)
query("vec_widened", "SELECT p_partkey, CAST(2147483647 AS BIGINT) + p_size AS s, CAST(-2147483648 AS BIGINT) - p_size AS d, CAST(2147483647 AS BIGINT) * p_size AS m FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", vec.add(F.lit(2**31 - 1), F.col("p_size").cast("int")).alias("s"), vec.sub(F.lit(-(2**31)).cast("int"), F.col("p_size").cast("int")).alias("d"), vec.mul(F.lit(2**31 - 1), F.col("p_size").cast("int")).alias("m"))
)

query("vec_shift_by", "SELECT event_id, a << CAST(event_id % 5 AS INTEGER) AS l, b >> CAST(event_id % 7 AS INTEGER) AS r FROM " + _AB)(lambda s, d: _ab(s, d).select("event_id", vec.shift_left_by(A(), F.col("event_id") % 5).alias("l"), vec.shift_right_by(B(), F.col("event_id") % 7).alias("r")))
query("vec_mul_high64", "SELECT event_id, CAST(floor_high AS BIGINT) AS h FROM (SELECT event_id, (p - ((p % m) + m) % m) // m AS floor_high FROM (SELECT event_id, CAST(a * 90000000000000000 AS HUGEINT) * (b * 1000000000000000) AS p, CAST(18446744073709551616 AS HUGEINT) AS m FROM (SELECT event_id, user_id % 90 AS a, event_id % 97 - 48 AS b FROM events)))")(
    lambda s, d: table(s, d, "events").select("event_id", vec.mul_high64(F.col("user_id") % 90 * F.lit(90000000000000000), (F.col("event_id") % 97 - 48) * F.lit(1000000000000000)).alias("h"))
)


@query("enc_dict_store", "SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT user_id AS value FROM events)")
def _(s, d):
    place = _place(s, "dictionary")
    enc.dictionary_write(enc.dictionary_sorted(table(s, d, "events"), "user_id"), place)
    return enc.dictionary_read(s, place)


@query("column_build", "SELECT event_id AS row_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE user_id END AS v FROM events WHERE event_id < 200 UNION ALL SELECT 200 + i, NULL FROM range(0, 50) t(i) UNION ALL SELECT event_id - 400 + 250, user_id FROM events WHERE event_id >= 400 AND event_id < 430")
def _(s, d):
    from ..functions import columns as col

    first = table(s, d, "events").where("event_id < 200").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("v"))
    other = table(s, d, "events").select(F.col("event_id").alias("row_id"), F.col("user_id").alias("v"))
    held = col.set_null(col.resize(first, 250), "v", F.col("row_id") % 10 == 3)
    return col.append(held, col.copy_range(other, 400, 30), 250)
