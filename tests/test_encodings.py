import random

import pytest
from pyspark.sql import functions as F
from strataframe.functions import encodings as enc
from strataframe.functions import vecops as vec
from strataframe.functions.positions import block_offsets, dense_codes


def back(df):
    return [r["value"] for r in df.orderBy("row_id").collect()]


def test_rle(rows):
    runs = enc.rle_encode(rows([42] * 1000), "row_id", "v")
    assert [(r["run_start"], r["value"], r["run_length"]) for r in runs.collect()] == [(0, 42, 1000)]
    values = [1, 1, None, None, 2, 2, 2, 1, 3, 3]
    runs = enc.rle_encode(rows(values), "row_id", "v", 4)
    assert back(enc.rle_decode(runs)) == values
    assert enc.rle_size(runs).first()["runs"] == 5
    for op, want in (("eq", [2, 2, 2]), ("ne", [1, 1, 1, 3, 3]), ("lt", [1, 1, 1]), ("le", [1, 1, 2, 2, 2, 1]), ("gt", [3, 3]), ("ge", [2, 2, 2, 3, 3])):
        assert back(enc.rle_filter(runs, op, 2)) == want


def test_delta(rows):
    d = enc.delta_encode(rows([10 * i for i in range(1000)]), "row_id", "v")
    assert [r["delta"] for r in d.orderBy("row_id").collect()] == [0] + [10] * 999
    values = [random.Random(1).randrange(-(10**9), 10**9) for _ in range(300)]
    assert back(enc.delta_decode(enc.delta_encode(rows(values, "long"), "row_id", "v", 64))) == values


def test_frames_and_widths(rows):
    df = rows([10_000 + i for i in range(1000)])
    b = enc.for_blocks(df, "row_id", "v").first()
    assert (b["base"], b["width"], b["n"]) == (10_000, 10, 1000) and b["bytes"] < 4000
    assert back(enc.for_decode(enc.for_encode(df, "row_id", "v"))) == [10_000 + i for i in range(1000)]
    p = enc.bitpack(rows([i % 16 for i in range(1000)]), "v").first()
    assert (p["base"], p["width"], p["bytes"]) == (0, 4, 504)
    constant = enc.bitpack(rows([7] * 10), "v").first()
    assert (constant["width"], constant["bytes"]) == (0, 0)
    assert enc.for_blocks(rows([7] * 10), "row_id", "v").first()["bytes"] == 0


def test_zigzag(rows):
    values = [0, -1, 1, -2, 2, 2**62, -(2**62), -(2**63), 2**63 - 1]
    z = rows(values, "long").select("row_id", enc.zigzag(F.col("v")).alias("z"), enc.unzigzag(enc.zigzag(F.col("v"))).alias("value"))
    assert back(z) == values
    assert [r["z"] for r in z.orderBy("row_id").limit(5).collect()] == [0, 1, 2, 3, 4]
    small = [-40, 3, 0, 99, -1]
    assert back(enc.for_zigzag_decode(enc.for_zigzag_encode(rows(small, "long"), "row_id", "v", 2))) == small


def test_dictionaries(rows):
    values = [random.Random(2).randrange(700) * 3 - 900 for _ in range(2000)]  # more than 256 entries
    df = rows(values)
    for codes in (enc.dictionary_sorted(df, "v"), enc.dictionary_first_seen(df, "row_id", "v")):
        held = codes.cache()
        assert sorted(r["code"] for r in held.collect()) == list(range(len(set(values))))
        assert back(enc.dictionary_decode(enc.dictionary_encode(df, "row_id", "v", held, strict=True), held)) == values
    in_order = {r["value"]: r["code"] for r in enc.dictionary_sorted(df, "v").collect()}
    assert in_order == {v: i for i, v in enumerate(sorted(set(values)))}
    seen = {r["value"]: r["code"] for r in enc.dictionary_first_seen(df, "row_id", "v").collect()}
    assert seen == {v: i for i, v in enumerate(dict.fromkeys(values))}
    few = rows([10, 20, 30, 40, 50] * 200)
    s = enc.dictionary_size(few, "v").first()
    assert (s["cardinality"], s["bytes"]) == (5, 5 * 4 + 1000)
    with pytest.raises(Exception, match="dictionary"):
        enc.dictionary_encode(rows([99]), "row_id", "v", enc.dictionary_sorted(few, "v"), strict=True).collect()


def test_offsets_and_codes_without_a_global_window(spark):
    parts = spark.createDataFrame([(i * 3000, i + 1) for i in range(20)], "p long, n long")
    got = {r["p"]: r["before"] for r in block_offsets(parts, "p", "n").collect()}
    assert got == {i * 3000: i * (i + 1) // 2 for i in range(20)}
    one = dense_codes(spark.createDataFrame([(5.0,)], "x double"), "x").first()
    assert one["code"] == 0


def test_vector_operations(rows, spark):
    df = rows([3, 1, 3, 3, 2, 1, 1, 5], "int")
    assert [r["prefix_sum"] for r in vec.prefix_sum(df, "row_id", "v", block_rows=3).orderBy("row_id").collect()] == [3, 4, 7, 10, 12, 13, 14, 19]
    assert [r["prefix_sum"] for r in vec.prefix_sum_block(df, "row_id", "v", 4).orderBy("row_id").collect()] == [3, 4, 7, 10, 2, 3, 4, 9]
    assert [r["conflicts"] for r in vec.conflict_detect(df, "row_id", "v", 4).orderBy("row_id").collect()] == [0, 0, 1, 2, 0, 0, 1, 0]
    assert [(r["row_id"], r["lane"]) for r in vec.compress(df, "row_id", F.col("v") > 1, 4).orderBy("row_id").collect()] == [(0, 0), (2, 1), (3, 2), (4, 0), (7, 1)]
    lanes = spark.createDataFrame([([1, 2, 3, 4], [True, False, True, False])], "x array<int>, m array<boolean>")
    r = lanes.select(vec.compress_lanes(F.col("x"), F.col("m")).alias("c"), vec.expand_lanes(F.array(F.lit(8), F.lit(9)), F.col("m")).alias("e"), vec.permute(F.col("x"), F.array(F.lit(3), F.lit(0))).alias("p"), vec.insert_lane(F.col("x"), 1, F.lit(0)).alias("i"), vec.reduce_lanes(F.col("x"), "add").alias("s")).first()
    assert (r["c"], r["e"], r["p"], r["i"], r["s"]) == ([1, 3], [8, None, 9, None], [4, 1], [1, 0, 3, 4], 10)
    top = spark.createDataFrame([(2**31 - 1, 5)], "a int, b int")
    r = top.select(vec.add_saturate(F.col("a"), F.col("b")).alias("s"), vec.mul_high(F.col("a"), F.col("a")).alias("h"), vec.pack_signed16(F.col("a")).alias("p"), vec.shift_right_logical(F.lit(-1), 60).alias("u"), vec.div(F.col("a"), F.lit(0)).alias("d")).first()
    assert (r["s"], r["h"], r["p"], r["u"], r["d"]) == (2**31 - 1, (2**31 - 1) ** 2 >> 32, 32767, 15, None)
