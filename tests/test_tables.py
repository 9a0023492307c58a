import pytest
from pyspark.sql import functions as F
from strataframe import types as L
from strataframe.operators import aggregate, delta, merge
from strataframe.operators.predicate import predicate
from strataframe.sources.table import Segment, SegmentWriter, open_segment, writer_options
from strataframe.streaming.ingest import drained, ingest, read_log, resolved_stream


def test_write_and_reopen(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "cast(0 as int) p", "cast(42 as int) r", "cast(10 * id as int) d", "if(id % 10 = 0, null, cast(id as double)) x")
    w = SegmentWriter(spark, str(tmp_path / "s"), row_id="id", created_ts=5).encode("p", "plain").encode("r", "rle").encode("d", "delta")
    s = w.add_zone_map("d", 100).add_bloom_filter("d", 1 << 16).finish(df, 2)
    s = open_segment(spark, s.path)
    assert (s.num_rows, s.num_columns, s.created_ts) == (1000, 5, 5)
    assert [s.column_encoding(c) for c in ("p", "r", 3)] == ["plain", "rle", "delta"] and s.column_type("x") == "double"
    assert sorted(map(tuple, s.df.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert [r[0] for r in s.read_values("d", 100, 3).collect()] == [1000, 1010, 1020]
    assert s.zone_map().count() == 10 and s.bloom_filter("p") is None
    assert s.bloom_filter("d").might_contain(s.df.select("d"), "d").where("not might_contain").count() == 0
    stats = {r["column"]: r for r in s.stats().collect()}
    assert (stats["x"]["null_count"], stats["d"]["distinct_count"], stats["d"]["max"]) == (100, 1000, 9990.0)
    held = s.prefetch("d")
    assert held.count() == 1000 and held.storageLevel.useMemory
    held.unpersist()


def test_empty_segment_and_bad_encodings(spark, tmp_path):
    schema = L.schema(a=L.INT32, f=L.FLOAT, s=L.VARCHAR)
    assert Segment.create(spark, str(tmp_path / "e"), schema).num_rows == 0
    for c, e in (("f", "delta"), ("f", "for"), ("s", "bitpack"), ("a", "huffman")):
        with pytest.raises(ValueError):
            writer_options(schema, {c: e})
    with pytest.raises(ValueError):
        writer_options(schema, compression="brotli9")
    with pytest.raises(TypeError):
        from pyspark.sql.types import DateType

        L.logical(DateType())
    assert L.INT64.is_integer and L.FLOAT.is_floating_point and not L.VARCHAR.is_fixed_size


@pytest.mark.parametrize("codec", ["none", "zstd", "lz4", "lz4_raw"])
def test_compression_round_trip(spark, tmp_path, codec):
    df = spark.range(10_000).selectExpr("cast(id % 100 as int) v")
    s = SegmentWriter(spark, str(tmp_path / "c"), compression=codec).finish(df)
    assert s.df.groupBy("v").count().where("count = 100").count() == 100


def test_aggregates(rows):
    df = rows([3, None, 5, 2**31 - 1])
    r = aggregate.aggregate_scan(df, ["v"], predicate().ge("v", 3).build()).first()
    assert tuple(r) == (float(3 + 5 + 2**31 - 1), 3, 3, 2**31 - 1)
    assert tuple(aggregate.aggregate_scan(df, ["v"], predicate().lt("v", 0).build()).first()) == (None, 0, None, None)
    assert aggregate.column_sum(df, "v").first()[0] == 8 + 2**31 - 1 and aggregate.null_count(df, "v").first()[0] == 1
    s = aggregate.column_stats(df, ["v"]).first()
    assert (s["total_count"], s["null_count"], s["distinct_count"], s["min"], s["max"]) == (4, 1, 3, 3.0, float(2**31 - 1))
    empty = aggregate.column_stats(df.where("false"), ["v"]).first()
    assert (empty["total_count"], empty["distinct_count"], empty["min"]) == (0, 0, None)
    assert aggregate.merge_stats(aggregate.column_stats(df, ["v"]), aggregate.column_stats(df, ["v"])).first()["total_count"] == 8


PAYLOAD = L.schema(c0=L.INT32, c1=L.INT64)


def make_log(spark, *entries):
    return spark.createDataFrame([(k, ts, i, op, c, None if c is None else c * 10) for i, (k, ts, op, c) in enumerate(entries)], delta.log_schema(PAYLOAD))


def test_log_rules(spark):
    log = make_log(spark, (1, 100, "I", 1), (2, 101, "I", 2), (1, 102, "D", None))
    assert delta.get(log, 1).count() == 0 and delta.get(log, 2).first()["ts"] == 101 and delta.get(log, 1, as_of=101).first()["c0"] == 1
    again = make_log(spark, (1, 100, "I", 1), (1, 101, "D", None), (1, 102, "I", 9))
    assert tuple(delta.get(again, 1).first()) == (1, 102, 9, 90)
    assert delta.resolve(make_log(spark, (1, 100, "I", 1), (1, 100, "D", None))).count() == 0
    many = make_log(spark, *[(i, 100 + i, "I", i) for i in range(1, 101)])
    got = [r["row_id"] for r in delta.get_range(many, 50, 75).orderBy("row_id").collect()]
    assert (len(got), got[0], got[-1]) == (25, 50, 74) and delta.get_range(many, 1, 101).count() == 100


def test_delta_store(spark, tmp_path):
    d = delta.DeltaLog(spark, str(tmp_path / "log"), PAYLOAD, flush_at=10)
    assert d.log().count() == 0
    d.insert([(i, i, i * 10) for i in range(15)])
    assert d.should_flush() and d.pending() == 15
    d.begin_flush()
    d.end_flush(10)
    assert d.pending() == 5 and not d.flushing
    d.insert([(1, 7, 70)], ts=500)
    d.delete([2], ts=501)
    assert delta.get(d.log(), 1).first()["c0"] == 7 and delta.get(d.log(), 2).count() == 0 and d.clock >= 501
    m = delta.DeltaLog(spark, str(tmp_path / "m"), PAYLOAD, flush_at=5)
    m.insert([(i, i, i) for i in range(10)])
    drained = m.store_for_flush()
    assert drained.count() == 10 and m.flushing
    m.finish_flush()
    assert not m.flushing and m.pending() == 0
    big = spark.createDataFrame([(i, 1, 1, "I", "x" * 100, "y" * 200) for i in range(100)], "row_id long, ts long, seq long, op string, a string, b string")
    assert delta.pending(big).first()["memory"] == 100 * 316


def test_reopened_log_goes_on(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(1, 5):
        d = delta.DeltaLog(spark, path, PAYLOAD, flush_at=3)
        d.insert([(1, i, i)])
        assert delta.get(d.log(), 1).first()["c0"] == i
    d.end_flush(2)
    again = delta.DeltaLog(spark, path, PAYLOAD, flush_at=3)
    assert (again.clock, again.flushed, again.pending()) == (d.clock, 2, 2)
    frame = spark.createDataFrame([(9, k, k) for k in range(20)], "row_id long, c0 int, c1 long").coalesce(1)
    again.insert(frame, ts=50)
    again.insert(frame.where("c0 < 5"), ts=50)
    assert delta.get(again.log(), 9).first()["c0"] == 4
    assert again.store_for_flush() is not None
    third = delta.DeltaLog(spark, path, PAYLOAD, flush_at=3)
    assert third.generation == 1 and third.flushing and third.pending() == 0
    third.clear()
    assert third.log().count() == 0


def test_stats_of_large_integers_and_text(spark):
    df = spark.createDataFrame([(2**53, "b"), (2**53 + 1, "a"), (None, "a"), (2**53, None)], "n long, s string")
    got = {r["column"]: r for r in aggregate.column_stats(df, ["n", "s"]).collect()}
    assert (got["n"]["distinct_count"], got["n"]["max_value"], got["n"]["null_count"]) == (2, str(2**53 + 1), 1)
    assert (got["s"]["distinct_count"], got["s"]["min_value"], got["s"]["max_value"], got["s"]["min"]) == (2, "a", "b", None)


def test_merging(spark, tmp_path, rows):
    a, b = rows(range(100)), rows(range(100, 200))
    r = merge.merge_segments(spark, [a, b], a.schema).agg(F.count("*"), F.min("v"), F.max("v")).first()
    assert tuple(r) == (200, 0, 199) and merge.merge_segments(spark, [], a.schema).count() == 0
    order = merge.merge_column([(rows([5, 1, 3]), 1), (rows([4, 2, 6]), 2)], "row_id", "v").orderBy("ts", "source_ord", "pos")
    assert [x["value"] for x in order.collect()] == [5, 1, 3, 4, 2, 6]
    base = spark.range(100).selectExpr("id as row_id", "cast(id as int) c0", "id as c1")
    log = make_log(spark, (100, 200, "I", 100), (101, 201, "I", 101))
    stats = merge.compact(base, log, str(tmp_path / "v1"))
    out = spark.read.parquet(str(tmp_path / "v1")).agg(F.count("*"), F.min("c0"), F.max("c0")).first()
    assert tuple(out) == (102, 0, 101) and (stats.rows_out, stats.rows_inserted, stats.rows_deleted) == (102, 2, 0)
    gone = make_log(spark, (100, 200, "I", 100), (101, 201, "I", 101), (100, 300, "D", None), (5, 300, "D", None))
    stats = merge.compact(base, gone, str(tmp_path / "v2"))
    assert (stats.rows_out, stats.rows_deleted) == (100, 1)
    assert merge.merge_column([(rows([5, 1, 3]), 1)], "row_id", "v", make_log(spark, (1, 9, "D", None), (7, 9, "I", 8)).withColumnRenamed("c0", "v")).count() == 3
    m = merge.Merger(spark, on_stats=lambda s: None)
    assert spark.read.parquet(m.submit([a, b], a.schema, str(tmp_path / "v3"), 1).result()).count() == 200
    assert m.submit([], a.schema, str(tmp_path / "v4")).result() and m.last_stats is not None
    m.stop()


def test_streaming_ingestion(spark, tmp_path):
    schema = delta.log_schema(PAYLOAD)
    make_log(spark, (1, 100, "I", 1), (2, 101, "I", 2), (1, 102, "D", None)).write.parquet(str(tmp_path / "in"))
    flushed = []
    run = lambda: ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "log"), str(tmp_path / "cp"), 2, lambda log: flushed.append(log.count())).awaitTermination()
    q = ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "log"), str(tmp_path / "cp"), 2, lambda log: flushed.append(log.count()))
    q.awaitTermination()
    assert flushed == [3]
    assert [r["row_id"] for r in delta.resolve(read_log(spark, schema, str(tmp_path / "log"))).collect()] == [2]
    make_log(spark, (5, 110, "I", 5)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert flushed == [3]  # one insert is pending since the flush
    make_log(spark, (6, 111, "I", 6)).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert flushed == [3, 2] and drained(spark, str(tmp_path / "log")) >= 2
    stream = resolved_stream(spark, str(tmp_path / "in"), schema)
    stream.writeStream.outputMode("complete").format("memory").queryName("resolved").trigger(availableNow=True).start().awaitTermination()
    got = {r["row_id"]: (r["ts"], r["c0"], r["visible"]) for r in spark.table("resolved").collect()}
    assert got == {1: (100, 1, False), 2: (101, 2, True), 5: (110, 5, True), 6: (111, 6, True)}
