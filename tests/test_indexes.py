import random

import pytest
from strataframe.operators.bloom import build_bloom
from strataframe.operators.predicate import predicate
from strataframe.operators.scan import ScanOptions, scan, scan_stats, segment_can_match_blooms
from strataframe.operators.zonemap import block_of, build_zone_map, pruned_blocks, segment_can_match


def test_blocks(rows):
    z = build_zone_map(rows(range(10_000)), "row_id", ["v"], 1000).orderBy("block_id").collect()
    assert len(z) == 10 and all((r["v_min"], r["v_max"], r["row_count"], r["v_nulls"]) == (1000 * k, 1000 * k + 999, 1000, 0) for k, r in enumerate(z))


def test_leading_and_all_null_blocks(rows):
    z = build_zone_map(rows([None, None, 5, 6, None, None, None, None]), "row_id", ["v"], 4).orderBy("block_id").collect()
    assert [(r["v_min"], r["v_max"], r["v_nulls"]) for r in z] == [(5, 6, 2), (None, None, 4)]


PREDICATES = [
    lambda: predicate().eq("v", 7), lambda: predicate().ne("v", 0), lambda: predicate().lt("v", 5), lambda: predicate().le("v", -3), lambda: predicate().gt("v", 40), lambda: predicate().ge("v", 49),
    lambda: predicate().is_null("v"), lambda: predicate().is_not_null("v"), lambda: predicate().in_("v", 1, 48), lambda: predicate().not_in("v", 0), lambda: predicate().eq("v", 0).not_(),
    lambda: predicate().lt("v", 3).or_().gt("v", 45), lambda: predicate().lt("v", 3).or_().is_null("v").not_(), lambda: predicate().gt("v", 10).and_().lt("v", 20).not_(),
]


@pytest.mark.parametrize("kind", ["int", "double"])
def test_pruning_keeps_every_match(rows, kind):
    r = random.Random(3)
    values = [0] * 40 + sorted(r.randrange(-5, 50) for _ in range(200)) + [None] * 25 + [r.choice([None, 1, 48]) for _ in range(60)]
    if kind == "double":
        values = [None if x is None else float(x) + 0.0 for x in values] + [float("nan"), 3.5]
    df = rows(values, kind).cache()
    zones = build_zone_map(df, "row_id", ["v"], 20).cache()
    for make in PREDICATES:
        p = make().build()
        plain, pruned = scan(df, p), scan(df, p, ScanOptions(None, "row_id", 20, zones))
        assert sorted(x["row_id"] for x in pruned.collect()) == sorted(x["row_id"] for x in plain.collect()), p.program


def test_pruning_prunes(rows):
    df = rows(range(1000))
    zones = build_zone_map(df, "row_id", ["v"], 100)
    assert pruned_blocks(zones, predicate().lt("v", 150).build()).where("keep").count() == 2
    assert not segment_can_match(zones, predicate().gt("v", 5000).build()).first()["keep"]
    s = scan_stats(df, predicate().lt("v", 150).build(), "row_id", zones, 100).first()
    assert (s["blocks_scanned"], s["blocks_pruned_zone"], s["rows_scanned"], s["rows_filtered"], s["rows_returned"]) == (10, 8, 1000, 50, 150)


def test_parquet_prunes_rows_at_the_reader(spark, tmp_path):
    spark.range(1 << 18).selectExpr("id", "id % 7 as x").repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    out = scan(spark.read.parquet(str(tmp_path / "t")), predicate().lt("id", 1000).build())
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    assert int(leaf.metrics().get("numOutputRows").get().value()) < 1 << 17


def test_pruned_scan_reads_less(spark, tmp_path):
    """On a table in row order, blocks that cannot match are not read, though the predicate's own column is in no order."""
    path = str(tmp_path / "t")
    spark.range(1 << 18).selectExpr("id", "if(id div 4096 in (3, 40), 1, 0) as hit", "id % 7 as x").repartitionByRange(8, "id").sortWithinPartitions("id").write.option("parquet.block.size", 1 << 16).option("parquet.column.statistics.enabled#hit", "false").option("parquet.enable.dictionary", "false").parquet(path)
    df = spark.read.parquet(path)
    zones = build_zone_map(df, "id", ["hit"], 4096)
    p = predicate().eq("hit", 1).build()  # the file has no statistics of this column

    def read(out):
        n = len(out.collect())
        return n, int(out._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value())

    plain, pruned = read(scan(df, p)), read(scan(df, p, ScanOptions(None, "id", 4096, zones)))
    assert plain[0] == pruned[0] > 0 and pruned[1] < plain[1] / 2
    assert scan(df, predicate().eq("hit", 9).build(), ScanOptions(None, "id", 4096, zones)).count() == 0


def test_scan_with_blooms(rows):
    df = rows(range(100))
    options = ScanOptions(blooms={"v": build_bloom(df, "v", 8192)})
    assert scan(df, predicate().eq("v", 5).build(), options).count() == 1
    out = scan(df, predicate().eq("v", 5000).build(), options)
    assert out.count() == 0 and "Filter" not in out._jdf.queryExecution().optimizedPlan().toString()  # nothing is read


def test_bloom(rows, spark):
    b = build_bloom(rows([7 * i for i in range(1000)]), "v", 1 << 16)
    probes = spark.range(10_000).selectExpr("cast(id as int) v")
    found = {r["v"]: r["might_contain"] for r in b.might_contain(probes, "v").collect()}
    assert all(found[v] for v in range(0, 7000, 7))
    assert sum(found[v] for v in range(10_000) if v % 7 or v >= 7000) < 100
    s = b.bits_set().first()
    assert 0 < s["bits_set"] <= 7000 and abs(s["false_positive_rate"] - (s["bits_set"] / 65536) ** 7) < 1e-12


@pytest.mark.parametrize(("kind", "values"), [("int", [-5, -1, 0, 9]), ("double", [-0.5, 2.25]), ("string", ["", "a", "abcdefgh1", "abcdefgh2"]), ("long", [-(2**40), 2**40])])
def test_bloom_never_loses_a_member(rows, kind, values):
    df = rows([*values, None], kind)
    found = {r["v"]: r["might_contain"] for r in build_bloom(df, "v", 4096).might_contain(df.select("v"), "v").collect()}
    assert all(found[v] for v in values) and not found[None]


def test_bloom_merge_block_stats(rows, spark):
    df = rows(range(100))
    a, b = build_bloom(df.where("v < 50"), "v", 8192), build_bloom(df.where("v >= 50"), "v", 8192)
    assert a.merge(b).might_contain(df.select("v"), "v").where("might_contain").count() == 100
    with pytest.raises(ValueError):
        a.merge(build_bloom(df, "v", 4096))
    blocked = build_bloom(df, "v", 8192, block=block_of("row_id", 10))
    probe = spark.createDataFrame([(0, 5), (1, 5), (99, 5)], "block_id long, v int")
    assert {r["block_id"]: r["might_contain"] for r in blocked.might_contain(probe, "v", "block_id").collect()} == {0: True, 1: False, 99: False}
    zones = build_zone_map(df, "row_id", ["v"], 10)
    s = scan_stats(df, predicate().eq("v", 5).build(), "row_id", zones, 10, {"v": blocked}).first()
    assert (s["blocks_pruned_zone"], s["blocks_pruned_bloom"], s["rows_returned"]) == (9, 0, 1)
    s = scan_stats(df.where("v <> 5"), predicate().eq("v", 5).build(), "row_id", zones, 10, {"v": build_bloom(df.where("v <> 5"), "v", 8192)}).first()
    assert (s["blocks_pruned_bloom"], s["rows_returned"]) == (1, 0)


def test_segment_bloom(rows, spark):
    b = {"v": build_bloom(rows(range(50)), "v", 8192)}
    keep = lambda p: segment_can_match_blooms(p.build(), b, spark).first()["keep"]
    assert keep(predicate().eq("v", 5)) and not keep(predicate().eq("v", 5000)) and not keep(predicate().eq("v", 5).and_().eq("v", 5000))
    assert keep(predicate().eq("v", 5000).or_().eq("v", 5)) and keep(predicate().eq("v", 5000).not_()) and keep(predicate().eq("w", 5000)) and keep(predicate())


def test_bloom_of_a_rate(rows):
    few, many = build_bloom(rows([1, None, 1]), "v", 8192, rate=0.01), build_bloom(rows(range(5000)), "v", 8192, rate=0.01)
    assert few.bits == 8192 and many.bits == 65536 and many.bits_set().first()["false_positive_rate"] < 0.01
    blocked = build_bloom(rows(range(5000)), "v", 8192, block=block_of("row_id", 1000), rate=0.01)
    assert blocked.bits == 16384 and blocked.bits_set().where("false_positive_rate < 0.01").count() == 5
    assert build_bloom(rows([None]), "v", 8192, rate=0.01).bits == 8192
    with pytest.raises(ValueError):
        build_bloom(rows([1]), "v", 8192, rate=0)
