import pytest
from strataframe.operators.predicate import PredicateBuilder, make_eq, make_predicate, predicate
from strataframe.operators.scan import CancellableScan, ScanOptions, deliver, scan, scan_segments


def n(df, pred):
    return scan(df, pred).count()


def test_comparison_counts(rows):
    df = rows(range(1000))
    assert [n(df, p.build()) for p in (predicate().eq("v", 500), predicate().lt("v", 500), predicate().le("v", 500), predicate().gt("v", 500), predicate().ge("v", 500), predicate().ne("v", 500))] == [1, 500, 501, 499, 500, 999]
    assert n(rows([1000 * i for i in range(1000)], "long"), make_eq("v", 500_000)) == 1


def mask(df, pred):
    return [r["match"] for r in pred.mask(df).orderBy("row_id").collect()]


def test_masks(rows):
    assert mask(rows([1, 10, 5, 10, 20], "long"), make_eq("v", 10)) == [False, True, False, True, False]
    df = rows([5, 30, 15], "long")
    assert mask(df, predicate().lt("v", 10).and_().gt("v", 20).build()) == [False, False, False]
    assert mask(df, predicate().lt("v", 100).and_().gt("v", 20).build()) == [False, True, False]
    assert mask(df, predicate().lt("v", 100).gt("v", 20).and_().build()) == [False, True, False]
    assert mask(rows([400, 600, 1500], "long"), predicate().gt("v", 500).and_().lt("v", 1000).build()) == [False, True, False]


def test_two_columns_and_run(spark):
    df = spark.range(4096).selectExpr("cast(id as int) id", "cast(id % 64 as int) val")
    out = scan(df, predicate().lt("id", 256).and_().eq("val", 7).build())
    assert [r["id"] for r in out.orderBy("id").collect()] == [7, 71, 135, 199]
    assert n(spark.range(8192).selectExpr("cast(id as int) v"), predicate().lt(0, 100).build()) == 100


def test_example_scan(spark):
    df = spark.range(100_000).selectExpr("id", "id % 64 as value", "(id * 2654435761) % 1000003 as score")
    assert n(df, predicate().lt("id", 50_000).and_().eq("value", 7).build()) == 782


def test_builder_rules():
    p = predicate().eq("a", 1).and_().eq("b", 2).or_().eq("c", 3).not_().build()
    assert [x for x in p.program if x in ("and", "or", "not")] == ["and", "or", "not"]
    q = predicate().gt("a", 10).and_().lt("a", 100).and_().is_not_null("b").build()
    assert len(q.terms()) == 3 and q.program.count("and") == 2
    for bad in (lambda: predicate().and_(), lambda: predicate().eq("a", 1).eq("b", 2).build(), lambda: predicate().eq("a", 1).and_().build(), lambda: predicate().not_(), lambda: predicate().eq("a", 1).and_().or_(), lambda: make_predicate("like", "a", "x")):
        with pytest.raises(ValueError):
            bad()
    assert isinstance(predicate(), PredicateBuilder)


def test_not_null_or_fractions(rows):
    df = rows([1, None, 3])
    assert n(df, predicate().eq("v", 1).not_().build()) == 1
    assert n(df, predicate().is_null("v").build()) == 1
    assert n(df, predicate().is_not_null("v").and_().ge("v", 3).build()) == 1
    assert n(df, predicate().build()) == 3
    assert n(rows([0.25, 0.5, 0.75], "double"), predicate().lt("v", 0.5).build()) == 1
    assert n(df, predicate().in_("v", 1, 2).build()) == 1 and n(df, predicate().not_in("v", 1, 2).build()) == 1


def test_push_down_and_pruned_columns(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id * 2 as x", "id * 3 as y").write.parquet(str(tmp_path / "t"))
    out = scan(spark.read.parquet(str(tmp_path / "t")), predicate().lt("id", 10).and_().gt("x", 4).build(), ScanOptions(columns=("x",)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,10)" in plan and "GreaterThan(x,4)" in plan and "y#" not in plan
    assert out.count() == 7


def test_segments_delivery_cancel(spark):
    parts = [spark.range(a, a + 100).toDF("v") for a in (0, 100, 200)]
    out = scan_segments(parts, predicate().lt("v", 150).build())
    assert out.count() == 150
    deliver(out, lambda batch: None)
    c = CancellableScan(spark)
    assert c.run(out.count) == 150
    assert c.cancel() == []
