"""The skew-safe helpers give what plain windows give, whatever the stretch length and the key skew."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scholarmatch.functions.scale import _stretches, keep_first, literal_table, page_of, previous_value, running_total, spaced_starts


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    keys = ["hot"] * 200 + [f"k{i % 40}" for i in range(200)]
    data = [(k, o, rng.choice(["a", "b", None]), rng.randint(0, 9)) for o, k in enumerate(rng.sample(keys, len(keys)))]
    return spark.createDataFrame(data, "k string, o long, v string, n int")


@pytest.mark.parametrize("parts", [1, 7, 50, None])
def test_previous_value_is_lag(rows, parts):
    want = rows.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("o"))).select("k", "o", "p")
    got = previous_value(rows, ["k"], "o", "v", "p", parts).select("k", "o", "p")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7, 50, None])
def test_running_total_is_cumulative_sum(rows, parts):
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select("k", "o", F.sum("n").over(w))
    got = running_total(rows, ["k"], "o", {"t": F.col("n")}, parts).select("k", "o", "t")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_equal_instants_follow_the_whole_order(spark):
    df = spark.createDataFrame([("a", 5, "y"), ("a", 5, "x"), ("a", 4, "z"), (None, 1, "q"), (None, 2, "r")], "k string, o long, v string")
    got = {(r["k"], r["v"]): r["p"] for r in previous_value(df, ["k"], ["o", "v"], "v", "p", 3).collect()}
    assert got == {("a", "z"): None, ("a", "x"): "z", ("a", "y"): "x", (None, "q"): None, (None, "r"): "q"}


def test_a_hot_key_with_sparse_orders_is_cut(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), (F.col("id") * 1_000_000).alias("o"))
    cut = _stretches(rows, ["k"], ["o"], 30)
    sizes = [r["count"] for r in cut.where("k = 'hot'").groupBy("_part").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 8 and max(sizes) <= 300


def test_keep_first_keeps_the_lowest_order(rows):
    got = {r["k"]: r["o"] for r in keep_first(rows, ["k"], "o").collect()}
    want = {r["k"]: r["o"] for r in rows.groupBy("k").agg(F.min("o").alias("o")).collect()}
    assert got == want


def test_literal_table_quotes(spark):
    t = literal_table(spark, ("a", "b"), [("it's", ["x", "y"]), (None, ["back\\slash"])])
    assert {r["a"] for r in t.collect()} == {"it's", None}
    assert {x for r in t.collect() for x in r["b"]} == {"x", "y", "back\\slash"}


def test_hot_key_top_rows_are_limited_before_the_shuffle(rows):
    w = Window.partitionBy("k").orderBy("o")
    plan = rows.withColumn("r", F.row_number().over(w)).where("r <= 2")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def _one_after_the_other(rows, gaps):
    last, out = {}, {}
    for key, at, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        if at is None:
            out[i] = None
            continue
        start = at if key not in last else max(at, last[key] + gaps.get(key, 0))
        last[key] = out[i] = start
    return out


@pytest.mark.parametrize("parts", [1, 6, 40, None])
def test_spaced_starts_equal_a_sequential_model(spark, parts):
    rng = random.Random(8)
    keys = ["hot"] * 150 + [rng.choice(["a", "b", "free", None]) for _ in range(150)]
    rows = [(k, rng.choice([None, rng.randrange(2000), rng.randrange(20) * 100]), i) for i, k in enumerate(keys)]
    gaps = {"hot": 30, "a": 7, "b": 1000}
    df = spark.createDataFrame(rows, "k string, at long, i long").withColumn("o", F.coalesce("at", F.lit(-1)))
    gap = F.when(F.col("k") == "hot", 30).when(F.col("k") == "a", 7).when(F.col("k") == "b", 1000)
    got = spaced_starts(df, ["k"], ["o", "i"], "at", gap, "start", parts)
    assert got.columns == ["k", "at", "i", "o", "start"]
    assert {r["i"]: r["start"] for r in got.collect()} == _one_after_the_other(rows, gaps)


def test_a_burst_waits_longer_with_every_call(spark):
    df = spark.createDataFrame([("s", t, i) for i, t in enumerate([0, 1, 2, 3, 100])], "k string, at long, i long")
    got = {r["i"]: r["start"] for r in spaced_starts(df, ["k"], ["at", "i"], "at", F.lit(10), "start").collect()}
    assert got == {0: 0, 1: 10, 2: 20, 3: 30, 4: 100}


def test_a_page_reads_the_ranges_that_hold_it(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "t int, i int")
    order = [F.desc("t"), F.col("i")]
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for first, last in ((0, 9), (245, 260), (490, 520), (600, 610)):
        page = page_of(df, order, first, last, parts=20)
        assert sorted(map(tuple, page.collect()), key=lambda r: (-r[0], r[1])) == want[first:last]
    page = page_of(df, order, 480, 490, parts=20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan.split("PushedFilters")[1][:200]
    assert page_of(df.limit(0), order, 0, 9).count() == 0


def test_narrow_rows_are_dealt_out_before_they_grow(spark):
    """A small file is one task; features and wide records of its rows are made in many."""
    from scholarmatch.plans import discovery, people

    grown = {"lexical_similarity": (discovery, "Generate explode"), "pick_author": (people, "SortAggregate")}
    for name, (module, mark) in grown.items():
        plan = module.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
        dealt = next((i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line), -1)  # the plan is printed from its end
        scan = next(i for i in range(dealt, len(plan)) if "FileScan" in plan[i])
        assert any(mark in line for line in plan[:max(dealt, 0)]), name
        assert not any("regexp_extract_all" in line for line in plan[dealt:scan]), name  # nor filtered by it at the scan
