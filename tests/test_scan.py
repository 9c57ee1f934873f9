"""Exact group analytics: rows in ranges must equal the window functions."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from listwatch.operators import classify as K, scan


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, one key is NULL, the rest is spread thin."""
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{rng.randrange(40)}", rng.randrange(50), i, rng.randrange(9))
            for i in range(6000)]
    return spark.createDataFrame(rows, "g string, k int, id int, v int").repartition(5)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges stay small, so the hot group and most others reach over several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("group", [["g"], []])
def test_row_number(skewed, group):
    order = [F.col("k").desc(), F.col("id")]
    got = scan.row_number_within(skewed, group, order, "n")
    want = skewed.withColumn("n", F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("bigint"))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("group", [["g"], []])
def test_running_sum(skewed, group):
    order = [F.col("k"), F.col("id")]
    got = scan.running_sum_within(skewed, group, order, F.col("v"), "s")
    over = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    want = skewed.withColumn("s", F.sum("v").over(over))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_previous(skewed):
    order = [F.col("k"), F.col("id")]
    got = scan.previous_within(skewed, ["g"], order, F.col("v"), "p")
    want = skewed.withColumn("p", F.lag("v").over(W.partitionBy("g").orderBy(*order)))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_no_task_takes_the_whole_order(spark, skewed):
    got = scan.row_number_within(skewed, [], [F.col("id")], "n")
    per = [r["n"] for r in got.groupBy(F.floor((F.col("n") - 1) / 1_000)).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert per == [1_000] * 6
    parts = scan._placed(skewed, [], [F.col("id")]).groupBy("_part").count().collect()
    assert len(parts) == 13 and max(r["count"] for r in parts) < 1_500
    assert scan.row_number_within(skewed.limit(0), [], [F.col("id")], "n").count() == 0


def test_top_per_group_limits_before_the_shuffle(skewed):
    top = scan.top_per_group(skewed, ["g"], [F.col("id")], 3)
    assert top.count() <= 3 * 42
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_first_per_key(skewed):
    got = {r["g"]: r["id"] for r in scan.first_per_key(skewed, ["g"], [F.col("k"), F.col("id")]).collect()}
    want = {r["g"]: r["id"] for r in skewed.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("k", "id")))
            .where("n = 1").collect()}
    assert got == want


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab cč\n") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    keys = sorted({"".join(rng.choice("abc č") for _ in range(rng.randrange(1, 5))) for _ in range(40)})
    items = spark.createDataFrame(texts, "id int, t string")
    dim = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {(r["id"], r["rule"]) for r in K.contains_join(items, dim, "id", "t").collect()}
    assert got == {(i, k) for i, t in texts for k in keys if k in t}


def test_contains_join_sends_no_texts_to_the_driver(spark):
    items = spark.range(50).selectExpr("id", "concat('alfa beta ', id) as t")
    joined = K.contains_join(items, spark.createDataFrame([("beta",)], "key string"), "id", "t")
    kept = str(joined._jdf.queryExecution().optimizedPlan())
    assert kept.count("strategy=merge") == 2 and joined.count() == 50
