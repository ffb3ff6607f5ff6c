"""Merged sketches against exact answers."""

from pyspark.sql import functions as F

from quillspark.plans.sketches import QUANTILES, answers, daily, merged


def test_merged_days_within_their_error(spark):
    rows = spark.range(0, 60000, 1, 6).select(
        (F.col("id") % 30).alias("day"), F.concat(F.lit("s"), (F.xxhash64("id") % 20000).cast("string")).alias("source"), F.pow(F.abs(F.xxhash64("id") % 100003) / 100003.0, F.lit(2)).alias("overall"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), (F.col("id") % 5000).cast("string"))).alias("action"),
    )
    got = answers(merged(daily(rows)), 3).first()
    exact = rows.select(F.count_distinct("source")).first()[0]
    assert got["n"] == 60000 and abs(got["n_sources"] - exact) < 0.05 * exact
    for q, x in zip(QUANTILES, got["quantiles"]):
        assert abs(rows.where(F.col("overall") <= x).count() / 60000 - q) < 0.035
    assert got["top"][0]["item"] == "hot" and abs(got["top"][0]["n"] - 20000) <= 60
    halves = merged(daily(rows).withColumn("half", F.col("day") < 15), "half")
    assert answers(halves).agg(F.sum("n")).first()[0] == 60000


def test_few_values_are_exact_and_missing_ones_harmless(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, "x"), (1, "b", None, "x"), (2, None, None, None), (None, "a", 0.1, "y")], "day int, source string, overall double, action string")
    got = answers(merged(daily(rows))).first()
    assert (got["n"], got["n_sources"], [tuple(t) for t in got["top"]][:2]) == (4, 2, [("x", 2), ("y", 1)])
    lone = answers(daily(rows.where("day = 2"))).first()
    assert lone["n_sources"] == 0 and lone["quantiles"] is None
    assert daily(rows.where("false")).count() == 0
