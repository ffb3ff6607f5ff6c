"""Tasks of composed texts are bounded, however large the table."""

from pyspark.sql import functions as F

from quillspark.plans import corpora as C


def test_a_task_has_bounded_rows(spark, tmp_path):
    rows = spark.range(130_000).select(F.col("id").alias("o_orderkey"), F.lit("1995-01-01").cast("date").alias("o_orderdate"), F.lit(1.5).alias("o_totalprice"))
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    counts = C.orders_corpus(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in counts) == 130_000 and max(r["count"] for r in counts) <= 1.1 * C.TASK_ROWS
