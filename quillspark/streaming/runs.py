"""Streams that read what is there and end."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.plans.shared import fresh
from quillspark.streaming.trust import STORE

_KEY = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, what: str, *, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs an append stream over all data that are available now and gives its rows, written as Parquet in the shared folder.

    checkpoint and out: those of an earlier run, to go on where it ended; by default new ones.
    """
    spark = stream.sparkSession
    out, checkpoint = out or fresh(spark, what), checkpoint or fresh(spark, f"{what}-checkpoint")
    before = spark.conf.get(_KEY)
    spark.conf.set(_KEY, STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_KEY, before)
    return spark.read.schema(stream.schema).parquet(out)
