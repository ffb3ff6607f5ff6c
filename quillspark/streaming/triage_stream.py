"""Triage of streams: scoring is a column of one row and so runs as it is; conflicts need windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.claims import claims
from quillspark.plans.triage import analyze


def analyze_stream(docs: DataFrame, with_brief: bool = True) -> DataFrame:
    """A stream of documents to a stream of assessments, without state."""
    return analyze(docs, with_brief)


def spread_by_window(docs: DataFrame, ts: str = "ts", late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Range of each entity's numbers in event-time windows; rows later than ``late`` are dropped.

    The state is one row for each open window and entity. Works on tables alike.
    """
    found = claims(docs.select("text", ts).withWatermark(ts, late), [ts])
    by = found.groupBy(F.window(ts, length).alias("w"), "entity_key")
    out = by.agg(F.count("*").alias("n"), F.min("numeric_value").alias("low"), F.max("numeric_value").alias("high"), F.bool_and(F.abs("numeric_value") < 20).alias("small"))
    spread = F.col("high") - F.col("low")
    conflict = F.when(F.col("small"), spread > 0.15).otherwise(spread > F.when(F.col("low") != 0, F.abs("low")).otherwise(1.0) * 0.02)
    return out.select(F.col("w.start").alias("window_start"), "entity_key", "n", "low", "high", (conflict & (F.col("n") > 1)).alias("conflict"))
