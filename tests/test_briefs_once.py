"""Sentences are classified once for a brief, however many of its fields are read."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans.triage import analyze, with_briefs

TEXT = "The OTC price is as of prior close, estimated. Shares fell 12.5% because of earnings, and data was reported by Reuters in a long filing. It is likely to be bullish here.\nNo filing  was\tfound."


def test_a_brief_is_made_once(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Short."), (3, None)], "doc_id long, text string")
    fields = ("key_signals", "source_caveats", "missing_receipts", "interpretation_or_framing")
    whole = analyze(docs).select("doc_id", *(F.to_json(f"assessment.signal_brief.{f}").alias(f) for f in fields))
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("prior (?:close|trading)") <= 8  # four kinds, ASCII or not
    own = with_briefs(docs).select("doc_id", *(F.to_json(f"signal_brief.{f}").alias(f) for f in fields))
    assert sorted(own.collect()) == sorted(whole.collect()) and whole.first()["source_caveats"] != "[]"


def test_words_between_white_space(spark):
    texts = ["", " ", "a", " a  b\nc ", "a\tb", "a\x1cb c", "é a b", "a\n\n b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.n_words(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [len(r["t"].split()) for r in rows]
