"""Word lists as tables against a loop."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lexicons

D = datetime.date
LIST = [
    ("a", "No Doubt", 1.0, D(2020, 1, 1), D(2021, 1, 1)), ("a", "no doubt", 3.0, D(2021, 1, 1), None), ("a", "doubt", 0.5, D(2020, 1, 1), None), ("b", "élan  vital", 2.0, D(2020, 1, 1), None),
    ("b", "", 9.0, D(2020, 1, 1), None), (None, "doubt", 9.0, D(2020, 1, 1), None), ("b", "doubt", None, D(2020, 1, 1), None), ("b", "doubt", 9.0, None, None),
]
DOCS = [
    (1, "No doubt, no DOUBT: no\ndoubt", D(2020, 5, 1)), (2, "No doubt, no DOUBT", D(2021, 1, 1)), (3, "ÉLAN vital élan vital élan", D(2030, 1, 1)), (4, None, D(2020, 5, 1)), (5, "", D(2020, 5, 1)),
    (6, "doubt", None), (7, "doubt", D(2019, 12, 31)), (8, "nothing of note", D(2020, 5, 1)),
]
WANT = {(1, "a"): (6, 2, 4.5), (2, "a"): (4, 2, 7.0), (3, "b"): (2, 1, 4.0)}


@pytest.mark.parametrize("most", [lexicons.BROADCAST_ROWS, 0])
def test_versions_of_lists(spark, monkeypatch, most):
    """Both ways of the join; periods, missing values, clashing columns, empty tables."""
    monkeypatch.setattr(lexicons, "BROADCAST_ROWS", most)
    lexicon = spark.createDataFrame(LIST, lexicons.LEXICON)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in DOCS], "doc_id int, text string, day date, list string, phrase string")
    got = lexicons.list_hits(docs, lexicon)
    assert {(r["doc_id"], r["list"]): (r["n_hits"], r["n_terms"], r["weight"]) for r in got.collect()} == WANT
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert (most == 0 or "BroadcastHashJoin" in plan) and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert lexicons.list_hits(docs.where("false"), lexicon).count() == 0 and lexicons.list_hits(docs, lexicon.where("false")).count() == 0


def test_runs_are_linear(spark):
    """200,000 words in one text."""
    rows = spark.createDataFrame([("a b c " * 66667,)], "t string").select(F.size(lexicons.runs(F.split(F.trim("t"), " "), 4)).alias("n"))
    assert rows.first()["n"] == 200001 + 200000 + 199999 + 199998


def test_only_phrases_of_a_small_lexicon_become_rows(spark):
    """Each run of words of each document became a row, and hits were shuffled twice."""
    rows = spark.createDataFrame([(k, t, "2024-01-01") for k, t in enumerate(("May be, may be early evidence suggests MAY", "a b a b a", "é may_be may be", "", None, "b" * 9))], "doc_id long, text string, day string")
    lexicon = spark.createDataFrame([("l", t, w, "2020-01-01", None) for t, w in (("may", 1.0), ("may be", 2.0), ("early evidence suggests", 3.0), ("a b a", 4.0), ("b", 5.0))] + [("m", "May be", 1.0, "2020-01-01", "2024-01-02")], "list string, term string, weight double, valid_from string, valid_to string")
    got = lexicons.list_hits(rows, lexicon)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    few, lexicons.LITERAL_ROWS = lexicons.LITERAL_ROWS, 0
    try:
        all_runs = lexicons.list_hits(rows, lexicon)
    finally:
        lexicons.LITERAL_ROWS = few
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, all_runs.collect())) == [(0, "l", 6, 3, 10.0), (0, "m", 2, 1, 2.0), (1, "l", 4, 2, 18.0), (2, "l", 2, 2, 3.0), (2, "m", 1, 1, 1.0)]
