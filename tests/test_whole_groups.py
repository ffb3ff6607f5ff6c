"""Groups of a stream that are compared whole: no document is left out for its place, and no group at the end."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.operators.claims import compare
from quillspark.streaming import comparison as M
from quillspark.streaming.runs import run_available
from test_streams import DOC, FIELDS, datetime, feed, group_rows, stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("room", [2, 50])
def test_a_stream_compares_all_documents(spark, tmp_path, room):
    """In any order of arrival, with documents that come again or beyond the horizon, and more than a task has at hand."""
    rows = group_rows(12, 3, lambda g: 80 if g % 5 == 0 else 55)
    rows += [(g, i, "again", "Gold: 77", ts + datetime.timedelta(minutes=1)) for g, i, _, _, ts in rows[::6]]
    rows.sort(key=lambda r: r[4])
    feed(spark, str(tmp_path / "in"), [*rows, (-1, 0, "", "", datetime.datetime(2030, 1, 1))], DOC, 25, 5)
    closed = run_available(M.gather_stream(stream(spark, str(tmp_path / "in"), DOC), late="2 hours", room=room), "comparison")
    got = {r["group_id"]: tuple(r) for r in M.compared_parts(closed, 100).select(FIELDS).collect()}
    want = {r["group_id"]: tuple(r) for r in compare(M.gathered(spark.createDataFrame(rows, DOC), most=1000)).select(FIELDS).collect()}
    assert got == want and set(got) == {r[0] for r in rows} and max(r[1] for r in got.values()) > 10
    assert closed.agg(F.max(F.size("doc_idx"))).first()[0] <= room


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_the_query_compares_all_groups_and_documents(spark):
    """Of twelve documents ten were compared, and the last group not at all."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").select((F.col("o_orderkey") / 16).cast("long").alias("group_id"), (F.col("o_orderkey") % 16).alias("i")).where("i <= group_id % 12")
    want = {tuple(r) for r in orders.groupBy("group_id").count().collect()}
    got = entry.queries()["q_compare_stream"](spark, SF)
    assert {tuple(r) for r in got.select("group_id", "doc_count").collect()} == want and max(n for _, n in want) == 12
