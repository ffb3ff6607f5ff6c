"""q_validate equals its SQL on texts that are null, blank in other ways, or at the limits."""

import duckdb

import __spark_entry__ as entry
from quillspark.sources import readers

TEXTS = (None, "", " \n\t\r", " ", "\x0b\x0c", "  \n", "\x1c", "a", " a", *(c * n for c in ("a", "é", "\U0001f600") for n in (12000, 12001, 50000, 50001)), " " * 12001, " " * 12001)


def test_validate_equals_its_sql(spark, tmp_path):
    """A null was a bad request, and so were texts of other white space."""
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    theirs = sorted(con.sql(entry.oracle_sql()["q_validate"]).fetchall())
    assert sorted(map(tuple, entry.queries()["q_validate"](spark, str(tmp_path)).collect())) == theirs
    assert {s for _, *both in theirs for s in both} == {"ok", "bad_request", "text_too_long"}


def test_requests_without_text_stay_refused(spark):
    rows = readers.validate(spark.createDataFrame([(x,) for x in TEXTS[:7]], "text string"))
    assert {r.status for r in rows.collect()} == {"bad_request"}
