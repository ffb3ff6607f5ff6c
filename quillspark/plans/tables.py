"""Queries over word lists as tables, files of text and stored sketches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.lexicons import list_hits
from quillspark.plans import corpora as C
from quillspark.plans import oracle as O
from quillspark.plans.catalogue import query
from quillspark.plans.shared import fresh, written
from quillspark.plans.sketches import answers, daily, merged
from quillspark.plans.triage import scored
from quillspark.sources import readers
from quillspark.streaming.runs import run_available

#: Two versions of two lists: of 1995 on, weights are others, and so are some of the terms.
VERSIONS = (
    ("certainty", "guaranteed", 1.0, "1990-01-01", "1995-01-01"), ("certainty", "clearly", 1.0, "1990-01-01", "1995-01-01"), ("certainty", "proven", 1.0, "1990-01-01", None), ("certainty", "everyone", 0.5, "1990-01-01", "1995-01-01"),
    ("certainty", "guaranteed", 0.25, "1995-01-01", None), ("certainty", "Everyone clearly knows", 2.0, "1995-01-01", None),
    ("hedges", "may be", 1.0, "1990-01-01", "1996-07-01"), ("hedges", "may", 0.5, "1996-07-01", None), ("hedges", "early evidence", 1.0, "1990-01-01", "1994-01-01"), ("hedges", "early evidence suggests", 1.5, "1994-01-01", None),
)
_ROWS = ", ".join(f"({O.q(a)}, lower({O.q(t)}), {w}e0, DATE '{f}', {f'DATE {O.q(u)}' if u else 'NULL::DATE'})" for a, t, w, f, u in VERSIONS)


@query(f"""WITH c AS ({O.ORDERS}), l(list, term, weight, valid_from, valid_to) AS (VALUES {_ROWS}),
w AS (SELECT doc_id, o_orderdate::DATE AS day, list_transform({O.WORDS.format('text')}, lambda x: lower(x)) AS w FROM c JOIN orders ON o_orderkey = doc_id),
p AS (SELECT doc_id, day, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS phrase FROM w, range(1, 4) AS r(n))
SELECT doc_id, list, count(*) AS n_hits, count(DISTINCT phrase) AS n_terms, round(sum(weight), 6) AS weight FROM p JOIN l ON phrase = term AND day >= valid_from AND (valid_to IS NULL OR day < valid_to) GROUP BY ALL""")
def q_lexicon_versions(spark, d):
    lexicon = spark.createDataFrame(list(VERSIONS), "list string, term string, weight double, valid_from string, valid_to string")
    lexicon = lexicon.withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})
    docs = C.orders_corpus(spark, d, day=F.col("o_orderdate").cast("date"))
    return list_hits(docs, lexicon).withColumn("weight", F.round("weight", 6))


@query("WITH l AS (SELECT unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n')) AS text FROM documents) SELECT sha256(text) AS line_sha256, length(text)::BIGINT AS n_chars, count(*) AS n FROM l GROUP BY ALL")
def q_text_lines(spark, d):
    """The documents written as text files, and read as a stream of lines."""
    folder = fresh(spark, "text")
    C.table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.text(folder)
    lines = run_available(readers.text_stream(spark, folder), "lines")
    return lines.groupBy("text").agg(F.count("*").alias("n")).select(F.sha2("text", 256).alias("line_sha256"), F.length("text").cast("bigint").alias("n_chars"), "n")


@query(O.scored() + f"""SELECT month, n, n_sources, top FROM (SELECT month, sum(k)::BIGINT AS n, string_agg(concat(action, ':', k::VARCHAR), ',' ORDER BY k DESC, action) AS top FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, {O.ACTION} AS action, count(*) AS k FROM z JOIN orders ON o_orderkey = doc_id GROUP BY ALL) GROUP BY month)
JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT source_type) AS n_sources FROM z JOIN orders ON o_orderkey = doc_id GROUP BY ALL) USING (month)""")
def q_sketch_months(spark, d):
    """Months from the stored sketches of their days; few sources and actions, so their numbers are exact."""
    rows = scored(C.orders_corpus(spark, d, day=F.col("o_orderdate").cast("date")), "s.overall", "d.action")
    days = daily(rows.select("day", F.col("source_type").alias("source"), F.col("s.overall").alias("overall"), F.col("d.action").alias("action")))
    months = answers(merged(written(days, "sketches").withColumn("month", F.date_format("day", "yyyy-MM")), "month"))
    top = F.array_join(F.transform("top", lambda x: F.concat(x["item"], F.lit(":"), x["n"].cast("string"))), ",")
    return months.select("month", "n", "n_sources", top.alias("top"))
