"""Numbers and widest differences of pairs of claims, without the pairs."""

import random

from pyspark.sql import functions as F

from quillspark.operators import claims as K

SCHEMA = "group_id string, doc_idx bigint, entity_key string, numeric_value double"


def test_summaries_are_those_of_the_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdefgh") + str(rng.randrange(12)), rng.choice([None, *range(4)]), rng.choice(["x", "y", None]), rng.choice([None, -1.5, 0.1, 0.3, 7.0, 7.25])) for _ in range(900)]
    found = spark.createDataFrame(rows, SCHEMA)
    pairs = K.claim_pairs(found).groupBy("group_id", "entity_key").agg(F.count("*").alias("n_pairs"), F.max("difference").alias("widest"))
    ours, theirs = (sorted(map(tuple, df.select("group_id", "entity_key", "n_pairs", "widest").collect()), key=str) for df in (K.pair_summary(found), pairs))
    assert ours == theirs and len(ours) > 100


def test_one_entity_in_many_documents(spark):
    """20 billion pairs; a join that makes them doesn't end."""
    n = 200_000
    found = spark.range(n).select(F.lit("g").alias("group_id"), F.col("id").alias("doc_idx"), F.lit("x").alias("entity_key"), F.col("id").cast("double").alias("numeric_value"))
    assert [tuple(r) for r in K.pair_summary(found).collect()] == [("g", "x", n * (n - 1) // 2, n - 1.0)]
