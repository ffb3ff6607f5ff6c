"""Importance resampling towards a target distribution: hashed n-gram features and Gumbel-perturbed top scores.

Scoring is free of explode: higher-order functions turn a text into the array of its features' buckets, and an aggregate
adds up entries of a literal array with one gain for each bucket. Only counts by bucket and rows of a few numbers are
shuffled. Drawn documents are ranked by ranges of the score, so no task sees them all.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Stored

#: Fixed: what stands between words, after A-Z became a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, of a null one none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BETWEEN), "")


def features(found: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, each joined by one space."""
    runs = [found]
    for n in range(2, longest + 1):  # the shorter array is padded with nulls, and concat() of a null is null
        behind = F.slice(found, n, F.greatest(F.size(found), F.lit(1)))
        runs.append(F.filter(F.zip_with(runs[-1], behind, lambda run, word: F.concat(run, F.lit(" "), word)), lambda run: run.isNotNull()))
    return F.concat(*runs) if longest > 1 else found


def bucket_array(found: Column, buckets: int) -> Column:
    """Places from 1 on of the features' buckets."""
    return F.transform(found, lambda w: (F.crc32(w.cast("binary")) % buckets + 1).cast("int"))


def bucket_totals(rows: DataFrame, text: str, longest: int, buckets: int) -> list[int]:
    """Number of features in each bucket over all rows; a task sends at most ``buckets`` rows."""
    hashed = bucket_array(features(words(F.col(text)), longest), buckets)
    found = rows.select(F.explode(hashed).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()  # at most one row for each bucket
    totals = [0] * buckets
    for row in found:
        totals[row["bucket"] - 1] = row["n"]
    return totals


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's share in the target and in the source, with one feature added to every bucket."""
    size = len(source)
    s_all, t_all = float(sum(source) + size), float(sum(target) + size)
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target)]


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable that depends on the seed and the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """rows with ``place`` (1, 2, 3... in the given order) and their number.

    Ranges of the order are sorted each by itself; a row's place is its place there and the number of rows in ranges before.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    stored = Stored(ordered, "ranked").df.withColumn("part", F.shiftright("at", 33))
    sizes = sorted((r["part"], r["n"]) for r in stored.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row for each range
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = rows.sparkSession.createDataFrame(starts, "part bigint, before bigint")
    placed = stored.join(F.broadcast(before), "part")  # one row for each range
    return placed.withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "at", "before"), total


def resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 10, longest: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred (rounded down) with the highest scores
    are drawn, ties to the smaller doc_id (null first), then to fewer features; rows that repeat are drawn each by itself.
    Null and empty texts have no features and weight 0. Other columns are ignored; an empty table gives no rows; an empty
    target counts every bucket alike.
    """
    gain = gains(bucket_totals(docs, text, longest, buckets), bucket_totals(target, target_text, longest, buckets))
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # a literal once the optimizer has folded it
    found = words(F.col(text))
    n = F.col("n_words").cast("bigint")
    n_features = sum((F.greatest(n - k, F.lit(0)) for k in range(1, longest)), n)
    weight = F.aggregate(bucket_array(features(found, longest), buckets), F.lit(0).cast("bigint"), lambda total, b: total + F.element_at(table, b))
    hashed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.size(found).alias("n_words"), weight.alias("weight"))
    weighed = hashed.select("doc_id", "n_words", n_features.alias("n_features"), "weight")
    scored = weighed.select(
        "doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"), F.monotonically_increasing_id().alias("row")
    )
    rows = Stored(scored, "importance").df
    placed, n = ranked(rows.where("eligible"), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("row")])
    drawn = F.when(F.col("place") <= percent * n // 100, F.col("place"))
    names = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*names, drawn.alias("rank")).unionByName(rows.where("NOT eligible").select(*names, F.lit(None).cast("bigint").alias("rank")))
