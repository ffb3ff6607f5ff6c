"""Counts from the listed words of a text are those of the patterns."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T

LISTS = [n for n in L.FOLDED if L.single_words(L.FOLDED[n])]


def test_counts_from_listed_words(spark):
    rng = random.Random(5)
    terms = [re.sub(r"\\s[*+]?", " ", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", t)).replace("[- ]", "-").replace("\\", "").replace("?", "") for n in LISTS for t in L.FOLDED[n][5:-3].split("|")]
    odd = ["", " ", " ", " ", "-", ".", "\n", "'", "x", "_", "1", "é", "ſ", "K"]
    texts = ["".join(x for _ in range(rng.randrange(1, 6)) for x in (rng.choice(odd[:8] if k % 2 else odd), rng.choice([str, str.upper, str.title])(rng.choice(terms)), rng.choice(odd[:8]))) for k in range(1200)]
    t, v, known = F.col("t"), F.col("v"), F.col("known")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("known", T.listed(t)).withColumn("v", T.vocabulary(t, known))
    wrong = rows.select(F.count("known").alias("plain"), *(F.sum((T.count_in(t, v, n, known) != F.regexp_count(t, F.lit(T.pattern(n)))).cast("int")).alias(n) for n in LISTS)).first()
    assert 500 < wrong.plain < 1200
    assert [n for n in LISTS if wrong[n]] == []


def test_strip_is_that_of_all_white_space(spark):
    texts = [a + "b c" + a for a in (*map(chr, range(1, 0x300)), *map(chr, range(0x1FF0, 0x2070)), "\u1680", "\u180e", "\u3000", "\ufeff", "\u200b")]
    own = F.regexp_replace("t", T.jvm(r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"), "")
    assert spark.createDataFrame([(x,) for x in texts], "t string").where(T.strip(F.col("t")) != own).count() == 0
