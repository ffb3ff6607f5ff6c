"""What is asked of ASCII texts in other ways gives the answers of the patterns; few windows are those cut out by places."""

import random

from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T

PIECES = (
    "https://a.b/c", "httpx", "2024-01-02", "12024-01-023", "May 5, 2024", "May 5, 20245", "x_1 12, 1999", "9:30", "12:301", "1.5%", "1.5%x", "7 percent", "7percents", "3bps", "4 basis points", "12 days", "5 usd", "5 $x", "6B", "6BB",
    "$5", "$5.20M", "$", "n = 3", "n=4", "n  =x", "Jane Moreno", "Jane  Moreno Smith", "JANE", "NASDAQ / x", "XYZ - A", "ABCDEF-a", "+1.5%", "-3%", "25 bps", "12 stocks up", "flat", "dataset", "audit", "filing", "SEC", "log file", "p-value",
    "\"we checked every single log file\"", "said", "RT @a", "#tag", "@b", "thread", "_thread_", "dm me", "follow", "LOUD", "WORDS", "THESE4", "NOBODY", "TIME", "act now", "no one", "act", "now", "before it's too late", "100%", "of course", "e.g.", "x",
)
BETWEEN = (" ", " ", " ", "  ", "\n", "\n ", " \n\n", "\t", "\x0b", "\x1c", "\r\n", ". ", "! ", "? \n", ".", ", ", "-", "_", "", "\x01")


def _texts(n: int, odd: tuple[str, ...] = ()) -> list[str]:
    rng = random.Random(9)
    return ["".join(rng.choice(PIECES + odd) + rng.choice(BETWEEN[:18] if k % 8 else BETWEEN) for _ in range(rng.randrange(1, 40 if k % 5 else 120))) for k in range(n)] + ["", " ", "\n", " .\n! "]


def _rows(spark, odd: tuple[str, ...] = ()):
    return spark.createDataFrame([(x,) for x in _texts(1500, odd)], "t string").withColumn("a", T.is_ascii(F.col("t")))


def test_quick_patterns_have_the_same_matches(spark):
    t = F.col("t")
    both = {n: (F.regexp_extract_all(t, F.lit(T.ascii_pattern(n)), 0), F.regexp_extract_all(t, F.lit(T.pattern(n)), 0)) for n in L.QUICK}
    row = _rows(spark).select(*(F.sum((a != b).cast("int")).alias(n) for n, (a, b) in both.items()), *(F.sum(F.size(a)).alias(f"n_{n}") for n, (a, _) in both.items())).first()
    assert [n for n in L.QUICK if row[n]] == [] and min(row[f"n_{n}"] for n in L.QUICK) > 4


def test_windows_of_few_and_many_matches(spark):
    t, a = F.col("t"), F.col("a")
    for name, k in (("evidence", 80), ("quote", 120), ("evidence", 5)):
        by_places = T.bound(T.pieces(t), lambda cut: F.transform(T.places(t, name), lambda p: T.around(cut, p, k)))
        row = _rows(spark, ("é", "ſ", "文")).select(F.sum((T.windows(t, name, k, ascii=a) != by_places).cast("int")).alias("all"), F.sum((T.windows(t, name, k, 3) != F.slice(by_places, 1, 3)).cast("int")).alias("three"), F.max(F.size(by_places)).alias("n")).first()
        assert (row["all"], row["three"]) == (0, 0) and row["n"] > (16 if name == "evidence" else 1)


def test_forms_of_ascii_texts(spark):
    t = F.col("t")
    parts = F.split(T.strip(t), L.jvm(r"(?<=[.!?])\s+|\n+"), -1)
    long = F.regexp_extract_all(t, F.lit(T.pattern("caps_word")), 0)
    caps = F.size(F.filter(long, lambda w: w == F.upper(w)))
    ratio = caps / F.greatest(F.size(long), F.lit(1))
    pairs = {
        "normalize": (T.normalize(t), F.trim(F.regexp_replace(t, L.jvm(r"[\s\x1c-\x1f]+"), " "))),
        "sentences": (T.sentences(t), F.filter(F.transform(parts, T.strip), lambda s: s != "")),
        "words": (F.coalesce(T.plain_words(t), F.transform(T.words(T.normalize(t)), F.lower)), F.transform(T.words(T.normalize(t)), F.lower)),
        "shouting": (T.shouting(t), F.when((F.size(long) < 8) | (caps < 4) | (ratio < 0.20), F.lit(0.0)).otherwise(T.clamp((ratio - 0.20) * 5.0))),
        "attribution": (T.attribution(t, F.when(T.any_of(t, T.QUOTES), T.count(t, "quote")).otherwise(0)), T.attribution(t)),
    }
    for odd in ((), ("é", " ", "“", "K")):
        row = _rows(spark, odd).select(*(F.sum((x != y).cast("int")).alias(n) for n, (x, y) in pairs.items()), F.sum((T.shouting(t) > 0).cast("int")).alias("loud")).first()
        assert [n for n in pairs if row[n]] == [] and row["loud"] > 10


def test_phrases_are_there_for_every_count(spark):
    t, known, v, line = map(F.col, ("t", "known", "v", "line"))
    rows = _rows(spark).withColumn("w", T.plain_words(t)).withColumns({"known": T.listed(t, F.col("w")), "line": T.joined(F.col("w"))}).withColumn("v", T.vocabulary(t, known))
    lists = [n for n in L.FOLDED if L.single_words(L.FOLDED[n])]
    row = rows.select(*(F.sum((T.count_in(t, v, n, known, F.col("a"), line) != F.regexp_count(t, F.lit(T.pattern(n)))).cast("int")).alias(n) for n in lists)).first()
    assert [n for n in lists if row[n]] == []


def test_a_score_asks_for_the_host_and_the_lower_case_once(spark):
    """The conditions on host and text were made of a new expression each, so a row paid for each of them."""
    from quillspark.plans.triage import scored

    docs = spark.createDataFrame([("a text", "https://a.b/c")], "text string, source_url string")
    plan = scored(docs, "r.inferred")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("://([^/?#]*)") == 1
