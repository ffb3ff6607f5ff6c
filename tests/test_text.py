"""Text functions against Python's own regular expressions on awkward strings."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T

STRINGS = [
    "", "   ", "élan étude naïve café", "émay may onç éon MAY", "One. Two! Three?\nFour\n\nFive", "n=4 n= 4 10-Q p-value filings filing", "100% sure, 100%a", "$5B 3 percent 8% y/y 2024-01-02 10:30 Jane Doe",
    "He said \"this is a rather long quoted passage\" to Ann Lee.", "“Curly quotes of more than twenty characters”", "NASDAQ Nasdaq OTC Markets OTC The Fed fed S&P 500", "🙂 wake up 🙂 act now", "ABC / Corp 3AB - x $3 -4.5% 25 bps", "must  be  jailed; enemies of us",
]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, t string")


@pytest.mark.parametrize("name", sorted({**L.FOLDED, **L.CASED}))
def test_counts_and_places_match_python(spark, name):
    pattern = re.compile({**L.FOLDED, **L.CASED}[name], re.I if name in L.FOLDED else 0)
    rows = frame(spark, STRINGS).select("id", T.count(F.col("t"), name).alias("n"), T.places(F.col("t"), name).alias("p")).collect()
    for r in rows:
        found = [(m.start(), m.end(), m[0]) for m in pattern.finditer(STRINGS[r.id])]
        assert r.n == len(found), (name, STRINGS[r.id])
        assert [tuple(x) for x in r.p] == found, (name, STRINGS[r.id])


def test_sentences_and_words_match_python(spark):
    for r in frame(spark, STRINGS).select("id", T.sentences(F.col("t")).alias("s"), T.words(T.normalize(F.col("t"))).alias("w"), T.n_words(F.col("t")).alias("n")).collect():
        text = STRINGS[r.id]
        assert r.s == [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if p.strip()]
        assert r.w == re.findall(r"\b\w+\b", text)
        assert r.n == len(text.split())


def test_rounding_is_that_of_the_exact_value(spark):
    values = [0.1235, 1.005, 0.5625, 0.0625, -0.0625, 0.125, 0.375, 2.675, 12.5, -3.14159, 0.0, 1 / 3, 0.9995, 0.145]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", *(T.py_round(F.col("x"), k).alias(f"r{k}") for k in (0, 2, 3))).collect()
    for r in rows:
        assert (r.r0, r.r2, r.r3) == (round(r.x, 0), round(r.x, 2), round(r.x, 3)), r.x


def test_compress(spark):
    texts = ["short", "word " * 60, "x" * 300, "a" * 120 + " (" + "b" * 200, "  padded  "]
    out = [r.c for r in frame(spark, texts).select("id", T.compress(F.col("t")).alias("c")).orderBy("id").collect()]
    assert out[0] == "short" and out[4] == "padded"
    assert out[1] == ("word " * 40).strip() + "…"
    assert out[2] == "x" * 200 + "…"
    assert out[3] == "a" * 120 + "…"


def test_unique_folded_keeps_the_first_form(spark):
    row = spark.createDataFrame([(["OTC", "Otc", "NYSE", "otc", "nyse"],)], "a array<string>").select(T.unique_folded(F.col("a")).alias("u")).first()
    assert row.u == ["OTC", "NYSE"]


def test_hosts(spark):
    urls = ["https://WWW.Sec.gov:8080/x", "http://user@x.com/a", "ftp://a.b", "no url", "https://a.gov).", ""]
    rows = frame(spark, urls).select("id", T.netloc(F.col("t")).alias("h")).orderBy("id").collect()
    assert [r.h for r in rows] == ["www.sec.gov:8080", "user@x.com", "a.b", "", "a.gov).", ""]


def test_gates_open_for_every_match(spark):
    """Counts behind a look into the vocabulary are the counts: phrases of the lists in odd surroundings, other letters and case foldings."""
    import random
    import re

    from pyspark.sql import functions as F

    from quillspark.functions import lexicon as L
    from quillspark.functions import text as T

    rng, lists = random.Random(11), {**L.FOLDED, **L.CASED}
    gated = {n: L.needed_words(p) for n, p in lists.items()}
    assert all(gated[n] for n in ("certainty", "hedges", "hype", "urgency", "evidence", "logic", "bias", "attack", "filler", "anonymous", "fin_terms", "press_release", "allocation", "macro_regions", "provider", "venue", "connectives"))
    assert gated["session"] is None and gated["specificity"] is None and "the" not in gated["certainty"]
    loose = [re.sub(r"\\s[*+]?", " ", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", t)).replace("[- ]", "-").replace("\\", "").replace("?", "") for n, p in lists.items() if gated[n] for t in p[5:-3].split("|")]
    odd = ["ſ", "İ", "ı", "K", "é", "²", "_", "́", "-", "'", "\n", "", " ", ".", "1"]
    texts = []
    for _ in range(1500):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            t = rng.choice(loose)
            t = rng.choice([t, t.upper(), t.title(), t.replace("s", "ſ", 1), t.replace("k", "K", 1), t.replace("i", "ı", 1)])
            parts += [rng.choice(odd), t, rng.choice(odd), rng.choice([" ", "", "x"])]
        texts.append("".join(parts))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", T.vocabulary(F.col("t")))
    t, v = F.col("t"), F.col("v")
    names = [n for n in lists if gated[n]]
    wrong = rows.select(*(F.sum((T.count(t, n) != T.count_in(t, v, n)).cast("int")).alias(n) for n in names), *(F.sum(T.count(t, n)).alias(f"all_{n}") for n in names)).first()
    assert all(wrong[n] == 0 for n in names) and sum(wrong[f"all_{n}"] > 0 for n in names) > 20


def test_places_by_marks(spark):
    """Places are those of Python's finditer, also in texts that have the mark themselves."""
    import re

    from pyspark.sql import functions as F

    from quillspark.functions import text as T

    texts = ["", "ab", "xabyab", "ab\x01ab x \x01", "é🙂ab ab🙂", "abab" * 200, "\x01", "$0ab\\1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.matches(F.col("t"), "a(b)").alias("m"))
    assert {r["i"]: [(x["s"], x["e"], x["m"]) for x in r["m"]] for r in rows.collect()} == {i: [(m.start(), m.end(), m.group()) for m in re.finditer("ab", t)] for i, t in enumerate(texts)}
