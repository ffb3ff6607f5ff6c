"""Counts behind a look for pairs of words, of lists by initials and of texts without dates are those of the patterns."""

from pyspark.sql import functions as F
from test_quick import PIECES, _rows

from quillspark.functions import lexicon as L
from quillspark.functions import text as T

LISTS = [n for n in L.FOLDED if L.single_words(L.FOLDED[n])]


def test_counts_behind_pairs_of_words(spark):
    terms = sorted({f.replace("\0", " ").strip() for n in LISTS for f in L._ways(L._parser.parse(L.FOLDED[n])) if " " in f or "\0" in f})
    texts = [sep.join(("x", *terms[k : k + 3], "y", PIECES[k % len(PIECES)])) for k in range(0, len(terms), 2) for sep in (" ", "\n", ". ", " x ")]
    t, known, v, pairs = map(F.col, ("t", "known", "v", "pairs"))
    rows = _rows(spark, ("é",)).unionByName(spark.createDataFrame([(x,) for x in texts], "t string").withColumn("a", T.is_ascii(t))).withColumns({"w": T.plain_words(t), "low": F.lower(t)})
    rows = rows.withColumns({"known": T.listed(t, F.col("w")), "pairs": T.paired(F.col("w"))}).withColumn("v", T.vocabulary(t, known))
    row = rows.select(*(F.sum((T.count_in(t, v, n, known, F.col("a"), pairs=pairs, low=F.col("low")) != F.regexp_count(t, F.lit(T.pattern(n)))).cast("int")).alias(n) for n in LISTS), F.sum(F.size("pairs")).alias("all")).first()
    assert [n for n in LISTS if row[n]] == [] and row["all"] > 100


def test_lists_by_initials_on_lower_case(spark):
    t = F.col("t")
    rows = _rows(spark).select(t, F.lower(t).alias("low"))
    row = rows.select(*(F.sum((T.count(t, n, F.lit(True), F.col("low")) != F.regexp_count(t, F.lit(T.pattern(n)))).cast("int")).alias(n) for n in L.FOLDED)).first()
    assert [n for n in L.FOLDED if row[n]] == []


def test_texts_without_dates_have_the_same_matches(spark):
    t = F.col("t")
    wrong = {n: (T.count(t, n) != F.regexp_count(t, F.lit(T.pattern(n)))) | (T.has(t, n) != t.rlike(T.pattern(n))) for n in L.UNDATED}
    row = _rows(spark, ("é",)).select(*(F.sum(w.cast("int")).alias(n) for n, w in wrong.items()), F.sum((~t.rlike(L.DATED)).cast("int")).alias("undated")).first()
    assert [n for n in wrong if row[n]] == [] and row["undated"] > 100


def test_lengths_of_sentences_by_blanks(spark):
    t = F.col("t")
    rows = _rows(spark).select(t, F.col("a"), T.words(t).alias("w"), T.sentences(t).alias("s"), (T.tidy(t) & ~F.contains(t, F.lit("  "))).alias("single"))
    row = rows.select(F.sum((T.coherence(F.col("w"), F.col("s"), ascii=F.col("a"), single=F.col("single")) != T.coherence(F.col("w"), F.col("s"))).cast("int")).alias("wrong"), F.sum(F.col("single").cast("int")).alias("n")).first()
    assert row["wrong"] == 0 and row["n"] > 20


def test_a_score_looks_for_no_phrase_by_phrase(spark):
    """Each list looked for each of its phrases in the whole text, which cost more than the pattern."""
    from quillspark.plans.triage import scored

    plan = scored(spark.createDataFrame([("a text",)], "text string"), "s.overall")._jdf.queryExecution().optimizedPlan().toString()
    assert "__f_n_urgency" in plan and " limited time " not in plan
