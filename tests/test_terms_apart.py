"""Terms of several words are counted apart from those of one word, and evidence is marked once."""

from pyspark.sql import functions as F
from test_quick import PIECES

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.plans.triage import scored

APART = [n for n in L.FOLDED if L.several_words(L.FOLDED[n])]


def test_lists_whose_terms_share_words_stay_whole():
    assert {"hedges", "urgency", "certainty", "bias", "logic", "connectives"} <= set(APART)
    assert not {"evidence", "attack", "missing", "press_release", "fin_terms"} & set(APART)  # "interview transcript", "must be purged", "unclear why", any words, "sell-off"


def test_counts_of_terms_apart(spark):
    forms = {n: sorted(L._ways(L._parser.parse(L.FOLDED[n]))) for n in APART}
    texts = [sep.join((a, b, a, PIECES[(i + k) % len(PIECES)], b)) for n in APART for i, a in enumerate(forms[n]) for k, sep in enumerate((" ", "-", ", ", "\n")) for b in (forms[n][(7 * i + 3) % len(forms[n])],)]
    t, known, v, pairs = map(F.col, ("t", "known", "v", "pairs"))
    rows = spark.createDataFrame([(x.title() if k % 2 else x,) for k, x in enumerate(texts)], "t string").withColumns({"a": T.is_ascii(t), "low": F.lower(t), "w": T.plain_words(t)})
    rows = rows.withColumns({"known": T.listed(t, F.col("w")), "pairs": T.paired(F.col("w"))}).withColumn("v", T.vocabulary(t, known))
    row = rows.select(*(F.sum((T.count_in(t, v, n, known, F.col("a"), pairs=pairs, low=F.col("low")) != F.regexp_count(t, F.lit(T.pattern(n)))).cast("int")).alias(n) for n in APART)).first()
    assert len(texts) > 500 and [n for n in APART if row[n]] == []


def test_evidence_is_marked_once(spark):
    texts = ["", "the trial", "a log file, the SEC filing and an interview transcript of 12 May", "raw data\x01 with a mark, a full report", "le dataset é n = 5", "no_file trial_x audit", "p-value p value Audit" * 30]
    rows = scored(spark.createDataFrame([(x,) for x in texts], "text string"), "f.n_evidence", "f.anchored")
    for r in rows.select("f.*", F.regexp_count("text", F.lit(T.pattern("evidence"))).alias("n"), F.size(F.filter(T.windows(F.col("text"), "evidence", 80), lambda w: T.has(w, "spec_window"))).alias("near")).collect():
        assert (r["n_evidence"], r["anchored"]) == (r["n"], r["near"])
    plan = rows.select("f.n_evidence", "f.anchored")._jdf.queryExecution().optimizedPlan().toString()
    assert "__f_marked" in plan
