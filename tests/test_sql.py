"""SQL functions against the columns that they are made from."""


from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators import claims as K
from quillspark.plans import sql
from quillspark.plans.triage import scored

TEXTS = [None, "", "  ", "Shares rose 5.5% on Monday, the 'filing' says; 100% certain! \\ back\\slash", "The CPI: 3.1%\nGold: $2,000/oz\nCPI: 3.1%\nCPI: 3.4%", "Unnamed people are saying it's a shocking miracle!! Act now " * 40, "ÉLAN “quoted words that go on for a while” and more; it's 5 o'clock"]


def test_text_of_columns(spark):
    """Operators, decimals, strings with operators and quotes in them, lambdas and structs mean the same as SQL text."""
    t, n = F.col("t"), F.col("n")
    columns = [
        n + 1, n / 3, -n * 0.1, (n > 1) & ~(n == 2) | n.isNull(), n.isin(1, 2), F.when(n >= 2, "a='b' and(1.5)").otherwise("it\\'s \n"), t.rlike(L.jvm(r"\b5\.5%|it's\b")), F.filter(F.split(t, " "), lambda w: (w != "") & (F.length(w) > 2)),
        F.exists(F.split(t, ""), lambda c: c == "'"), F.aggregate(F.sequence(F.lit(1), n), F.lit(0.25), lambda a, x: a + x), F.struct((n % 2).alias("odd"), t.alias("t"))["odd"], T.py_round(n * 1.005, 2), T.count(t, "certainty"), F.lit(1e-5) * n,
    ]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(TEXTS)], "t string, n int").where("n > 0")
    want = rows.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    got = rows.selectExpr(*(f"{sql.text_of(c)} AS c{i}" for i, c in enumerate(columns)))
    assert [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert list(map(repr, got.collect())) == list(map(repr, want.collect()))


def test_triage_in_sql(spark):
    sql.register(spark)
    sql.register(spark)
    rows = spark.createDataFrame([(i, t, k, u) for i, t in enumerate(TEXTS) for k, u in (("auto", ""), ("primary", "https://www.sec.gov/x"), (None, None))], "i int, text string, source_type string, source_url string")
    got = spark.sql("SELECT i, source_type AS k, triage(text, source_type, source_url) AS t FROM {rows}", rows=rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange", "Join"))
    want = scored(rows.withColumn("k", F.col("source_type")))
    want = want.select("i", "k", F.struct("d.action", "d.verdict", "f.genre", F.col("r.effective").alias("source_type"), "s.overall", "d.flags", "d.questions").alias("t"))
    key = lambda r: (r["i"], r["k"] or "")
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert got.schema["t"].dataType.simpleString() == want.schema["t"].dataType.simpleString()


def test_claims_in_sql(spark):
    sql.register(spark)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "i int, text string, unit string")
    fields = "pos, entity_key, entity_label, raw_value, numeric_value"
    want = sorted(map(tuple, K.claims(docs, ["i"]).select("i", *fields.split(", "), "unit").collect()))
    lateral = spark.sql(f"SELECT i, {fields}, c.unit FROM {{docs}} AS d, LATERAL numeric_claims(d.text) AS c", docs=docs)
    listed = spark.sql(f"SELECT i, {fields}, c.unit FROM (SELECT i, claim_list(text) AS found FROM {{docs}}) LATERAL VIEW inline(found) c", docs=docs)
    assert len(want) == 3 and sorted(map(tuple, lateral.collect())) == want and sorted(map(tuple, listed.collect())) == want
    assert "Python" not in lateral._jdf.queryExecution().executedPlan().toString()
    outer = spark.sql("SELECT i, c.entity_key FROM {docs} AS d LEFT JOIN LATERAL numeric_claims(d.text) AS c", docs=docs)
    assert outer.where("entity_key IS NULL").count() == len(TEXTS) - 1
