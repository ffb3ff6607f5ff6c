"""The shape of evidence from the listed words of a text is that of the patterns."""

from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators import resolve as R
from quillspark.operators import scoring as S
from quillspark.plans import corpora as C

TEXTS = ["", " ", "via x, via source: note:a not live", "No filing; no clear driver, unclear why! reason for the odd drop", "HTTPS://SEC.GOV/a http://x.org https://doi.org/1", "Optimistic_x optimism could may indicate as of é", "Reuters, reuters and S&P 500 on NASDAQ / OTC Markets $5 12 % 3 bps 4M", "data provided\tby FactSet, data  provided by no one", *C.PHRASES, *(p.upper() for p in C.PHRASES), "\n".join(C.PHRASES)]


def test_evidence_shape_from_words(spark):
    rows = spark.createDataFrame([(x, "") for x in (*TEXTS, None)], "text string, source_url string")
    t = F.col("text")
    of = {c: F.col(f"__f_{c}") for c in ("providers", "venues", "vocabulary", "listed", "ascii", "pairs", "lower")}
    light = R.evidence_shape(t, of["providers"], of["venues"], ascii=of["ascii"], low=of["lower"])
    rows = S.features(rows).select("text", R.evidence_shape(t, *of.values()).alias("e"), light.alias("light"))
    count = lambda name: F.regexp_count(t, F.lit(T.pattern(name)))
    plain = F.struct(count("missing").alias("missing"), count("interpretation").alias("interpretation"), t.rlike(T.pattern("caveat")).alias("caveat"), count("url").alias("links"), F.lower(t).rlike(L.jvm(L.PRIMARY_LINKS["shape"])).alias("primary"), T.found(t, "provider").alias("providers"), T.found(t, "venue").alias("venues"))
    for r in rows.withColumn("p", plain).collect():
        e, p = r["e"], r["p"]
        assert e == r["light"]
        receipts = "strong" if p["primary"] else "medium" if (p["links"] or 0) >= 2 else "weak" if p["links"] else "none"
        assert (e["unverified_claims_count"], e["interpretive_claims_count"], e["source_caveats_present"], e["primary_links_present"], e["external_receipts"], e["named_data_providers"], e["markets_venues_mentioned"]) == (p["missing"], p["interpretation"], p["caveat"], p["primary"], receipts, p["providers"], p["venues"]), r["text"]
