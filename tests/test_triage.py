"""Documents of known shape and what their assessment must say; comparisons; pages; streams."""

import re
import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import render
from quillspark.operators import briefs as B
from quillspark.operators import claims as K
from quillspark.plans.triage import analyze
from quillspark.sources import pages as P
from quillspark.sources import readers
from quillspark.streaming.triage_stream import analyze_stream, spread_by_window

FILL = "The meeting went on for a while and people talked about roads, bread, trees and the weather of the season before they left again for home in the evening. "
DOCS = [
    ("hype", "social", "Act now! This shocking, explosive secret is a miracle. Everyone must watch before it's too late. Share this, hurry, last chance, wake up!"),
    ("clean", "primary", "The dataset covers 412 sites measured on 2024-03-05. The full report is at https://www.agency.gov/report and the methodology lists 36 trial sites. \"We checked every log file twice before release,\" said Ada Moreno. However, the sample size of 90 in one region was small, because two stations failed. The audit of 12 files found 3 percent errors. Therefore the confidence interval is 2.1 to 2.9. " + FILL),
    ("laundered", "primary", "The transcript, the filing, the invoice and the audit prove it. It is undeniable, proven and guaranteed. The dataset is clearly irrefutable. Everyone obviously knows the appendix settles it, no doubt. It is always so and never otherwise. The evidence is certainly there in the methodology and nobody disputes any of it at all in the whole country today."),
    ("attack", "unknown", "These idiots are vermin and traitors! They must be jailed now! The sheep and morons should be purged! Wake up, act now, everyone must watch this shocking bombshell! Final warning!"),
    ("short", "primary", "n=4 in the dataset of 2024-01-01, see https://a.gov/x."),
    ("strategy", "auto", "We remain cautious on equities and bonds. Our house view is overweight on shares and underweight on credit, with a tactical upgrade of the sector. The strategic allocation reflects high conviction, and earnings yield supports the portfolio. " + FILL),
    ("witness", "first_hand", "I saw it on 2024-02-03 at 10:30 near the bridge. I walked 3 miles with Jane Doe and we counted 12 cars. However, I could not see the far side, because it was dark. " + FILL),
    ("null", None, None),
]


@pytest.fixture(scope="module")
def assessed(spark):
    rows = analyze(spark.createDataFrame(DOCS, "name string, source_type string, text string")).collect()
    return {r.name: r.assessment for r in rows}


def test_shapes(assessed):
    a = assessed["hype"]
    assert a.scores.pressure >= 0.5 and a.scores.manipulation_risk >= 0.4 and a.scores.overall_confidence <= 0.3 and a.recommended_action in ("seek_receipts", "drop", "reject")
    assert any("pressure" in f.lower() for f in a.flags)
    a = assessed["clean"]
    assert a.recommended_action == "verify_primary" and a.custody_warning_level == "clean" and a.evidence_breakdown.anchored >= 3 and a.scores.overall_confidence >= 0.65
    a = assessed["laundered"]
    assert a.scores.certainty_bias >= 0.5 and a.scores.certainty_to_evidence_gap >= 0.2 and any("certainty" in f.lower() for f in a.flags)
    a = assessed["attack"]
    assert a.recommended_action == "reject" and a.scores.overall_confidence <= 0.3 and any("attack" in f.lower() for f in a.flags)
    assert assessed["short"].scores.overall_confidence <= 0.55 and any("short" in f.lower() for f in assessed["short"].flags)
    a = assessed["strategy"]
    assert a.source_genre == "investment_strategy_commentary" and any("house view" in f.lower() for f in a.flags) and a.signal_brief.investment_views
    assert assessed["witness"].scores.source_custody >= 0.6 and assessed["witness"].scores.pressure <= 0.15
    assert assessed["null"].word_count == 0 and assessed["null"].scores.internal_coherence == 0.5


def test_first_hand_custody_beats_anonymous(spark):
    rows = spark.createDataFrame([("first_hand", DOCS[6][2]), ("anonymous", DOCS[6][2])], "source_type string, text string")
    got = {r.source_type: r.assessment.scores.source_custody for r in analyze(rows, with_brief=False).collect()}
    assert got["first_hand"] > got["anonymous"]


def test_no_shuffle_and_no_python_in_the_plan(spark):
    plan = analyze(spark.createDataFrame(DOCS, "name string, source_type string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_renderings(spark):
    rows = analyze(spark.createDataFrame(DOCS, "name string, source_type string, text string"))
    a = F.col("assessment")
    for r in rows.select("name", render.report(a).alias("r"), render.capsule(a).alias("c"), render.plain_report(a, F.lit("id1")).alias("p"), render.envelope(a, F.lit("id1")).alias("e")).collect():
        assert "overall_confidence" in r.r and r.c.startswith(render.RULE) and "REQUEST ID: id1" in r.p
        body = json.loads(r.e)
        assert body["receipt_readiness_score"] == body["overall_confidence"] and body["capsule"].count("\n") >= 7


def test_values(spark):
    cases = {"4.61%": 4.61, "$68.43/bbl": 68.43, "4.25-4.75": 4.5, "5,894": 5894.0, "25bps": None, "14.3.": None, "+0.02%": 0.02, "1d": None, "12.5 per barrel": 12.5, "5894.": 5894.0, "4.25%-4.75%": None}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", K.parse_value(F.col("raw")).alias("v")).collect()
    assert {r.raw: r.v for r in rows} == cases


def test_compare(spark):
    docs = [
        (1, 0, "A", "10-Year Treasury Yield: 4.61%\nWTI Crude: $68.43/bbl\nS&P 500 reached 5,894"), (1, 1, None, "The 10-year Treasury 4.56% and so on.\nBrent crude: 70.1\nS&P 500 at 5,300"),
        (2, 0, "alone", "CPI: 3.1%"), (3, 0, "x", "nothing"), (3, 1, "y", ""),
    ]
    got = {r.group_id: r for r in K.compare(spark.createDataFrame(docs, "group_id int, doc_idx int, source_name string, text string")).collect()}
    one = got[1]
    assert [c.entity_key for c in one.alignment] == ["10yr-treasury-yield"] and [c.entity_key for c in one.conflicts] == ["sp500"]
    assert one.conflicts[0]["values"][1].source == "doc_2" and one.crude_note and len(one.follow_up_sources) == 3
    assert got[2].error and not got[2].conflicts and got[3].triage_summary.startswith("No shared")


def test_movers_and_mismatch(spark):
    text = "Acme Metals (ABC) at $2.50 (+12.5%). ABC again $3 +1%. OTC at $1 +2%. XYZ C$ 3.10 -4.0%"
    row = spark.createDataFrame([(text,)], "t string").select(F.transform(B.movers(F.col("t")), B.mover_line).alias("m")).first()
    assert row.m == ["ABC  $2.50  +12.5%  (Acme Metals)", "XYZ  C$3.10  -4.0%"] or row.m[0].startswith("ABC")
    row = spark.createDataFrame([("Indexes retreated early. S&P 500: +0.02%",)], "t string").select(B.timeframe_mismatch(F.col("t")).alias("m")).first()
    assert row.m


def test_pages(spark):
    words = "word " * 100
    pages = [
        (f"<html><head><title>Hi &amp; bye</title><meta name='author' content='Ann'></head><body><nav>menu items here</nav><article><p>{words}</p><p>HOME</p></article><p>outside</p></body></html>",),
        (f"<html><head><script type='application/ld+json'>{{\"@graph\":[{{\"publisher\":{{\"name\":\"Pub\"}}}}]}}</script></head><body><div class='x entry-content y'>{words}</div></body></html>",),
        ("<p>too short</p>",), (None,), (f"no markup {words}",),
    ]
    got = [r.page for r in P.clean(spark.createDataFrame(pages, "html string")).collect()]
    assert got[0].title == "Hi & bye" and got[0].author == "Ann" and got[0].text == words.strip()
    assert got[1].publisher == "Pub" and got[1].text == words.strip()
    assert got[2].error and got[3].error and got[4].text.startswith("no markup")


def test_validation(spark):
    rows = spark.createDataFrame([("",), ("a" * 13000,), ("fine",), (None,)], "text string")
    assert [r.status for r in readers.validate(rows).collect()] == ["bad_request", "text_too_long", "ok", "bad_request"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Act now! This is shocking.\nA plain line.\n")
    stream = analyze_stream(readers.text_stream(spark, str(tmp_path / "in")), with_brief=False).select("assessment.recommended_action")
    run = stream.writeStream.format("memory").queryName("triaged").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("triaged").count() == 2
    rows = spark.createDataFrame([("Gold: 10.0", "2024-01-01 10:00:00"), ("Gold: 10.5", "2024-01-01 11:00:00")], "text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert spread_by_window(rows).first().conflict


def test_command_line(spark, capsys, tmp_path):
    from quillspark.__main__ import main

    main(["--text", DOCS[0][2], "--type", "social", "--json"])
    assert json.loads(capsys.readouterr().out)["source_type"] == "social"
    (tmp_path / "a.txt").write_bytes("Plain text, \xff and more.".encode("latin-1"))
    main(["--file", str(tmp_path / "a.txt")])
    assert "TRIAGE REPORT" in capsys.readouterr().out
    main(["--demo"])
    assert capsys.readouterr().out.count("TRIAGE REPORT") == len(readers.EXAMPLES)
    main(["--schema"])
    assert json.loads(capsys.readouterr().out)["type"] == "struct"
    with pytest.raises(SystemExit):
        main(["--text", "  "])


def test_json_requests(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"text": "Hello there.", "source_type": "primary"}\nnot json\n')
    rows = readers.validate(readers.requests(spark, str(tmp_path / "r.json"))).collect()
    assert sorted(r.status for r in rows) == ["bad_request", "ok"]


def test_coherence_of_every_language(spark, tmp_path):
    import __spark_entry__ as entry

    texts = {1: "Le café était là. Les élèves étaient là hier soir encore. Oui.", 2: "Der Hund war da. Die Katze schlief. Über Nacht kam Regen because es kalt war.", 3: "été été été été été été été été été été été."}
    langs = {1: "fr", 2: "de", 3: None}
    spark.createDataFrame([(i, t, langs[i]) for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.coherence for r in entry.queries()["q_coherence_all"](spark, str(tmp_path)).collect()}

    def brute(t, connectives):
        words, sents = re.findall(r"\w+", t.lower()), [x for x in re.split(r"(?<=[.!?])\s+", t) if x]
        sizes = [len(x.split()) for x in sents]
        mean = sum(sizes) / len(sizes)
        spread = min((sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5 / max(mean, 1) / 0.5, 1) if len(sizes) >= 3 else 0.5
        return 0.45 * min(connectives / len(sents) / 0.25, 1) + 0.40 * min(max((len(set(words)) / len(words) - 0.25) / 0.40, 0), 1) + 0.15 * spread

    assert set(got) == set(texts)
    for i, n in ((1, 0), (2, 1), (3, 0)):
        assert abs(got[i] - brute(texts[i], n)) < 1e-9


def test_long_documents(spark):
    """Claims, movers and places of one text follow its length."""
    import time

    from quillspark.operators import briefs, claims
    from quillspark.functions import text as T

    lines = "".join(f"CPI: {i % 5000}.5%\nFoo (AB{chr(65 + i % 26)}) at $5.00 (+1.0%) up.\n" for i in range(10_000))
    rows = spark.createDataFrame([("g", 0, lines), ("g", 1, "CPI: 3%\nCPI: 3%\nAAA at $5.00 +1.0%\nAAA at $6.00 +2.0%")], "group_id string, doc_idx int, text string")
    began = time.time()
    assert {r.doc_idx: r.n for r in claims.claims(rows, ["group_id", "doc_idx"]).where("entity_key = 'cpi'").groupBy("doc_idx").agg(F.count("*").alias("n")).collect()} == {0: 5000, 1: 1}
    got = {r.doc_idx: r.m for r in rows.select("doc_idx", briefs.movers(F.col("text")).alias("m")).collect()}
    assert [m.ticker for m in got[0]] == [f"AB{chr(65 + i)}" for i in range(26)] and [(m.ticker, m.price) for m in got[1]] == [("AAA", "$5.00")]
    assert got[0][0].company == "Foo"
    marks = spark.createDataFrame([("the audit of 5 files. " * 20_000,)], "text string").select(F.size(T.snippets(F.col("text"), "evidence", None)).alias("n"), T.attribution(F.col("text"))).first()
    assert marks.n == 20_000 and time.time() - began < 120


def test_own_columns_pass_through(spark):
    from quillspark.plans.triage import analyze

    rows = spark.createDataFrame([("Numbers rose.", 1, "x", 2.0, True, 7)], "text string, f int, r string, s double, d boolean, c int")
    got = analyze(rows).first()
    assert (got.f, got.r, got.s, got.d, got.c) == (1, "x", 2.0, True, 7) and got.assessment.word_count == 2


def test_decisions_are_all_reached(spark):
    """Every verdict, genre, flag, status and both values of each condition occur in queries that have SQL."""
    import __spark_entry__ as entry
    from quillspark.operators import scoring as S

    sf = "/root/testdata/sf0.001"
    rows = entry.queries()["q_case_decisions"](spark, sf).collect()
    assert {r.verdict for r in rows} == set(S.VERDICTS) and {r.non_english for r in rows} == {True, False}
    assert len({r.genre for r in rows}) == 9
    flags = {f for r in rows for f in r.flags.split(",") if f}
    flags |= {f for r in entry.queries()["q_flags"](spark, sf).collect() for f in r["flags"].split(",") if f} if "q_flags" in entry.queries() else set()
    assert flags == set(S.FLAGS) - {"language"}
    assert {r.status for r in entry.queries()["q_cross_entities"](spark, sf).collect()} == {"unique", "shared", "conflict", "alignment"}
    assert {r.status for r in entry.queries()["q_cross_validate"](spark, sf).collect()} == {"ok", "too_few", "too_many", "bad_request"}
    assert {r.mismatch for r in entry.queries()["q_case_timeframe"](spark, sf).collect()} == {True, False}
