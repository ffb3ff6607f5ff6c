"""Scores, confidence band and decisions of a document, as columns over the features.

Everything is a column of one row, so a corpus is scored in the pass that reads it, without a shuffle.
Thresholds see unrounded values; rounding happens when the assessment is assembled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.operators import resolve as R

COUNTED = ("certainty", "hedges", "hype", "urgency", "specificity", "logic", "bias", "attack", "filler", "evidence", "anonymous")

#: code: sentence. The codes, in this order, are the flags of a document.
FLAGS = {
    "weak_custody": "Source custody is weak; use this as a lead only.",
    "certainty_bias": "Certainty bias: the wording is surer than the support shown.",
    "high_pressure": "Strong pressure in the wording: hype, panic or a sales pitch may be at work.",
    "strong_low_evidence": "Firm claims with hardly any evidence terms; ask for the receipts.",
    "unanchored": "Evidence terms stand without a number, link or name close by.",
    "incentive": "Incentive or bias wording; look at who gains.",
    "attack": "Attack or dehumanising wording; this may be bait rather than analysis.",
    "short": "Short text; there is little context and confidence is capped.",
    "table_heavy": "Table-heavy market text; coherence says little here, read the evidence shape and the brief.",
    "low_coherence": "Coherence is low; the argument repeats itself or does not connect.",
    "house_view": "House view: positions of an asset manager, not independent primary data.",
    "forward_looking": "Forward-looking allocation claims are convictions and no receipts.",
    "language": "The text does not look English; the word lists are English, so scores stay conservative.",
    "contradicted": "The declared source type contradicts the inferred one; custody rests on low confidence.",
    "downgraded": "A declared type of high trust conflicts with cues of an article; the effective type was lowered.",
}
VERDICTS = {
    "attack_pressure": ("reject", "attack wording under pressure; not evidence"),
    "manipulative": ("drop", "much pressure and little trust; do not pass on without receipts"),
    "usable": ("verify_primary", "usable signal; check key claims at the primary source"),
    "mixed": ("treat_as_lead", "mixed signal; read, verify, and keep facts and framing apart"),
    "outpaced": ("seek_receipts", "claims run ahead of their support; ask for receipts"),
    "weak": ("treat_as_lead", "weak custody or a noisy frame; a lead and no evidence"),
    "secondary_market": ("treat_as_lead", "secondary market source; a lead, to be checked at the primary data"),
}
QUESTIONS = {
    "primary": "Which primary source lies closest to the main claim?",
    "beneficiary": "Who gains if this framing is believed?",
    "falsifier": "What would change my mind if the claim were wrong?",
    "kinds": "Which claims are observed, which are interpretation, and which speculation?",
    "certainty": "Why is the author so sure, and which uncertainty is missing?",
    "trace": "Does this lead back to a named witness, document, data set or recording?",
    "emotion": "Which emotion is this meant to raise before it is examined?",
    "anchors": "Which of the evidence terms have a number, link or name behind them?",
    "profit": "Who profits if this framing spreads?",
    "strip": "Without the attack wording, does the argument still stand?",
    "quotes": "Who said the quoted words, when, and on what record?",
}
CUSTODY_PHRASES = {"weak": "Weak custody", "mismatch": "Source type mismatch", "watch": "Middling custody", "clean": "Solid custody"}
IMPERATIVES = {
    "verify_primary": "Usable; check key claims at the primary source.",
    "treat_as_lead": "A lead only; do not pass on as evidence.",
    "seek_receipts": "Ask for receipts before trusting it.",
    "drop": "Do not pass on without independent verification.",
    "reject": "Reject as evidence.",
}
CUSTODY_LABELS = {
    "first_hand": "first hand: direct witness", "primary": "primary: raw record or research", "regulatory_filing": "regulatory filing: compliance record",
    "official": "official: statement of an institution", "official_release": "official release: statement of a company or institution", "expert": "expert: named interpretation",
    "secondary": "secondary: reporting or analysis", "secondary_market_article": "secondary market article: no raw data", "news_article": "news article: secondary reporting",
    "tertiary": "tertiary: summary of summaries", "anonymous": "anonymous: weak custody", "social": "social: high drift", "social_post": "social post: high drift",
    "opinion": "opinion: argument, no evidence", "opinion_article": "opinion article: argument, no evidence", "unknown": "unknown: custody not established",
}
NOTE = "Heuristic triage only; the verdict is no truth. Go to primary sources, keep observation and interpretation apart, and prefer the confidence band to the single value."


def document(df: DataFrame) -> DataFrame:
    """df with the columns that scoring reads: nulls filled, missing metadata added."""
    have = set(df.columns)
    fill = {"text": "", "source_type": "auto", "source_name": "unknown", "source_url": ""}
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in have else F.lit(v) for c, v in fill.items()})


def put(df: DataFrame, prefix: str, **columns: Column) -> DataFrame:
    """df with columns __prefix_name: flat ones, since the optimizer repeats the fields of a struct at every mention."""
    return df.withColumns({f"__{prefix}_{k}": v for k, v in columns.items()})


def _of(prefix: str):
    return lambda name: F.col(f"__{prefix}_{name}")


_f, _r, _s, _d = map(_of, "frsd")


def features(df: DataFrame) -> DataFrame:
    """df (as document() gives it) with columns __f_*: text forms, counts and sub-scores that need the text."""
    text, ascii = F.col("text"), _f("ascii")
    df = put(df, "f", ascii=T.is_ascii(text))
    df = put(df, "f", tidy=T.tidy(text, ascii))
    df = put(df, "f", normalized=T.normalize(text, _f("tidy")), sentences=T.sentences(text, _f("tidy")), single=_f("tidy") & ~F.contains(text, F.lit("  ")))
    df = put(df, "f", words=T.plain_words(text, ascii), lower=F.lower(text), normal_low=F.lower(_f("normalized")), url=F.lower(F.col("source_url")), host=T.netloc(F.col("source_url")))
    df = put(df, "f", low=F.coalesce(_f("words"), F.transform(T.words(_f("normalized")), F.lower)), listed=T.listed(text, _f("words")), pairs=T.paired(_f("words")))
    df = put(df, "f", vocabulary=T.vocabulary(text, _f("listed")))
    known, listed, pairs = _f("vocabulary"), _f("listed"), _f("pairs")
    count = lambda name: T.count_in(text, known, name, listed, ascii, pairs=pairs, low=_f("lower"))
    normal = T.is_ascii(_f("normalized"))
    # evidence is marked once, for its number and for what stands around it
    df = put(df, "f", marked=F.when(T.may_occur(known, "evidence") & ~T.holds_mark(text), T.marked(text, "evidence", ascii)))
    df = put(df, "f", n_evidence=F.when(_f("marked").isNotNull(), T.n_marked(_f("marked"))).otherwise(count("evidence")), n_fin_terms=T.count_in(_f("normalized"), known, "fin_terms", listed, normal, pairs=pairs, low=_f("normal_low")), n_fin_numeric=T.count(_f("normalized"), "fin_numeric", normal), n_quotes=F.when(T.any_of(text, T.QUOTES), T.count(text, "quote", ascii)).otherwise(0))
    near = F.size(F.filter(T.windows(text, "evidence", 80, ascii=ascii, parts=_f("marked")), lambda w: T.has(w, "spec_window")))
    df = put(
        df, "f", n_sentences=F.greatest(F.size(_f("sentences")), F.lit(1)), **{f"n_{k}": count(k) for k in COUNTED if k != "evidence"},
        n_exclaims=T.exclaims(text), anchored=F.when(_f("n_evidence") > 0, near).otherwise(0), shouting=T.shouting(text, ascii), attribution=T.attribution(text, _f("n_quotes"), ascii), non_english=T.looks_non_english(text, ascii),
        sponsored=F.contains(_f("lower"), F.lit("sponsored")), links=R.links(text, ascii), genre=R.genre(_f("normalized"), _f("url"), known, _f("n_fin_terms"), _f("n_fin_numeric"), listed, normal, pairs, _f("normal_low")),
        providers=T.found(text, "provider", known, ascii), venues=T.found(text, "venue", known, ascii),
    )
    return put(df, "f", n_words=F.size(_f("low")), unanchored=_f("n_evidence") - _f("anchored"), coherence=T.coherence(_f("low"), _f("sentences"), _f("low"), known, listed, ascii, pairs, _f("single")), link_bonus=_f("links")["bonus"])


def resolved(df: DataFrame) -> DataFrame:
    """df with features, with columns __r_*: effective, declared and inferred type, confidence, mismatch."""
    df = put(df, "r", inferred=R.infer_type(F.col("text"), F.col("source_url"), _f("host"), _f("lower")))
    plain = R.resolve(F.col("text"), F.col("source_type"), F.col("source_url"), _r("inferred"))
    by_genre = R.resolve_by_genre(plain, _f("genre"))
    return put(df, "r", **{k: by_genre[k] for k in ("effective", "declared", "confidence", "mismatch")})


def scores(df: DataFrame) -> DataFrame:
    """df with features and resolution, with columns __s_*: unrounded scores."""
    f, s, per = _f, _s, lambda n: _f(n) / _f("n_sentences")
    known = R.effective_type(F.col("text"), _r("effective"), F.col("source_url"), _r("inferred"))
    df = put(df, "s", label_type=known)
    df = put(
        df, "s", custody_raw=R.custody_score(s("label_type"), f("n_evidence"), f("n_anonymous"), f("n_quotes"), f("link_bonus")),
        specificity=T.clamp(per("n_specificity") * 0.9), evidence=T.clamp((f("anchored") + f("unanchored") * 0.3) / f("n_sentences")), logic=T.clamp(per("n_logic") * 0.8),
        filler=per("n_filler") * F.when(_r("effective").isin("first_hand", "social"), 0.15).otherwise(0.25),
        pressure=T.clamp(per("n_hype") * 1.2 + per("n_urgency") * 1.5 + per("n_certainty") * 0.5 + per("n_exclaims") * 0.4 + f("shouting") * 0.6 + per("n_attack") * 0.9),
        bias_risk=T.clamp(f("n_bias") * 0.07 + f("n_attack") * 0.05 + F.when(f("sponsored"), 0.12).otherwise(0.0)),
    )
    df = put(df, "s", custody=s("custody_raw") * (0.65 + 0.35 * _r("confidence")))
    df = put(
        df, "s", signal=T.clamp(0.25 + s("specificity") * 0.25 + s("evidence") * 0.25 + s("logic") * 0.15 + s("custody") * 0.20 + f("attribution") * 0.05),
        certainty_bias=T.clamp(per("n_certainty") * 1.3 - per("n_hedges") * 0.5 + F.greatest(F.lit(0.0), 0.55 - s("custody")) * 0.4 + F.greatest(F.lit(0.0), 0.40 - s("evidence")) * 0.3),
    )
    df = put(df, "s", manipulation_risk=T.clamp(s("pressure") * 0.48 + s("certainty_bias") * 0.32 + s("bias_risk") * 0.20))
    overall = T.clamp(s("signal") * 0.40 + s("custody") * 0.35 + s("evidence") * 0.15 + f("attribution") * 0.05 - s("manipulation_risk") * 0.30 - s("certainty_bias") * 0.15)
    cap = F.least(F.when((s("pressure") >= 0.65) | (f("n_attack") >= 1), 0.40).otherwise(1.0), F.when(f("n_attack") >= 2, 0.25).otherwise(1.0), F.when(f("n_words") < 50, 0.55).otherwise(1.0))
    noise = T.clamp(0.18 + s("filler") + s("pressure") * 0.32 + (1.0 - s("signal")) * 0.30)
    df = put(df, "s", overall=F.least(overall, cap), noise=noise, gap=s("certainty_bias") - s("evidence"), width=0.10 + (s("manipulation_risk") + s("certainty_bias")) * 0.12, coherence_raw=f("coherence"), coherence=T.py_round(f("coherence"), 3))
    return put(df, "s", low=T.clamp(s("overall") - s("width")), high=T.clamp(s("overall") + s("width") * 0.4), warning=R.custody_warning(s("custody"), _r("confidence")))


def _chosen(conditions: dict[str, Column]) -> Column:
    """The codes whose conditions hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in conditions.items())), lambda x: x.isNotNull())


def worded(codes: Column, texts: dict[str, str]) -> Column:
    return F.transform(codes, lambda c: T.lookup(c, texts, None))


def decisions(df: DataFrame) -> DataFrame:
    """df with scores, with columns __d_*: codes of flags, verdict, action, codes of questions, triage sentence."""
    f, s, r = _f, _s, _r
    loose = f("unanchored") > f("anchored")
    incoherent = (s("coherence") < 0.30) & (f("n_words") >= 50)
    tables = f("genre").isin("financial_market_snapshot", "global_macro_market_update")
    strategy = f("genre") == "investment_strategy_commentary"
    flags = _chosen({
        "weak_custody": s("custody") < 0.45, "certainty_bias": s("certainty_bias") > 0.55, "high_pressure": s("pressure") > 0.55,
        "strong_low_evidence": (s("evidence") < 0.20) & (f("n_certainty") >= 2), "unanchored": loose & (f("n_evidence") >= 2),
        "incentive": s("bias_risk") > 0.35, "attack": f("n_attack") > 0, "short": f("n_words") < 50,
        "table_heavy": incoherent & tables, "low_coherence": incoherent & ~tables, "house_view": strategy, "forward_looking": strategy,
        "language": f("non_english"), "contradicted": (r("confidence") < 0.50) & ~r("declared").isin(*R.UNDECLARED) & ~r("mismatch"), "downgraded": r("mismatch"),
    })
    verdict = (
        F.when((f("n_attack") >= 1) & (s("pressure") >= 0.55), "attack_pressure")
        .when(s("manipulation_risk") >= 0.65, "manipulative")
        .when((s("overall") >= 0.70) & (s("custody") >= 0.70) & (s("manipulation_risk") < 0.35), F.when(f("genre").isin(*L.FINANCE_GENRES) & r("effective").isin(*L.SECONDARY_TYPES), "secondary_market").otherwise("usable"))
        .when(s("overall") >= 0.50, "mixed")
        .when((s("certainty_bias") >= 0.50) | loose, "outpaced")
        .otherwise("weak")
    )
    yes = F.lit(True)
    questions = _chosen({
        "primary": yes, "beneficiary": yes, "falsifier": yes, "kinds": yes, "certainty": s("certainty_bias") > 0.45, "trace": s("custody") < 0.50,
        "emotion": s("pressure") > 0.50, "anchors": loose & (f("n_evidence") > 0), "profit": s("bias_risk") > 0.35, "strip": f("n_attack") > 0,
        "quotes": (f("attribution") < 0.5) & (f("n_quotes") >= 1),
    })
    df = put(df, "d", flags=flags, verdict=verdict, questions=questions)
    df = put(df, "d", action=T.lookup(_d("verdict"), {k: a for k, (a, _) in VERDICTS.items()}, None))
    parts = F.array(
        T.lookup(s("warning"), CUSTODY_PHRASES, None), F.when(f("n_attack") >= 1, "attack wording"), F.when(s("pressure") >= 0.55, "high pressure"),
        F.when(s("certainty_bias") >= 0.55, "high certainty bias"), F.when(loose & (f("unanchored") >= 2), "unanchored evidence terms"),
    )
    triage = F.concat(F.array_join(parts, " + "), F.lit(". "), T.lookup(_d("action"), IMPERATIVES, ""))
    return put(df, "d", triage=triage)


def clues(df: DataFrame) -> DataFrame:
    """df as scored() gives it, with a struct column c: windows and counts for people to look at."""
    text, n = F.col("text"), lambda c: F.col(c).cast("string")
    counted = {"evidence markers": "f.n_evidence", "anonymous or rumor markers": "f.n_anonymous", "long quotes": "f.n_quotes", "institutional links": "f.links.institutional", "academic links": "f.links.academic", "social links": "f.links.social", "other links": "f.links.web"}
    lines = F.filter(F.array(*(F.when(F.col(c) > 0, F.concat(F.lit(f"{k}: "), n(c))) for k, c in counted.items())), lambda x: x.isNotNull())
    ascii = F.col("f.ascii")
    evidence = F.concat(T.snippets(text, "evidence", 5, 80, ascii, F.col("f.marked"), F.col("f.n_evidence")), lines)
    pressure = F.concat(*(T.snippets(text, k, 3, ascii=ascii, n=F.col(f"f.n_{k}")) for k in ("hype", "urgency", "certainty")))
    return df.withColumn("c", F.struct(evidence.alias("evidence_clues"), pressure.alias("pressure_clues")))
