"""Genre, source type and custody of a document, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T

UNDECLARED = ("", "auto", "unknown")


def infer_type(text: Column, url: Column, host: Column | None = None, low: Column | None = None) -> Column:
    """From the host of the URL, then from cues in the text; the first hit wins. host: that of the URL, low: the text in lower case, where they are at hand; they are asked many times."""
    host, low = T.netloc(url) if host is None else host, F.lower(text) if low is None else low
    institutional = F.lit(False)
    for suffix in L.INSTITUTIONAL_SUFFIXES:
        institutional = institutional | host.endswith(suffix)
    out = F.when(T.any_of(host, L.SOCIAL_HOSTS), "social").when(institutional, "official").when(T.any_of(host, L.ACADEMIC_HOSTS), "primary")
    for kind, cues in L.TYPE_CUES:
        out = out.when(T.any_of(low, cues), kind)
    return out.otherwise("unknown")


def effective_type(text: Column, declared: Column, url: Column, inferred: Column | None = None) -> Column:
    """The declared type in lower case, or the inferred one where none is declared."""
    return F.when(F.lower(declared).isin(*UNDECLARED), infer_type(text, url) if inferred is None else inferred).otherwise(F.lower(declared))


def resolve(text: Column, declared: Column, url: Column, inferred: Column | None = None) -> Column:
    """struct(effective, declared, inferred, confidence) without a look at the genre."""
    declared = F.lower(declared)
    inferred = infer_type(text, url) if inferred is None else inferred
    open_ = declared.isin(*UNDECLARED)
    confidence = F.when(open_ & (inferred == "unknown"), 0.30).when(open_, 0.75).when((inferred == "unknown") | (inferred == declared), 0.90).otherwise(0.40)
    return F.struct(F.when(open_, inferred).otherwise(declared).alias("effective"), declared.alias("declared"), inferred.alias("inferred"), confidence.alias("confidence"))


def resolve_by_genre(resolved: Column, genre: Column) -> Column:
    """The same, and mismatch: whether an article's genre contradicts a declared type of high trust."""
    mismatch = resolved["declared"].isin(*L.HIGH_TRUST_TYPES) & genre.isin(*L.ARTICLE_GENRES)
    by_genre = T.lookup(genre, L.GENRE_TYPES, None)
    lifted = ~mismatch & resolved["declared"].isin(*UNDECLARED) & by_genre.isNotNull()
    effective = F.when(mismatch | lifted, by_genre).otherwise(resolved["effective"])
    confidence = F.when(mismatch, F.least(resolved["confidence"], F.lit(0.40))).when(lifted, F.greatest(resolved["confidence"], F.lit(0.70))).otherwise(resolved["confidence"])
    return F.struct(effective.alias("effective"), resolved["declared"].alias("declared"), resolved["inferred"].alias("inferred"), confidence.alias("confidence"), mismatch.alias("mismatch"))


def genre(normalized: Column, url: Column, vocabulary: Column | None = None, terms: Column | None = None, numbers: Column | None = None, known: Column | None = None, ascii: Column | None = None, pairs: Column | None = None, lower: Column | None = None) -> Column:
    """Decision list over URL and term counts of the normalised text; later counts are made only where needed.

    vocabulary, terms, numbers, known (T.listed), ascii, pairs (T.paired) and lower: those of the text, where they are at hand; terms and numbers decide several times.
    """
    if terms is None or numbers is None:
        counts = F.struct(T.count(normalized, "fin_terms").alias("terms"), T.count(normalized, "fin_numeric").alias("numbers"))
        return T.bound(counts, lambda c: genre(normalized, url, vocabulary, c["terms"], c["numbers"], known, ascii, pairs, lower))
    low = F.lower(url)
    n = lambda name: T.count(normalized, name, ascii) if vocabulary is None else T.count_in(normalized, vocabulary, name, known, ascii, pairs=pairs, low=lower)
    social = normalized.rlike(L.jvm(L.SOCIAL_HINTS, fold=True, multiline=True))
    if vocabulary is not None:
        social = (vocabulary.isNull() | T.any_of(normalized, ("#", "@")) | T.any_in(vocabulary, L.SOCIAL_WORDS)) & social
    finance = (terms >= 2) | (numbers >= 2)
    return (
        F.when(T.has(low, "regulatory_url"), "regulatory_filing")
        .when(T.any_of(low, L.RELEASE_URLS), "official_release")
        .when(n("press_release") >= 2, "official_release")
        .when(finance & (n("allocation") >= 3), "investment_strategy_commentary")
        .when(finance & (n("macro_indicators") >= 3) & (n("macro_regions") >= 2), "global_macro_market_update")
        .when((terms >= 4) & (numbers >= 3), "financial_market_snapshot")
        .when(T.any_of(low, L.NEWS_URLS), "news_article")
        .when(social, "social_post")
        .when(n("opinion_hints") > 0, "opinion_article")
        .otherwise("generic_article")
    )


def link_class(host: Column) -> Column:
    institutional = F.lit(False)
    for suffix in L.INSTITUTIONAL_SUFFIXES:
        institutional = institutional | host.endswith(suffix)
    return F.when(institutional, "institutional").when(T.any_of(host, L.ACADEMIC_HOSTS), "academic").when(T.any_of(host, L.SOCIAL_HOSTS), "social").otherwise("web")


def links(text: Column, ascii: Column | None = None) -> Column:
    """struct(institutional, academic, social, web, bonus) of the links in the text."""
    classes = F.when(F.contains(text, F.lit("http")), F.transform(F.transform(T.all_of(text, "url", ascii), T.netloc), link_class)).otherwise(F.array().cast("array<string>"))
    return T.bound(classes, _linked)


def _linked(classes: Column) -> Column:
    n = lambda kind: F.size(F.filter(classes, lambda c: c == kind))
    step = lambda a, c: a + F.when(c == "institutional", 0.04).when(c == "academic", 0.05).when(c == "social", -0.01).otherwise(0.015)
    bonus = T.clamp(F.aggregate(classes, F.lit(0.0), step), -0.10, 0.18)
    return F.struct(*(n(k).alias(k) for k in ("institutional", "academic", "social", "web")), bonus.alias("bonus"))


def custody_score(effective: Column, evidence_hits: Column, anonymous_hits: Column, quote_hits: Column, link_bonus: Column) -> Column:
    base = T.lookup(effective, L.CUSTODY_WEIGHTS, L.CUSTODY_WEIGHTS["unknown"])
    raw = base + F.least(evidence_hits * 0.035, F.lit(0.18)) + link_bonus + F.least(quote_hits * 0.02, F.lit(0.08)) - F.least(anonymous_hits * 0.07, F.lit(0.25))
    return T.clamp(raw)


def custody_warning(custody: Column, confidence: Column) -> Column:
    return F.when(confidence < 0.50, "mismatch").when(custody < 0.45, "weak").when(custody < 0.70, "watch").otherwise("clean")


def custody_breakdown(text: Column, effective: Column, confidence: Column, providers: Column, venues: Column, ascii: Column | None = None, low: Column | None = None) -> Column:
    """Custody of publisher, data and claims apart. ascii and low: those of the text, where they are at hand."""
    linked = (F.lower(text) if low is None else low).rlike(L.jvm(L.PRIMARY_LINKS["custody"]))
    named = F.size(providers) > 0
    claim = F.least(0.30 + T.count(text, "claim_attribution", ascii, low) * 0.07, F.lit(0.85))
    return F.struct(
        T.lookup(effective, L.PUBLISHER_WEIGHTS, 0.40).alias("publisher_custody"),
        F.when(linked, 0.85).when(named, 0.60).otherwise(0.30).alias("data_custody"),
        T.py_round(claim, 2).alias("claim_custody"),
        T.py_round(confidence, 2).alias("source_type_confidence"),
        linked.alias("primary_source_present"),
        linked.alias("primary_source_linked"),
        named.alias("data_source_named"),
        F.get(providers, F.lit(0)).alias("data_source_name"),
        providers.alias("named_data_providers"),
        venues.alias("markets_venues_mentioned"),
    )


def evidence_shape(text: Column, providers: Column, venues: Column, vocabulary: Column | None = None, known: Column | None = None, ascii: Column | None = None, pairs: Column | None = None, low: Column | None = None) -> Column:
    """Numbers, sources, links and hedges of a text. vocabulary, known (T.listed), ascii, pairs (T.paired) and low: those of the text, where they are at hand."""
    count = lambda name: T.count(text, name, ascii, low) if vocabulary is None else T.count_in(text, vocabulary, name, known, ascii, pairs=pairs, low=low)
    low = F.lower(text) if low is None else low
    without = ~F.contains(low, F.lit("http"))
    numbers = T.count(text, "numeric_anchor", ascii)
    linked = F.when(without, False).otherwise(low.rlike(L.jvm(L.PRIMARY_LINKS["shape"])))
    n_links = F.when(without, 0).otherwise(T.count(text, "url", ascii))
    return F.struct(
        F.when(numbers >= 10, "high").when(numbers >= 4, "medium").otherwise("low").alias("local_numeric_anchors"),
        T.unique_folded(F.concat(providers, venues)).alias("named_sources"),
        providers.alias("named_data_providers"),
        venues.alias("markets_venues_mentioned"),
        F.when(linked, "strong").when(n_links >= 2, "medium").when(n_links >= 1, "weak").otherwise("none").alias("external_receipts"),
        linked.alias("primary_links_present"),
        (count("caveat") > 0).alias("source_caveats_present"),
        count("missing").alias("unverified_claims_count"),
        count("interpretation").alias("interpretive_claims_count"),
    )
