"""Word lists, patterns, weights and tables, as data.

Fixed values: results depend on every entry and on the order of alternatives, so they are stated as they
are. ``whole(...)`` wraps alternatives in word boundaries; ``jvm`` adds the flags that make Java's classes,
boundaries and case folding cover Unicode; the bare pattern serves other engines.
"""

from __future__ import annotations

import re
from re import _parser


_FIRSTS: dict[str, str] = {}
_TERMS: dict[str, tuple[str, ...]] = {}


def whole(*terms: str) -> str:
    pattern = r"\b(?:" + "|".join(terms) + r")\b"
    _TERMS[pattern] = terms
    firsts = {t[0] for t in terms}
    # what is no plain character at a term's start may stand for others
    _FIRSTS[pattern] = "".join(sorted(firsts)) if all(c.isalnum() for c in firsts) else ""
    return pattern


def initials(pattern: str) -> str:
    """The characters that a list made by whole() can start with; empty if one of them isn't plain, and for other patterns."""
    return _FIRSTS.get(pattern, "")


def guarded(pattern: str, fold: bool) -> str:
    """The pattern behind a look at the first character, so that Java tries the alternatives at few places only."""
    first = initials(pattern)
    first = "".join(sorted(set(first.lower()))) if fold else first
    return f"(?=[{first}]){pattern}" if first else pattern


def lowered(pattern: str) -> str:
    """The pattern in lower case, but for its escapes: on ASCII texts in lower case it has the matches that it has on them where case is ignored."""
    return re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)


def by_initials(pattern: str) -> str:
    """lowered(), of a list made by whole() with its terms put together by their first character, so that Java tries a few of them at each place.

    Terms with other first characters have no match at the same place, so those of one character keep their order.
    """
    if not initials(pattern):
        return lowered(pattern)
    rests: dict[str, list[str]] = {}
    for term in map(lowered, _TERMS[pattern]):
        rests.setdefault(term if term[1:2] in ("?", "*", "+", "{") else term[0], []).append(term)
    parts = [k if len(k) > 1 else k + (v[0][1:] if len(v) == 1 else f"(?:{'|'.join(t[1:] for t in v)})") for k, v in rests.items()]
    return f"(?=[{''.join(sorted(set(initials(pattern).lower())))}])\\b(?:{'|'.join(parts)})\\b"


_UNKNOWN = {"\0"}
#: Phrases up to which a list's are looked for; beyond, one word of each is.
_MOST_PHRASES = 30


def _one(op, arg) -> set[str]:
    """What one element of a parsed pattern matches: ASCII letters and digits as they are, " " for others, a zero for any run."""
    name = str(op)
    if name == "LITERAL":
        c = chr(arg).lower()
        return {c if c.isascii() and c.isalnum() else " "}
    if name == "IN":
        parts = [_one(o, a) if str(o) == "LITERAL" else {" "} if (str(o), str(a)) == ("CATEGORY", "CATEGORY_SPACE") else _UNKNOWN for o, a in arg]
        return _UNKNOWN if _UNKNOWN in parts else set().union(*parts)
    if name == "ANY":
        return {" ", *"abcdefghijklmnopqrstuvwxyz0123456789"}
    if name == "BRANCH":
        return set().union(*map(_ways, arg[1]))
    if name == "SUBPATTERN":
        return _ways(arg[-1])
    if name == "MAX_REPEAT":
        low, high, seq = arg
        ways = _ways(seq)
        once = ways if int(high) == 1 or ways == {" "} else _UNKNOWN
        return once | ({""} if low == 0 else set())
    return {""} if name == "AT" else _UNKNOWN


def _ways(seq) -> set[str]:
    out = {""}
    for op, arg in seq:
        out = {a + b for a in out for b in _one(op, arg)}
    return out


def needed_words(pattern: str) -> tuple[str, ...] | None:
    """ASCII words in lower case, one of which stands by itself in every match of a list made by whole(); None if there are none such.

    A match lies between word boundaries; of each form of it the longest word counts, for it is rarest.
    """
    if pattern not in _FIRSTS:
        return None
    forms = [[w for w in form.split(" ") if w and "\0" not in w] for form in _ways(_parser.parse(pattern))]
    return tuple(sorted({min(words, key=lambda w: (-len(w), w)) for words in forms})) if all(forms) else None


def single_words(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """The terms of a list made by whole() that are one ASCII word, in lower case, and words of which one is in each match of any other; None if there are none such."""
    if needed_words(pattern) is None:
        return None
    forms = _ways(_parser.parse(pattern))
    single = {f for f in forms if " " not in f and "\0" not in f}
    others = [[w for w in f.split(" ") if w and "\0" not in w] for f in forms - single]
    return tuple(sorted(single)), tuple(sorted({min(words, key=lambda w: (-len(w), w)) for words in others}))


def phrases(pattern: str) -> tuple[str, ...]:
    """Runs of words with a blank around each, one of which is among the words of each match of a term of single_words() that is no single word."""
    out = set()
    for form in _ways(_parser.parse(pattern)):
        words = [w for w in form.split(" ") if w and "\0" not in w]
        if "\0" in form:  # what stands for it may be any number of words
            words = [min(words, key=lambda w: (-len(w), w))]
        if " " in form or "\0" in form:
            out.add(f" {' '.join(words)} ")
    return tuple(sorted(out)) if len(out) <= _MOST_PHRASES else tuple(f" {w} " for w in single_words(pattern)[1])


def word_pairs(pattern: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Two neighbouring words of each term of single_words() that is no single word; and a word of those that have no two such."""
    pairs, lone = set(), set()
    for form in _ways(_parser.parse(pattern)):
        if " " in form or "\0" in form:
            words = [w for w in form.split(" ") if w]
            near = [f"{a} {b}" for a, b in zip(words, words[1:]) if "\0" not in a + b]
            known = [w for w in words if "\0" not in w]
            (pairs if near else lone).add(min(near or known, key=lambda w: (-len(w), w)))
    return tuple(sorted(pairs)), tuple(sorted(lone))


def several_words(pattern: str) -> str | None:
    """by_initials() of the terms of a list that are several words, where these never share a word with those that are one word.

    Then no match of a term of one kind can be in the way of one of the other, and the two are counted apart. None where
    that is open: a term may be one word or more, or has a part that may be any word, or words are shared.
    """
    if single_words(pattern) is None or not initials(pattern):
        return None
    forms = {t: _ways(_parser.parse(t)) for t in _TERMS[pattern]}
    several = [t for t, ways in forms.items() if any(" " in f or "\0" in f for f in ways)]
    plain = [f for t in several for f in forms[t]]
    if not several or not all(" " in f and "\0" not in f for f in plain) or {w for f in plain for w in f.split(" ")} & set(single_words(pattern)[0]):
        return None
    return by_initials(whole(*several))


def jvm(pattern: str, fold: bool = False, multiline: bool = False) -> str:
    return f"(?U{'i' * fold}{'m' * multiline}){pattern}"


# Scorer lists; all but SPECIFICITY, SPEC_WINDOW, QUOTE and NAME ignore case.
FOLDED = {
    "certainty": whole("always", "never", "everyone", "no one", "undeniable", "irrefutable", "proven", "proves", "proof", "definitely", "certainly", "clearly", "obviously", "guaranteed", "without doubt", "no doubt", "settled science", "the science is settled", "impossible", "cannot be wrong", "100%", "zero chance"),
    "hedges": whole("may", "might", "could", "appears", "seems", "suggests", "indicates", "roughly", "approximately", "preliminary", "uncertain", "unresolved", "likely", "unlikely", "plausible", "possible", "limited evidence", "early evidence", "according to", "we do not know", "not enough data"),
    "hype": whole("breakthrough", "revolutionary", "game[- ]changing", "groundbreaking", "shocking", "miracle", "secret", "one weird trick", "they don't want you to know", "exclusive", "mind[- ]blowing", "incredible", "unbelievable", "explosive", "bombshell", "wake up", "mainstream media won't tell you", "experts hate", "hidden truth"),
    "urgency": whole("act now", "hurry", "limited time", "before it'?s too late", "share this", "must watch", "must read", "do your own research", "open your eyes", "don't wait", "they are coming", "final warning", "last chance", "gets deleted", "banned"),
    "evidence": whole("dataset", "raw data", "methodology", "sample size", r"n\s*=", "confidence interval", "p[- ]value", "appendix", "supplementary", "replication", "trial", "control group", "filing", "court record", "transcript", "audit", "minutes", "invoice", "receipt", "photo metadata", "source code", "commit", "log file", "primary source", "full report", "downloaded data", "direct quote", "interview transcript", "official record", "SEC", "10-Q", "EDGAR", "limitations section"),
    "logic": whole("because", "therefore", "however", "although", "unless", "if", "then", "so that", "whereas", "compared with", "relative to", "caused by", "correlated with", "mechanism", "tradeoff", "limitation", "counterpoint", "alternative explanation", "alternative explanations", "bias", "excluded", "though"),
    "bias": whole("our product", "our platform", "investors?", "shareholders?", "sponsored", "affiliate", "paid partnership", "press release", "partnered with", "we are excited", "political action", "donate", "subscribe", "buy now", "use code", "limited offer", "my course", "my newsletter", "my book", "my token", "financial interest"),
    "attack": whole("idiots?", "morons?", "traitors?", "evil", "degenerates?", "sheep", "NPCs?", "cultists?", "shills?", r"enem(?:y|ies)\s+of", "vermin", "parasites?", "subhuman", r"destroy(?:ed|ing|s)?\s+(?:them|the country)", r"lock(?:ed)?\s+(?:them|him|her|people|those|us)\s*up", r"must\s+be\s+(?:jailed|imprisoned|locked\s+up|purged|removed|eradicated)", r"should\s+be\s+(?:jailed|imprisoned|locked\s+up|purged)", "purged?", "eradicated?", "exterminated?"),
    "connectives": whole("therefore", "because", "however", "although", "despite", "since", "thus", "consequently", "furthermore", "moreover", "nevertheless", "whereas", "as a result", "in contrast", "for this reason", "by contrast", "given that", "it follows that", "on the other hand", "in turn", "this means", "which means"),
    "filler": whole("very", "really", "basically", "actually", "literally", "sort of", "kind of", "at the end of the day", "needless to say", "it is important to note", "as everyone knows", "of course", "trust me"),
    "attribution_verb": whole("said", "told", "stated", "wrote", "noted", "reported", "added", "explained", "argued", "asked", "replied", "warned", "testified", "confirmed", "denied", "tweeted", "posted"),
    "anonymous": whole("anonymous", "unnamed", "source familiar", "people are saying", "rumor"),
    # genre lists
    "fin_terms": whole("ticker", "tickers", "shares?", "stocks?", "ETFs?", "NASDAQ", "NYSE", "TSX", "CSE", "OTC", "previous close", "market session", "basis points", "trading volume", "IPO", "market cap", "breadth", "rally", "sell.?off", "earnings", "revenue", "dividend", "yield", "hedge fund", "futures", "options", "portfolio", "short interest", "float", "sector", "equit(?:y|ies)", "index", "indices"),
    "press_release": whole("FOR IMMEDIATE RELEASE", "press release", "we are pleased to (?:announce|report|inform)", "the company (?:announces|is pleased)", r"(?:NASDAQ|NYSE|TSX|CSE):\s*[A-Z]+", "forward.?looking statements?", "safe harbor", "for more information.{0,40}(?:contact|visit)"),
    "macro_indicators": whole("CPI", "PPI", "PCE", "PMI", "GDP", "GNP", "inflation", "deflation", "jobless claims", "unemployment rate?", "labor market", "employment data", "retail sales", "consumer spending", "consumer confidence", "trade balance", "trade surplus", "trade deficit", "current account", "monetary policy", "yield curve", "fiscal policy", "budget deficit", "sovereign debt", "industrial production", "manufacturing output"),
    "macro_regions": whole("Europe", "European", "Eurozone", r"euro\s*zone", "ECB", "Japan(?:ese)?", "BoJ", r"Bank\s+of\s+Japan", "Nikkei", "China", "Chinese", "PBOC", r"emerging\s+markets?", r"EM\b", "UK", "Britain", "British", r"Bank\s+of\s+England", "BoE", "FTSE", "Canada", r"Bank\s+of\s+Canada", "Asia(?:n)?", "Asia[- ]Pacific", "APAC", r"global\s+markets?", r"international\s+markets?"),
    "allocation": whole("overweight", "underweight", r"neutral\s+weight", "upgrad(?:e|es|ed|ing)", "downgrad(?:e|es|ed|ing)", "tactical(?:ly)?", "strategic(?:ally)?", "allocat(?:e|ion|ions|ed|ing)", r"portfolio\s+weight", r"house\s+view", r"asset\s+class(?:es)?", "risk[- ]on", "risk[- ]off", "conviction", "rebalanc(?:e|ing)", "positioning"),
    "forward_looking": whole(r"we\s+(?:expect|believe|project|forecast|anticipate|prefer)", r"our\s+(?:view|outlook|expectation|target|forecast)", "projected?", "forecastin?g?", r"expected?\s+to", r"in\s+our\s+(?:view|opinion|assessment)", r"we\s+(?:are\s+positioning|remain\s+(?:cautious|constructive|bullish|bearish))", r"medium[- ]term\s+(?:view|outlook)", r"12[- ]month\s+(?:view|target|return)"),
    "statement_verb": whole("said", "stated", "noted", "told", "wrote", "added", "confirmed", "indicated", "announced", "signaled"),
    "opinion_hints": whole("in my (?:view|opinion)", "i (?:believe|think|argue|contend)", "my take", "the (?:real|true|actual) (?:issue|problem|story)", "what (?:nobody|everyone)", "we should", "they should", "the fact is", "let me be clear", "make no mistake", "in my judgment"),
    # sentence cues
    "interpretation": whole("tone", "constructive", "cautious", "investors? appear", "suggests?", "signals?", "could", "may indicate", "likely", "pressure", "momentum", r"optimis\w*", "sentiment", "poised", "positioned", "seems", "appears? to", "heading", "trending", "outperform", "underperform", "bullish", "bearish"),
    "caveat": whole("reflects? prior", "not live", "as of", "OTC price", "prior (?:close|trading)", "no filing", "no announcement", "data provided by", "source:", r"via\s", "caveat", "note:", "disclaimer", "subject to change", "may be delayed", "estimated", "approximate", "for informational purposes"),
    "missing": whole("no filing", "no announcement", "cause is unknown", "no (?:clear )?driver", "not identified", "unconfirmed", "unverified", "cannot confirm", "unclear why", r"reason for the \w+ (?:move|drop|jump|spike|decline|rally)"),
    "breadth": r"\b\d+\s*(?:stocks?|tickers?|names?|issues?)?\s*(?:up|down|advanc\w*|declin\w*|flat|unchanged)\b",
    "session": whole(r"\d{1,2}:\d{2}\s*(?:am|pm|ET|EST|PT|UTC)", "today", "this morning", "this session", r"as of (?:this )?\w+", "market open", "market close", "premarket", "at open", "at close", "Wednesday", "Monday", "Tuesday", "Thursday", "Friday"),
    "claim_attribution": whole("said", "reported", "according to", "stated", "confirmed", "per", "found", "cited"),
    "signal_attribution": whole("said", "reported", "found", "shows?", "data", "according to", "per", "filed", "published", "recorded"),
    "signal_number": r"\$\d+|\b\d+(?:\.\d+)?(?:\s*(?:%|million|billion|thousand|bps))",
    "early_down": whole("retreated?", "fell", "fallen", "declined?", "dropped?", r"pulled\s+back", r"moved?\s+lower", r"edged?\s+lower", r"sold\s+off", r"under\s+pressure", r"erased\s+gains?", r"gave?\s+back"),
    "index_up": r"\b(?:S&P|S&P\s+500|Dow|Nasdaq|Russell|DJIA)\b[^.!?\n]{0,50}[+]\d",
    "view_words": whole("overweight", "underweight", "neutral", "upgrade", "downgrade"),
    "move_reason": whole("because", "due to", "following", "after", "amid", "on news", "on volume"),
    "regulatory_url": whole(r"sec\.gov", r"sedarplus\.ca", r"sedar\.com", r"cftc\.gov", r"finra\.org", "edgar"),
}
SOCIAL_HINTS = r"(?:^|\s)(?:RT\s+@|#[A-Za-z]\w{1,}|@[A-Za-z]\w{1,}|\bthread\b|\bdm me\b|\bfollow\b)"

CASED = {
    "specificity": r"https?://\S+|\b\d{4}-\d{2}-\d{2}\b|\b\w+ \d{1,2}, \d{4}\b|\b\d{1,2}:\d{2}\b|\b\d+(?:\.\d+)?\s?(?:%|percent|bps|basis points|million|billion|kg|km|miles|hours|days|weeks|months|years|usd|cad|\$|B|M)\b|\$\d+(?:\.\d+)?[BMK]?|\bn\s*=\s*\d+|\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    "spec_window": r"https?://\S+|\b\d{4}-\d{2}-\d{2}\b|\b\w+ \d{1,2}, \d{4}\b|\b\d+(?:[.,]\d+)?\b|\$\d|\bn\s*=|\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    "quote": "[“\"][^”\"]{20,}[”\"]",
    "name": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
    "name_pair": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    "fin_numeric": r"(?<![A-Za-z])[A-Z]{2,5}(?!\w)\s*(?:/|-|—)\s*[A-Za-z]|\$\d+(?:\.\d+)?\b|[-+]\d+(?:\.\d+)?%|\d+(?:\.\d+)?\s*bps\b",
    "provider": whole("Finnhub", "Bloomberg", "Reuters", "FactSet", "Refinitiv", "S&P Global", "S&P 500", "Moody'?s", "Fitch", "EDGAR", "SEC", "SEDAR", "Yahoo Finance", "Google Finance", "Morningstar", "CapIQ", "PitchBook", "Crunchbase", "CoinMarketCap", "CoinGecko", "Glassnode", "Dune Analytics", "Alpha Vantage", "Quandl", "FRED", "World Bank", "IMF", "BLS", "BEA", "Census Bureau", "Federal Reserve", "The Fed"),
    "venue": whole("NASDAQ", "NYSE", "TSX", "CSE", r"OTC(?:\s+Markets)?", "LSE", "ASX", "HKEX", "SGX", "Euronext", "CBOE", "CME", "NYMEX", "ICE", "Cboe"),
    "listed_venue": whole("NASDAQ", "NYSE", "TSX", "CSE", r"OTC(?:\s+Markets)?", "LSE", "ASX", "HKEX", "SGX", "Euronext", "CBOE", "CME", "NYMEX", "ICE"),
    "numeric_anchor": r"\$\d+(?:\.\d+)?|\b\d+(?:\.\d+)?(?:\s*(?:%|bps|million|billion|M\b|B\b|K\b))",
    "ticker_price": r"\b[A-Z]{2,5}\b[^.!?\n]{0,80}(?:\$\d+(?:\.\d+)?|[-+]\d+(?:\.\d+)?%)",
    "mover": r"\b([A-Z]{2,5})\b(?:[^\n.!?]{0,40})(?:C?\$\s*\d+(?:\.\d+)?)[^\n.!?]{0,40}([-+]\d+(?:\.\d+)?%)",
    "big_move": r"\b([A-Z]{2,5})\b[^.!?\n]{0,60}[-+]\d{2,}(?:\.\d+)?%",
    "url": r"https?://\S+",
    "caps_word": r"\b[A-Za-z]{4,}\b",
}
#: The same matches in ASCII texts, behind a look at the first character and without ways back that can't help.
_CAPITALS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_DATED = r"\w++ \d{1,2}, \d{4}\b"
QUICK = {
    "specificity": rf"https?://\S+|\$\d+(?:\.\d+)?[BMK]?|\b(?:\d{{4}}-\d{{2}}-\d{{2}}\b|{_DATED}|\d{{1,2}}:\d{{2}}\b|\d++(?:\.\d+)?\s?(?:%|percent|bps|basis points|million|billion|kg|km|miles|hours|days|weeks|months|years|usd|cad|\$|B|M)\b|n\s*=\s*\d+|[A-Z][a-z]++\s+[A-Z][a-z]+\b)",
    "spec_window": rf"https?://\S+|\$\d|\b(?:\d{{4}}-\d{{2}}-\d{{2}}\b|{_DATED}|\d++(?:[.,]\d+)?\b|n\s*=|[A-Z][a-z]++\s+[A-Z][a-z]+\b)",
    "fin_numeric": f"(?=[{_CAPITALS}{_DIGITS}$+-])(?:" + CASED["fin_numeric"] + ")",
    **{name: f"(?=[${_DIGITS}])(?:" + (CASED | FOLDED)[name] + ")" for name in ("numeric_anchor", "signal_number")},
    **{name: "(?=[A-Z])" + CASED[name] for name in ("name", "name_pair", "ticker_price", "mover", "big_move")},
    "breadth": "(?=[0-9])" + FOLDED["breadth"],
}
#: What dates such as "May 5, 2024" must have, the only matches that can start with any word; and the others, behind a look at the
#: first character. Java looks a list of single characters up, but asks for ranges one by one.
DATED = f"[{_DIGITS}], [{_DIGITS}]{{4}}"
UNDATED = {name: f"(?=[$hn{_CAPITALS}{_DIGITS}])(?:" + QUICK[name].replace(f"{_DATED}|", "") + ")" for name in ("specificity", "spec_window")}
#: Words of SOCIAL_HINTS, one of which is in each match that has no # or @.
SOCIAL_WORDS = ("thread", "dm", "follow")
#: All words by which lists are found: needed ones, those that are terms, and those of SOCIAL_HINTS.
LISTED = tuple(sorted({*SOCIAL_WORDS} | {w for p in (*FOLDED.values(), *CASED.values()) for words in (needed_words(p), *(single_words(p) or ())) for w in words or ()}))
#: The pairs of words by which terms of several words are found, and the first words of these.
PAIRED = tuple(sorted({w for p in FOLDED.values() if single_words(p) for w in word_pairs(p)[0]}))
PAIR_STARTS = tuple(sorted({w.split(" ")[0] for w in PAIRED}))
#: Links that count as primary; hosts must follow the slashes at once.
PRIMARY_LINKS = {
    "custody": r"https?://(?:sec\.gov|sedarplus|sedar\.com|edgar|doi\.org|arxiv\.org|pubmed)",
    "shape": r"https?://(?:sec\.gov|sedarplus|edgar|doi\.org|arxiv\.org|pubmed)",
    "generic": r"https?://(?:sec\.gov|sedarplus|edgar|doi\.org|arxiv\.org|pubmed)",
    "snapshot": r"https?://(?:sec\.gov|sedarplus|edgar|doi\.org|arxiv)",
    "strategy": r"https?://(?:sec\.gov|sedarplus|edgar|doi\.org|arxiv)",
    "macro": r"https?://(?:sec\.gov|sedarplus|edgar|bls\.gov|eurostat\.ec|stat\.go\.jp|stats\.gov\.cn|doi\.org|arxiv)",
}

INSTITUTIONAL_SUFFIXES = (".gov", ".edu", ".mil", ".int")
ACADEMIC_HOSTS = ("doi.org", "arxiv.org", "pubmed.ncbi", "ncbi.nlm.nih", "jstor.org", "nature.com", "science.org", "ssrn.com", "stanford.edu")
SOCIAL_HOSTS = ("x.com", "twitter.com", "reddit.com", "tiktok.com", "facebook.com", "youtube.com", "instagram.com", "t.me", "truthsocial.com", "bsky.app")
#: (type, substrings of the lower-cased text), first hit wins.
TYPE_CUES = (
    ("anonymous", ("anonymous source", "source familiar", "unnamed source", "rumor", "leaked")),
    ("official", ("press release", "we are excited to announce")),
    ("primary", ("abstract", "methodology", "sample size", "doi", "preprint", "sec 10-q", "edgar", "filing")),
    ("first_hand", ("i saw", "i recorded", "i measured", "my experience")),
    ("opinion", ("opinion", "essay", "i think", "my take")),
    ("secondary", ("reported", "according to", "sources said")),
)
RELEASE_URLS = ("investor.", "/investors/", "/ir/", "newswire", "press-release", "press_release", "news-release")
NEWS_URLS = ("news", "article", "story", "blog", "substack", "medium.com", "forbes.com", "reuters.com", "apnews.com", "bloomberg.com", "cnbc.com", "marketwatch.com", "thestreet.com", "benzinga.com", "seekingalpha.com", "motleyfool.com", "markets", "finance")

CUSTODY_WEIGHTS = {"first_hand": 0.90, "primary": 0.88, "regulatory_filing": 0.92, "official": 0.78, "official_release": 0.78, "expert": 0.72, "secondary": 0.62, "secondary_market_article": 0.62, "news_article": 0.62, "tertiary": 0.42, "anonymous": 0.30, "social": 0.28, "social_post": 0.28, "opinion": 0.35, "opinion_article": 0.35, "unknown": 0.25}
PUBLISHER_WEIGHTS = {"primary": 0.88, "regulatory_filing": 0.92, "official": 0.78, "official_release": 0.78, "expert": 0.72, "first_hand": 0.84, "secondary": 0.65, "secondary_market_article": 0.65, "global_macro_market_update": 0.65, "investment_strategy_commentary": 0.68, "news_article": 0.65, "tertiary": 0.42, "anonymous": 0.28, "social": 0.28, "social_post": 0.28, "opinion": 0.40, "opinion_article": 0.40, "unknown": 0.25, "generic_article": 0.50}
GENRE_TYPES = {"financial_market_snapshot": "secondary_market_article", "global_macro_market_update": "secondary_market_article", "investment_strategy_commentary": "secondary_market_article", "news_article": "secondary", "official_release": "official", "regulatory_filing": "primary", "opinion_article": "opinion", "social_post": "social"}
HIGH_TRUST_TYPES = ("first_hand", "primary", "official", "expert", "regulatory_filing")
ARTICLE_GENRES = ("financial_market_snapshot", "global_macro_market_update", "investment_strategy_commentary", "news_article", "opinion_article", "social_post")
FINANCE_GENRES = ("financial_market_snapshot", "global_macro_market_update", "investment_strategy_commentary")
SECONDARY_TYPES = ("secondary", "secondary_market_article", "news_article")
FAKE_TICKERS = ("OTC", "THE", "FOR", "AND", "NOT", "ARE", "HAS", "HAD", "WAS", "ITS", "ALL", "BUT", "CAN", "DID", "GET", "GOT", "LET", "MAY", "NEW", "NOW", "OUT", "OWN", "PUT", "RUN", "SAY", "SET", "USE", "WAY", "WHO", "WHY", "YET", "YOU", "CMS", "SEC", "FDA", "TSX", "CSE", "ETF", "IPO", "CEO", "CFO", "COO", "CBD", "THC", "EBITDA")

#: (pattern, key, label), first match wins; all ignore case.
ENTITIES = (
    (r"\b30[-\s]?y(?:ear|r)(?:\s+(?:treasury|T(?:reasury)?))?", "30yr-treasury-yield", "30-Year Treasury Yield"),
    (r"\b10[-\s]?y(?:ear|r)(?:\s+(?:treasury|T(?:reasury)?))?", "10yr-treasury-yield", "10-Year Treasury Yield"),
    (r"\b5[-\s]?y(?:ear|r)(?:\s+(?:treasury|T(?:reasury)?))?", "5yr-treasury-yield", "5-Year Treasury Yield"),
    (r"\b2[-\s]?y(?:ear|r)(?:\s+(?:treasury|T(?:reasury)?))?", "2yr-treasury-yield", "2-Year Treasury Yield"),
    (r"\bS&P\s*500\b", "sp500", "S&P 500"),
    (r"\bNasdaq(?:\s+Composite)?\b", "nasdaq", "Nasdaq Composite"),
    (r"\bDow(?:\s+Jones(?:\s+Industrial(?:\s+Avg(?:erage)?)?)?)?\b|\bDJIA\b", "dow", "Dow Jones"),
    (r"\bRussell\s+2000\b", "russell2000", "Russell 2000"),
    (r"\bBrent(?:\s+crude)?\b", "brent-crude", "Brent Crude"),
    (r"\bWTI(?:\s+crude)?\b", "wti-crude", "WTI Crude"),
    (r"\bGold\b", "gold", "Gold"),
    (r"\bVIX\b", "vix", "VIX"),
    (r"\bDXY\b|\bDollar\s+Index\b|U\.S\.\s+Dollar\s+Index", "dxy", "US Dollar Index"),
    (r"\bUSD[/]EUR\b|\bEUR[/]USD\b", "eur-usd", "EUR/USD"),
    (r"\bUSD[/]JPY\b|\bJPY[/]USD\b", "usd-jpy", "USD/JPY"),
    (r"\bCPI\b", "cpi", "CPI"),
    (r"\bPPI\b", "ppi", "PPI"),
    (r"\bPCE\b", "pce", "PCE"),
    (r"\bPMI\b", "pmi", "PMI"),
    (r"\bGDP\b", "gdp", "GDP"),
    (r"\b(?:initial\s+)?jobless\s+claims?\b|\binitial\s+claims?\b", "jobless-claims", "Jobless Claims"),
    (r"\bretail\s+sales?\b", "retail-sales", "Retail Sales"),
)
COLON_CLAIM = r"([A-Za-z&][^:\n]{2,55}):\s*([+-]?\$?\d[\d,\.]*(?:%|bps|(?:\s*/bbl)|(?:\s*/oz)|(?:\s+per\s+(?:barrel|oz(?:ounce)?)))?(?:\s*[-–]\s*\d[\d,\.]*(?:%|bps)?)?)"
INLINE_CLAIM = r"\b(S&P\s*500|Nasdaq(?:\s+Composite)?|Dow(?:\s+Jones)?|DJIA|Russell\s+2000|\d{1,2}[-\s]?y(?:ear|r)(?:\s+Treasury)?|WTI(?:\s+crude)?|Brent(?:\s+crude)?|Gold|VIX|DXY|CPI|PPI|PCE|PMI|GDP|(?:initial\s+)?jobless\s+claims?|retail\s+sales?)[^.!?\n]{0,70}?([+-]?\$?\d[\d,\.]*(?:%|\s*bps|\s*/bbl|\s*/oz|\s+per\s+(?:barrel|oz)|\s*,\d{3})*)"
CRUDE_KEYS = ("wti-crude", "brent-crude")
FOLLOW_UP_KEYS = (
    ("treasury", ("10yr-treasury-yield", "2yr-treasury-yield", "5yr-treasury-yield", "30yr-treasury-yield")),
    ("energy", CRUDE_KEYS),
    ("labor", ("cpi", "ppi", "jobless-claims", "retail-sales")),
    ("exchange", ("sp500", "nasdaq", "dow", "russell2000", "vix")),
)

JUNK_CHUNK = r"^(?:skip\s+to\s+(?:main\s+)?content|menu|search|home|subscribe|log\s?in|sign\s+in|share|tweet|facebook|linkedin|pinterest|email this|print|advertisement|sponsored|related articles?|you may also like|read more|see more|load more|comments?|reply|close|dismiss|toggle\s+\w+|back\s+to\s+top|cookie\s+\w+|accept\s+all|privacy\s+policy|terms\s+of\s+(?:use|service))$"
CONTENT_DIV = r"""<div[^>]+(?:class|id)=["'][^"']*(?:article[-_]?body|entry[-_]?content|post[-_]?content|story[-_]?body|field[-_]?body|article__body|post__content|main[-_]?content|content[-_]?area)[^"']*["'][^>]*>"""
CHROME_TAGS = ("script", "style", "nav", "footer", "head", "noscript", "iframe", "aside", "svg", "form", "header")
