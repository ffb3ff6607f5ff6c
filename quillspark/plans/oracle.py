"""The same queries in DuckDB's SQL, built from the same word lists; independent in how they compute."""

from __future__ import annotations

from quillspark.functions import lexicon as L
from quillspark.operators import scoring as S
from quillspark.plans import corpora as C


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def d(x: float) -> str:
    """A double, for a plain literal would be a decimal."""
    return f"{x!r}e0"


def rx(name: str) -> str:
    """A named pattern for RE2, which has no look-around."""
    if name in L.FOLDED:
        return q("(?i)" + L.FOLDED[name])
    return q(L.CASED[name].replace("(?<![A-Za-z])[A-Z]{2,5}(?!\\w)", r"\b[A-Z]{2,5}\b"))


def cnt(name: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, {rx(name)}))"


def has(name: str, text: str = "text") -> str:
    return f"regexp_matches({text}, {rx(name)})"


def any_of(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in parts) + ")"


def case(key: str, values: dict, default: str, lit=q) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {default} END"


def clamp(x: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"greatest({d(low)}, least({d(high)}, {x}))"


def pick(values, index: str) -> str:
    return f"list_extract({listed(values)}, CAST(({index}) % {len(values)} + 1 AS INTEGER))"


def normalized(text: str = "text") -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def sentences(text: str = "text") -> str:
    marked = rf"regexp_replace(trim({text}, E' \n\t\r'), '([.!?])\s+', concat('\1', chr(10)), 'g')"
    return rf"list_filter(list_transform(string_split_regex({marked}, '\n+'), lambda x: trim(x, E' \n\t\r')), lambda x: x <> '')"


def n_words(text: str) -> str:
    return rf"len(list_filter(string_split_regex({text}, '\s+'), lambda w: w <> ''))"


WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"


def netloc(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def suffix(host: str) -> str:
    return "(" + " OR ".join(f"ends_with({host}, {q(s)})" for s in L.INSTITUTIONAL_SUFFIXES) + ")"


def inferred(text: str, url: str) -> str:
    host = netloc(url)
    cues = " ".join(f"WHEN {any_of(f'lower({text})', c)} THEN {q(k)}" for k, c in L.TYPE_CUES)
    return f"CASE WHEN {any_of(host, L.SOCIAL_HOSTS)} THEN 'social' WHEN {suffix(host)} THEN 'official' WHEN {any_of(host, L.ACADEMIC_HOSTS)} THEN 'primary' {cues} ELSE 'unknown' END"


def link_class(host: str) -> str:
    return f"CASE WHEN {suffix(host)} THEN 'institutional' WHEN {any_of(host, L.ACADEMIC_HOSTS)} THEN 'academic' WHEN {any_of(host, L.SOCIAL_HOSTS)} THEN 'social' ELSE 'web' END"


def windows(name: str, k: int, text: str = "text") -> str:
    """The list of matches with k characters on either side."""
    g, m = f"string_split_regex({text}, {rx(name)})", f"regexp_extract_all({text}, {rx(name)})"
    at = "(CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT))"
    one = f"substring({text}, greatest({at} - {k}, 0) + 1, least({at} + length(m[i]) + {k}, length({text})) - greatest({at} - {k}, 0))"
    return f"(SELECT list_transform(range(1, len(m) + 1), lambda i: {one}) FROM (SELECT {g} AS g, {m} AS m))"


def unique_folded(items: str) -> str:
    low = f"list_transform({items}, lambda z: lower(z))"
    return f"list_filter({items}, lambda x, i: list_position({low}, lower(x)) = i)"


def found(name: str, text: str = "text") -> str:
    return unique_folded(f"regexp_extract_all({text}, {rx(name)})")


ORDERS = (
    "SELECT o_orderkey AS doc_id, concat("
    + ", ".join(f"{pick(C.PHRASES, f'o_orderkey * {m} + {o}')}, {q(sep)}" for m, o, sep in C.PICKS)
    + ", ' On ', strftime(o_orderdate, '%Y-%m-%d'), ' the sum was $', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), ' for 3 percent.') AS text, "
    + f"{pick(C.TYPES, 'o_orderkey')} AS source_type, {pick(C.URLS, 'o_orderkey // 3')} AS source_url FROM orders"
)


def _ticker(m: int) -> str:
    return "concat(" + ", ".join(f"chr(CAST(65 + (p_partkey * {m} // {x}) % 26 AS INTEGER))" for x in (1, 26, 676)) + ")"


_PRICE = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR)"
PARTS = (
    f"SELECT p_partkey AS doc_id, concat('Stocks fell early on the NASDAQ and NYSE. Acme Metals (', {_ticker(1)}, ') at $', {_PRICE}, '.50 (+', CAST(p_partkey % 30 AS VARCHAR), '.5%) led. ', "
    f"{_ticker(7)}, ' at C$ ', {_PRICE}, ' -', CAST(p_partkey % 9 AS VARCHAR), '.2% on volume.', chr(10), {_ticker(1)}, ' again $1.10 +2.0%', chr(10), 'The OTC at $3.00 +1.0% is no ticker.', chr(10), 'S&P 500: +0.', CAST(p_partkey % 10 AS VARCHAR), '2% at close.', chr(10), {pick(C.PHRASES, 'p_partkey * 3')}) AS text, "
    f"{pick(C.TYPES, 'p_partkey')} AS source_type, '' AS source_url FROM part"
)
_LINE = "CASE event_type " + " ".join(f"WHEN {q(k)} THEN concat({q(a)}, CAST(value AS VARCHAR), {q(b)})" for k, (a, b) in C.CLAIM_LINES.items()) + " END"
EVENTS = f"SELECT strftime(ts, '%Y-%m-%d') AS group_id, user_id AS doc_idx, string_agg({_LINE}, chr(10) ORDER BY event_id) AS text, concat('user ', CAST(user_id AS VARCHAR)) AS source_name FROM events GROUP BY ALL"

_GENRE = (
    f"CASE WHEN {has('regulatory_url', 'lower(source_url)')} THEN 'regulatory_filing' WHEN {any_of('lower(source_url)', L.RELEASE_URLS)} THEN 'official_release' WHEN {cnt('press_release', 'n')} >= 2 THEN 'official_release' "
    f"WHEN (ft >= 2 OR fn >= 2) AND {cnt('allocation', 'n')} >= 3 THEN 'investment_strategy_commentary' WHEN (ft >= 2 OR fn >= 2) AND {cnt('macro_indicators', 'n')} >= 3 AND {cnt('macro_regions', 'n')} >= 2 THEN 'global_macro_market_update' "
    f"WHEN ft >= 4 AND fn >= 3 THEN 'financial_market_snapshot' WHEN {any_of('lower(source_url)', L.NEWS_URLS)} THEN 'news_article' WHEN regexp_matches(n, {q('(?im)' + L.SOCIAL_HINTS)}) THEN 'social_post' WHEN {has('opinion_hints', 'n')} THEN 'opinion_article' ELSE 'generic_article' END"
)
_SHOUT = f"(SELECT CASE WHEN len(w) < 8 OR c < 4 OR c / len(w) < {d(0.2)} THEN {d(0.0)} ELSE {clamp(f'(c / len(w) - {d(0.2)}) * {d(5.0)}')} END FROM (SELECT w, len(list_filter(w, lambda x: x = upper(x))) AS c FROM (SELECT regexp_extract_all(text, {rx('caps_word')}) AS w)))"
_URLS = f"regexp_extract_all(text, {rx('url')})"
_BONUS = f"list_reduce(list_transform(cls, lambda c: CASE c WHEN 'institutional' THEN {d(0.04)} WHEN 'academic' THEN {d(0.05)} WHEN 'social' THEN {d(-0.01)} ELSE {d(0.015)} END), lambda a, b: a + b, {d(0.0)})"


def coherence(tokens: str, sents: str) -> str:
    """Over columns of a subselect that has tokens and sents."""
    low = f"list_transform({tokens}, lambda x: lower(x))"
    # RE2 takes letters beyond ASCII for edges of words
    hits = cnt("connectives", f"regexp_replace(array_to_string({low}, ' '), '[^\\x00-\\x7F]', 'x', 'g')")
    lens = f"list_transform({sents}, lambda s: {n_words('s')})"
    connected = f"least({hits} / greatest(len({sents}), 1) / {d(0.25)}, {d(1.0)})"
    variety = f"least(greatest((len(list_distinct({low})) / greatest(len({tokens}), 1) - {d(0.25)}) / {d(0.4)}, {d(0.0)}), {d(1.0)})"
    spread = f"sqrt(CAST(len(l) * list_sum(list_transform(l, lambda x: x * x)) - list_sum(l) * list_sum(l) AS DOUBLE)) / len(l) / greatest(list_sum(l) / len(l), {d(1.0)})"
    varied = f"(SELECT CASE WHEN len(l) >= 3 THEN least({spread} / {d(0.5)}, {d(1.0)}) ELSE {d(0.5)} END FROM (SELECT {lens} AS l))"
    return f"CASE WHEN len({tokens}) < 10 THEN {d(0.5)} ELSE {clamp(f'{d(0.45)} * {connected} + {d(0.4)} * {variety} + {d(0.15)} * {varied}')} END"


def scored(corpus: str = ORDERS) -> str:
    """WITH ... up to table ``z``, a row for each document with everything that decisions need."""
    counts = ", ".join(f"{cnt(k)} AS n_{k}" for k in S.COUNTED)
    open_ = "dec IN ('', 'auto', 'unknown')"
    mismatch = f"dec IN ({', '.join(map(q, L.HIGH_TRUST_TYPES))}) AND genre IN ({', '.join(map(q, L.ARTICLE_GENRES))})"
    by_genre = case("genre", L.GENRE_TYPES, "NULL")
    per = lambda k: f"(n_{k} / ns)"
    known = f"CASE WHEN eff IN ('', 'auto', 'unknown') THEN {inferred('text', 'source_url')} ELSE lower(eff) END"
    base = case("known", L.CUSTODY_WEIGHTS, d(L.CUSTODY_WEIGHTS["unknown"]), d)
    finance = f"genre IN ({', '.join(map(q, L.FINANCE_GENRES))}) AND eff IN ({', '.join(map(q, L.SECONDARY_TYPES))})"
    return f"""WITH c AS ({corpus}),
f0 AS (SELECT *, {normalized()} AS n, {sentences()} AS sents FROM c),
f1 AS (SELECT *, {WORDS.format('n')} AS tokens, greatest(len(sents), 1) AS ns, {counts}, {cnt('quote')} AS n_quotes, length(text) - length(replace(text, '!', '')) AS n_exclaims,
  len(list_filter({windows('evidence', 80)}, lambda x: {has('spec_window', 'x')})) AS anchored, {_SHOUT} AS shouting,
  (SELECT CASE WHEN len(w) = 0 THEN {d(0.0)} ELSE {clamp(f"len(list_filter(w, lambda x: {has('attribution_verb', 'x')} AND {has('name', 'x')})) / len(w)")} END FROM (SELECT {windows('quote', 120)} AS w)) AS attribution,
  contains(lower(text), 'sponsored') AS sponsored, list_transform({_URLS}, lambda u: {link_class(netloc('u'))}) AS cls,
  {cnt('fin_terms', 'n')} AS ft, {cnt('fin_numeric', 'n')} AS fn, lower(source_type) AS dec, {inferred('text', 'source_url')} AS inf FROM f0),
f2 AS (SELECT *, len(tokens) AS n_words, n_evidence - anchored AS unanchored, {clamp(_BONUS, -0.1, 0.18)} AS bonus, {_GENRE} AS genre, {coherence('tokens', 'sents')} AS coherence_raw,
  CASE WHEN {open_} THEN inf ELSE dec END AS eff0, CASE WHEN {open_} AND inf = 'unknown' THEN {d(0.3)} WHEN {open_} THEN {d(0.75)} WHEN inf = 'unknown' OR inf = dec THEN {d(0.9)} ELSE {d(0.4)} END AS conf0 FROM f1),
r AS (SELECT *, {mismatch} AS mismatch, CASE WHEN {mismatch} OR ({open_} AND {by_genre} IS NOT NULL) THEN {by_genre} ELSE eff0 END AS eff,
  CASE WHEN {mismatch} THEN least(conf0, {d(0.4)}) WHEN {open_} AND {by_genre} IS NOT NULL THEN greatest(conf0, {d(0.7)}) ELSE conf0 END AS conf FROM f2),
k AS (SELECT *, {known} AS known FROM r),
s1 AS (SELECT *, {clamp(f"{base} + least(n_evidence * {d(0.035)}, {d(0.18)}) + bonus + least(n_quotes * {d(0.02)}, {d(0.08)}) - least(n_anonymous * {d(0.07)}, {d(0.25)})")} AS custody_raw,
  {clamp(f"{per('specificity')} * {d(0.9)}")} AS specificity, {clamp(f"(anchored + unanchored * {d(0.3)}) / ns")} AS evidence, {clamp(f"{per('logic')} * {d(0.8)}")} AS logic,
  {per('filler')} * CASE WHEN eff IN ('first_hand', 'social') THEN {d(0.15)} ELSE {d(0.25)} END AS filler,
  {clamp(f"{per('hype')} * {d(1.2)} + {per('urgency')} * {d(1.5)} + {per('certainty')} * {d(0.5)} + {per('exclaims')} * {d(0.4)} + shouting * {d(0.6)} + {per('attack')} * {d(0.9)}")} AS pressure,
  {clamp(f"n_bias * {d(0.07)} + n_attack * {d(0.05)} + CASE WHEN sponsored THEN {d(0.12)} ELSE {d(0.0)} END")} AS bias_risk FROM k),
s2 AS (SELECT *, custody_raw * ({d(0.65)} + {d(0.35)} * conf) AS custody FROM s1),
s3 AS (SELECT *, {clamp(f"{d(0.25)} + specificity * {d(0.25)} + evidence * {d(0.25)} + logic * {d(0.15)} + custody * {d(0.2)} + attribution * {d(0.05)}")} AS signal,
  {clamp(f"{per('certainty')} * {d(1.3)} - {per('hedges')} * {d(0.5)} + greatest({d(0.0)}, {d(0.55)} - custody) * {d(0.4)} + greatest({d(0.0)}, {d(0.4)} - evidence) * {d(0.3)}")} AS certainty_bias FROM s2),
s4 AS (SELECT *, {clamp(f"pressure * {d(0.48)} + certainty_bias * {d(0.32)} + bias_risk * {d(0.2)}")} AS manipulation_risk FROM s3),
s5 AS (SELECT *, least({clamp(f"signal * {d(0.4)} + custody * {d(0.35)} + evidence * {d(0.15)} + attribution * {d(0.05)} - manipulation_risk * {d(0.3)} - certainty_bias * {d(0.15)}")},
  CASE WHEN pressure >= {d(0.65)} OR n_attack >= 1 THEN {d(0.4)} ELSE {d(1.0)} END, CASE WHEN n_attack >= 2 THEN {d(0.25)} ELSE {d(1.0)} END, CASE WHEN n_words < 50 THEN {d(0.55)} ELSE {d(1.0)} END) AS overall,
  {clamp(f"{d(0.18)} + filler + pressure * {d(0.32)} + ({d(1.0)} - signal) * {d(0.3)}")} AS noise, certainty_bias - evidence AS gap, {d(0.1)} + (manipulation_risk + certainty_bias) * {d(0.12)} AS width, round(coherence_raw, 3) AS coherence FROM s4),
s6 AS (SELECT *, {clamp('overall - width')} AS low, {clamp(f'overall + width * {d(0.4)}')} AS high, CASE WHEN conf < {d(0.5)} THEN 'mismatch' WHEN custody < {d(0.45)} THEN 'weak' WHEN custody < {d(0.7)} THEN 'watch' ELSE 'clean' END AS warning,
  unanchored > anchored AS loose, round(coherence_raw, 3) < {d(0.3)} AND n_words >= 50 AS incoherent, genre IN ('financial_market_snapshot', 'global_macro_market_update') AS tables, genre = 'investment_strategy_commentary' AS strategy FROM s5),
z AS (SELECT *, CASE WHEN n_attack >= 1 AND pressure >= {d(0.55)} THEN 'attack_pressure' WHEN manipulation_risk >= {d(0.65)} THEN 'manipulative'
  WHEN overall >= {d(0.7)} AND custody >= {d(0.7)} AND manipulation_risk < {d(0.35)} THEN CASE WHEN {finance} THEN 'secondary_market' ELSE 'usable' END
  WHEN overall >= {d(0.5)} THEN 'mixed' WHEN certainty_bias >= {d(0.5)} OR loose THEN 'outpaced' ELSE 'weak' END AS verdict FROM s6)
"""


def chosen(conditions: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(k)} END" for k, c in conditions.items()) + "], lambda x: x IS NOT NULL), ',')"


FLAGS = chosen({
    "weak_custody": f"custody < {d(0.45)}", "certainty_bias": f"certainty_bias > {d(0.55)}", "high_pressure": f"pressure > {d(0.55)}", "strong_low_evidence": f"evidence < {d(0.2)} AND n_certainty >= 2",
    "unanchored": "loose AND n_evidence >= 2", "incentive": f"bias_risk > {d(0.35)}", "attack": "n_attack > 0", "short": "n_words < 50", "table_heavy": "incoherent AND tables", "low_coherence": "incoherent AND NOT tables",
    "house_view": "strategy", "forward_looking": "strategy", "contradicted": f"conf < {d(0.5)} AND dec NOT IN ('', 'auto', 'unknown') AND NOT mismatch", "downgraded": "mismatch",
})
QUESTIONS = chosen({
    "primary": "true", "beneficiary": "true", "falsifier": "true", "kinds": "true", "certainty": f"certainty_bias > {d(0.45)}", "trace": f"custody < {d(0.5)}", "emotion": f"pressure > {d(0.5)}",
    "anchors": "loose AND n_evidence > 0", "profit": f"bias_risk > {d(0.35)}", "strip": "n_attack > 0", "quotes": f"attribution < {d(0.5)} AND n_quotes >= 1",
})
ACTION = case("verdict", {k: a for k, (a, _) in S.VERDICTS.items()}, "NULL")
TRIAGE = (
    f"concat(array_to_string(list_filter([{case('warning', S.CUSTODY_PHRASES, 'NULL')}, CASE WHEN n_attack >= 1 THEN 'attack wording' END, CASE WHEN pressure >= {d(0.55)} THEN 'high pressure' END, "
    f"CASE WHEN certainty_bias >= {d(0.55)} THEN 'high certainty bias' END, CASE WHEN loose AND unanchored >= 2 THEN 'unanchored evidence terms' END], lambda x: x IS NOT NULL), ' + '), '. ', {case(f'({ACTION})', S.IMPERATIVES, q(''))})"
)


def sentence_class(kind: str) -> str:
    """Of column s."""
    key = f"({has('signal_number', 's')} AND ({has('signal_attribution', 's')} OR {n_words('s')} >= 12))"
    if kind == "snapshot":
        rules = f"WHEN {has('missing', 's')} THEN 'missing' WHEN {' OR '.join(has(k, 's') for k in ('ticker_price', 'breadth', 'session', 'provider', 'listed_venue'))} THEN 'key' WHEN {has('interpretation', 's')} THEN 'framing'"
    elif kind == "macro":
        rules = f"WHEN {key} AND ({has('macro_indicators', 's')} OR {has('macro_regions', 's')}) THEN 'key' WHEN {has('statement_verb', 's')} AND (regexp_matches(s, '[\"“]') OR {has('name_pair', 's')}) THEN 'attributed' WHEN {key} THEN 'key'"
    elif kind == "strategy":
        rules = f"WHEN {has('allocation', 's')} AND {has('view_words', 's')} THEN 'view' WHEN {has('forward_looking', 's')} THEN 'forward' WHEN {key} THEN 'view'"
    else:
        rules = f"WHEN {has('missing', 's')} THEN 'missing' WHEN {key} THEN 'key' WHEN {has('interpretation', 's')} THEN 'framing'"
    return f"CASE WHEN {has('caveat', 's')} THEN 'caveat' {rules} END"


def brief_sentences(kind: str, corpus: str) -> str:
    most = {"snapshot": 350, "macro": 400, "strategy": 400}.get(kind)
    keep = f"{n_words('s')} >= {5 if kind == 'generic' else 4}" + (f" AND length(s) <= {most}" if most else "")
    return f"WITH c AS ({corpus}), t AS (SELECT doc_id, unnest({sentences()}) AS s FROM c), k AS (SELECT doc_id, {sentence_class(kind)} AS class FROM t WHERE {keep}) SELECT doc_id, class, count(*) AS n FROM k WHERE class IS NOT NULL GROUP BY ALL"


def entity(fragment: str, what: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({fragment}, {q('(?i)' + e[0])}) THEN {q(e[what])}" for e in L.ENTITIES) + " END"


def parsed(raw: str) -> str:
    clean = rf"trim(regexp_replace(trim(regexp_replace({raw}, ',|\$|/bbl|/oz', '', 'g')), '(?i)\s+per\s+(?:barrel|oz(?:ounce)?)', '', 'g'))"
    rng = r"'^([+-]?\d+\.?\d*)[-–](\d+\.?\d*)'"
    low, high = (f"regexp_extract({clean}, {rng}, {i})" for i in (1, 2))
    plain = f"regexp_replace({clean}, '[% ]+$', '')"
    return rf"CASE WHEN {low} <> '' THEN round((TRY_CAST({low} AS DOUBLE) + TRY_CAST({high} AS DOUBLE)) / {d(2.0)}, 5) WHEN regexp_matches({plain}, '^[+-]?(?:\d+\.?\d*|\.\d+)$') THEN TRY_CAST({plain} AS DOUBLE) END"


def unit(raw: str) -> str:
    return rf"CASE WHEN contains({raw}, '%') THEN '%' WHEN contains({raw}, 'bps') THEN 'bps' WHEN regexp_matches({raw}, '\$|/bbl|/oz') THEN '$' ELSE '' END"


def claims(corpus: str = EVENTS) -> str:
    """WITH ... up to table ``claims``."""
    one = lambda p, k: f"SELECT group_id, doc_idx, source_name, {k} AS pass, unnest(range(1, len(regexp_extract_all(text, {q('(?i)' + p)})) + 1)) AS nth, unnest(regexp_extract_all(text, {q('(?i)' + p)}, 1)) AS label, unnest(regexp_extract_all(text, {q('(?i)' + p)}, 2)) AS raw0 FROM c"
    return f"""WITH c AS ({corpus}), h AS ({one(L.COLON_CLAIM, 1)} UNION ALL {one(L.INLINE_CLAIM, 2)}),
e AS (SELECT group_id, doc_idx, source_name, pass, nth, trim(raw0) AS raw_value, {entity('trim(label)', 1)} AS entity_key, {entity('trim(label)', 2)} AS entity_label, {parsed('trim(raw0)')} AS numeric_value FROM h),
claims AS (SELECT group_id, doc_idx, source_name, pass, nth, entity_key, entity_label, raw_value, numeric_value, {unit('raw_value')} AS unit FROM e WHERE entity_key IS NOT NULL AND numeric_value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY group_id, doc_idx, entity_key, numeric_value ORDER BY pass, nth) = 1)
"""


def entities(corpus: str = EVENTS) -> str:
    """claims() and up to table ``entities``."""
    crude = f"entity_key IN ({', '.join(map(q, L.CRUDE_KEYS))})"
    return claims(corpus) + f""", g AS (SELECT group_id, entity_key, count(*) AS n_values, count(DISTINCT doc_idx) AS n_docs, min(numeric_value) AS low, max(numeric_value) AS high, bool_and(abs(numeric_value) < 20) AS small FROM claims GROUP BY ALL),
g2 AS (SELECT *, count(*) FILTER ({crude}) OVER (PARTITION BY group_id) = 2 AS crude, high - low AS spread FROM g),
entities AS (SELECT *, CASE WHEN n_values = 1 THEN 'unique' WHEN crude AND {crude} THEN 'shared' WHEN CASE WHEN small THEN spread > {d(0.15)} ELSE spread > CASE WHEN low <> 0 THEN abs(low) ELSE {d(1.0)} END * {d(0.02)} END THEN 'conflict' ELSE 'alignment' END AS status FROM g2)
"""
