"""Queries over texts made so that every decision is reached on either side, and over rendered results, with SQL.

Each corpus is composed from the structured tables, by columns here and by SQL beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import render
from quillspark.operators import briefs as B
from quillspark.operators import claims as K
from quillspark.plans import corpora as C
from quillspark.plans import oracle as O
from quillspark.plans.catalogue import query
from quillspark.plans.triage import analyze, assess, scored, with_briefs
from quillspark.sources import pages as P
from quillspark.sources import readers

_PAD = " The bread was warm and the river ran past the old mill while two boats went by and the baker closed the door."
#: (text, type, url) of documents, by number.
CASES = (
    ("Numbers rose.", "primary", ""),
    ("Это обычный текст о погоде и хлебе без каких либо чисел и ссылок для проверки языка.", "auto", ""),
    ("bread " * 60, "unknown", ""),
    ("shares stocks NYSE NASDAQ +1.5% -2.5% " * 12, "auto", ""),
    ("Act now and share this shocking miracle secret, it is always guaranteed, proven, undeniable and explosive, hurry before it's too late!!!", "unknown", ""),
    ("The dataset and the filing of 2024-03-05 cover 412 shares and 36 stocks on the NYSE and NASDAQ, because the audit of 18 trials shows +1.2%, -3.4% and +5.6% at $14.20, and the methodology is at https://www.sec.gov/x and https://doi.org/10.1/y. However, the raw data of 12 receipts and the transcript of 2024-02-01 are public, therefore the sample size of 90 is known, although 3 invoices are missing.", "secondary", ""),
    ("RT @baker follow this thread about bread #rivers and mills." + _PAD, "auto", ""),
    ("In my opinion the real issue is what nobody sees, and we should act on it." + _PAD, "auto", ""),
    ("For immediate release: this press release has forward-looking statements of 2024 and a safe harbor." + _PAD, "auto", ""),
    ("The idiots and traitors must be purged, act now, everyone knows it is proven!!" + _PAD, "auto", ""),
    ("The methodology, the dataset and the audit say so." + _PAD, "primary", ""),
    ("A story about the mill." + _PAD, "primary", "https://news.example.com/story"),
    ("The mill reported 12 loaves on 2024-03-05 in its filing." + _PAD, "auto", "https://www.sec.gov/edgar/1"),
    ("I saw it myself and recorded the trial of 36 loaves for 12 days, because the oven was new. However, the audit of 2024-03-05 found 3 percent errors, although \"we checked every log file twice before that\" said Ada Moreno." + _PAD, "first_hand", ""),
    ("We keep an overweight on shares and stocks, a tactical upgrade, a strategic allocation and a house view with +1.5% and 25 bps." + _PAD, "auto", ""),
    ("The methodology, the dataset and the audit say so, it is proven." + _PAD, "unknown", ""),
    ("Investors should subscribe to our product and our platform, donate, buy now, use code MILL, a sponsored paid partnership with an affiliate." + _PAD, "auto", ""),
    ("CPI, GDP and inflation in Europe, Japan and China slowed while shares and stocks gained +1.5% and bonds lost 25 bps." + _PAD, "auto", ""),
)


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def cases_corpus(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text, kind, url = (_pick([c[i] for c in CASES], k) for i in range(3))
    rows = C.spread(C.table(spark, d, "part").select("p_partkey"))
    return rows.select(k.alias("doc_id"), F.concat(text, F.lit(" Item "), k.cast("string"), F.lit(".")).alias("text"), kind.alias("source_type"), url.alias("source_url"))


CASES_SQL = f"SELECT p_partkey AS doc_id, concat({O.pick([c[0] for c in CASES], 'p_partkey')}, ' Item ', CAST(p_partkey AS VARCHAR), '.') AS text, {O.pick([c[1] for c in CASES], 'p_partkey')} AS source_type, {O.pick([c[2] for c in CASES], 'p_partkey')} AS source_url FROM part"
_LETTERS = [rf"length(regexp_replace(text, '{x}', '', 'g'))" for x in (r"[^\p{L}]", "[^A-Za-z]")]
_FOREIGN = f"({_LETTERS[0]} >= 20 AND {_LETTERS[1]} / greatest({_LETTERS[0]}, 1) < 0.7e0 AND NOT ({' OR '.join(O.has(k) for k in ('logic', 'hedges', 'certainty'))}))"


@query(O.scored(CASES_SQL) + f"SELECT doc_id, genre, eff AS source_type, verdict, {O.ACTION} AS action, {O.FLAGS} AS flags, {_FOREIGN} AS non_english, warning, round(overall, 6) AS overall FROM z")
def q_case_decisions(spark, d):
    flags = F.filter("d.flags", lambda x: x != "language")
    return scored(cases_corpus(spark, d)).select("doc_id", "f.genre", F.col("r.effective").alias("source_type"), "d.verdict", "d.action", F.array_join(flags, ",").alias("flags"), "f.non_english", "s.warning", F.round("s.overall", 6).alias("overall"))


@query(f"WITH c AS ({O.ORDERS}) SELECT doc_id, {O.has('early_down', 'substring(text, 1, 400)')} AND {O.has('index_up')} AS mismatch FROM c")
def q_case_timeframe(spark, d):
    return C.orders_corpus(spark, d).select("doc_id", B.timeframe_mismatch(F.col("text")).alias("mismatch"))


_LABELS, _TEXTS, _KINDS = zip(*readers.EXAMPLES)
_EXAMPLES = f"SELECT p_partkey AS doc_id, {O.pick(_LABELS, 'p_partkey')} AS label, {O.pick(_TEXTS, 'p_partkey')} AS text, {O.pick(_KINDS, 'p_partkey')} AS source_type, '' AS source_url FROM part"


@query(O.scored(_EXAMPLES) + f"SELECT doc_id, label, {O.ACTION} AS recommended_action, warning AS custody_warning_level, round(overall, 3) AS overall_confidence FROM z")
def q_examples(spark, d):
    k = F.col("p_partkey")
    rows = C.spread(C.table(spark, d, "part").select(k)).select(k.alias("doc_id"), *(_pick(v, k).alias(n) for v, n in ((_LABELS, "label"), (_TEXTS, "text"), (_KINDS, "source_type"))))
    return analyze(rows).select("doc_id", "label", "assessment.recommended_action", "assessment.custody_warning_level", "assessment.scores.overall_confidence")


# requests

_REQUEST_SQL = f"""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 7 = 3 THEN concat('no json ', CAST(p_partkey AS VARCHAR)) ELSE concat('{{"text": "', CASE WHEN p_partkey % 11 = 5 THEN ' ' ELSE concat('T ', CAST(p_partkey AS VARCHAR)) END, '", "source_type": "', {O.pick(C.TYPES, 'p_partkey')}, '", "source_name": "', CASE WHEN p_partkey % 2 = 0 THEN repeat('n', 199 + p_partkey % 5) ELSE '' END, '"', CASE WHEN p_partkey % 3 = 0 THEN ', "include_signal_brief": false' ELSE '' END, '}}') END AS value FROM part"""


@query(f"""WITH v AS ({_REQUEST_SQL}), j AS (SELECT doc_id, CASE WHEN json_valid(value) THEN value ELSE '{{}}' END AS j FROM v), r AS (SELECT doc_id, j->>'$.text' AS text, j->>'$.source_type' AS source_type, j->>'$.source_name' AS name, coalesce(CAST(j->>'$.include_signal_brief' AS BOOLEAN), true) AS include_signal_brief FROM j)
SELECT doc_id, text, source_type, coalesce(nullif(substring(name, 1, 200), ''), 'unknown') AS source_name, '' AS source_url, include_signal_brief, CASE WHEN trim(coalesce(text, '')) = '' THEN 'bad_request' ELSE 'ok' END AS status FROM r""")
def q_json_requests(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 11 == 5, " ").otherwise(F.concat(F.lit("T "), k.cast("string")))
    name = F.when(k % 2 == 0, F.repeat(F.lit("n"), (199 + k % 5).cast("int"))).otherwise("")
    brief = F.when(k % 3 == 0, ', "include_signal_brief": false').otherwise("")
    json = F.concat(F.lit('{"text": "'), text, F.lit('", "source_type": "'), _pick(C.TYPES, k), F.lit('", "source_name": "'), name, F.lit('"'), brief, F.lit("}"))
    lines = C.table(spark, d, "part").select(k.alias("doc_id"), F.when(k % 7 == 3, F.concat(F.lit("no json "), k.cast("string"))).otherwise(json).alias("value"))
    return readers.validate(readers.parsed(lines)).drop("value").withColumn("include_signal_brief", F.coalesce("include_signal_brief", F.lit(True)))


# comparisons of one to twelve documents

LABELS = ("30-Year Treasury", "10-Year Treasury", "5-Year Treasury", "2-Year Treasury", "S&P 500", "Nasdaq Composite", "Dow Jones", "Russell 2000", "Brent crude", "WTI crude", "Gold", "VIX", "Dollar Index", "EUR/USD", "USD/JPY", "CPI", "PPI", "PCE", "PMI", "GDP", "jobless claims", "retail sales")
UNITS = (("", "%"), ("$", ""), ("", " bps"), ("", ""))


def cross_corpus(spark: SparkSession, d: str, orders: DataFrame | None = None) -> DataFrame:
    """A group for each 16 orders, of one document to all twelve, with three claims each: equal, near or far values."""
    rows = C.spread((C.table(spark, d, "orders") if orders is None else orders).select("o_orderkey"))
    rows = rows.select(F.floor(F.col("o_orderkey") / 16).alias("group_id"), (F.col("o_orderkey") % 16).cast("int").alias("doc_idx")).where("doc_idx <= group_id % 12")
    g, i = F.col("group_id"), F.col("doc_idx")
    whole = F.when(g % 2 == 0, 3).otherwise(90 + g % 7) + i * (F.floor(g / 3) % 2)
    number = F.concat(whole.cast("string"), F.lit("."), (i * (g % 3) % 10).cast("string"))
    crude = g % 5 == 0
    labels = (_pick(LABELS, g), F.when(crude, "WTI crude").otherwise(_pick(LABELS, g + 8 + g % 2)), F.when(crude, "Brent crude").otherwise(_pick(LABELS, g + i)))
    lines = [F.concat(F.lit("The "), label, F.lit(": "), _pick([u for u, _ in UNITS], g + n), number, _pick([u for _, u in UNITS], g + n), F.lit("\n")) for n, label in enumerate(labels)]
    text = F.when((g % 17 == 3) & (i == 0), " ").otherwise(F.concat(*lines))
    return rows.select("group_id", "doc_idx", text.alias("text"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("desk "), i.cast("string"))).alias("source_name"))


_LABEL = (O.pick(LABELS, "group_id"), f"CASE WHEN group_id % 5 = 0 THEN 'WTI crude' ELSE {O.pick(LABELS, 'group_id + 8 + group_id % 2')} END", f"CASE WHEN group_id % 5 = 0 THEN 'Brent crude' ELSE {O.pick(LABELS, 'group_id + doc_idx')} END")
_CROSS_LINES = ", ".join(f"'The ', {label}, ': ', {O.pick([u for u, _ in UNITS], f'group_id + {n}')}, number, {O.pick([u for _, u in UNITS], f'group_id + {n}')}, chr(10)" for n, label in enumerate(_LABEL))
CROSS_SQL = f"""SELECT group_id, doc_idx, CASE WHEN group_id % 17 = 3 AND doc_idx = 0 THEN ' ' ELSE concat({_CROSS_LINES}) END AS text, CASE WHEN doc_idx % 5 = 0 THEN concat('doc_', CAST(doc_idx + 1 AS VARCHAR)) ELSE concat('desk ', CAST(doc_idx AS VARCHAR)) END AS source_name FROM (
  SELECT group_id, doc_idx, concat(CAST(CASE WHEN group_id % 2 = 0 THEN 3 ELSE 90 + group_id % 7 END + doc_idx * ((group_id // 3) % 2) AS VARCHAR), '.', CAST(doc_idx * (group_id % 3) % 10 AS VARCHAR)) AS number
  FROM (SELECT o_orderkey // 16 AS group_id, o_orderkey % 16 AS doc_idx FROM orders) WHERE doc_idx <= group_id % 12)"""
_KEYS = ["group_id", "doc_idx", "source_name"]


@query(O.entities(CROSS_SQL) + "SELECT group_id, entity_key, n_values, n_docs, low, high, spread, status FROM entities")
def q_cross_entities(spark, d):
    return K.entities(K.claims(cross_corpus(spark, d), _KEYS)).select("group_id", "entity_key", "n_values", "n_docs", "low", "high", "spread", "status")


_SIZED = ", sizes AS (SELECT group_id, count(*) AS doc_count FROM c GROUP BY ALL)"
_SEEN = ", seen AS (SELECT group_id, entity_key, min(doc_idx * 1000000 + pass * 100000 + nth) AS first_at FROM claims GROUP BY ALL), l AS (SELECT e.*, seen.first_at FROM entities e JOIN seen USING (group_id, entity_key) JOIN sizes USING (group_id) WHERE doc_count >= 2)"
_LISTS = {"shared_claims": "status <> 'unique'", "unique_claims": "status = 'unique'", "conflicts": "status = 'conflict'", "alignment": "status = 'alignment'"}


@query(O.entities(CROSS_SQL) + _SIZED + _SEEN + " " + " UNION ALL ".join(f"SELECT group_id, '{k}' AS list, row_number() OVER (PARTITION BY group_id ORDER BY first_at) - 1 AS pos, entity_key, round(spread, 5) AS spread, n_values FROM l WHERE {c}" for k, c in _LISTS.items()))
def q_cross_lists(spark, d):
    rows = K.compare(cross_corpus(spark, d))
    parts = [rows.select("group_id", F.lit(k).alias("list"), F.posexplode(k).alias("pos", "x")) for k in _LISTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("group_id", "list", F.col("pos").cast("bigint").alias("pos"), "x.entity_key", "x.spread", "x.n_values")


_FOLLOW = ", ".join(f"CASE WHEN len(list_intersect(keys, {O.listed(k)})) > 0 THEN {O.q(K.FOLLOW_UPS[n])} END" for n, k in O.L.FOLLOW_UP_KEYS)


def summary_sql(corpus: str) -> str:
    """Notes, follow-ups and summary of each group of a corpus."""
    return O.entities(corpus) + _SIZED + f""", t AS (SELECT group_id, doc_count, doc_count >= 2 AS enough, coalesce(bool_or(crude), false) AS crude, count(*) FILTER (status = 'conflict') AS n, count(*) FILTER (status <> 'unique') AS m, coalesce(list(entity_key) FILTER (entity_key IS NOT NULL), []) AS keys FROM sizes LEFT JOIN entities USING (group_id) GROUP BY ALL)
SELECT group_id, doc_count, CASE WHEN enough AND crude THEN {O.q(K.CRUDE_NOTE)} ELSE '' END AS crude_note, CASE WHEN enough THEN array_to_string(list_filter([{_FOLLOW}], lambda x: x IS NOT NULL), ' | ') ELSE '' END AS follow_ups,
  CASE WHEN NOT enough THEN 'Too few documents to compare.' WHEN n > 0 THEN printf('%d conflicting number(s) in %d documents with %d shared claim(s). Check times and definitions before passing on.', n, doc_count, m)
    WHEN m > 0 THEN printf('No conflicts in %d shared claim(s) of %d documents; values agree within tolerance.', m, doc_count) ELSE printf('No shared numeric claims in %d documents.', doc_count) END AS triage_summary FROM t"""


@query(summary_sql(CROSS_SQL))
def q_cross_summary(spark, d):
    rows = K.compare(cross_corpus(spark, d))
    return rows.select("group_id", "doc_count", "crude_note", F.array_join("follow_up_sources", " | ").alias("follow_ups"), "triage_summary")


@query(O.entities(CROSS_SQL) + _SIZED + _SEEN + f""", v AS (SELECT group_id, entity_key, array_to_string(list(concat(source_name, ': ', raw_value) ORDER BY doc_idx, pass, nth)[1:3], '  vs  ') AS said, any_value(entity_label) AS label FROM claims GROUP BY ALL),
k AS (SELECT l.group_id, l.first_at, concat('  · ', label, ': ', said) AS line, row_number() OVER (PARTITION BY l.group_id ORDER BY l.first_at) AS nth FROM l JOIN v USING (group_id, entity_key) WHERE status = 'conflict')
SELECT group_id, concat('CONFLICTS:', chr(10), string_agg(line, chr(10) ORDER BY first_at)) AS part FROM k WHERE nth <= 5 GROUP BY ALL""")
def q_cross_capsule(spark, d):
    rows = K.compare(cross_corpus(spark, d)).select("group_id", F.split(render.compare_capsule(), "\n").alias("l"))
    part = F.array_join(F.filter("l", lambda x: x.startswith("CONFLICTS:") | x.startswith("  · ")), "\n")
    return rows.select("group_id", part.alias("part")).where("part <> ''")


@query(f"WITH c AS ({CROSS_SQL}), n AS (SELECT group_id, count(*) AS k, count(*) FILTER (trim(text) = '') AS blank FROM c GROUP BY ALL) SELECT group_id, doc_idx, source_name, CASE WHEN k < 2 THEN 'too_few' WHEN k > 10 THEN 'too_many' WHEN blank > 0 THEN 'bad_request' ELSE 'ok' END AS status FROM c JOIN n USING (group_id)")
def q_cross_validate(spark, d):
    return readers.validate_groups(cross_corpus(spark, d)).select("group_id", F.col("doc_idx").cast("bigint").alias("doc_idx"), "source_name", "status")


# briefs and renderings, line by line

_FIELDS = {
    "generic": {"caveat": ["source_caveats"], "missing": ["missing_receipts"], "key": ["key_signals"], "framing": ["interpretation_or_framing"]},
    "snapshot": {"caveat": ["source_caveats"], "key": ["key_signals"], "framing": ["interpretation_or_framing"]},
    "macro": {"caveat": ["source_caveats"], "key": ["key_signals"], "attributed": ["attributed_claims"]},
    "strategy": {"caveat": ["source_caveats"], "view": ["key_signals", "investment_views"], "forward": ["forward_looking_claims", "interpretation_or_framing"]},
}


def _compressed(text: str) -> str:
    head = f"substring({text}, 1, 200)"
    at = f"(CASE WHEN contains({head}, ' ') THEN 200 - instr(reverse({head}), ' ') ELSE -1 END)"
    return rf"CASE WHEN length({text}) <= 200 THEN {text} ELSE concat(regexp_replace(CASE WHEN {at} > 100 THEN substring({head}, 1, {at}) ELSE {head} END, '[\s.,;:\-–—(\[{{]+$', ''), '…') END"


def _brief_sql(corpus: str) -> str:
    parts = []
    for kind, fields in _FIELDS.items():
        genres = [g for g, k in B.KINDS.items() if k == kind]
        mine = f"genre IN ({', '.join(map(O.q, genres))})" if genres else f"genre NOT IN ({', '.join(map(O.q, B.KINDS))})"
        most = {"snapshot": 350, "macro": 400, "strategy": 400}.get(kind)
        keep = f"{O.n_words('s')} >= {5 if kind == 'generic' else 4}" + (f" AND length(s) <= {most}" if most else "")
        ranked = f"SELECT doc_id, class, {_compressed('s')} AS line, row_number() OVER (PARTITION BY doc_id, class ORDER BY i) AS pos FROM (SELECT doc_id, i, s, {O.sentence_class(kind)} AS class FROM t WHERE {mine} AND {keep}) WHERE class IS NOT NULL"
        for name, into in fields.items():
            parts += [f"SELECT doc_id, '{f}' AS field, pos, line FROM ({ranked}) WHERE class = '{name}' AND pos <= {B.CAPS[kind][f]}" for f in into]
    return O.scored(corpus) + ", t AS (SELECT doc_id, genre, unnest(sents) AS s, unnest(range(1, len(sents) + 1)) AS i FROM z) " + " UNION ALL ".join(parts)


def _brief_lines(docs: DataFrame) -> DataFrame:
    brief = F.col("signal_brief")
    named = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(brief[f], F.array().cast("array<string>")).alias("lines")) for f in ("source_caveats", "missing_receipts", "key_signals", "interpretation_or_framing", "attributed_claims", "investment_views", "forward_looking_claims")))
    rows = with_briefs(docs).select("doc_id", brief["genre"].alias("genre"), F.explode(named).alias("x")).select("doc_id", "genre", "x.field", F.posexplode("x.lines").alias("p", "line"))
    # lines that finance briefs add to the missing receipts are no sentences of the text
    rows = rows.where((F.col("field") != "missing_receipts") | ~F.col("genre").isin(*B.KINDS))
    return rows.select("doc_id", "field", (F.col("p") + 1).cast("bigint").alias("pos"), "line")


@query(_brief_sql(O.ORDERS))
def q_brief_lines(spark, d):
    return _brief_lines(C.orders_corpus(spark, d))


@query(_brief_sql(O.PARTS))
def q_brief_lines_parts(spark, d):
    return _brief_lines(C.parts_corpus(spark, d))


_BEFORE = "Stocks fell early on the NASDAQ and NYSE. Acme Metals ("  # before the first row of every text


@query(rf"""WITH c AS ({O.PARTS}), m AS (SELECT doc_id, unnest(range(1, 99)) AS i, regexp_extract_all(text, {O.rx('mover')}, 1) AS t FROM c), k AS (SELECT doc_id, i, t[i] AS ticker FROM m WHERE i <= len(t))
SELECT doc_id, ticker, CASE WHEN min(i) = 1 THEN trim(regexp_extract({O.q(_BEFORE[-50:])}, '([A-Za-z][A-Za-z\s&'',.\-]{{2,35}})\s*\(\s*$', 1)) ELSE '' END AS company FROM k WHERE ticker NOT IN ({', '.join(map(O.q, O.L.FAKE_TICKERS))}) GROUP BY ALL""")
def q_mover_companies(spark, d):
    return C.parts_corpus(spark, d).select("doc_id", F.explode(B.movers(F.col("text"))).alias("m")).select("doc_id", "m.ticker", "m.company")


def _sql_percent(x: str) -> str:
    return f"CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR)"


@query(O.scored(CASES_SQL) + f"""SELECT doc_id, concat('CUSTODY:   ', warning, '  (', {_sql_percent('round(overall, 3)')}, '% confidence  [', {_sql_percent('round(low, 3)')}, '–', {_sql_percent('round(high, 3)')}, '%])') AS custody_line, n_words AS word_count,
  anchored, unanchored, concat('effective=', eff, ' declared=', dec, ' inferred=', inf, ' confidence=', printf('%.2f', conf)) AS source_line FROM z""")
def q_report_lines(spark, d):
    """Lines of the capsule and the report as they are shown."""
    a = F.col("assessment")
    rows = assess(scored(cases_corpus(spark, d))).select("doc_id", F.split(render.capsule(a), "\n").alias("c"), F.split(render.report(a), "\n").alias("r"))
    line = lambda c, head: F.get(F.filter(c, lambda x: x.startswith(head)), F.lit(0))
    number = lambda head, what: F.regexp_extract(line("r", head), what, 1).cast("bigint")
    return rows.select(
        "doc_id", line("c", "CUSTODY:").alias("custody_line"), number("Words", r": (\d+)").alias("word_count"), number("Evidence       :", r" anchored=(\d+)").alias("anchored"), number("Evidence       :", r"unanchored=(\d+)").alias("unanchored"),
        F.regexp_replace(line("r", "Source type"), "^Source type    : ", "").alias("source_line"),
    )


# pages of every form

_BODY = "The bread &amp; the river went past the old mill while two boats lay still and the baker closed the door for the day. " * 5


def composed_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return C.spread(C.table(spark, d, "part").select("p_partkey")).select(k.alias("page_id"), F.replace(_pick([html for html, *_ in PAGES], k), F.lit("{k}"), k.cast("string")).alias("html"))


_PLAIN = _BODY.replace("&amp;", "&").strip()
#: (html, text, title, author, publisher); {k} is the page's number.
PAGES = (
    (f"<html><head><title>Mill {{k}} &amp; more</title><meta name='author' content='Ann {{k}}'></head><body><nav>All pages</nav><article><h1>HOME</h1><p>{_BODY}</p><p>Part {{k}}</p></article><p>outside</p></body></html>", f"{_PLAIN} Part {{k}}", "Mill {k} & more", "Ann {k}", None),
    (f"<html><head><meta property='og:site_name' content='Site {{k}}'><meta property='article:author' content='Bea'></head><body><main class='x'><p>{_BODY}</p><p>Share</p><p>ABOUT US</p><p>A 1</p></main><footer>end</footer></body></html>", f"{_PLAIN} A 1", None, "Bea", "Site {k}"),
    (f"<html><head><script type='application/ld+json'>{{\"@graph\": [{{\"author\": [{{\"name\": \"Cy {{k}}\"}}]}}, {{\"publisher\": {{\"name\": \"Press\"}}}}]}}</script></head><body><p>before</p><div class='entry-content'><p>{_BODY}</p></div></body></html>", _PLAIN, None, "Cy {k}", "Press"),
    (f"<html><head><title>Short part</title><meta name='publisher' content='Pub'></head><body><article><p>Only {{k}} words.</p></article><p>{_BODY}</p></body></html>", f"Only {{k}} words. {_PLAIN}", "Short part", None, "Pub"),
    (f"Plain {{k}} text. {_PLAIN}", f"Plain {{k}} text. {_PLAIN}", None, None, None),
    ("<html><head><title>Nothing {k}</title></head><body><script>var x = 1;</script><p>Hi {k}</p></body></html>", "", "Nothing {k}", None, None),
)


def _page_sql(column: int) -> str:
    return "CASE " + " ".join(f"WHEN p_partkey % {len(PAGES)} = {n} THEN " + ("NULL" if p[column] is None else f"replace({O.q(p[column])}, '{{k}}', CAST(p_partkey AS VARCHAR))") for n, p in enumerate(PAGES)) + " END"


@query(f"SELECT p_partkey AS page_id, {_page_sql(1)} AS text, CASE WHEN {_page_sql(1)} = '' THEN {O.q(P.TOO_LITTLE)} ELSE '' END AS error, {_page_sql(2)} AS title, {_page_sql(3)} AS author, {_page_sql(4)} AS publisher FROM part")
def q_html_composed(spark, d):
    return P.clean(composed_pages(spark, d)).select("page_id", "page.*")


@query(f"SELECT p_partkey AS page_id, coalesce(nullif(concat_ws(' / ', {_page_sql(3)}, {_page_sql(4)}), ''), 'unknown') AS source_name FROM part")
def q_html_source_name(spark, d):
    return P.page_documents(composed_pages(spark, d).withColumn("url", F.lit(""))).select("page_id", "source_name")
