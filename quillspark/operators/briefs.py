"""Briefs: sentences sorted into classes, market movers, and what to check next, by genre."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T

#: field: most entries, by genre; a field that a genre doesn't have is null.
CAPS = {
    "snapshot": {"top_movers": 12, "key_signals": 8, "source_caveats": 5, "interpretation_or_framing": 6, "missing_receipts": 6, "do_not_pass_forward_as": 5, "follow_up_sources": 5},
    "generic": {"key_signals": 8, "source_caveats": 5, "interpretation_or_framing": 6, "missing_receipts": 4, "do_not_pass_forward_as": 4, "follow_up_sources": 4},
    "macro": {"key_signals": 10, "attributed_claims": 5, "source_caveats": 4, "interpretation_or_framing": 4, "missing_receipts": 6, "do_not_pass_forward_as": 3, "follow_up_sources": 5},
    "strategy": {"key_signals": 8, "investment_views": 8, "forward_looking_claims": 6, "house_view_warning": 1, "source_caveats": 4, "interpretation_or_framing": 4, "missing_receipts": 6, "do_not_pass_forward_as": 3, "follow_up_sources": 4},
}
KINDS = {"financial_market_snapshot": "snapshot", "global_macro_market_update": "macro", "investment_strategy_commentary": "strategy"}
FIELDS = ("top_movers", "key_signals", "attributed_claims", "investment_views", "forward_looking_claims", "house_view_warning", "source_caveats", "interpretation_or_framing", "missing_receipts", "do_not_pass_forward_as", "follow_up_sources")


def key_signal(sent: Column) -> Column:
    """A number, with a word of attribution or twelve words."""
    return T.has(sent, "signal_number") & (T.has(sent, "signal_attribution") | (T.n_words(sent) >= 12))


def _classes(sent: Column, kind: str) -> list[tuple[Column, str]]:
    """The conditions of a kind's classes, in the order in which they are asked."""
    caveat, missing, framing = (T.has(sent, "caveat"), "caveat"), (T.has(sent, "missing"), "missing"), (T.has(sent, "interpretation"), "framing")
    if kind == "snapshot":
        signal = sent.rlike(T.pattern("ticker_price")) | T.has(sent, "breadth") | T.has(sent, "session") | T.has(sent, "provider") | T.has(sent, "listed_venue")
        return [caveat, missing, (signal, "key"), framing]
    if kind == "macro":
        spoken = T.has(sent, "statement_verb") & (sent.rlike("[\"“]") | T.has(sent, "name_pair"))
        return [caveat, (key_signal(sent) & (T.has(sent, "macro_indicators") | T.has(sent, "macro_regions")), "key"), (spoken, "attributed"), (key_signal(sent), "key")]
    if kind == "strategy":
        return [caveat, (T.has(sent, "allocation") & T.has(sent, "view_words"), "view"), (T.has(sent, "forward_looking"), "forward"), (key_signal(sent), "view")]
    return [caveat, missing, (key_signal(sent), "key"), framing]


def sentence_class(sent: Column, kind: str, wanted: tuple[str, ...] = ()) -> Column:
    """caveat, missing, key, attributed, view, forward, framing, or null; the first that fits. wanted: null for all other classes, and none is asked for behind the last of these."""
    asked = _classes(sent, kind)
    if wanted:
        asked = asked[: max((n for n, (_, name) in enumerate(asked) if name in wanted), default=-1) + 1]
    out = None
    for condition, name in asked:
        name = F.lit(name) if not wanted or name in wanted else F.lit(None).cast("string")
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(None).cast("string") if out is None else out


def sentence_kept(sent: Column, kind: str) -> Column:
    """Length limits: few words say nothing, very long lines are tables."""
    most = {"snapshot": 350, "macro": 400, "strategy": 400}.get(kind)
    enough = T.n_words(sent) >= (5 if kind == "generic" else 4)
    return enough if most is None else enough & (F.length(sent) <= most)


def classified(sents: Column, kind: str, wanted: tuple[str, ...] = ()) -> Column:
    """array of struct(class, item): the compressed sentences that have a class, one of wanted if these are named."""
    if not wanted:
        kept = F.filter(sents, lambda s: sentence_kept(s, kind))
        both = F.transform(kept, lambda s: F.struct(sentence_class(s, kind).alias("class"), T.compress(s).alias("item")))
        return F.filter(both, lambda x: x["class"].isNotNull())
    kept = F.filter(F.transform(sents, lambda s: F.struct(F.when(sentence_kept(s, kind), sentence_class(s, kind, wanted)).alias("class"), s.alias("s"))), lambda x: x["class"].isNotNull())
    return F.transform(kept, lambda x: F.struct(x["class"].alias("class"), T.compress(x["s"]).alias("item")))


def of_class(items: Column, name: str) -> Column:
    return F.transform(F.filter(items, lambda x: x["class"] == name), lambda x: x["item"])


def movers(text: Column) -> Column:
    """array of struct(ticker, price, change, company): the first row of each ticker that is none of the known words.

    The company is what stands in the 50 characters before, ahead of an opening bracket.
    """
    row = lambda cut, p: F.struct(
        F.regexp_extract(p["m"], L.jvm(L.CASED["mover"]), 1).alias("ticker"),
        p["s"].alias("at"),
        F.replace(F.regexp_extract(p["m"], r"C?\$\s*\d+(?:\.\d+)?", 0), F.lit(" "), F.lit("")).alias("price"),
        F.regexp_extract(p["m"], r"[-+]\d+(?:\.\d+)?%", 0).alias("change"),
        T.strip(F.regexp_extract(T.piece(cut, F.greatest(p["s"] - 50, F.lit(0)), F.least(p["s"], F.lit(50))), r"([A-Za-z][A-Za-z\s&',.\-]{2,35})\s*\(\s*$", 1)).alias("company"),
    )
    rows = T.bound(T.pieces(text), lambda cut: F.transform(T.places(text, "mover"), lambda p: row(cut, p)))
    real = F.array_sort(F.filter(rows, lambda x: ~x["ticker"].isin(*L.FAKE_TICKERS)))
    # by ticker and place, a row is the first of its ticker where the ticker before is another
    seen = T.scan(real, F.lit(""), "string", "struct<first:boolean,at:int,ticker:string,price:string,change:string,company:string>", lambda _, x: x["ticker"], lambda last, x: F.struct(last != x["ticker"], x["at"], x["ticker"], x["price"], x["change"], x["company"]))
    first = F.array_sort(F.filter(seen, lambda x: x["first"]))
    return F.transform(first, lambda x: F.struct(x["ticker"].alias("ticker"), x["price"].alias("price"), x["change"].alias("change"), x["company"].alias("company")))


def mover_line(x: Column) -> Column:
    return F.concat_ws("  ", x["ticker"], x["price"], x["change"], F.when(x["company"] != "", F.concat(F.lit("("), x["company"], F.lit(")"))))


def timeframe_mismatch(text: Column) -> Column:
    """Falling prices in the first 400 characters, and an index that is up anywhere."""
    return T.has(F.substring(text, 1, 400), "early_down") & T.has(text, "index_up")


def unexplained_move(text: Column) -> Column:
    """The first of the first two tickers with a two-digit move whose reason isn't given within 120 characters; null if none."""
    tickers = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(L.jvm(L.CASED["big_move"])), 1)), 1, 2)
    reason = L.FOLDED["move_reason"]
    bare = F.filter(tickers, lambda t: ~t.isin(*L.FAKE_TICKERS) & ~F.regexp_like(text, F.concat(F.lit(r"(?Ui)\b"), t, F.lit(r"\b.{0,120}" + reason))))
    return F.get(bare, F.lit(0))


def _lines(*pairs: tuple[Column | None, str | Column]) -> Column:
    """The lines whose conditions hold."""
    return F.filter(F.array(*(F.lit(t) if c is None and isinstance(t, str) else t if c is None else F.when(c, t) for c, t in pairs)), lambda x: x.isNotNull())


def brief(text: Column, sents: Column, effective: Column, genre: Column, providers: Column, venues: Column, kind: str, only: tuple[str, ...] = (), low: Column | None = None) -> Column:
    """struct of all fields for one kind of brief, or of those named; the sentences are classified once. low: the text in lower case, where it is at hand."""
    if only == ("missing_receipts",):
        # only such sentences are looked for, and of two kinds these lines are no sentences
        items = classified(sents, kind, ("missing",)) if kind in ("snapshot", "generic") else F.array().cast("array<struct<class:string,item:string>>")
    else:
        items = classified(sents, kind)
    return T.bound(items, lambda items: _brief(text, items, effective, genre, providers, venues, kind, only, F.lower(text) if low is None else low))


def _brief(text: Column, items: Column, effective: Column, genre: Column, providers: Column, venues: Column, kind: str, only: tuple[str, ...], low: Column) -> Column:
    named = T.unique_folded(F.concat(providers, venues))
    linked = low.rlike(L.jvm(L.PRIMARY_LINKS[kind]))
    get = lambda name: of_class(items, name)
    secondary, some = effective.isin(*L.SECONDARY_TYPES), F.size(providers) > 0
    two = F.array_join(F.slice(providers, 1, 2), ", ")
    unlinked = (some & ~linked, F.concat(two, F.lit(" is named as data source, and no link was checked here.")))
    word = lambda *w: low.rlike(L.jvm(L.whole(*w)))
    out: dict[str, Column] = {"source_caveats": get("caveat")}
    if kind == "snapshot":
        move = unexplained_move(text)
        otc = F.exists(get("caveat"), lambda s: F.contains(F.upper(s), F.lit("OTC")) | F.contains(F.lower(s), F.lit("prior close"))) | F.exists(venues, lambda v: F.contains(F.upper(v), F.lit("OTC")))
        out |= {
            "top_movers": F.transform(movers(text), mover_line), "key_signals": get("key"), "interpretation_or_framing": get("framing"),
            "missing_receipts": F.concat(get("missing"), _lines(unlinked, (secondary, "No filing, exchange quote, company release or raw data was checked here."), (timeframe_mismatch(text), "The opening speaks of falling prices while listed indices are up; the time frames may differ."))),
            "do_not_pass_forward_as": _lines((secondary, "Primary financial data; this is a secondary article."), (otc, "Live OTC data; such prices reflect a prior close."), (move.isNotNull(), F.concat(F.lit("Proof of why "), move, F.lit(" moved; the text gives no cause.")))),
            "follow_up_sources": _lines((F.exists(venues, lambda v: F.upper(v).isin("OTC", "OTC MARKETS")), "OTC Markets for current OTC quotes."), (some, F.concat(F.lit("Raw data at "), F.get(providers, F.lit(0)), F.lit("."))), (None, "Investor pages or regulatory filings of the companies named.")),
        }
    elif kind == "macro":
        receipts = _lines(
            (word("cpi", "ppi", "jobless claims", "retail sales"), "US labor statistics: prices and jobless claims."), (word("europe", "eurozone", "ecb", "stoxx", "ftse"), "Eurostat and ECB: output, prices and policy of the euro area."),
            (word("japan", "nikkei", "boj", "bank of japan"), "Japan's statistics bureau and central bank: prices and rate decisions."), (word("china", "pboc", "csi", "caixin"), "China's statistics bureau and central bank: surveys and trade."), unlinked,
        )
        out |= {
            "key_signals": get("key"), "attributed_claims": get("attributed"), "interpretation_or_framing": F.array().cast("array<string>"),
            "missing_receipts": F.when(F.size(receipts) > 0, receipts).otherwise(F.array(F.lit("No primary data was linked; check each indicator at its agency."))),
            "do_not_pass_forward_as": F.array(F.lit("Primary financial data; this is a secondary update on official releases.")),
            "follow_up_sources": _lines((None, "Labor statistics releases."), (None, "Transcripts of central banks for quoted statements."), (F.size(venues) > 0, F.concat(F.lit("Exchange data for index quotes: "), F.array_join(F.slice(venues, 1, 3), ", "), F.lit(".")))),
        }
    elif kind == "strategy":
        out |= {
            "key_signals": get("view"), "investment_views": get("view"), "forward_looking_claims": get("forward"), "interpretation_or_framing": get("forward"),
            "house_view_warning": F.array(F.lit("This is an asset manager's house view; its own positions and fees may shape it.")),
            "missing_receipts": _lines((word("earnings", "eps", "revenue"), "Earnings data behind the projections."), (word("spreads?", "default", "yield"), "The source of the credit spreads."), (word("inflation", "tips", "linkers"), "Inflation data behind the projections."), (None, "No independent primary data was checked; these are views on allocation.")),
            "do_not_pass_forward_as": F.array(F.lit("Primary financial data; this is commentary on strategy."), F.lit("Independent research; compare other managers or primary data.")),
            "follow_up_sources": F.array(F.lit("The issuer's full commentary with its method and disclosures."), F.lit("Primary data for each statistic cited."), F.lit("Views of other institutions.")),
        }
    else:
        out |= {
            "key_signals": get("key"), "interpretation_or_framing": get("framing"), "missing_receipts": get("missing"),
            "do_not_pass_forward_as": _lines((secondary | (effective == "tertiary"), "Primary source material; check key claims at the origin."), (some & ~linked, F.concat(F.lit("Direct output of "), F.get(providers, F.lit(0)), F.lit("; named and not linked.")))),
            "follow_up_sources": _lines((None, "The primary source of each main claim."), (F.size(named) > 0, F.concat(F.lit("Direct source: "), F.array_join(F.slice(named, 1, 2), ", "), F.lit(".")))),
        }
    caps = CAPS[kind]
    none = F.lit(None).cast("array<string>")
    head = [genre.alias("genre"), effective.alias("source_type"), named.alias("primary_data_named"), providers.alias("named_data_providers"), venues.alias("markets_venues_mentioned"), linked.alias("primary_data_verified")]
    return F.struct(*(() if only else head), *((F.slice(out[k], 1, caps[k]) if k in out else none).alias(k) for k in FIELDS if not only or k in only))


def brief_by_genre(make: Callable[[str], Column], genre: Column) -> Column:
    """make(kind) for the kind of the genre; the others are not evaluated."""
    out = None
    for name, kind in KINDS.items():
        out = F.when(genre == name, make(kind)) if out is None else out.when(genre == name, make(kind))
    return out.otherwise(make("generic"))
