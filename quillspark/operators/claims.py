"""Numeric claims: extraction from text, and their comparison across the documents of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicon as L
from quillspark.functions import text as T
from quillspark.plans.shared import written

FOLLOW_UPS = {
    "treasury": "Treasury yield data of the issuer",
    "energy": "Energy statistics on crude prices and stocks",
    "labor": "Labor statistics releases for prices, claims and sales",
    "exchange": "Closing prices of the exchanges",
}
CRUDE_NOTE = "WTI and Brent are both present; they are different contracts and are not compared."


def entity(fragment: Column) -> Column:
    """struct(key, label) of the first rule that matches; null if none does."""
    out = None
    for pattern, key, label in L.ENTITIES:
        hit = fragment.rlike(L.jvm(pattern, fold=True))
        value = F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def parse_value(raw: Column) -> Column:
    """The number in a raw value; the middle of a tight range; null if it isn't one."""
    clean = F.regexp_replace(raw, r",|\$|/bbl|/oz", "")
    clean = T.strip(F.regexp_replace(T.strip(clean), L.jvm(r"\s+per\s+(?:barrel|oz(?:ounce)?)", fold=True), ""))
    low, high = (F.regexp_extract(clean, r"^([+-]?\d+\.?\d*)[-–](\d+\.?\d*)", i) for i in (1, 2))
    middle = T.py_round((low.try_cast("double") + high.try_cast("double")) / 2.0, 5)
    plain = F.regexp_replace(clean, "[% ]+$", "")
    number = F.when(plain.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
    return F.when(low != "", middle).otherwise(number)


def unit(raw: Column) -> Column:
    return F.when(F.contains(raw, F.lit("%")), "%").when(F.contains(raw, F.lit("bps")), "bps").when(raw.rlike(r"\$|/bbl|/oz"), "$").otherwise("")


def _hits(text: Column, pattern: str, pass_: int) -> Column:
    p = F.lit(L.jvm(pattern, fold=True))
    parts = F.arrays_zip(*(F.regexp_extract_all(text, p, i) for i in range(3)))  # whole match, label, value
    return F.transform(parts, lambda x, i: F.struct(F.lit(pass_).alias("pass"), i.alias("at"), T.strip(x["1"]).alias("fragment"), T.strip(x["2"]).alias("raw"), F.substring(x["0"], 1, 120).alias("context")))


CLAIM = "struct<new:boolean,pos:int,key:string,number:double,label:string,raw:string,context:string,new_entity:boolean>"


def claim_array(text: Column) -> Column:
    """The claims of a text as an array of CLAIM, by entity and number, each entity and number once."""
    t = F.coalesce(text, F.lit(""))
    both = F.concat(_hits(t, L.COLON_CLAIM, 1), _hits(t, L.INLINE_CLAIM, 2))
    named = F.transform(both, lambda x, i: F.struct(entity(x["fragment"]).alias("entity"), parse_value(x["raw"]).alias("number"), i.alias("pos"), x["raw"], x["context"]))
    known = F.filter(named, lambda x: x["entity"].isNotNull() & x["number"].isNotNull())
    ordered = F.array_sort(F.transform(known, lambda x: F.struct(x["entity"]["key"].alias("key"), x["number"], x["pos"], x["entity"]["label"].alias("label"), x["raw"], x["context"])))
    last = "struct<key:string,number:double>"
    marked = T.scan(
        ordered, F.struct(F.lit("").alias("key"), F.lit(0.0).alias("number")), last, CLAIM, lambda _, x: F.struct(x["key"], x["number"]),
        lambda was, x: F.struct((was["key"] != x["key"]) | (was["number"] != x["number"]), x["pos"], x["key"], x["number"], x["label"], x["raw"], x["context"], was["key"] != x["key"]),
    )
    return F.filter(marked, lambda x: x["new"])


def claims(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A row for each claim: keys, pos, entity_key, entity_label, raw_value, numeric_value, unit, context, new_entity.

    Labelled lines come before inline mentions; of the same entity and number in one document the first stays.
    keys name a document, of one row; new_entity marks one claim of each entity in it. A document's claims are
    sorted and read once, so its cost follows its length, and nothing is shuffled.
    """
    rows = df.select(*keys, F.explode(claim_array(F.col(text))).alias("c"))
    return rows.select(*keys, "c.pos", F.col("c.key").alias("entity_key"), F.col("c.label").alias("entity_label"), F.col("c.raw").alias("raw_value"), F.col("c.number").alias("numeric_value"), unit(F.col("c.raw")).alias("unit"), "c.context", "c.new_entity")


#: Values that a comparison lists for each entity; the table of claims has them all.
LISTED = 100
_SALTS = 64


def first_values(found: DataFrame, group: str, k: int) -> DataFrame:
    """group, entity_key and ``values``: the first k by (doc_idx, pos). No task sends or holds more than k of an entity and salt.

    Ranks are limited before each exchange: first within parts of an entity by salt, then among what is left of it.
    """
    value = F.struct("doc_idx", "pos", F.col("source_name").alias("source"), F.col("numeric_value").alias("value"), "unit", F.col("raw_value").alias("raw"))
    rows = found.select(group, "entity_key", value.alias("v"), F.pmod(F.xxhash64("doc_idx", "pos"), F.lit(_SALTS)).alias("salt"))
    for keys in ([group, "entity_key", "salt"], [group, "entity_key"]):
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("v"))).where(F.col("nth") <= k)
    return rows.groupBy(group, "entity_key").agg(F.sort_array(F.collect_list("v")).alias("values"))


def _judged(item: Column, crude: Column) -> Column:
    """item with spread and status: unique, shared (crude benchmarks that are both present), conflict or alignment."""
    spread = item["high"] - item["low"]
    reference = F.when(item["low"] != 0, F.abs(item["low"])).otherwise(1.0)
    conflict = F.when(item["small"], spread > 0.15).otherwise(spread > reference * 0.02)
    status = F.when(item["n_values"] == 1, "unique").when(crude & item["entity_key"].isin(*L.CRUDE_KEYS), "shared").when(conflict, "conflict").otherwise("alignment")
    return item.withField("spread", spread).withField("status", status)


def _both_crudes(items: Column) -> Column:
    return F.size(F.array_intersect(F.transform(items, lambda x: x["entity_key"]), F.array(*map(F.lit, L.CRUDE_KEYS)))) == 2


def grouped(found: DataFrame, group: str = "group_id", k: int = LISTED) -> DataFrame:
    """A row for each group with claims: crude (both benchmarks are present) and items, its entities in first-seen order.

    An item has counts, range, smallness and place of its first claim, which are aggregated in part before the shuffle,
    and the first k values (none for k = 0, which spares their passes). A group has at most one item for each entity
    that there is, so its row is bounded however many claims it has.
    """
    by = found.groupBy(group, "entity_key").agg(
        F.first("entity_label").alias("entity_label"), F.count("*").alias("n_values"), F.count_if("new_entity").alias("n_docs"), F.min(F.struct("doc_idx", "pos")).alias("seen"),
        F.min("numeric_value").alias("low"), F.max("numeric_value").alias("high"), F.bool_and(F.abs("numeric_value") < 20).alias("small"),
    )
    fields = ["seen", "entity_key", "entity_label", "n_values", "n_docs", "low", "high", "small"]
    if k:
        by, fields = by.join(first_values(found, group, k), [group, "entity_key"]), [*fields, "values"]
    rows = by.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    crude = _both_crudes(F.col("items"))
    return rows.select(group, crude.alias("crude"), F.transform("items", lambda x: _judged(x, crude)).alias("items"))


def items_of(found: Column, k: int = LISTED) -> Column:
    """The items of grouped() from an array of one group's claims, for groups that are gathered anyway."""
    keys = F.array_distinct(F.transform(found, lambda x: x["entity_key"]))

    def item(key: Column) -> Column:
        return T.bound(F.filter(found, lambda x: x["entity_key"] == key), lambda own: F.struct(
            F.array_min(F.transform(own, lambda x: F.struct(x["doc_idx"], x["pos"]))).alias("seen"), key.alias("entity_key"), own[0]["entity_label"].alias("entity_label"),
            F.size(own).cast("bigint").alias("n_values"), F.size(F.filter(own, lambda x: x["new_entity"])).cast("bigint").alias("n_docs"),
            F.array_min(F.transform(own, lambda x: x["numeric_value"])).alias("low"), F.array_max(F.transform(own, lambda x: x["numeric_value"])).alias("high"), F.forall(own, lambda x: F.abs(x["numeric_value"]) < 20).alias("small"),
            F.slice(F.sort_array(F.transform(own, lambda x: F.struct(x["doc_idx"], x["pos"], x["source_name"].alias("source"), x["numeric_value"].alias("value"), x["unit"], x["raw_value"].alias("raw")))), 1, k).alias("values"),
        ))

    made = F.sort_array(F.transform(keys, item))
    return T.bound(made, lambda items: T.bound(_both_crudes(items), lambda crude: F.transform(items, lambda x: _judged(x, crude))))


def entities(found: DataFrame, group: str = "group_id", k: int = 0) -> DataFrame:
    """A row for each entity of each group, from claims with doc_idx and source_name: counts, range, spread, status; for k > 0 the first k values."""
    rows = grouped(found, group, k).select(group, "crude", F.explode("items").alias("x"))
    return rows.select(group, "crude", "x.*")


def named(docs: DataFrame) -> DataFrame:
    """docs with a source_name: a missing one is doc_ and the document's place."""
    return docs.withColumn("source_name", F.coalesce(F.nullif(F.col("source_name"), F.lit("")), F.concat(F.lit("doc_"), (F.col("doc_idx") + 1).cast("string"))))


def compare(docs: DataFrame, group: str = "group_id", k: int = LISTED) -> DataFrame:
    """A row for each group of documents (group, doc_idx, source_name, text): lists in first-seen order, note, follow-ups, summary.

    A group of fewer than two documents has an error and empty lists. A missing name is doc_ and its place. Lists give
    the first k values of each entity and the number of all; claims are written to the shared folder once for k > 0.
    """
    docs = named(docs)
    sizes = docs.groupBy(group).agg(F.count("*").alias("doc_count"))
    found = claims(docs, [group, "doc_idx", "source_name"])
    return compared(sizes.join(grouped(written(found, "claims") if k else found, group, k), group, "left"), group)


def compared(whole: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows of group, doc_count and items (null: none) as comparisons; other columns stay."""
    kept = [c for c in whole.columns if c not in (group, "doc_count", "items", "crude")]
    kind = dict(whole.dtypes)["items"]
    whole = whole.withColumn("items", F.coalesce("items", F.array().cast(kind)))
    enough = F.col("doc_count") >= 2
    pick = lambda *s: F.filter("items", lambda x: enough & x["status"].isin(*s))
    slim = lambda items: F.transform(items, lambda x: x.dropFields("low", "high", "small", "n_docs").withField("spread", T.py_round(x["spread"], 5)))
    lists = {"shared_claims": ("conflict", "alignment", "shared"), "unique_claims": ("unique",), "conflicts": ("conflict",), "alignment": ("alignment",)}
    note = F.when(enough & _both_crudes(F.col("items")), CRUDE_NOTE).otherwise("").alias("crude_note")
    whole = whole.select(group, "doc_count", *kept, F.when(~enough, "a comparison needs two documents or more").alias("error"), *(slim(pick(*s)).alias(name) for name, s in lists.items()), note)
    keys = F.concat(*(F.transform(c, lambda x: x["entity_key"]) for c in ("shared_claims", "unique_claims")))
    follow = F.filter(F.array(*(F.when(F.arrays_overlap(keys, F.array(*map(F.lit, k))), F.lit(FOLLOW_UPS[n])) for n, k in L.FOLLOW_UP_KEYS)), lambda x: x.isNotNull())
    n, m, d = F.size("conflicts"), F.size("shared_claims"), F.col("doc_count")
    summary = (
        F.when(~enough, "Too few documents to compare.")
        .when(n > 0, F.format_string("%d conflicting number(s) in %d documents with %d shared claim(s). Check times and definitions before passing on.", n, d, m))
        .when(m > 0, F.format_string("No conflicts in %d shared claim(s) of %d documents; values agree within tolerance.", m, d))
        .otherwise(F.format_string("No shared numeric claims in %d documents.", d))
    )
    return whole.withColumns({"follow_up_sources": follow, "triage_summary": summary})


def claim_pairs(found: DataFrame, group: str = "group_id") -> DataFrame:
    """Pairs of claims on one entity in two documents of a group, with the difference; dealt out by group and entity."""
    a, b = found.alias("a"), found.alias("b")
    on = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.entity_key") == F.col("b.entity_key")) & (F.col("a.doc_idx") < F.col("b.doc_idx"))
    return a.join(b, on).select(F.col(f"a.{group}").alias(group), F.col("a.entity_key").alias("entity_key"), F.col("a.doc_idx").alias("doc_a"), F.col("b.doc_idx").alias("doc_b"), F.col("a.numeric_value").alias("value_a"), F.col("b.numeric_value").alias("value_b"), F.abs(F.col("a.numeric_value") - F.col("b.numeric_value")).alias("difference"))


def pair_summary(found: DataFrame, group: str = "group_id") -> DataFrame:
    """n_pairs and widest, the number of claim_pairs() and their greatest difference, by group and entity; linear, as no pair is made.

    A row for each document, group and entity is written to the shared folder once, as it is read twice. Of n claims, n_d of them in document d, (n**2 - sum of n_d**2) / 2 pairs are of two documents. The widest of them has the
    highest or the lowest value; where one document has both, it is between these and the values of the others.
    """
    by, value = [group, "entity_key"], F.col("numeric_value")
    docs = found.where(F.col(group).isNotNull() & F.col("entity_key").isNotNull() & F.col("doc_idx").isNotNull()).groupBy(*by, "doc_idx").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    docs = written(docs, "claims-by-document")
    first = lambda c: F.when(F.col(c).isNotNull(), F.struct(c, "doc_idx"))
    ends = docs.groupBy(*by).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("own"), F.max(first("high")).alias("top"), F.min(first("low")).alias("bottom"))
    ends = ends.where("all * all > own").withColumn("n_pairs", F.expr("(all * all - own) div 2"))
    one = F.col("top.doc_idx") == F.col("bottom.doc_idx")
    other = F.col("doc_idx") != F.col("top.doc_idx")
    rest = F.greatest(F.col("top.high") - F.min(F.when(other, F.col("low"))), F.max(F.when(other, F.col("high"))) - F.col("bottom.low"))
    made = docs.drop("n").join(ends, by).groupBy(*by, "n_pairs", "top", "bottom").agg(rest.alias("rest"))
    return made.select(*by, "n_pairs", F.when(one, F.col("rest")).otherwise(F.col("top.high") - F.col("bottom.low")).alias("widest"))
