"""Word lists as tables: terms with weights and days of validity, matched to documents by their day.

A lexicon has a row for each list, term and period: list, term, weight, valid_from and valid_to (the first day on which
the row no longer holds; null: no end). Another version of a list is another set of periods, and needs no code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

LEXICON = "list string, term string, weight double, valid_from date, valid_to date"
#: Rows of a lexicon up to which it is sent to all executors; a row has a term of some words.
BROADCAST_ROWS = 200_000
#: Rows up to which its phrases are also looked for in a document's words, before any run of words becomes a row.
LITERAL_ROWS = 1_000


def phrase(term: Column) -> Column:
    """A term or text as lower-case words with one blank between them."""
    return F.array_join(_low(term), " ")


def _low(text: Column) -> Column:
    return F.transform(T.words(F.coalesce(text, F.lit(""))), F.lower)


def runs(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, with one blank between them; linear in the number of words."""
    out = [words]
    for n in range(2, longest + 1):  # the shorter array is padded with nulls, and concat() of a null is null
        behind = F.slice(words, n, F.greatest(F.size(words), F.lit(1)))
        out.append(F.filter(F.zip_with(out[-1], behind, lambda run, word: F.concat(run, F.lit(" "), word)), lambda run: run.isNotNull()))
    return F.concat(*out) if longest > 1 else words


def runs_of(words: Column, phrases: list[str]) -> Column:
    """Those of runs() that are one of the phrases; longer runs are made only where a phrase's first word stands."""
    out = []
    for n in sorted({p.count(" ") + 1 for p in phrases}):
        own = [p for p in phrases if p.count(" ") + 1 == n]
        made = words
        if n > 1:
            firsts = sorted({p.split(" ")[0] for p in own})
            made = F.transform(words, lambda w, i: F.when(w.isin(*firsts), F.concat(w, *(x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))))))
        out.append(F.filter(made, lambda run: run.isin(*own)))
    return F.concat(*out) if out else F.array().cast("array<string>")


def checked(lexicon: DataFrame) -> DataFrame:
    """The lexicon with its terms as phrases; rows without list, term, weight or first day are left out."""
    made = lexicon.withColumn("phrase", phrase(F.col("term"))).where("list IS NOT NULL AND phrase <> '' AND weight IS NOT NULL AND valid_from IS NOT NULL")
    return made.select("list", "phrase", "weight", "valid_from", "valid_to")


def list_hits(docs: DataFrame, lexicon: DataFrame, *, key: str = "doc_id", text: str = "text", day: str = "day") -> DataFrame:
    """A row for each document and list with hits: key, list, n_hits, n_terms (different ones) and weight, the sum over hits.

    A hit is a run of the document's words that is a term whose period holds on the document's day. A lexicon of up to
    BROADCAST_ROWS rows is broadcast after a count, and then only hits are shuffled, once; of one of up to LITERAL_ROWS rows,
    only runs that are phrases become rows. A larger one is joined by phrase to the counted runs of each document, where
    Spark splits common phrases. key names a document, of one row.
    """
    terms = checked(lexicon)
    about = terms.select(F.max(F.size(F.split("phrase", " "))).alias("longest"), F.count("*").alias("n")).first()
    words = docs.select(F.col(key).alias("__key"), F.col(day).cast("date").alias("__day"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    words = words.select("__key", "__day", F.coalesce(T.plain_words(F.col("__text")), _low(F.col("__text"))).alias("__words"))
    if about["n"] <= LITERAL_ROWS:
        some = runs_of(F.col("__words"), sorted(r["phrase"] for r in terms.select("phrase").distinct().collect()))
    else:
        some = runs(F.col("__words"), about["longest"] or 1)
    found = words.select("__key", "__day", F.explode(some).alias("phrase"))
    if about["n"] <= BROADCAST_ROWS:
        found, terms = found.withColumn("times", F.lit(1).cast("bigint")), F.broadcast(terms)
    else:
        found = found.groupBy("__key", "__day", "phrase").agg(F.count("*").alias("times"))
    holds = (F.col("__day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to")))
    hits = found.join(terms, "phrase").where(holds)
    if about["n"] <= BROADCAST_ROWS:  # both groupings then keep the rows where they are
        hits = hits.repartition("__key")
    by_term = hits.groupBy("__key", "list", "phrase").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("weight")).alias("weight"))
    by_list = by_term.groupBy("__key", "list").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_terms"), F.sum("weight").alias("weight"))
    return by_list.select(F.col("__key").alias(key), "list", "n_hits", "n_terms", "weight")
