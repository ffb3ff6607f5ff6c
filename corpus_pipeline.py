"""Documents to packed training sequences: quality classifier, near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. ``run`` applies them to the documents table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Stored, table
from quillspark.llm.minhash_dedup import near_documents
from quillspark.llm.packing import pack
from quillspark.llm.pii import accepted, candidates, fit
from quillspark.llm.quality import classify
from quillspark.llm.spans import replaced


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows with the doc_id (null or not) and text of a row of gone (doc_id, text_hash)."""
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    marked = docs.withColumn("__id", key)
    ids = gone.select("doc_id", "text_hash").distinct()
    same = marked["__id.doc_id"].eqNullSafe(ids["doc_id"]) & (marked["__id.text_hash"] == ids["text_hash"])
    return marked.join(ids, same, "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text lies above its language's perplexity."""
    return _without(docs, classify(docs, table(spark, sf_dir, "labels")).where("NOT kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class, once if its row is repeated; rows without doc_id stay."""
    kept = _without(docs, near_documents(docs).where("NOT kept")).withColumn("__same", F.xxhash64("text"))
    once = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "__same"])
    return once.unionByName(kept.where("doc_id IS NULL")).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind's name in place of each span of personal data; null texts stay null."""
    found = candidates(docs.select(*(F.col(c) for c in docs.columns)), "text", "__found")
    model = fit(found, "__found")
    clean = replaced(F.col("text"), accepted(F.col("__found"), model), lambda x: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    return found.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, a row for each piece of a document."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]
#: A trained model, hashed signatures and a tokenizer have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read again, and dropped once the next one is written.

    What the last stage reads stays, for its rows are made when the result is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        written = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
