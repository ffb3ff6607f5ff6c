"""Documents from files, JSON requests and examples, with the columns that analyze() reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

REQUEST = "text string, source_type string, source_name string, source_url string, include_signal_brief boolean"
PUBLIC_CHARS, KEYED_CHARS = 12_000, 50_000
MAX_URL, MAX_NAME, MAX_DOCS = 2_000, 200, 10

EXAMPLES = (
    ("pressure", "Act now!! This shocking, explosive secret is guaranteed. Everyone must watch before it's too late. Share this!", "social"),
    ("measured", "The agency published its dataset on 2024-03-05. According to the methodology, 412 sites reported 3.2 percent growth, however the sample size was small. \"We checked every log file twice,\" said Ada Moreno.", "primary"),
    ("bare", "The audit is proven and the evidence is undeniable. The transcript, the filing and the invoice say so. No doubt remains.", "primary"),
    ("hedged", "In my opinion the plan may help, although early evidence suggests it could also fail. I think we do not know enough.", "opinion"),
)


def examples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLES), "label string, text string, source_type string")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """A document for each file; bytes that are no UTF-8 become replacement characters."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_path"))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """A document for each JSON request, one a line; what isn't JSON gives nulls and fails validation."""
    return parsed(spark.read.text(path)).drop("value")


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with the fields of the JSON request in column value."""
    return lines.withColumn("__r", F.from_json(value, REQUEST)).select(*lines.columns, "__r.*")


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """A streaming source of documents: each line of the files that arrive below path."""
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def validate(docs: DataFrame, max_chars: int | Column = PUBLIC_CHARS, *, spaces: str | None = T.SPACES, null_is_blank: bool = True) -> DataFrame:
    """docs with ``status``: ok, bad_request (blank text) or text_too_long; name and URL filled and cut.

    spaces: the characters that leave a text blank, None to ask for its length only; null_is_blank: whether a text that
    is null is refused, too, as in requests, or has nothing that could be refused, as in SQL.
    """
    text = F.col("text").cast("string")
    text = F.coalesce(text, F.lit("")) if null_is_blank else text
    have = set(docs.columns)
    name = F.coalesce(F.nullif(F.substring(F.col("source_name").cast("string"), 1, MAX_NAME), F.lit("")), F.lit("unknown")) if "source_name" in have else F.lit("unknown")
    url = F.coalesce(F.substring(F.col("source_url").cast("string"), 1, MAX_URL), F.lit("")) if "source_url" in have else F.lit("")
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    blank = F.lit(False) if spaces is None else F.btrim(text, F.lit(spaces)) == ""
    status = F.when(blank, "bad_request").when(F.length(text) > limit, "text_too_long").otherwise("ok")
    return docs.withColumns({"source_name": name, "source_url": url, "status": status})


def validate_groups(docs: DataFrame, group: str = "group_id", max_chars: int = PUBLIC_CHARS) -> DataFrame:
    """docs of comparisons with ``status`` of the group: ok, too_few, too_many or bad_request; texts cut to the limit."""
    per = docs.groupBy(group).agg(F.count("*").alias("__n"), F.count_if(T.strip(F.coalesce("text", F.lit(""))) == "").alias("__blank"))
    status = F.when(F.col("__n") < 2, "too_few").when(F.col("__n") > MAX_DOCS, "too_many").when(F.col("__blank") > 0, "bad_request").otherwise("ok")
    named = F.coalesce(F.nullif(F.col("source_name"), F.lit("")), F.concat(F.lit("doc_"), (F.col("doc_idx") + 1).cast("string")))
    return docs.join(per, group).withColumns({"status": status, "source_name": named, "text": F.substring("text", 1, max_chars)}).drop("__n", "__blank")
