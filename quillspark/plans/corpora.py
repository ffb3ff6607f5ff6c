"""Texts composed from the structured tables, so that every word list and form occurs; the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHRASES = (
    "The dataset covers 412 sites and the methodology is public.",
    "Act now, this shocking miracle is guaranteed to work!",
    "However, early evidence suggests the effect may be smaller.",
    "Everyone clearly knows this is proven and undeniable.",
    "Jane Moreno said \"we checked every single log file twice\" on Monday.",
    "The idiots must be purged before it's too late!!",
    "Shares and stocks on NASDAQ rose, and earnings beat the sector index.",
    "ABC - Holdings gained +12.5% while XYZ / Metals lost -3.4% and bonds added 25 bps at $14.20.",
    "We remain cautious and keep an overweight on equities with a strategic allocation.",
    "In our view a tactical upgrade and a risk-on house view are likely.",
    "CPI, GDP and inflation in Europe and Japan slowed, because retail sales fell.",
    "The filing and the audit are on record, and no announcement was made.",
    "Investors should subscribe, our product is sponsored by a paid partnership.",
    "I saw it myself and recorded the trial for 12 days.",
    "According to Reuters and Bloomberg the price was reported at market close.",
    "Basically it is really very simple, of course, trust me.",
    "Unnamed people are saying there is a rumor about the invoice.",
    "See https://www.sec.gov/filing and https://doi.org/10.1/x for the full report.",
    "More at https://news.example.com/a and https://x.com/b or http://agency.gov/c today.",
    "For immediate release: this press release has forward-looking statements.",
    "In my opinion the real issue is what nobody sees, and we should act.",
    "The tone is constructive and momentum could signal a bullish trend.",
    "Data provided by FactSet, prices reflect prior close, estimated and not live.",
    "The cause is unknown and unconfirmed, with no clear driver.",
    "NOBODY WANTS THESE LOUD WORDS WRITTEN LIKE THAT ALL THE TIME",
    "Monetary policy at the Bank of Japan and the ECB moved the yield curve and PMI.",
    "S&P 500 +0.4% and Dow 0.2% were up after markets fell early today.",
    "A plain sentence about trees, rivers and bread without any claim.",
)
TYPES = ("auto", "primary", "secondary", "official", "unknown", "opinion", "Social", "first_hand", "tertiary", "expert", "")
URLS = ("", "https://www.sec.gov/edgar/1", "https://news.example.com/story", "https://x.com/p/1", "https://www.nature.com/a", "https://investor.acme.com/ir/1", "https://blog.example.org/post", "http://agency.gov/data", "https://example.org/page")
#: (multiplier, offset, separator behind) of the phrases of a text.
PICKS = ((1, 0, " "), (3, 5, " "), (5, 2, "\n"), (11, 7, " "), (13, 9, " "), (17, 4, "\n"), (23, 1, ""))
CLAIM_LINES = {"click": ("CPI: ", "%"), "view": ("Gold: $", ""), "purchase": ("WTI crude: $", "/bbl"), "signup": ("The 10-year Treasury stands at ", "%"), "error": ("S&P 500 reached ", "")}


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


#: Rows of composed texts that a task scores, some seconds; a task's time then doesn't grow with the table.
TASK_ROWS = 20_000


def tasks(spark: SparkSession, rows: int) -> int:
    """All cores at least, and no more than TASK_ROWS rows in a task."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


#: Pages that a task, and so a batch of its Python worker, has at most.
TASK_PAGES = 1000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over all cores where a table is in fewer files than there are cores: scoring costs far more than the shuffle. rows: as many in a task at most, about."""
    if df.isStreaming:
        return df
    least = df.sparkSession.sparkContext.defaultParallelism
    least = max(least, -(-df.count() // rows)) if rows else least
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def dealt(df: DataFrame) -> DataFrame:
    """A few narrow columns of a table, of which long texts will be made, in tasks of bounded size; the rows are counted in its files' footers."""
    return df if df.isStreaming else df.repartition(tasks(df.sparkSession, df.count()))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files, in tasks of bounded size, as a batch may be one file; as a pattern, the path may be one file or a folder of them."""
    whole = table(spark, sf_dir, name)
    rows = spark.readStream.schema(whole.schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return rows.repartition(tasks(spark, whole.count()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_time() -> Column:
    """A time of the order's day, the same in every time zone."""
    return F.timestamp_seconds(F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86400 + F.col("o_orderkey") % 86400)


def orders_corpus(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, **more: Column) -> DataFrame:
    """A document for each order: seven phrases, the day and the price, a type and a URL. orders: the table, or a stream of it."""
    k = F.col("o_orderkey")
    parts = [F.concat(pick(PHRASES, k * m + o), F.lit(sep)) for m, o, sep in PICKS]
    tail = F.concat(F.lit(" On "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" the sum was $"), F.floor("o_totalprice").cast("string"), F.lit(" for 3 percent."))
    rows = table(spark, sf_dir, "orders") if orders is None else orders
    made = (k.alias("doc_id"), F.concat(*parts, tail).alias("text"), pick(TYPES, k).alias("source_type"), pick(URLS, F.floor(k / 3)).alias("source_url"))
    return dealt(rows.select("o_orderkey", "o_orderdate", "o_totalprice")).select(*made, *(c.alias(name) for name, c in more.items()))


def parts_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market snapshot for each part, with rows of tickers and prices."""
    k = F.col("p_partkey")
    ticker = lambda m: F.concat(*(F.char((65 + F.floor(k * m / d) % 26).cast("int")) for d in (1, 26, 676)))
    price = F.floor(F.col("p_retailprice")).cast("string")
    text = F.concat(
        F.lit("Stocks fell early on the NASDAQ and NYSE. Acme Metals ("), ticker(1), F.lit(") at $"), price, F.lit(".50 (+"), (k % 30).cast("string"), F.lit(".5%) led. "),
        ticker(7), F.lit(" at C$ "), price, F.lit(" -"), (k % 9).cast("string"), F.lit(".2% on volume.\n"), ticker(1), F.lit(" again $1.10 +2.0%\nThe OTC at $3.00 +1.0% is no ticker.\nS&P 500: +0."), (k % 10).cast("string"), F.lit("2% at close.\n"), pick(PHRASES, k * 3),
    )
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")).select(k.alias("doc_id"), text.alias("text"), pick(TYPES, k).alias("source_type"), F.lit("").alias("source_url"))


def events_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each user and day, a line for each event; a group for each day."""
    e = F.col("event_type")
    line = None
    for kind, (head, tail) in CLAIM_LINES.items():
        made = F.concat(F.lit(head), F.col("value").cast("string"), F.lit(tail))
        line = F.when(e == kind, made) if line is None else line.when(e == kind, made)
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "events").select(day.alias("group_id"), F.col("user_id").alias("doc_idx"), F.struct("event_id", line.alias("line")).alias("l"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n")
    return rows.groupBy("group_id", "doc_idx").agg(text.alias("text")).withColumn("source_name", F.concat(F.lit("user "), F.col("doc_idx").cast("string")))
