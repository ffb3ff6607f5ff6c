"""python -m quillspark (--text TEXT | --file PATH | --stdin | --demo | --schema) [--type T] [--name N] [--url U] [--json]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.functions.render import report
from quillspark.plans.triage import analyze
from quillspark.sources import readers


def main(args: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    source = options.add_mutually_exclusive_group(required=True)
    source.add_argument("--text")
    source.add_argument("--file")
    for flag in ("--stdin", "--demo", "--schema"):
        source.add_argument(flag, action="store_true")
    options.add_argument("--type", default="auto")
    options.add_argument("--name", default="unknown")
    options.add_argument("--url", default="")
    options.add_argument("--json", action="store_true")
    given = options.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if given.demo or given.schema:
        docs = readers.examples(spark)
    elif given.file:
        docs = readers.text_files(spark, given.file)
    else:
        docs = spark.createDataFrame([(given.text if given.text is not None else sys.stdin.read(),)], "text string")
    if not given.demo and not given.schema:
        docs = docs.withColumns({"source_type": F.lit(given.type), "source_name": F.lit(given.name), "source_url": F.lit(given.url)})
        if docs.where(F.trim("text") != "").isEmpty():
            options.error("there is no text")
    rows = analyze(docs)
    if given.schema:
        print(rows.schema["assessment"].dataType.json())
        return
    shown = F.to_json("assessment") if given.json else report(F.col("assessment"))
    for row in rows.select(shown.alias("shown")).toLocalIterator():
        print(row.shown)


if __name__ == "__main__":
    main()
