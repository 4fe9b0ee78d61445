"""Takes new files of a text table in, sets unusable rows apart and reports quality by source.

    python -m jobs.text_intake --input hdfs:///raw/documents --output hdfs:///intake [--config jobs/text_intake.json]

The input is a folder (or file) of Parquet that grows by new files.  A file stream with a
checkpoint takes what is new and then ends.  Below the output folder are

* ``rows/batch=N/verdict=V/source=S``: all rows, accepted or set apart with the reason;
* ``counts/batch=N``: counts of each batch, from the rows as they were written;
* ``report/source=S``: the counts of all batches merged, and whether each group passes.

A batch that is repeated after a failure overwrites its own partitions with the same rows, and
the report is made anew from the counts, so a run that is repeated changes nothing.

Null keys, null or blank texts and lengths that aren't the text's are set apart.  Keys that repeat
are accepted and counted, as only a reader can choose between their rows.  Null and
empty sources are one group.
"""

from __future__ import annotations

import argparse
import json
import logging
import pathlib
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.operators import quality

log = logging.getLogger(__name__)

ACCEPTED, NO_KEY, NO_TEXT, WRONG_LENGTH = "accepted", "no_key", "no_text", "wrong_length"
CONFIG = pathlib.Path(__file__).with_suffix(".json")


def read_config(path: str | pathlib.Path = CONFIG) -> dict:
    """key, text, length (or null), source, language, files_per_batch, most_set_apart, least_rows."""
    return json.loads(pathlib.Path(path).read_text())


def verdict(config: dict) -> Column:
    """Whether a row is accepted, or the first reason why not."""
    text = F.col(config["text"])
    checks = F.when(F.col(config["key"]).isNull(), NO_KEY).when(text.isNull() | (F.length(F.trim(text)) == 0), NO_TEXT)
    if config["length"]:
        checks = checks.when(~F.length(text).cast("long").eqNullSafe(F.col(config["length"]).cast("long")), WRONG_LENGTH)
    return checks.otherwise(ACCEPTED)


def overwritten(df: DataFrame, path: str, *partitions: str) -> None:
    """Writes only over the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def take(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """One batch: its rows by verdict and source, then their counts as read back."""
    spark, schema = batch.sparkSession, batch.schema
    judged = batch.withColumns({"batch": F.lit(number).cast("long"), "verdict": verdict(config)})
    # a source may hold most rows: rebalancing splits it over tasks and gathers small ones
    overwritten(judged.hint("rebalance", "verdict", config["source"]), f"{output}/rows", "batch", "verdict", config["source"])
    written = rows(spark, output, schema).where(F.col("batch") == number)
    counts = group_counts(written, config)
    overwritten(counts, f"{output}/counts", "batch")
    for r in spark.read.schema(counts.schema).parquet(f"{output}/counts").where(F.col("batch") == number).groupBy("verdict").agg(F.sum("n_rows").alias("n")).orderBy("verdict").collect():
        log.info("batch %d: wrote %d rows %s to %s/rows", number, r.n, r.verdict, output)


def rows(spark: SparkSession, output: str, schema) -> DataFrame:
    """All rows that were taken in, with ``batch`` and ``verdict``."""
    known = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    return spark.read.schema(", ".join([*known, "batch long", "verdict string"])).parquet(f"{output}/rows")


def group_counts(taken: DataFrame, config: dict) -> DataFrame:
    """(batch, verdict, source, lang, n_rows, n_bytes, least_chars, most_chars): sums and extremes, so that batches can be merged."""
    text = F.col(config["text"])
    chars = F.length(text).cast("long")
    return taken.groupBy("batch", "verdict", F.col(config["source"]).alias("source"), F.col(config["language"]).alias("lang")).agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("n_bytes"), F.min(chars).alias("least_chars"), F.max(chars).alias("most_chars")
    )


def report(spark: SparkSession, output: str, schema, config: dict) -> DataFrame:
    """One row a source and language over all batches, in order of neither."""
    taken = rows(spark, output, schema)
    counts = spark.read.schema(group_counts(taken, config).schema).parquet(f"{output}/counts")
    reasons = [F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("n_rows"))), F.lit(0)).alias(f"n_{v}") for v in (ACCEPTED, NO_KEY, NO_TEXT, WRONG_LENGTH)]
    merged = counts.groupBy("source", "lang").agg(F.sum("n_rows").alias("n_rows"), *reasons, F.sum("n_bytes").alias("n_bytes"), F.min("least_chars").alias("least_chars"), F.max("most_chars").alias("most_chars"))
    accepted = taken.where(F.col("verdict") == ACCEPTED).select(F.col(config["key"]).cast("string").alias("value"), F.col(config["source"]).alias("source"), F.col(config["language"]).alias("lang"))
    repeats = quality.repeated_keys(accepted, ("value",)).select("value")
    repeated = accepted.join(repeats, "value").groupBy("source", "lang").agg(F.count("*").alias("n"))
    same = merged.source.eqNullSafe(repeated.source) & merged.lang.eqNullSafe(repeated.lang)
    share = (F.col("n_rows") - F.col("n_accepted")) / F.col("n_rows")
    out = merged.join(repeated, same, "left").select(merged["*"], F.coalesce("n", F.lit(0)).alias("n_with_repeated_key"), F.round(share, 6).alias("share_set_apart"))
    passed = (F.col("share_set_apart") <= F.lit(float(config["most_set_apart"]))) & (F.col("n_rows") >= F.lit(int(config["least_rows"]))) & (F.col("n_with_repeated_key") == 0)
    return out.withColumn("passed", passed)


def run(spark: SparkSession, source: str, output: str, config: dict) -> DataFrame:
    """Takes in what is new below ``source`` and returns the report as it was written."""
    schema = spark.read.parquet(source).schema
    whole = source.rstrip("/")
    at = whole.rfind("/") + 1
    pattern = f"{whole[:at]}{{{whole[at:]}}}"  # as a pattern, the path may be a single file, too
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(pattern)
    query = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, output, config)).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    n_new = sum(p.numInputRows for p in query.recentProgress)
    log.info("read %d new rows from %s", n_new, source)
    made = report(spark, output, schema, config)
    overwritten(made, f"{output}/report", "source")
    found = spark.read.schema(made.schema).parquet(f"{output}/report").select(made.columns)
    failed = found.where(~F.col("passed")).count()
    log.info("wrote the report to %s/report: %d groups, %d don't pass", output, found.count(), failed)
    return found


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Takes new files of a text table in and reports quality by source.")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_intake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        failed = run(spark, given.input, given.output, read_config(given.config)).where("not passed").count()
    finally:
        spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
