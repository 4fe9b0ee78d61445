"""Raw catalog files as a stream: each batch is cleaned and kept as a partition of its own.

The batch operators do the work; the stream only says which files are new.  A batch writes what is
new and nothing else; the latest version of each event is found when the table is read.
A batch that is repeated after a failure replaces its own partition with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import silver


def raw_stream(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as rows of text; the columns are named, nothing is inferred."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)


def keep_silver(stream: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the cleaned rows of each batch below root, in ``batch=N``."""

    def take(batch: DataFrame, number: int) -> None:
        fresh = silver.refine(batch).withColumn("batch", F.lit(number).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(root)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_silver(spark: SparkSession, root: str) -> DataFrame:
    """The latest version of each event of all batches."""
    return silver.latest(spark.read.option("mergeSchema", True).parquet(root).drop("batch"))
