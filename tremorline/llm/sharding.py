"""Balanced shards: contiguous in the order of the key, equal in bytes.

Documents are dealt by ranges of their key and sorted within each range, and a
running sum of their sizes is kept beside them.  The totals of the ranges (a row
each) are summed up to where each range starts, so every document knows the bytes
before it in the whole table.  A shard's target is an equal part of all bytes; a
document goes to the shard that holds its middle byte.  So a shard's size is off its
target by at most half the document at each of its ends.

Sizes are the UTF-8 bytes of a text plus ``overhead``.

Defined results: a null text has no bytes and stays null; null keys come first;
documents of one key are ordered by a hash of their text, and repeated rows by their
place in the input, so that a key or text that most rows share is spread over ranges,
too; an empty table gives an empty table; where documents are larger than the target
some shards are empty; extra columns are kept by ``place`` and ``write``, and those that have
the name of an added one come back with an underscore behind it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import shared

OVERHEAD = 16
ADDED = ("size", "shard", "slot")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """A row of docs as one struct, with an underscore behind the names that are added here."""
    taken, fields = {c.lower() for c in docs.columns} | set(ADDED), []
    for c in docs.columns:
        name = c
        while c.lower() in ADDED and name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        fields.append(quoted(c).alias(name))
    return F.struct(*fields)


def dealt(docs: DataFrame, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, parts: int | None = None) -> DataFrame:
    """(doc, size, range, before, row): each row with the range it is in, and the bytes and rows before it there; written, as ranges are drawn from a sample."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = {"_key": F.col(key), "_hash": F.xxhash64(F.col(text)), "_place": F.monotonically_increasing_id()}
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)
    own = docs.select(packed(docs).alias("doc"), size.alias("size"), *(c.alias(name) for name, c in order.items()))
    ranges = own.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc", "size", F.spark_partition_id().alias("range"))

    def run(batches):
        before, row = 0, 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = before + np.cumsum(sizes, dtype=np.int64)
            added = [pa.array(ends - sizes, pa.int64()), pa.array(np.arange(row, row + len(sizes)), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=["doc", "size", "range", "before", "row"])
            before, row = before + int(sizes.sum()), row + len(sizes)

    schema = StructType([*ranges.schema, StructField("before", LongType()), StructField("row", LongType())])
    return shared.materialize(ranges.mapInArrow(run, schema), "sharding-ranges")


def starts(ranges: DataFrame) -> DataFrame:
    """(of, bytes, rows, total): what lies before each range, and all bytes; a row for each range, of which there are as many as partitions."""
    totals = ranges.groupBy(F.col("range").alias("of")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    summed = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("b", "bytes"), ("n", "rows"))]
    return totals.select("of", *summed, F.sum("b").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))


def place(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, parts: int | None = None) -> DataFrame:
    """docs with ``size``, ``shard`` (0 to shards - 1) and ``slot``, the place in the shard from 0 in the order of the key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    ranges = dealt(docs, key, text, overhead, parts)
    wide = "decimal(38,0)"  # bytes times shards outgrow a long
    middle = (F.col("before") + F.col("bytes")).cast(wide) * 2 + F.col("size")
    known = ranges.join(F.broadcast(starts(ranges)), F.col("range") == F.col("of")).withColumns({"at": F.col("row") + F.col("rows"), "twice": middle, "whole": F.col("total").cast(wide) * 2})
    known = known.withColumn("shard", F.expr(f"cast((twice * {int(shards)}) div whole as int)"))
    firsts = known.groupBy(F.col("shard").alias("in")).agg(F.min("at").alias("first"))  # a row a shard
    return known.join(F.broadcast(firsts), F.col("shard") == F.col("in")).select("doc.*", "size", "shard", (F.col("at") - F.col("first")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD, parts: int | None = None) -> DataFrame:
    """The shards as folders ``shard=N`` of Parquet files below path, rows in order of their slots, read back.

    A range of documents meets few shards, so the files are about as many as ranges and
    shards together, and nothing is shuffled for them.
    """
    placed = place(docs, shards, key, text, overhead, parts)
    placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path).select(*map(quoted, placed.columns))


def digests(written: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of what is read back."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return written.select(F.col(key).alias("doc_id"), "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
