"""Raw catalogs as compressed text, and the published comma-separated tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_bronze(raw: DataFrame, path: str) -> None:
    """All columns as text, gzip files with headers."""
    raw.select(*(F.col(c).cast("string").alias(c) for c in raw.columns)).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_bronze(spark: SparkSession, *paths: str) -> DataFrame:
    """Everything as text: a header in each file, columns by their names; several answers of a service at once."""
    return spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).option("multiLine", False).csv(list(paths))


def as_text(table: DataFrame) -> DataFrame:
    """Times to whole seconds with their offset, booleans as True and False, numbers as they are.

    Columns go by their place, as two names may differ in case alone.
    """
    placed = table.toDF(*(f"c{i}" for i in range(len(table.columns))))

    def column(f: T.StructField):
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(F.col(f.name).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxx").alias(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return F.initcap(F.col(f.name).cast("string")).alias(f.name)
        return F.col(f.name)

    return placed.select(*(column(f) for f in placed.schema.fields)).toDF(*table.columns)


#: Rows up to which a table that people open is written as one part.
SINGLE_ROWS = 500_000


def write_csv(table: DataFrame, path: str, single: bool = False) -> None:
    """A folder of comma-separated parts; with ``single`` one part if the rows, which are counted, are few enough.

    Published columns may differ in case alone, which a session of its own tells apart; the
    caller's settings stay as they are.
    """
    text = as_text(table)
    single = single and table.count() <= SINGLE_ROWS
    own = table.sparkSession.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    name = f"delivery_{uuid.uuid4().hex}"
    text.toDF(*(f"c{i}" for i in range(len(text.columns)))).createGlobalTempView(name)
    try:
        named = own.table(f"global_temp.{name}").toDF(*text.columns)
        (named.coalesce(1) if single else named).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    finally:
        own.catalog.dropGlobalTempView(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A published table; its columns by their place, times as the text they were published as."""
    kinds = [T.StringType() if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) else f.dataType for f in schema]
    placed = T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate(kinds)])
    return spark.read.schema(placed).option("header", True).option("enforceSchema", True).csv(path).toDF(*schema.names)
