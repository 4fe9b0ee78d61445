"""Cleaning of raw catalog text into the typed, deduplicated catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from .ordering import numbered

#: Texts that count as missing in a raw catalog.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def text_or_null(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def number_or_null(c: Column) -> Column:
    """A plain number, else null; suffixes that Spark's own cast takes are refused."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def check_columns(raw: DataFrame) -> None:
    if missing := [c for c in model.REQUIRED_RAW if c not in raw.columns]:
        raise ValueError(f"the raw catalog lacks the columns {missing}")


def typed(raw: DataFrame) -> DataFrame:
    """Text columns with times and numbers parsed; what can't be parsed is null."""
    check_columns(raw)

    def column(name: str) -> Column:
        c = text_or_null(F.col(name).cast("string"))
        if name in ("time", "updated"):
            return F.try_to_timestamp(c).alias(name)
        return (number_or_null(c) if name in model.NUMERIC_RAW else c).alias(name)

    # one entry of an array: else Spark puts a filter on parsed columns below the parsing, which then runs twice
    return raw.select(F.inline(F.array(F.struct(*(column(c) for c in raw.columns)))))


def latest(df: DataFrame, by: tuple = ()) -> DataFrame:
    """One row by id, the last updated; a missing update time counts as the last.

    Ties go to the latest event time, then to the larger values, so the result does
    not depend on the order of the input.  It is a maximum, so an id that fills a third
    of the rows is pre-aggregated where it is read.
    """
    keys = [*by, "id"]
    rest = [c for c in df.columns if c not in (*keys, "updated", "time")]
    newest = F.max(F.struct(F.col("updated").isNull().alias("_open"), "updated", "time", *rest)).alias("_newest")
    return df.groupBy(*keys).agg(newest).select(*(F.col(c) if c in keys else F.col(f"_newest.{c}").alias(c) for c in df.columns))


def refine(raw: DataFrame, by: tuple = ()) -> DataFrame:
    """Typed rows without missing keys, one by id, with the known columns that exist.

    The result isn't in time order (tables have none); ``with_order`` numbers it.
    """
    clean = latest(typed(raw).dropna(subset=list(model.NOT_NULL)), by)
    return clean.select(*by, *(c for c in model.SILVER if c in clean.columns and c not in by))


def with_order(catalog: DataFrame, by: tuple = (), name: str = "ord") -> DataFrame:
    """Numbers the events of each group by (time, id), from 1."""
    return numbered(catalog, ("time", "id"), by, name)
