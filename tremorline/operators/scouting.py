"""Choosing regions: completeness by blocks of years, density by strips, the largest events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import stats

FIRST_YEAR, BLOCK_YEARS, LOW, HIGH = 1973, 5, 3.5, 6.0


def _block(first: int, years: int):
    return (F.lit(first) + F.floor((F.year("time") - first) / years) * years).cast("int")


def blocks_mc(catalog: DataFrame, first: int = FIRST_YEAR, years: int = BLOCK_YEARS, by: tuple = ()) -> DataFrame:
    """(by, start_year, mc, n_ge_45, n_ge_6): completeness of each block of years from magnitudes 3.5 to 6.0."""
    own = catalog.where(F.year("time") >= first).withColumn("start_year", _block(first, years))
    step = stats.magnitude_bin(F.col("mag")).cast("long")
    keys = [*by, "start_year"]
    bins = own.where(step.between(round(LOW * 10), round(HIGH * 10))).groupBy(*keys, step.alias("bin")).agg(F.count("*").alias("n"))
    top = bins.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "bin"))).where("_r = 1")
    mc = top.select(*keys, F.round(F.col("bin") * F.lit(model.MAGNITUDE_BIN) + F.lit(model.MAXC_CORRECTION), 2).alias("mc"))
    counts = own.groupBy(*keys).agg(F.count_if(F.col("mag") >= 4.45).alias("n_ge_45"), F.count_if(F.col("mag") >= 6).alias("n_ge_6"))
    return counts.join(mc, keys, "left").select(*keys, "mc", "n_ge_45", "n_ge_6")


def density_strips(catalog: DataFrame, axis: str = "latitude", least: float = 4.45) -> DataFrame:
    """(edge, n): events by strips of one degree."""
    return catalog.where(F.col("mag") >= least).groupBy(F.floor(axis).cast("int").alias("edge")).agg(F.count("*").alias("n"))


def mega_events(catalog: DataFrame, least: float = 8.0) -> DataFrame:
    """(id, time, latitude, longitude, mag) of the largest events."""
    return catalog.where(F.col("mag") >= least).select("id", "time", "latitude", "longitude", "mag")
