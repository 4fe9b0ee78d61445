"""Magnitude of completeness by maximum curvature, by group where groups are named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import stats


def fmd(catalog: DataFrame, by: tuple = (), width: float = model.MAGNITUDE_BIN) -> DataFrame:
    """(by, bin, center, n, n_cumulative): dense bins from the least to the largest magnitude."""
    counts = catalog.where(F.col("mag").isNotNull()).groupBy(*by, stats.magnitude_bin(F.col("mag"), width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    # from here on a few hundred rows a group
    dense = counts.groupBy(*by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).where("lo is not null").select(*by, F.explode(F.sequence("lo", "hi")).alias("bin"))
    full = dense.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    down = Window.partitionBy(*by).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(*by, "bin", F.round(F.col("bin") * F.lit(width), 4).alias("center"), "n", F.sum("n").over(down).alias("n_cumulative"))


def mc_maxc(catalog: DataFrame, by: tuple = (), width: float = model.MAGNITUDE_BIN, correction: float = model.MAXC_CORRECTION) -> DataFrame:
    """(by, mc): the fullest bin, the first of equal ones, plus the correction."""
    first = Window.partitionBy(*by).orderBy(F.col("n").desc(), "bin")
    return fmd(catalog, by, width).withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*by, (F.col("center") + F.lit(correction)).alias("mc"))


def trim_to_mc(catalog: DataFrame, mc: float | Column, width: float = model.MAGNITUDE_BIN) -> DataFrame:
    """The complete events; mc is a number or a column of the catalog."""
    return catalog.where(stats.is_complete(F.col("mag"), mc if isinstance(mc, Column) else F.lit(float(mc)), width))


def with_mc(catalog: DataFrame, mc: DataFrame, by: tuple = ()) -> DataFrame:
    """Adds each group's mc; ``mc`` has a row a group and is checked to be small before it is broadcast."""
    return catalog.join(F.broadcast(mc), list(by)) if by else catalog.withColumn("mc", F.lit(float(mc.first().mc)))


def estimate(catalog: DataFrame, by: tuple = (), width: float = model.MAGNITUDE_BIN, correction: float = model.MAXC_CORRECTION) -> DataFrame:
    """(by, mc, b, d, n_events_catalog, n_events_complete)."""
    mc = mc_maxc(catalog, by, width, correction)
    complete = stats.is_complete(F.col("mag"), F.col("mc"), width)
    return with_mc(catalog, mc, by).groupBy(*by, "mc").agg(F.lit(model.B_VALUE).alias("b"), F.lit(model.FRACTAL_D).alias("d"), F.count("*").alias("n_events_catalog"), F.count_if(complete).alias("n_events_complete"))


def require(estimates: DataFrame, least: int = model.MIN_COMPLETE) -> list:
    """The estimates as rows; too few complete events in a group are an error."""
    rows = estimates.collect()  # one row a group
    for r in rows:
        if r.n_events_complete < least:
            raise ValueError(f"only {r.n_events_complete} events are complete above Mc={r.mc:.2f} (at least {least} are needed): widen the window or lower the magnitude")
    if not rows:
        raise ValueError("no events are left after cleaning")
    return rows
