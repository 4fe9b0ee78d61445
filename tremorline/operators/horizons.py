"""What is known of a sequence some hours after its mainshock, and what is still to come.

Spark and other engines don't tell ``n_aft_t`` from ``n_aft_T`` by case, so the table
has names of its own; ``published`` renames at the very end, for files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from .features import utc_micros

#: The names of the published columns.
PUBLISHED = {"n_aft_until_t": "n_aft_t", "max_aft_mag": "max_aft_mag_t", "hours_since_last": "hours_since_last_t", "n_aft_until_window": "n_aft_T", "censored_target": "censored_T", "censored_feature": "censored_t"}


def aftershock_delays(events: DataFrame, summary: DataFrame, by: tuple = ()) -> DataFrame:
    """(by, cluster_id, mag, delay_h) of every event at or after its mainshock, itself excluded."""
    main = summary.select(*by, "cluster_id", "mainshock_id", F.unix_micros("mainshock_time").alias("_t0")).hint("merge")  # a row a cluster, which Spark takes for small
    delay = (F.unix_micros("time") - F.col("_t0")) / F.lit(3600e6)
    joined = events.select(*by, "cluster_id", "id", "time", "mag").join(main, [*by, "cluster_id"]).where(F.col("id") != F.col("mainshock_id"))
    return joined.select(*by, "cluster_id", "mag", delay.alias("delay_h")).where("delay_h >= 0")


def build_horizons(summary: DataFrame, events: DataFrame, endtime, hours: tuple = model.HORIZONS_HOURS, days: float = model.HORIZON_DAYS, by: tuple = ()) -> DataFrame:
    """One row a cluster and horizon.  All horizons come from one pass of conditional aggregates.

    ``endtime`` is a moment or a timestamp column of the summary.
    """
    window = days * 24.0
    if any(not 0 < h < window for h in hours):
        raise ValueError(f"every horizon must lie within 0 and {window:g} hours, not {list(hours)}")
    d = F.col("delay_h")
    sums = aftershock_delays(events, summary, by).groupBy(*by, "cluster_id").agg(F.count_if(d <= window).alias("all"), F.array(*(F.struct(F.lit(int(h)).alias("horizon_hours"), F.count_if(d <= h).alias("n"), F.max(F.when(d <= h, F.col("mag"))).alias("mag"), F.max(F.when(d <= h, d)).alias("last")) for h in hours)).alias("h"))
    none = F.array(*(F.struct(F.lit(int(h)).alias("horizon_hours"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mag"), F.lit(None).cast("double").alias("last")) for h in hours))
    end, t0 = F.col("_end"), F.col("_t0")
    last = F.unix_micros(endtime) if isinstance(endtime, Column) else F.lit(utc_micros(endtime))
    rows = summary.select(*by, "cluster_id", F.unix_micros("mainshock_time").alias("_t0"), last.alias("_end")).join(sums, [*by, "cluster_id"], "left").select(*by, "cluster_id", "_t0", "_end", F.coalesce("all", F.lit(0)).alias("all"), F.explode(F.coalesce("h", none)).alias("h"))
    left = F.col("all") - F.col("h.n")
    return rows.select(
        *by,
        "cluster_id",
        "h.horizon_hours",
        F.col("h.n").cast("int").alias("n_aft_until_t"),
        F.col("h.mag").alias("max_aft_mag"),
        (F.col("h.horizon_hours") - F.coalesce("h.last", F.lit(0.0))).alias("hours_since_last"),
        left.cast("int").alias("y_aft"),
        (left > 0).alias("y_has_aft"),
        F.col("all").cast("int").alias("n_aft_until_window"),
        (t0 + F.lit(round(days * 86_400_000_000)) > end).alias("censored_target"),
        (t0 + F.col("h.horizon_hours").cast("long") * 3_600_000_000 > end).alias("censored_feature"),
    )


def positives(horizons: DataFrame, by: tuple = ()) -> DataFrame:
    return horizons.groupBy(*by, "horizon_hours").agg(F.count_if("y_has_aft").alias("positives"), F.count("*").alias("n"))


def violations(horizons: DataFrame, summary: DataFrame, days: float = model.HORIZON_DAYS, by: tuple = ()) -> DataFrame:
    """One row of counts: how often each identity of the table is broken."""
    from pyspark.sql import Window

    step = Window.partitionBy(*by, "cluster_id").orderBy("horizon_hours")
    names = ("cluster_id", "horizon_hours", "n_aft_until_t", "hours_since_last", "y_aft", "y_has_aft", "n_aft_until_window", "censored_target", "censored_feature")
    main = summary.select(*by, "cluster_id", "n_aftershocks", "duration_days")
    seen = horizons.withColumn("_back", F.col("n_aft_until_t") < F.lag("n_aft_until_t").over(step)).join(main, [*by, "cluster_id"], "left")
    fits = (F.col("duration_days") <= days) & ~F.col("censored_target")
    return seen.agg(
        F.count_if("_back").alias("not_monotonic"),
        F.count_if(F.col("n_aft_until_t") + F.col("y_aft") != F.col("n_aft_until_window")).alias("sums_differ"),
        F.count_if(F.col("y_aft") < 0).alias("negative_targets"),
        F.count_if(~F.col("hours_since_last").between(0, F.col("horizon_hours"))).alias("hours_outside"),
        F.count_if(fits & (F.col("n_aft_until_window") != F.col("n_aftershocks"))).alias("totals_differ"),
        F.count_if(F.greatest(*(F.col(c).isNull().cast("int") for c in names)) == 1).alias("unexpected_nulls"),
        F.count_if(F.col("max_aft_mag").isNull() != (F.col("n_aft_until_t") == 0)).alias("null_magnitudes_differ"),
    )


def check_invariants(horizons: DataFrame, summary: DataFrame, days: float = model.HORIZON_DAYS, by: tuple = ()) -> None:
    broken = {k: v for k, v in violations(horizons, summary, days, by).first().asDict().items() if v}
    if broken:
        raise ValueError(f"the horizon table breaks its identities: {broken}")


def published(horizons: DataFrame) -> DataFrame:
    """The columns under their published names; only for writing, as two pairs differ in case alone."""
    return horizons.toDF(*(PUBLISHED.get(c, c) for c in horizons.columns))
