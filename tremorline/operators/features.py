"""Causal features of each sequence: what had happened around its mainshock before it."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import geo
from ..storage import written
from . import windows
from .completeness import trim_to_mc
from .neighbors import deal_crowded, parts_for_pairs
from .ordering import numbered

log = logging.getLogger(__name__)


def utc_micros(moment) -> int:
    """Microseconds since 1970 of a time or its ISO text; one without a zone is in UTC."""
    t = moment if isinstance(moment, dt.datetime) else dt.datetime.fromisoformat(str(moment))
    t = t if t.tzinfo else t.replace(tzinfo=dt.UTC)
    return round((t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(microseconds=1))


DAY_US = 86_400_000_000
#: Added to a look-back in microseconds; ages in days, as doubles, decide what is inside.
SLACK_US = 1000


def mainshocks(summary: DataFrame, grid: geo.Grid, starttime, by: tuple = ()) -> DataFrame:
    """The mainshocks (c_...) with their moment, place, the cells that can hold events near them and the start of their catalog."""
    start = F.unix_micros(starttime) if isinstance(starttime, Column) else F.lit(utc_micros(starttime))
    return summary.select(*(F.col(c).alias(f"c_{c}") for c in (*by, "cluster_id", "mainshock_id")), F.unix_micros("mainshock_time").alias("c_us"), F.radians("mainshock_lat").alias("c_lat"), F.radians("mainshock_lon").alias("c_lon"), grid.around(F.col("mainshock_lat"), F.col("mainshock_lon")).alias("c_around"), start.alias("c_start"))


def earlier_events(catalog: DataFrame, grid: geo.Grid, by: tuple = ()) -> DataFrame:
    """The events (p_...), each once, in its own cell: mainshocks, which are fewer, go to all cells around them."""
    at = catalog.withColumn("_c", grid.cell(F.col("latitude"), F.col("longitude")))
    return at.select(*(F.col(c).alias(f"p_{c}") for c in (*by, "id", "mag")), F.unix_micros("time").alias("p_us"), F.radians("latitude").alias("p_lat"), F.radians("longitude").alias("p_lon"), F.col("_c.band").alias("p__band"), F.col("_c.cell").alias("p__cell"))


def candidate_pairs(main: DataFrame, events: DataFrame, low_us: int, high_us: int, by: tuple = ()) -> DataFrame:
    """Mainshocks with the events of their cells that are over ``low_us`` and at most ``high_us`` older.

    Time goes by buckets as wide as the look-back, so a mainshock meets the events of two
    buckets in its cells, whatever the catalog's age.
    """
    width = high_us - low_us
    bucket = lambda us: F.floor(us / F.lit(width))
    around = main.withColumn("_c", F.explode("c_around")).select(*(c for c in main.columns if c != "c_around"), F.col("_c.band").alias("c__band"), F.col("_c.cell").alias("c__cell"))
    children = around.withColumn("c__bucket", F.explode(F.sequence(bucket(F.col("c_us") - high_us), bucket(F.col("c_us") - low_us))))
    keys = (*by, "_band", "_cell", "_bucket")
    sides = deal_crowded(children, events.withColumn("p__bucket", bucket(F.col("p_us"))), keys, "c_cluster_id")
    children, parents = (x.repartition(parts_for_pairs(main), *(prefix + k for k in (*keys, "_salt"))) for x, prefix in zip(sides, ("c_", "p_"), strict=True))
    gap = F.col("c_us") - F.col("p_us")
    return children.join(parents, [*(F.col(f"p_{k}") == F.col(f"c_{k}") for k in (*keys, "_salt")), gap > low_us, gap <= high_us, F.col("p_id") != F.col("c_mainshock_id")])


def prior_seismicity(summary: DataFrame, catalog: DataFrame, mc: float | Column | None, starttime, radius_km: float = model.PRIOR_RADIUS_KM, by: tuple = ()) -> DataFrame:
    """(by, cluster_id, n_prior_2d, n_prior_30d, n_prior_365d, prior_max_mag_365d, days_since_prior, prior_window_truncated).

    Complete events within the radius of the mainshock and strictly before it, itself
    excluded; the windows include their far end.  Trees of totals count all windows at once
    (``windows``), so events in reach are not met one by one.  The last event before has no such limit: only
    mainshocks without any in the window look further back, each time twice as far, by an equi-join on cells of
    the sphere and buckets of time, until one is found or the catalog begins.
    """
    grid, reach = geo.Grid(radius_km * (1 + 1e-6)), radius_km * (1 + 1e-9)
    complete = trim_to_mc(catalog, mc) if mc is not None else catalog
    main, events = written(mainshocks(summary, grid, starttime, by), "prior-mainshocks"), earlier_events(complete, grid, by)
    longest = max(model.PRIOR_WINDOWS_DAYS)
    keys = [f"c_{c}" for c in (*by, "cluster_id")]
    age = (F.col("c_us") / F.lit(1e6) - F.col("p_us") / F.lit(1e6)) / F.lit(86400.0)

    def near(some: DataFrame, low_us: int, high_us: int) -> DataFrame:
        return candidate_pairs(some, events, low_us, high_us, by).where(geo.haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("c_lat"), F.col("c_lon")) <= reach).withColumn("age", age)

    low, high = 0, longest * DAY_US + SLACK_US
    places = complete.select(*by, "id", "mag", F.radians("latitude").alias("lat"), F.radians("longitude").alias("lon"), F.unix_micros("time").alias("us"))
    moments = main.select(*(F.col(f"c_{c}").alias(c) for c in by), "c_cluster_id", "c_mainshock_id", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), F.col("c_us").alias("us"))
    counted = windows.before(moments, places, reach, model.PRIOR_WINDOWS_DAYS, by, "c_cluster_id").where(F.col("last").isNotNull())
    names = [f"n_prior_{d}d" for d in model.PRIOR_WINDOWS_DAYS]
    # Spark takes a few columns of the mainshocks, whose lists of cells are long, for small and would broadcast them: hence the hints
    tallied = counted.select(*(F.col(c).alias(f"c_{c}") for c in by), "c_cluster_id", *(F.col(f"n_{d}").cast("int").alias(n) for d, n in zip(model.PRIOR_WINDOWS_DAYS, names, strict=True)), F.col("largest").alias(f"prior_max_mag_{longest}d"), "last")
    found = tallied.join(main.select(*keys, "c_us").hint("merge"), keys).withColumn("days_since_prior", (F.col("c_us") / F.lit(1e6) - F.col("last") / F.lit(1e6)) / F.lit(86400.0)).drop("c_us", "last")
    # a catalog that has a mainshock's id at an earlier moment, too: these few meet their events one by one
    twice = moments.withColumnsRenamed({"us": "c_us"}).hint("merge").join(places.select(*by, F.col("id").alias("c_mainshock_id"), "us"), [*by, "c_mainshock_id"]).where("us < c_us")
    twice = written(twice.select(*(F.col(c).alias(f"c_{c}") for c in by), "c_cluster_id").distinct(), "prior-twice")
    if not twice.isEmpty():
        counts = [F.count_if(F.col("age") <= d).cast("int").alias(n) for d, n in zip(model.PRIOR_WINDOWS_DAYS, names, strict=True)]
        singly = near(main.join(twice, keys, "left_semi"), low, high).groupBy(*keys).agg(*counts, F.max(F.when(F.col("age") <= longest, F.col("p_mag"))).alias(f"prior_max_mag_{longest}d"), F.min("age").alias("days_since_prior"))
        found = found.join(twice, keys, "left_anti").unionByName(singly)
    known = written(main.join(found, keys, "left"), "prior-windows")
    first = events.agg(F.min("p_us")).first()[0]  # null: no events at all
    last, open_ = known.where("days_since_prior is not null").select(*keys, "days_since_prior"), known.where("days_since_prior is null").select(main.columns)
    while first is not None:
        low, high = high, 2 * high
        open_ = open_.where(F.col("c_us") - low > first)  # others have no event that old
        if open_.isEmpty():
            break
        ages = near(open_, low, high).groupBy(*keys).agg(F.min("age").alias("days_since_prior"))
        step = written(open_.join(ages, keys, "left"), "prior-lookback")
        last = last.unionByName(step.where("days_since_prior is not null").select(last.columns))
        open_ = step.where("days_since_prior is null").select(main.columns)
    joined = known.drop("days_since_prior").join(last.hint("merge"), keys, "left")
    return joined.select(
        *(F.col(f"c_{c}").alias(c) for c in (*by, "cluster_id")),
        *(F.coalesce(f"n_prior_{d}d", F.lit(0)).alias(f"n_prior_{d}d") for d in model.PRIOR_WINDOWS_DAYS),
        f"prior_max_mag_{longest}d",
        "days_since_prior",
        (F.col("c_us") - F.lit(longest * DAY_US) < F.col("c_start")).alias("prior_window_truncated"),
    )


def add_border(summary: DataFrame, bbox: tuple, buffer_km: float = model.BORDER_BUFFER_KM) -> DataFrame:
    out = summary.withColumn("dist_to_border_km", geo.border_distance_km(F.col("mainshock_lat"), F.col("mainshock_lon"), bbox))
    return out.withColumn("near_border", F.col("dist_to_border_km") < F.lit(float(buffer_km)))


def build_features(summary: DataFrame, catalog: DataFrame, mc: float, log10_eta0: float, starttime, radius_km: float = model.PRIOR_RADIUS_KM, bbox: tuple | None = None, buffer_km: float = model.BORDER_BUFFER_KM, by: tuple = ()) -> DataFrame:
    """The summary with the new columns behind its own; border columns only with a whole box."""
    prior = prior_seismicity(summary, catalog, mc, starttime, radius_km, by)
    out = summary.join(prior, [*by, "cluster_id"]).select(*summary.columns, *(c for c in prior.columns if c not in (*by, "cluster_id")))
    out = out.withColumns({"region_mc": F.lit(float(mc)), "region_log10_eta0": F.lit(float(log10_eta0)), "has_aftershock": F.col("n_aftershocks") > 0})
    return add_border(out, bbox, buffer_km) if bbox is not None else out


def correlations(table: DataFrame, features: tuple = ("mainshock_mag", "mainshock_depth", "n_prior_2d", "n_prior_30d", "n_prior_365d", "prior_max_mag_365d", "days_since_prior", "dist_to_border_km"), by: tuple = ()) -> DataFrame:
    """(by, feature, n, pearson, spearman, gap_std) against n_aftershocks, of features that exist and vary.

    Ranks of equal values are averaged; rows are numbered in ranges, so no task sorts them all.
    """
    kept = [c for c in features if c in table.columns]
    y = F.col("n_aftershocks").cast("double")
    long = table.select(*by, y.alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in kept))).alias("f")).select(*by, "f.feature", "f.x", "y").where("x is not null")
    keys = [*by, "feature"]

    def ranks(value: str) -> DataFrame:
        places = numbered(long.select(*keys, value), (value,), tuple(keys), "place")
        return places.groupBy(*keys, value).agg(((F.min("place") + F.max("place")) / 2).alias(f"r{value}"))

    ranked = long.join(ranks("x"), [*keys, "x"]).join(ranks("y"), [*keys, "y"])

    def corr(a: str, b: str) -> Column:
        """Null where a side doesn't vary; Spark's own fails there."""
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    mean = lambda cond: F.avg(F.when(cond, F.col("x")))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"), mean(F.col("y") > 0).alias("_a"), mean(F.col("y") <= 0).alias("_b"), F.stddev_samp("x").alias("_s"))
    return out.where("n >= 3 and _s > 0").select(*keys, "n", *(F.round(c, 3).alias(c) for c in ("pearson", "spearman")), F.round(F.try_divide(F.col("_a") - F.col("_b"), F.col("_s")), 3).alias("gap_std"))


def uncensored(table: DataFrame, endtime, days: float = model.HORIZON_DAYS) -> DataFrame:
    """Sequences whose whole target window lies before the end of the catalog."""
    return table.where(F.unix_micros("mainshock_time") + F.lit(round(days * 86_400_000_000)) <= F.lit(utc_micros(endtime)))


