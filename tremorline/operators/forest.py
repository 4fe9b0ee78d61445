"""Clusters from accepted links: roots inside parts of space, then by pointer doubling; mainshocks and summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions import geo
from ..storage import written
from .ordering import numbered
from .slabs import CLOSE_KM, MOST, parted, plain, tasks_for

MOST_ROUNDS = 40
#: Kilometres that a microsecond counts for when the catalog is cut: ten years as the neighbours' whole span.
PACE = CLOSE_KM / (10 * model.SECONDS_PER_YEAR * 1e6)


def heads(names: list[str]):
    """A part's events with their highest ancestor in the part, the links to it, and the parent where it is in another part."""

    def run(table: pa.Table) -> pa.Table:
        ids, up = table.column("id").combine_chunks(), table.column("_up")
        at = pc.fill_null(pc.index_in(up.combine_chunks(), value_set=ids), -1).to_numpy(zero_copy_only=False)
        (us,) = plain(table, "_us")
        inside = at >= 0
        step, depth = np.where(inside, at, np.arange(len(at))), inside.astype(np.int64)
        late = inside & (us[step] >= us)
        for _ in range(MOST_ROUNDS):
            onward = step[step]
            if np.array_equal(onward, step):
                break
            depth, step = depth + depth[step], onward
        found = {"_up": pc.if_else(pa.array(inside), None, up), "_head": ids.take(pa.array(step)), "_depth": pa.array(depth), "_late": pa.array(late)}
        return pa.Table.from_arrays([found[c] if c in found else table.column(c) for c in names], names=names)

    return run


def assign_clusters(classified: DataFrame, by: tuple = (), most: int = MOST) -> DataFrame:
    """Adds cluster_id (the root's id) and generation.

    Most parents are near, so chains are first followed inside parts of space of a bounded number of
    events, each in one task.  Only events whose parent is in another part are left to be joined: each round joins their
    ancestors with those' ancestors, so a chain through n parts takes log2(n) rounds.
    """
    key = [*by, "id"]
    linked = F.col("is_aftershock") & F.col("parent_id").isNotNull()
    own = classified.withColumns({"_up": F.when(linked, F.col("parent_id")), "_us": F.unix_micros("time"), "_lat": F.radians("latitude"), "_lon": F.radians("longitude")})
    placed = written(parted(own, by, most, number="id", pace=PACE).drop("_lat", "_lon"), "forest-parts")
    kept = T.StructType([*(f for f in placed.schema if f.name != "part"), *(T.StructField(n, t) for n, t in (("_head", T.StringType()), ("_depth", T.LongType()), ("_late", T.BooleanType())))])
    parts = placed.select(*by, "part").distinct().count()
    local = written(placed.repartition(tasks_for(parts, placed.sparkSession.sparkContext.defaultParallelism), *by, "part").groupBy(*by, "part").applyInArrow(heads(kept.names), kept), "heads")

    beyond = written(local.where("_up is not null").select(*key, "_up", "_us"), "beyond")
    inner = local.select(*by, F.col("id").alias("_up"), F.col("_us").alias("_when"), F.col("_head").alias("_to"), (F.col("_depth") + 1).alias("depth"))
    met = written(inner.join(beyond, [*by, "_up"]).select(*key, "_to", "depth", (F.col("_when") >= F.col("_us")).alias("_late")), "ancestors")
    late = local.where("_late").select("id").unionByName(met.where("_late").select("id")).unionByName(beyond.join(met, key, "left_anti").select("id")).limit(1).collect()
    if late:
        raise ValueError(f"the parent of {late[0].id!r} is not an earlier event of the catalog")
    for _ in range(MOST_ROUNDS):
        onward = met.select(*by, F.col("id").alias("_to"), F.col("_to").alias("_on"), F.col("depth").alias("_more"))
        step = met.select(*key, "_to", "depth").join(onward, [*by, "_to"], "left")
        met = written(step.select(*key, F.coalesce("_on", "_to").alias("_to"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_on").isNotNull().alias("_moved")), "ancestors")
        if met.where("_moved").isEmpty():
            break
    else:
        raise ValueError("the links have a cycle")
    onto = met.select(*by, F.col("id").alias("_head"), "_to", F.col("depth").alias("_more"))
    generation = (F.col("_depth") + F.coalesce("_more", F.lit(0))).cast("int")
    out = local.join(onto, [*by, "_head"], "left").select(*key, *(c for c in classified.columns if c not in key), F.coalesce("_to", "_head").alias("cluster_id"), generation.alias("generation"))
    return written(out, "assigned")


def with_mainshock(clustered: DataFrame, definition: str = "largest", by: tuple = ()) -> DataFrame:
    """Adds order_in_cluster and is_mainshock: the largest event (of equal ones the first) or the root."""
    if definition not in ("largest", "root"):
        raise ValueError(f"unknown mainshock definition {definition!r}; it is 'largest' or 'root'")
    key = [*by, "cluster_id"]
    out = numbered(clustered, ("time", "ord"), tuple(key), "_place").withColumn("order_in_cluster", (F.col("_place") - 1).cast("int"))
    if definition == "root":
        return out.drop("_place").withColumn("is_mainshock", F.col("generation") == 0)
    # a minimum of structs would sort all events; of each size the first and of these the largest one don't
    size = F.coalesce(-F.col("mag"), F.lit(float("-inf")))
    firsts = out.groupBy(*key, size.alias("_size")).agg(F.min("_place").alias("_first"))
    # a row a cluster, and most clusters are single events: too many to be broadcast
    first = written(firsts.groupBy(*key).agg(F.min_by("_first", "_size").alias("_first")), "mainshocks").hint("merge")
    return out.join(first, key).withColumn("is_mainshock", F.col("_place") == F.col("_first")).drop("_place", "_first")


def summarize(events: DataFrame, by: tuple = ()) -> DataFrame:
    """One row a cluster; ``events`` has is_mainshock."""
    place = ["place"] if "place" in events.columns else []
    main = events.where("is_mainshock").select(*by, "cluster_id", F.col("id").alias("mainshock_id"), *(F.col(c).alias("mainshock_place") for c in place), F.col("mag").alias("mainshock_mag"), F.col("time").alias("mainshock_time"), F.col("latitude").alias("mainshock_lat"), F.col("longitude").alias("mainshock_lon"), F.col("depth").alias("mainshock_depth"))
    joined = events.join(main, [*by, "cluster_id"])
    far = geo.haversine_km(*(F.radians(c) for c in ("latitude", "longitude", "mainshock_lat", "mainshock_lon")))
    heads = [c for c in main.columns if c not in (*by, "cluster_id")]
    return (
        joined.groupBy(*by, "cluster_id", *heads)
        .agg(
            F.count("*").cast("int").alias("n_events"),
            F.count_if(F.col("time") < F.col("mainshock_time")).cast("int").alias("n_foreshocks"),
            ((F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))) / F.lit(86400e6)).alias("duration_days"),
            F.max(far).alias("extent_km"),
            F.max("generation").alias("max_generation"),
        )
        .select(*by, "cluster_id", *heads, "n_events", (F.col("n_events") - 1 - F.col("n_foreshocks")).alias("n_aftershocks"), "n_foreshocks", "duration_days", "extent_km", "max_generation", (F.col("cluster_id") == F.col("mainshock_id")).alias("root_is_mainshock"))
    )


def build_clusters(classified: DataFrame, definition: str = "largest", by: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(events, summary): events also say how many aftershocks their sequence and they themselves have."""
    from .silver import with_order

    own = classified if "ord" in classified.columns else with_order(classified, by)
    events = written(with_mainshock(assign_clusters(own, by), definition, by), "clustered")
    summary = written(summarize(events, by), "summary")
    counted = events.join(summary.select(*by, "cluster_id", F.col("n_aftershocks").alias("n_aftershocks_sequence")).hint("merge"), [*by, "cluster_id"])  # a row a cluster, which Spark takes for small
    return counted.withColumn("n_aftershocks", F.when(F.col("is_mainshock"), F.col("n_aftershocks_sequence")).otherwise(0)), summary


def implausible(summary: DataFrame, most_km: float = model.MAX_EXTENT_KM) -> DataFrame:
    """Clusters wider than any sequence of aftershocks."""
    return summary.where(F.col("extent_km") > most_km)


def productivity_bins(summary: DataFrame, width: float = 0.5, least: int = 5, by: tuple = ()) -> DataFrame:
    """(by, center, mean_aftershocks, n_mainshocks) by the mainshock's magnitude, clusters without aftershocks included."""
    ends = summary.groupBy(*by).agg((F.floor(F.min("mainshock_mag") / width) * F.lit(width)).alias("_lo"), (F.ceil(F.max("mainshock_mag") / width) * F.lit(width)).alias("_hi"))
    n = F.greatest(F.lit(1), F.round((F.col("_hi") - F.col("_lo")) / width).cast("int"))
    joined = summary.join(F.broadcast(ends), list(by)) if by else summary.join(F.broadcast(ends), F.lit(True))
    at = F.least(n - 1, F.floor((F.col("mainshock_mag") - F.col("_lo")) / width))
    bins = joined.groupBy(*by, (F.col("_lo") + at * F.lit(width) + F.lit(width / 2)).alias("center")).agg(F.avg(F.col("n_aftershocks").cast("double")).alias("mean_aftershocks"), F.count("*").alias("n_mainshocks"))
    return bins.where((F.col("n_mainshocks") >= least) & (F.col("mean_aftershocks") > 0))


def productivity(summary: DataFrame, width: float = 0.5, least: int = 5, by: tuple = ()) -> DataFrame:
    """(by, alpha, intercept, r2, n_bins, plausible): a line through the log10 means; under three bins no row."""
    y, x = F.log10("mean_aftershocks"), F.col("center")
    fit = productivity_bins(summary, width, least, by).groupBy(*by).agg(F.regr_slope(y, x).alias("alpha"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("_r2"), F.var_pop(y).alias("_v"), F.count("*").alias("n_bins"))
    return fit.where("n_bins >= 3").select(*by, "alpha", "intercept", F.when(F.col("_v") > 0, F.col("_r2")).otherwise(0.0).alias("r2"), "n_bins", F.col("alpha").between(*model.ALPHA_PLAUSIBLE).alias("plausible"))
