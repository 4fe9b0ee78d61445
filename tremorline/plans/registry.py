"""The queries of the seismic operators over the fixture catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import geo, stats
from ..operators import boxes, completeness, features, forest, horizons, mixture, neighbors, nulls, ordering, quality, regions, scouting, silver
from . import fixture, oracles, regional
from .fixture import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def r6(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6)


def us(c: str) -> Column:
    return F.unix_micros(c)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as text, every event twice with update times, some of it damaged."""
    c = fixture.catalog(spark, sf_dir)
    copies = c.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k, n = F.col("k"), F.col("copy")
    return copies.select(
        "id",
        F.when((k % 97 == 3) & (n == 0), "not a time").otherwise(stamp).alias("time"),
        F.when((k % 11 == 0) & (n == 0), F.lit("")).otherwise(F.concat(F.lit("2026-01-0"), (n + 1).cast("string"), F.lit("T00:00:00Z"))).alias("updated"),
        F.when(k % 89 == 5, "NA").otherwise(F.col("latitude").cast("string")).alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"),
        F.when(k % 7 == 0, "").otherwise(F.col("depth").cast("string")).alias("depth"),
        F.when((k % 83 == 7) & (n == 1), "1d").otherwise((F.col("mag") + n).cast("string")).alias("mag"),
        F.lit("earthquake").alias("type"),
        F.concat(F.lit("net"), (k % 3).cast("string")).alias("net"),
    )


# cleaning


@query
def q_silver_refine(spark, sf_dir):
    s = silver.refine(raw(spark, sf_dir))
    return s.select("id", us("time").alias("t_us"), r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), "depth", "mag", "net")


@query
def q_silver_dedup_latest(spark, sf_dir):
    s = silver.latest(silver.typed(raw(spark, sf_dir)).dropna(subset=list(model.NOT_NULL)))
    return s.select("id", "mag", F.coalesce(us("updated"), F.lit(-1)).alias("updated_us"))


@query
def q_silver_order(spark, sf_dir):
    return silver.with_order(fixture.catalog(spark, sf_dir)).select("id", "ord")


# completeness


@query
def q_fmd(spark, sf_dir):
    return completeness.fmd(fixture.catalog(spark, sf_dir)).select("bin", "center", "n", "n_cumulative")


@query
def q_mc_maxc(spark, sf_dir):
    return completeness.mc_maxc(fixture.catalog(spark, sf_dir), ("region",)).select("region", r6("mc").alias("mc"))


@query
def q_trim_to_mc(spark, sf_dir):
    return completeness.trim_to_mc(fixture.catalog(spark, sf_dir), fixture.MC).select("id", "mag")


@query
def q_estimate(spark, sf_dir):
    e = completeness.estimate(fixture.catalog(spark, sf_dir), ("region",))
    return e.select("region", r6("mc").alias("mc"), "b", "d", "n_events_catalog", "n_events_complete")


# geometry


@query
def q_haversine(spark, sf_dir):
    d = geo.haversine_km(F.radians("latitude"), F.radians("longitude"), F.radians(F.lit(-33.45)), F.radians(F.lit(-70.66)))
    return fixture.catalog(spark, sf_dir).select("id", r6(d).alias("km"))


@query
def q_border_distance(spark, sf_dir):
    return fixture.catalog(spark, sf_dir).select("id", r6(geo.border_distance_km(F.col("latitude"), F.col("longitude"), fixture.BBOX)).alias("km"))


@query
def q_gk_radius(spark, sf_dir):
    return fixture.catalog(spark, sf_dir).select("mag", r6(geo.gardner_knopoff_km(F.col("mag"))).alias("km")).distinct()


@query
def q_region_overlap(spark, sf_dir):
    several = table(spark, sf_dir, "events").where("n_aftershocks_sequence > 0 or order_in_cluster > 0")
    return boxes.overlapping(boxes.bounding(several, "cluster_id"), "cluster_id")


# pairing


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("id", "parent_id", "parent_mag", r6("log10_eta").alias("log10_eta"), r6("t_years").alias("t_years"), r6("r_km").alias("r_km"))


@query
def q_nn_uncapped(spark, sf_dir):
    return _pairs(table(spark, sf_dir, "paired"))


@query
def q_nn_radius_fixed(spark, sf_dir):
    return _pairs(table(spark, sf_dir, "capped"))


@query
def q_nn_radius_gk(spark, sf_dir):
    return _pairs(neighbors.nearest_neighbor(table(spark, sf_dir, "complete"), None, policy=model.RadiusPolicy("gk", None, 3.0)))


@query
def q_nn_by_region(spark, sf_dir):
    by = silver.with_order(table(spark, sf_dir, "complete").drop("ord"), ("region",))
    return _pairs(neighbors.nearest_neighbor(by, None, ("region",)))


@query
def q_rescaled_tr(spark, sf_dir):
    return table(spark, sf_dir, "paired").select("id", r6("log10_T").alias("log10_t"), r6("log10_R").alias("log10_r"))


# mixture


@query
def q_eta_quantiles(spark, sf_dir):
    q = ordering.quantiles(table(spark, sf_dir, "paired"), "log10_eta", (0.25, 0.5, 0.75))
    return q.select(r6("q0").alias("p25"), r6("q1").alias("p50"), r6("q2").alias("p75"))


@query
def q_eta_histogram(spark, sf_dir):
    return mixture.histogram(table(spark, sf_dir, "paired"))


@query
def q_em_step(spark, sf_dir):
    m = fixture.MIXTURE
    state = {"w": [m["weight_aftershocks"], m["weight_background"]], "mu": [m["mu_aftershocks"], m["mu_background"]], "sigma": [m["sigma_aftershocks"], m["sigma_background"]]}
    step = mixture.em_step(table(spark, sf_dir, "paired"), state)
    return step.select("n", *(r6(c).alias(c) for c in step.columns if c != "n"))


@query
def q_fit_threshold(spark, sf_dir):
    t = mixture.fit_threshold(table(spark, sf_dir, "paired"))
    m = t["mixture"]
    return spark.createDataFrame([(round(t["log10_eta0"], 4), t["n_events"], t["n_below_threshold"], round(t["expected_classification_error"], 6), *(round(m[k], 4) for k in fixture.MIXTURE), round(m["separation_sigmas"], 3))], ["log10_eta0", "n_events", "n_below_threshold", "expected_classification_error", *fixture.MIXTURE, "separation_sigmas"])


@query
def q_posterior_background(spark, sf_dir):
    return table(spark, sf_dir, "paired").where("log10_eta is not null").select("id", r6(stats.posterior_background(F.col("log10_eta"), fixture.MIXTURE)).alias("p_background"))


@query
def q_hard_threshold(spark, sf_dir):
    return table(spark, sf_dir, "thinned").select("id", "is_aftershock_eta")


# null and thinning


@query
def q_shuffle_marginals(spark, sf_dir):
    s = nulls.shuffle_marginals(table(spark, sf_dir, "complete"), 2, fixture.SEED)
    return s.select("repetition", "id", us("time").alias("t_us"), "mag", r6("latitude").alias("latitude"))


@query
def q_null_distribution(spark, sf_dir):
    n = table(spark, sf_dir, "null")
    return n.groupBy("repetition", F.floor(F.col("log10_eta") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"), r6(F.sum("log10_eta")).alias("total"))


@query
def q_null_contrast(spark, sf_dir):
    c = nulls.contrast(table(spark, sf_dir, "capped"), table(spark, sf_dir, "null"), fixture.ETA0)
    return c.select(*(r6(x).alias(x) for x in c.columns))


@query
def q_thinning(spark, sf_dir):
    return table(spark, sf_dir, "thinned").select("id", r6("p_background").alias("p_background"), "is_aftershock", "is_aftershock_eta")


@query
def q_thinning_diagnostics(spark, sf_dir):
    d = nulls.thinning_diagnostics(table(spark, sf_dir, "thinned"), fixture.SEED + 1)
    return d.withColumn("fraction_aftershocks", r6("fraction_aftershocks"))


# forest and sequences


@query
def q_cluster_assignment(spark, sf_dir):
    return forest.assign_clusters(table(spark, sf_dir, "thinned")).select("id", "cluster_id", "generation")


@query
def q_order_in_cluster(spark, sf_dir):
    return table(spark, sf_dir, "events").select("id", "cluster_id", "order_in_cluster")


@query
def q_mainshock_largest(spark, sf_dir):
    return table(spark, sf_dir, "events").where("is_mainshock").select("cluster_id", "id", "mag")


@query
def q_mainshock_root(spark, sf_dir):
    own = table(spark, sf_dir, "events").drop("is_mainshock", "order_in_cluster")
    return forest.with_mainshock(own, "root").where("is_mainshock").select("cluster_id", "id", "mag")


@query
def q_cluster_summary(spark, sf_dir):
    s = table(spark, sf_dir, "summary")
    return s.select("cluster_id", "mainshock_id", "mainshock_mag", us("mainshock_time").alias("mainshock_us"), r6("mainshock_lat").alias("mainshock_lat"), r6("mainshock_lon").alias("mainshock_lon"), "mainshock_depth", "n_events", "n_aftershocks", "n_foreshocks", F.round("duration_days", 9).alias("duration_days"), r6("extent_km").alias("extent_km"), "max_generation", "root_is_mainshock")


@query
def q_events_enriched(spark, sf_dir):
    return table(spark, sf_dir, "events").select("id", "cluster_id", "is_mainshock", "n_aftershocks_sequence", "n_aftershocks")


@query
def q_implausible_clusters(spark, sf_dir):
    return forest.implausible(table(spark, sf_dir, "summary"), 100.0).select("cluster_id", r6("extent_km").alias("extent_km"), "max_generation")


@query
def q_productivity_bins(spark, sf_dir):
    b = forest.productivity_bins(table(spark, sf_dir, "summary"))
    return b.select(r6("center").alias("center"), r6("mean_aftershocks").alias("mean_aftershocks"), "n_mainshocks")


@query
def q_productivity_fit(spark, sf_dir):
    p = forest.productivity(table(spark, sf_dir, "summary"))
    return p.select(r6("alpha").alias("alpha"), r6("intercept").alias("intercept"), r6("r2").alias("r2"), "n_bins", "plausible")


# features


@query
def q_prior_seismicity(spark, sf_dir):
    p = features.prior_seismicity(table(spark, sf_dir, "summary"), table(spark, sf_dir, "complete"), None, fixture.START)
    return p.withColumn("days_since_prior", F.round("days_since_prior", 9))  # whole seconds in days end or repeat before


@query
def q_features(spark, sf_dir):
    f = table(spark, sf_dir, "features")
    return f.select("cluster_id", "n_aftershocks", "n_prior_30d", "region_mc", "region_log10_eta0", "has_aftershock", r6("dist_to_border_km").alias("dist_to_border_km"), "near_border", "prior_window_truncated")


@query
def q_near_border(spark, sf_dir):
    return table(spark, sf_dir, "features").groupBy("near_border").agg(F.count("*").alias("n"), r6(F.min("dist_to_border_km")).alias("least_km"))


# horizons


@query
def q_aftershock_delays(spark, sf_dir):
    d = horizons.aftershock_delays(table(spark, sf_dir, "events"), table(spark, sf_dir, "summary"))
    return d.select("cluster_id", "mag", r6("delay_h").alias("delay_h"))


@query
def q_horizons(spark, sf_dir):
    return table(spark, sf_dir, "horizons").withColumn("hours_since_last", r6("hours_since_last"))


@query
def q_positives_by_horizon(spark, sf_dir):
    return horizons.positives(table(spark, sf_dir, "horizons"))


@query
def q_horizon_monotonic(spark, sf_dir):
    return horizons.violations(table(spark, sf_dir, "horizons"), table(spark, sf_dir, "summary"))


@query
def q_uncensored(spark, sf_dir):
    return features.uncensored(table(spark, sf_dir, "summary"), "2025-06-01").select("cluster_id", "n_aftershocks")


# quality, regions, scouting


@query
def q_quality_profile(spark, sf_dir):
    t = table(spark, sf_dir, "features").select("cluster_id", "mainshock_id", "mainshock_mag", "n_aftershocks", "prior_max_mag_365d", "days_since_prior")
    return quality.profile(t, "cluster_id").drop("type")


@query
def q_table_shape(spark, sf_dir):
    s = quality.shape(table(spark, sf_dir, "summary"), "n_aftershocks")
    return s.select("n_rows", r6("positive_share").alias("positive_share"), r6("mean").alias("mean"), r6("skew").alias("skew"))


@query
def q_repeated_keys(spark, sf_dir):
    s = table(spark, sf_dir, "summary").select("cluster_id", "mainshock_id")
    return quality.repeated_keys(s.unionByName(s.where("cluster_id like '%5'")))


@query
def q_combine_regions(spark, sf_dir):
    s = table(spark, sf_dir, "summary").select("cluster_id", "mainshock_id", "n_aftershocks")
    parts = {name: s.where(F.pmod(F.substring("cluster_id", 2, 20).cast("long"), F.lit(3)) == i) for i, name in enumerate(("north", "middle", "south"))}
    return regions.combine(parts)


@query
def q_regions_declustered(spark, sf_dir):
    f = regional.decluster(raw(spark, sf_dir), fixture.THREE, model.RunParams(seed=fixture.SEED), with_null=False).features
    return f.select("region", "cluster_id", "mainshock_id", "n_events", "n_aftershocks", "n_foreshocks", r6("extent_km").alias("extent_km"), "n_prior_365d", F.round("days_since_prior", 9).alias("days_since_prior"), r6("region_mc").alias("region_mc"), F.round("region_log10_eta0", 4).alias("region_log10_eta0"), r6("dist_to_border_km").alias("dist_to_border_km"))


@query
def q_feature_correlations(spark, sf_dir):
    f = features.uncensored(table(spark, sf_dir, "features"), fixture.END)
    return features.correlations(f, ("mainshock_mag", "mainshock_depth", "n_prior_365d", "dist_to_border_km"))


@query
def q_correlations_by_region(spark, sf_dir):
    f = table(spark, sf_dir, "features").withColumn("region", F.pmod(F.substring("cluster_id", 2, 20).cast("long"), F.lit(3)))
    return features.correlations(f, ("mainshock_mag", "mainshock_depth", "dist_to_border_km"), ("region",))


@query
def q_blocks_mc(spark, sf_dir):
    return scouting.blocks_mc(fixture.catalog(spark, sf_dir), 2013, 5)


@query
def q_density_strips(spark, sf_dir):
    return scouting.density_strips(fixture.catalog(spark, sf_dir))


@query
def q_mega_events(spark, sf_dir):
    m = scouting.mega_events(fixture.catalog(spark, sf_dir), 6.5)
    return m.select("id", us("time").alias("t_us"), r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), "mag")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.ORACLES.items() if k in QUERIES}
