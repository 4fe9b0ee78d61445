"""Shuffled catalogs: what eta looks like when nothing triggers anything; thinning of links."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import stats
from . import mixture as mix
from .neighbors import nearest_neighbor
from .ordering import quantiles
from .silver import with_order

log = logging.getLogger(__name__)

#: Events up to which the driver draws numpy's permutations, 28 bytes each.
NUMPY_EVENTS = 5_000_000


def shuffle_marginals(catalog: DataFrame, repetitions: int, seed: int = 0, rng: str = "portable", by: tuple = ()) -> DataFrame:
    """Every repetition's catalog with times and magnitudes permuted, each by itself; epicentres stay.

    (repetition, id, time, latitude, longitude, mag, ...).  ``portable`` permutes places by a
    keyed Feistel network in whole numbers, which other engines can repeat, so nothing is
    sorted; ``numpy`` takes numpy's permutations from one stream for all repetitions.
    """
    if repetitions < 1:
        raise ValueError("at least one repetition is needed")
    spark = catalog.sparkSession
    own = with_order(catalog, by) if "ord" not in catalog.columns else catalog
    within = (*by, "repetition")
    if by and rng != "portable":
        raise ValueError("groups are shuffled with portable numbers only")
    if rng == "portable":
        from ..storage import written

        sizes = own.groupBy(*by).agg(F.count("*").alias("_n"))
        each = mix.joined(own, sizes, by).withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
        seeds = F.lit(int(seed)) + F.col("repetition") * 1000003
        drawn = written(each.withColumns({"_a": stats.permuted(F.col("ord"), F.col("_n"), seeds, 1), "_b": stats.permuted(F.col("ord"), F.col("_n"), seeds, 2)}).drop("_n"), "shuffled")
        taken = lambda c, place: drawn.select(*within, "ord", place).join(own.select(*by, F.col("ord").alias(place), F.col(c).alias(f"_{c}")), [*by, place]).drop(place)
        times, mags = taken("time", "_a"), taken("mag", "_b")
    elif rng == "numpy":
        from ..storage import written

        n = own.count()
        if n > NUMPY_EVENTS:
            raise ValueError(f"numpy's permutations are drawn for {NUMPY_EVENTS} events at most")
        g, places = np.random.default_rng(seed), None
        for r in range(repetitions):  # one stream for all, one repetition on the driver at a time
            drawn = pa.table({"repetition": np.full(n, r, dtype=np.int32), "ord": np.arange(1, n + 1), "_a": g.permutation(n) + 1, "_b": g.permutation(n) + 1})
            one = written(spark.createDataFrame(drawn), "permutations")
            places = one if places is None else places.unionAll(one)
        each = places.join(own, "ord")
        times = places.join(own.select(F.col("ord").alias("_a"), F.col("time").alias("_time")), "_a").select("repetition", "ord", "_time")
        mags = places.join(own.select(F.col("ord").alias("_b"), F.col("mag").alias("_mag")), "_b").select("repetition", "ord", "_mag")
        drawn = each
    else:
        raise ValueError(f"unknown generator {rng!r}; it is 'portable' or 'numpy'")
    out = drawn.drop("_a", "_b").join(times, [*within, "ord"]).join(mags, [*within, "ord"])
    return out.select("repetition", *(F.col("_time").alias(c) if c == "time" else F.col("_mag").alias(c) if c == "mag" else F.col(c) for c in catalog.columns if c not in ("ord", "repetition")))


def null_distribution(complete: DataFrame, repetitions: int = 5, seed: int = 0, b: float = model.B_VALUE, d: float = model.FRACTAL_D, policy: model.RadiusPolicy = model.RadiusPolicy(), rng: str = "portable", by: tuple = ()) -> DataFrame:
    """(by, repetition, log10_eta) of the complete events shuffled; all groups and repetitions in one plan."""
    shuffled = shuffle_marginals(complete.select(*by, "id", "time", "latitude", "longitude", "mag"), repetitions, seed, rng, by)
    found = nearest_neighbor(shuffled, None, (*by, "repetition"), b, d, policy=policy)
    return found.where("log10_eta is not null").select(*by, "repetition", "log10_eta")


def contrast(paired: DataFrame, null: DataFrame, log10_eta0: float | Column, by: tuple = ()) -> DataFrame:
    """(by, fraction observed, fraction of the null, excess, ratio, medians); the threshold is a number or a column of both."""

    def side(df: DataFrame, name: str) -> DataFrame:
        shares = df.where("log10_eta is not null").groupBy(*by).agg(F.avg((F.col("log10_eta") < log10_eta0).cast("double")).alias(f"fraction_below_threshold_{name}"))
        medians = quantiles(df, "log10_eta", (0.5,), by).withColumnRenamed("q0", f"median_{name}")
        return shares.join(medians, list(by)) if by else shares.join(medians, F.lit(True))  # one row on each side

    observed, shuffled = side(paired, "observed"), side(null, "null")
    joined = observed.join(shuffled, list(by)) if by else observed.join(shuffled, F.lit(True))  # one row on each side
    share, chance = F.col("fraction_below_threshold_observed"), F.col("fraction_below_threshold_null")
    return joined.withColumns({"excess_over_chance": share - chance, "ratio_over_chance": F.when(chance > 0, share / chance)})


def contrast_with_null(paired: DataFrame, null: DataFrame, log10_eta0: float) -> dict:
    """The same with the separation of the null's own modes, and a warning if the excess is small."""
    row = contrast(paired, null, log10_eta0).first().asDict()
    n = null.count()
    fit = mix.fit(null.select("log10_eta").toArrow().column(0).to_numpy()) if n <= mix.KERNEL_VALUES else mix.fit_distributed(null)
    row["null_mode_separation"] = fit["separation_sigmas"]
    if row["excess_over_chance"] <= model.MIN_EXCESS:
        log.warning("only %.1f points more lie below the threshold than by chance", 100 * row["excess_over_chance"])
    return row


def thin(paired: DataFrame, mixture: dict, log10_eta0, seed: int = 0, rng: str = "portable") -> DataFrame:
    """Adds p_background, is_aftershock and is_aftershock_eta.

    A link is accepted if the row's uniform number reaches the background probability;
    each row draws one, parentless ones too.  parent_id is never erased.  The mixture's
    values and the threshold are numbers or columns.
    """
    own = with_order(paired) if "ord" not in paired.columns else paired
    x = F.col("log10_eta")
    linked = x.isNotNull()
    u = stats.numpy_uniform(F.col("ord"), seed) if rng == "numpy" else stats.portable_uniform(F.col("ord"), seed, 3)
    cut = log10_eta0 if not isinstance(log10_eta0, (int, float)) else F.lit(float(log10_eta0))
    background = F.when(linked, stats.posterior_background(x, mixture)).otherwise(1.0)
    return own.withColumn("p_background", background).withColumn("is_aftershock", linked & (u >= F.col("p_background"))).withColumn("is_aftershock_eta", F.coalesce(x < cut, F.lit(False)))


def thinning_diagnostics(thinned: DataFrame, seed: int = 0, by: tuple = ()) -> DataFrame:
    a, e = F.col("is_aftershock"), F.col("is_aftershock_eta")
    return thinned.groupBy(*by).agg(
        F.lit(int(seed)).alias("seed"),
        F.count("*").alias("n_events"),
        F.count_if(a).alias("n_aftershocks"),
        F.count_if(e).alias("n_aftershocks_by_threshold"),
        F.count_if(e & ~a).alias("n_returned_to_background"),
        F.count_if(a & ~e).alias("n_added_to_aftershocks"),
        F.avg(a.cast("double")).alias("fraction_aftershocks"),
    )
