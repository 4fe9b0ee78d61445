"""From the event service to published sequences, for one region or several."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import model
from ..operators import completeness, features, forest, horizons, mixture, neighbors, nulls, quality, regions, silver
from ..sources import fdsn, files
from ..storage import Layers, Scratch, written


@dataclass
class Run:
    """What a region's run has made."""

    params: model.RunParams
    silver: DataFrame
    estimate: dict
    paired: DataFrame
    threshold: dict
    null: DataFrame
    contrast: dict
    thinned: DataFrame
    events: DataFrame
    summary: DataFrame
    features: DataFrame
    horizons: DataFrame


def download(spark: SparkSession, params: model.RunParams, **options: str) -> DataFrame:
    """The raw catalog of a run from the event service; ``options`` has its ``url`` or a ``client``."""
    spark.dataSource.register(fdsn.FdsnSource)
    asked = {"starttime": params.starttime, "endtime": params.endtime, "minmagnitude": params.minmagnitude, "limit": params.limit} | dict(zip(fdsn.BOX, params.edges, strict=True))
    return spark.read.format("fdsn").options(**{k: str(v) for k, v in asked.items() if v is not None}, **options).load()


def land(spark: SparkSession, layers: Layers, params: model.RunParams, source: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The raw catalog as it is stored; ``source`` is asked only if nothing is, or if all is made anew."""
    path = layers.path("bronze", params.names()["bronze"])
    if not layers.fresh(path):
        files.write_bronze(source(), path)
    return files.read_bronze(spark, path), path


def decluster(raw: DataFrame | Callable[[], DataFrame], params: model.RunParams = model.RunParams(), rng: str = "portable", layers: Layers | None = None) -> Run:
    """All stages on one region.

    With ``layers`` each stage's result is kept under the run's names and used again while
    it is newer than what it was made from; without, tables between stages go to the shared
    folder.  The drawn numbers come from ``seed`` for the shuffles and ``seed + 1`` for thinning.
    """
    keep, names = layers or Scratch(), params.names()
    clean, at_silver = keep.table("silver", names["silver"], lambda: silver.refine(raw() if callable(raw) else raw))
    known = completeness.require(completeness.estimate(clean))[0].asDict()
    held = []

    def complete() -> DataFrame:
        if not held:
            held.append(written(silver.with_order(completeness.trim_to_mc(clean, known["mc"])), "complete"))
        return held[0]

    paired, at_paired = keep.table("neighbors", names["neighbors"], lambda: neighbors.nearest_neighbor(complete(), None, b=known["b"], d=known["d"], policy=params.radius), [at_silver])
    threshold, at_threshold = keep.json("threshold", names["threshold"], lambda: mixture.fit_threshold(paired), [at_paired])
    null, at_null = keep.table("null", names["null"], lambda: nulls.null_distribution(complete(), params.n_randomizations, params.seed, known["b"], known["d"], params.radius, rng), [at_silver])
    contrast = nulls.contrast_with_null(paired, null, threshold["log10_eta0"])
    thinned, at_thinned = keep.table("aftershocks", names["aftershocks"], lambda: nulls.thin(paired, threshold["mixture"], threshold["log10_eta0"], params.seed + 1, rng), [at_paired, at_threshold, at_null])
    made = []

    def clusters(which: int) -> DataFrame:
        if not made:
            made.append(forest.build_clusters(thinned, params.mainshock))
        return made[0][which]

    events, at_events = keep.table("clusters", names["events"], lambda: clusters(0), [at_thinned])
    summary, at_summary = keep.table("clusters", names["summary"], lambda: clusters(1), [at_thinned])
    table, _ = keep.table("features", names["features"], lambda: features.build_features(summary, clean, known["mc"], threshold["log10_eta0"], params.starttime, params.prior_radius_km, params.bbox, params.border_buffer_km), [at_summary, at_silver, at_threshold])
    hours, _ = keep.table("features", names["horizons"], lambda: horizons.build_horizons(summary, events, params.endtime, days=params.horizon_days), [at_summary, at_events])
    return Run(params, clean, known, paired, threshold, null, contrast, thinned, events, summary, table, hours)


def gate(tables: dict[str, tuple[DataFrame, str]], min_rows: int) -> dict:
    """The quality reports of tables by name, each with its key; an error lists what doesn't meet the criteria."""
    checked = {name: quality.check(table, key, name, min_rows) for name, (table, key) in tables.items()}
    if problems := [p for _, found in checked.values() for p in found]:
        raise ValueError("the published tables don't meet the criteria: " + "; ".join(problems))
    return {name: report for name, (report, _) in checked.items()}


def publish(run: Run, root: str, min_rows: int = model.MIN_ROWS) -> dict:
    """Writes the tables, then checks them, so a table that fails can be looked at."""
    names = run.params.names()
    horizons.check_invariants(run.horizons, run.summary, run.params.horizon_days)
    files.write_csv(run.features, f"{root}/delivery/{names['clusters_csv']}", single=True)
    files.write_csv(run.events.drop("ord", "p_ord"), f"{root}/delivery/{names['events_csv']}", single=True)
    files.write_csv(horizons.published(run.horizons), f"{root}/delivery/{names['horizons_csv']}", single=True)
    layers = Layers(run.features.sparkSession, root)
    path = layers.path("threshold", names["threshold"])
    if layers.changed(path) is None or layers.read_json(path) != run.threshold:  # one that is the same stays as old as it is
        layers.write_json("threshold", names["threshold"], run.threshold)
    return gate({"clusters": (run.features, "cluster_id"), "events": (run.events, "id")}, min_rows)


def run_region(spark: SparkSession, root: str, params: model.RunParams = model.RunParams(), source: Callable[[], DataFrame] | None = None, rng: str = "portable", min_rows: int = model.MIN_ROWS, **options: str) -> tuple[Run, dict]:
    """From the service to the delivery in one call: (run, quality reports).

    ``source`` gives the raw catalog; without it the service is asked with ``options``.
    What is stored below ``root`` and still fresh isn't made again unless ``params.force``.
    """
    layers = Layers(spark, root, params.force)
    raw, _ = land(spark, layers, params, source or (lambda: download(spark, params, **options)))
    run = decluster(raw, params, rng, layers)
    return run, publish(run, root, min_rows)


def decluster_regions(raw: dict[str, DataFrame], configuration: list[dict], params: model.RunParams = model.RunParams(), rng: str = "portable", layers: Layers | None = None) -> tuple[DataFrame, DataFrame, dict[str, Run]]:
    """(sequences, horizons, runs) of all regions: each with its own Mc and threshold, then united and checked."""
    regions.validate(configuration)
    runs = {r["name"]: decluster(raw[r["name"]], params.for_region(r), rng, layers) for r in configuration}
    return *united(runs), runs


def united(runs: dict[str, Run]) -> tuple[DataFrame, DataFrame]:
    """The sequences and the horizons of all regions; a cluster has a row for each horizon, so these have no key."""
    return regions.combine({n: r.features for n, r in runs.items()}), regions.combine({n: r.horizons for n, r in runs.items()}, keys=())


def publish_combined(sequences: DataFrame, hours: DataFrame, configuration: list[dict], root: str, params: model.RunParams = model.RunParams(), min_rows: int = model.MIN_ROWS) -> dict:
    """Writes both tables of all regions, named by what was combined, then checks the sequences."""
    names = params.names(f"combined_{model.regions_tag(configuration)}")
    files.write_csv(sequences, f"{root}/delivery/{names['clusters_csv']}", single=True)
    files.write_csv(horizons.published(hours), f"{root}/delivery/{names['horizons_csv']}", single=True)
    return gate({"combined": (sequences, "cluster_id")}, min_rows)


def run_regions(spark: SparkSession, root: str, configuration: list[dict] | None = None, params: model.RunParams = model.RunParams(), sources: dict[str, Callable[[], DataFrame]] | None = None, rng: str = "portable", min_rows: int = model.MIN_ROWS, **options: str) -> dict:
    """Every region from the service to its delivery, then their union: quality reports by region and of the union."""
    configuration = regions.REGIONS if configuration is None else configuration
    regions.validate(configuration)
    runs, reports = {}, {}
    for r in configuration:
        name = r["name"]
        runs[name], reports[name] = run_region(spark, root, params.for_region(r), (sources or {}).get(name), rng, min_rows, **options)
    return reports | publish_combined(*united(runs), configuration, root, params, min_rows)
