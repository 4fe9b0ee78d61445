"""A deterministic catalog over the driver's events table, and the stages on top of it.

Stages are written once for each session and folder, so that fifty queries don't
search for the same neighbours fifty times.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import completeness, features, forest, horizons, neighbors, nulls, silver
from ..storage import written

#: The view in SQL that Spark and DuckDB both run.
CATALOG = """
SELECT 'q' || CAST(event_id AS VARCHAR(20)) AS id, event_id AS k, CAST(a % 3 AS BIGINT) AS region,
  1451606400000000 + ((a * 15485863) % 315360000) * 1000000
    + CASE WHEN child THEN ((event_id * 7349) % 172800 + 60) * 1000000 ELSE 0 END AS t_us,
  -55e0 + ((a * 7919 + 13) % 33000) / 1e3 + CASE WHEN child THEN ((event_id * 31) % 41 - 20) / 2e2 ELSE 0e0 END AS latitude,
  -74e0 + ((a * 104729 + 7) % 21000) / 1e3 + CASE WHEN child THEN ((event_id * 37) % 41 - 20) / 2e2 ELSE 0e0 END AS longitude,
  CAST((event_id * 17) % 200 AS DOUBLE) AS depth,
  4e0 + least(floor(value / 25e0), 25e0) / 1e1 + CASE WHEN event_id % 5 = 0 THEN 1e0 ELSE 0e0 END AS mag
FROM (SELECT event_id, value, event_id % 5 IN (1, 2) AS child,
             CASE WHEN event_id % 5 IN (1, 2) THEN event_id - event_id % 5 ELSE event_id END AS a FROM {events}) e
"""
MC, ETA0 = 4.2, -5.2859
MIXTURE = {"weight_aftershocks": 0.29736, "weight_background": 0.70264, "mu_aftershocks": -6.59456, "mu_background": -3.69999, "sigma_aftershocks": 0.58544, "sigma_background": 0.61666}
SEED = 1
START, END = "2016-01-01", "2026-01-01"
BBOX = (-55.0, -21.0, -74.0, -53.0)
#: A configuration of regions that cover the catalog.
THREE = [{"name": name, "minlatitude": south, "maxlatitude": north, "minlongitude": -75.0, "maxlongitude": -52.0, "starttime": START, "endtime": END, "minmagnitude": 3.5} for name, south, north in (("middle", -44.0, -33.0), ("north", -33.0, -21.0), ("south", -56.0, -44.0))]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, region, time, t_us, latitude, longitude, depth, mag."""
    rows = spark.sql(CATALOG.format(events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.withColumn("time", F.timestamp_micros("t_us"))


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def _complete(spark, sf_dir):
    return silver.with_order(completeness.trim_to_mc(catalog(spark, sf_dir), MC))


def _paired(spark, sf_dir):
    return neighbors.nearest_neighbor(table(spark, sf_dir, "complete"), None)


def _thinned(spark, sf_dir):
    return nulls.thin(table(spark, sf_dir, "paired"), MIXTURE, ETA0, SEED + 1)


def _events(spark, sf_dir):
    return forest.build_clusters(table(spark, sf_dir, "thinned"))[0]


def _summary(spark, sf_dir):
    return forest.summarize(table(spark, sf_dir, "events").select(*table(spark, sf_dir, "thinned").columns, "cluster_id", "generation", "order_in_cluster", "is_mainshock"))


def _features(spark, sf_dir):
    return features.build_features(table(spark, sf_dir, "summary"), table(spark, sf_dir, "complete"), MC, ETA0, START, bbox=BBOX)


def _horizons(spark, sf_dir):
    return horizons.build_horizons(table(spark, sf_dir, "summary"), table(spark, sf_dir, "events"), END)


def _null(spark, sf_dir):
    return nulls.null_distribution(table(spark, sf_dir, "complete"), 2, SEED, policy=model.RadiusPolicy("fixed", 300.0))


def _capped(spark, sf_dir):
    return neighbors.nearest_neighbor(table(spark, sf_dir, "complete"), None, policy=model.RadiusPolicy("fixed", 300.0))


_MAKERS = {"complete": _complete, "paired": _paired, "thinned": _thinned, "events": _events, "summary": _summary, "features": _features, "horizons": _horizons, "null": _null, "capped": _capped}


#: Seconds that each stage took, without the stages it builds on; for the benchmark.
SECONDS: dict[str, float] = {}
_OPEN: list[float] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        began = time.time()
        _OPEN.append(0.0)
        _TABLES[key] = written(_MAKERS[name](spark, sf_dir), f"fixture-{name}")
        took, below = time.time() - began, _OPEN.pop()
        SECONDS[name] = round(took - below, 3)
        if _OPEN:
            _OPEN[-1] += took
    return _TABLES[key]
