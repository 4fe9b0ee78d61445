"""Counts of windows of time around a place by trees of totals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.operators import features, windows

DAY = 86400.0


def catalog(spark, n=1500, seed=3):
    """Crowded places, repeated moments, ages at the windows' ends, two groups, and a pole."""
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lat, lon = (-30.0 + g.uniform(-2, 2), -70.0 + g.uniform(-2, 2)) if i % 3 else (-30.0, -70.0) if i % 2 else (89.0 + g.uniform(-1, 1), g.uniform(-180, 180))
        rows.append((f"e{i:05d}", "ab"[i % 4 == 0], float(g.integers(0, 800)) * DAY if i % 2 else float(g.uniform(0, 800)) * DAY, float(lat), float(lon), float(g.integers(40, 80)) / 10))
    df = spark.createDataFrame(rows, "id string, region string, s double, latitude double, longitude double, mag double")
    return df.withColumn("time", F.timestamp_seconds("s")).localCheckpoint()


@pytest.mark.parametrize("by", [(), ("region",)])
@pytest.mark.parametrize("most", [60, 100_000])
def test_windows_as_pairs(spark, monkeypatch, by, most):
    monkeypatch.setattr(windows.before, "__defaults__", (*windows.before.__defaults__[:-1], most))
    df = catalog(spark)
    summary = df.where("id like '%3' or id like '%8'").select(*by, F.col("id").alias("cluster_id"), F.col("id").alias("mainshock_id"), F.col("time").alias("mainshock_time"), F.col("latitude").alias("mainshock_lat"), F.col("longitude").alias("mainshock_lon"))
    got = {r.cluster_id: r for r in features.prior_seismicity(summary, df, None, "1970-01-01", 80.0, by).collect()}
    rows = df.collect()
    main = [r for r in rows if r.id[-1] in "38"]
    lat, lon, s, mag = (np.array([getattr(r, c) for r in rows]) for c in ("latitude", "longitude", "s", "mag"))
    lat, lon = np.radians(lat), np.radians(lon)
    region = np.array([r.region for r in rows])
    assert len(got) == len(main)
    for m in main:
        p, q = np.radians(m.latitude), np.radians(m.longitude)
        far = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(np.sin((lat - p) / 2) ** 2 + np.cos(p) * np.cos(lat) * np.sin((lon - q) / 2) ** 2, 0, 1)))
        age = m.s / DAY - s / DAY
        some = (age > 0) & (far <= 80.0) & ((region == m.region) | (not by))
        r = got[m.id]
        assert (r.n_prior_2d, r.n_prior_30d, r.n_prior_365d) == tuple(int((some & (age <= d + 1e-9)).sum()) for d in (2, 30, 365))
        assert r.prior_max_mag_365d == (mag[some & (age <= 365 + 1e-9)].max() if (some & (age <= 365 + 1e-9)).any() else None)
        assert r.days_since_prior == (pytest.approx(age[some].min(), abs=1e-9) if some.any() else None)


def test_crowds_are_counted_and_not_met(spark, monkeypatch):
    """Events in reach grow with the square of a dense catalog; only those beside an edge are looked at, and no join meets the others."""
    met = []
    plain = features.candidate_pairs
    monkeypatch.setattr(features, "candidate_pairs", lambda main, events, low, high, by=(): met.append(low) or plain(main, events, low, high, by))
    df = catalog(spark, 300)
    summary = df.select(F.col("id").alias("cluster_id"), F.col("id").alias("mainshock_id"), F.col("time").alias("mainshock_time"), F.col("latitude").alias("mainshock_lat"), F.col("longitude").alias("mainshock_lon"))
    features.prior_seismicity(summary, df, None, "1970-01-01").count()
    assert 0 not in met  # only look-backs beyond the longest window

    g = np.random.default_rng(5)
    n, seen = 40_000, []
    lat, lon, us = np.radians(g.uniform(-31, -29, n)), np.radians(g.uniform(-71, -69, n)), g.integers(0, 400 * windows.DAY_US, n)
    query = windows.Query(100.0, (2, 30, 365))
    found = windows.Totals(lat, lon, us, np.full(n, 4.0), 100.0 / query.high).search(lat[:200], lon[:200], us[:200], query, seen)
    assert sum(seen) < 0.5 * found.counts[2].sum()


def test_a_mainshocks_own_id_is_left_out(spark):
    """Also where the catalog has it at an earlier moment."""
    rows = [("m", 100.0, 5.0), ("m", 99.0, 6.0), ("a", 98.0, 4.5), ("m2", 100.0, 5.0)]
    df = spark.createDataFrame(rows, "id string, day double, mag double").withColumns({"time": F.timestamp_seconds(F.col("day") * DAY), "latitude": F.lit(-30.0), "longitude": F.lit(-70.0)})
    summary = df.where("day = 100").select(F.col("id").alias("cluster_id"), F.col("id").alias("mainshock_id"), F.col("time").alias("mainshock_time"), F.col("latitude").alias("mainshock_lat"), F.col("longitude").alias("mainshock_lon"))
    got = {r.cluster_id: (r.n_prior_2d, r.prior_max_mag_365d, r.days_since_prior) for r in features.prior_seismicity(summary, df, None, "1970-01-01").collect()}
    assert got == {"m": (1, 4.5, 2.0), "m2": (2, 6.0, 1.0)}


def test_events_stand_in_one_cell(spark):
    """Mainshocks go to the cells around them, also over the antimeridian and at a pole; a catalog isn't copied to nine cells each."""
    from tremorline.functions import geo

    rows = [(f"e{i}", float(i), lat, lon, 4.0) for i, (lat, lon) in enumerate([(-30.0, -70.0), (-30.5, -70.5), (0.0, 179.9), (0.1, -179.9), (89.9, 10.0), (89.8, -170.0)])]
    events = spark.createDataFrame(rows, "id string, s double, latitude double, longitude double, mag double").withColumn("time", F.timestamp_seconds("s"))
    grid = geo.Grid(100.0)
    placed = features.earlier_events(events, grid)
    assert placed.count() == 6
    main = events.select(F.col("id").alias("cluster_id"), F.col("id").alias("mainshock_id"), F.col("time").alias("mainshock_time"), F.col("latitude").alias("mainshock_lat"), F.col("longitude").alias("mainshock_lon"))
    met = features.candidate_pairs(features.mainshocks(main, grid, "1970-01-01"), placed, 0, 10**9)
    assert {("e1", "e0"), ("e3", "e2"), ("e5", "e4")} <= {(r.c_cluster_id, r.p_id) for r in met.collect()}
    assert met.count() == met.select("c_cluster_id", "p_id").distinct().count()
