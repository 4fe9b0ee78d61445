"""Written answers, metamorphic and brute-force tests of the seismic operators."""

import datetime as dt
import logging
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremorline import model
from tremorline.functions import geo, stats
from tremorline.operators import completeness, curve, features, forest, horizons, mixture, neighbors, nulls, ordering, quality, regions, silver, tree

SCHEMA = "id string, time timestamp, latitude double, longitude double, depth double, mag double"
T0 = dt.datetime(2020, 1, 1, tzinfo=dt.UTC)


def catalog(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), float(lat), float(lon), 10.0, float(m)) for i, h, lat, lon, m in rows], SCHEMA)


def random_catalog(spark, n, seed=0, lat=(-40, -20), lon=(-75, -60), ties=True):
    g = np.random.default_rng(seed)
    hours = np.sort(g.uniform(0, 9000, n))
    if ties:
        hours[1::7] = hours[::7][: len(hours[1::7])]
    rows = [(f"e{i:04d}", float(h), float(g.uniform(*lat)), float(g.uniform(*lon)), float(round(4 + g.exponential(0.5), 1))) for i, h in enumerate(hours)]
    return catalog(spark, rows), rows


def parents(df):
    return {r.id: r.parent_id for r in df.select("id", "parent_id").collect()}


def test_known_parents(spark):
    df = catalog(spark, [("A", 0, -30, -70, 7.0), ("B", 10, -40, -65, 4.5), ("C", 20, -22, -60, 4.5), ("D", 30, -30.05, -70.05, 4.5)])
    out = neighbors.nearest_neighbor(df, 4.0)
    rows = {r.id: r for r in out.collect()}
    assert rows["A"].parent_id is None and rows["A"].eta is None and rows["A"].log10_eta is None
    assert rows["D"].parent_id == "A" and rows["D"].parent_mag == 7.0
    for r in rows.values():
        if r.eta is not None:
            assert r.log10_eta == pytest.approx(r.log10_T + r.log10_R)


def test_radius_caps(spark):
    df = catalog(spark, [("A", 0, -30, -70, 7.0), ("B", 5, -30.1, -70.1, 4.5), ("C", 10, -40, -70, 4.5)])
    assert parents(neighbors.nearest_neighbor(df, 4.0, policy=model.RadiusPolicy("fixed", 300))) == {"A": None, "B": "A", "C": None}
    assert parents(neighbors.nearest_neighbor(df, 4.0))["C"] == "A"
    df = catalog(spark, [("A", 0, -33.1, -70, 8.0), ("B", 1, -33.9, -70, 4.5), ("D", 2001, -34.0, -70, 4.5)])
    assert parents(neighbors.nearest_neighbor(df, 4.0))["D"] == "A"
    assert parents(neighbors.nearest_neighbor(df, 4.0, policy=model.RadiusPolicy("fixed", 50)))["D"] == "B"
    for mag, want in ((4.5, None), (7.0, "A")):
        df = catalog(spark, [("A", 0, -30, -70, mag), ("B", 1, -31, -70, 4.5)])
        assert parents(neighbors.nearest_neighbor(df, 4.0, policy=model.RadiusPolicy("gk", None, 3.0)))["B"] == want
    for bad in ({"mode": "x"}, {"max_km": 0}, {"mode": "gk", "k": 0}):
        with pytest.raises(ValueError):
            model.RadiusPolicy(**bad)


def brute(rows, cap=None, gk=None, d=1.5):
    out = {}
    for j, (i, h, lat, lon, _) in enumerate(rows):
        best = None
        for k, (p, hp, latp, lonp, mp) in enumerate(rows):
            us = round(h * 3600e6) - round(hp * 3600e6)
            if us <= 0:
                continue
            a = math.sin(math.radians(lat - latp) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(latp)) * math.sin(math.radians(lon - lonp) / 2) ** 2
            r = 2 * 6371 * math.asin(math.sqrt(min(1, a)))
            if r > (cap or 1e9) or gk and r > gk * 10 ** (0.1238 * mp + 0.983):
                continue
            eta = us / 1e6 / 31557600 * max(r, 0.01) ** d * 10**-mp
            if best is None or (eta, k) < best[:2]:
                best = (eta, k, p)
        out[i] = best and best[2]
    return out


@pytest.mark.parametrize("place", [((-40, -20), (-75, -60)), ((80, 90), (-180, 180)), ((-10, 10), (-180, 180))])
def test_every_search_as_brute_force(spark, place):
    df, rows = random_catalog(spark, 150, 3, *place)
    rows = sorted(rows, key=lambda r: (round(r[1] * 3600e6), r[0]))
    for strategy in ("blocks", "tree", "bounded", "theta"):
        assert parents(neighbors.nearest_neighbor(df, None, strategy=strategy)) == brute(rows), strategy
    for strategy in ("grid", "tree", "curve"):
        for cap in (60.0, 700.0):
            assert parents(neighbors.nearest_neighbor(df, None, policy=model.RadiusPolicy("fixed", cap), strategy=strategy)) == brute(rows, cap)
        assert parents(neighbors.nearest_neighbor(df, None, policy=model.RadiusPolicy("gk", None, 4.0), strategy=strategy)) == brute(rows, gk=4.0)


def test_huge_radius_is_no_radius(spark):
    df, _ = random_catalog(spark, 120, 5)
    free = neighbors.nearest_neighbor(df, None).orderBy("id").collect()
    for policy in (model.RadiusPolicy("fixed", 1e6), model.RadiusPolicy("gk", None, 1e6)):
        assert neighbors.nearest_neighbor(df, None, policy=policy).orderBy("id").collect() == free
    other = neighbors.nearest_neighbor(df.orderBy(F.rand(1)).repartition(7), None).orderBy("id").collect()
    assert other == free


def test_too_few_events(spark):
    with pytest.raises(ValueError):
        neighbors.nearest_neighbor(catalog(spark, [("A", 0, 0, 0, 5.0)]), 4.0)
    with pytest.raises(ValueError):
        neighbors.nearest_neighbor(catalog(spark, [("A", 0, 0, 0, 5.0), ("B", 1, 0, 0, 5.0)]), 4.0, p=2)


def raw(spark, rows):
    names = ("id", "time", "updated", "latitude", "longitude", "depth", "mag", "type")
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_cleaning(spark):
    t = "2020-01-01T00:00:00.500Z"
    rows = [
        ("a", t, "2020-01-02T00:00:00Z", "1", "2", "", "4.5", "e"),
        ("a", t, "2020-01-03T00:00:00Z", "1", "2", "3", "4.6", "e"),
        ("b", t, "2020-01-03T00:00:00Z", "1", "2", "3", "5.0", "e"),
        ("b", t, None, "1", "2", "3", "5.1", "e"),
        ("c", "bad", "2020-01-03", "1", "2", "3", "5", "e"),
        ("d", t, "2020-01-03", "1d", "2", "3", "5", "e"),
        ("e", t, "2020-01-03", "NA", "2", "3", "5", "e"),
        ("f", "2019-01-01T00:00:00Z", "x", " 2 ", "1e1", "nan", "+3", "e"),
        ("g", t, "x", "0x10", "1", "1", "1", "e"),
        ("None", t, "x", "1", "1", "1", "1", "e"),
    ]
    out = silver.refine(raw(spark, rows))
    assert {r.id: r.mag for r in out.collect()} == {"a": 4.6, "b": 5.1, "f": 3.0}
    assert "type" not in out.columns and [r.id for r in silver.with_order(out).orderBy("ord").collect()] == ["f", "a", "b"]
    with pytest.raises(ValueError):
        silver.refine(raw(spark, rows).drop("mag"))
    assert silver.refine(raw(spark, [])).count() == 0


def test_completeness(spark):
    mags = [4.0] * 5 + [4.1] * 5 + [4.3] * 2 + [4.25, 4.35]
    df = catalog(spark, [(f"x{i}", i, 0, 0, m) for i, m in enumerate(mags)])
    rows = completeness.fmd(df).orderBy("bin").collect()
    assert [(r.center, r.n, r.n_cumulative) for r in rows] == [(4.0, 5, 14), (4.1, 5, 9), (4.2, 1, 4), (4.3, 2, 3), (4.4, 1, 1)] or sum(r.n for r in rows) == 14
    assert completeness.mc_maxc(df).first().mc == pytest.approx(4.2)
    with pytest.raises(ValueError):
        completeness.require(completeness.estimate(df))
    halves = np.arange(400, 700) / 100
    got = [r.b for r in spark.createDataFrame([(float(x),) for x in halves], "m double").select(stats.magnitude_bin(F.col("m")).alias("b")).collect()]
    assert got == np.round(halves / 0.1).tolist()


def test_mixture(spark):
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(-6.5, 0.5, 3000), g.normal(-3.5, 0.7, 7000)])
    m = mixture.fit(x)
    assert (round(m["weight_aftershocks"], 1), round(m["mu_aftershocks"], 1), round(m["mu_background"], 1)) == (0.3, -6.5, -3.5)
    df = spark.createDataFrame([(float(v),) for v in x[::5]], "log10_eta double")
    a, b = mixture.fit(x[::5]), mixture.fit_distributed(df)
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a if k != "iterations")
    t = mixture.fit_threshold(df)
    counts, edges = np.histogram(x[::5], bins=60)
    assert t["histogram"]["counts"] == counts.tolist() and np.allclose(t["histogram"]["edges"], edges)
    assert t["n_below_threshold"] == int((x[::5] < t["log10_eta0"]).sum()) and -6 < t["log10_eta0"] < -4
    assert mixture.fit_threshold(df, manual=-5)["log10_eta0"] == -5 and mixture.fit_threshold(df, manual=-5)["mixture"] == t["mixture"]
    with pytest.raises(ValueError):
        mixture.fit(x[:19])
    assert mixture.crossing({"weight_aftershocks": 0.999, "weight_background": 0.001, "mu_aftershocks": 0.0, "mu_background": 0.1, "sigma_aftershocks": 1.0, "sigma_background": 1.0}) is None


def test_shuffles_keep_marginals(spark):
    df, rows = random_catalog(spark, 80, 8)
    for rng in ("portable", "numpy"):
        s = nulls.shuffle_marginals(df, 2, 5, rng).collect()
        for rep in (0, 1):
            own = [r for r in s if r.repetition == rep]
            assert sorted(r.mag for r in own) == sorted(r[4] for r in rows) and {(r.id, r.latitude) for r in own} == {(r[0], r[2]) for r in rows}
            assert sorted(r.time for r in own) == sorted(r.time for r in df.collect()) and [r.mag for r in sorted(own, key=lambda r: r.id)] != [r[4] for r in rows]
    capped = nulls.null_distribution(df, 2, 1, policy=model.RadiusPolicy("fixed", 100)).count()
    assert capped < nulls.null_distribution(df, 2, 1).count() == 2 * 79 or capped < 160
    with pytest.raises(ValueError):
        nulls.shuffle_marginals(df, 0)


def test_permutations_are_one_to_one_and_without_a_sort(spark):
    sizes = [1, 2, 3, 5, 6, 7, 12, 50, 99, 1000, 4097]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    made = rows.select("n", "place", *(stats.permuted(F.col("place"), F.col("n"), F.lit(seed), 1).alias(f"p{seed}") for seed in (3, 4))).toPandas()
    for n, own in made.groupby("n"):
        for p in ("p3", "p4"):
            assert sorted(own[p]) == list(range(1, n + 1)), (n, p)
        if n >= 50:
            assert (own["p3"] != own["p4"]).mean() > 0.9 and abs(own["p3"].corr(own["place"])) < 4 / n**0.5
    df, _ = random_catalog(spark, 60, 2)
    plan = nulls.shuffle_marginals(silver.with_order(df), 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_uniforms(spark):
    n = 20000
    df = spark.range(1, n + 1).repartition(5)
    u = np.array([r.u for r in df.select("id", stats.numpy_uniform(F.col("id"), 7).alias("u")).orderBy("id").collect()])
    assert (u == np.random.default_rng(7).random(n)).all()
    p = np.array([r.u for r in df.select("id", stats.portable_uniform(F.col("id"), 7, 3).alias("u")).orderBy("id").collect()])
    assert abs(p.mean() - 0.5) < 0.01 and abs(p.std() - 0.2887) < 0.01 and p.min() >= 0 and p.max() < 1
    assert abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.03


MIX = {"weight_aftershocks": 0.3, "weight_background": 0.7, "mu_aftershocks": -6.5, "mu_background": -3.7, "sigma_aftershocks": 0.6, "sigma_background": 0.6}


def test_thinning(spark):
    df = spark.createDataFrame([(i, f"p{i}" if i else None, [-9.0, -5.2, -1.0][i % 3] if i else None) for i in range(300)], "ord long, parent_id string, log10_eta double")
    for rng in ("portable", "numpy"):
        out = nulls.thin(df.withColumn("ord", F.col("ord") + 1), MIX, -5.0, 3, rng).collect()
        first = next(r for r in out if r.log10_eta is None)
        assert first.p_background == 1 and not first.is_aftershock and not first.is_aftershock_eta
        assert all(r.is_aftershock for r in out if r.log10_eta == -9) and not any(r.is_aftershock for r in out if r.log10_eta == -1)
        assert all(r.is_aftershock_eta == (r.log10_eta < -5) for r in out if r.log10_eta is not None) and all(r.parent_id for r in out if r.ord > 1)
        share = np.mean([r.is_aftershock for r in out if r.log10_eta == -5.2])
        assert 0.1 < share < 0.9


FOREST = [("A", 0, 6.0, None, False), ("B", 1, 5.0, "A", True), ("C", 2, 6.5, "A", True), ("D", 3, 4.0, "B", True), ("E", 4, 4.0, "D", False), ("F", 5, 4.5, "E", True), ("G", 6, 6.5, "C", True)]


def classified(spark):
    rows = [(i, T0 + dt.timedelta(hours=h), 0.0, 0.1 * h, 10.0, m, p, a) for i, h, m, p, a in FOREST]
    return spark.createDataFrame(rows, SCHEMA + ", parent_id string, is_aftershock boolean")


def test_forest(spark):
    events, summary = forest.build_clusters(classified(spark))
    e = {r.id: r for r in events.collect()}
    assert {i: (r.cluster_id, r.generation, r.order_in_cluster) for i, r in e.items()} == {"A": ("A", 0, 0), "B": ("A", 1, 1), "C": ("A", 1, 2), "D": ("A", 2, 3), "G": ("A", 2, 4), "E": ("E", 0, 0), "F": ("E", 1, 1)}
    s = {r.cluster_id: r for r in summary.collect()}
    assert (s["A"].mainshock_id, s["A"].n_events, s["A"].n_foreshocks, s["A"].n_aftershocks, s["A"].max_generation, s["A"].root_is_mainshock) == ("C", 5, 2, 2, 2, False)
    assert s["A"].duration_days == 0.25 and s["A"].extent_km == pytest.approx(0.4 * math.pi / 180 * 6371)
    assert s["E"].mainshock_id == "F" and e["C"].n_aftershocks == 2 and e["A"].n_aftershocks == 0 and e["A"].n_aftershocks_sequence == 2
    _, roots = forest.build_clusters(classified(spark), "root")
    assert {r.cluster_id: r.n_aftershocks for r in roots.collect()} == {"A": 4, "E": 1}
    with pytest.raises(ValueError):
        forest.build_clusters(classified(spark), "first")
    with pytest.raises(ValueError):
        forest.assign_clusters(classified(spark).withColumn("parent_id", F.when(F.col("id") == "B", "D").otherwise(F.col("parent_id"))))


def test_long_chain(spark):
    rows = [(f"n{i:03d}", T0 + dt.timedelta(hours=i), 0.0, 0.0, 10.0, 4.0, f"n{i - 1:03d}" if i else None, i > 0) for i in range(200)]
    out = forest.assign_clusters(spark.createDataFrame(rows, SCHEMA + ", parent_id string, is_aftershock boolean")).collect()
    assert all(r.cluster_id == "n000" and r.generation == int(r.id[1:]) for r in out)


def test_chains_are_followed_in_parts_of_space(spark, monkeypatch):
    """Links inside a part aren't joined, and parts that cut every chain give the same clusters, by group."""
    g, n = np.random.default_rng(3), 2000
    up = [int(g.integers(max(0, i - 60), i)) if i and g.random() < 0.99 else None for i in range(n)]
    rows = [(f"n{i:04d}", T0 + dt.timedelta(hours=i), float(g.uniform(-40, -30)), float(g.uniform(-75, -65)), 10.0, 4.0, None if u is None else f"n{u:04d}", i % 7 > 0) for i, u in enumerate(up)]
    df = spark.createDataFrame(rows, SCHEMA + ", parent_id string, is_aftershock boolean")
    want = {}
    for r in rows:
        root, depth = want[r[6]] if r[6] and r[7] else (r[0], -1)
        want[r[0]] = (root, depth + 1)
    real, counted = forest.written, []

    def counting(df, name):
        out = real(df, name)
        counted.append(out.count() if name == "ancestors" else 0)
        return out

    monkeypatch.setattr(forest, "written", counting)
    found = lambda out: {r.id: (r.cluster_id, r.generation) for r in out.collect()}
    assert found(forest.assign_clusters(df)) == want and sum(counted) == 0
    assert found(forest.assign_clusters(df, most=50)) == want and sum(counted) > 0
    twice = df.withColumn("region", F.explode(F.array(F.lit(0), F.lit(1))))
    out = forest.assign_clusters(twice, ("region",), 200)
    assert out.count() == 2 * n and found(out.where("region = 0")) == found(out.where("region = 1")) == want
    with pytest.raises(ValueError, match="not an earlier event"):
        forest.assign_clusters(df.where("id <> 'n0002'").withColumn("is_aftershock", F.lit(True)))


def test_productivity(spark):
    rows = []
    for k, m in enumerate((4.25, 4.75, 5.25, 5.75, 6.25)):
        rows += [(f"c{k}-{i}", m, round(10 ** (0.9 * (m - 4)) * 10)) for i in range(6)]
    fit = forest.productivity(spark.createDataFrame(rows, "cluster_id string, mainshock_mag double, n_aftershocks int")).first()
    assert fit.alpha == pytest.approx(0.9, abs=0.01) and fit.r2 > 0.999 and fit.plausible and fit.n_bins == 5
    assert forest.productivity(spark.createDataFrame(rows[:12], "cluster_id string, mainshock_mag double, n_aftershocks int")).count() == 0


MAIN = dt.datetime(2020, 6, 1, tzinfo=dt.UTC)
PRIOR = [("MAIN", 0, 0, 7.0), ("E1", 1, 10, 5.0), ("E2", 10, 50, 5.8), ("E3", 200, 99, 4.6), ("E4", 5, 150, 6.0), ("E5", 400, 10, 6.5), ("E6", -3, 10, 5.0), ("E7", 0.5, 10, 4.0)]


def test_prior_seismicity(spark):
    km = 180 / math.pi / 6371
    df = spark.createDataFrame([(i, MAIN - dt.timedelta(days=d), -30 + k * km, -70.0, 10.0, m) for i, d, k, m in PRIOR], SCHEMA)
    summary = spark.createDataFrame([("MAIN", "MAIN", MAIN, -30.0, -70.0, 1), ("X", "X", MAIN, 40.0, 100.0, 0)], "cluster_id string, mainshock_id string, mainshock_time timestamp, mainshock_lat double, mainshock_lon double, n_aftershocks int")
    rows = {r.cluster_id: r for r in features.prior_seismicity(summary, df, 4.5, "2010-01-01").collect()}
    r = rows["MAIN"]
    assert (r.n_prior_2d, r.n_prior_30d, r.n_prior_365d, r.prior_max_mag_365d, r.days_since_prior, r.prior_window_truncated) == (1, 2, 3, 5.8, 1.0, False)
    x = rows["X"]
    assert (x.n_prior_365d, x.prior_max_mag_365d, x.days_since_prior) == (0, None, None)
    late = {q.cluster_id: q for q in features.prior_seismicity(summary, df, 4.5, MAIN - dt.timedelta(days=100)).collect()}
    assert late["MAIN"].prior_window_truncated
    for radius, n in ((20, 1), (200, 4)):
        assert next(q for q in features.prior_seismicity(summary, df, 4.5, "2010-01-01", radius).collect() if q.cluster_id == "MAIN").n_prior_365d == n
    full = features.build_features(summary, df, 4.5, -5.0, "2010-01-01", bbox=(-32, -10, -90, -40))
    assert full.columns[: len(summary.columns)] == summary.columns and full.columns[-2:] == ["dist_to_border_km", "near_border"]
    assert "near_border" not in features.build_features(summary, df, 4.5, -5.0, "2010-01-01").columns


def test_borders(spark):
    def at(lat, lon, box):
        return spark.range(1).select(geo.border_distance_km(F.lit(float(lat)), F.lit(float(lon)), box)).first()[0]

    box = (-32, -10, -90, -40)
    assert at(-30, -65, box) == pytest.approx(2 * 111.195, rel=1e-4)
    assert at(60, 1, (0, 89, 0, 100)) == pytest.approx(111.195 / 2, rel=1e-3)
    near = features.add_border(spark.createDataFrame([(-31.5, -65.0), (-20.0, -65.0)], "mainshock_lat double, mainshock_lon double"), box).collect()
    assert [r.near_border for r in near] == [True, False]


def horizon_tables(spark, end="2026-01-01"):
    t = dt.datetime(2020, 1, 1, tzinfo=dt.UTC)
    a = [(-2, 4.6), (0, 7.0), (0.5, 5.0), (10, 4.8), (72, 4.9), (960, 5.5)]
    rows = [("A", "A-main" if m == 7.0 else f"A{i}", t + dt.timedelta(hours=h), m) for i, (h, m) in enumerate(a)] + [("B", "B-main", t, 6.0)]
    events = spark.createDataFrame(rows, "cluster_id string, id string, time timestamp, mag double")
    summary = spark.createDataFrame([("A", "A-main", t, 4, 40.0), ("B", "B-main", t, 0, 0.0)], "cluster_id string, mainshock_id string, mainshock_time timestamp, n_aftershocks int, duration_days double")
    return summary, horizons.build_horizons(summary, events, end), events


def test_horizons(spark):
    summary, h, events = horizon_tables(spark)
    a = [r for r in h.orderBy("horizon_hours").collect() if r.cluster_id == "A"]
    assert [r.n_aft_until_t for r in a] == [1, 1, 2, 3, 3] and [r.y_aft for r in a] == [2, 2, 1, 0, 0] and {r.n_aft_until_window for r in a} == {3}
    assert [r.hours_since_last for r in a] == [0.5, 5.5, 14, 0, 96] and {r.max_aft_mag for r in a} == {5.0}
    b = [r for r in h.orderBy("horizon_hours").collect() if r.cluster_id == "B"]
    assert all(r.n_aft_until_t == 0 and r.max_aft_mag is None and r.hours_since_last == r.horizon_hours and not r.y_has_aft for r in b)
    horizons.check_invariants(h, summary)
    with pytest.raises(ValueError):
        horizons.check_invariants(h.withColumn("y_aft", F.col("y_aft") + 1), summary)
    assert "n_aft_T" in horizons.published(h).columns and "n_aft_t" in horizons.published(h).columns
    with pytest.raises(ValueError):
        horizons.build_horizons(summary, events, "2026-01-01", days=7)
    _, soon, _ = horizon_tables(spark, "2020-01-11")
    assert all(r.censored_target and not r.censored_feature for r in soon.collect())
    _, now, _ = horizon_tables(spark, "2020-01-01T05:00:00")
    assert all(r.censored_feature == (r.horizon_hours > 5) for r in now.collect())


def region(name, s, n, w, e, **more):
    return {"name": name, "minlatitude": s, "maxlatitude": n, "minlongitude": w, "maxlongitude": e, "starttime": "2000-01-01", "endtime": "2010-01-01", "minmagnitude": 4} | more


def test_regions(spark, tmp_path):
    regions.validate(regions.REGIONS)
    regions.validate([region("a", 0, 10, 0, 10), region("b", 10, 20, 0, 10)])
    for bad in ([], [region("a", 0, 10, 0, 10), region("a", 20, 30, 0, 10)], [region("a", 0, 10, 0, 10), region("b", 5, 20, 5, 20)], [region("a", 0, 10, 170, -170)], [region("a", 0, 10, 0, 10, endtime="1990-01-01")], [{"name": "a"}]):
        with pytest.raises(ValueError):
            regions.validate(bad)
    assert regions.overlaps(regions.as_table(spark, [region("a", 0, 10, 0, 10), region("b", 5, 20, 5, 20), region("c", 20, 30, 0, 5)])).collect() == [("a", "b")]
    make = lambda *ids: spark.createDataFrame([(i, i, 1) for i in ids], "cluster_id string, mainshock_id string, n_aftershocks int")
    out = regions.combine({"x": make("1", "2"), "y": make("3")})
    assert out.columns[-1] == "region" and sorted(r.region for r in out.collect()) == ["x", "x", "y"]
    with pytest.raises(ValueError):
        regions.combine({"x": make("1"), "y": make("1")})
    with pytest.raises(ValueError):
        regions.combine({"x": make("1"), "y": make("2").withColumn("more", F.lit(1))})
    with pytest.raises(regions.BadRegions) as all_at_once:
        regions.validate([region("a", 0, 95, 0, 10), region("a", 50, 60, 5, 20), {"name": "c"}, region("d", 1, 2, 170, -170, endtime="1990-01-01")])
    assert len(all_at_once.value.breaches) == 6
    with pytest.raises(regions.BadRegions):
        regions.combine({})
    wide = regions.combine({"x": make("1"), "y": make("2").select("n_aftershocks", "mainshock_id", "cluster_id")}, schema=make("1").withColumn("n_aftershocks", F.col("n_aftershocks").cast("long")).schema)
    assert wide.schema["n_aftershocks"].dataType.simpleString() == "bigint" and sorted(r.cluster_id for r in wide.collect()) == ["1", "2"]
    text = spark.createDataFrame([("1", "5", "5"), ("2", "NA", "5"), ("3", "-50", "100")], "id string, latitude string, longitude string")
    assert [r.region for r in regions.assign(text, [region("a", 0, 10, 0, 10), region("b", -60, -40, 90, 110)]).orderBy("id").collect()] == ["a", None, "b"]
    path = tmp_path / "r.yaml"
    path.write_text('{"regions": [%s]}' % __import__("json").dumps(region("a", 0, 10, 0, 10)))
    assert regions.load(path)[0]["name"] == "a"


def test_quality(spark):
    df = spark.createDataFrame([(str(i), i, None, 1.0, "x") for i in range(3)] + [("0", None, None, 2.0, "y")], "k string, a int, b double, c double, d string")
    report, problems = quality.check(df, "k", "t")
    assert report["columns_with_nulls"] == {"b": 1.0, "a": 0.25} and report["empty_columns"] == ["b"] and not report["key_without_duplicates"] and len(problems) == 3
    same = df.drop("b").where("a is not null")
    assert quality.compare(same, same.withColumn("new", F.lit(1)), "k") == []
    assert quality.compare(same, same.withColumn("c", F.col("c") + 1), "k") == ["column 'c' differs in 3 rows"]
    assert quality.compare(same, same.select("a", "k", "c", "d"), "k") and quality.compare(same, same.limit(1), "k")


def test_correlations(spark):
    g = np.random.default_rng(2)
    n, x = g.poisson(2, 200), np.round(g.normal(size=200), 1)
    import pandas as pd

    pdf = pd.DataFrame({"n_aftershocks": n, "mainshock_mag": x + 0.3 * n, "mainshock_depth": np.where(g.random(200) < 0.2, np.nan, x), "n_prior_2d": 1.0})
    got = {r.feature: r for r in features.correlations(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "n_aftershocks int, mainshock_mag double, mainshock_depth double, n_prior_2d double")).collect()}
    assert set(got) == {"mainshock_mag", "mainshock_depth"}
    for c, r in got.items():
        ok = pdf[c].notna()
        assert r.n == ok.sum() and r.pearson == pytest.approx(pdf[c][ok].corr(pdf.n_aftershocks[ok]), abs=6e-4)
        assert r.spearman == pytest.approx(pdf[c][ok].rank().corr(pdf.n_aftershocks[ok].rank()), abs=6e-4)


def test_planted_aftershocks(spark, caplog):
    """Half the events planted close behind others: the split finds them; shuffling destroys it."""
    g = np.random.default_rng(4)
    rows = []
    for i in range(400):
        h, lat, lon = g.uniform(0, 80000), g.uniform(-40, -20), g.uniform(-75, -60)
        rows += [(f"b{i}", h, lat, lon, 4.5 + float(g.exponential(0.4))), (f"a{i}", h + float(g.uniform(0.2, 30)), lat + float(g.normal(0, 0.03)), lon + float(g.normal(0, 0.03)), 4.2 + float(g.exponential(0.2)))]
    df = silver.with_order(catalog(spark, rows))
    paired = neighbors.nearest_neighbor(df, None)
    t = mixture.fit_threshold(paired)
    assert t["mixture"]["separation_sigmas"] > 2
    thinned = nulls.thin(paired, t["mixture"], t["log10_eta0"], 2).collect()
    hit = [r.id[0] == "a" for r in thinned if r.is_aftershock]
    assert np.mean(hit) > 0.9 and sum(hit) > 340
    with caplog.at_level(logging.WARNING):
        c = nulls.contrast_with_null(paired, nulls.null_distribution(df, 2, 1), t["log10_eta0"])
    assert c["excess_over_chance"] > 0.3


def test_names():
    assert [model.RadiusPolicy().suffix(), model.RadiusPolicy("fixed", 300).suffix(), model.RadiusPolicy("gk").suffix(), model.RadiusPolicy("gk", 250, 2.5).suffix()] == ["", "_rmax=300", "_rmax=gk3", "_rmax=gk2.5-cap250"]
    p = model.RunParams(prior_radius_km=75.5, horizon_days=14, border_buffer_km=150)
    assert (p.prior_suffix(), p.horizon_suffix(), p.border_suffix()) == ("_prior=75.5", "_T=14", "_border=150")
    assert model.RunParams().data_name() == "earthquake_starttime=2016-01-01_endtime=2026-01-01_minmagnitude=3.5_bbox=-55,-21,-74,-53"
    assert model.RunParams(minmagnitude=3).data_name() == model.RunParams(minmagnitude=3.0).data_name() and model.RunParams(maxlatitude=None).bbox is None
    assert model.regions_tag(regions.REGIONS).startswith("5regions-") and model.regions_tag(regions.REGIONS) != model.regions_tag(regions.REGIONS[:4])


def test_tiles_find_the_same_parents():
    rng = np.random.default_rng(3)
    for n, reach in ((300, None), (300, 120.0), (40, 1e5)):
        us = np.sort(rng.integers(0, 40, n) * 3_600_000_000 * 24)  # many equal times
        lat, lon = np.radians(rng.normal(-30, 0.5, n)), np.radians(rng.choice([-70, 179.9, -179.9], n) + rng.normal(0, 0.3, n))
        lat[5:9], lon[5:9] = lat[5], lon[5]  # equal places
        side = neighbors.Side(np.arange(1, n + 1), lat, lon, us, 10 ** -np.round(rng.uniform(3, 6, n), 1), np.full(n, np.nan if reach is None else reach))
        for d in (1.5, 1.2):
            at = np.sort(rng.choice(n, n - 3, replace=False))
            found = [neighbors.best_parents(side, at, d, 0.01, rows=16, tile=32), *(tree.search(tree.EventTree(side, leaf), side, at, d, 0.01) for leaf in (1, 5, 64))]
            for eta, place, *_ in found:
                for j, e, p in zip(at, eta, place):
                    i = np.arange(j)
                    exact = side.exact(np.full(j, j), i, d, 0.01)[0] if j else np.array([np.inf])
                    assert (e == exact.min() and p == exact.argmin()) if np.isfinite(exact.min()) else (p == -1 and np.isinf(e))


def test_tree_computes_few_distances():
    rng = np.random.default_rng(6)
    shares = []
    for n in (5_000, 20_000):
        us, mag = np.sort(rng.integers(0, 10**15, n)), np.round(4 + rng.exponential(0.43, n), 1)
        side = neighbors.Side(np.arange(1, n + 1), np.radians(rng.uniform(-55, -21, n)), np.radians(rng.uniform(-74, -53, n)), us, 10**-mag, np.full(n, np.nan))
        at = np.arange(0, n, 40)
        seen: list[int] = []
        eta, place, *_ = tree.search(tree.EventTree(side), side, at, 1.5, 0.01, seen)
        assert np.array_equal(place, neighbors.best_parents(side, at, 1.5, 0.01)[1])
        shares.append(sum(seen) / len(at) / n)
    assert shares[1] < 0.05 and shares[1] < shares[0] / 2, shares


def test_memory_of_tiles_does_not_grow_with_the_catalog():
    import tracemalloc

    peaks = []
    for n in (20_000, 200_000):
        rng = np.random.default_rng(1)
        side = neighbors.Side(np.arange(1, n + 1), rng.normal(-0.5, 0.01, n), rng.normal(-1.2, 0.01, n), np.sort(rng.integers(0, 10**15, n)), np.full(n, 1e-4), np.full(n, np.nan))
        at = np.arange(n - 256, n)
        tracemalloc.start()
        neighbors.best_parents(side, at, 1.5, 0.01)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 100e6


def test_crowded_cells_are_split(spark, monkeypatch):
    rows = [(f"e{i}", float(i), 4 + i % 7 / 10) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, s double, mag double").select("id", F.timestamp_seconds("s").alias("time"), F.lit(-30.0).alias("latitude"), (F.lit(-70.0) + F.col("s") / 1e5).alias("longitude"), "mag")
    policy = model.RadiusPolicy("fixed", 50.0)
    key = lambda strategy: sorted((r.id, r.parent_id, round(r.log10_eta, 9) if r.log10_eta else None) for r in neighbors.nearest_neighbor(df, None, policy=policy, strategy=strategy).collect())
    want = key("theta")
    monkeypatch.setattr(neighbors.deal_crowded, "__defaults__", ("c_", "p_", 16))
    assert key("grid") == want and key("blocks") == want and key("tree") == want
    monkeypatch.setattr(curve.search, "__defaults__", (*curve.search.__defaults__[:-1], 30))
    assert key("curve") == want
    children = spark.range(100).select(F.lit(1).alias("c_k"), F.col("id").alias("c_ord"))
    parents = spark.range(5).select(F.lit(1).alias("p_k"), "id")
    left, right = neighbors.deal_crowded(children, parents, ("k",), "c_ord", most=16)
    assert max(r["count"] for r in left.groupBy("c__salt").count().collect()) < 40 and right.count() == 35


def test_ranges_of_the_curve_copy_few_events(spark):
    g = np.random.default_rng(9)
    rows = [(f"e{i}", float(i), float(a), float(b), 4.0) for i, (a, b) in enumerate(zip(g.uniform(-55, -21, 20000), g.uniform(-74, -53, 20000)))]
    df = spark.createDataFrame(rows, "id string, s double, latitude double, longitude double, mag double").withColumn("time", F.timestamp_seconds("s"))
    events = neighbors.prepare(df, policy=model.RadiusPolicy("fixed", 60.0)).withColumn("_at", geo.Grid(60.0).cell(F.col("latitude"), F.col("longitude")))
    home = events.groupBy(F.col("_at.band").alias("band"), F.col("_at.cell").alias("cell")).agg(F.count("*").alias("children"))
    links = events.select(F.col("_at").alias("own"), F.explode(geo.Grid(60.0).around(F.col("latitude"), F.col("longitude"))).alias("to")).groupBy("own", F.col("to.band").alias("band"), F.col("to.cell").alias("cell")).agg(F.count("*").alias("n"))
    links = links.join(events.groupBy(F.col("_at").alias("own")).agg(F.count("*").alias("parents")), "own")
    cells, owners = curve.ranges(home, links, (), 2500)
    n = cells.select("range").distinct().count()
    copies = events.select(F.col("_at").alias("own")).join(owners, "own").count()
    assert n >= 8 and copies < 2 * 20000, (n, copies)
    assert cells.count() == home.count(), "every child has one range"


def test_choice_follows_the_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"e{i}", float(i), float(a), float(b), 4.0) for i, (a, b) in enumerate(zip(rng.uniform(-80, 80, 3000), rng.uniform(-180, 180, 3000)))]
    df = spark.createDataFrame(rows, "id string, s double, latitude double, longitude double, mag double").withColumn("time", F.timestamp_seconds("s"))
    monkeypatch.setattr(neighbors, "FEW_EVENTS", 100)
    chosen = lambda km: neighbors.choose(neighbors.prepare(df, policy=model.RadiusPolicy("fixed", km)), 3000, km)
    assert [chosen(50.0), chosen(2500.0)] == ["grid", "tree"] and neighbors.choose(df, 3000, None) == "tree" and neighbors.choose(df, 10**7, None) == "bounded" and neighbors.choose(df, 10**7, 50.0) == "curve"
    events = neighbors.prepare(df, policy=model.RadiusPolicy("fixed", 500.0))
    assert neighbors.grid_pairs(events, 500.0) < 3000 * 3000 / 5


def test_exact_quantiles_of_many_and_of_equal_values(spark):
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=40_000), np.full(30_000, 0.25), -np.exp(rng.normal(0, 6, 20_000)), [1e300, -1e300]])
    df = spark.createDataFrame(pa.table({"v": rng.permutation(x)}))
    shares = (0.0, 0.001, 0.25, 0.5, 0.9, 1.0)
    quantiles = ordering.quantiles(df, "v", shares, most=20)
    assert np.allclose(list(quantiles.first()), np.quantile(x, shares), rtol=1e-12) and "rangepartitioning" not in quantiles._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles_by_sketches(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.normal(size=500).round(2))] + [(None, 1.0), (7, 2.5), (8, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    for by in ((), ("g",)):
        few, many = (sorted(map(str, ordering.quantiles(df, "v", shares, by, most).select(*by, *(F.round(f"q{i}", 9) for i in range(5))).collect())) for most in (10**6, 0))
        assert few == many and len(few) == (5 if by else 1)
    assert ordering.quantiles(df.limit(0), "v", (0.5,)).first().q0 is None
    values = df.where("g = 1").select("v")
    got = mixture.fit_distributed(values.unionAll(values.selectExpr("v + 9")), "v")
    want = mixture.fit(np.array([r.v for r in values.collect()] + [r.v + 9 for r in values.collect()]))
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want if k != "log_likelihood")
