"""The search of large catalogs by slabs of time and parts of space."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline import model
from tremorline.operators import neighbors, slabs


def crowded(spark, n=600, seed=4):
    """Two groups: many events at equal places and times, some large ones, some far away."""
    g = np.random.default_rng(seed)
    spots = np.stack([g.uniform(-60, 60, 40), g.uniform(-180, 180, 40)])
    rows = []
    for i in range(n):
        lat, lon = spots[:, i % 40] if i % 3 else (g.uniform(-89, 89), g.uniform(-180, 180))
        rows.append((f"e{i:04d}", int(i % 4 == 0), float(g.integers(0, 10**6)) if i % 5 else 5000.0, float(lat), float(lon), 4.0 + (4.0 if i % 97 == 0 else float(g.integers(0, 9)) / 10)))
    df = spark.createDataFrame(rows, "id string, region int, s double, latitude double, longitude double, mag double")
    return df.withColumn("time", F.timestamp_seconds("s"))


def found(df, by, policy, strategy):
    out = neighbors.nearest_neighbor(df, None, by, policy=policy, strategy=strategy)
    return sorted(tuple(r) for r in out.select(*by, "id", "parent_id", F.round("log10_eta", 9)).collect())


@pytest.mark.parametrize("by", [(), ("region",)])
def test_slabs_find_what_the_definition_finds(spark, monkeypatch, by):
    monkeypatch.setattr(slabs.search, "__defaults__", (*slabs.search.__defaults__[:-1], 40))
    df = crowded(spark).localCheckpoint()
    for policy in (model.RadiusPolicy(), model.RadiusPolicy("fixed", 900.0), model.RadiusPolicy("gk", None, 4.0)):
        assert found(df, by, policy, "slabs") == found(df, by, policy, "theta"), policy


def test_large_catalogs_take_slabs(spark, monkeypatch):
    called = []
    monkeypatch.setattr(neighbors, "BROADCAST_EVENTS", 100)
    monkeypatch.setattr(slabs, "search", lambda events, by, d, r_min: called.append(by) or neighbors.search_theta(events, by, d, r_min))
    neighbors.nearest_neighbor(crowded(spark, 120), None)
    neighbors.nearest_neighbor(crowded(spark, 120), None, policy=model.RadiusPolicy("fixed", 300.0))
    assert called == [(), ()]


def test_parts_are_bounded_and_children_visit_few(spark):
    """Also where all events are at one place, and no child is sent to more than a few parts on average."""
    g = np.random.default_rng(1)
    n, most = 8000, 1000
    rows = [(f"e{i}", float(i), float(a), float(b), 4.0) for i, (a, b) in enumerate(zip(g.uniform(-55, -21, n), g.uniform(-74, -53, n), strict=True))]
    df = spark.createDataFrame(rows, "id string, s double, latitude double, longitude double, mag double").withColumn("time", F.timestamp_seconds("s"))
    for catalog in (df, df.withColumns({"latitude": F.lit(-30.0), "longitude": F.lit(-70.0)})):
        sizes = [r["count"] for r in slabs.parted(neighbors.prepare(catalog), (), most).groupBy("part").count().collect()]
        assert sum(sizes) == n and max(sizes) < 1.5 * most


def test_permutations_are_arrays_in_tasks(spark):
    """The numbers of the SQL, and no expression that Spark interprets a row at a time."""
    from tremorline.functions import stats

    rows = spark.range(1, 1001).select(F.col("id").alias("place"), F.lit(1000).cast("long").alias("n"))
    made = rows.select(stats.permuted(F.col("place"), F.col("n"), F.lit(3), 1).alias("p"))
    assert "aggregate(" not in made._jdf.queryExecution().toString()
    a = b = 32

    def once(x, key=(3 * 104729 + 15485863) % 2**31):
        high, low = divmod(x, b)
        for i in range(6):
            y = ((low if i % 2 == 0 else high) * 7919 + key + i * 1000003) % 2**31
            for _ in range(2):
                y = ((y * y >> 15) + y * 1103515245 + 12345) % 2**31
            high, low = ((high + y) % a, low) if i % 2 == 0 else (high, (low + y) % b)
        return high * b + low

    want = []
    for x in range(1000):
        x = once(x)
        while x >= 1000:
            x = once(x)
        want.append(x + 1)
    assert [r.p for r in made.collect()] == want and sorted(want) == list(range(1, 1001))


def test_parts_seldom_share_a_task(spark, monkeypatch):
    """Forty parts dealt over thirty-two tasks leave some with four or five of them while the others wait."""
    given = []
    monkeypatch.setattr(slabs, "tasks_for", lambda groups, least: given.append(groups) or 4 * groups)
    monkeypatch.setattr(slabs.search, "__defaults__", (*slabs.search.__defaults__[:-1], 100))
    found(crowded(spark, 300), (), model.RadiusPolicy(), "slabs")
    assert given[0] >= 3


def test_tasks_grow_with_the_parts():
    assert (slabs.tasks_for(2, 32), slabs.tasks_for(180, 32)) == (32, 720)


def test_places_that_repeat_are_found_by_few_distances():
    """Most parents are earlier events of the same place, long ago: cuts go through space first, and one leaf is looked at on the way down."""
    from tremorline.operators import tree

    g = np.random.default_rng(2)
    n, spots = 40_000, 3000
    at = g.integers(0, spots, n)
    lat, lon = np.radians(g.uniform(-35, -30, spots))[at], np.radians(g.uniform(-72, -68, spots))[at]
    side = neighbors.Side(np.arange(1, n + 1), lat, lon, np.sort(g.integers(0, 3 * 10**14, n)), 10 ** -np.round(4 + g.exponential(0.43, n), 1), np.full(n, np.nan))
    some, seen = np.arange(n // 2, n, 200), []
    _, place, *_ = tree.search(tree.EventTree(side), side, some, 1.5, 0.01, seen)
    assert np.array_equal(place, neighbors.best_parents(side, some, 1.5, 0.01)[1])
    assert sum(seen) / len(some) < 700


def test_children_that_know_a_parent_do_not_look_for_one_first():
    """The way down to a leaf of each root only serves those that know nothing."""
    from tremorline.operators import tree

    g = np.random.default_rng(5)
    n = 5000
    side = neighbors.Side(np.arange(1, n + 1), np.radians(g.uniform(-35, -30, n)), np.radians(g.uniform(-72, -68, n)), np.sort(g.integers(0, 10**14, n)), 10 ** -np.round(4 + g.exponential(0.43, n), 1), np.full(n, np.nan))
    own, some = tree.EventTree(side), np.arange(1, n)
    eta, place, *_ = tree.search(own, side, some, 1.5, 0.01)
    known = np.where(some % 5 == 0, np.inf, np.where(some % 5 == 1, eta / 2, eta))
    again, found, *_ = tree.search(own, side, some, 1.5, 0.01, None, known)
    better = some % 5 != 1
    assert np.array_equal(found[better], place[better]) and np.array_equal(again[better], eta[better]) and (found[~better] < 0).all()
    seen = []
    tree.search(own, side, some, 1.5, 0.01, seen, np.zeros(len(some)))  # nothing can be as good, so no leaf is looked at
    assert sum(seen) <= tree.FIRST * len(some)
