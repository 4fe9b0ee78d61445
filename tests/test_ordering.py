"""Numbering in groups, cleaning and mainshocks: same rows, without tables or work that grow with the groups."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorline.operators import forest, horizons, ordering, silver


def rows_of(n, seed=3):
    """Many groups of one row, two of over a quarter of all rows, some of null and NaN."""
    rnd = random.Random(seed)
    groups = [(f"r{i % 2}", rnd.choice([float(i), float(i), 7.0, 7.0, 7.0, 7.0, 7.0, 7.0, float("nan"), None])) for i in range(n)]
    return [(a, g, i, float(rnd.randint(0, 9))) for i, (a, g) in enumerate(groups)]


def spied(monkeypatch, module):
    kept, written = {}, module.written

    def spy(df, name):
        kept[name] = written(df, name)
        return kept[name]

    monkeypatch.setattr(module, "written", spy)
    return kept


def test_places_in_groups_that_go_on_in_other_partitions(spark, monkeypatch):
    kept = spied(monkeypatch, ordering)
    df = spark.createDataFrame(rows_of(900), "region string, g double, id long, v double")
    got = {r.id: r.place for r in ordering.numbered(df, ("v", "id"), ("region", "g"), "place").collect()}
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("region", "g").orderBy("v", "id"))).collect()
    assert got == {r.id: r.place for r in want}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert df.select("region", "g").distinct().count() > 20 * parts and 0 < kept["starts"].count() <= 2 * parts  # not a row a group
    assert ordering.numbered(df.limit(0), ("v", "id"), ("region", "g"), "place").count() == 0


def test_places_by_small_batches(spark):
    """A group goes on in the next batch."""
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(rows_of(120, 5), "region string, g double, id long, v double")
        got = {r.id: r.place for r in ordering.numbered(df, ("v", "id"), ("region", "g"), "place").collect()}
        want = df.withColumn("place", F.row_number().over(Window.partitionBy("region", "g").orderBy("v", "id"))).collect()
        assert got == {r.id: r.place for r in want}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)


def test_mainshocks_of_many_clusters_are_not_broadcast(spark):
    """The largest event, of equal ones the first; a null magnitude counts as the largest."""
    rnd = random.Random(8)
    rows = [(f"c{rnd.randint(0, 150)}", i, rnd.choice([4.0, 4.5, 5.0, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "cluster_id string, ord long, mag double").withColumn("time", F.timestamp_seconds(F.col("ord")))
    out = forest.with_mainshock(df)
    largest = {}
    for c, i, m in rows:
        size = (float("-inf") if m is None else -m, i)
        largest[c] = min(largest.get(c, size), size)
    assert {r.ord for r in out.where("is_mainshock").collect()} == {i for _, i in largest.values()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1  # the few starts of partitions


def test_rows_of_clusters_are_not_broadcast(spark):
    """Spark takes a few columns of the clusters for small; a catalog of single events has as many clusters as events."""
    rows = [(f"c{i}", i, 4.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, ord long, mag double").withColumns({"time": F.timestamp_seconds("ord"), "latitude": F.lit(0.0), "longitude": F.lit(0.0), "depth": F.lit(1.0), "is_aftershock": F.lit(False), "parent_id": F.lit(None).cast("string")})
    events, summary = forest.build_clusters(df)
    for table in (events, horizons.aftershock_delays(events, summary)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert events.count() == summary.count() == 40


def test_raw_columns_are_parsed_once(spark):
    """A filter on parsed columns isn't put below the parsing."""
    raw = spark.createDataFrame([("a", "2020-01-01", None, "1", "2", "3", "4", "earthquake"), ("b", "2020-01-01", None, "x", "2", "3", "4", "earthquake"), ("c", "", None, "1", "2", "3", "4", "earthquake")], "id string, time string, updated string, latitude string, longitude string, depth string, mag string, type string")
    clean = silver.refine(raw)
    assert [(r.id, r.latitude, r.mag) for r in clean.collect()] == [("a", 1.0, 4.0)]
    assert raw.columns == silver.typed(raw).columns
    plan = clean._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 4  # one a number
