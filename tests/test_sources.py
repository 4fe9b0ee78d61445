"""Sources, files, the run plan, the layers and the stream, without a network."""

import datetime as dt
import json
import os
import urllib.error

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

import __spark_entry__
from tremorline import cli, model, storage
from tremorline.operators import quality, silver
from tremorline.plans import fixture, pipeline, registry
from tremorline.sources import fdsn, files
from tremorline.storage import Layers
from tremorline.streaming import landing

HEADER = "time,latitude,longitude,depth,mag,magType,id,updated,place,type,net,status"


class FakeService:
    """Events every hour of 2020, with one dense day; counts its requests."""

    def __init__(self):
        start = dt.datetime(2020, 1, 1, tzinfo=dt.UTC)
        self.times = [start + dt.timedelta(hours=i) for i in range(200)] + [start + dt.timedelta(days=3, seconds=7 * i) for i in range(900)]
        self.counts = 0

    def _inside(self, request):
        a, b = (dt.datetime.fromisoformat(request.encoded()[k]) for k in ("starttime", "endtime"))
        return [t for t in self.times if a <= t <= b]

    def count(self, request):
        self.counts += 1
        return len(self._inside(request))

    def query(self, p):
        assert p.encoded(format="csv")["format"] == "csv" and p.encoded()["minlatitude"] == "-55" and "maxlatitude" not in p.encoded()
        rows = [f'{t.isoformat()},-30,-70,10,4.5,mb,us{t.timestamp():.0f},{t.isoformat()},"a, b",earthquake,us,reviewed' for t in self._inside(p)]
        return ("\n".join([HEADER, *rows]) + "\n").encode()


def test_slices():
    service = FakeService()
    options = {"starttime": "2020-01-01", "endtime": "2020-02-01", "service_limit": "100", "minlatitude": "-55"}
    slices = fdsn.plan(service, options)
    assert all(n <= 100 for *_, n in slices) and len(slices) > 10
    assert all(a[1] == b[0] for a, b in zip(slices, slices[1:])) and service.counts < 2 * len(slices) + 2
    for bad in ({"endtime": "2019-01-01"}, {"endtime": "2020-01-01"}, {"starttime": "2021-01-01", "endtime": "2021-02-01"}, {"limit": "50"}):
        with pytest.raises(ValueError):
            fdsn.plan(service, options | bad)
    with pytest.raises(ValueError):
        fdsn.plan_slices(lambda a, b: 500, fdsn.moment("2020-01-01"), fdsn.moment("2020-01-01") + dt.timedelta(microseconds=1), 500, 100)


def test_data_source(spark):
    spark.dataSource.register(fdsn.FdsnSource)
    df = spark.read.format("fdsn").options(client="tests.test_sources:FakeService", starttime="2020-01-01", endtime="2020-02-01", service_limit="100", minlatitude="-55").load()
    assert df.rdd.getNumPartitions() > 10
    out = silver.refine(df)
    assert out.count() == len({round(t.timestamp()) for t in FakeService().times}) and out.first().place == "a, b"


def http_error(code):
    return urllib.error.HTTPError("http://x", code, "said so", {}, None)


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise http_error(503)
        return "ok"

    assert fdsn.Patience().ask(call, waits.append) == "ok" and len(waits) == 2 and 1 <= waits[0] <= 2 <= waits[1] <= 4
    assert len([*fdsn.Patience().waits()]) == 4 and max(max(fdsn.Patience(12).waits()) for _ in range(20)) <= 30
    for error, tries in ((http_error(404), 1), (http_error(429), 3), (http_error(500), 3), (TimeoutError(), 3), (urllib.error.URLError("no route"), 3), (KeyError("x"), 1), (ValueError("503:busy"), 1), (PermissionError(), 1)):
        waits.clear()
        with pytest.raises(type(error)):
            fdsn.Patience(3).ask(lambda error=error: (_ for _ in ()).throw(error), waits.append)
        assert len(waits) == tries - 1, error
    assert fdsn.concatenate([b"h\n1\n", b"h\n", b"h\n2\n"]) == b"h\n1\n2\n" and fdsn.concatenate([b"h\n1"]) == b"h\n1"


def test_requests():
    r = fdsn.Request("a", "b", 3, box={"minlatitude": None, "maxlatitude": 1})
    assert r.encoded() == {"starttime": "a", "endtime": "b", "eventtype": "earthquake", "minmagnitude": 3, "maxlatitude": 1}
    assert r.url("http://x", "count", format="geojson") == "http://x/count?starttime=a&endtime=b&eventtype=earthquake&minmagnitude=3&maxlatitude=1&format=geojson"
    full = fdsn.Request.of({"starttime": "2020-01-01", "endtime": "2020-02-01", "minlatitude": "", "maxlatitude": "3", "eventtype": None})
    assert full.box == {"maxlatitude": "3"} and full.eventtype == "earthquake" and full.starttime == "2020-01-01T00:00:00+00:00"


def test_filters_narrow_the_request(spark):
    options = {"client": "tests.test_sources:FakeService", "starttime": "2020-01-01", "endtime": "2020-02-01", "service_limit": "100", "minlatitude": "-55"}
    reader = fdsn.NarrowingReader(options, ["id"])
    filters = [ds.GreaterThanOrEqual(("time",), "2020-01-02"), ds.LessThan(("time",), "2020-01-03T00:00:00"), ds.GreaterThan(("time",), "z"), ds.EqualTo(("type",), "earthquake"), ds.EqualTo(("net",), "us")]
    assert list(reader.pushFilters(filters)) == filters
    assert (reader.own["starttime"], reader.own["endtime"], reader.own["eventtype"]) == ("2020-01-02T00:00:00+00:00", "2020-01-03T00:00:00+00:00", "earthquake")
    none = fdsn.NarrowingReader(options, ["id"])
    list(none.pushFilters([ds.GreaterThan(("time",), "2021-01-01")]))
    assert none.partitions() == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(fdsn.FdsnSource)
        df = spark.read.format("fdsn").options(**options, pushfilters="true").load().where("time >= '2020-01-02' and time < '2020-01-03'")
        assert df.rdd.getNumPartitions() == 1 and df.count() == 24
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def raw(spark):
    return registry.raw(spark, "/root/testdata/sf0.001")


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/bronze"
    files.write_bronze(raw(spark), path)
    back = files.read_bronze(spark, path)
    assert back.count() == 2000 and {t for _, t in back.dtypes} == {"string"}
    t = dt.datetime(2020, 1, 2, 3, 4, 5, 678000, tzinfo=dt.UTC)
    files.write_csv(spark.createDataFrame([("a", t, True, 1.5, None)], "id string, time timestamp, ok boolean, x double, y string"), f"file://{tmp_path}/csv", single=True)
    (name,) = [f for f in os.listdir(tmp_path / "csv") if f.endswith(".csv")]
    assert (tmp_path / "csv" / name).read_text() == "id,time,ok,x,y\na,2020-01-02T03:04:05+0000,True,1.5,\n"


def test_run_of_one_region(spark, tmp_path):
    run = pipeline.decluster(raw(spark), model.RunParams(n_randomizations=1))
    assert run.estimate["n_events_complete"] == run.paired.count() and run.summary.count() + run.thinned.where("is_aftershock").count() == run.paired.count()
    reports = pipeline.publish(run, f"file://{tmp_path}", min_rows=100)
    assert reports["clusters"]["key_without_duplicates"] and reports["events"]["rows"] == run.paired.count()
    assert any(n.startswith("horizons_") for n in os.listdir(tmp_path / "delivery"))
    (name,) = [n for n in os.listdir(tmp_path / "threshold") if n.endswith(".json")]
    assert json.loads((tmp_path / "threshold" / name).read_text())["n_events"] == run.threshold["n_events"]
    with pytest.raises(ValueError):
        pipeline.publish(run, f"file://{tmp_path}", min_rows=10**6)
    again = pipeline.decluster(raw(spark).repartition(5), model.RunParams(n_randomizations=1))
    key = lambda df: sorted((r.id, r.cluster_id) for r in df.collect())
    assert key(again.events) == key(run.events)


def test_layers_are_used_again(spark, tmp_path):
    root, params, asked = f"file://{tmp_path}", model.RunParams(n_randomizations=1), []

    def source():
        asked.append(1)
        return raw(spark)

    def times():
        return {f"{layer}/{n}": os.stat(f"{tmp_path}/{layer}/{n}/_SUCCESS" if os.path.isdir(f"{tmp_path}/{layer}/{n}") else f"{tmp_path}/{layer}/{n}").st_mtime_ns for layer in ("bronze", "silver", "neighbors", "null", "aftershocks", "clusters", "features") for n in os.listdir(tmp_path / layer) if not n.startswith(".")}

    run, reports = pipeline.run_region(spark, root, params, source, min_rows=100)
    assert reports["events"]["rows"] == run.paired.count()
    before = times()
    assert len(before) == 9 and {n.rpartition("/")[2] for n in before} <= set(params.names().values())
    again, _ = pipeline.run_region(spark, root, params, source, min_rows=100)
    assert times() == before and len(asked) == 1
    key = lambda df: sorted((r.id, r.cluster_id) for r in df.collect())
    assert key(again.events) == key(run.events)
    # an older input's successors are made anew, and only these
    os.utime(f"{tmp_path}/null/{params.names()['null']}/_SUCCESS")
    pipeline.run_region(spark, root, params, source, min_rows=100)
    changed = {n.partition("/")[0] for n, t in times().items() if t != before[n]}
    assert changed == {"null", "aftershocks", "clusters", "features"} and len(asked) == 1
    forced = model.RunParams(n_randomizations=1, force=True)
    pipeline.run_region(spark, root, forced, source, min_rows=100)
    assert len(asked) == 2 and all(t > before[n] for n, t in times().items())


def box(name, s, n):
    return {"name": name, "minlatitude": s, "maxlatitude": n, "minlongitude": -80, "maxlongitude": -50, "starttime": "2016-01-01", "endtime": "2026-01-01", "minmagnitude": 4}


def test_combined_delivery(spark, tmp_path):
    base, configuration = raw(spark), [box("south", -60, -38), box("north", -38, -10)]
    lat = F.expr("try_cast(latitude as double)")
    sources = {"south": lambda: base.where(lat < -38), "north": lambda: base.where(lat >= -38)}
    root, params = f"file://{tmp_path}", model.RunParams(n_randomizations=1, prior_radius_km=75.5, horizon_days=14)
    reports = pipeline.run_regions(spark, root, configuration, params, sources, min_rows=50)
    assert set(reports) == {"south", "north", "combined"}
    tag, end = model.regions_tag(configuration), "_mainshock=largest_seed=1.csv"
    assert {f"clusters_combined_{tag}_prior=75.5{end}", f"horizons_combined_{tag}_prior=75.5_T=14{end}"} <= set(os.listdir(tmp_path / "delivery"))
    assert reports["combined"]["rows"] == sum(reports[n]["clusters"]["rows"] for n in ("south", "north"))
    with pytest.raises(ValueError):
        pipeline.run_regions(spark, root, configuration, params, sources, min_rows=reports["north"]["clusters"]["rows"] + reports["south"]["clusters"]["rows"] - 1)
    names = params.names(f"combined_{tag}")
    like = spark.createDataFrame([], "cluster_id string, mainshock_id string, mainshock_place string, mainshock_mag double, mainshock_time timestamp")
    text = spark.read.option("header", True).csv(f"{root}/delivery/{names['clusters_csv']}")
    assert text.columns[-1] == "region" and {r.region for r in text.select("region").distinct().collect()} == {"south", "north"}
    back = files.read_csv(spark, f"{root}/delivery/{names['clusters_csv']}", spark.createDataFrame([], ", ".join(f"`{c}` string" for c in text.columns)).schema)
    assert back.count() == text.count() and files.read_csv(spark, f"{root}/delivery/{names['clusters_csv']}", like.schema).schema["mainshock_time"].dataType.simpleString() == "string"


def test_download(spark, tmp_path):
    params = model.RunParams(starttime="2020-01-01", endtime="2020-02-01", limit=2000, maxlatitude=None, maxlongitude=None, minlongitude=None)
    layers = Layers(spark, f"file://{tmp_path}")
    stored, path = pipeline.land(spark, layers, params, lambda: pipeline.download(spark, params, client="tests.test_sources:OneRegion", service_limit="100"))
    assert path.endswith(params.names()["bronze"]) and silver.refine(stored).count() == len({round(t.timestamp()) for t in FakeService().times})
    again, _ = pipeline.land(spark, layers, params, lambda: 1 / 0)
    assert again.count() == stored.count()
    with pytest.raises(Exception, match="limit"):
        pipeline.download(spark, model.RunParams(starttime="2020-01-01", endtime="2020-02-01", limit=50, maxlatitude=None, maxlongitude=None, minlongitude=None), client="tests.test_sources:OneRegion").count()


class OneRegion(FakeService):
    def query(self, request):
        assert request.encoded()["minlatitude"] == "-55.0" and request.encoded()["minmagnitude"] == 3.5
        rows = [f'{t.isoformat()},-30,-70,10,4.5,mb,us{t.timestamp():.0f},{t.isoformat()},"a, b",earthquake,us,reviewed' for t in self._inside(request)]
        return ("\n".join([HEADER, *rows]) + "\n").encode()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    asked = []
    monkeypatch.setattr(pipeline, "run_region", lambda *a, **k: asked.append((a, k)) or (None, {"clusters": {"rows": 5}}))
    monkeypatch.setattr(pipeline, "run_regions", lambda *a, **k: asked.append((a, k)) or {"combined": {"rows": 7}})
    files.write_bronze(raw(spark), f"file://{tmp_path}/raw")
    stored = f"file://{tmp_path}/raw"
    assert cli.main(["run", "file:///out", "--raw", stored, "--n-randomizations", "1", "--min-rows", "100", "--radius-mode", "gk", "--force"], spark) == 0
    (_, root, params, source, rng, least), options = asked.pop()
    assert json.loads(capsys.readouterr().out) == {"clusters": {"rows": 5}} and source().count() == 2000
    assert (root, params.n_randomizations, params.radius.mode, params.force, rng, least, options) == ("file:///out", 1, "gk", True, "portable", 100, {})
    (tmp_path / "r.json").write_text(json.dumps({"regions": [box("south", -60, -38), box("north", -38, -10)]}))
    assert cli.main(["regions", "file:///all", "--raw", stored, "--configuration", str(tmp_path / "r.json"), "--rng", "numpy"], spark) == 0
    (_, _, configuration, _, sources, rng, _), _ = asked.pop()
    counts = {name: source().count() for name, source in sources.items()}
    assert [r["name"] for r in configuration] == list(counts) and rng == "numpy" and min(counts.values()) > 500 and sum(counts.values()) <= 2000
    assert cli.main(["run", "file:///out", "--url", "http://x"], spark) == 0 and asked.pop()[1] == {"url": "http://x"}
    for name, rows in (("old", 50), ("new", 50), ("less", 40)):
        files.write_csv(spark.range(rows).selectExpr("id", "id / 3 as third"), f"file://{tmp_path}/{name}", single=True)
    assert cli.main(["compare", f"file://{tmp_path}/old", f"file://{tmp_path}/new"], spark) == 0 and "no difference" in capsys.readouterr().out
    assert cli.main(["compare", f"file://{tmp_path}/old", f"file://{tmp_path}/less"], spark) == 1
    assert cli.main(["scout", stored, "--first-year", "2016"], spark) == 0 and "start_year" in capsys.readouterr().out
    delivered = spark.range(200).selectExpr("id as cluster_id", "timestamp_seconds(1483228800 + id * 86400 * 16) as mainshock_time", "id % 7 + rand(1) as mainshock_mag", "int(id % 7) as n_aftershocks", "if(id % 2 = 0, 'north', 'south') as region")
    files.write_csv(delivered, f"file://{tmp_path}/sequences")
    assert cli.main(["correlations", f"file://{tmp_path}/sequences", "--endtime", "2025-01-01", "--out", f"file://{tmp_path}/signal"], spark) == 0
    signal = {r.region: r for r in spark.read.option("header", True).csv(f"file://{tmp_path}/signal").collect()}
    assert set(signal) == {"all", "north", "south"} and float(signal["all"].pearson) > 0.9 and int(signal["all"].n) == 181
    assert cli.main(["correlations", f"file://{tmp_path}/sequences"], spark) == 0 and "mainshock_mag" in capsys.readouterr().out


def test_columns_that_differ_in_case_leave_settings_alone(spark, tmp_path):
    before = spark.conf.get("spark.sql.caseSensitive")
    files.write_csv(spark.range(3).selectExpr("id", "id + 1 as other").toDF("n_t", "n_T"), f"file://{tmp_path}/case", single=True)
    assert spark.conf.get("spark.sql.caseSensitive") == before
    (name,) = [f for f in os.listdir(tmp_path / "case") if f.endswith(".csv")]
    assert (tmp_path / "case" / name).read_text() == "n_t,n_T\n0,1\n1,2\n2,3\n"
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("delivery_")]


def test_comparison_by_row_order(spark, tmp_path):
    rows = [("a", 1.0, None), ("a", 1.0, None), ("b", 2.0, "x"), ("c", None, "y")]
    write = lambda name, own, **more: spark.createDataFrame(own, "k string, v double, w string").coalesce(1).write.parquet(f"file://{tmp_path}/{name}") or spark.read.parquet(f"file://{tmp_path}/{name}")
    old = write("old", rows)
    assert quality.compare(old, write("same", [(k, v and v + 1e-10, w) for k, v, w in rows])) == []
    assert quality.compare(old, write("turned", rows[::-1])) == ["column 'k' differs in 4 rows", "column 'v' differs in 4 rows", "column 'w' differs in 4 rows"]
    assert quality.compare(old, write("turned2", rows[::-1]), "k") == []
    assert quality.compare(old, write("fewer", rows[:2])) == ["rows: 4 before, 2 now"]


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_run_of_two_regions(spark):
    base = raw(spark)
    lat = F.expr("try_cast(latitude as double)")
    sequences, hours, runs = pipeline.decluster_regions({"south": base.where(lat < -38), "north": base.where(lat >= -38)}, [box("south", -60, -38), box("north", -38, -10)], model.RunParams(n_randomizations=1))
    assert sequences.columns[-1] == "region" and sequences.count() == sum(r.summary.count() for r in runs.values()) and hours.count() == 5 * sequences.count()


def test_layers(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    layers = Layers(spark, f"file://{tmp_path}")
    a, path = layers.table("x", "t.parquet", make)
    layers.table("x", "t.parquet", make)
    assert len(made) == 1 and a.count() == 3
    Layers(spark, f"file://{tmp_path}", force=True).table("x", "t.parquet", make)
    assert len(made) == 2 and not layers.fresh(f"file://{tmp_path}/none") and not layers.fresh(path, [f"file://{tmp_path}/none"])
    assert layers.read_json(layers.write_json("j", "a.json", {"b": 1})) == {"b": 1}


def test_stream(spark, tmp_path):
    rows = raw(spark)
    root, land = f"file://{tmp_path}/silver", f"{tmp_path}/land"
    for n in range(3):
        rows.where(f"pmod(hash(id, mag), 3) = {n}").coalesce(1).write.mode("append").option("header", True).csv(f"file://{land}")
        stream = landing.raw_stream(spark, f"file://{land}", rows.columns, 1)
        landing.keep_silver(stream, root, f"file://{tmp_path}/checkpoint").awaitTermination()
    key = lambda df: sorted((r.id, r.mag, r.net) for r in df.collect())
    assert key(landing.read_silver(spark, root)) == key(silver.refine(rows))
    sizes = {p.name: sum(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in (tmp_path / "silver").glob("batch=*")}
    landing.keep_silver(landing.raw_stream(spark, f"file://{land}", rows.columns, 1), root, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert sizes == {p.name: sum(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in (tmp_path / "silver").glob("batch=*")} and len(sizes) == 3


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.oracle_sql()) >= 50
    assert fixture.catalog(spark, "/root/testdata/sf0.001").count() == 1000
