"""The command line: ``python -m tremorline.cli run|regions|scout|compare|correlations ...``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import features, quality, regions, scouting, silver
from .plans import pipeline
from .sources import files

#: Parameters of a run that are numbers, text or switches of their own.
PLAIN = {f.name: f.default for f in fields(model.RunParams) if f.name not in ("radius", "force")}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tremorline", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, what in (("run", "one region from the service or stored text to its delivery"), ("regions", "all regions of a file and their union")):
        own = commands.add_parser(name, help=what)
        own.add_argument("root", help="URI of the folder that holds the layers and the delivery")
        own.add_argument("--url", help="address of the event service")
        own.add_argument("--raw", nargs="*", help="stored answers of the service instead of the service")
        own.add_argument("--rng", choices=("portable", "numpy"), default="portable")
        own.add_argument("--min-rows", type=int, default=model.MIN_ROWS)
        own.add_argument("--force", action="store_true", help="make everything anew")
        own.add_argument("--radius-mode", choices=("fixed", "gk"), default="fixed")
        own.add_argument("--radius-km", type=float)
        own.add_argument("--radius-k", type=float, default=3.0)
        for field, default in PLAIN.items():
            own.add_argument("--" + field.replace("_", "-"), type=float if isinstance(default, float) else type(default), default=default)
    commands.choices["regions"].add_argument("--configuration", help="a file of regions; without it the published ones")
    scout = commands.add_parser("scout", help="completeness by block, density by strip and the largest events of raw text")
    scout.add_argument("raw", nargs="+")
    scout.add_argument("--first-year", type=int, default=2000)
    scout.add_argument("--years", type=int, default=5)
    scout.add_argument("--magnitude", type=float, default=8.0)
    old = commands.add_parser("compare", help="a delivery with an earlier one; exit code 1 if they differ")
    old.add_argument("old")
    old.add_argument("new")
    old.add_argument("--tolerance", type=float, default=1e-9)
    signal = commands.add_parser("correlations", help="of the features of delivered sequences with their number of aftershocks")
    signal.add_argument("delivery", help="a table of sequences as it was delivered")
    signal.add_argument("--endtime", default=model.RunParams.endtime, help="end of the catalog; sequences whose window isn't over are left out")
    signal.add_argument("--days", type=float, default=model.HORIZON_DAYS)
    signal.add_argument("--out", help="folder to write the table to; without it the table is shown")
    return out


def parameters(args: argparse.Namespace) -> model.RunParams:
    policy = model.RadiusPolicy(args.radius_mode, args.radius_km, args.radius_k)
    return model.RunParams(radius=policy, force=args.force, **{field: getattr(args, field) for field in PLAIN})


def _delivered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tremorline").getOrCreate()
    if args.command == "compare":
        differences = quality.compare(_delivered(spark, args.old), _delivered(spark, args.new), tolerance=args.tolerance)
        print("\n".join(differences) or "no difference")
        return int(bool(differences))
    if args.command == "correlations":
        table = features.uncensored(_delivered(spark, args.delivery).withColumn("mainshock_time", F.to_timestamp("mainshock_time")), args.endtime, args.days)
        whole = features.correlations(table).select(F.lit("all").alias("region"), "*")
        out = whole.unionByName(features.correlations(table, by=("region",))) if "region" in table.columns else whole
        if args.out:
            files.write_csv(out.orderBy("region", "feature"), args.out, single=True)
        else:
            out.orderBy("region", "feature").show(1000, truncate=False)
        return 0
    if args.command == "scout":
        catalog = silver.refine(files.read_bronze(spark, *args.raw))
        for table in (scouting.blocks_mc(catalog, args.first_year, args.years), scouting.density_strips(catalog), scouting.mega_events(catalog, args.magnitude)):
            table.show(200, truncate=False)
        return 0
    stored = (lambda: files.read_bronze(spark, *args.raw)) if args.raw else None
    options, params = {"url": args.url} if args.url else {}, parameters(args)
    if args.command == "run":
        _, reports = pipeline.run_region(spark, args.root, params, stored, args.rng, args.min_rows, **options)
    else:
        configuration = regions.load(args.configuration) if args.configuration else regions.REGIONS
        sources = None
        if args.raw:
            assigned = regions.assign(files.read_bronze(spark, *args.raw), configuration)
            sources = {r["name"]: (lambda name=r["name"]: assigned.where(assigned.region == name).drop("region")) for r in configuration}
        reports = pipeline.run_regions(spark, args.root, configuration, params, sources, args.rng, args.min_rows, **options)
    print(json.dumps(reports, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
