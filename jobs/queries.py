"""The jobs as queries: each runs twice into a new folder and returns its whole output after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.plans import fixture, oracles
from tremorline.storage import shared_dir

from . import catalog_delivery, text_intake


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tremorline-jobs/{name}-{uuid.uuid4().hex}"


#: The driver's events as a raw catalog.
RAW_CATALOG = f"SELECT id, date_format(timestamp_micros(t_us), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS time, CAST(NULL AS STRING) AS updated, latitude, longitude, depth, mag, 'earthquake' AS type FROM ({fixture.CATALOG.format(events='{source}')})"
DELIVERY = catalog_delivery.read_config() | {"select": RAW_CATALOG, "regions": fixture.THREE, "seed": fixture.SEED, "randomizations": 0, "least_sequences": 100}


def job1_catalog_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = folder(spark, "catalog-delivery")
    for _ in range(2):
        sequences, _ = catalog_delivery.run(spark, f"{sf_dir}/events.parquet", output, DELIVERY)
    return sequences.select("region", "cluster_id", "mainshock_id", "mainshock_mag", F.unix_micros("mainshock_time").alias("mainshock_us"), "n_events", "n_aftershocks", "n_foreshocks", F.round("extent_km", 6).alias("extent_km"), "n_prior_365d", F.round("region_mc", 6).alias("region_mc"), F.round("region_log10_eta0", 4).alias("region_log10_eta0"))


def job2_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, config = folder(spark, "text-intake"), text_intake.read_config()
    for _ in range(2):
        report = text_intake.run(spark, f"{sf_dir}/documents.parquet", output, config)
    return report


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_catalog_delivery": job1_catalog_delivery, "job2_text_intake": job2_text_intake}

ORACLES: dict[str, str] = {
    "job1_catalog_delivery": f"""WITH RECURSIVE {oracles.regional(f"{oracles.CAT}, clean AS (SELECT id, t_us, latitude, longitude, depth, mag FROM cat)")}
SELECT s.region, s.cluster_id, mainshock_id, m.mag AS mainshock_mag, mainshock_us, CAST(n_events AS INT) AS n_events, CAST(n_events - 1 - n_foreshocks AS INT) AS n_aftershocks, CAST(n_foreshocks AS INT) AS n_foreshocks,
  round(extent_km, 6) AS extent_km, CAST(n_prior AS INT) AS n_prior_365d, round(mc, 6) AS region_mc, round(cut, 4) AS region_log10_eta0
FROM summary s JOIN main m USING (region, cluster_id) JOIN prior USING (region, cluster_id) JOIN known USING (region) JOIN cuts USING (region)""",
    "job2_text_intake": """
with judged as (
  select *, nullif(source, '') as src, case when doc_id is null then 'no_key' when text is null or length(trim(text)) = 0 then 'no_text' when n_chars is distinct from length(text) then 'wrong_length' else 'accepted' end as verdict from documents
), counted as (
  select *, verdict = 'accepted' and count(*) filter (verdict = 'accepted') over (partition by doc_id) > 1 as again from judged
), merged as (
  select src as source, lang, count(*) as n_rows, count(*) filter (verdict = 'accepted') as n_accepted, count(*) filter (verdict = 'no_key') as n_no_key, count(*) filter (verdict = 'no_text') as n_no_text, count(*) filter (verdict = 'wrong_length') as n_wrong_length,
    coalesce(sum(octet_length(encode(text))), 0)::bigint as n_bytes, min(length(text)) as least_chars, max(length(text)) as most_chars, count(*) filter (again) as n_with_repeated_key
  from counted group by src, lang
)
select *, round((n_rows - n_accepted) / n_rows, 6) as share_set_apart, round((n_rows - n_accepted) / n_rows, 6) <= 0.05e0 and n_rows >= 20 and n_with_repeated_key = 0 as passed from merged
""",
}
