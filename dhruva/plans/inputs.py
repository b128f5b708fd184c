"""Queries over sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.schema import TABLES, table
from dhruva.session import checkpoint_dir
from dhruva.sources import files
from dhruva.streaming.departures import run_available


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    hubs = files.read_parquet(spark, f"{sf}/transport_hubs.parquet", TABLES["transport_hubs"])
    files.write_csv(hubs, path := _folder(spark, "csv"))
    return files.read_csv(spark, path, TABLES["transport_hubs"])


def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Nested lists written as JSON, read with their schema and exploded."""
    rows = table(spark, sf, "station_aliases").select("station_key", "aliases")
    files.write_json(rows, path := _folder(spark, "json"))
    back = spark.read.json(path, schema=rows.schema)
    return back.select("station_key", F.posexplode("aliases").alias("pos", "alias"))


def stream_hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = run_available(spark, sf, "events.parquet")
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "events", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (csv_round_trip, json_round_trip, stream_hourly_counts)}
ORACLES = {
    "csv_round_trip": "SELECT hub_id, hub_name, latitude, longitude FROM transport_hubs",
    "json_round_trip": "SELECT station_key, CAST(i AS INT) AS pos, aliases[i + 1] AS alias FROM (SELECT station_key, aliases, unnest(range(len(aliases))) AS i FROM station_aliases)",
    "stream_hourly_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
