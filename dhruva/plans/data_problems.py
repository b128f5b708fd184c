"""Queries p4_... and p6_... over the transit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.operators.proximity import in_regions, pairs_within
from dhruva.operators.references import Parent, id_key, orphan_counts, orphan_references


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, Parent]]:
    links = _t(spark, sf, "route_stops")
    both = F.array(
        F.struct(F.lit("route_id").alias("ref_field"), id_key("route_id").alias("key")),
        F.struct(F.lit("canonical_stop_id").alias("ref_field"), id_key("canonical_stop_id").alias("key")),
    )
    refs = links.select("link_id", F.col("loaded_at").cast("timestamp_ntz").alias("at"), F.date_format("snapshot_date", "yyyy-MM").alias("month"), F.explode(both).alias("r"))
    parent = F.when(F.col("r.ref_field") == "route_id", "transport_routes").when(F.col("r.key").startswith("HUB_"), "transport_hubs").otherwise("transport_stops")
    refs = refs.select("link_id", "at", "month", "r.ref_field", "r.key", parent.alias("parent"))
    tables = [
        Parent("transport_routes", _t(spark, sf, "transport_routes"), "route_id", "first_seen", "deleted_at"),
        Parent("transport_stops", _t(spark, sf, "transport_stops"), "stop_id", "first_seen", "deleted_at"),
        Parent("transport_hubs", _t(spark, sf, "transport_hubs"), "hub_id"),
    ]
    return refs, {p.name: p for p in tables}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Links whose route, stop or hub was not on record when the row was loaded."""
    refs, parents = _references(spark, sf)
    return orphan_references(refs, parents).select("link_id", "ref_field").distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per referenced table and month of the snapshot; a link delivered twice counts once."""
    refs, parents = _references(spark, sf)
    return orphan_counts(refs.distinct(), parents, "month").withColumnRenamed("parent", "referenced_table")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of stops at most 75 m apart."""
    pairs = pairs_within(_t(spark, sf, "transport_stops"), 75.0, "stop_id")
    return pairs.select(F.col("id_a").alias("stop_a"), F.col("id_b").alias("stop_b"))


def p6_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Stops in the lozenge of two hundredths of a degree around each hub."""
    hub = _t(spark, sf, "transport_hubs").where("latitude is not null and longitude is not null")
    corners = ((0.02, 0.0), (0.0, 0.02), (-0.02, 0.0), (0.0, -0.02))
    ring = F.array(*(F.struct((F.col("latitude") + y).alias("lat"), (F.col("longitude") + x).alias("lon")) for y, x in corners))
    stops = _t(spark, sf, "transport_stops").select(F.col("stop_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return in_regions(stops, hub.select(F.col("hub_id").alias("region_id"), ring.alias("ring"))).select(F.col("id").alias("stop_id"), F.col("region_id").alias("hub_id"))


_P4_REFS = """WITH k AS (
  SELECT link_id, loaded_at, strftime(snapshot_date, '%Y-%m') AS month, 'route_id' AS ref_field, upper(trim(route_id)) AS key FROM route_stops
  UNION ALL
  SELECT link_id, loaded_at, strftime(snapshot_date, '%Y-%m'), 'canonical_stop_id', upper(trim(canonical_stop_id)) FROM route_stops),
refs AS (SELECT DISTINCT *, CASE WHEN ref_field = 'route_id' THEN 'transport_routes' WHEN key LIKE 'HUB\\_%' ESCAPE '\\' THEN 'transport_hubs' ELSE 'transport_stops' END AS parent
  FROM k WHERE key <> ''),
lives AS (
  SELECT 'transport_routes' AS parent, upper(trim(route_id)) AS key, first_seen, deleted_at FROM transport_routes
  UNION ALL SELECT 'transport_stops', upper(trim(stop_id)), first_seen, deleted_at FROM transport_stops
  UNION ALL SELECT 'transport_hubs', upper(trim(hub_id)), TIMESTAMP '0001-01-01', NULL FROM transport_hubs),
orphans AS (SELECT * FROM refs r WHERE NOT EXISTS (
  SELECT 1 FROM lives l WHERE l.parent = r.parent AND l.key = r.key AND l.first_seen <= r.loaded_at AND (l.deleted_at IS NULL OR r.loaded_at < l.deleted_at)))
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_report, p6_found, p6_regions)}
ORACLES = {
    "p4_found": _P4_REFS + "SELECT DISTINCT link_id, ref_field FROM orphans",
    "p4_report": _P4_REFS
    + """SELECT r.parent AS referenced_table, r.month, count(*) AS "references", count(o.link_id) AS orphans, count(DISTINCT o.key) AS missing_keys
FROM refs r LEFT JOIN orphans o ON o.link_id = r.link_id AND o.ref_field = r.ref_field AND o.loaded_at = r.loaded_at AND o.key = r.key AND o.month = r.month
GROUP BY ALL""",
    "p6_regions": """SELECT DISTINCT stop_id, hub_id FROM transport_stops s JOIN transport_hubs h ON abs(s.latitude - h.latitude) + abs(s.longitude - h.longitude) < 0.02
  WHERE stop_id IS NOT NULL AND s.latitude BETWEEN -90 AND 90 AND s.longitude BETWEEN -180 AND 180 AND NOT (s.latitude = 0 AND s.longitude = 0)""",
    "p6_found": """WITH p AS (SELECT DISTINCT stop_id, latitude AS y, longitude AS x, CAST(floor(latitude * 500) AS BIGINT) AS cy, CAST(floor(longitude * 50) AS BIGINT) AS cx FROM transport_stops
  WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0)),
n AS (SELECT p.*, cy + dy AS ny, cx + dx AS nx FROM p, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))
SELECT DISTINCT n.stop_id AS stop_a, p.stop_id AS stop_b FROM n JOIN p ON p.cy = n.ny AND p.cx = n.nx AND n.stop_id < p.stop_id
WHERE 2 * 6371000 * asin(sqrt(pow(sin(radians(p.y - n.y) / 2), 2) + cos(radians(n.y)) * cos(radians(p.y)) * pow(sin(radians(p.x - n.x) / 2), 2))) <= 75""",
}
