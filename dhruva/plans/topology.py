"""Queries over routes and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.operators import topology as op
from dhruva.schema import SQL, network

_REQ = SQL + """, seqs AS (
  SELECT route_id, direction_id, list(stop_id ORDER BY stop_sequence, stop_id) AS s FROM usable GROUP BY ALL HAVING count(*) >= 3),
requests AS (SELECT DISTINCT s[1] AS origin, s[(len(s) + 1) // 2] AS via, s[-1] AS destination FROM seqs WHERE s[1] <> s[-1]),
found AS (
  SELECT q.origin, q.destination, q.via, a.route_id, a.direction_id, a.stop_sequence AS origin_sequence, b.stop_sequence AS destination_sequence
  FROM requests q JOIN usable a ON a.stop_id = q.origin JOIN usable b ON b.stop_id = q.destination AND b.route_id = a.route_id AND b.direction_id = a.direction_id AND b.stop_sequence > a.stop_sequence),
full_found AS (SELECT f.*, r.route_short_name, r.mode, r.source_id, c.total_links <> c.usable_links AS partial_topology FROM found f JOIN routes r ON r.route_id = f.route_id JOIN coverage c ON c.route_id = f.route_id)
"""
_COLS = ["origin", "destination", "route_id", "route_short_name", "mode", "source_id", "direction_id", "origin_sequence", "destination_sequence", "partial_topology"]


def plan_route_pairs(spark: SparkSession, sf: str) -> DataFrame:
    net = network(spark, sf)
    return op.direct_routes(net, op.terminal_requests(net).select("origin", "destination").distinct()).select(*_COLS)


def plan_route_top10(spark: SparkSession, sf: str) -> DataFrame:
    net = network(spark, sf)
    found = op.direct_routes(net, op.terminal_requests(net).select("origin", "destination").distinct())
    return op.first_options(found, 10).select(*_COLS, "rank", "truncated")


def plan_route_via(spark: SparkSession, sf: str) -> DataFrame:
    net = network(spark, sf)
    return op.direct_routes(net, op.terminal_requests(net), via=True).select(*_COLS, "via")


def route_options_capped(spark: SparkSession, sf: str) -> DataFrame:
    """All journeys between stops whose names are those of a request, equal modes only: at most 10 per pair of names."""
    best = op.options_between_names(network(spark, sf), 10)
    return best.groupBy("origin", "destination", "truncated").agg(F.count("*").alias("options"), F.min("route_id").alias("least_route"))


def route_topology_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return op.coverage(network(spark, sf))


def list_route_stops(spark: SparkSession, sf: str) -> DataFrame:
    return op.stop_sequences(network(spark, sf))


def stop_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Asked for every stop that any link of a route code names."""
    net = network(spark, sf)
    named = net.routes.where("status = 'operational'").select("route_id", op.route_key("route_short_name").alias("code")).where("code != ''")
    return op.membership(net, net.links.join(named, "route_id").select("code", "stop_id").distinct())


def preflight_mode_topology(spark: SparkSession, sf: str) -> DataFrame:
    """Is there any mode-consistent topology for a mode? The refusal is published_mode_topology_absent."""
    net = network(spark, sf)
    modes = net.stops.select("mode").union(net.routes.select("mode")).distinct()
    there = net.usable.select("mode", F.lit(True).alias("there")).distinct()
    return modes.join(there, "mode", "left").select("mode", F.when(F.col("there"), "ok").otherwise("published_mode_topology_absent").alias("reason"))


def monotone_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of the stop sequence per route and direction."""
    from pyspark.sql import Window

    w = Window.partitionBy("route_id", "direction_id").orderBy("stop_sequence")
    rows = network(spark, sf).usable.withColumn("step", F.col("stop_sequence") - F.lag("stop_sequence").over(w))
    return rows.groupBy("route_id").agg(F.count("step").alias("steps"), F.max("step").cast("long").alias("largest_step"), F.count_if(F.col("step") <= 0).alias("backward"))


def route_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Stops per route code over all its routes."""
    net = network(spark, sf)
    named = net.usable.select(op.route_key("route_short_name").alias("code"), "route_id", "stop_id").where("code != ''")
    return named.groupBy("code").agg(F.count_distinct("route_id").alias("routes"), F.count_distinct("stop_id").alias("stops"))


QUERIES = {f.__name__: f for f in (plan_route_pairs, plan_route_top10, plan_route_via, route_options_capped, route_topology_coverage, list_route_stops, stop_membership, preflight_mode_topology, monotone_sequences, route_codes)}
_C = ", ".join(_COLS)
_D = ", ".join(c for c in _COLS)
ORACLES = {
    "plan_route_pairs": _REQ + f"SELECT DISTINCT {_C} FROM full_found",
    "plan_route_top10": _REQ + f"""SELECT {_C}, CAST(rank AS INT) AS rank, truncated FROM (SELECT *, max(rank) OVER (PARTITION BY origin, destination) > 10 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY destination_sequence - origin_sequence, route_id, direction_id, origin_sequence) AS rank
  FROM (SELECT DISTINCT {_C} FROM full_found))) WHERE rank <= 10""",
    "plan_route_via": _REQ + f"""SELECT {_C}, via FROM full_found f WHERE EXISTS (SELECT 1 FROM usable m WHERE m.route_id = f.route_id AND m.direction_id = f.direction_id
  AND m.stop_id = f.via AND m.stop_sequence > f.origin_sequence AND m.stop_sequence < f.destination_sequence)""",
    "route_options_capped": _REQ + """, names AS (SELECT stop_id, lower(trim(canonical_name)) AS name FROM stops WHERE trim(canonical_name) <> ''),
asked AS (SELECT DISTINCT a.name AS f, b.name AS t FROM requests q JOIN names a ON a.stop_id = q.origin JOIN names b ON b.stop_id = q.destination),
ends AS (SELECT DISTINCT k.f, k.t, a.stop_id AS o, b.stop_id AS d FROM asked k JOIN names a ON a.name = k.f JOIN names b ON b.name = k.t WHERE a.stop_id <> b.stop_id),
opts AS (SELECT DISTINCT e.f, e.t, x.route_id, x.direction_id, x.stop_sequence AS os, y.stop_sequence AS ds FROM ends e JOIN usable x ON x.stop_id = e.o
  JOIN usable y ON y.stop_id = e.d AND y.route_id = x.route_id AND y.direction_id = x.direction_id AND y.stop_sequence > x.stop_sequence),
ranked AS (SELECT *, row_number() OVER (PARTITION BY f, t ORDER BY ds - os, route_id, direction_id, os) AS rank, count(*) OVER (PARTITION BY f, t) > 10 AS truncated FROM opts)
SELECT f AS origin, t AS destination, truncated, count(*) AS options, min(route_id) AS least_route FROM ranked WHERE rank <= 10 GROUP BY ALL""",
    "route_topology_coverage": SQL + "SELECT *, total_links <> usable_links AS partial_topology FROM coverage",
    "list_route_stops": SQL + "SELECT route_id, direction_id, CAST(count(*) AS INT) AS n_stops, string_agg(stop_id, '>' ORDER BY stop_sequence, stop_id) AS stops FROM usable GROUP BY ALL HAVING count(*) >= 2",
    "stop_membership": SQL + """, named AS (SELECT route_id, upper(regexp_replace(route_short_name, '[ -]', '', 'g')) AS code FROM routes WHERE status = 'operational' AND upper(regexp_replace(route_short_name, '[ -]', '', 'g')) <> ''),
asked AS (SELECT DISTINCT n.code, l.stop_id FROM links l JOIN named n ON n.route_id = l.route_id),
per_code AS (SELECT n.code, count(*) AS routes, bool_or(c.total_links <> c.usable_links OR c.total_links = 0) AS partial FROM named n JOIN coverage c ON c.route_id = n.route_id GROUP BY n.code),
hit AS (SELECT n.code, u.stop_id, count(DISTINCT u.route_id) AS matched FROM usable u JOIN named n ON n.route_id = u.route_id GROUP BY ALL)
SELECT a.code, a.stop_id, p.routes, coalesce(h.matched, 0) AS matched, CASE WHEN h.matched > 0 THEN 'yes' WHEN p.partial THEN 'unavailable' ELSE 'no' END AS on_route
FROM asked a JOIN per_code p ON p.code = a.code LEFT JOIN hit h ON h.code = a.code AND h.stop_id = a.stop_id""",
    "preflight_mode_topology": SQL + """SELECT m.mode, CASE WHEN EXISTS (SELECT 1 FROM usable u WHERE u.mode = m.mode) THEN 'ok' ELSE 'published_mode_topology_absent' END AS reason
FROM (SELECT mode FROM stops UNION SELECT mode FROM routes) m""",
    "monotone_sequences": SQL + """SELECT route_id, count(step) AS steps, CAST(max(step) AS BIGINT) AS largest_step, count(*) FILTER (step <= 0) AS backward FROM (
  SELECT route_id, stop_sequence - lag(stop_sequence) OVER (PARTITION BY route_id, direction_id ORDER BY stop_sequence) AS step FROM usable) GROUP BY route_id""",
    "route_codes": SQL + """SELECT code, count(DISTINCT route_id) AS routes, count(DISTINCT stop_id) AS stops FROM (
  SELECT upper(regexp_replace(route_short_name, '[ -]', '', 'g')) AS code, route_id, stop_id FROM usable) WHERE code <> '' GROUP BY code""",
}
