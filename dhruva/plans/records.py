"""Queries over stops, hubs, fares and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.operators import records as op
from dhruva.operators.proximity import around, nearest, pairs_within, usable
from dhruva.schema import SQL, latest, network, table


def _points(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("stop_id").alias("id"), "canonical_name", "mode", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "primary_source_id", *more)


def nearest_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Five nearest stops of each hub inside the area; metro, rail and MRTS stops only from the source trusted for them."""
    net = network(spark, sf)
    anchors = net.hubs.select(F.col("hub_id").alias("anchor"), F.col("latitude").alias("alat"), F.col("longitude").alias("alon"))
    trusted = _points(net.stops.where("inside_cma = 1")).where("mode = 'bus' or primary_source_id in ('SYN_METRO', 'SYN_BOARD')")
    near = nearest(anchors, trusted, whole_metres=True)
    return near.select(F.col("anchor").alias("hub_id"), "rank", F.col("id").alias("stop_id"), "mode", F.bround("metres").cast("long").alias("distance_m"))


def coordinate_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _points(network(spark, sf).stops).where(usable("lat", "lon")).select("id", F.lower(F.trim("canonical_name")).alias("name"), F.col("primary_source_id").alias("source"), "lat", "lon")
    return op.conflicting(rows.where("name != ''"), 300.0).select(F.col("id").alias("stop_id"), "name")


def hub_members_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Stops within 2 km of a hub stand for it; memberships by distance alone are provisional."""
    net = network(spark, sf)
    hubs = net.hubs.select(F.col("hub_id").alias("anchor"), F.col("latitude").alias("alat"), F.col("longitude").alias("alon"))
    stops = net.stops.select(F.col("stop_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    rows = around(hubs, stops, 2_000.0).select(F.col("anchor").alias("hub_id"), F.col("id").alias("stop_id"), (F.col("metres") > 500).alias("far"))
    return rows.groupBy("hub_id").agg(F.count("*").alias("members"), F.bool_or("far").alias("provisional"), F.min("stop_id").alias("least_stop"))


def anchor_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """What a name stands for: reviewed places first, then hubs, then stops."""
    net = network(spark, sf)
    name = lambda c: F.lower(F.trim(c)).alias("name")
    places = table(spark, sf, "reviewed_name_aliases_v1").select(name("canonical_name"), F.col("entry_id").cast("string").alias("id"))
    hubs = net.hubs.select(name("hub_name"), F.col("hub_id").alias("id"))
    stops = net.stops.select(name("canonical_name"), F.col("stop_id").alias("id"))
    found = op.first_of([("place", places), ("hub", hubs), ("stop", stops)], "name").where("name != ''")
    return found.groupBy("name", "kind").agg(F.count_distinct("id").alias("candidates"), F.min("id").alias("least_id"))


def interchange_either_end(spark: SparkSession, sf: str) -> DataFrame:
    """Walks of at most 75 m between stops of different modes, listed at both ends: a union of two equi-joins, not an OR."""
    net = network(spark, sf)
    near = pairs_within(net.stops, 75.0, "stop_id")
    mode = net.stops.select("stop_id", "mode")
    rows = near.join(mode.select(F.col("stop_id").alias("id_a"), F.col("mode").alias("m_a")), "id_a").join(mode.select(F.col("stop_id").alias("id_b"), F.col("mode").alias("m_b")), "id_b").where("m_a != m_b")
    walk = F.bround("metres").cast("long").alias("walking_distance_m")
    ends = rows.select(F.col("id_a").alias("station"), F.col("id_a").alias("from_stop_id"), F.col("id_b").alias("to_stop_id"), walk)
    return ends.union(rows.select("id_b", "id_a", "id_b", walk))


def accessibility_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Stops with any known flag, and what a requested one says: a null flag is unknown, not false."""
    s = network(spark, sf).stops
    known = s.where(F.coalesce(F.col("inside_cma").cast("double"), F.col("latitude"), F.col("longitude")).isNotNull())
    value = F.when(F.col("inside_cma").isNull(), "unavailable").when(F.col("inside_cma") == 1, "yes").otherwise("no")
    return known.groupBy("mode", value.alias("inside")).agg(F.count("*").alias("stops"))


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The latest order of each customer, ties by order key."""
    rows = latest(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return rows.select("o_custkey", "o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("amount"))


def nocase_equality(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    wanted = spark.createDataFrame([("1-urgent",), ("5-LOW",), ("2-High",)], "class string")
    return o.join(wanted, F.lower("o_orderpriority") == F.lower("class")).groupBy("class").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last_key"))


def pair_symmetry(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring stops that are linked as often in one direction as in the other."""
    from pyspark.sql import Window

    w = Window.partitionBy("route_id", "direction_id").orderBy("stop_sequence")
    hops = network(spark, sf).links.withColumn("next", F.lead("stop_id").over(w)).where("next is not null and next != stop_id")
    n = hops.groupBy(F.col("stop_id").alias("o"), F.col("next").alias("d")).agg(F.count("*").alias("n"))
    back = n.select(F.col("d").alias("o"), F.col("o").alias("d"), F.col("n").alias("back"))
    return n.join(back, ["o", "d"]).where("o < d").groupBy((F.col("n") == F.col("back")).alias("symmetric")).agg(F.count("*").alias("pairs"))


def stop_names(spark: SparkSession, sf: str) -> DataFrame:
    """Id to name for display: one row per stop, a missing name shown as the id."""
    return network(spark, sf).stops.select("stop_id", F.coalesce(F.when(F.trim("canonical_name") != "", F.trim("canonical_name")), "stop_id").alias("label"))


def quality_checks(spark: SparkSession, sf: str) -> DataFrame:
    net = network(spark, sf)
    s, l, r = net.stops, net.links, net.routes
    hubs = net.hubs.select(F.upper("hub_id").alias("stop_id"))
    known = s.select("stop_id").union(hubs)
    return op.report([
        op.check("stop_names_present", s.where("canonical_name is null or length(trim(canonical_name)) = 0")),
        op.check("coordinates_in_box", s.where("not (latitude between 12 and 15) or not (longitude between 78 and 81)")),
        op.check("outside_area", s.where("inside_cma = 0")),
        op.check("one_mode_per_stop", table(spark, sf, "transport_stops").groupBy("stop_id").agg(F.count_distinct("mode").alias("n")).where("n > 1")),
        op.check("hub_names_unique", net.hubs.groupBy(F.lower("hub_name").alias("h")).count().where("count > 1")),
        op.check("alternate_script_names", table(spark, sf, "station_aliases").where("canonical_name_hi is null")),
        op.check("source_present", s.where("primary_source_id is null or trim(primary_source_id) = ''")),
        op.check("link_routes_exist", l.join(r.select("route_id"), "route_id", "left_anti")),
        op.check("link_stops_exist", l.join(known, "stop_id", "left_anti")),
        op.check("link_ids_unique", table(spark, sf, "route_stops").distinct().groupBy("link_id").count().where("count > 1")),
        op.check("operational_routes_linked", r.where("status = 'operational'").join(l.select("route_id"), "route_id", "left_anti")),
        op.check("lifetimes_in_order", table(spark, sf, "transport_stops").where("deleted_at <= first_seen")),
    ])


def range_of_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Links between the first and the last load of the busiest month, bounds from a scalar subquery."""
    table(spark, sf, "route_stops").createOrReplaceTempView("dhruva_route_stops")
    return spark.sql("""WITH m AS (SELECT date_format(loaded_at, 'yyyy-MM') AS month, count(*) AS n, min(loaded_at) AS lo, max(loaded_at) AS hi FROM dhruva_route_stops GROUP BY 1),
best AS (SELECT max(struct(n, month)).month AS month FROM m)
SELECT direction_id, count(*) AS links FROM dhruva_route_stops
WHERE loaded_at BETWEEN (SELECT max(lo) FROM m JOIN best USING (month)) AND (SELECT max(hi) FROM m JOIN best USING (month)) GROUP BY direction_id""")


QUERIES = {
    f.__name__: f
    for f in (
        nearest_stops, coordinate_conflicts, hub_members_expand, anchor_fallback, interchange_either_end, accessibility_flag, latest_per_key, nocase_equality, pair_symmetry, stop_names,
        quality_checks, range_of_bounds,
    )
}
_DIST = "2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"
_OK = "{a}.latitude BETWEEN -90 AND 90 AND {a}.longitude BETWEEN -180 AND 180 AND NOT ({a}.latitude = 0 AND {a}.longitude = 0)"
_CHECKS = {
    "stop_names_present": "SELECT 1 FROM stops WHERE canonical_name IS NULL OR length(trim(canonical_name)) = 0",
    "coordinates_in_box": "SELECT 1 FROM stops WHERE NOT (latitude BETWEEN 12 AND 15) OR NOT (longitude BETWEEN 78 AND 81)",
    "outside_area": "SELECT 1 FROM stops WHERE inside_cma = 0",
    "one_mode_per_stop": "SELECT 1 FROM transport_stops GROUP BY stop_id HAVING count(DISTINCT mode) > 1",
    "hub_names_unique": "SELECT 1 FROM transport_hubs GROUP BY lower(hub_name) HAVING count(*) > 1",
    "alternate_script_names": "SELECT 1 FROM station_aliases WHERE canonical_name_hi IS NULL",
    "source_present": "SELECT 1 FROM stops WHERE primary_source_id IS NULL OR trim(primary_source_id) = ''",
    "link_routes_exist": "SELECT 1 FROM links l WHERE NOT EXISTS (SELECT 1 FROM routes r WHERE r.route_id = l.route_id)",
    "link_stops_exist": "SELECT 1 FROM links l WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.stop_id = l.stop_id) AND NOT EXISTS (SELECT 1 FROM transport_hubs h WHERE upper(h.hub_id) = l.stop_id)",
    "link_ids_unique": "SELECT 1 FROM (SELECT DISTINCT * FROM route_stops) GROUP BY link_id HAVING count(*) > 1",
    "operational_routes_linked": "SELECT 1 FROM routes r WHERE status = 'operational' AND NOT EXISTS (SELECT 1 FROM links l WHERE l.route_id = r.route_id)",
    "lifetimes_in_order": "SELECT 1 FROM transport_stops WHERE deleted_at <= first_seen",
}
ORACLES = {
    "nearest_stops": SQL + f"""SELECT hub_id, CAST(rank AS INT) AS rank, stop_id, mode, CAST(round_even(metres, 0) AS BIGINT) AS distance_m FROM (
  SELECT h.hub_id, s.stop_id, s.mode, {_DIST.format(a='h', b='s')} AS metres, row_number() OVER (PARTITION BY h.hub_id ORDER BY round_even({_DIST.format(a='h', b='s')}, 0), s.stop_id) AS rank
  FROM transport_hubs h, stops s WHERE {_OK.format(a='h')} AND {_OK.format(a='s')} AND s.inside_cma = 1 AND (s.mode = 'bus' OR s.primary_source_id IN ('SYN_METRO', 'SYN_BOARD'))) WHERE rank <= 5""",
    "coordinate_conflicts": SQL + f""", p AS (SELECT *, lower(trim(canonical_name)) AS name FROM stops s WHERE {_OK.format(a='s')} AND trim(canonical_name) <> '')
SELECT stop_id, name FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.name = a.name AND b.primary_source_id <> a.primary_source_id AND {_DIST.format(a='a', b='b')} > 300)""",
    "hub_members_expand": SQL + f"""SELECT hub_id, count(*) AS members, bool_or(metres > 500) AS provisional, min(stop_id) AS least_stop FROM (
  SELECT h.hub_id, s.stop_id, {_DIST.format(a='h', b='s')} AS metres FROM transport_hubs h, stops s WHERE {_OK.format(a='h')} AND {_OK.format(a='s')}) WHERE metres <= 2000 GROUP BY hub_id""",
    "anchor_fallback": SQL + """, c AS (SELECT lower(trim(canonical_name)) AS name, 'place' AS kind, 0 AS p, CAST(entry_id AS VARCHAR) AS id FROM reviewed_name_aliases_v1
  UNION ALL SELECT lower(trim(hub_name)), 'hub', 1, hub_id FROM transport_hubs UNION ALL SELECT lower(trim(canonical_name)), 'stop', 2, stop_id FROM stops)
SELECT name, kind, count(DISTINCT id) AS candidates, min(id) AS least_id FROM (SELECT *, min(p) OVER (PARTITION BY name) AS top FROM c) WHERE p = top AND name <> '' GROUP BY ALL""",
    "interchange_either_end": SQL + f""", near AS (SELECT a.stop_id AS f, b.stop_id AS t, {_DIST.format(a='a', b='b')} AS metres FROM stops a JOIN stops b ON a.stop_id < b.stop_id AND a.mode <> b.mode
  AND abs(a.latitude - b.latitude) < 0.001 AND abs(a.longitude - b.longitude) < 0.01 WHERE {_OK.format(a='a')} AND {_OK.format(a='b')}),
w AS (SELECT f, t, CAST(round_even(metres, 0) AS BIGINT) AS walking_distance_m FROM near WHERE metres <= 75)
SELECT f AS station, f AS from_stop_id, t AS to_stop_id, walking_distance_m FROM w UNION ALL SELECT t, f, t, walking_distance_m FROM w""",
    "accessibility_flag": SQL + """SELECT mode, CASE WHEN inside_cma IS NULL THEN 'unavailable' WHEN inside_cma = 1 THEN 'yes' ELSE 'no' END AS inside, count(*) AS stops FROM stops
WHERE inside_cma IS NOT NULL OR latitude IS NOT NULL OR longitude IS NOT NULL GROUP BY ALL""",
    "latest_per_key": """SELECT o_custkey, o_orderkey, o_orderdate, round(o_totalprice, 2) AS amount FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "nocase_equality": "SELECT class, count(*) AS orders, max(o_orderkey) AS last_key FROM orders JOIN (VALUES ('1-urgent'), ('5-LOW'), ('2-High')) w(class) ON lower(class) = lower(o_orderpriority) GROUP BY class",
    "pair_symmetry": SQL + """, hops AS (SELECT stop_id AS o, lead(stop_id) OVER (PARTITION BY route_id, direction_id ORDER BY stop_sequence) AS d FROM links),
n AS (SELECT o, d, count(*) AS n FROM hops WHERE d IS NOT NULL AND d <> o GROUP BY ALL)
SELECT a.n = b.n AS symmetric, count(*) AS pairs FROM n a JOIN n b ON a.o = b.d AND a.d = b.o WHERE a.o < a.d GROUP BY 1""",
    "stop_names": SQL + "SELECT stop_id, coalesce(CASE WHEN trim(canonical_name) <> '' THEN trim(canonical_name) END, stop_id) AS label FROM stops",
    "quality_checks": SQL + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) = 0 AS passed, count(*) AS failures FROM ({v})" for k, v in _CHECKS.items()),
    "range_of_bounds": """WITH m AS (SELECT strftime(loaded_at, '%Y-%m') AS month, count(*) AS n, min(loaded_at) AS lo, max(loaded_at) AS hi FROM route_stops GROUP BY 1),
best AS (SELECT month FROM m ORDER BY n DESC, month DESC LIMIT 1)
SELECT direction_id, count(*) AS links FROM route_stops WHERE loaded_at BETWEEN (SELECT lo FROM m JOIN best USING (month)) AND (SELECT hi FROM m JOIN best USING (month)) GROUP BY direction_id""",
}
