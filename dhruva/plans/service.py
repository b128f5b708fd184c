"""Queries over operations on published routes, and over data sets as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dhruva.functions.display import canonical_json
from dhruva.operators import corpus
from dhruva.operators import records as rec
from dhruva.operators import service as op
from dhruva.operators import topology as top
from dhruva.plans import records as plan_records
from dhruva.plans import topology as plan_topology
from dhruva.plans.evaluation import LABELS
from dhruva.plans.evaluation import _SPLIT as SPLIT_SQL
from dhruva.plans.evaluation import _split as split_of
from dhruva.schema import SQL, network, table

_CASES = [(o, s, v) for o in (*op.REFUSED, *op.TEMPORAL, "GET_INTERCHANGE_DETAILS", "GET_ACCESSIBILITY_INFO", "LIST_ROUTE_STOPS") for s, v in (("none", ""), ("date", "2024-01-10"), ("timing_type", "first"), ("time", ""), ("preference", "fastest"), ("preference", "direct_only"))]


def preflight(spark: SparkSession, sf: str) -> DataFrame:
    """Which operations can be answered at all; a stop's flag stands for accessibility, a walk of 75 m for an interchange."""
    cases = spark.createDataFrame(_CASES, "operation string, slot string, value string")
    walks = plan_records.interchange_either_end(spark, sf).limit(1).agg((F.count("*") > 0).alias("walks"))
    flags = network(spark, sf).stops.where("inside_cma is not null").limit(1).agg((F.count("*") > 0).alias("flags"))
    rows = cases.crossJoin(F.broadcast(walks)).crossJoin(F.broadcast(flags))
    return rows.select("operation", "slot", "value", op.refusal(F.col("operation"), F.create_map("slot", "value"), F.col("walks"), F.col("flags")).alias("reason"))


def plan_route_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Direct services by bus, and of a route asked for by its code in another spelling."""
    net = network(spark, sf)
    asked = top.terminal_requests(net).select("origin", "destination").distinct()
    by_mode = op.plan(net, asked.withColumn("asked_mode", F.lit("bus"))).select("origin", "destination", "route_id", "direction_id", F.lit("mode").alias("asked"))
    first = net.routes.where("status = 'operational' and trim(route_short_name) != ''").groupBy().agg(F.min_by("route_short_name", "route_id").alias("name"))
    by_code = op.plan(net, asked.crossJoin(F.broadcast(first.select(F.concat_ws("-", F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)")).alias("asked_code")))))
    return by_mode.union(by_code.select("origin", "destination", "route_id", "direction_id", F.lit("code"))).distinct()


def service_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded connections of the journeys between ends, asked in both directions."""
    net = network(spark, sf)
    asked = top.terminal_requests(net).select("origin", "destination")
    return op.availability(net, asked.union(asked.select("destination", "origin")))


def route_stop_report(spark: SparkSession, sf: str) -> DataFrame:
    return op.route_report(network(spark, sf))


def route_sequences_first(spark: SparkSession, sf: str) -> DataFrame:
    return op.first_sequences(network(spark, sf))


def published_options(spark: SparkSession, sf: str) -> DataFrame:
    net = network(spark, sf)
    names = net.stops.where("trim(canonical_name) != ''").select(F.lower(F.trim("canonical_name")).alias("name"), "stop_id", "mode")
    ends = top.terminal_requests(net).select("origin", "destination").distinct()
    asked = ends.join(names.select(F.col("stop_id").alias("origin"), F.col("name").alias("from_name")), "origin").join(names.select(F.col("stop_id").alias("destination"), F.col("name").alias("to_name")), "destination")
    return op.published_options(net, names, asked.select("from_name", "to_name").distinct())


def interchange_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten walks of each station, the shortest first."""
    rows = plan_records.interchange_either_end(spark, sf)
    w = Window.partitionBy("station").orderBy("walking_distance_m", "from_stop_id", "to_stop_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Event types of each user in the order in which they first occur."""
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("t"))
    each = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_type"))).alias("e"))
    return each.select("user_id", F.array_join(F.transform("e", lambda x: x["event_type"]), ">").alias("kinds"))


def canonical_records(spark: SparkSession, sf: str) -> DataFrame:
    """Stops as canonical JSON: equal records are equal strings."""
    s = network(spark, sf).stops
    return s.select(canonical_json(stop_id=F.col("stop_id"), name=F.trim("canonical_name"), mode=F.col("mode"), inside=F.col("inside_cma")).alias("record")).groupBy("record").agg(F.count("*").alias("n"))


def dataset_checks(spark: SparkSession, sf: str) -> DataFrame:
    """May the questions be trained on? Blank texts and families, unknown labels and splits, duplicates, torn families, labels that a split lacks."""
    q = table(spark, sf, "hindi_intents").select("id", "text", F.lower(F.trim("intent")).alias("intent"), corpus.family_name("family_id", "intent").alias("family"), split_of("split").alias("split")).distinct()
    groups = q.where("text is not null").groupBy("text").agg(F.count_distinct("id").alias("n")).where("n > 1")
    torn = q.where("family is not null and split is not null").groupBy("family").agg(F.count_distinct("split").alias("n")).where("n > 1")
    labels = spark.createDataFrame([(x,) for x in LABELS], "intent string")
    splits = spark.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    lacking = labels.crossJoin(splits).join(q.select("intent", "split"), ["intent", "split"], "left_anti")
    return rec.report([
        rec.check("blank_text", q.where("text is null or trim(text) = ''")), rec.check("no_family", q.where("family is null")), rec.check("unknown_label", q.where(F.col("intent").isNull() | ~F.col("intent").isin(LABELS))),
        rec.check("unknown_split", q.where("split is null")), rec.check("duplicate_question", groups), rec.check("torn_family", torn), rec.check("label_absent_from_split", lacking),
    ])


QUERIES = {f.__name__: f for f in (preflight, plan_route_filtered, service_availability, route_stop_report, route_sequences_first, published_options, interchange_first, ordered_distinct, canonical_records, dataset_checks)}
_KEY = "upper(regexp_replace(route_short_name, '[ -]', '', 'g'))"
_NAMED = f"named AS (SELECT route_id, {_KEY} AS code FROM routes WHERE status = 'operational' AND {_KEY} <> '')"
_WALKS = plan_records.ORACLES["interchange_either_end"]
ORACLES = {
    "preflight": f"""WITH c(operation, slot, value) AS (VALUES {", ".join(f"('{o}', '{s}', '{v}')" for o, s, v in _CASES)}), k AS (SELECT (SELECT count(*) > 0 FROM ({_WALKS})) AS walks, (SELECT count(*) > 0 FROM transport_stops WHERE inside_cma IS NOT NULL) AS flags)
SELECT operation, slot, value, CASE
  WHEN operation = 'PLAN_ROUTE' AND slot IN ('date', 'time', 'temporal_relative', 'timing_type') AND value <> '' THEN 'route_temporal_scope_unsupported'
  WHEN operation = 'CHECK_SERVICE_AVAILABILITY' AND slot IN ('date', 'time', 'temporal_relative') AND value <> '' THEN 'availability_temporal_scope_unsupported'
  WHEN operation = 'PLAN_ROUTE' AND slot = 'preference' AND value IN ('fastest', 'cheapest', 'least_transfers') THEN 'route_preference_unsupported'
  WHEN operation = 'GET_TICKETING_POLICY' THEN 'ticket_policy_absent' WHEN operation = 'GET_STATION_FACILITY' THEN 'facility_verification_absent' WHEN operation = 'PLAN_MULTIMODAL_ROUTE' THEN 'confirmed_multimodal_graph_absent'
  WHEN operation = 'REJECT_UNSUPPORTED_REALTIME' THEN 'realtime_status_unsupported' WHEN operation = 'REJECT_OUT_OF_SCOPE' THEN 'out_of_scope'
  WHEN operation = 'GET_INTERCHANGE_DETAILS' AND NOT walks THEN 'confirmed_interchanges_absent' WHEN operation = 'GET_ACCESSIBILITY_INFO' AND NOT flags THEN 'accessibility_values_absent' END AS reason FROM c, k""",
    "plan_route_filtered": plan_topology._REQ + f""", f AS (SELECT min_by(route_short_name, route_id) AS name FROM routes WHERE status = 'operational' AND trim(route_short_name) <> '')
SELECT DISTINCT origin, destination, route_id, direction_id, 'mode' AS asked FROM full_found WHERE mode = 'bus'
UNION SELECT DISTINCT origin, destination, route_id, direction_id, 'code' FROM full_found, f WHERE {_KEY} = upper(regexp_replace(name, '[ -]', '', 'g'))""",
    "service_availability": plan_topology._REQ + """, asked AS (SELECT origin, destination FROM requests UNION SELECT destination, origin FROM requests),
hits AS (SELECT q.origin, q.destination, count(DISTINCT a.route_id) AS routes, bool_or(c.total_links <> c.usable_links) AS partial FROM asked q JOIN usable a ON a.stop_id = q.origin
  JOIN usable b ON b.stop_id = q.destination AND b.route_id = a.route_id AND b.direction_id = a.direction_id AND b.stop_sequence > a.stop_sequence JOIN coverage c ON c.route_id = a.route_id GROUP BY ALL)
SELECT q.origin, q.destination, CASE WHEN h.routes > 0 THEN 'recorded' ELSE 'unavailable' END AS status, coalesce(h.routes, 0) AS routes, coalesce(h.partial, false) AS partial
FROM asked q LEFT JOIN hits h ON h.origin = q.origin AND h.destination = q.destination""",
    "route_stop_report": SQL + f""", {_NAMED}, s AS (SELECT route_id, count(*) AS sequences FROM (SELECT route_id, direction_id FROM usable GROUP BY ALL HAVING count(*) >= 2) GROUP BY route_id),
r AS (SELECT n.code, sum(coalesce(s.sequences, 0)) AS sequences, sum(c.total_links - c.usable_links) AS excluded, coalesce(string_agg(n.route_id, ',' ORDER BY n.route_id) FILTER (c.usable_links < 2), '') AS uncovered
  FROM named n JOIN coverage c ON c.route_id = n.route_id LEFT JOIN s ON s.route_id = n.route_id GROUP BY n.code)
SELECT code, CASE WHEN sequences > 0 THEN 'ok' ELSE 'unavailable' END AS status, CAST(sequences AS BIGINT) AS sequences, sequences > 10 AS truncated, CAST(excluded AS BIGINT) AS excluded_unusable_rows, uncovered AS uncovered_route_ids, excluded > 0 OR uncovered <> '' AS partial_topology FROM r""",
    "route_sequences_first": SQL + f""", {_NAMED}, s AS (SELECT route_id, direction_id, string_agg(stop_id, '>' ORDER BY stop_sequence, stop_id) AS stops FROM usable GROUP BY ALL HAVING count(*) >= 2)
SELECT code, CAST(rank AS INT) AS rank, route_id, direction_id, stops FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY route_id, direction_id) AS rank FROM s JOIN named USING (route_id)) WHERE rank <= 10""",
    "published_options": plan_topology._REQ + """, nm AS (SELECT lower(trim(canonical_name)) AS name, stop_id, mode FROM stops WHERE trim(canonical_name) <> ''),
ask AS (SELECT DISTINCT a.name AS from_name, b.name AS to_name FROM requests q JOIN nm a ON a.stop_id = q.origin JOIN nm b ON b.stop_id = q.destination),
pr AS (SELECT k.*, a.stop_id AS origin, b.stop_id AS destination, count(*) OVER (PARTITION BY from_name, to_name) AS total, row_number() OVER (PARTITION BY from_name, to_name ORDER BY a.stop_id, b.stop_id) AS n
  FROM ask k JOIN nm a ON a.name = k.from_name JOIN nm b ON b.name = k.to_name AND b.mode = a.mode),
opt AS (SELECT DISTINCT p.from_name, p.to_name, p.total, r.route_short_name, p.origin, p.destination, a.route_id, a.direction_id FROM pr p JOIN usable a ON a.stop_id = p.origin
  JOIN usable b ON b.stop_id = p.destination AND b.route_id = a.route_id AND b.direction_id = a.direction_id AND b.stop_sequence > a.stop_sequence JOIN routes r ON r.route_id = a.route_id WHERE p.n <= 64 AND p.origin <> p.destination),
rk AS (SELECT *, count(*) OVER (PARTITION BY from_name, to_name) AS many, row_number() OVER (PARTITION BY from_name, to_name ORDER BY route_short_name NULLS FIRST, origin, destination, route_id, direction_id) AS rank FROM opt)
SELECT from_name, to_name, CAST(rank AS INT) AS rank, route_id, direction_id, origin, destination, many > 10 OR total > 64 AS truncated FROM rk WHERE rank <= 10""",
    "interchange_first": f"SELECT station, from_stop_id, to_stop_id, walking_distance_m, CAST(row_number() OVER (PARTITION BY station ORDER BY walking_distance_m, from_stop_id, to_stop_id) AS INT) AS rank FROM ({_WALKS}) QUALIFY rank <= 10",
    "ordered_distinct": "SELECT user_id, string_agg(event_type, '>' ORDER BY t, event_type) AS kinds FROM (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL) GROUP BY user_id",
    "canonical_records": SQL + "SELECT CAST(to_json({'inside': inside_cma, 'mode': mode, 'name': trim(canonical_name), 'stop_id': stop_id}) AS VARCHAR) AS record, count(*) AS n FROM stops GROUP BY 1",
    "dataset_checks": rf"""WITH raw AS (SELECT DISTINCT id, text, lower(trim(intent)) AS intent, lower(regexp_replace(family_id, '[\s\p{{Z}}\p{{Cf}}]+', '', 'g')) AS f, lower(regexp_replace(intent, '[\s\p{{Z}}\p{{Cf}}]+', '', 'g')) AS i, {SPLIT_SQL} AS split FROM hindi_intents),
n AS (SELECT *, CASE WHEN regexp_matches(f, '^.+:[0-9]+$') THEN regexp_replace(f, ':[0-9]+$', '') WHEN regexp_matches(f, '^[0-9]+$') THEN i END AS name, regexp_replace(regexp_extract(f, '([0-9]+)$', 1), '^0+([0-9])', '\1') AS number FROM raw),
q AS (SELECT DISTINCT id, text, intent, CASE WHEN name <> '' THEN name || ':' || number END AS family, split FROM n),
l(intent) AS (VALUES """ + ", ".join(f"('{x}')" for x in LABELS) + """),
c AS (SELECT 'blank_text' AS check_name, count(*) AS failures FROM q WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT 'no_family', count(*) FROM q WHERE family IS NULL
  UNION ALL SELECT 'unknown_label', count(*) FROM q WHERE intent IS NULL OR intent NOT IN (SELECT intent FROM l) UNION ALL SELECT 'unknown_split', count(*) FROM q WHERE split IS NULL
  UNION ALL SELECT 'duplicate_question', count(*) FROM (SELECT text FROM q WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT id) > 1)
  UNION ALL SELECT 'torn_family', count(*) FROM (SELECT family FROM q WHERE family IS NOT NULL AND split IS NOT NULL GROUP BY family HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'label_absent_from_split', count(*) FROM l, (VALUES ('train'), ('validation'), ('test')) v(split) WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.intent = l.intent AND q.split = v.split))
SELECT check_name, failures = 0 AS passed, failures FROM c""",
}
