"""Queries over departures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.operators import schedule as op
from dhruva.schema import table

_D = """WITH d AS (SELECT event_id, user_id AS trip_id, event_type AS route_id, CAST(ts AS DATE) AS service_day, strftime(ts, '%H:%M:%S') AS clock, CAST(event_id % 2 AS INT) AS direction_id, 'STOP_' || (user_id % 3) AS stop_id FROM events),
cal(service_id, first_day, last_day, days) AS (VALUES ('view', DATE '2024-01-01', DATE '2025-12-31', [0,1,2,3,4,5,6]), ('click', DATE '2024-01-01', DATE '2025-12-31', [0,1,2,3,4]),
  ('purchase', DATE '2024-01-01', DATE '2025-12-31', [5,6]), ('signup', DATE '2024-01-15', DATE '2024-01-31', [0,1,2,3,4,5,6]), ('error', DATE '2023-01-01', DATE '2023-12-31', [0,1,2,3,4,5,6])),
running AS (SELECT * FROM d WHERE EXISTS (SELECT 1 FROM cal c WHERE c.service_id = d.route_id AND d.service_day BETWEEN c.first_day AND c.last_day AND list_contains(c.days, isodow(d.service_day) - 1))),
m AS (SELECT *, CAST(split_part(clock, ':', 1) AS INT) * 60 + CAST(split_part(clock, ':', 2) AS INT) + CASE WHEN CAST(split_part(clock, ':', 3) AS INT) >= 30 THEN 1 ELSE 0 END AS minute FROM d)
"""


def _deps(spark: SparkSession, sf: str) -> DataFrame:
    return op.departures(table(spark, sf, "events"))


def first_last_service(spark: SparkSession, sf: str) -> DataFrame:
    return op.first_last(op.running(_deps(spark, sf), op.calendars(spark)), ["route_id", "service_day"])


def scheduled_departures(spark: SparkSession, sf: str) -> DataFrame:
    return op.next_departures(_deps(spark, sf), ["route_id", "service_day"], "08:00:00").select("route_id", "service_day", "rank", "clock", "trip_id")


def calendar_active_departures(spark: SparkSession, sf: str) -> DataFrame:
    rows = op.running(_deps(spark, sf), op.calendars(spark))
    return rows.groupBy("route_id", F.weekday("service_day").alias("weekday")).agg(F.count("*").alias("departures"))


def preflight_mode_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Does a route have any departure that its calendar allows?"""
    deps = _deps(spark, sf)
    there = op.running(deps, op.calendars(spark)).select("route_id", F.lit(True).alias("there")).distinct()
    rows = deps.select("route_id").distinct().join(there, "route_id", "left")
    return rows.select("route_id", F.when(F.col("there"), "ok").otherwise("published_mode_schedule_absent").alias("reason"))


def service_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return op.headways(_deps(spark, sf), [*op.GROUP, "service_day"])


def frequency_windowed(spark: SparkSession, sf: str) -> DataFrame:
    """The two hours from 08:00, by rounded minutes."""
    return op.headways(_deps(spark, sf), [*op.GROUP, "service_day"], "08:00:00")


def frequency_group_guard(spark: SparkSession, sf: str) -> DataFrame:
    """A headway is only told for one route, direction and stop: asked for a trip's day, a route's day is ambiguous."""
    deps = _deps(spark, sf)
    by_route = op.frequency(deps, ["route_id", "service_day"]).withColumn("trip_id", F.lit(None).cast("long"))
    by_trip = op.frequency(deps, ["route_id", "trip_id"]).withColumn("service_day", F.lit(None).cast("date"))
    return by_route.unionByName(by_trip).select("route_id", "trip_id", "service_day", "status", "median_headway_minutes", "sample_intervals")


def schedule_reaches_destination(spark: SparkSession, sf: str) -> DataFrame:
    return op.reaches(_deps(spark, sf).where("route_id in ('view', 'purchase')"), "purchase").where("route_id = 'view'").select("event_id", "trip_id", "service_day", "clock")


def relative_days(spark: SparkSession, sf: str) -> DataFrame:
    """Departures of a word's day, counted from a fixed today."""
    words = spark.createDataFrame([("today",), ("aaj",), ("tomorrow",), ("yesterday",), ("parso",)], "word string")
    days = words.withColumn("day", op.relative_day("word", F.lit("2024-01-10").cast("date")))
    rows = days.join(_deps(spark, sf), F.col("day") == F.col("service_day"), "left")
    return rows.groupBy("word", "day").agg(F.count("event_id").alias("departures"))


def recent_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The five most recent distinct event types of each user: the last time of each, newest first."""
    from pyspark.sql import Window

    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"))
    w = Window.partitionBy("user_id").orderBy(F.col("last_ts").desc(), "event_type")
    return last.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("user_id", "event_type", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        first_last_service, scheduled_departures, calendar_active_departures, preflight_mode_schedule, service_frequency, frequency_windowed, frequency_group_guard, schedule_reaches_destination,
        relative_days, recent_distinct,
    )
}
def _headways(by: str, where: str = "true") -> str:
    return f"""SELECT {by}, CAST(median(gap) AS DOUBLE) AS median_headway_minutes, count(*) AS sample_intervals FROM (
  SELECT *, minute - lag(minute) OVER (PARTITION BY {by} ORDER BY minute) AS gap FROM (SELECT DISTINCT {by}, minute FROM m WHERE {where})) WHERE gap <= 180 GROUP BY {by}"""


_ALL = "route_id, direction_id, stop_id, "
_TOLD = """SELECT g.route_id, {trip} AS trip_id, {day} AS service_day, CASE WHEN n > 1 THEN 'frequency_direction_or_stop_ambiguous' WHEN sample_intervals IS NULL THEN 'too_few_departures' ELSE 'ok' END AS status,
  CASE WHEN n = 1 THEN median_headway_minutes END AS median_headway_minutes, CASE WHEN n = 1 THEN sample_intervals END AS sample_intervals
FROM (SELECT route_id, {by}, count(DISTINCT direction_id || '/' || stop_id) AS n FROM d GROUP BY ALL) g LEFT JOIN (
  SELECT route_id, {by}, min(median_headway_minutes) AS median_headway_minutes, min(sample_intervals) AS sample_intervals FROM ({told}) GROUP BY ALL) h ON h.route_id = g.route_id AND h.{by} = g.{by}"""
ORACLES = {
    "first_last_service": _D + """SELECT route_id, service_day, CASE WHEN count(*) <= 10000 THEN min(clock) END AS first_departure, CASE WHEN count(*) <= 10000 THEN max(clock) END AS last_departure,
CASE WHEN count(*) > 10000 THEN 'unavailable' ELSE 'ok' END AS status, string_agg(DISTINCT CAST(direction_id AS VARCHAR), ',' ORDER BY CAST(direction_id AS VARCHAR)) AS directions FROM running GROUP BY ALL""",
    "scheduled_departures": _D + """SELECT route_id, service_day, CAST(rank AS INT) AS rank, clock, trip_id FROM (
  SELECT *, row_number() OVER (PARTITION BY route_id, service_day ORDER BY clock, event_id) AS rank FROM d WHERE clock >= '08:00:00') WHERE rank <= 5""",
    "calendar_active_departures": _D + "SELECT route_id, CAST(isodow(service_day) - 1 AS INT) AS weekday, count(*) AS departures FROM running GROUP BY ALL",
    "preflight_mode_schedule": _D + "SELECT DISTINCT route_id, CASE WHEN route_id IN (SELECT route_id FROM running) THEN 'ok' ELSE 'published_mode_schedule_absent' END AS reason FROM d",
    "service_frequency": _D + _headways(_ALL + "service_day"),
    "frequency_windowed": _D + _headways(_ALL + "service_day", "minute >= 480 AND minute < 600"),
    "frequency_group_guard": _D + _TOLD.format(by="service_day", day="g.service_day", trip="CAST(NULL AS BIGINT)", told=_headways(_ALL + "service_day")) + " UNION ALL "
    + _TOLD.format(by="trip_id", day="CAST(NULL AS DATE)", trip="g.trip_id", told=_headways(_ALL + "trip_id")),
    "schedule_reaches_destination": _D + """SELECT event_id, trip_id, service_day, clock FROM d a WHERE route_id = 'view' AND EXISTS (
  SELECT 1 FROM d b WHERE b.route_id = 'purchase' AND b.trip_id = a.trip_id AND b.service_day = a.service_day AND b.clock > a.clock)""",
    "relative_days": _D + """SELECT w.word, w.day, count(d.event_id) AS departures FROM (VALUES ('today', DATE '2024-01-10'), ('aaj', DATE '2024-01-10'), ('tomorrow', DATE '2024-01-11'),
  ('yesterday', DATE '2024-01-09'), ('parso', NULL)) w(word, day) LEFT JOIN d ON d.service_day = w.day GROUP BY ALL""",
    "recent_distinct": """SELECT user_id, event_type, CAST(rank AS INT) AS rank FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS rank
FROM events GROUP BY user_id, event_type) WHERE rank <= 5""",
}
