"""Timetable operators on service-day clock text (HH:MM:SS, may pass 24:00:00).

Events stand for departures: the user is the trip, the event type the route, the clock is text and is compared as text.
Direction and stop of a departure are projected from its number and trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: A service with more departures than this is refused rather than cut.
MOST_DEPARTURES = 10_000


def departures(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("user_id").alias("trip_id"), F.col("event_type").alias("route_id"), F.to_date("ts").alias("service_day"), F.date_format("ts", "HH:mm:ss").alias("clock"),
        (F.col("event_id") % 2).cast("int").alias("direction_id"), F.concat(F.lit("STOP_"), (F.col("user_id") % 3).cast("string")).alias("stop_id"),
    )


def minutes(clock: Column | str) -> Column:
    """Minutes of a clock text; half a minute and more counts as one."""
    parts = F.split(clock, ":")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    return part(1) * 60 + part(2) + F.when(F.coalesce(part(3), F.lit(0)) >= 30, 1).otherwise(0)


def calendars(spark: SparkSession) -> DataFrame:
    """Service calendars of the projection: two all week, one on working days, one at weekends, one that has ended."""
    rows = [
        ("view", "20240101", "20251231", *([1] * 7)), ("click", "20240101", "20251231", 1, 1, 1, 1, 1, 0, 0), ("purchase", "20240101", "20251231", 0, 0, 0, 0, 0, 1, 1),
        ("signup", "20240115", "20240131", *([1] * 7)), ("error", "20230101", "20231231", *([1] * 7)),
    ]
    return spark.createDataFrame(rows, "service_id string, start_date string, end_date string, " + ", ".join(f"{d} int" for d in WEEKDAYS))


def active_days(calendar: DataFrame) -> DataFrame:
    """One row per service and weekday (Monday = 0) it runs on."""
    pairs = ", ".join(f"{i}, {d}" for i, d in enumerate(WEEKDAYS))
    rows = calendar.selectExpr("service_id", "start_date", "end_date", f"stack(7, {pairs}) as (weekday, runs)").where("runs = 1")
    return rows.select("service_id", F.to_date("start_date", "yyyyMMdd").alias("first_day"), F.to_date("end_date", "yyyyMMdd").alias("last_day"), "weekday")


def running(deps: DataFrame, calendar: DataFrame) -> DataFrame:
    """Departures whose service runs on their day: a semi join on service and weekday within the calendar's dates."""
    on = (F.col("route_id") == F.col("service_id")) & (F.weekday("service_day") == F.col("weekday")) & F.col("service_day").between(F.col("first_day"), F.col("last_day"))
    return deps.join(active_days(calendar), on, "left_semi")


def first_last(deps: DataFrame, by: list[str]) -> DataFrame:
    """Bounds of the scheduled rows; refused (null, status unavailable) beyond MOST_DEPARTURES."""
    many = F.count("*") > MOST_DEPARTURES
    return deps.groupBy(*by).agg(
        F.when(~many, F.min("clock")).alias("first_departure"), F.when(~many, F.max("clock")).alias("last_departure"), F.when(many, "unavailable").otherwise("ok").alias("status"),
        F.array_join(F.array_sort(F.collect_set(F.col("direction_id").cast("string"))), ",").alias("directions"),
    )


def next_departures(deps: DataFrame, by: list[str], since: str, k: int = 5) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("clock", "event_id")
    return deps.where(F.col("clock") >= since).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: What a headway is told for: departures of one route in one direction at one stop.
GROUP = ("route_id", "direction_id", "stop_id")
AMBIGUOUS = "frequency_direction_or_stop_ambiguous"


def headways(deps: DataFrame, by: list[str], since: str | None = None, most: int = 180, window: int = 120) -> DataFrame:
    """Median of the gaps of at most ``most`` minutes between consecutive departures, told apart by the minute.

    ``since``: only departures in the ``window`` minutes from that clock, by rounded minutes. A group is the set of its
    minutes, which grows with the length of a service day and not with its rows, so no group is sorted in one task.
    Groups without a gap have no row.
    """
    rows = deps.select(*by, minutes("clock").alias("minute")).where("minute is not null")
    if since:
        h, m, s = map(int, since.split(":"))
        start = h * 60 + m + (s >= 30)
        rows = rows.where((F.col("minute") >= start) & (F.col("minute") < start + window))
    times = rows.groupBy(*by).agg(F.array_sort(F.collect_set("minute")).alias("t"))
    steps = F.expr("case when size(t) > 1 then zip_with(slice(t, 2, size(t) - 1), slice(t, 1, size(t) - 1), (b, a) -> b - a) else cast(array() as array<int>) end")
    gaps = times.select(*by, F.array_sort(F.filter(steps, lambda g: g <= most)).alias("g")).where("size(g) > 0")
    middle = F.expr("(g[(size(g) - 1) div 2] + g[size(g) div 2]) / 2.0D")
    return gaps.select(*by, middle.cast("double").alias("median_headway_minutes"), F.size("g").cast("long").alias("sample_intervals"))


def frequency(deps: DataFrame, asked: list[str], since: str | None = None) -> DataFrame:
    """A headway for each value of ``asked`` columns, told only if all its departures are of one route, direction and stop.

    ``status``: ok, the reason that it is ambiguous, or too_few_departures.
    """
    groups = [c for c in GROUP if c not in asked]
    each = deps.groupBy(*asked).agg(F.count_distinct(F.struct(*GROUP)).alias("groups"))
    told = headways(deps, [*asked, *groups], since).groupBy(*asked).agg(F.min("median_headway_minutes").alias("median_headway_minutes"), F.min("sample_intervals").alias("sample_intervals"))
    a, b = each.alias("a"), told.alias("b")
    same = None
    for c in asked:
        cond = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = cond if same is None else same & cond
    one = F.col("groups") == 1
    status = F.when(~one, AMBIGUOUS).when(F.col("sample_intervals").isNull(), "too_few_departures").otherwise("ok")
    return a.join(b, same, "left").select(*(f"a.{c}" for c in asked), status.alias("status"), F.when(one, F.col("median_headway_minutes")).alias("median_headway_minutes"), F.when(one, F.col("sample_intervals")).alias("sample_intervals"))


def reaches(deps: DataFrame, destination: str) -> DataFrame:
    """Departures after which the same trip calls at ``destination`` on the same day."""
    end = deps.where(F.col("route_id") == destination).select(F.col("trip_id").alias("t"), F.col("service_day").alias("d"), F.col("clock").alias("c"))
    return deps.join(end, (F.col("trip_id") == F.col("t")) & (F.col("service_day") == F.col("d")) & (F.col("c") > F.col("clock")), "left_semi")


def relative_day(word: Column | str, today: Column) -> Column:
    """The day a word means, counted from a given today; other words mean none."""
    w = F.lower(F.trim(F.col(word) if isinstance(word, str) else word))
    offset = F.when(w.isin("today", "aaj", "आज"), 0).when(w == "tomorrow", 1).when(w == "yesterday", -1)
    return F.date_add(today, offset)
