"""Schemas of the canonical tables and their current state in the delivered history.

The delivered tables hold one row per lifetime and per load. Operators work on the current state: the latest lifetime
of each route and stop, the latest load of each (route, direction, sequence). `SQL` is the same as CTEs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.session import materialise


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _L, _D, _N = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()
TABLES = {
    "transport_stops": _schema(("stop_id", _S), ("canonical_name", _S), ("mode", _S), ("latitude", _D), ("longitude", _D), ("inside_cma", _I), ("primary_source_id", _S), ("first_seen", _N), ("deleted_at", _N)),
    "transport_routes": _schema(("route_id", _S), ("route_short_name", _S), ("mode", _S), ("source_id", _S), ("status", _S), ("first_seen", _N), ("deleted_at", _N)),
    "route_stops": _schema(("link_id", _L), ("route_id", _S), ("direction_id", _I), ("stop_sequence", _I), ("canonical_stop_id", _S), ("snapshot_date", T.DateType()), ("loaded_at", _N)),
    "transport_hubs": _schema(("hub_id", _S), ("hub_name", _S), ("latitude", _D), ("longitude", _D)),
}
# A lifetime may be delivered again with other values; these columns, least first and null last, then decide.
_TIES = ("deleted_at", "inside_cma", "latitude", "longitude", "canonical_name", "mode", "primary_source_id")
MODES = ("bus", "metro", "suburban_rail", "mrts")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rank(field: T.StructField, descending: bool) -> list[Column]:
    """Parts of an order by which a smaller struct is an earlier row, nulls last."""
    c = F.col(field.name)
    if descending:
        kind = field.dataType
        c = F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) else c
        c = -c
    return [F.col(field.name).isNull().alias(f"{field.name}_null"), c.alias(field.name)]


def latest(df: DataFrame, keys: list[str], newest: list[str], then: list[str] | tuple[str, ...] = (), keep: list[str] | None = None) -> DataFrame:
    """The row of each key with the greatest ``newest`` values (dates, times, numbers), ties by the least ``then``; nulls last in both.

    An aggregate, not a window: each task keeps one row per key before anything is shuffled. ``keep``: columns that are
    returned besides the keys, all without it; others are not carried along.
    """
    order = F.struct(*(x for c in newest for x in _rank(df.schema[c], True)), *(x for c in then for x in _rank(df.schema[c], False)))
    rest = [c for c in keep or df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, "__row.*").select(*(c for c in df.columns if c in keys or c in rest))


@dataclass(frozen=True)
class Network:
    routes: DataFrame
    stops: DataFrame
    links: DataFrame
    hubs: DataFrame

    @cached_property
    def usable(self) -> DataFrame:
        """Links of operational routes whose stop has the route's mode: the only ones a topology may rest on; written once."""
        r = self.routes.where("status = 'operational'").select("route_id", "route_short_name", "mode", "source_id")
        s = self.stops.select("stop_id", "canonical_name", "mode")
        return materialise(self.links.join(r, "route_id").join(s, ["stop_id", "mode"]), "usable")


def network(spark: SparkSession, sf: str) -> Network:
    routes = latest(table(spark, sf, "transport_routes"), ["route_id"], ["first_seen"], ["deleted_at", "route_short_name", "mode", "source_id", "status"])
    routes = routes.select("route_id", "route_short_name", "mode", "source_id", F.lower(F.trim("status")).alias("status"))
    stops = latest(table(spark, sf, "transport_stops"), ["stop_id"], ["first_seen"], _TIES, keep=["canonical_name", "mode", "latitude", "longitude", "inside_cma", "primary_source_id"])
    stops = stops.select("stop_id", "canonical_name", "mode", "latitude", "longitude", "inside_cma", "primary_source_id")
    key = lambda c: F.upper(F.trim(c))
    links = table(spark, sf, "route_stops").select(
        "link_id", key("route_id").alias("route_id"), "direction_id", "stop_sequence", key("canonical_stop_id").alias("stop_id"), "snapshot_date", "loaded_at"
    )
    links = links.where("route_id != '' and stop_id != '' and direction_id is not null and stop_sequence is not null")
    links = latest(links, ["route_id", "direction_id", "stop_sequence"], ["snapshot_date", "loaded_at", "link_id"], keep=["stop_id"])
    return Network(routes, stops, links.select("route_id", "direction_id", "stop_sequence", "stop_id"), table(spark, sf, "transport_hubs"))


SQL = """WITH routes AS (
  SELECT route_id, route_short_name, mode, source_id, lower(trim(status)) AS status FROM (
    SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY first_seen DESC, deleted_at ASC NULLS LAST, route_short_name ASC NULLS LAST, mode ASC NULLS LAST,
      source_id ASC NULLS LAST, status ASC NULLS LAST) AS rn FROM transport_routes) WHERE rn = 1),
stops AS (
  SELECT stop_id, canonical_name, mode, latitude, longitude, inside_cma, primary_source_id FROM (
    SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY first_seen DESC, deleted_at ASC NULLS LAST, inside_cma ASC NULLS LAST, latitude ASC NULLS LAST,
      longitude ASC NULLS LAST, canonical_name ASC NULLS LAST, mode ASC NULLS LAST, primary_source_id ASC NULLS LAST) AS rn FROM transport_stops) WHERE rn = 1),
links AS (
  SELECT route_id, direction_id, stop_sequence, stop_id FROM (
    SELECT *, row_number() OVER (PARTITION BY route_id, direction_id, stop_sequence ORDER BY snapshot_date DESC, loaded_at DESC, link_id DESC) AS rn FROM (
      SELECT link_id, upper(trim(route_id)) AS route_id, direction_id, stop_sequence, upper(trim(canonical_stop_id)) AS stop_id, snapshot_date, loaded_at FROM route_stops)
    WHERE route_id <> '' AND stop_id <> '' AND direction_id IS NOT NULL AND stop_sequence IS NOT NULL) WHERE rn = 1),
usable AS (
  SELECT l.*, r.route_short_name, r.mode, r.source_id, s.canonical_name FROM links l JOIN routes r ON r.route_id = l.route_id AND r.status = 'operational'
  JOIN stops s ON s.stop_id = l.stop_id AND s.mode = r.mode),
coverage AS (
  SELECT r.route_id, count(l.stop_id) AS total_links, count(s.stop_id) AS usable_links FROM routes r LEFT JOIN links l ON l.route_id = r.route_id
  LEFT JOIN stops s ON s.stop_id = l.stop_id AND s.mode = r.mode WHERE r.status = 'operational' GROUP BY r.route_id)
"""
