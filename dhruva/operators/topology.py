"""Questions about which routes connect which stops. Missing topology is reported, never read as absence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.operators.bitmaps import Bitmap, flat
from dhruva.schema import Network
from dhruva.session import materialise

#: Pairs of stops of one route that are held against the bitmap at a time.
AT_ONCE = 1 << 18


def coverage(net: Network) -> DataFrame:
    """Links and usable links of each operational route; a route is partial if they differ."""
    routes = net.routes.where("status = 'operational'").select("route_id", "mode")
    stops = net.stops.select("stop_id", "mode", F.lit(1).alias("there"))
    rows = routes.join(net.links.select("route_id", "stop_id"), "route_id", "left").join(stops, ["stop_id", "mode"], "left")
    counts = rows.groupBy("route_id").agg(F.count("stop_id").alias("total_links"), F.count("there").alias("usable_links"))
    return counts.withColumn("partial_topology", F.col("total_links") != F.col("usable_links"))


def terminal_requests(net: Network) -> DataFrame:
    """Origin, a stop half way and destination of each direction of each route: the journeys that are asked for."""
    ordered = F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id")))
    rows = net.usable.groupBy("route_id", "direction_id").agg(ordered.alias("s")).where("size(s) >= 3")
    at = lambda e: F.expr(f"element_at(s, {e}).stop_id")
    return rows.select(at("1").alias("origin"), at("cast((size(s) + 1) div 2 as int)").alias("via"), at("-1").alias("destination")).where("origin != destination").distinct()


def direct_routes(net: Network, requests: DataFrame, via: bool = False) -> DataFrame:
    """Direct services of each request: same route and direction, destination later than origin, ``via`` strictly between."""
    u = net.usable.select("route_id", "direction_id", "stop_sequence", "stop_id")
    start = u.select("route_id", "direction_id", F.col("stop_id").alias("origin"), F.col("stop_sequence").alias("origin_sequence"))
    end = u.select("route_id", "direction_id", F.col("stop_id").alias("destination"), F.col("stop_sequence").alias("destination_sequence"))
    found = requests.join(start, "origin").join(end, ["destination", "route_id", "direction_id"]).where("destination_sequence > origin_sequence")
    if via:
        mid = u.select(F.col("route_id").alias("r"), F.col("direction_id").alias("d"), F.col("stop_id").alias("v"), F.col("stop_sequence").alias("q"))
        between = (F.col("route_id") == F.col("r")) & (F.col("direction_id") == F.col("d")) & (F.col("via") == F.col("v"))
        found = found.join(mid, between & F.expr("q > origin_sequence and q < destination_sequence"), "left_semi")
    info = net.routes.select("route_id", "route_short_name", "mode", "source_id").join(coverage(net).select("route_id", "partial_topology"), "route_id")
    return found.join(info, "route_id")


def first_options(found: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` shortest options of each journey and whether more exist."""
    by = ["origin", "destination"]
    order = [F.col("destination_sequence") - F.col("origin_sequence"), "route_id", "direction_id", "origin_sequence"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit + 1)
    more = F.max("rank").over(Window.partitionBy(*by)) > limit
    return ranked.withColumn("truncated", more).where(F.col("rank") <= limit)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two."""
    out = a.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + b.view(np.uint64)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


@F.arrow_udf(T.LongType())
def _both(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(_pair(a.to_numpy(), b.to_numpy()))


def _journeys(known: Bitmap, most: int):
    """Of the stops of each direction, in order, those pairs whose names may be asked for, as place of the first * 2^31 + place of the second.

    Of two names the ``most`` shortest journeys. The bitmap holds pairs of names, and with 1 and 2 the names of origins and destinations.
    """

    def run(hashes: pa.Array, names: pa.Array, stops: pa.Array, sequences: pa.Array) -> pa.Array:
        h, ends = flat(hashes)
        name, stop = (c.flatten().dictionary_encode().indices.to_numpy() for c in (names, stops))
        at = flat(sequences)[0].astype(np.int64)
        first, second = np.flatnonzero(known.has(h, 1)), np.flatnonzero(known.has(h, 2))
        low = np.searchsorted(second, first, "right")
        total = np.concatenate([[0], np.cumsum(np.searchsorted(second, ends[np.searchsorted(ends, first, "right")]) - low)])

        def least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            row = np.searchsorted(ends, a, "right")
            order = np.lexsort((at[a], at[b] - at[a], name[b], name[a], row))
            a, b, row = a[order], b[order], row[order]
            new = np.ones(len(a), bool)
            new[1:] = (row[1:] != row[:-1]) | (name[a[1:]] != name[a[:-1]]) | (name[b[1:]] != name[b[:-1]])
            place = np.arange(len(a))
            keep = place - np.maximum.accumulate(np.where(new, place, 0)) < most
            return a[keep], b[keep]

        kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        begin, held = 0, 0
        while begin < len(first):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + AT_ONCE, "right")) - 1)
            n = np.diff(total[begin : end + 1])
            a = np.repeat(first[begin:end], n)
            b = second[np.arange(len(a)) + np.repeat(low[begin:end] - (total[begin:end] - total[begin]), n)]
            ok = known.has(_pair(h[a], h[b])) & (stop[a] != stop[b])
            kept[0].append(a[ok]), kept[1].append(b[ok])
            held += int(ok.sum())
            if held > AT_ONCE:
                kept = tuple([x] for x in least(*map(np.concatenate, kept)))
                held = 0
            begin = end
        a, b = least(*map(np.concatenate, kept))
        row = np.searchsorted(ends, a, "right")
        cuts, base = np.searchsorted(row, np.arange(len(ends)), "right"), ends[row - 1]
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array((a - base) << 31 | (b - base), pa.int64()))

    return F.arrow_udf(run, T.ArrayType(T.LongType()))


def options_between_names(net: Network, limit: int) -> DataFrame:
    """The ``limit`` shortest journeys of one route and direction between stops with the names of its ends, for all directions of three stops or more.

    Names compare without case and outer blanks; blank ones are none. ``(origin, destination, route_id, direction_id,
    origin_sequence, destination_sequence, rank, truncated)``: ends by name. Pairs of stops are made within a direction
    only, whose stops stand in one row, and those that are not asked for go there: no product of the stops of two names.
    """
    name = F.lower(F.trim("canonical_name"))
    stop = F.struct("stop_sequence", "stop_id", F.when(name != "", name).alias("name"))
    rows = materialise(net.usable.groupBy("route_id", "direction_id").agg(F.array_sort(F.collect_list(stop)).alias("s")), "sequences")
    a, b = F.element_at("s", 1), F.element_at("s", -1)
    asked = rows.where(F.size("s") >= 3).where(a["stop_id"] != b["stop_id"]).select(a["name"].alias("origin"), b["name"].alias("destination"))
    asked = materialise(asked.where("origin is not null and destination is not null").distinct(), "asked")
    of = lambda c: F.xxhash64(c)
    ends = [asked.select(of(c)).distinct().select("*", F.lit(n)) for n, c in ((1, "origin"), (2, "destination"))]
    known = Bitmap(asked.select(_both(of("origin"), of("destination")).alias("h"), F.lit(0).alias("n")).union(ends[0]).union(ends[1]), 3 * asked.count())
    named = rows.select("route_id", "direction_id", F.filter("s", lambda x: x["name"].isNotNull()).alias("s")).where("size(s) > 1")
    found = named.withColumn("at", _journeys(known, limit + 1)(F.transform("s", lambda x: of(x["name"])), F.col("s.name"), F.col("s.stop_id"), F.col("s.stop_sequence")))
    x, y = "get(s, cast(shiftright(c, 31) as int))", "get(s, cast(c & 2147483647 as int))"
    both = f"named_struct('origin', {x}.name, 'destination', {y}.name, 'origin_sequence', {x}.stop_sequence, 'destination_sequence', {y}.stop_sequence)"
    found = found.where("size(at) > 0").select("route_id", "direction_id", F.explode(F.expr(f"transform(at, c -> {both})")).alias("j")).select("route_id", "direction_id", "j.*")
    return first_options(found, limit).join(asked, ["origin", "destination"], "left_semi")


def stop_sequences(net: Network) -> DataFrame:
    """Ordered stops of each route and direction with at least two usable ones."""
    ordered = F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id")))
    rows = net.usable.groupBy("route_id", "direction_id").agg(ordered.alias("s")).where("size(s) >= 2")
    return rows.select("route_id", "direction_id", F.size("s").alias("n_stops"), F.array_join(F.transform("s", lambda x: x["stop_id"]), ">").alias("stops"))


def route_key(c: str) -> Column:
    """Route codes compare without case, blanks and hyphens."""
    return F.upper(F.regexp_replace(c, "[ -]", ""))


def membership(net: Network, asked: DataFrame) -> DataFrame:
    """Is stop ``stop_id`` on a route with code ``code``? yes, no (only if all its routes are complete) or unavailable."""
    named = net.routes.where("status = 'operational'").select("route_id", route_key("route_short_name").alias("code")).where("code != ''")
    usable = net.usable.select("route_id", "stop_id").distinct()
    per_code = named.join(coverage(net), "route_id", "left").groupBy("code").agg(
        F.max(F.coalesce(F.col("partial_topology") | (F.col("total_links") == 0), F.lit(True))).alias("partial"), F.count("*").alias("routes")
    )
    hit = usable.join(named, "route_id").groupBy("code", "stop_id").agg(F.count_distinct("route_id").alias("matched"))
    rows = asked.join(per_code, "code").join(hit, ["code", "stop_id"], "left")
    answer = F.when(F.col("matched") > 0, "yes").when(F.col("partial"), "unavailable").otherwise("no")
    return rows.select("code", "stop_id", "routes", F.coalesce("matched", F.lit(0)).alias("matched"), answer.alias("on_route"))
