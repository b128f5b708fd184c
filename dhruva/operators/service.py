"""Operations on published routes as sets: every request of a table is answered at once, and never from missing data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dhruva.operators.topology import coverage, direct_routes, route_key
from dhruva.schema import Network

# Operations that nothing in the tables can answer, with their reason (fixed values).
REFUSED = {
    "GET_TICKETING_POLICY": "ticket_policy_absent",
    "GET_STATION_FACILITY": "facility_verification_absent",
    "PLAN_MULTIMODAL_ROUTE": "confirmed_multimodal_graph_absent",
    "REJECT_UNSUPPORTED_REALTIME": "realtime_status_unsupported",
    "REJECT_OUT_OF_SCOPE": "out_of_scope",
}
# Slots that a published sequence cannot honour (fixed values).
TEMPORAL = {"PLAN_ROUTE": ("date", "time", "temporal_relative", "timing_type"), "CHECK_SERVICE_AVAILABILITY": ("date", "temporal_relative", "time")}
PREFERENCES = ("fastest", "cheapest", "least_transfers")


def refusal(operation: Column, slots: Column, interchanges: Column, accessibility: Column) -> Column:
    """Why an operation with these slots (a map) cannot be answered whatever else is asked; null if it may be.

    ``interchanges`` and ``accessibility`` say whether there is any record of the kind.
    """
    out = F.lit(None).cast("string")
    has = lambda s: F.coalesce(F.try_element_at(slots, F.lit(s)) != "", F.lit(False))
    for op, reason in REFUSED.items():
        out = F.when(operation == op, reason).otherwise(out)
    out = F.when((operation == "GET_INTERCHANGE_DETAILS") & ~interchanges, "confirmed_interchanges_absent").otherwise(out)
    out = F.when((operation == "GET_ACCESSIBILITY_INFO") & ~accessibility, "accessibility_values_absent").otherwise(out)
    out = F.when((operation == "PLAN_ROUTE") & F.coalesce(F.try_element_at(slots, F.lit("preference")).isin(*PREFERENCES), F.lit(False)), "route_preference_unsupported").otherwise(out)
    for op, names in TEMPORAL.items():
        reason = "route_temporal_scope_unsupported" if op == "PLAN_ROUTE" else "availability_temporal_scope_unsupported"
        asked = F.lit(False)
        for n in names:
            asked = asked | has(n)
        out = F.when((operation == op) & asked, reason).otherwise(out)
    return out


def plan(net: Network, requests: DataFrame) -> DataFrame:
    """Direct services of ``requests(origin, destination[, mode, code])``; a null mode or code asks for any."""
    found = direct_routes(net, requests)
    for column, value in (("asked_mode", F.col("mode")), ("asked_code", route_key("route_short_name"))):
        if column in requests.columns:
            want = F.col(column) if column == "asked_mode" else route_key(column)
            found = found.where(F.col(column).isNull() | (want == value))
    return found


def availability(net: Network, requests: DataFrame) -> DataFrame:
    """Is a connection recorded for each request? It never says that there is none."""
    asked = requests.select("origin", "destination").distinct()
    found = direct_routes(net, asked).groupBy("origin", "destination").agg(F.count_distinct("route_id").alias("routes"), F.bool_or("partial_topology").alias("partial"))
    rows = asked.join(found, ["origin", "destination"], "left")
    return rows.select("origin", "destination", F.when(F.col("routes") > 0, "recorded").otherwise("unavailable").alias("status"), F.coalesce("routes", F.lit(0)).alias("routes"), F.coalesce("partial", F.lit(False)).alias("partial"))


def route_report(net: Network) -> DataFrame:
    """Per route code: sequences of two stops or more, links left out, routes without a sequence, and whether more than ten exist."""
    named = net.routes.where("status = 'operational'").select("route_id", route_key("route_short_name").alias("code")).where("code != ''")
    per_direction = net.usable.groupBy("route_id", "direction_id").agg(F.count("*").alias("n")).where("n >= 2").groupBy("route_id").agg(F.count("*").alias("sequences"))
    rows = named.join(coverage(net), "route_id").join(per_direction, "route_id", "left")
    per = rows.groupBy("code").agg(
        F.sum(F.coalesce("sequences", F.lit(0))).alias("sequences"), F.sum(F.col("total_links") - F.col("usable_links")).alias("excluded_unusable_rows"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("usable_links") < 2, F.col("route_id")))), ",").alias("uncovered_route_ids"),
    )
    partial = (F.col("excluded_unusable_rows") > 0) | (F.col("uncovered_route_ids") != "")
    return per.select("code", F.when(F.col("sequences") > 0, "ok").otherwise("unavailable").alias("status"), "sequences", (F.col("sequences") > 10).alias("truncated"), "excluded_unusable_rows", "uncovered_route_ids", partial.alias("partial_topology"))


def first_sequences(net: Network, limit: int = 10) -> DataFrame:
    """The first sequences of each route code by route and direction."""
    named = net.routes.where("status = 'operational'").select("route_id", route_key("route_short_name").alias("code")).where("code != ''")
    ordered = F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id")))
    seqs = net.usable.groupBy("route_id", "direction_id").agg(ordered.alias("s")).where("size(s) >= 2").join(named, "route_id")
    ranked = seqs.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("route_id", "direction_id"))).where(F.col("rank") <= limit)
    return ranked.select("code", "rank", "route_id", "direction_id", F.array_join(F.transform("s", lambda x: x["stop_id"]), ">").alias("stops"))


def published_options(net: Network, names: DataFrame, requests: DataFrame, pairs: int = 64, limit: int = 10) -> DataFrame:
    """Options between all stops of two names: ``requests(from_name, to_name)``, ``names(name, stop_id, mode)``.

    Stops of equal mode are paired by id, at most ``pairs`` of them; services of these are ordered by route name and
    ends and the first ``limit`` shown. ``truncated``: there are more pairs or more services. Only the first ``pairs`` stops of a
    name and mode can stand in the first pairs, so a name of very many stops makes no product.
    """
    some = names.withColumn("n", F.row_number().over(Window.partitionBy("name", "mode").orderBy("stop_id"))).where(F.col("n") <= pairs).drop("n")
    counts = names.groupBy("name", "mode").agg(F.count("*").alias("n"))
    end = lambda df, side, key: df.withColumnsRenamed({"name": side, key: f"{key}_{side}"})
    both = requests.join(end(counts, "from_name", "n"), "from_name").join(end(counts, "to_name", "n"), ["to_name", "mode"])
    total = both.groupBy("from_name", "to_name").agg(F.sum(F.col("n_from_name") * F.col("n_to_name")).alias("total"))
    made = requests.join(end(some, "from_name", "stop_id"), "from_name").join(end(some, "to_name", "stop_id"), ["to_name", "mode"])
    made = made.select("from_name", "to_name", F.col("stop_id_from_name").alias("origin"), F.col("stop_id_to_name").alias("destination"))
    first = made.withColumn("n", F.row_number().over(Window.partitionBy("from_name", "to_name").orderBy("origin", "destination"))).where(F.col("n") <= pairs).drop("n")
    found = direct_routes(net, first.where("origin != destination")).select("from_name", "to_name", "route_short_name", "origin", "destination", "route_id", "direction_id").distinct()
    by = ["from_name", "to_name"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("route_short_name").asc_nulls_first(), "origin", "destination", "route_id", "direction_id"))).where(F.col("rank") <= limit + 1)
    more = F.max("rank").over(Window.partitionBy(*by)) > limit
    out = ranked.withColumn("more", more).where(F.col("rank") <= limit).join(total, by)
    return out.select(*by, "rank", "route_id", "direction_id", "origin", "destination", (F.col("more") | (F.col("total") > pairs)).alias("truncated"))
