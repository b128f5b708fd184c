"""Names in texts: alias index, collisions, longest non-overlapping spans, resolution.

An ambiguous name keeps all its candidates. Everything is a join on normalised names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.functions.text import normalised, qualifier
from dhruva.operators.bitmaps import Bitmap, flat
from dhruva.session import materialise, small_batches, spread

#: Qualifiers that may follow a stop's name, by mode (fixed values).
QUALIFIERS = {
    "metro": ("metro station", "मेट्रो स्टेशन"),
    "bus": ("bus stop", "बस स्टॉप"),
    "suburban_rail": ("suburban railway station", "railway station", "उपनगरीय रेल स्टेशन", "रेलवे स्टेशन"),
    "mrts": ("mrts station", "एमआरटीएस स्टेशन"),
}
#: Names that are no places (fixed values).
GENERIC = ("bus stop", "metro station", "railway station", "station", "stop", "bus terminus", "मेट्रो स्टेशन", "रेलवे स्टेशन", "बस स्टॉप")
#: The city itself as a qualifier adds nothing to a name (fixed values).
CITY = ("chennai", "chennai city")
#: Rows of names up to which they are sent to every executor; more are shuffled, with the same result.
BROADCAST_NAMES = 20_000
JOURNEY = ("origin", "destination", "via")
JOURNEY_OPERATIONS = ("point_to_point_route", "multimodal_route", "mode_availability")
#: Words that make a stop's name a thing one can stand at (fixed values).
PHYSICAL = "station|stop|terminus|terminal|depot|metro|railway|mrts|स्टेशन|स्टॉप|मेट्रो|एमआरटीएस"


def compact(name: Column | str) -> Column:
    """Names that differ by blanks only are one name."""
    return F.replace(F.col(name) if isinstance(name, str) else name, F.lit(" "), F.lit(""))


def alias_index(stops: DataFrame, hubs: DataFrame, aliases: DataFrame, places: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """``(name, entity_id, kind, mode, partial)``: every name with every entity it may mean.

    ``aliases(canonical_name, alias)`` passes all candidates of the canonical name on to the alias. Stops are also
    known with their mode's qualifiers, all names also written in one word, and names that differ by blanks only share
    their candidates. ``places(place_id, name)``: of a name with a comma the part before it is ``partial`` - it needs
    its qualifier and means nothing alone - unless the qualifier is the city. Null and blank names are left out.
    ``asked(surface)``: rows of other names may be missing.
    """
    every, bare = _spelt(stops, hubs, aliases, places)
    if asked is not None:
        # Names that differ by blanks only are asked for together.
        keys = asked.select(F.xxhash64(compact("surface")).alias("h"), F.lit(0).alias("n"))
        every = every.where(Bitmap(keys, keys.count()).may_hold(F.xxhash64(compact("name"))))
    every = every.distinct()
    full = spacing_closure(materialise(every, "names")).withColumn("partial", F.lit(False))
    if bare is not None:
        half = spacing_closure(bare).withColumn("partial", F.lit(True))
        # A name that needs its qualifier needs it whatever else it may mean.
        full = full.join(half.select("name", F.lit(True).alias("half")).distinct(), "name", "left").withColumn("partial", F.coalesce("half", F.lit(False))).drop("half").union(half).distinct()
    return full.where(~F.col("name").isin(*GENERIC))


def _spelt(stops: DataFrame, hubs: DataFrame, aliases: DataFrame, places: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """``(name, entity_id, kind, mode)``: names as they are written, some of them again and again; the same of names that need their qualifier."""
    none = F.lit(None).cast("string").alias("mode")
    s = stops.select(normalised("canonical_name").alias("name"), F.col("stop_id").alias("entity_id"), F.lit("stop").alias("kind"), "mode")
    h = hubs.select(normalised("hub_name").alias("name"), F.col("hub_id").alias("entity_id"), F.lit("hub").alias("kind"), none)
    base = s.union(h)
    bare = None
    if places is not None:
        first, rest = qualifier("name")
        p = places.select("name", F.col("place_id").cast("string").alias("entity_id"), F.lit("place").alias("kind"), none, normalised(first).alias("first"), normalised(rest).alias("rest"))
        base = base.union(p.select(normalised("name").alias("name"), "entity_id", "kind", "mode")).union(p.where(F.col("rest").isin(*CITY)).select("first", "entity_id", "kind", "mode"))
        bare = p.where(F.col("rest").isNotNull() & ~F.col("rest").isin("", *CITY)).select(F.col("first").alias("name"), "entity_id", "kind", "mode").where("name != ''").distinct()
    base = materialise(base.where("name != ''").distinct(), "names")
    passed = base.join(aliases.select(normalised("canonical_name").alias("name"), normalised("alias").alias("alias")).distinct(), "name").select(F.col("alias").alias("name"), "entity_id", "kind", "mode")
    known = base.union(passed).where("name != ''")
    # Each row with the name as it is and in one word, from one pass; what repeats goes at the end.
    known = known.select(F.explode(F.array_distinct(F.array("name", compact("name")))).alias("name"), "entity_id", "kind", "mode")
    words = F.create_map(*(x for m, q in QUALIFIERS.items() for x in (F.lit(m), F.array(*map(F.lit, q)))))
    longer = F.transform(F.try_element_at(words, F.col("mode")), lambda q: F.concat_ws(" ", F.col("name"), q))
    # All names of a row together: itself and, of a stop, with its qualifiers.
    spelt = F.concat(F.array("name"), F.when(F.col("kind") == "stop", F.coalesce(longer, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    every = known.select(F.explode(spelt).alias("name"), "entity_id", "kind", "mode")
    return every, bare


def spacing_closure(index: DataFrame) -> DataFrame:
    """Each name, and each written in one word, with the candidates of every name that is spelled alike but for blanks."""
    groups = index.select(compact("name").alias("key"), "entity_id", "kind", "mode").distinct()
    listed = index.select("name", compact("name").alias("key"))
    return listed.union(listed.select("key", "key")).distinct().join(groups, "key").select("name", "entity_id", "kind", "mode")


def collisions(index: DataFrame) -> DataFrame:
    """Names that may mean several entities."""
    return index.groupBy("name").agg(F.count_distinct("entity_id").alias("candidates"), F.count_distinct("kind").alias("kinds"), F.min("entity_id").alias("least_id")).where("candidates > 1")


#: Texts that are sent to Python at a time.
TEXTS_AT_ONCE = 500
#: Words of texts that are held against the bitmap at a time.
AT_ONCE = 1 << 18


def _chain(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """One hash of the ``n`` hashes from each position."""
    h = h.view(np.uint64)
    out = h[at]
    for k in range(1, n):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + h[at + k]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


@F.arrow_udf(T.LongType())
def _whole(hashes: pa.Array) -> pa.Array:
    """The hash of each whole list."""
    h, ends = flat(hashes)
    size = np.diff(ends)
    out = np.zeros(len(size), np.int64)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        out[rows] = _chain(h, ends[rows], n)
    return pa.array(out)


def _runs(known: Bitmap, lengths: list[int], base: int):
    """From the hashes of a text's words the runs that may be names, as start * base + words."""

    def run(hashes: pa.Array) -> pa.Array:
        h, ends = flat(hashes)
        found, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(h), AT_ONCE):
            some = np.arange(low, min(len(h), low + AT_ONCE))
            left = ends[np.searchsorted(ends, some, "right")] - some
            for n in lengths:
                at = some[known.has(h[some], n) & (left >= n)]
                at = at[known.has(_chain(h, at, n))]
                found.append(at), sizes.append(np.full(len(at), n))
        at, n = np.concatenate(found), np.concatenate(sizes)
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
        cuts = np.searchsorted(at, ends)
        start = at - np.repeat(ends[:-1], np.diff(cuts))
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(start * base + n, pa.int64()))

    return F.arrow_udf(run, T.ArrayType(T.LongType()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _kept(starts: pa.Array, minus: pa.Array) -> pa.Array:
    """Of sorted hits the places of those that do not overlap one accepted before."""
    s, ends = flat(starts)
    until = (s - flat(minus)[0]).tolist()
    out, cuts = [], [0]
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
        after = 0
        for i, start in enumerate(s[low:high].tolist()):
            if start >= after:
                out.append(i)
                after = until[low + i]
        cuts.append(len(out))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(out, pa.int32()))


def name_spans(docs: DataFrame, id_col: str, text: str, names: DataFrame, around: bool = False) -> DataFrame:
    """Longest non-overlapping names from left to right: ``(id, start, words, surface)``, positions in words.

    ``around``: also ``before``, the word in front (null for none), and ``after``, the three words behind.

    A bitmap knows the first words of names together with the names' lengths in words, and whole names: only runs of
    words that pass both are carried to the list of names. A pass over the hits of a text, in order of position and then
    length, drops what overlaps an accepted one. Null texts have no names; a text's rows are taken together by id.
    """
    words = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))).select("id", F.split(normalised("t"), " ").alias("w")).where("w is not null")
    listed = materialise(names.select(F.col("name").alias("surface")).where("surface != ''").distinct(), "names")
    length = F.size(F.split("surface", " "))
    lengths, count = listed.agg(F.sort_array(F.collect_set(length)), F.count("*")).first()
    hashes = F.transform(F.split("surface", " "), lambda x: F.xxhash64(x))
    heads = listed.select(F.xxhash64(F.substring_index("surface", " ", 1)).alias("h"), length.alias("n"))
    known = Bitmap(heads.union(listed.select(_whole(hashes), F.lit(0))), 2 * count)
    if count <= BROADCAST_NAMES:
        listed = F.broadcast(listed)
    base = max(lengths, default=0) + 1
    starts = _runs(known, lengths, base)(F.transform("w", lambda x: F.xxhash64(x))).alias("at")
    start, n = f"cast(c div {base} as int)", f"cast(c % {base} as int)"
    # No slice: it would copy the whole text for each run.
    beside = f", 'before', get(w, {start} - 1), 'after', array_compact(array({', '.join(f'get(w, {start} + {n} + {k})' for k in range(3))}))" if around else ""
    run = f"named_struct('start', {start}, 'minus', -{n}, 'surface', array_join(transform(sequence(0, {n} - 1), k -> get(w, {start} + k)), ' '){beside})"
    runs = words.select("id", "w", starts).where("size(at) > 0").select("id", F.explode(F.expr(f"transform(at, c -> {run})")).alias("r")).select("id", "r.*")
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        runs = materialise(runs, "runs")
    hits = runs.join(listed, "surface", "left_semi")
    more = ["before", "after"] if around else []
    found = hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "minus", "surface", *more))).alias("h"))
    kept = found.withColumn("k", _kept(F.transform("h", lambda x: x["start"]), F.transform("h", lambda x: x["minus"])))
    one = kept.select("id", F.explode(F.expr("transform(k, i -> get(h, i))")).alias("s")).select("id", "s.*")
    return one.select("id", "start", (-F.col("minus")).alias("words"), "surface", *more)


#: Words that give a place its part in a journey (fixed values).
SOURCE_AFTER, SOURCE_BEFORE = ("से", "se"), ("from",)
TARGET_AFTER, TARGET_BEFORE = ("तक", "tak"), ("to",)
VIA_AFTER, VIA_BEFORE = ("होकर", "hokar", "via"), ("via",)
#: Words that may stand between a name and its marker (fixed values).
BETWEEN = ("station", "स्टेशन", "metro", "मेट्रो", "railway", "रेलवे", "stop", "स्टॉप")


def endpoints(spans: DataFrame) -> DataFrame:
    """Per text its ``(id, station, origin, destination, via, ambiguous)`` from ``name_spans(.., around=True)``.

    Equal names are one place however often they come, with all parts they are marked for. One place is a station, and
    an origin or destination if it is marked as such. Of two the one marked as source is the origin, else the first. With
    more, none is chosen. A place one goes through is no end.
    """
    after = F.filter("after", lambda w: ~w.isin(*BETWEEN))
    nxt, then = F.get(after, 0), F.get(after, 1)
    via = F.coalesce(F.col("before").isin(*VIA_BEFORE), F.lit(False)) | F.coalesce(nxt.isin(*VIA_AFTER), F.lit(False)) | F.coalesce(nxt.isin(*SOURCE_AFTER) & then.isin(*VIA_AFTER), F.lit(False))
    source = ~via & (F.coalesce(nxt.isin(*SOURCE_AFTER), F.lit(False)) | F.coalesce(F.col("before").isin(*SOURCE_BEFORE), F.lit(False)))
    target = ~via & (F.coalesce(nxt.isin(*TARGET_AFTER), F.lit(False)) | F.coalesce(F.col("before").isin(*TARGET_BEFORE), F.lit(False)))
    each = spans.select("id", "surface", "start", via.alias("v"), source.alias("s"), target.alias("t")).groupBy("id", "surface")
    each = each.agg(F.min("start").alias("at"), F.bool_and("v").alias("v"), F.bool_or("s").alias("s"), F.bool_or("t").alias("t"))
    per = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "surface", "s", "t", "v"))).alias("p"))
    per = per.select("id", F.filter("p", lambda x: ~x["v"]).alias("p"), F.filter("p", lambda x: x["v"]).alias("v"))
    per = per.withColumn("src", F.filter("p", lambda x: x["s"])).withColumn("n", F.size("p"))
    first, second = F.get("p", 0), F.get("p", 1)
    swap = (F.size("src") == 1) & (F.get("src", 0)["at"] == second["at"])
    origin = F.when((F.col("n") == 1) & first["s"], first["surface"]).when(F.col("n") == 2, F.when(swap, second["surface"]).otherwise(first["surface"]))
    destination = F.when((F.col("n") == 1) & first["t"], first["surface"]).when(F.col("n") == 2, F.when(swap, first["surface"]).otherwise(second["surface"]))
    return per.select(
        "id", F.when(F.col("n") == 1, first["surface"]).alias("station"), origin.alias("origin"), destination.alias("destination"),
        F.when(F.size("v") == 1, F.get("v", 0)["surface"]).alias("via"), ((F.col("n") > 2) | (F.size("v") > 1)).alias("ambiguous"),
    )


def resolve(spans: DataFrame, index: DataFrame, role: str | None = None, operation: str | None = None, mode: str | None = None, route: str | None = None, on_route: DataFrame | None = None) -> DataFrame:
    """Spans with the entity they mean; null if several remain or the name needs its qualifier.

    ``role``, ``operation``, ``mode`` and ``route`` name columns of ``spans(surface, ..)`` (without a role, a journey's origin
    is meant). A role decides which kinds count: landmarks and localities are places or, failing that, stops and hubs;
    stations and stops are stops. Then an asked mode prefers its stops, else places, else keeps all; without one
    journeys prefer hubs. A route (``on_route(route, entity_id)``) prefers its own stops. Each preference holds only where
    it leaves a candidate. ``(.., entity_id, candidates, ambiguous)``: candidates that remain.

    Distinct questions are ranked, not spans, by aggregates only: a name with very many candidates is no large group.
    """
    asked = [c for c in (role, operation, mode, route) if c]
    keys = list(dict.fromkeys(["surface", *asked]))
    of = lambda c: F.col(c) if c else F.lit(None).cast("string")
    what = F.coalesce(of(role), F.lit("origin"))
    questions = spans.select(*keys).distinct()
    rows = questions.join(index.select(F.col("name").alias("surface"), "entity_id", F.col("kind").alias("__kind"), F.col("mode").alias("__mode"), F.col("partial").alias("__partial")), "surface")
    kind, place = F.col("__kind"), what.isin("landmark", "locality")
    fits = F.when(place, F.when(kind == "place", 0).when(kind.isin("stop", "hub"), 1)).when(what.isin("station", "stop"), F.when(kind == "stop", 0)).otherwise(0)
    wanted = of(mode).isNotNull() & (of(mode) != "any") & ~place
    by_mode = F.when(wanted, F.when((kind == "stop") & (F.col("__mode") == of(mode)), 0).when(kind == "place", 1).otherwise(2))
    journey = what.isin(*JOURNEY) & F.coalesce(of(operation), F.lit(JOURNEY_OPERATIONS[0])).isin(*JOURNEY_OPERATIONS)
    by_mode = by_mode.when(journey, F.when(kind == "hub", 0).otherwise(1)).otherwise(0)
    there = F.lit(0)
    if route and on_route is not None:
        known = on_route.select(F.col("route").alias("__route"), F.col("entity_id").alias("__stop"), F.lit(True).alias("__on")).distinct()
        rows = rows.join(known, (F.col(route) == F.col("__route")) & (F.col("entity_id") == F.col("__stop")), "left")
        there = F.when(what.isin("station", "stop") & F.col("__on"), 0).otherwise(1)
    ranked = rows.select(*keys, "entity_id", "__kind", "__partial", F.struct(fits.alias("a"), by_mode.alias("b"), there.alias("c")).alias("rank"))
    # Names that need their qualifier keep all they may mean.
    ranked = ranked.withColumn("rank", F.when(F.col("__partial"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))).otherwise(F.col("rank"))).where("rank.a is not null")
    each = ranked.groupBy(*keys, "rank").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("one"), F.max("__kind").alias("kind"), F.bool_or("__partial").alias("partial"))
    best = each.groupBy(*keys).agg(F.min_by(F.struct("n", "one", "kind", "partial"), "rank").alias("b")).select(*keys, "b.*")
    # "Near X" needs a thing to stand at: a bare stop name is none.
    vague = (of(operation) == "nearest_transport") & place & (F.col("kind") == "stop") & ~F.col("surface").rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{PHYSICAL})(?![\p{{L}}\p{{N}}_])")
    open_ = F.col("partial") | (F.col("n") > 1) | F.coalesce(vague, F.lit(False))
    out = best.select(*keys, F.when(~open_, F.col("one")).alias("entity_id"), F.col("n").alias("candidates"), open_.alias("ambiguous"))
    same = None
    for k in keys:
        cond = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = cond if same is None else same & cond
    found = spans.alias("a").join(out.alias("b"), same, "left")
    return found.select(*(f"a.{c}" for c in spans.columns), "b.entity_id", F.coalesce("b.candidates", F.lit(0)).alias("candidates"), F.coalesce("b.ambiguous", F.lit(False)).alias("ambiguous"))


def grouped(stops: DataFrame) -> DataFrame:
    """``stops(canonical_name, mode, ..)`` with ``group``, one text for stops of one name and mode; null without a name.

    An index of groups in place of stops has the same names: they follow from a stop's name and mode alone.
    """
    mode = F.coalesce("mode", F.lit(""))
    return stops.withColumn("group", F.when(F.trim("canonical_name") != "", F.concat(F.length(mode), F.lit(" "), mode, "canonical_name")))


def name_classes(groups: DataFrame, hubs: DataFrame, aliases: DataFrame, places: DataFrame) -> DataFrame:
    """``(class, names, groups)``: names of stops that need no qualifier, those that differ by blanks only together, with the groups they mean.

    What ``alias_index`` has of stops, in one row for a class. ``groups``: in place of its stops, with the group as ``stop_id`` (``grouped``).
    """
    every, bare = _spelt(groups, hubs, aliases, places)
    stop = F.when(F.col("kind") == "stop", F.col("entity_id"))
    classes = every.groupBy(compact("name").alias("key")).agg(F.collect_set("name").alias("names"), F.collect_set(stop).alias("groups")).where("size(groups) > 0")
    half = bare.groupBy(compact("name").alias("key")).agg(F.collect_set("name").alias("half"))
    partial = F.when(F.col("half").isNull(), F.array(*map(F.lit, GENERIC))).otherwise(F.concat("half", F.array("key", *map(F.lit, GENERIC))))
    names = F.array_except(F.array_union("names", F.array("key")), partial)
    rows = classes.join(half, "key", "left").select(names.alias("names"), "groups").where("size(names) > 0")
    return materialise(rows.withColumn("class", F.monotonically_increasing_id()), "classes")


def resolve_stops_on_route(classes: DataFrame, on: DataFrame) -> DataFrame:
    """What each name of a stop means together with each route that calls at a stop so named, as ``resolve`` with the role of a stop.

    ``classes``: as of ``name_classes``. ``on(group, route, stop_id)``: distinct stops of routes, each in one group.
    ``(surface, route, entity_id, candidates, ambiguous)``. Of a name that needs no qualifier the stops on the route come
    first, and there is one: no other candidate is looked at. Stops are counted for classes and routes; only then names
    are written out.
    """
    counted = on.repartition("group").groupBy("group", "route").agg(F.count("*").alias("n"), F.min("stop_id").alias("one"))
    # Most names mean one group: all of these are together with it.
    one, more = classes.where("size(groups) = 1"), classes.where("size(groups) > 1")
    one = one.groupBy(F.col("groups")[0].alias("group")).agg(F.flatten(F.collect_list("names")).alias("names"))
    rows = counted.join(one, "group").select("names", "route", "n", "one")
    each = counted.join(more.select("class", F.explode("groups").alias("group")), "group").groupBy("class", "route").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    rows = rows.union(each.join(more.select("class", "names"), "class").select("names", "route", "n", "one"))
    open_ = F.col("n") > 1
    return rows.select(F.explode("names").alias("surface"), "route", F.when(~open_, F.col("one")).alias("entity_id"), F.col("n").alias("candidates"), open_.alias("ambiguous"))
