import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dhruva.functions import display
from dhruva.functions import text as tx
from dhruva.operators import contracts, corpus, features, metrics, names, schedule, service, topology
from dhruva.operators.intents import IntentModel
from dhruva.operators.prefix import front, running_total
from dhruva.plans import evaluation
from dhruva.plans import names as names_plans
from dhruva.plans import topology as routes_plans
from dhruva.schema import Network
from dhruva.session import checkpoint_dir, intermediates, materialise
from dhruva.sources import files
from tests.compare import connect, same


def test_running_total_over_groups(spark):
    rows = [("a" if i % 3 else None, i % 7, i, None if i % 11 == 0 else i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, id int, v int")
    got = {r["id"]: r["running"] for r in running_total(df, "v", ["o", "id"], ["g"]).collect()}
    for g in ("a", None):
        total = 0
        for _, o, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            total += v or 0
            assert got[i] == total
    assert running_total(df.limit(0), "v", ["id"]).count() == 0


def test_intermediate_tables_go(spark):
    from pathlib import Path

    with intermediates(spark):
        df = materialise(spark.range(5), "scope")
        path = Path(df.inputFiles()[0].removeprefix("file://")).parent
        assert df.count() == 5 and path.exists()
    assert not path.exists()


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)  # noqa: N815

    with pytest.raises(ValueError):
        checkpoint_dir(Elsewhere)


def test_front_of_groups(spark):
    rows = [(i, "ab"[i % 5 == 0], (i * 37) % 101, i % 7, [60, 11][i % 5 == 0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, o int, v int, most int")
    want = set()
    for g in "ab":
        total = 0
        for i, _, _, v, most in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            total += v
            if total > most:
                break
            want.add(i)
    assert {r["id"] for r in front(df, "v", ["o", "id"], ["g"], "most").collect()} == want
    assert front(df.limit(0), "v", ["id"], ["g"], "most").count() == 0


def test_word_boundaries(spark):
    t = spark.createDataFrame([("लोकल",), ("कल",)], "t string")
    assert [r[0] for r in t.select(tx.has_word(F.col("t"), "कल", True)).collect()] == [False, True]
    # Without marks the virama of a preceding letter would end a word, so the notions differ on purpose.
    assert [r[0] for r in t.select(tx.has_word(F.col("t"), "कल", False)).collect()][1] is True


def test_normalised_and_digits(spark):
    df = spark.createDataFrame([("  Bus-No. १२  "), ("É".encode().decode()), None, ""], "string")
    assert [r[0] for r in df.select(tx.normalised("value")).collect()] == ["bus no १२", "é", None, ""]
    assert df.select(tx.ascii_digits("value")).first()[0] == "  Bus-No. 12  "


def test_minutes_round_half_up_and_pass_midnight(spark):
    df = spark.createDataFrame([("08:00:29",), ("08:00:30",), ("25:10:00",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(schedule.minutes("c")).collect()] == [480, 481, 1510, None, None]


def test_headway_needs_two_departures(spark):
    df = spark.createDataFrame([(1, "r", "08:00:00"), (2, "r", "08:10:00"), (3, "r", "08:30:00"), (4, "r", "23:00:00"), (5, "s", "08:00:00")], "event_id long, route_id string, clock string")
    assert [tuple(r) for r in schedule.headways(df, ["route_id"]).collect()] == [("r", 15.0, 2)]
    assert schedule.headways(df.limit(0), ["route_id"]).count() == 0


def test_headway_of_one_direction_and_stop_only(spark):
    rows = [("r", 0, "s", "08:00:00"), ("r", 1, "s", "08:10:00"), ("r", 0, "s", "08:20:00"), ("r", 1, "s", "08:30:00"), ("q", 0, "s", "08:00:00"), ("q", 0, "s", "08:12:00"), ("q", 0, "s", "08:12:10"), ("p", 0, "s", "08:00:00"), (None, 0, "s", "09:00:00")]
    df = spark.createDataFrame(rows, "route_id string, direction_id int, stop_id string, clock string")
    got = {r["route_id"]: tuple(r)[1:] for r in schedule.frequency(df, ["route_id"]).collect()}
    assert got == {"r": (schedule.AMBIGUOUS, None, None), "q": ("ok", 12.0, 1), "p": ("too_few_departures", None, None), None: ("too_few_departures", None, None)}


def test_headway_window_by_rounded_minutes(spark):
    rows = [("07:59:29",), ("07:59:30",), ("08:09:00",), ("09:59:29",), ("09:59:30",), (None,)]
    df = spark.createDataFrame(rows, "clock string").withColumn("r", F.lit(1))
    # 08:00, 08:09 and 09:59 are in; 07:59 and 10:00 are not.
    assert [tuple(r) for r in schedule.headways(df, ["r"], "08:00:00").collect()] == [(1, (9 + 110) / 2, 2)]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b"), ("c", "x")], "expected string, predicted string")
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.class_scores(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (0.5, 1.0, pytest.approx(2 / 3), 1), "b": (1.0, 0.5, pytest.approx(2 / 3), 2), "c": (0.0, 0.0, 0.0, 1)}
    assert metrics.confusion(df, ["a", "b", "c"]).agg(F.sum("n"), F.count("*")).first()[:] == (3, 9)
    sets = spark.createDataFrame([(["a", "b"], ["b", "b"]), (None, []), (["x"], None)], "e array<string>, p array<string>")
    assert metrics.slot_scores(sets, "e", "p").first()[:3] == (1, 0, 2)


def test_ngrams_of_short_and_null_texts(spark):
    df = spark.createDataFrame([("Ab  c",), ("a",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(features.char_ngrams(F.col("t"), 2, 3)).collect()]
    assert got == [["ab", "b ", " c", "ab ", "b c"], [], [], []]


def test_spans_are_longest_and_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "Central Bus Stop, near Lake central"), (2, None), (3, ""), (4, "bus " * 50), (5, "kya tiyoguvadi main road bus stop band hai")], "doc long, body string")
    index = spark.createDataFrame([("central",), ("central bus",), ("bus stop near",), ("lake central",), ("tiyoguvadi main road",), ("tiyoguvadi main road bus stop",), ("tiyoguvadi main road bus stop gate four b",)], "name string")
    got = sorted((r["id"], r["start"], r["words"], r["surface"]) for r in names.name_spans(docs, "doc", "body", index).collect())
    assert got == [(1, 0, 2, "central bus"), (1, 4, 2, "lake central"), (5, 1, 5, "tiyoguvadi main road bus stop")]
    assert names.name_spans(docs, "doc", "body", index.limit(0)).count() == 0


def test_ends_of_a_journey(spark):
    cases = {
        "guindy se central kaise jaye": (None, "guindy", "central", None, False), "central jaana hai guindy metro station se": (None, "guindy", "central", None, False), "from central to guindy": (None, "central", "guindy", None, False),
        "guindy central": (None, "guindy", "central", None, False), "guindy se": ("guindy", "guindy", None, None, False), "guindy tak": ("guindy", None, "guindy", None, False), "guindy": ("guindy", None, None, None, False),
        "guindy se guindy": ("guindy", "guindy", None, None, False), "guindy से central होकर airport": (None, "guindy", "airport", "central", False), "guindy se central se hokar airport": (None, "guindy", "airport", "central", False),
        "guindy central airport": (None, None, None, None, True), "via guindy via central": (None, None, None, None, True), "nothing here": None, None: None,
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "id long, t string")
    listed = spark.createDataFrame([("guindy",), ("central",), ("airport",)], "name string")
    got = {r["id"]: tuple(r)[1:] for r in names.endpoints(names.name_spans(docs, "id", "t", listed, around=True)).collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}


@pytest.mark.parametrize("bound", [500_000, 0])
def test_spans_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(names, "BROADCAST_NAMES", bound)
    rnd = random.Random(5)
    known = {" ".join(rnd.choices("abcd", k=rnd.choice((1, 1, 2, 3, 5, 7)))) for _ in range(60)} - {"a", "b"}
    texts = [" ".join(rnd.choices("abcdx", k=rnd.randint(0, 40))) for _ in range(200)]
    want = []
    for i, t in enumerate(texts):
        w, at = t.split(), 0
        while at < len(w):
            n = next((n for n in range(min(7, len(w) - at), 0, -1) if " ".join(w[at : at + n]) in known), 0)
            if n:
                want.append((i, at, n, " ".join(w[at : at + n])))
            at += n or 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, body string")
    got = names.name_spans(docs, "doc", "body", spark.createDataFrame([(n,) for n in known], "name string")).collect()
    assert sorted((r["id"], r["start"], r["words"], r["surface"]) for r in got) == want


@pytest.mark.parametrize("around", [False, True])
def test_names_need_no_windows_of_words(spark, around):
    """No run of words that isn't a name is carried to the list of names, and names are sent to all only if they are few."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(3_000)) + " lake central x y")], "doc long, body string")
    listed = spark.createDataFrame([("lake central",), ("lake",), ("central park road",)], "name string")
    known = names.name_spans(docs, "doc", "body", listed, around)
    assert [(r["start"], r["words"], r["surface"]) for r in known.collect()] == [(3_000, 2, "lake central")]
    if around:
        assert [(r["before"], r["after"]) for r in known.collect()] == [("w2999", ["x", "y"])]
    assert "slice(" not in known._jdf.queryExecution().optimizedPlan().toString()
    assert names.BROADCAST_NAMES <= 20_000


def test_index_of_asked_names(spark):
    stops = spark.createDataFrame([("M1", "Lake Side", "metro"), ("B1", "Lakeside", "bus"), ("B2", "Hill", "bus")], "stop_id string, canonical_name string, mode string")
    hubs = spark.createDataFrame([("HUB", "Hill")], "hub_id string, hub_name string")
    aliases = spark.createDataFrame([("Hill", "गिंडी")], "canonical_name string, alias string")
    asked = spark.createDataFrame([("lakeside",), ("hill bus stop",)], "surface string")
    whole, some = names.alias_index(stops, hubs, aliases), names.alias_index(stops, hubs, aliases, asked=asked)
    get = lambda df: sorted(map(tuple, df.join(asked.withColumnRenamed("surface", "name"), "name").select("name", "entity_id", "kind").collect()))
    assert get(some) == get(whole) == [("hill bus stop", "B2", "stop"), ("lakeside", "B1", "stop"), ("lakeside", "M1", "stop")]


def test_resolution_keeps_ambiguous_candidates(spark):
    stops = spark.createDataFrame([("M1", "Guindy", "metro"), ("R1", "Guindy", "suburban_rail"), ("B1", "Guindy", "bus"), ("B2", "Guindy", "bus"), ("B3", "Maple Quay", "bus")], "stop_id string, canonical_name string, mode string")
    hubs = spark.createDataFrame([("HUB", "Guindy")], "hub_id string, hub_name string")
    places = spark.createDataFrame([("P1", "Maple Research Institute, Estuary Campus"), ("P2", "Marina Beach, Chennai"), ("P3", "Lake,")], "place_id string, name string")
    index = names.alias_index(stops, hubs, spark.createDataFrame([("Guindy", "गिंडी")], "canonical_name string, alias string"), places)
    on = spark.createDataFrame([("29C", "B1"), ("5", "B1"), ("5", "B2")], "route string, entity_id string")
    ask = [
        ("guindy", "origin", "point_to_point_route", None, None, "HUB", 1), ("guindy", "origin", "service_frequency", None, None, None, 5), ("guindy", "origin", "point_to_point_route", "metro", None, "M1", 1), ("guindy", "station", "x", None, None, None, 4),
        ("guindy", "stop", "x", "bus", "29C", "B1", 1), ("guindy", "stop", "x", "bus", "5", None, 2), ("guindy", "stop", "x", "bus", "77", None, 2), ("guindy metro station", "station", "x", None, None, "M1", 1), ("गिंडी", "station", "x", "metro", None, "M1", 1),
        ("maple research institute", "landmark", "x", None, None, None, 1), ("maple research institute estuary campus", "landmark", "x", None, None, "P1", 1), ("marina beach", "landmark", "x", None, None, "P2", 1), ("marinabeach", "landmark", "x", None, None, "P2", 1),
        ("maple quay", "landmark", "nearest_transport", None, None, None, 1), ("maple quay bus stop", "landmark", "nearest_transport", None, None, "B3", 1), ("maple quay", "origin", "point_to_point_route", "metro", None, "B3", 1), ("lake", "landmark", "x", None, None, "P3", 1),
        ("marina beach", "stop", "x", None, None, None, 0), ("guindy", "landmark", "x", "metro", None, None, 5), ("nowhere", "origin", "x", None, None, None, 0), (None, "origin", "x", None, None, None, 0),
    ]
    spans = spark.createDataFrame([a[:5] for a in ask], "surface string, role string, operation string, mode string, route string")
    got = {tuple(r[:5]): (r["entity_id"], r["candidates"]) for r in names.resolve(spans, index, "role", "operation", "mode", "route", on).collect()}
    assert got == {a[:5]: a[5:] for a in ask}


def test_templates(spark):
    t = spark.createDataFrame([("l", 0, "{origin} to {destination}")], "label string, family int, template string")
    n = spark.createDataFrame([("A",), ("B",)], "name string")
    assert sorted(r["text"] for r in corpus.generate(t, n, n).collect()) == ["A to B", "B to A"]


def test_masked_mean_and_softmax(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0]), (None, None)], "v array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(features.masked_mean(F.col("v"), F.col("m"))).collect()] == [[2.0, 3.0], None, None]
    p = df.limit(1).select(features.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0]
    assert p == [0.5, 0.5]


def test_contracts(spark):
    cases = [
        ("origin", "BUS_1", None), ("origin", "bus 1", "entity_id"), ("time", "25:00:00", "clock"), ("time", "08:00:00", None), ("date", "2024-02-30", "date"), ("date", "2024-02-29", None), ("stage_number", "31", "stage"), ("stage_number", "30", None),
        ("stage_number", "x", "stage"), ("transport_mode", "boat", "vocabulary"), ("time", None, None), ("other", "x", "unknown_slot"), (None, "x", "unknown_slot"), ("ticket_type", "smart_card", None), ("ticket_type", "cash", "vocabulary"), ("fare_type", "concession", None),
        ("fare_type", "free", "vocabulary"), ("service_type", "Night Services", None), ("service_type", "night services", "vocabulary"), ("line_name", "Blue Line", None), ("line_name", "Red Line", "vocabulary"), ("mode_from", "mrts", None), ("mode_to", "tram", "vocabulary"),
        ("facility_type", "atm", None), ("accessibility_feature", "any", None), ("preference", "direct_only", None), ("timing_type", "never", "vocabulary"), ("temporal_relative", " ", "blank"), ("temporal_relative", "kal", None), ("via", "", "entity_id"),
    ]
    df = spark.createDataFrame(cases, "slot string, value string, want string")
    assert [r[0] for r in df.select(contracts.reason(F.col("slot"), F.col("value"))).collect()] == [c[2] for c in cases]


def test_forbidden_slots_by_hand(spark):
    cases = [
        ("point_to_point_route", "via", False), ("point_to_point_route", "station", True), ("route_stop_sequence", "stop", True), ("route_stop_membership", "stop", False), ("scheduled_departure", "stop", False), ("service_frequency", "stop", True),
        ("fare_calculation", "stage_number", False), ("fare_calculation", "via", True), ("nearest_transport", "landmark", False), ("nearest_transport", "origin", True), ("station_facilities", "facility_type", False), ("station_facilities", "accessibility_feature", True),
        ("interchange_transfer", "mode_to", False), ("mode_availability", "timing_type", True), ("ticketing_and_passes", "fare_type", True), ("realtime_status_query", "time", True), *(("out_of_scope", s, False) for s in contracts.SLOTS), ("unknown", "via", True), ("out_of_scope", "other", True),
    ]
    got = {tuple(r) for r in contracts.forbidden(spark.createDataFrame([c[:2] for c in cases], "operation string, slot string")).collect()}
    assert got == {c[:2] for c in cases if c[2]} and len(contracts.SLOTS) == 23 and len(contracts.ALLOWED) == 16


def test_display(spark):
    df = spark.createDataFrame([("suburban_rail", "https://www.Example.org/a?b", "<a & 'b'>"), ("other_mode", "x", None), (None, None, "")], "m string, u string, h string")
    got = df.select(display.label("m"), display.source_title("u"), display.html("h")).collect()
    assert [tuple(r) for r in got] == [("Suburban rail", "example.org", "&lt;a &amp; &#x27;b&#x27;&gt;"), ("Other mode", None, None), (None, None, "")]


def test_earliest_best(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9)], "epoch int, f1 double")
    assert tuple(metrics.earliest_best(df, "epoch", "f1").first()) == (2, 0.9)
    assert metrics.earliest_best(df.limit(0), "epoch", "f1").count() == 0


def test_files(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    df = spark.createDataFrame([('x "q",\n|', 1), (None, 2)], schema)
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    nested = T.StructType([T.StructField("items", T.ArrayType(schema))])
    (tmp_path / "n.json").write_text('{"items": [{"a": "x", "b": 1},\n {"a": "y"}]}')
    rows = files.explode_list(files.read_json(spark, str(tmp_path / "n.json"), nested), "items", a="name")
    assert [tuple(r) for r in rows.collect()] == [("x", 1), ("y", None)]
    files.write_markdown(df, str(tmp_path / "r.md"), "Title")
    assert (tmp_path / "r.md").read_text().startswith("# Title\n\n| a | b |")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/f").write_bytes(b"abc")
    assert files.verified(spark, str(tmp_path / "d"), {"f": hashlib.sha256(b"abc").hexdigest()})
    assert not files.verified(spark, str(tmp_path / "d"), {"f": "0"})
    with pytest.raises(files.SourceError):
        files.read_parquet(spark, str(tmp_path / "none"))


def test_contained_texts_are_whole_however_long(spark):
    asked = "Where does the last bus to Lake Road stop after ten, and is there a ramp?"
    docs = [(1, f"Intro. {asked.upper()} The end"), (2, asked.replace("ramp", "lift")), (3, "To lake road-end"), (4, "Lakeroad"), (5, None), (6, "lake road"), (7, "x a b c d e f g h y"), (8, "a a a a a a a a a")]
    docs = spark.createDataFrame(docs, "doc int, t string")
    listed = spark.createDataFrame([(asked,), ("Lake Road",), ("a b c d e f g",), ("a b c d e f g h",), ("a a a a a a a a a",), ("a a a a a a a a a a",), ("",), (None,)], "name string")
    got = sorted(tuple(r) for r in corpus.contained_texts(docs, "doc", "t", listed.select(tx.normalised("name").alias("name")), "name").collect())
    whole = "where does the last bus to lake road stop after ten and is there a ramp"
    assert got == sorted([(1, whole), (1, "lake road"), (2, "lake road"), (3, "lake road"), (6, "lake road"), (7, "a b c d e f g"), (7, "a b c d e f g h"), (8, "a a a a a a a a a")])


def test_leakage_texts_reports_a_planted_question(spark, tmp_path):
    q = "kya yahan se lake road tak aakhri bus raat dus baje ke baad chalti hai"
    spark.createDataFrame([("e1", q, "Test "), ("t1", "train " + q, "train")], "id string, text string, split string").write.parquet(f"{tmp_path}/hindi_intents.parquet")
    spark.createDataFrame([("S", "Lake Road", None, ["LR"])], "station_key string, canonical_name_en string, canonical_name_hi string, aliases array<string>").write.parquet(f"{tmp_path}/station_aliases.parquet")
    spark.createDataFrame([(1, f"so: {q}?"), (2, "lake road"), (3, "train")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in evaluation.leakage_texts(spark, str(tmp_path)).collect())
    assert got == [("question", "e1", 1), ("station", "S", 2)]


def test_document_frequency_has_all_lengths_and_counts_ids_once(spark):
    docs = spark.createDataFrame([(1, "abcdef"), (1, "abcdex"), (2, "xbcde"), (3, None), (4, "a")], "id int, text string")
    got = {r["term"]: r["df"] for r in features.document_frequency(docs, "id", "text").collect()}
    assert {len(t) for t in got} == {2, 3, 4, 5}
    assert (got["abcde"], got["bcde"], got["bcdef"], got["xb"]) == (1, 2, 1, 1)


def test_question_top_terms_counts_a_text_once(spark, tmp_path):
    spark.createDataFrame([("a", "zzz"), ("b", "zzz"), ("c", "yy"), ("d", None)], "id string, text string").write.parquet(f"{tmp_path}/hindi_intents.parquet")
    got = sorted((r["id"], r["rank"], r["term"]) for r in evaluation.question_top_terms(spark, str(tmp_path)).collect())
    assert got == [("a", 1, "zz"), ("a", 2, "zzz"), ("c", 1, "yy")]


def test_families_are_torn_however_they_are_written(spark, tmp_path):
    rows = [("7", "Ticketing ", "train"), ("ticketing:07", "x", "test"), ("A:0", "a", "train"), (" a : 00", "a", "val"), ("8", "a", "train"), ("a:8", "a", "train"), ("9", None, "train"), ("?", "a", "test"), (None, "a", "test")]
    spark.createDataFrame(rows, "family_id string, intent string, split string").write.parquet(f"{tmp_path}/hindi_intents.parquet")
    assert sorted(tuple(r) for r in evaluation.family_split_leaks(spark, str(tmp_path)).collect()) == [("a:0", 2, 2), ("ticketing:7", 2, 2)]


def test_install_checks_before_it_moves(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    good = hashlib.sha256(b"x" * 3_000_000).hexdigest()
    with pytest.raises(files.SourceError):
        files.install(str(tmp_path / "a"), str(tmp_path / "b"), "0" * 64)
    assert not (tmp_path / "b").exists()
    files.install(str(tmp_path / "a"), str(tmp_path / "b"), good)
    assert (tmp_path / "b").stat().st_size == 3_000_000 and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_refusals_and_canonical_json(spark):
    rows = [("PLAN_ROUTE", {"date": "2024-01-01"}), ("PLAN_ROUTE", {"date": ""}), ("PLAN_ROUTE", {"preference": "direct_only"}), ("PLAN_ROUTE", {"preference": "cheapest"}), ("GET_INTERCHANGE_DETAILS", {}), ("GET_ACCESSIBILITY_INFO", {}), ("REJECT_OUT_OF_SCOPE", {}), (None, None)]
    df = spark.createDataFrame(rows, "o string, s map<string,string>")
    got = [r[0] for r in df.select(service.refusal(F.col("o"), F.col("s"), F.lit(False), F.lit(True))).collect()]
    assert got == ["route_temporal_scope_unsupported", None, None, "route_preference_unsupported", "confirmed_interchanges_absent", None, "out_of_scope", None]
    j = spark.createDataFrame([("é/", None)], "b string, a int").select(display.canonical_json(b=F.col("b"), a=F.col("a"))).first()[0]
    assert j == '{"a":null,"b":"é/"}'


def test_published_options_of_a_very_common_name(spark):
    stops = [(f"S{i:03d}", "Main Road", "bus") for i in range(70)] + [("T1", "Temple", "bus"), ("T2", "Temple", "metro")]
    net = Network(
        spark.createDataFrame([("R", "5", "bus", "x", "operational")], "route_id string, route_short_name string, mode string, source_id string, status string"),
        spark.createDataFrame(stops, "stop_id string, canonical_name string, mode string"),
        spark.createDataFrame([("R", 0, i, s[0]) for i, s in enumerate(stops)], "route_id string, direction_id int, stop_sequence int, stop_id string"), None,
    )
    names_ = net.stops.select(F.lower("canonical_name").alias("name"), "stop_id", "mode")
    asked = spark.createDataFrame([("main road", "temple"), ("temple", "main road")], "from_name string, to_name string")
    got = service.published_options(net, names_, asked).collect()
    assert sorted((r["rank"], r["origin"], r["destination"], r["truncated"]) for r in got) == [(i + 1, f"S{i:03d}", "T1", True) for i in range(10)]
    report = service.route_report(net).first()
    assert tuple(report) == ("5", "ok", 1, False, 1, "", True)
    both = spark.createDataFrame([("S000", "T1"), ("T1", "S000")], "origin string, destination string")
    assert {tuple(r) for r in service.availability(net, both).collect()} == {("S000", "T1", "recorded", 1, True), ("T1", "S000", "unavailable", 0, False)}


@pytest.mark.parametrize("at_once", [1 << 18, 5])
def test_options_between_names_equal_brute_force(spark, monkeypatch, at_once):
    """Every option of two names, made without pairing the stops of one name with those of the other."""
    monkeypatch.setattr(topology, "AT_ONCE", at_once)
    rnd = random.Random(3)
    names_ = ["Lake", " lake ", "HILL", "hill", "Ford", "Mill", None, "  "]
    stops = [(f"S{i}", names_[i % 8], "bus" if i % 9 else "metro") for i in range(60)] + [("T0", "Pier", "bus"), ("T1", "Quay", "bus")]
    routes = [(f"R{i}", "5", "bus", "x", "operational" if i % 7 else "suspended") for i in range(12)]
    links = [(f"R{i}", d, 3 * k + k % 2, f"S{rnd.randrange(60)}") for i in range(12) for d in (0, 1) for k in range((2, 3, 9, 40)[i % 4])] + [("R1", 2, k, "S0") for k in range(3)] + [("R1", 3, k, s) for k, s in enumerate(("T0", "S1", "T1"))]
    net = Network(
        spark.createDataFrame(routes, "route_id string, route_short_name string, mode string, source_id string, status string"), spark.createDataFrame(stops, "stop_id string, canonical_name string, mode string"),
        spark.createDataFrame(links, "route_id string, direction_id int, stop_sequence int, stop_id string"), None,
    )
    name, bus = {s: (n or "").strip().lower() for s, n, _ in stops}, {s for s, _, m in stops if m == "bus"}
    runs, asked, found = {}, set(), {}
    for r, d, k, s in sorted(links):
        if s in bus and int(r[1:]) % 7:
            runs.setdefault((r, d), []).append((k, s))
    for run in runs.values():
        if len(run) >= 3 and run[0][1] != run[-1][1] and name[run[0][1]] and name[run[-1][1]]:
            asked.add((name[run[0][1]], name[run[-1][1]]))
    for (r, d), run in runs.items():
        for k, s in run:
            for q, t in run:
                if k < q and s != t and (name[s], name[t]) in asked:
                    found.setdefault((name[s], name[t]), []).append((q - k, r, d, k))
    want = {(*e, len(o) > 10, min(len(o), 10), min(x[1] for x in sorted(o)[:10])) for e, o in found.items()}
    assert {x[2] for x in want} == {True, False}
    monkeypatch.setattr(routes_plans, "network", lambda *_: net)
    got = routes_plans.route_options_capped(spark, "")
    assert {tuple(r[c] for c in ("origin", "destination", "truncated", "options", "least_route")) for r in got.collect()} == want
    assert "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_names_on_routes_hold_no_stop_against_another_route(spark, tmp_path):
    """Equal to its SQL for names of several stops, modes and spellings; a name's stops aren't multiplied by the routes asked for."""
    at, day = datetime.datetime(2024, 1, 1), datetime.date(2024, 1, 1)
    named = ["Lake Side", "Lakeside", "LAKE  SIDE", "Lake", "Mill", "Bus Stop", "Ford", "St. Mary", None, " ", "-", "Main Road"]
    stops = [(f"S{i}", named[i % 12], ["bus", "metro", "suburban_rail", None, "x y"][i % 5], 13.0, 80.0, 1, "a", at, None) for i in range(120)] + [("S0", "Lake", "bus", 13.0, 80.0, 1, "a", at + datetime.timedelta(1), None), ("S200", "Pier", "bus", 1.0, 1.0, 1, "a", at, None)]
    routes = [(f"R{i}", ["5", "29 c", "29C", "", None, "M-1", "7"][i % 7], ["bus", "metro", "suburban_rail", "x y"][i % 4], "a", "operational" if i % 9 else "suspended", at, None) for i in range(40)]
    links = [(40 * i + k, f"R{i}", k % 2, k, f"S{(i * 7 + k * 11) % 120}", day, at) for i in range(40) for k in range(30)] + [(9_999, "R1", 0, 0, "S200", day, at + datetime.timedelta(1)), (9_998, " r8", 5, 0, "s200 ", day, at)]
    tables = {
        "transport_stops": (stops, "stop_id string, canonical_name string, mode string, latitude double, longitude double, inside_cma int, primary_source_id string, first_seen timestamp_ntz, deleted_at timestamp_ntz"),
        "transport_routes": (routes, "route_id string, route_short_name string, mode string, source_id string, status string, first_seen timestamp_ntz, deleted_at timestamp_ntz"),
        "route_stops": (links, "link_id long, route_id string, direction_id int, stop_sequence int, canonical_stop_id string, snapshot_date date, loaded_at timestamp_ntz"),
        "transport_hubs": ([("H", "Mill", 1.0, 1.0)], "hub_id string, hub_name string, latitude double, longitude double"),
        "station_aliases": ([("Lake", ["Talab", "ta lab", "Pi er"]), ("Mill", ["Talab"])], "canonical_name_en string, aliases array<string>"),
        "reviewed_name_aliases_v1": ([(1, "Ford, Old Town", ["Furt"]), (2, "Main Road, Chennai", ["MR"]), (3, "P ier", [])], "entry_id long, canonical_name string, aliases array<string>"),
        "chennai_case_study": ([("1", "Mainroad, Adyar")], "id string, name_en string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = connect(tmp_path)
    for name in tables:
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = names_plans.resolve_on_route(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() > 100 and {r["ambiguous"] for r in got.collect()} == {True, False}
    same(got, con, names_plans.ORACLES["resolve_on_route"])
    assert not [x for x in plan.splitlines() if "Join" in x and "surface" in x]


def test_intent_model_learns_saves_and_loads(spark, sf, tmp_path):
    rows = evaluation._rows(spark, sf).where("expected is not null").select("id", "text", F.col("expected").alias("intent"), "split")
    model = IntentModel.fit(rows.where("split = 'train'"))
    test = rows.where("split = 'test'")
    told = model.predict(test)
    right = told.agg(F.avg((F.col("predicted") == F.col("intent")).cast("double"))).first()[0]
    assert right > 0.85 and told.count() == test.count()
    model.save(str(tmp_path / "model"))
    again = IntentModel.load(str(tmp_path / "model")).predict(test)
    assert {(r["id"], r["predicted"]) for r in again.collect()} == {(r["id"], r["predicted"]) for r in told.collect()}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 50_000)], "id int, text string")
    assert {r["predicted"] in model.labels.labels for r in model.predict(odd).collect()} == {True}
