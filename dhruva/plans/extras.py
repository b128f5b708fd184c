"""Queries over contracts, display text, guidance and model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dhruva.functions import display
from dhruva.operators import contracts, metrics
from dhruva.operators import topology as top
from dhruva.operators.proximity import nearest
from dhruva.plans import evaluation as ev
from dhruva.plans import records as plan_records
from dhruva.plans import topology as plan_topology
from dhruva.schema import SQL, network, table


def forbidden_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Slots per operation that it may not carry."""
    slots = spark.createDataFrame([(s,) for s in contracts.SLOTS], "slot string")
    grid = contracts.allowed_slots(spark).select("operation").distinct().crossJoin(slots)
    return contracts.forbidden(grid)


def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded values held against the contract of their slot, counted by reason."""
    r = table(spark, sf, "transport_routes").distinct()
    values = F.array(
        F.struct(F.lit("route_number").alias("slot"), F.col("route_short_name").alias("value")), F.struct(F.lit("transport_mode").alias("slot"), F.col("mode").alias("value")),
        F.struct(F.lit("origin").alias("slot"), F.col("route_id").alias("value")), F.struct(F.lit("date").alias("slot"), F.date_format("first_seen", "yyyy-MM-dd").alias("value")),
        F.struct(F.lit("time").alias("slot"), F.date_format("first_seen", "HH:mm").alias("value")), F.struct(F.lit("mode_from").alias("slot"), F.upper("mode").alias("value")),
        F.struct(F.lit("line_name").alias("slot"), F.col("route_short_name").alias("value")), F.struct(F.lit("status").alias("slot"), F.col("status").alias("value")),
    )
    rows = r.select(F.explode(values).alias("v")).select("v.*").withColumn("reason", contracts.reason(F.col("slot"), F.col("value")))
    return rows.groupBy("slot", "reason").agg(F.count("*").alias("n"))


def route_sentences(spark: SparkSession, sf: str) -> DataFrame:
    net = network(spark, sf)
    found = top.direct_routes(net, top.terminal_requests(net).select("origin", "destination").distinct())
    text = display.html(display.route_sentence("route_short_name", "mode", "origin", "destination", "partial_topology"))
    return found.select("route_id", "direction_id", text.alias("sentence")).distinct()


def nearest_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Of the stops near a hub one per name, the nearest; the first three, bus stops of the preferred source first."""
    net = network(spark, sf)
    anchors = net.hubs.select(F.col("hub_id").alias("anchor"), F.col("latitude").alias("alat"), F.col("longitude").alias("alon"))
    points = plan_records._points(net.stops).where("trim(canonical_name) != ''")
    near = nearest(anchors, points, 10)
    first = near.groupBy("anchor", F.lower(F.trim("canonical_name")).alias("name")).agg(F.min_by(F.struct("id", "primary_source_id", "metres"), F.struct("metres", "id")).alias("s")).select("anchor", "name", "s.*")
    order = [(F.col("primary_source_id") != "SYN_FEED").cast("int"), "metres", "id"]
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where("rank <= 3")
    return ranked.select(F.col("anchor").alias("hub_id"), "name", F.col("id").alias("stop_id"), "rank")


def guidance_match(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows one of whose typed names is, letter by letter, a reviewed name."""
    typed = table(spark, sf, "chennai_case_study").select("id", F.explode("aliases").alias("name")).distinct()
    ref = table(spark, sf, "reviewed_name_aliases_v1").select("entry_id", F.col("canonical_name").alias("name")).distinct()
    return typed.join(ref, "name").select("id", "entry_id").distinct()


def best_epoch(spark: SparkSession, sf: str) -> DataFrame:
    """Earliest best by macro F1 on validation; an epoch here is the rule classifier with one rule more."""
    rows = ev._scored(spark, sf).where("split = 'validation'")
    names = list(ev.RULES)
    upto = F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("epoch")
    order = F.array_position(F.array(*map(F.lit, names)), F.col("predicted")).cast("int")
    known = rows.select("expected", order.alias("o"), "predicted", upto).select("epoch", "expected", F.when((F.col("o") > 0) & (F.col("o") <= F.col("epoch")), F.col("predicted")).otherwise("none").alias("predicted"))
    runs = metrics.accuracy(known, ev.LABELS, ["epoch"])
    return metrics.earliest_best(runs.withColumn("score", F.round("macro_f1", 9)), "epoch", "score").select("epoch", "n", F.round("macro_f1", 6).alias("macro_f1"))


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two classifiers on the test questions: the keyword rules, and words that vote for the intent they most often have in training."""
    rows = ev._scored(spark, sf).select("id", "expected", "split", "t", F.col("predicted").alias("rules")).distinct()
    words = rows.select("id", "expected", "split", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("word"))
    seen = words.where("split = 'train'").groupBy("word", "expected").agg(F.count("*").alias("n"))
    votes = seen.groupBy("word").agg(F.min_by("expected", F.struct(-F.col("n"), "expected")).alias("vote"))
    tally = words.where("split = 'test'").join(votes, "word").groupBy("id", "t", "vote").agg(F.count("*").alias("n"))
    chosen = tally.groupBy("id", "t").agg(F.min_by("vote", F.struct(-F.col("n"), "vote")).alias("words"))
    test = rows.where("split = 'test'").join(chosen, ["id", "t"], "left")
    long = test.select("expected", F.explode(F.create_map(F.lit("rules"), "rules", F.lit("words"), F.coalesce("words", F.lit("none")))).alias("model", "predicted"))
    return long.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("expected")).cast("double")), 6).alias("accuracy"))


QUERIES = {f.__name__: f for f in (forbidden_slots, contract_violations, route_sentences, nearest_by_name, guidance_match, best_epoch, model_comparison)}
_ALLOWED = "allowed(operation, slot) AS (VALUES " + ", ".join(f"('{i}', '{s}')" for i, t in contracts.ALLOWED.items() for s in t.split()) + ")"
_LABEL = "CASE mode " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in display.MODE_LABELS.items()) + " END"
ORACLES = {
    "forbidden_slots": f"WITH {_ALLOWED}, s(slot) AS (VALUES " + ", ".join(f"('{s}')" for s in contracts.SLOTS) + """)
SELECT o.operation, s.slot FROM (SELECT DISTINCT operation FROM allowed) o, s EXCEPT SELECT operation, slot FROM allowed""",
    "contract_violations": """WITH r AS (SELECT DISTINCT * FROM transport_routes), v AS (
  SELECT 'route_number' AS slot, CASE WHEN NOT regexp_matches(route_short_name, '^[A-Z0-9][A-Z0-9#-]*$') THEN 'route_code' END AS reason FROM r
  UNION ALL SELECT 'transport_mode', CASE WHEN mode NOT IN ('metro', 'bus', 'suburban_rail', 'mrts', 'any') THEN 'vocabulary' END FROM r
  UNION ALL SELECT 'origin', CASE WHEN NOT regexp_matches(route_id, '^[A-Z0-9_]+$') THEN 'entity_id' END FROM r UNION ALL SELECT 'date', NULL FROM r UNION ALL SELECT 'time', CASE WHEN first_seen IS NOT NULL THEN 'clock' END FROM r
  UNION ALL SELECT 'mode_from', CASE WHEN mode IS NOT NULL THEN 'vocabulary' END FROM r UNION ALL SELECT 'line_name', CASE WHEN route_short_name IS NOT NULL THEN 'vocabulary' END FROM r UNION ALL SELECT 'status', 'unknown_slot' FROM r)
SELECT slot, reason, count(*) AS n FROM v GROUP BY ALL""",
    "route_sentences": plan_topology._REQ + f"""SELECT DISTINCT route_id, direction_id, replace(coalesce(route_short_name, '?') || ' (' || {_LABEL} || '): ' || origin || ' → ' || destination || CASE WHEN partial_topology THEN ' [partial]' ELSE '' END, '&', '&amp;') AS sentence FROM full_found""",
    "nearest_by_name": SQL + f""", d AS (SELECT h.hub_id, s.stop_id, s.primary_source_id, lower(trim(s.canonical_name)) AS name, {plan_records._DIST.format(a='h', b='s')} AS metres FROM transport_hubs h, stops s
  WHERE {plan_records._OK.format(a='h')} AND {plan_records._OK.format(a='s')} AND trim(s.canonical_name) <> ''),
t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY hub_id ORDER BY metres, stop_id) <= 10), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY hub_id, name ORDER BY metres, stop_id) = 1)
SELECT hub_id, name, stop_id, CAST(row_number() OVER (PARTITION BY hub_id ORDER BY CAST(primary_source_id <> 'SYN_FEED' AS INT), metres, stop_id) AS INT) AS rank FROM f QUALIFY rank <= 3""",
    "guidance_match": "SELECT DISTINCT c.id, r.entry_id FROM (SELECT id, unnest(aliases) AS name FROM chennai_case_study) c JOIN reviewed_name_aliases_v1 r ON r.canonical_name = c.name",
    "best_epoch": ev._Q + f""", e AS (SELECT k.epoch, s.expected, CASE WHEN list_position(names, s.predicted) BETWEEN 1 AND k.epoch THEN s.predicted ELSE 'none' END AS predicted
  FROM s, (SELECT unnest(range(1, {len(ev.RULES) + 1})) AS epoch, {list(ev.RULES)} AS names) k WHERE s.split = 'validation'),
x AS (SELECT epoch, expected AS label, 1 AS e, 0 AS g, CAST(expected = predicted AS INT) AS hit FROM e UNION ALL SELECT epoch, predicted, 0, 1, 0 FROM e),
u AS (SELECT epoch, label, sum(hit) AS tp, sum(e) AS support, sum(g) AS given FROM x WHERE label IN (SELECT label FROM labels) GROUP BY ALL),
v AS (SELECT *, CASE WHEN given > 0 THEN tp / given ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM u), m AS (SELECT epoch, avg({ev._F1}) AS macro_f1 FROM v GROUP BY epoch)
SELECT CAST(m.epoch AS INT) AS epoch, (SELECT count(*) FROM s WHERE split = 'validation') AS n, round(macro_f1, 6) AS macro_f1 FROM m ORDER BY round(macro_f1, 9) DESC, m.epoch LIMIT 1""",
    "model_comparison": ev._Q + """, d AS (SELECT DISTINCT id, expected, split, t, predicted AS rules FROM s), w AS (SELECT id, expected, split, t, unnest(list_distinct(string_split(t, ' '))) AS word FROM d),
seen AS (SELECT word, expected, count(*) AS n FROM w WHERE split = 'train' GROUP BY ALL), votes AS (SELECT word, expected AS vote FROM seen QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, expected) = 1),
tally AS (SELECT w.id, w.t, v.vote, count(*) AS n FROM w JOIN votes v ON v.word = w.word WHERE w.split = 'test' GROUP BY ALL), c AS (SELECT id, t, vote FROM tally QUALIFY row_number() OVER (PARTITION BY id, t ORDER BY n DESC, vote) = 1),
m AS (SELECT d.expected, d.rules, coalesce(c.vote, 'none') AS words FROM d LEFT JOIN c ON c.id = d.id AND c.t = d.t WHERE d.split = 'test'),
l AS (SELECT 'rules' AS model, expected, rules AS predicted FROM m UNION ALL SELECT 'words', expected, words FROM m)
SELECT model, count(*) AS n, round(avg(CAST(predicted = expected AS INT)), 6) AS accuracy FROM l GROUP BY model""",
}
