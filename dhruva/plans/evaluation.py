"""Queries over labels, features and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.functions.text import normalised
from dhruva.operators import corpus, features, metrics
from dhruva.operators.intents import predict_intents
from dhruva.plans.text import NORM, NORM_TEXT
from dhruva.schema import table
from dhruva.session import materialise

LABELS = ["accessibility", "out_of_scope", "railway_complaint", "route_query", "service_availability", "service_timing", "station_information", "ticketing", "train_status"]
PHRASES = ["platform", "luggage", "ticket", "लिफ्ट", "टिकट", "timetable"]
# A keyword classifier, first hit wins, whose words were picked from the synthetic questions: a fixture for the metric queries
# that both engines can run, no model to be used (fixed values).
RULES = {
    "out_of_scope": "kavita|halwai|mele|कविता|मेले|हलवाई",
    "accessibility": "dadi|arzi|दादी|अर्ज़ी",
    "railway_complaint": "dibba|shikayat|डिब्बा|शिकायत",
    "ticketing": "mahine|counter|raseed|paisa|महीने|काउंटर|रसीद",
    "train_status": "booking|local|soochna|बुकिंग|लोकल|सूचना",
    "station_information": "phatak|chowk|फाटक|चौक",
    "service_timing": "pehli|aakhri|पहली|आख़िरी",
    "service_availability": "chal rahi|badhti|चल रही|बढ़ती",
    "route_query": "pahunchna|utarkar|पहुँचना|उतरकर",
}


def _by_rules(text: Column) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in RULES.items()), F.lit("none"))


def _split(c: str) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("train", "training"), "train").when(s.isin("validation", "val", "dev"), "validation").when(s == "test", "test")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "hindi_intents").select("id", "text", "intent", "language", "split").distinct()
    return q.select("id", "text", F.lower(F.trim("intent")).alias("expected"), "language", _split("split").alias("split"), normalised("text").alias("t"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).where("expected is not null and t is not null").withColumn("predicted", _by_rules(F.col("t")))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf), LABELS)


def class_prf(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.class_scores(_scored(spark, sf), LABELS)
    return s.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


def metrics_by_language(spark: SparkSession, sf: str) -> DataFrame:
    a = metrics.accuracy(_scored(spark, sf), LABELS, ["language", "split"])
    return a.select("language", "split", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def slot_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of the station list against those of the reviewed list, as sets per station name."""
    a = table(spark, sf, "station_aliases").select(F.col("canonical_name_en").alias("name"), F.col("aliases").alias("expected"))
    b = table(spark, sf, "reviewed_name_aliases_v1").select(F.col("canonical_name").alias("name"), F.col("aliases").alias("predicted"))
    s = metrics.slot_scores(a.join(b, "name"), "expected", "predicted")
    return s.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact")))


def intent_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and macro F1 of the fitted baseline, per split."""
    rows = _rows(spark, sf).where("expected is not null and text is not null").select("id", "text", F.col("expected").alias("intent"), "split")
    rows = materialise(rows, "labelled")
    scored = predict_intents(rows, rows.where("split = 'train'")).select("split", F.col("intent").alias("expected"), "predicted")
    scored = materialise(scored, "scored")
    a = metrics.accuracy(scored, LABELS, ["split"])
    return a.select("split", "n", F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-grams of two characters with their document frequency."""
    q = table(spark, sf, "hindi_intents").select("id", "text").distinct()
    grams = q.select("id", F.explode(F.array_distinct(features.char_ngrams(F.col("text"), 2, 2))).alias("term"))
    return grams.groupBy("term").agg(F.count_distinct("id").alias("df"))


def ngram_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-grams of two to five characters with their document frequency."""
    return features.document_frequency(table(spark, sf, "hindi_intents"), "id", "text")


def char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """N-grams per question and length, counted within the row."""
    q = table(spark, sf, "hindi_intents").select("id", "text").dropDuplicates(["id", "text"])
    per = F.array(*(F.struct(F.lit(n).alias("n"), features.char_ngrams(F.col("text"), n, n).alias("g")) for n in range(2, 6)))
    rows = q.where("text is not null").select("id", F.explode(per).alias("x")).where("size(x.g) > 0")
    return rows.select("id", "x.n", F.size("x.g").cast("long").alias("grams"), F.size(F.array_distinct("x.g")).cast("long").alias("different"))


def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The heaviest n-gram of each station guide name list: TF-IDF over the reviewed names."""
    from pyspark.sql import Window

    docs = table(spark, sf, "reviewed_name_aliases_v1").select("entry_id", "canonical_name").distinct()
    weights = features.tfidf(features.term_counts(docs, "entry_id", "canonical_name"), "entry_id", docs.count())
    w = Window.partitionBy("entry_id").orderBy(F.round("weight", 9).desc(), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("entry_id", "rank", "term", F.round("weight", 6).alias("weight"))


def question_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The three heaviest n-grams of each question, by TF-IDF over all questions; a text that is there several times counts once, under its least id."""
    from pyspark.sql import Window

    docs = table(spark, sf, "hindi_intents").where("text is not null").groupBy("text").agg(F.min("id").alias("id"))
    # One id may have several texts. Numbers are short keys, written once as they differ from run to run; spread by them, terms are counted where their text is.
    docs = materialise(docs.withColumn("doc", F.monotonically_increasing_id()), "questions")
    weights = features.tfidf(features.term_counts(docs.repartition("doc"), "doc", "text"), "doc", docs.count())
    w = Window.partitionBy("doc").orderBy(F.round("weight", 9).desc(), "term")
    top = weights.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    return top.join(docs, "doc").select("id", "text", "rank", "term", F.round("weight", 6).alias("weight"))


def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    c = features.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", "i", F.round("mean", 6).alias("mean"))


def linear_head_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The class whose mean vector has the largest product with a vector."""
    e = table(spark, sf, "embeddings")
    c = features.centroids(e, "label", "embedding")
    head = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("weights"))
    out = features.linear_head(e, head)
    return out.select("vec_id", F.col("predicted").cast("int").alias("predicted"), F.round("score", 6).alias("score"))


def leakage_exact(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "hindi_intents").select("text", _split("split").alias("split"))
    return corpus.shared_texts(rows.where("split = 'train'"), rows.where("split in ('validation', 'test')"), "text")


def leakage_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a phrase of a fixed list."""
    phrases = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return docs.join(F.broadcast(phrases), F.col("t").contains(F.col("phrase"))).groupBy("phrase").agg(F.count_distinct("doc_id").alias("documents"))


def leakage_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain an evaluation question or a listed station's name in full."""
    asked = table(spark, sf, "hindi_intents").where(_split("split").isin("validation", "test")).select(F.lit("question").alias("kind"), F.col("id").alias("key"), "text")
    names = F.explode(F.concat(F.array("canonical_name_en", "canonical_name_hi"), F.coalesce("aliases", F.array().cast("array<string>"))))
    stations = table(spark, sf, "station_aliases").select(F.lit("station").alias("kind"), F.col("station_key").alias("key"), names.alias("text"))
    listed = materialise(asked.union(stations).select("kind", "key", normalised("text").alias("text")).distinct(), "listed")
    found = corpus.contained_texts(table(spark, sf, "documents"), "doc_id", "text", listed, "text")
    return found.join(listed, "text").groupBy("kind", "key").agg(F.count_distinct("doc_id").alias("documents"))


def family_split_check(spark: SparkSession, sf: str) -> DataFrame:
    """Families, as written, with rows in more than one split, as written."""
    return corpus.torn_groups(table(spark, sf, "hindi_intents").select(F.trim("family_id").alias("family"), _split("split").alias("split")).where("family like '%:%'"), "family", "split")


def family_split_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Families, whatever way they are written, with rows in more than one split."""
    rows = table(spark, sf, "hindi_intents").select(corpus.family_name("family_id", "intent").alias("family"), _split("split").alias("split"))
    return corpus.torn_groups(rows, "family", "split")


_TEMPLATES = [("route_query", 0, "{origin} se {destination} kaise jaun"), ("service_availability", 0, "{origin} aur {destination} ke beech bus hai"), ("ticketing", 0, "{origin} se {destination} ka ticket")]


def corpus_templates(spark: SparkSession, sf: str) -> DataFrame:
    hubs = table(spark, sf, "transport_hubs").select(F.col("hub_name").alias("name"))
    return corpus.generate(spark.createDataFrame(_TEMPLATES, "label string, family int, template string"), hubs, hubs)


def first_n_per_group_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """The first three training questions of each intent and language give way to authored ones."""
    rows = _rows(spark, sf).where("split = 'train'").select("id", "expected", "language", F.lit("delivered").alias("origin")).dropDuplicates(["id"])
    new = rows.select("expected", "language").distinct().select(F.concat(F.lit("authored_"), F.coalesce("expected", F.lit("none")), F.lit("_"), F.coalesce("language", F.lit("none"))).alias("id"), "expected", "language", F.lit("authored").alias("origin"))
    return corpus.replace_first(rows, ["expected", "language"], "id", 3, new).groupBy("expected", "language", "origin").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"))


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, class_prf, metrics_by_language, slot_scores, intent_baseline, document_frequency, ngram_frequency, char_ngrams, tfidf_top_terms, question_top_terms, mean_pool, linear_head_argmax, leakage_exact,
        leakage_contains, leakage_texts, family_split_check, family_split_leaks, corpus_templates, first_n_per_group_replaced,
    )
}
_SPLIT = "CASE WHEN lower(trim(split)) IN ('train', 'training') THEN 'train' WHEN lower(trim(split)) IN ('validation', 'val', 'dev') THEN 'validation' WHEN lower(trim(split)) = 'test' THEN 'test' END"
_RULES = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in RULES.items()) + " ELSE 'none' END"
_LABELS = "labels(label) AS (VALUES " + ", ".join(f"('{x}')" for x in LABELS) + ")"
_Q = f"""WITH q AS (SELECT DISTINCT id, text, intent, language, split FROM hindi_intents),
r AS (SELECT id, text, lower(trim(intent)) AS expected, language, {_SPLIT} AS split, {NORM_TEXT} AS t FROM q),
s AS (SELECT *, {_RULES} AS predicted FROM r WHERE expected IS NOT NULL AND t IS NOT NULL),
{_LABELS}
"""
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


def _class_sql(by: str = "") -> str:
    k = f"{by}, " if by else ""
    return f"""each AS (SELECT {k}expected AS label, 1 AS e, 0 AS g, CAST(expected = predicted AS INT) AS hit FROM s UNION ALL SELECT {k}predicted, 0, 1, 0 FROM s),
sums AS (SELECT {k}label, sum(hit) AS tp, sum(e) AS support, sum(g) AS given FROM each WHERE label IN (SELECT label FROM labels) GROUP BY ALL),
pr AS (SELECT *, CASE WHEN given > 0 THEN tp / given ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM sums),
f AS (SELECT *, {_F1} AS f1 FROM pr)"""


ORACLES = {
    "confusion_matrix": _Q + "SELECT a.label AS expected, b.label AS predicted, count(s.id) AS n FROM labels a CROSS JOIN labels b LEFT JOIN s ON s.expected = a.label AND s.predicted = b.label GROUP BY ALL",
    "class_prf": _Q + ", " + _class_sql() + " SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f",
    "metrics_by_language": _Q + ", " + _class_sql("language, split") + """, m AS (SELECT language, split, avg(f1) AS macro FROM f GROUP BY ALL),
a AS (SELECT language, split, count(*) AS n, avg(CAST(expected = predicted AS INT)) AS acc FROM s GROUP BY ALL)
SELECT a.language, a.split, n, round(acc, 6) AS accuracy, round(coalesce(macro, 0), 6) AS macro_f1 FROM a LEFT JOIN m ON m.language IS NOT DISTINCT FROM a.language AND m.split IS NOT DISTINCT FROM a.split""",
    "slot_scores": """WITH j AS (SELECT list_distinct(coalesce(a.aliases, [])) AS e, list_distinct(coalesce(b.aliases, [])) AS p FROM station_aliases a JOIN reviewed_name_aliases_v1 b ON a.canonical_name_en = b.canonical_name),
c AS (SELECT len(list_intersect(e, p)) AS tp, len(p) - len(list_intersect(e, p)) AS fp, len(e) - len(list_intersect(e, p)) AS fn FROM j),
t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(CAST(fp + fn = 0 AS INT)) AS exact FROM c),
u AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM t)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(""" + _F1 + ", 6) AS f1, round(exact, 6) AS exact FROM u",
    "document_frequency": r"""WITH q AS (SELECT DISTINCT id, regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g') AS t FROM hindi_intents),
g AS (SELECT id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) AS term FROM q WHERE length(t) >= 2)
SELECT term, count(DISTINCT id) AS df FROM g GROUP BY term""",
    "char_ngrams": r"""WITH q AS (SELECT DISTINCT id, text, regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g') AS t FROM hindi_intents),
g AS (SELECT id, n, unnest(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))) AS term FROM q, (VALUES (2), (3), (4), (5)) v(n) WHERE length(t) >= n)
SELECT id, CAST(n AS INT) AS n, count(*) AS grams, count(DISTINCT term) AS different FROM g GROUP BY ALL""",
    "tfidf_top_terms": r"""WITH q AS (SELECT DISTINCT entry_id, regexp_replace(lower(canonical_name), '[\s\p{Z}]+', ' ', 'g') AS t FROM reviewed_name_aliases_v1),
g AS (SELECT entry_id, unnest(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))) AS term FROM q, (VALUES (2), (3), (4), (5)) v(n) WHERE length(t) >= n),
c AS (SELECT entry_id, term, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT c.entry_id, c.term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT (entry_id, canonical_name)) FROM reviewed_name_aliases_v1)) / (1 + df)) + 1) AS w FROM c JOIN d ON c.term = d.term),
x AS (SELECT entry_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY entry_id)) AS weight FROM w)
SELECT entry_id, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY round(weight, 9) DESC, term) AS rank FROM x) WHERE rank <= 3""",
    "ngram_frequency": r"""WITH q AS (SELECT DISTINCT id, regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g') AS t FROM hindi_intents),
g AS (SELECT id, unnest(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))) AS term FROM q, (VALUES (2), (3), (4), (5)) v(n) WHERE length(t) >= n)
SELECT term, count(DISTINCT id) AS df FROM g GROUP BY term""",
    "question_top_terms": r"""WITH q AS (SELECT text, min(id) AS id, regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g') AS t FROM hindi_intents WHERE text IS NOT NULL GROUP BY text),
g AS (SELECT id, text, unnest(list_transform(range(1, length(t) - n + 2), lambda i: substr(t, i, n))) AS term FROM q, (VALUES (2), (3), (4), (5)) v(n) WHERE length(t) >= n),
c AS (SELECT id, text, term, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w AS (SELECT c.id, c.text, c.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM q)) / (1 + df)) + 1) AS w FROM c JOIN d ON c.term = d.term),
x AS (SELECT id, text, term, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS weight FROM w)
SELECT id, text, CAST(rank AS INT) AS rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(weight, 9) DESC, term) AS rank FROM x) WHERE rank <= 3""",
    "mean_pool": "SELECT label, CAST(i - 1 AS INT) AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL",
    "linear_head_argmax": """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY ALL), s AS (SELECT u.vec_id, c.label, sum(u.x * c.m) AS score FROM u JOIN c ON c.i = u.i GROUP BY ALL),
p AS (SELECT vec_id, label, score, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM s)
SELECT vec_id, CAST(arg_max(label, score) AS INT) AS predicted, round(max(e) / sum(e), 6) AS score FROM p GROUP BY vec_id""",
    "leakage_exact": f"WITH r AS (SELECT text, {_SPLIT} AS split FROM hindi_intents WHERE text IS NOT NULL) SELECT text FROM r WHERE split = 'train' INTERSECT SELECT text FROM r WHERE split IN ('validation', 'test')",
    "leakage_contains": "SELECT phrase, count(DISTINCT doc_id) AS documents FROM documents JOIN (VALUES " + ", ".join(f"('{p}')" for p in PHRASES) + ") v(phrase) ON contains(lower(text), phrase) GROUP BY phrase",
    "leakage_texts": f"""WITH l AS (SELECT 'question' AS kind, id AS key, text FROM hindi_intents WHERE {_SPLIT} IN ('validation', 'test')
  UNION ALL SELECT 'station', station_key, unnest(list_concat([canonical_name_en, canonical_name_hi], coalesce(aliases, []))) FROM station_aliases),
n AS (SELECT DISTINCT kind, key, {NORM.replace('{c}', 'text')} AS t FROM l), d AS (SELECT doc_id, ' ' || {NORM.replace('{c}', 'text')} || ' ' AS t FROM documents)
SELECT kind, key, count(DISTINCT doc_id) AS documents FROM n JOIN d ON contains(d.t, ' ' || n.t || ' ') WHERE n.t <> '' GROUP BY ALL""",
    "family_split_check": f"""WITH r AS (SELECT trim(family_id) AS family, {_SPLIT} AS split FROM hindi_intents WHERE contains(family_id, ':'))
SELECT family, count(DISTINCT split) AS splits, count(*) AS rows FROM r WHERE split IS NOT NULL GROUP BY family HAVING count(DISTINCT split) > 1""",
    "family_split_leaks": rf"""WITH b AS (SELECT lower(regexp_replace(family_id, '[\s\p{{Z}}\p{{Cf}}]+', '', 'g')) AS f, lower(regexp_replace(intent, '[\s\p{{Z}}\p{{Cf}}]+', '', 'g')) AS i, {_SPLIT} AS split FROM hindi_intents),
n AS (SELECT split, CASE WHEN regexp_matches(f, '^.+:[0-9]+$') THEN regexp_replace(f, ':[0-9]+$', '') WHEN regexp_matches(f, '^[0-9]+$') THEN i END AS name, regexp_replace(regexp_extract(f, '([0-9]+)$', 1), '^0+([0-9])', '\1') AS number FROM b)
SELECT name || ':' || number AS family, count(DISTINCT split) AS splits, count(*) AS rows FROM n WHERE split IS NOT NULL AND name <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    "corpus_templates": "WITH t(label, family, template) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in _TEMPLATES) + """)
SELECT label, family, o.hub_name AS origin, d.hub_name AS destination, replace(replace(template, '{origin}', o.hub_name), '{destination}', d.hub_name) AS text
FROM t, transport_hubs o, transport_hubs d WHERE o.hub_name <> d.hub_name""",
    "first_n_per_group_replaced": _Q + """, d AS (SELECT DISTINCT ON (id) id, expected, language FROM r WHERE split = 'train' ORDER BY id),
k AS (SELECT id, expected, language, 'delivered' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY expected, language ORDER BY id) AS rn FROM d) WHERE rn > 3
  UNION ALL SELECT DISTINCT 'authored_' || coalesce(expected, 'none') || '_' || coalesce(language, 'none'), expected, language, 'authored' FROM d)
SELECT expected, language, origin, count(*) AS rows, min(id) AS first_id FROM k GROUP BY ALL""",
}
