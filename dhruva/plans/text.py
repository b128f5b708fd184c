"""Queries over question texts and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.functions import text as tx
from dhruva.operators.topology import route_key
from dhruva.schema import table


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hindi_intents").select("id", "text", "intent", "language", "split").distinct()


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("id", tx.normalised("text").alias("normalised")).distinct()


def route_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "transport_routes").select("route_id", route_key("route_short_name").alias("route_key")).distinct()


def ascii_digits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _questions(spark, sf).where(F.col("text").rlike(f"[{tx.DIGITS}]"))
    return rows.select("id", tx.ascii_digits("text").alias("text")).distinct()


def one_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Words one edit away from a word that decides something: similarity only asks back, it never chooses."""
    words = _questions(spark, sf).select(F.explode(F.split(tx.normalised("text"), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("times")).where(F.col("word").rlike("^[a-z]{4,}$"))
    near = words.withColumn("near", F.explode(tx.one_edit(F.col("word"), ["local", "booking", "counter", "number", "station", "token", "kitna", "khadi"])))
    return near.select("word", "near", "times")


def word_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Mode words under both notions of a boundary."""
    t = _questions(spark, sf).select(tx.normalised("text").alias("t"))
    counts = []
    for mode, words in tx.MODES.items():
        for marks in (True, False):
            counts.append(F.count_if(tx.has_word(F.col("t"), "|".join(words), marks)).alias(f"{mode}_{'marks' if marks else 'plain'}"))
    return t.agg(*counts)


def keyword_slots(spark: SparkSession, sf: str) -> DataFrame:
    rows = _questions(spark, sf).select("id", tx.normalised("text").alias("t"))
    return rows.select("id", tx.first_kind(F.col("t"), tx.INFORMATION).alias("information_type"), tx.first_kind(F.col("t"), tx.ACCESSIBILITY).alias("accessibility_feature"), tx.first_kind(F.col("t"), tx.STATION_DETAIL).alias("station_detail"), tx.first_kind(F.col("t"), tx.COMPLAINT).alias("complaint_type")).distinct()


def goal_cues(spark: SparkSession, sf: str) -> DataFrame:
    rows = _questions(spark, sf).select(F.lower(F.trim("intent")).alias("intent"), tx.normalised("text").alias("t"))
    return rows.groupBy("intent").agg(*(F.count_if(tx.has_word(F.col("t"), p)).alias(g) for g, p in tx.GOALS.items()))


def enum_first_hit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _questions(spark, sf).select(tx.normalised("text").alias("t"))
    return rows.groupBy(tx.first_enum(F.col("t"), tx.MODES).alias("first_mode")).agg(F.count("*").alias("questions"))


def requested_modes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _questions(spark, sf).select("id", tx.normalised("text").alias("t"))
    return rows.select("id", F.array_join(tx.modes(F.col("t")), ",").alias("modes")).distinct()


def qualified_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with a qualifier after a comma: the bare name needs qualification."""
    base, rest = tx.qualifier("name_en")
    return table(spark, sf, "chennai_case_study").where("name_en like '%,%'").select("id", base.alias("bare"), rest.alias("qualifier")).distinct()


QUERIES = {
    f.__name__: f for f in (normalize_text, route_keys, ascii_digits, one_edit, word_boundaries, keyword_slots, goal_cues, enum_first_hit, requested_modes, qualified_names)
}
_P = "[" + tx.PUNCTUATION.replace("'", "''") + "]+"
NORM = f"trim(regexp_replace(regexp_replace(lower(nfc_normalize({{c}})), '{_P}', ' ', 'g'), '[{tx.BLANK}]+', ' ', 'g'))"
NORM_TEXT = NORM.replace("{c}", "text")
_Q = f"WITH q AS (SELECT DISTINCT id, text, intent, language, split FROM hindi_intents), n AS (SELECT *, {NORM_TEXT} AS t FROM q)\n"


def _word_sql(pattern: str, marks: bool = True) -> str:
    """RE2 has no look-behind: the boundary is a consumed character or the text's edge."""
    w = tx.MARK_WORD if marks else tx.PLAIN_WORD
    return f"regexp_matches(t, '(^|[^{w}])(?:{pattern})($|[^{w}])')"


def _kind_sql(table_: dict, whole: bool = False) -> str:
    parts = []
    for kind, words in table_.items():
        test = _word_sql("|".join(words)) if whole else " OR ".join(f"contains(t, '{w}')" for w in words)
        parts.append(f"WHEN {test} THEN '{kind}'")
    return "CASE " + " ".join(parts) + " END"


_RAIL = "|".join(tx.MODES["rail"])
_BARE = rf"regexp_replace(t, '(?:{_RAIL})\s+(?:station|स्टेशन)|(?:metro|mrts|मेट्रो|एमआरटीएस)\s+(?:\S+\s+){{0,2}}(?:train|ट्रेन)', ' ', 'g')"
ORACLES = {
    "normalize_text": _Q + "SELECT DISTINCT id, t AS normalised FROM n",
    "route_keys": "SELECT DISTINCT route_id, upper(regexp_replace(route_short_name, '[ -]', '', 'g')) AS route_key FROM transport_routes",
    "ascii_digits": _Q + f"SELECT DISTINCT id, translate(text, '{tx.DIGITS}', '{'0123456789' * (len(tx.DIGITS) // 10)}') AS text FROM q WHERE regexp_matches(text, '[{tx.DIGITS}]')",
    "one_edit": _Q + """, w AS (SELECT word, count(*) AS times FROM (SELECT unnest(string_split(t, ' ')) AS word FROM n) GROUP BY word)
SELECT word, k AS near, times FROM w JOIN (VALUES ('local'), ('booking'), ('counter'), ('number'), ('station'), ('token'), ('kitna'), ('khadi')) v(k) ON levenshtein(word, k) = 1 WHERE regexp_matches(word, '^[a-z]{4,}$')""",
    "word_boundaries": _Q + "SELECT " + ", ".join(f"count(*) FILTER ({_word_sql('|'.join(words), m)}) AS {mode}_{'marks' if m else 'plain'}" for mode, words in tx.MODES.items() for m in (True, False)) + " FROM n",
    "keyword_slots": _Q + f"SELECT DISTINCT id, {_kind_sql(tx.INFORMATION)} AS information_type, {_kind_sql(tx.ACCESSIBILITY)} AS accessibility_feature, {_kind_sql(tx.STATION_DETAIL)} AS station_detail, {_kind_sql(tx.COMPLAINT)} AS complaint_type FROM n",
    "goal_cues": _Q + "SELECT lower(trim(intent)) AS intent, " + ", ".join(f"count(*) FILTER ({_word_sql(p)}) AS {g}" for g, p in tx.GOALS.items()) + " FROM n GROUP BY 1",
    "enum_first_hit": _Q + f"SELECT {_kind_sql(tx.MODES, True)} AS first_mode, count(*) AS questions FROM n GROUP BY 1",
    "requested_modes": _Q + "SELECT DISTINCT id, CASE WHEN t IS NOT NULL THEN concat_ws(',', " + ", ".join(
        f"CASE WHEN {_word_sql('|'.join(words)).replace('(t,', '(' + (_BARE if mode == 'rail' else 't') + ',')} THEN '{mode}' END" for mode, words in tx.MODES.items()
    ) + ") ELSE '' END AS modes FROM n",
    "qualified_names": """SELECT DISTINCT id, trim(split_part(name_en, ',', 1)) AS bare, nullif(trim(substr(name_en, strpos(name_en, ',') + 1)), '') AS qualifier FROM chennai_case_study WHERE contains(name_en, ',')""",
}
