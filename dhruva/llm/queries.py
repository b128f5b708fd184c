"""Queries pN_... of the operators in this subpackage, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.llm.canonical_names import map_values
from dhruva.llm.chunking import split_oversized
from dhruva.llm.confusables import consistent_form, look_alike_classes, look_alike_pairs
from dhruva.llm.encoding import encode_corpus
from dhruva.llm.grouped_splits import assign_splits, family_key
from dhruva.llm.mixing import mix_sources
from dhruva.llm.overlap import cross_split_overlaps, split_name
from dhruva.session import materialise


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The reviewed entry that each typed alias means, -1 for none."""
    typed = _t(spark, sf, "chennai_case_study").select("id", F.posexplode("aliases").alias("alias_pos", "value")).where("id is not null").distinct()
    found = map_values(typed, _t(spark, sf, "reviewed_name_aliases_v1"))
    return typed.join(found, "value", "left").select("id", "alias_pos", F.coalesce("entry_id", F.lit(-1).cast("long")).alias("entry_id")).distinct()


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that mean no reviewed entry, with how often they were typed and how many entries they fit equally well."""
    typed = _t(spark, sf, "chennai_case_study").select("id", F.posexplode("aliases").alias("alias_pos", "value")).where("id is not null").distinct()
    none = map_values(typed, _t(spark, sf, "reviewed_name_aliases_v1")).where("entry_id is null").select("value", "fits")
    counts = typed.groupBy("value").agg(F.count("*").alias("typed"))
    return counts.join(none, "value", "left").where("fits is not null or value is null").select("value", "typed", F.coalesce("fits", F.lit(0)).alias("fits"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [_t(spark, sf, "hindi_intents").select(F.lit("intents").alias("corpus"), F.col("id").alias("key"), "text")]
    for table, key in (("station_aliases", "station_key"), ("reviewed_name_aliases_v1", "entry_id")):
        rows = _t(spark, sf, table).select(F.col(key).cast("string").alias("k"), F.posexplode("aliases").alias("pos", "text"))
        parts.append(rows.select(F.lit("aliases").alias("corpus"), F.concat_ws("/", F.lit(table), "k", F.col("pos").cast("string")).alias("key"), "text"))
    return parts[0].union(parts[1]).union(parts[2])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Question texts and aliases that look the same but are different strings."""
    return look_alike_pairs(_texts(spark, sf))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The same as one row per key: its class, and how many texts and keys the class has."""
    return look_alike_classes(_texts(spark, sf))


RATIOS = {"train": 0.70, "validation": 0.12, "test": 0.18}


def _recorded(rows: DataFrame) -> DataFrame:
    """The recorded splits are the component table so far: each family with each split it was recorded in."""
    node = F.concat(F.lit("family="), F.col("family"))
    known = rows.where("family is not null and recorded is not null")
    return known.select(node.alias("node"), F.concat_ws("@", "family", "recorded").alias("component"), F.col("recorded").alias("split")).distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Families that the recorded split tears apart; only families can be torn, so rows of one spelling are one row first."""
    spelt = _t(spark, sf, "hindi_intents").where("family_id is not null and split is not null").groupBy("family_id", "intent", "split").agg(F.count("*").alias("n"))
    rows = spelt.select(family_key("family_id", "intent").alias("family"), split_name("split").alias("recorded"), "n").where("family is not null and recorded is not null")
    rows = materialise(rows.groupBy("family", "recorded").agg(F.sum("n").alias("n")), "families")
    torn = assign_splits(rows, ["family"], RATIOS, _recorded(rows), row_key="family", weight="n").quarantine
    return torn.where("startswith(node, 'family=')").select(F.expr("substring(node, 8)").alias("family_id")).distinct()


def _questions(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    rows = _t(spark, sf, "hindi_intents").select("id", family_key("family_id", "intent").alias("family"), split_name("split").alias("recorded"), *more)
    return materialise(rows, "questions")


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every question with its split at 70/12/18 %; families in one recorded split keep it, torn ones are placed anew."""
    rows = _questions(spark, sf)
    return assign_splits(rows, ["family"], RATIOS, _recorded(rows), "reassign", row_key="id").records.select("id", "family", "recorded", "split")


def p3_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The questions in two batches, the later fifth second, kept together by family and by look-alike text.

    The component table of the first batch is written and read again; its components keep their split, and a question
    of the second batch that joins components of different splits is quarantined (null split).
    """
    rows = _questions(spark, sf, F.md5(consistent_form(spark, "text")).alias("twin"), "created_at")
    since = rows.agg(F.percentile_approx(F.col("created_at").cast("timestamp").cast("long"), 0.8)).first()[0]
    late = F.coalesce(F.col("created_at").cast("timestamp").cast("long") > F.lit(since), F.lit(False))
    rows = rows.withColumn("batch", F.when(late, 2).otherwise(1)).drop("created_at")
    before = assign_splits(rows.where("batch = 1"), ["family", "twin"], RATIOS, row_key="id")
    table = materialise(before.state, "component-table")
    after = assign_splits(rows.where("batch = 2"), ["family", "twin"], RATIOS, table, row_key="id")
    return before.records.unionByName(after.records).select("id", "family", "twin", "batch", "split")


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return cross_split_overlaps(_t(spark, sf, "hindi_intents"), "id", "text", "split")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of validation or test that are also, exactly or almost, in train."""
    return _overlaps(spark, sf).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation questions with a train partner, counted per split and source; a null source is a group of its own."""
    hit = _overlaps(spark, sf).groupBy("eval_id", "eval_split").agg(F.count("*").alias("links"), F.max("shared").alias("most"))
    source = _t(spark, sf, "hindi_intents").select(F.col("id").alias("eval_id"), "source").distinct()
    rows = hit.join(source, "eval_id").groupBy(F.col("eval_split").alias("split"), "source")
    return rows.agg(F.countDistinct("eval_id").alias("questions"), F.sum("links").alias("links"), F.sum(F.expr("int(most = 1)")).alias("exact"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(_t(spark, sf, "documents"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents selected for the mix and how often each is used."""
    return mix_sources(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets")).selection.withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached per source, with the sources that are too small or absent."""
    return mix_sources(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets")).shares


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of more than 1,000 tokens."""
    return split_oversized(_t(spark, sf, "documents"), with_text=False).select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of those documents, of at most 1,000 tokens, consecutive ones sharing 50."""
    return split_oversized(_t(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_classes, p3_found, p3_splits, p3_batches, p5_found, p5_report, p7_ids, p8_mix, p8_shares, p9_found, p9_pieces)}
ORACLES: dict[str, str] = {
    "p3_found": r"""WITH k AS (
  SELECT lower(regexp_replace(family_id, '\s', '', 'g')) AS f, lower(regexp_replace(intent, '\s', '', 'g')) AS i, lower(trim(split)) AS s
  FROM hindi_intents WHERE family_id IS NOT NULL AND split IS NOT NULL),
n AS (
  SELECT CASE WHEN f LIKE '%:%' THEN split_part(f, ':', 1) || ':' || CAST(CAST(split_part(f, ':', 2) AS BIGINT) AS VARCHAR)
    ELSE i || ':' || CAST(CAST(f AS BIGINT) AS VARCHAR) END AS family_id,
    CASE WHEN s IN ('train', 'training') THEN 'train' WHEN s = 'test' THEN 'test' WHEN s IN ('validation', 'val', 'dev') THEN 'validation' END AS s FROM k)
SELECT family_id FROM n WHERE family_id IS NOT NULL GROUP BY family_id HAVING count(DISTINCT s) > 1""",
}
