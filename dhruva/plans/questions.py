"""Queries over the slots of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.operators.questions import question_slots, with_published
from dhruva.operators.topology import route_key
from dhruva.schema import network, table
from dhruva.session import spread


def _slots(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "hindi_intents").select("id", "text", F.lower(F.trim("intent")).alias("intent")).where("id is not null").distinct()
    codes = network(spark, sf).routes.where("status = 'operational'").select(route_key("route_short_name").alias("code")).where("code != ''")
    return spread(with_published(q, "id", "text", codes)).withColumn("s", question_slots("text", "published")).select("id", "intent", "s.*")


def slot_extract(spark: SparkSession, sf: str) -> DataFrame:
    """All slots of every question."""
    rows = _slots(spark, sf)
    return rows.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes)).distinct()


def question_goals(spark: SparkSession, sf: str) -> DataFrame:
    """Goals that questions ask for and goals that they deny, per recorded intent."""
    rows = _slots(spark, sf)
    each = rows.select("id", "intent", F.explode("goals").alias("goal"), F.lit(True).alias("wanted")).union(rows.select("id", "intent", F.explode("denied_goals"), F.lit(False)))
    return each.groupBy("intent", "goal", "wanted").agg(F.count_distinct("id").alias("questions"))


def route_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Route codes in questions, with how many published routes carry the code."""
    codes = _slots(spark, sf).where("route_number is not null").groupBy("route_number").agg(F.count_distinct("id").alias("questions"))
    known = network(spark, sf).routes.select(F.upper(F.regexp_replace("route_short_name", "[ -]", "")).alias("route_number"), "route_id").groupBy("route_number").agg(F.count_distinct("route_id").alias("routes"))
    return codes.join(known, "route_number", "left").select("route_number", "questions", F.coalesce("routes", F.lit(0)).alias("routes"))


def answer_status(spark: SparkSession, sf: str) -> DataFrame:
    """How questions can be answered: never from missing or ambiguous data."""
    rows = _slots(spark, sf)
    status = (
        F.when(F.col("intent").isNull(), "clarification").when(F.col("intent") == "out_of_scope", "out_of_scope").when(F.col("intent").isin("train_status", "ticketing"), "unavailable")
        .when(F.col("intent") == "railway_complaint", "information").when(F.col("clarification").isNotNull() | (F.size("excluded_modes") > 0), "clarification").otherwise("lookup")
    )
    return rows.groupBy("intent", status.alias("status")).agg(F.count_distinct("id").alias("questions"))


QUERIES = {f.__name__: f for f in (slot_extract, question_goals, route_scope, answer_status)}
ORACLES: dict[str, str] = {}
