"""Record-level operators: fallbacks, conflicts, quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dhruva.operators.proximity import EARTH, great_circle


def first_of(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Union of candidates by source, keeping for each key those of the first source that has any."""
    rows = reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(kind)).withColumn("priority", F.lit(i)) for i, (kind, df) in enumerate(parts)))
    best = rows.withColumn("top", F.min("priority").over(Window.partitionBy(key)))
    return best.where("priority = top").drop("priority", "top")


def conflicting(rows: DataFrame, metres: float) -> DataFrame:
    """Rows ``(id, name, source, lat, lon)`` whose name another source puts more than ``metres`` away.

    Names of one source, and names all of whose positions lie within ``metres`` along a meridian and a parallel, have no
    conflict and are left out by an aggregate. For the others a semi join stops at the first conflict of a row and makes
    no pairs; as they are spread out, it stops early.
    """
    way = F.lit(EARTH) * F.radians(F.max("lat") - F.min("lat") + F.max("lon") - F.min("lon"))
    torn = rows.groupBy("name").agg((F.min("source") != F.max("source")).alias("several"), way.alias("way")).where((F.col("way") > metres) & F.col("several")).select("name")
    rows = rows.join(torn, "name", "left_semi").select(*rows.columns)
    other = rows.select(F.col("name").alias("n"), F.col("source").alias("s"), F.col("lat").alias("y"), F.col("lon").alias("x")).distinct()
    far = great_circle("lat", "lon", "y", "x") > metres
    return rows.join(other, (F.col("name") == F.col("n")) & (F.col("source") != F.col("s")) & far, "left_semi")


def check(name: str, failures: DataFrame) -> DataFrame:
    """One row ``(check_name, passed, failures)`` of a quality check; ``failures`` are the offending rows."""
    return failures.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check_name"), (F.col("failures") == 0).alias("passed"), "failures")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
