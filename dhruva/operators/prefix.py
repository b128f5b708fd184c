"""Running totals over rows too many for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dhruva.session import materialise


def _ranges(df: DataFrame, value: Column, order: list[str], group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows range-partitioned by group and order with their ``__part``, and ``(__part, group, __sum, __start)`` of each part."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Groups and order are range bounds together: the partition number grows with them.
    rows = materialise(df.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0)))


def _with_start(rows: DataFrame, starts: DataFrame, group: list[str]) -> DataFrame:
    """Rows with what their part knows; one row per partition and group that meet: at most partitions + groups are sent."""
    same = rows["__part"] == starts["__part"]
    for g in group:
        same = same & rows[g].eqNullSafe(starts[g])
    return rows.join(F.broadcast(starts), same).select(rows["*"], starts["__start"])


def _within(order: list[str], group: list[str]):
    return Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_total(df: DataFrame, value: str, order: list[str], group: list[str] | None = None, name: str = "running") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to and with each row, by ``order`` within ``group``.

    Rows are range-partitioned by group and order, so a hot group spans many tasks. Each partition is summed, the
    sums before it are added up from one small row per partition and group, and only then rows are accumulated
    within their partition. ``order`` should make rows distinct; nulls in ``value`` count as 0.
    """
    group = group or []
    amount = F.coalesce(F.col(value), F.lit(0))
    rows, starts = _ranges(df, amount, order, group)
    joined = _with_start(rows, starts.drop("__sum"), group)
    return joined.withColumn(name, F.sum(amount).over(_within(order, group)) + F.col("__start")).drop("__part", "__start")


def front(df: DataFrame, value: str, order: list[str], group: list[str], limit: str) -> DataFrame:
    """The rows of each group, by ``order``, up to where the sum of ``value`` (not negative) would pass ``limit``.

    ``limit`` is a column with one value per group. As ``running_total``, but only the one part of a group that holds the
    limit is accumulated; parts before it come whole, parts behind it not at all.
    """
    amount = F.coalesce(F.col(value), F.lit(0))
    rows, starts = _ranges(df, amount, order, group)
    limits = df.select(*group, F.col(limit).alias("__limit")).dropDuplicates(group)
    same = None
    for g in group:
        same = starts[g].eqNullSafe(limits[g]) if same is None else same & starts[g].eqNullSafe(limits[g])
    known = starts.join(limits, same).select(starts["*"], "__limit")
    whole = _with_start(rows, known.where("__start + __sum <= __limit").drop("__sum", "__limit"), group)
    part = _with_start(rows, known.where("__start + __sum > __limit and __start <= __limit").drop("__sum", "__limit"), group)
    part = part.withColumn("__running", F.sum(amount).over(_within(order, group)) + F.col("__start")).where(F.col("__running") <= F.col(limit))
    return whole.select(*df.columns).union(part.select(*df.columns))
