"""Problem 4: references to records that do not exist, or not yet, or no more, when the referring row arrives."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dhruva.session import materialise


def id_key(column: Column | str) -> Column:
    """Ids compare without letter case and surrounding blanks; null and blank ids are no reference."""
    column = F.col(column) if isinstance(column, str) else column
    key = F.upper(F.regexp_replace(column.cast("string"), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    return F.when(key != "", key)


@dataclass(frozen=True)
class Parent:
    """A table that references may point to; without ``since`` its records exist always."""

    name: str
    rows: DataFrame
    key: str
    since: str | None = None
    until: str | None = None


def _lifetimes(parents: Mapping[str, Parent]) -> DataFrame:
    """Merged lifetimes of each key: ``(parent, key, lives array<struct<since, until>>)``; overlapping ones become one.

    Null ``since`` is unknown and means from ever; null ``until`` means still there; a lifetime that ends before it
    begins holds no moment. Repeated rows fall together before they are collected.
    """
    out = None
    for p in parents.values():
        low, high = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
        since = F.coalesce(F.col(p.since).cast("timestamp_ntz"), low) if p.since else low
        until = F.coalesce(F.col(p.until).cast("timestamp_ntz"), high) if p.until else high
        rows = p.rows.select(F.lit(p.name).alias("parent"), id_key(p.key).alias("key"), since.alias("since"), until.alias("until"))
        out = rows if out is None else out.union(rows)
    return (
        out.where("key is not null and since < until")
        .groupBy("parent", "key")
        .agg(F.collect_set(F.struct("since", "until")).alias("lives"), F.min("since").alias("first"), F.max("until").alias("last"), F.count_distinct("since", "until").alias("n"))
    )


def orphan_references(refs: DataFrame, parents: Mapping[str, Parent]) -> DataFrame:
    """Rows of ``refs`` whose parent has no record at the row's moment.

    ``refs`` has ``parent`` (a name in ``parents``), ``key`` (normalised id, null for none) and ``at`` (timestamp, null
    means the reference must merely exist at any time); its other columns come along. A row whose ``parent`` is
    null or not a known table is an orphan. Null keys are no references. Repeated rows are all returned.

    Distinct keys with their first and last moment (a map-side aggregate, so a hot key is one row) are anti-joined
    with the parents' keys: keys without any record and keys that a single lifetime does not cover remain. They are
    written once; only rows of these keys are looked at again. While the written table is small enough for Spark to send
    it to the executors (its own bound on the size of files), rows are not shuffled at all.
    """
    refs = refs.where("key is not null")
    lives = _lifetimes(parents)
    keys = refs.groupBy("parent", "key").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    covered = lives.where("n = 1").select(F.col("parent").alias("__p"), F.col("key").alias("__k"), "first", "last")
    same = (F.col("parent") == F.col("__p")) & (F.col("key") == F.col("__k"))
    doubtful = keys.join(covered, same & F.expr("lo is null or (lo >= first and hi < last)"), "left_anti")
    doubtful = doubtful.join(lives.select("parent", "key", "lives"), ["parent", "key"], "left").select(
        F.col("parent").alias("__p"), F.col("key").alias("__k"), F.col("lives").alias("__lives")
    )
    doubtful = materialise(doubtful, "doubtful")
    alive = F.exists("__lives", lambda x: F.col("at").isNull() | ((x["since"] <= F.col("at")) & (F.col("at") < x["until"])))
    rows = refs.join(doubtful, F.col("parent").eqNullSafe(F.col("__p")) & (F.col("key") == F.col("__k")))
    return rows.where(F.col("__lives").isNull() | ~alive).drop("__p", "__k", "__lives")


def orphan_counts(refs: DataFrame, parents: Mapping[str, Parent], period: str) -> DataFrame:
    """Orphans and references per referenced table and ``period`` (a column of ``refs``); 0 where all resolve."""
    all_refs = refs.where("key is not null").groupBy("parent", period).agg(F.count("*").alias("references"))
    orphans = orphan_references(refs, parents).groupBy("parent", period).agg(F.count("*").alias("orphans"), F.count_distinct("key").alias("missing_keys"))
    a, b = all_refs.alias("a"), orphans.alias("b")
    on = F.col("a.parent").eqNullSafe(F.col("b.parent")) & F.col(f"a.{period}").eqNullSafe(F.col(f"b.{period}"))
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0)).alias(c)
    return a.join(b, on, "left").select("a.parent", f"a.{period}", "a.references", zero("orphans"), zero("missing_keys"))
