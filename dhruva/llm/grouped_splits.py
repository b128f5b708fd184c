"""Problem 3: splits that keep related records together.

Records that share a key (author, source, entity ...) belong together, also through other records. Components of
keys are found by hooking each component to the least one it touches and pointer jumping; every round contracts the
edges to those between components, writes both tables to the shared folder and reads them back. The component table
persists: a later batch starts from it, existing components keep their split, new ones fill what the splits lack,
and components that were given different splits before and now turn out to belong together are quarantined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dhruva.operators.prefix import running_total
from dhruva.session import materialise

#: New components that hold more than this part of the new records are placed one by one, largest first; there are
#: at most 1 / LARGE of them. The others are laid out along a line in hash order and cut at the splits' deficits.
LARGE = 0.001


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``; a component is named by its least node."""
    edges = materialise(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    parent = materialise(nodes.select("node", F.col("node").alias("root")), "parents")
    live = edges.where("a != b")
    while not live.isEmpty():
        # Hook: the roots in `live` point to the least root they touch ...
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a").select(F.col("a").alias("root"), F.col("b").alias("to"))
        hooks = materialise(hooks, "hooks")
        # ... and chains of such pointers are halved until they are flat.
        while True:
            nxt = hooks.select(F.col("root").alias("to"), F.col("to").alias("far"))
            jumped = materialise(hooks.join(nxt, "to", "left").select("root", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        parent = materialise(parent.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "parents")
        left = hooks.select(F.col("root").alias("a"), F.col("to").alias("to_a"))
        right = hooks.select(F.col("root").alias("b"), F.col("to").alias("to_b"))
        contracted = live.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        live = materialise(contracted.where("a != b").distinct(), "edges")
    return parent.select("node", F.col("root").alias("component"))


@dataclass
class Splits:
    """What an assignment returns; the new splits are worked out when they are first asked for."""

    records_in: DataFrame
    anchor: Column
    member: DataFrame  # (node, component) of all keys
    known: DataFrame  # (component, splits): what parts of a component were given before
    sizes: Callable[[], DataFrame]
    ratios: dict[str, float]
    conflicts: str

    @cached_property
    def _placed(self) -> DataFrame:
        sizes = materialise(self.sizes(), "sizes")
        fixed = sizes.where("size(splits) = 1").select("component", "n", F.element_at("splits", 1).alias("split"))
        fresh = sizes.where("splits is null" if self.conflicts == "quarantine" else "splits is null or size(splits) > 1").select("component", "n")
        held = self.known.where("size(splits) = 1").select("component", F.element_at("splits", 1).alias("split"))
        split_of = held.union(_fill(self.records_in.sparkSession, fresh, fixed, self.ratios))
        return materialise(self.member.join(split_of, "component", "left"), "placed")

    @property
    def records(self) -> DataFrame:
        """The input rows with ``component`` and ``split`` (null while quarantined)."""
        rows = self.records_in.withColumn("__node", self.anchor)
        where_to = self._placed.select(F.col("node").alias("__node"), F.col("component").alias("__component"), F.col("split").alias("__split"))
        drop = [c for c in ("component", "split") if c in rows.columns]
        return rows.join(where_to, "__node", "left").drop("__node", *drop).withColumnsRenamed({"__component": "component", "__split": "split"})

    @property
    def state(self) -> DataFrame:
        """The component table to persist: ``(node, component, split)``."""
        return self._placed.where("not startswith(node, 'component=')").select("node", "component", "split")

    @property
    def quarantine(self) -> DataFrame:
        """``(node, component, splits)`` of components whose parts were in different splits."""
        nodes = self.member.where("not startswith(node, 'component=')")
        return nodes.join(self.known.where("size(splits) > 1"), "component").select("node", "component", "splits")


def _node(key: str) -> Column:
    """Nodes are named by column and value, so equal values of different columns stay apart."""
    return F.when(F.col(key).isNotNull(), F.concat(F.lit(f"{key}="), F.col(key).cast("string")))


def assign_splits(
    records: DataFrame, keys: list[str], ratios: dict[str, float], state: DataFrame | None = None, conflicts: str = "quarantine", row_key: str | None = None, weight: str | None = None
) -> Splits:
    """Splits in the given ratios of rows, with all rows that share a value of any of ``keys`` in one split.

    ``state`` is the component table of earlier batches, rows ``(node, component, split)``; a null split means not yet
    placed. A record without any key is its own component, named by ``row_key`` (then required), or by all of
    its columns. ``weight`` names a column with the number of records a row stands for. ``conflicts``: "quarantine" leaves the rows of torn components without a split, "reassign" places
    each such component anew as a whole. Null keys link nothing; repeated rows count as often as they come; an
    empty table gives empty results.
    """
    if conflicts not in ("quarantine", "reassign"):
        raise ValueError("conflicts is quarantine or reassign")
    spark = records.sparkSession
    own = F.col(row_key).cast("string") if row_key else F.sha2(F.to_json(F.struct(*records.columns)), 256)
    anchor = F.coalesce(*(_node(k) for k in keys), F.concat(F.lit("row="), F.coalesce(own, F.lit(""))))
    # Records with the same keys are one row from here on.
    names = [f"k{i}" for i in range(len(keys))]
    amount = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1)
    first = records.select(anchor.alias("a"), *(_node(k).alias(n) for k, n in zip(keys, names)), amount.alias("n"))
    first = materialise(first.groupBy("a", *names).agg(F.sum("n").alias("n")), "links")
    edges = first.select("a", F.col("a").alias("b"))
    for i in range(len(keys)):
        edges = edges.union(first.select("a", F.col(f"k{i}")).where(f"k{i} is not null"))
    old = None
    if state is not None:
        # A component of the table is a node too: what it held is linked to it, and it carries the split.
        old = state.select("node", F.concat(F.lit("component="), F.col("component")).alias("c"), "split")
        edges = edges.union(old.select("node", "c"))
    # A component keeps its name: the mark of table rows is not part of it.
    found = components(edges).withColumn("component", F.regexp_replace("component", "^component=", ""))
    member = materialise(found, "components")
    if old is None:
        known = spark.createDataFrame([], "component string, splits array<string>")
    else:
        given = old.join(member, "node").where("split is not null")
        known = given.groupBy("component").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    known = materialise(known, "known")

    def sizes() -> DataFrame:
        rows = first.select(F.col("a").alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n")).join(member, "node")
        return rows.groupBy("component").agg(F.sum("n").alias("n")).join(known, "component", "left")

    return Splits(records, anchor, member, known, sizes, ratios, conflicts)


def _fill(spark: SparkSession, fresh: DataFrame, fixed: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """``(component, split)`` of components without a split, so that the splits get nearest to their ratios."""
    held = {r["split"]: r["n"] for r in fixed.groupBy("split").agg(F.sum("n").alias("n")).collect()}
    new = fresh.agg(F.sum("n")).first()[0] or 0
    total = new + sum(held.values())
    lack = {s: max(0.0, r * total - held.get(s, 0)) for s, r in ratios.items()}
    large = [(r["component"], r["n"]) for r in fresh.where(F.col("n") > LARGE * new).collect()]
    out = []
    for component, n in sorted(large, key=lambda x: (-x[1], x[0])):
        split = max(lack, key=lambda s: lack[s])
        lack[split] -= n
        out.append((component, split))
    chosen = spark.createDataFrame(out, "component string, split string")
    lack = {s: max(0.0, x) for s, x in lack.items()}
    small = fresh.where(F.col("n") <= LARGE * new).withColumn("h", F.xxhash64("component"))
    line = running_total(small, "n", ["h", "component"])
    scale = (new - sum(n for _, n in large)) / (sum(lack.values()) or 1.0)
    split, upto = F.lit(None).cast("string"), 0.0
    bounds = []
    for name, x in lack.items():
        upto += x * scale
        if x > 0:
            bounds.append((name, upto))
    for name, end in reversed(bounds):
        split = F.lit(name) if (name, end) == bounds[-1] else F.when(F.col("running") - F.col("n") / 2 <= end, name).otherwise(split)
    return chosen.union(line.select("component", split.alias("split")))


def family_key(family: str, intent: str) -> Column:
    """A family as ``intent:number`` in lower case without blanks or leading zeros; null for what is no family."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s\p{Z}\p{Cf}]+", ""))
    f = bare(family)
    number = F.regexp_replace(F.regexp_extract(f, r"(\d+)$", 1), r"^0+(?=\d)", "")
    name = F.when(f.rlike(r"^.+:\d+$"), F.regexp_extract(f, r"^(.+):\d+$", 1)).when(f.rlike(r"^\d+$"), bare(intent))
    return F.when(name != "", F.concat_ws(":", name, number))
