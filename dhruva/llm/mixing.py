"""Problem 8: mixing sources to target weights by Pareto order sampling.

Each source gets a budget of tokens. Whole copies that the budget certainly allows are taken of every document; the
rest is a sample without replacement: documents are ranked by the odds of a uniform random number divided by the
odds of their inclusion probability, and taken from the front until the budget is met. Inclusion is unequal where
single documents are large against what is still to be filled: their expected share of it stays bounded.

The ranking is followed to its end: a document that does not fit any more is passed over, the next that fits is taken,
and a budget is never passed. Where a source is still short then, the documents around the end of its budget are
chosen anew so that their sum comes near enough.

Random numbers are hashes of the document id and a seed, so a rerun, or a lost executor, changes nothing. Nothing
is ranked in one task: budgets are cut on a distributed running total, only the few documents that fill a last gap
are looked at on the driver, a block at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dhruva.llm.encoding import RANKS, token_counts
from dhruva.operators.prefix import front
from dhruva.session import materialise

#: No document is expected to fill more than this part of what remains to be sampled from its source, relative to
#: a small one.
MOST = 0.05
#: A source this near to its budget (as a part of it) is met.
CLOSE = 0.005
#: Documents that are looked at on the driver at a time, of all sources together, to fill what a budget has left.
BLOCK = 100_000
#: Documents of a source on each side of the budget's end from which a better choice is made where a source is short.
POOL = 64
BITS_OF_BUDGET = 4_000_000
#: Sizes are summed in bins this much apart (factor) to solve for inclusion probabilities.
BIN = 1.02


@dataclass
class Mix:
    selection: DataFrame  # (id, source, tokens, copies), copies >= 1
    shares: DataFrame  # one row per source of the targets or the documents


def _inclusion(sizes: np.ndarray, counts: np.ndarray, rest: float) -> float:
    """c such that the expected tokens of inclusion probabilities min(1, c w) are ``rest``; w = min(1, MOST rest / size)."""
    w = np.minimum(1.0, MOST * rest / np.maximum(sizes, 1e-9))
    tokens = sizes * counts
    low, high = 0.0, 1.0
    while (tokens * np.minimum(1, high * w)).sum() < rest and high < 1e12:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (tokens * np.minimum(1, mid * w)).sum() < rest else (low, mid)
    return high


def choose(sizes: list[int], budget: int, enough: float) -> list[int]:
    """Positions of sizes whose sum comes nearest to ``budget`` without passing it; of all that leave at most ``enough``, the first in order.

    Subset sums as bits of whole numbers, from the last size to the first; large budgets are counted in units, sizes
    rounded up, so that none is passed.
    """
    unit = max(1, budget // BITS_OF_BUDGET)
    sizes, top = [-(-t // unit) for t in sizes], budget // unit
    mask = (1 << (top + 1)) - 1
    after = [1]
    for t in reversed(sizes):
        after.append(after[-1] | (after[-1] << t & mask) if t <= top else after[-1])
    after.reverse()
    low = min(after[0].bit_length() - 1, max(0, top - int(enough // unit)))
    out, high = [], top
    for i, t in enumerate(sizes):
        # Can what is behind still bring the sum into reach if this one is taken?
        if t <= high and (after[i + 1] & ((1 << (high - t + 1)) - 1)) >> max(0, low - t):
            out.append(i)
            low, high = max(0, low - t), high - t
    return out


def _fill(drawn: DataFrame, plan: dict[str, tuple[float, float]]) -> DataFrame:
    """``(id, source, tokens)`` drawn from ``drawn(id, source, tokens, rest, q)``: for each source the ranking by ``q`` as far as its budget goes.

    ``plan``: source to (budget, what counts as met). Equal to going through the whole ranking one by one and taking
    what still fits, then choosing around the end anew.
    """
    spark = drawn.sparkSession
    taken = materialise(front(drawn, "tokens", ["q", "id"], ["source"], "rest").select("id", "source", "tokens", "q"), "taken")
    more: list[tuple] = []
    filled = {r["source"]: r for r in taken.groupBy("source").agg(F.sum("tokens").alias("t"), F.max(F.struct("q", "id")).alias("last")).collect()}
    gap = {s: int(rest) - (filled[s]["t"] if s in filled else 0) for s, (rest, _) in plan.items()}
    last = {s: (filled[s]["last"]["q"], filled[s]["last"]["id"]) if s in filled else (-1.0, None) for s in plan}
    live = {s for s in plan if gap[s] > 0}
    schema = f"source string, gap long, lq double, lid {drawn.schema['id'].dataType.simpleString()}"
    while live:
        k = max(1, BLOCK // len(live))
        todo = spark.createDataFrame([(s, gap[s], *last[s]) for s in sorted(live)], schema)
        rest = drawn.select("id", "source", "tokens", "q").join(F.broadcast(todo), "source").where("tokens <= gap and (lq < 0 or q > lq or (q = lq and id > lid))")
        block = rest.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("q", "id"))).where(F.col("n") <= k)
        seen: dict[str, int] = {}
        for r in sorted(block.select("source", "q", "id", "tokens").collect(), key=lambda r: (r["source"], r["q"], r["id"])):
            s = r["source"]
            seen[s] = seen.get(s, 0) + 1
            last[s] = (r["q"], r["id"])
            if r["tokens"] <= gap[s]:
                gap[s] -= r["tokens"]
                more.append((r["id"], s, r["tokens"], r["q"]))
        live = {s for s in live if gap[s] > 0 and seen.get(s, 0) == k}
    taken = taken.union(spark.createDataFrame(more, taken.schema))
    short = {s: gap[s] for s, (_, enough) in plan.items() if gap[s] > enough}
    if not short:
        return taken.drop("q")
    # Of those drawn last and those that would have come next, the choice that comes near enough.
    k = max(1, min(POOL, BLOCK // (2 * len(short))))
    todo = F.broadcast(spark.createDataFrame(list(short.items()), "source string, gap long"))
    some = lambda df, *order: df.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("n") <= k).select("source", "tokens", "id", "q").collect()
    mine = some(taken.join(todo, "source"), F.col("q").desc(), F.col("id").desc())
    room = {s: short[s] + sum(r["tokens"] for r in mine if r["source"] == s) for s in short}
    rooms = F.broadcast(spark.createDataFrame(list(room.items()), "source string, room long"))
    other = some(drawn.select("id", "source", "tokens", "q").join(rooms, "source").where("tokens <= room").join(taken.select("id"), "id", "left_anti"), "q", "id")
    pools: dict[str, list] = {s: [] for s in short}
    for r in (*reversed(mine), *other):
        pools[r["source"]].append(r)
    out, into = [(r["id"],) for r in mine], []
    for s, pool in pools.items():
        pool.sort(key=lambda r: (r["q"], r["id"]))
        into += [(pool[i]["id"], s, pool[i]["tokens"]) for i in choose([r["tokens"] for r in pool], room[s], plan[s][1])]
    kind = drawn.schema["id"].dataType.simpleString()
    rest = taken.drop("q").join(F.broadcast(spark.createDataFrame(out, f"id {kind}")), "id", "left_anti")
    return rest.select("id", "source", "tokens").union(spark.createDataFrame(into, f"id {kind}, source string, tokens long"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total: int | None = None, seed: int = 1, ranks: str = RANKS, least_part: float = 0.5
) -> Mix:
    """A selection in which each source of ``targets(source, target_share, max_repeats)`` fills its share of ``total`` tokens.

    ``total`` defaults to the largest at which every source that has documents fills its share, but at least ``least_part``
    of the tokens of all documents whose source has a target, so that a tiny source does not make the mix tiny (0: the
    smallest source decides). A source that cannot fill its share even with ``max_repeats`` copies of everything is taken
    whole that many times, an absent one stays empty, and both are reported; their shortfall is not passed on. A source
    never gets more than its share. Documents of other or no source are never selected; rows without id are left out;
    null and empty texts have no tokens and are not selected. Rows that share an id are one document (the last source
    and the most tokens among them). ``targets`` is a list of sources and must be small (it is checked); null
    shares or repeats count as 0. Source names compare exactly.
    """
    spark = docs.sparkSession
    goal = targets.select(F.col("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    goals = [r for r in goal.where("source is not null").dropDuplicates(["source"]).limit(10_001).collect()]
    if len(goals) > 10_000:
        raise ValueError("targets is meant to be a list of at most 10,000 sources")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("id is not null")
    counted = token_counts(rows, ["id", "source"], "text", ranks)
    sized = materialise(counted.groupBy("id").agg(F.max(F.struct("source", "tokens")).alias("d")).select("id", "d.*"), "sized")

    wanted = F.broadcast(spark.createDataFrame([(g["source"],) for g in goals], "source string"))
    known = sized.where("tokens > 0").join(wanted, "source")
    held = {r["source"]: r["t"] for r in known.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    if total is None:
        most = [held[g["source"]] * g["max_repeats"] / g["target_share"] for g in goals if held.get(g["source"]) and g["target_share"] > 0]
        total = max(min(most, default=0), least_part * sum(held.values()))
    plan = []
    for g in goals:
        have = held.get(g["source"], 0)
        want = min(g["target_share"] * total, float(have * g["max_repeats"]))
        whole = int(want // have) if have else 0
        plan.append((g["source"], g["target_share"], g["max_repeats"], have, float(g["target_share"] * total), whole, float(want - whole * have)))
    todo = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, available long, target_tokens double, whole int, rest double")

    # Inclusion odds from sums by source and size bin: a few thousand rows per source, whatever the number of documents.
    ready = known.join(F.broadcast(todo.select("source", "whole", "rest")), "source")
    bin_ = F.floor(F.log(F.col("tokens").cast("double")) / F.log(F.lit(BIN)))
    bins = ready.where("rest >= 1").groupBy("source", "rest", bin_.alias("b")).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, t = pdf["n"].to_numpy(float), pdf["t"].to_numpy(float)
        return pd.DataFrame({"source": pdf["source"].iloc[:1], "c": [_inclusion(t / n, n, float(pdf["rest"].iloc[0]))]})

    odds_of = {r["source"]: r["c"] for r in bins.groupBy("source").applyInPandas(solve, "source string, c double").collect()}
    c = spark.createDataFrame(list(odds_of.items()), "source string, c double")
    w = F.least(F.lit(1.0), F.lit(MOST) * F.col("rest") / F.col("tokens"))
    p = F.least(F.lit(1.0), F.col("c") * w)
    u = (F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = F.when(p >= 1 - 1e-12, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))
    drawn = ready.join(F.broadcast(c), "source").select("id", "source", "tokens", "rest", odds.alias("q"))
    budgets = {s: (rest, max(0.0, CLOSE * want)) for s, _, _, _, want, _, rest in plan if s in odds_of}
    taken = _fill(drawn, budgets).withColumn("copies", F.lit(1))
    copies = ready.where("whole > 0").select("id", "source", "tokens", F.col("whole").alias("copies")).union(taken.select("id", "source", "tokens", "copies"))
    chosen = materialise(copies.groupBy("id", "source", "tokens").agg(F.sum("copies").cast("int").alias("copies")), "mix")

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    all_sources = sized.groupBy("source").agg(F.count("*").alias("in_corpus"), F.sum("tokens").alias("corpus_tokens"))
    report = all_sources.join(todo, all_sources["source"].eqNullSafe(todo["source"]), "full").select(
        F.coalesce(all_sources["source"], todo["source"]).alias("source"), "in_corpus", "corpus_tokens", "target_share", "max_repeats", "target_tokens"
    )
    report = report.join(got.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    everything = chosen.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    status = (
        F.when(F.col("target_share").isNull(), "no_target").when(F.coalesce("corpus_tokens", F.lit(0)) == 0, "absent")
        .when(F.col("corpus_tokens") * F.col("max_repeats") < F.col("target_tokens") - 0.5, "too_small")
        .when(F.col("target_tokens") - F.coalesce("selected_tokens", F.lit(0)) > F.greatest(F.lit(1.0), CLOSE * F.col("target_tokens")), "documents_too_large").otherwise("met")
    )
    shares = report.select(
        "source", "target_share", "max_repeats", zero("in_corpus"), zero("corpus_tokens"), zero("documents"), zero("most_copies"), zero("selected_tokens"),
        (F.coalesce("selected_tokens", F.lit(0)) / float(max(total, 1))).alias("share_of_target_total"),
        (F.coalesce("selected_tokens", F.lit(0)) / float(max(everything, 1))).alias("share_of_selection"), status.alias("status"),
    )
    return Mix(chosen, shares)
