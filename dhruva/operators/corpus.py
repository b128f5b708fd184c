"""Template corpora: generation, replacement, leak checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dhruva.functions.text import normalised
from dhruva.session import spread

#: Words of a run, and runs of which the one with the least hash stands for all: texts of RUN + WINDOW - 1 words or more are found by it.
RUN, WINDOW = 4, 5


def fill(template: Column, values: dict[str, Column]) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def generate(templates: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """Every template (``label, family, template``) with every pair of an origin and a destination: a generator over small lists."""
    pairs = origins.select(F.col("name").alias("origin")).crossJoin(destinations.select(F.col("name").alias("destination"))).where("origin != destination")
    rows = templates.crossJoin(pairs)
    text = fill(F.col("template"), {"origin": F.col("origin"), "destination": F.col("destination")})
    return rows.select("label", "family", "origin", "destination", text.alias("text"))


def replace_first(rows: DataFrame, by: list[str], order: str, n: int, new: DataFrame) -> DataFrame:
    """``rows`` without the first ``n`` of each group, and ``new`` instead."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") > n).drop("__rn").unionByName(new)


def family_name(family: str, intent: str) -> Column:
    """A family as ``intent:number`` in lower case without blanks or leading zeros, a bare number with the row's intent; null for what is no family."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s\p{Z}\p{Cf}]+", ""))
    f = bare(family)
    name = F.when(f.rlike(r"^.+:[0-9]+$"), F.regexp_replace(f, ":[0-9]+$", "")).when(f.rlike("^[0-9]+$"), bare(intent))
    return F.when(name != "", F.concat_ws(":", name, F.regexp_replace(F.regexp_extract(f, "([0-9]+)$", 1), "^0+([0-9])", "$1")))


def torn_groups(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups whose rows are in more than one split."""
    counts = rows.where(f"{group} is not null and {split} is not null").groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("rows"))
    return counts.where("splits > 1")


def shared_texts(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """Texts that occur on both sides, exactly."""
    return a.where(f"{text} is not null").select(text).intersect(b.select(text))


def _marks(words: Column) -> Column:
    """Least hash of each WINDOW successive runs of RUN words, each value once; none for fewer words than that takes."""
    ends = lambda short: F.sequence(F.lit(0), F.size(words) - short)
    # Bound as the element of a one-element array, the hashes are computed once and not for every window.
    hashes = F.array(F.transform(ends(RUN), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(RUN)))))
    least = F.get(F.transform(hashes, lambda h: F.transform(ends(RUN + WINDOW - 1), lambda i: F.array_min(F.slice(h, i + 1, WINDOW)))), 0)
    return F.when(F.size(words) >= RUN + WINDOW - 1, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def contained_texts(docs: DataFrame, id_col: str, text: str, listed: DataFrame, wanted: str) -> DataFrame:
    """``(id_col, wanted)``: the texts of ``listed``, normalised ones, that stand in a document as a whole run of words, however long.

    Long texts meet a document by the mark of their first words, short ones by their first word: a run of words has the same marks wherever it
    stands, so none is missed. Every meeting is then checked on the full texts, so equal hashes of other words do no harm.
    """
    least = RUN + WINDOW - 1
    refs = listed.select(F.col(wanted).alias("ref"), F.split(wanted, " ").alias("w")).where("ref != ''").distinct()
    refs = refs.select("ref", F.when(F.size("w") >= least, F.get(_marks(F.slice("w", 1, least)), 0)).otherwise(F.xxhash64(F.get("w", 0))).alias("key"))
    # Marks and words in one column: the documents are read and normalised once.
    words = F.array(F.split(normalised(text), " "))
    keys = F.get(F.transform(words, lambda w: F.concat(_marks(w), F.transform(F.array_distinct(w), lambda x: F.xxhash64(x)))), 0)
    met = spread(docs.select(id_col, text)).select(id_col, F.explode(keys).alias("key")).join(refs, "key").select(id_col, "ref").distinct()
    by_doc = met.groupBy(id_col).agg(F.collect_list("ref").alias("refs"))
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    full = by_doc.join(docs.select(id_col, text), id_col).select(id_col, "refs", pad(normalised(text)).alias("t"))
    return full.select(id_col, F.explode(F.filter("refs", lambda r: F.col("t").contains(pad(r)))).alias(wanted)).distinct()
