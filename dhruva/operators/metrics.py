"""Evaluation: confusion matrix, precision, recall, F1, set-valued slots. Division by zero counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, labels: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Dense matrix over ``labels``: cells without a row count 0; other labels are left out."""
    spark = rows.sparkSession
    axis = spark.createDataFrame([(x,) for x in labels], "label string")
    grid = axis.select(F.col("label").alias(expected)).crossJoin(axis.select(F.col("label").alias(predicted)))
    counts = rows.groupBy(expected, predicted).agg(F.count("*").alias("n"))
    return grid.join(counts, [expected, predicted], "left").select(expected, predicted, F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(rows: DataFrame, labels: list[str], by: list[str] | None = None, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each label, from one pass over the rows."""
    by = by or []
    each = rows.select(*by, F.explode(F.array(F.struct(F.col(expected).alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p"), (F.col(expected) == F.col(predicted)).cast("int").alias("hit")),
                                               F.struct(F.col(predicted).alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select(*by, "x.*")
    sums = each.where(F.col("label").isin(labels)).groupBy(*by, "label").agg(F.sum("hit").alias("tp"), F.sum("e").alias("support"), F.sum("p").alias("given"))
    p, r = ratio(F.coalesce("tp", F.lit(0)), F.col("given")), ratio(F.coalesce("tp", F.lit(0)), F.col("support"))
    return sums.select(*by, "label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def accuracy(rows: DataFrame, labels: list[str], by: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """Accuracy and macro F1 over the labels that occur, per group."""
    right = F.avg((F.col(expected) == F.col(predicted)).cast("double"))
    plain = rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(right, F.lit(0.0)).alias("accuracy"))
    macro = class_scores(rows, labels, by, expected, predicted).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    on = [plain[c].eqNullSafe(macro[c]) for c in by]
    return plain.join(macro, on, "left").select(*(plain[c] for c in by), "n", "accuracy", F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))


def slot_scores(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Micro precision, recall and F1 of set-valued slots and the share of exact sets."""
    e, p = F.coalesce(F.array_distinct(expected), F.array()), F.coalesce(F.array_distinct(predicted), F.array())
    per = rows.select(F.size(F.array_intersect(e, p)).alias("tp"), F.size(F.array_except(p, e)).alias("fp"), F.size(F.array_except(e, p)).alias("fn"))
    s = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg((F.col("fp") + F.col("fn") == 0).cast("double")).alias("exact"))
    pr, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("tp", "fp", "fn", pr.alias("precision"), rc.alias("recall"), ratio(2 * pr * rc, pr + rc).alias("f1"), "exact")


def earliest_best(runs: DataFrame, step: str, score: str) -> DataFrame:
    """The run with the best score, the earliest of equals."""
    best = runs.agg(F.max_by(F.struct(*runs.columns), F.struct(F.col(score), -F.col(step))).alias("b"))
    return best.select("b.*").where(F.col(step).isNotNull())
