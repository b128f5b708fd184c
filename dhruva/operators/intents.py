"""Baseline intent model: hashed character n-grams, TF-IDF, multinomial logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dhruva.operators.features import char_ngrams

#: Labelled rows a model is fitted on at most, taken by a hash of their id; prediction covers every row.
MOST_FITTED = 20_000


def _with_grams(rows: DataFrame, text: str) -> DataFrame:
    # Few rows, much work on each: an explicit number of partitions is not coalesced.
    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return spread.withColumn("__grams", F.coalesce(char_ngrams(F.col(text), 2, 4), F.array().cast("array<string>")))


@dataclass
class IntentModel:
    stages: PipelineModel
    labels: StringIndexerModel

    @classmethod
    def fit(cls, train: DataFrame, id_col: str = "id", text: str = "text", label: str = "intent", c: float = 4.0, features: int = 1 << 14) -> IntentModel:
        """A model of at most MOST_FITTED rows that have a text and a label."""
        known = train.where(f"{text} is not null and {label} is not null").orderBy(F.xxhash64(id_col), id_col).limit(MOST_FITTED).select(text, label)
        tf = HashingTF(numFeatures=features, inputCol="__grams", outputCol="__tf")
        counts = tf.transform(_with_grams(known, text)).select(label, "__tf").cache()
        n = max(1, counts.count())
        idf = IDF(inputCol="__tf", outputCol="__w").fit(counts)
        unit = Normalizer(inputCol="__w", outputCol="__x")
        labels = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(counts)
        # The strength C of the inverse penalty over n rows is 1 / (C n) per row; features are not standardised.
        lr = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=25, regParam=1 / (c * n), standardization=False, family="multinomial", predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r")
        model = lr.fit(labels.transform(unit.transform(idf.transform(counts))))
        counts.unpersist()
        return cls(PipelineModel([tf, idf, unit, model]), labels)

    def predict(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """``rows`` with ``predicted`` and ``score``; a text without n-grams gets what the labels' frequencies say."""
        names = F.array(*map(F.lit, self.labels.labels))
        out = self.stages.transform(_with_grams(rows, text))
        out = out.withColumn("predicted", F.get(names, F.col("__p").cast("int"))).withColumn("score", F.array_max(vector_to_array("__q")))
        return out.select(*rows.columns, "predicted", "score")

    def save(self, path: str) -> None:
        """Two folders below ``path``, which must not be there yet."""
        self.stages.save(f"{path}/stages")
        self.labels.save(f"{path}/labels")

    @classmethod
    def load(cls, path: str) -> IntentModel:
        return cls(PipelineModel.load(f"{path}/stages"), StringIndexerModel.load(f"{path}/labels"))


def predict_intents(rows: DataFrame, train: DataFrame, id_col: str = "id", text: str = "text", label: str = "intent") -> DataFrame:
    """``rows`` with ``predicted`` and ``score``, from a model fitted on at most MOST_FITTED rows of ``train``."""
    return IntentModel.fit(train, id_col, text, label).predict(rows, text)
