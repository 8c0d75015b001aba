"""Text classifiers fitted with Spark: hashed terms and a logistic regression.

A model is fitted on labelled rows where they lie, kept as a folder of files any session can load, and
scores texts as one more column inside the pass of all scorers.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdict.operators.scoring import ModelScorer

#: Buckets of hashed terms.
TERMS = 1 << 16


def fold(key: str, folds: int = 5) -> Column:
    """The fold of a row, by a hash of its key; null keys are of fold 0."""
    return F.when(F.col(key).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folds))).cast("int")


def fit_text_model(
    labelled: DataFrame,
    text: str = "comment",
    label: str = "label",
    terms: int = TERMS,
    strength: float = 1e-3,
    rounds: int = 50,
) -> PipelineModel:
    """A model of the rows whose label is 0 or 1; other rows and null texts are left out.

    Terms are runs of letters and digits in lower case; a text holds a term or does not.
    Both labels weigh the same in all, however rare one is. Rows of one label only cannot be learned from.
    Keep the model and load its scorer: fresh from the fit it holds a summary that Spark cannot send to tasks.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("double").alias("label"))
    rows = rows.filter("text IS NOT NULL AND label IN (0, 1)")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("labelled rows of both labels are needed")
    total = sum(counts.values())
    weight = F.when(F.col("label") == 1, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    steps = [
        RegexTokenizer(inputCol="text", outputCol="terms", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="terms", outputCol="features", numFeatures=terms, binary=True),
        LogisticRegression(
            featuresCol="features", labelCol="label", weightCol="weight", regParam=strength,
            maxIter=rounds, standardization=False,
        ),
    ]
    return Pipeline(stages=steps).fit(rows.withColumn("weight", weight))


def save_model(model: PipelineModel, path: str) -> None:
    """Keep a model below ``path``, replacing one that is there."""
    model.write().overwrite().save(path)


def load_scorer(name: str, path: str, **more) -> ModelScorer:
    """A scorer of a kept model."""
    return ModelScorer(name, transformer=PipelineModel.load(path), text_col="text", **more)
