"""Correctness models over metric or sequence features: logistic regression and boosted trees, with out-of-fold AUC."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.operators.curate import folds
from lodespark.operators.metrics import auc_by
from lodespark.sources.shared import cut


def logistic(features: list[str], label: str = "label") -> Pipeline:
    """Median imputation, standardisation, and logistic regression with balanced classes (column weight)."""
    filled = [f"{f}__f" for f in features]
    return Pipeline(stages=[
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol=label, weightCol="weight", maxIter=100, regParam=1e-4),
    ])


def boosted(features: list[str], label: str = "label", iterations: int = 50) -> Pipeline:
    """Boosted trees of depth 3 with step 0.05; missing values become their median."""
    filled = [f"{f}__f" for f in features]
    return Pipeline(stages=[
        Imputer(inputCols=features, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="features"),
        GBTClassifier(labelCol=label, maxDepth=3, stepSize=0.05, maxIter=iterations, seed=7),
    ])


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """weight: n / (2 * rows of the class)."""
    n, pos = df.agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    neg = (n or 0) - (pos or 0)
    return df.withColumn("weight", F.when(F.col(label) == 1, n / 2 / max(1, pos or 0)).otherwise((n or 0) / 2 / max(1, neg)))


def scored(model: Pipeline, train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    out = model.fit(balanced(train, label)).transform(balanced(test, label))
    return out.withColumn("score", vector_to_array("probability")[1])


def out_of_fold(df: DataFrame, model: Pipeline, key: str, label: str = "label", k: int = 5) -> DataFrame:
    """df with the score of each row under the model fitted to the other folds."""
    return _held_out(cut(folds(df, label, key, k)), model, label, k)


def _held_out(parts: DataFrame, model: Pipeline, label: str, k: int) -> DataFrame:
    out = None
    for i in range(k):
        one = scored(model, parts.filter(F.col("fold") != i), parts.filter(F.col("fold") == i), label)
        out = one if out is None else out.unionByName(one)
    return out


def fold_auc(df: DataFrame, models: dict[str, Pipeline], key: str, label: str = "label", k: int = 5) -> DataFrame:
    """model, auc, n: out-of-fold AUC of each model. The features are computed and dealt to folds once for all models."""
    parts, out = cut(folds(df, label, key, k)), None
    for name, m in models.items():
        one = _held_out(parts, m, label, k).select(F.lit(name).alias("model"), F.col(label).cast("int").alias("y"), "score")
        out = one if out is None else out.unionByName(one)
    return auc_by(out, ["model"], "y", "score").select("model", "auc", (F.col("n_pos") + F.col("n_neg")).alias("n"))
