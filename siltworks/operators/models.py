"""How well a label can be told from features: cross-validated multinomial logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .selection import running

LEAST = 20


def folds_of(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with fold (0 to folds - 1): each label's rows, in the order of a hash of their key, are dealt out in turn."""
    placed = running(df.withColumn("__hash", F.xxhash64(F.lit(seed), key)), [label], ["__hash", key], "__place")
    return placed.withColumn("fold", (F.col("__place") - 1) % folds).drop("__hash", "__place")


def predictions(df: DataFrame, key: str, features: str, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """(key, label, predicted): every row is predicted by a model that did not see its fold.

    Folds are stratified. The penalty is half the squared weights against the
    sum of the rows' losses (a C of 1), on features scaled to their sample
    deviation in the training folds; intercepts are free. Rows without key,
    label or features have no part. Fewer than ``LEAST`` rows or a single class
    are an error.
    """
    fine = F.col(features).isNotNull() & F.col(key).isNotNull() & F.col(label).isNotNull()
    rows = df.where(fine).select(key, F.col(label).cast("string").alias("label"), F.col(features).cast("array<double>").alias("__f"))
    rows = materialize(folds_of(rows, key, "label", folds, seed).withColumn("x", array_to_vector("__f")).drop("__f"))
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, classes = sum(sizes.values()), rows.select("label").distinct().count()
    if n < LEAST or classes < 2:
        raise ValueError(f"{n} rows of {classes} classes: {LEAST} rows of two classes are needed")
    index = StringIndexer(inputCol="label", outputCol="y").fit(rows)
    indexed, out = index.transform(rows), None
    names = F.array(*[F.lit(x) for x in index.labels])
    for k in range(folds):
        weigh = LogisticRegression(featuresCol="scaled", labelCol="y", family="multinomial", maxIter=200, regParam=1 / (n - sizes.get(k, 0)), standardization=False)
        steps = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="scaled", withMean=True), weigh])
        found = steps.fit(indexed.where(F.col("fold") != k)).transform(indexed.where(F.col("fold") == k)).select(key, "label", names[F.col("prediction").cast("int")].alias("predicted"))
        out = found if out is None else out.unionByName(found)
    return out


def accuracy(found: DataFrame) -> DataFrame:
    """(label, rows, right): how many of each class were told."""
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == F.col("predicted")).alias("right"))


def told(found: DataFrame) -> DataFrame:
    """(label, predicted, n, accuracy): the cells of the confusion matrix that are not 0, each with the accuracy of all rows."""
    cells = materialize(found.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n")))
    whole = cells.agg(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("all")).first()
    return cells.withColumn("accuracy", F.lit(whole["right"] / whole["all"] if whole["all"] else None).cast("double"))
