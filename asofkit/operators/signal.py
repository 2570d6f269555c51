"""Signals out of sample: standardised logistic regression, calibration on validation, evaluation on test."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skill


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """Features by the mean and population deviation of the training part; constant ones become 0."""
    stats = df.where("part = 'train'").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])
    j = df.crossJoin(F.broadcast(stats))  # one row
    return j.select(*[c for c in df.columns if c not in features],
                    *[F.coalesce((F.col(f) - F.col(f"m_{f}")) / F.nullif(F.col(f"s_{f}"), F.lit(0.0)), F.lit(0.0)).alias(f) for f in features])


def fit_signal(df: DataFrame, features: list[str], label: str, model: str = "logistic") -> DataFrame:
    """Rows of the test part with ``p``: the model sees train, its calibration validation, and nothing sees test."""
    z = VectorAssembler(inputCols=features, outputCol="x").transform(standardise(df, features)).withColumn("y", F.col(label).cast("double"))
    train = z.where("part = 'train'").select("x", "y")
    if model == "logistic":
        fit = LogisticRegression(featuresCol="x", labelCol="y", standardization=False, regParam=1.0 / max(train.count(), 1), rawPredictionCol="raw").fit(train)
    else:
        fit = GBTClassifier(featuresCol="x", labelCol="y", maxIter=10, maxDepth=3, seed=7).setRawPredictionCol("raw").fit(train)
    scored = fit.transform(z).withColumn("logit", vector_to_array("raw")[1])
    one = VectorAssembler(inputCols=["logit"], outputCol="l").transform(scored)
    platt = LogisticRegression(featuresCol="l", labelCol="y", standardization=False, probabilityCol="pp", rawPredictionCol="pr", predictionCol="pd").fit(one.where("part = 'validation'").select("l", "y"))
    return platt.transform(one.where("part = 'test'")).withColumn("p", vector_to_array("pp")[1]).drop("x", "l", "raw", "probability", "prediction", "pp", "pr", "pd")


def baselines(df: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """Signals that need no model: random, always long, momentum, distance to the mean."""
    return df.select("*", skill.random_baseline(F.col(key), seed).alias("random"), F.lit(1.0).alias("always_long"),
                     F.signum("momentum").alias("momentum_sign"), F.signum("mean_gap").alias("mean_gap_sign"))
