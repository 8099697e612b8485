"""Scaling, scoring and evaluation of classifiers of machine condition; `training` fits them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Without rows that miss a feature or the label."""
    return df.dropna(subset=[*features, "label"])


def stratified_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """is_test: the first test share of each label's rows, rounded up, in order of a seeded digest of the key.

    Rows are counted and ranked within 64 shares of the digest; a share's offset comes from the small table of shares, so a label is not one task's.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.withColumn("_digest", digest).withColumn("_share", F.substring("_digest", 1, 2))
    shares = rows.groupBy("label", "_share").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("label").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumns({"_before": F.coalesce(F.sum("_n").over(order), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("label"))}).drop("_n")
    rank = F.row_number().over(Window.partitionBy("label", "_share").orderBy("_digest", key))
    placed = rows.withColumn("_rank", rank).join(shares, ["label", "_share"])
    return placed.withColumn("is_test", F.col("_rank") + F.col("_before") <= F.ceil(F.col("_all") * test)).drop("_digest", "_share", "_before", "_all", "_rank")


@dataclass(frozen=True)
class Scaler:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.features, self.mean, self.std)})


def fit_scaler(train: DataFrame, features: list[str]) -> Scaler:
    """Mean and population deviation, one aggregation; a deviation of 0 becomes 1."""
    row = train.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    return Scaler(tuple(features), tuple(row[f"mean_{c}"] for c in features), tuple(row[f"std_{c}"] or 1.0 for c in features))


def fit_labels(df: DataFrame) -> list[str]:
    """The classes, sorted."""
    return [r.label for r in df.select("label").where("label IS NOT NULL").distinct().orderBy("label").collect()]  # a row for each class


def encode(label: Column, labels: list[str]) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), label) - 1, F.lit(-1))


def decode(index: Column, labels: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), index.cast("int"))


@dataclass(frozen=True)
class Linear:
    """A scaler, weights by class and feature, biases, and the classes."""

    scaler: Scaler
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    labels: tuple[str, ...]


def model_table(spark: SparkSession, model: Linear) -> DataFrame:
    """The parameters in 32 bits: label, bias, feature, mean, std and weight, a row for each class and feature."""
    small = lambda v: float(np.float32(v))
    rows = [(label, small(b), f, small(m), small(s), small(w)) for label, b, ws in zip(model.labels, model.bias, model.weights) for f, m, s, w in zip(model.scaler.features, model.scaler.mean, model.scaler.std, ws)]
    return spark.createDataFrame(rows, "label string, bias double, feature string, mean double, std double, weight double")


def score_logreg(df: DataFrame, model: Linear, link: str = "softmax") -> DataFrame:
    """df with probabilities (an array by class), prediction (the first largest) and confidence. link "sigmoid" scores each class alone."""
    z = [(F.col(c) - m) / s for c, m, s in zip(model.scaler.features, model.scaler.mean, model.scaler.std)]
    logits = [sum((x * w for x, w in zip(z, ws)), F.lit(b)) for ws, b in zip(model.weights, model.bias)]
    rows = df.withColumn("_logits", F.array(*logits))
    if link == "sigmoid":
        p = F.transform("_logits", lambda v: 1 / (1 + F.exp(-v)))
    else:
        rows = rows.withColumn("_exp", F.transform("_logits", lambda v: F.exp(v - F.array_max("_logits"))))
        p = F.transform("_exp", lambda v: v / F.aggregate("_exp", F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("probabilities", p)
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return rows.withColumns({"prediction": decode(best, list(model.labels)), "confidence": F.array_max("probabilities")}).drop("_logits", "_exp")


@dataclass(frozen=True)
class Dense:
    """A scaler, (weights by unit and input, biases) of each layer, and the classes. All layers but the last are ReLU, the last softmax."""

    scaler: Scaler
    layers: tuple[tuple[tuple[tuple[float, ...], ...], tuple[float, ...]], ...]
    labels: tuple[str, ...]

    @staticmethod
    def of_rule(scaler: Scaler, sizes: tuple[int, ...], labels: tuple[str, ...]) -> Dense:
        """Weights by a fixed rule, for tests and queries: cos(7 unit + 3 input + layer) over the root of the inputs."""
        layers = []
        for k, (n, m) in enumerate(zip(sizes, sizes[1:])):
            layers.append((tuple(tuple(math.cos(7 * i + 3 * j + k) / math.sqrt(n) for j in range(n)) for i in range(m)), tuple(0.1 * math.sin(i + k) for i in range(m))))
        return Dense(scaler, tuple(layers), labels)


def forward(x: np.ndarray, model: Dense) -> np.ndarray:
    x = (x - np.array(model.scaler.mean)) / np.array(model.scaler.std)
    for k, (w, b) in enumerate(model.layers):
        x = x @ np.array(w).T + np.array(b)
        if k < len(model.layers) - 1:
            x = np.maximum(x, 0)
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def score_mlp(df: DataFrame, model: Dense) -> DataFrame:
    """df with probabilities, prediction and confidence of a dense network; a batch of rows is one matrix product for each layer."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def probabilities(x: pd.Series) -> pd.Series:
        return pd.Series(list(forward(np.stack(x.to_numpy()).astype(float), model)) if len(x) else [], dtype=object)

    rows = df.withColumn("probabilities", probabilities(F.array(*[F.col(c).cast("double") for c in model.scaler.features])))
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return rows.withColumns({"prediction": decode(best, list(model.labels)), "confidence": F.array_max("probabilities")})


def confusion(df: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each label in order, a column for each prediction; zeros where there is none."""
    order = df.sparkSession.createDataFrame(list(enumerate(labels)), "place int, label string")
    counts = df.groupBy("label").pivot("prediction", labels).agg(F.count(F.lit(1)))
    return F.broadcast(order).join(counts, "label", "left").fillna(0, labels).select("place", "label", *labels)


def classification_report(df: DataFrame, labels: list[str]) -> DataFrame:
    """label, precision, recall, f1 and support of each class, of their plain and weighted means, and of accuracy. One aggregation to at most classes squared rows."""
    pairs = df.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"{k}{i}") for i, name in enumerate(labels) for k, c in (("tp", (F.col("label") == name) & (F.col("prediction") == name)), ("p", F.col("prediction") == name), ("s", F.col("label") == name))]
    one = pairs.agg(*sums, F.sum("n").alias("n"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = []
    for i, name in enumerate(labels):
        precision, recall = ratio(F.col(f"tp{i}"), F.col(f"p{i}")), ratio(F.col(f"tp{i}"), F.col(f"s{i}"))
        rows.append(F.struct(F.lit(name).alias("label"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), F.col(f"s{i}").alias("support")))
    table = one.select("n", F.array(*rows).alias("rows"), sum((F.col(f"tp{i}") for i in range(len(labels))), F.lit(0)).alias("right"))
    total = lambda field, weight: F.aggregate("rows", F.lit(0.0), lambda a, r: a + r[field] * (r["support"] if weight else F.lit(1.0)))
    mean = lambda name, weight: F.struct(F.lit(name).alias("label"), *[ratio(total(f, weight), F.col("n") if weight else F.lit(len(labels))).alias(f) for f in ("precision", "recall", "f1")], F.col("n").alias("support"))
    accuracy = ratio(F.col("right"), F.col("n"))
    more = F.array(mean("macro avg", False), mean("weighted avg", True), F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), F.col("n").alias("support")))
    return table.select(F.explode(F.concat("rows", more)).alias("r")).select("r.*")
