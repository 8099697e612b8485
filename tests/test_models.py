"""Trained models against what their objective asks, and the parameter table against its model."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import model, training

FEATURES = ["u", "v"]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    centers = {"healthy": (0.0, 0.0), "imbalanced": (2.5, 0.0), "obstruction": (0.0, 2.5)}
    rows = [(name, *map(float, rng.normal(c, 1.0))) for name, c in centers.items() for _ in range(80)]
    return spark.createDataFrame(rows, "label string, u double, v double").repartition(4).cache()


def test_logistic_regression_is_at_its_minimum(train):
    fitted = training.fit_logreg(train, FEATURES)
    rows = train.toPandas()
    x = (rows[FEATURES].to_numpy() - fitted.scaler.mean) / fitted.scaler.std
    y = np.array([[label == name for name in fitted.labels] for label in rows["label"]], float)
    w, b = np.array(fitted.weights), np.array(fitted.bias)
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.abs((p - y).T @ x / len(x) + w / len(x)).max() < 1e-9  # the gradient of the mean loss and the penalty
    assert np.abs((p - y).mean(0)).max() < 1e-9
    assert abs(b.sum()) < 1e-12


def test_table_holds_the_model_in_32_bits(spark):
    linear = model.Linear(model.Scaler(("u", "v"), (0.1, -2.0), (1.0, 1 / 3)), ((0.5, math.pi), (-1.0, 1e-3)), (0.25, -0.7), ("a", "b"))
    rows = {(r.label, r.feature): r for r in model.model_table(spark, linear).collect()}
    assert set(rows) == {(label, f) for label in "ab" for f in "uv"}
    small = lambda v: float(np.float32(v))
    for i, label in enumerate("ab"):
        for j, f in enumerate("uv"):
            r = rows[label, f]
            assert (r.bias, r.mean, r.std, r.weight) == tuple(map(small, (linear.bias[i], linear.scaler.mean[j], linear.scaler.std[j], linear.weights[i][j])))


def test_newton_on_separable_and_single_class_data(spark):
    apart = spark.createDataFrame([("a", -1.0 - i / 9, 0.0) for i in range(20)] + [("b", 1.0 + i / 9, 0.0) for i in range(20)] + [(None, 0.0, 0.0)], "label string, u double, v double")
    gradient = training.regression_gradient(apart, training.fit_logreg(apart, FEATURES, c=100.0), 100.0).collect()
    assert len(gradient) == 6 and max(abs(r.gradient) for r in gradient) < 1e-9 and {r.n for r in gradient} == {40}
    alone = training.fit_logreg(apart.where("label = 'a'"), FEATURES)
    assert alone.labels == ("a",) and alone.weights == ((0.0, 0.0),)


def test_sums_by_tree_are_those_of_all_rows(spark):
    data = spark.range(1000).selectExpr("array(cast(id as double), 1d) as x", "0 as y").repartition(150)
    assert training.summed(data, 2, lambda b: training.arrays(b)[0].sum(0)).tolist() == [499500.0, 1000.0]
    assert training.summed(data.where("x[0] < 0"), 2, lambda b: training.arrays(b)[0].sum(0)).tolist() == [0.0, 0.0]


def test_gradient_of_the_network_is_that_of_differences():
    rng = np.random.default_rng(5)
    x, y, sizes = rng.normal(size=(40, 5)), rng.integers(0, 3, 40), (5, 7, 4, 3)
    flat = rng.normal(size=sum(m * n + m for n, m in zip(sizes, sizes[1:])))
    _, gradient = training.backward(x, y, training.unpacked(flat, sizes))
    for i in range(len(flat)):
        near = [training.backward(x, y, training.unpacked(flat + s * 1e-6 * (np.arange(len(flat)) == i), sizes))[0] for s in (1, -1)]
        assert abs((near[0] - near[1]) / 2e-6 - gradient[i]) < 1e-4 * max(1, abs(gradient[i]))


@pytest.fixture(scope="module")
def crossed(spark):
    rng = np.random.default_rng(4)
    points = rng.uniform(-1, 1, (400, 2))
    return spark.createDataFrame([(i, "healthy" if u * v > 0 else "imbalanced", float(u), float(v)) for i, (u, v) in enumerate(points) if abs(u * v) > 0.03], "id long, label string, u double, v double").cache()


def test_dense_classifier_learns_what_no_line_parts(crossed):
    fitted, told = training.fit_mlp(crossed, FEATURES, "id", rate=0.05, epochs=40)
    right = model.score_mlp(crossed, fitted).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("share")).first().share
    assert fitted.labels == ("healthy", "imbalanced") and right > 0.95
    assert [t.epoch for t in told] == list(range(1, len(told) + 1)) and told[-1].validation_loss < 0.3


def test_dense_training_is_the_same_for_any_partitioning(crossed):
    a, b = (training.fit_mlp(crossed.repartition(n), FEATURES, "id", epochs=4)[0] for n in (1, 7))
    for (w, v), (w2, v2) in zip(a.layers, b.layers):
        assert np.allclose(w, w2, atol=1e-9) and np.allclose(v, v2, atol=1e-9)


def test_training_stops_early_and_keeps_the_best_weights(spark):
    """Labels are noise: the validation loss only rises, and the network of its least is given."""
    rng = np.random.default_rng(6)
    noise = spark.createDataFrame([(i, "ab"[int(rng.integers(0, 2))], float(rng.normal()), float(rng.normal())) for i in range(120)], "id long, label string, u double, v double")
    fitted, told = training.fit_mlp(noise, FEATURES, "id", rate=0.1, epochs=60, patience=3)
    losses = [t.validation_loss for t in told]
    best = losses.index(min(losses))
    assert len(told) == best + 1 + 3 < 60
    held = noise.withColumn("key", F.col("id").cast("string")).where(F.pmod(F.xxhash64(F.lit(42), F.lit(-1), F.col("key")), F.lit(1_000_000)) / 1_000_000.0 < 0.2)
    place = F.array_position(F.array(F.lit("a"), F.lit("b")), F.col("label")).cast("int") - 1
    loss = model.score_mlp(held, fitted).agg(F.avg(-F.ln(F.get("probabilities", place))).alias("x")).first().x
    assert abs(loss - min(losses)) < 1e-9
