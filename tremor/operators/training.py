"""Fitting of classifiers by sums over rows: each step is one pass over a written table, summed in tasks, then by tree.

The driver holds parameters, gradients and Hessians alone; their size follows the number of features and units, not of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators.model import Dense, Linear, encode, fit_labels, fit_scaler
from tremor.sources.shared import new_path

#: Vectors of sums that the driver adds; more of them are added by tasks first.
MOST_SUMS = 64


def design(df: DataFrame, features: list[str], labels: list[str], **more: Column) -> DataFrame:
    """x (array of the features), y (place of the label) and further columns, written once for all passes. Rows without a known label are left out."""
    path = new_path(df.sparkSession, "design")
    rows = df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), encode(F.col("label"), labels).cast("int").alias("y"), *[v.alias(k) for k, v in more.items()])
    rows.where("y IS NOT NULL").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def summed(data: DataFrame, width: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of of(batch), a vector of that width, over all batches: one vector a task, and by tasks again where there are many."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += b.column("sums").flatten().to_numpy().reshape(-1, width).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    parts, n = data.mapInArrow(local, "sums array<double>"), data.rdd.getNumPartitions()
    while n > MOST_SUMS:
        n = math.isqrt(n)
        parts = parts.repartition(n).mapInArrow(again, "sums array<double>")
    rows = parts.toArrow().column("sums").combine_chunks().flatten().to_numpy()
    return rows.reshape(-1, width).sum(0)


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    y = batch.column("y").to_numpy()
    return batch.column("x").flatten().to_numpy().reshape(len(y), -1), y


def softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities by row, and the logarithm of each row's sum of powers."""
    most = z.max(1, keepdims=True)
    e = np.exp(z - most)
    total = e.sum(1, keepdims=True)
    return e / total, (np.log(total) + most)[:, 0]


def curvature(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and Hessian of multinomial regression, summed over rows; the last column of theta is the bias."""
    k, x = len(theta), np.hstack([x, np.ones((len(x), 1))])
    z = x @ theta.T
    p, log_total = softmax(z)
    hessian = np.empty((k, x.shape[1], k, x.shape[1]))
    for i in range(k):
        for j in range(i, k):
            hessian[i, :, j, :] = hessian[j, :, i, :] = x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None])
    return np.concatenate([[len(y), (log_total - z[np.arange(len(y)), y]).sum()], ((p - np.eye(k)[y]).T @ x).ravel(), hessian.ravel()])


def fit_logreg(train: DataFrame, features: list[str], c: float = 1.0, tolerance: float = 1e-10, most: int = 50) -> Linear:
    """Multinomial logistic regression with an L2 penalty of 1 / (c n) on scaled features, by Newton steps to a gradient below the tolerance.

    Gradient and Hessian of a step come from one pass. A step that raises the objective is halved. Biases have no penalty, and only their
    differences count: they sum to zero. Two classes have two rows of weights too.
    """
    scaler, labels = fit_scaler(train, features), fit_labels(train)
    data, k, d = design(scaler.apply(train), features, labels), len(labels), len(features) + 1

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The objective (mean loss and penalty), its gradient and Hessian."""
        sums = summed(data, 2 + k * d + (k * d) ** 2, lambda b: curvature(*arrays(b), theta))
        n, loss, gradient, hessian = sums[0], sums[1], sums[2 : 2 + k * d], sums[2 + k * d :].reshape(k * d, k * d)
        held = np.ones((k, d)) / (c * n)
        held[:, -1] = 0
        return loss / n + (held * theta**2).sum() / 2, gradient / n + (held * theta).ravel(), hessian / n + np.diag(held.ravel())

    theta = np.zeros((k, d))
    if k:
        value, gradient, hessian = at(theta)
        for _ in range(most):
            if np.abs(gradient).max() < tolerance:
                break
            step = np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0].reshape(k, d)
            for _ in range(40):
                new = at(theta - step)
                if new[0] <= value + 1e-14 * abs(value):
                    break
                step = step / 2
            else:
                break
            theta = theta - step
            value, gradient, hessian = new
        theta[:, -1] -= theta[:, -1].mean()
    return Linear(scaler, tuple(tuple(map(float, row[:-1])) for row in theta), tuple(map(float, theta[:, -1])), tuple(labels))


def regression_gradient(train: DataFrame, model: Linear, c: float = 1.0) -> DataFrame:
    """label, feature (or bias) and gradient of the penalized mean loss at a model, from built-in functions alone; n: rows with a label."""
    k, features = len(model.labels), list(model.scaler.features)
    rows = model.scaler.apply(train).withColumn("_y", encode(F.col("label"), list(model.labels))).where("_y IS NOT NULL")
    logits = F.array(*[sum((F.col(f) * w for f, w in zip(features, ws)), F.lit(b)) for ws, b in zip(model.weights, model.bias)])
    power = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    rows = rows.withColumn("_e", power).withColumn("_p", F.transform("_e", lambda v: v / F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)))
    sums = [F.avg((F.get("_p", F.lit(i)) - (F.col("_y") == i).cast("double")) * (F.col(f) if f else F.lit(1.0))) for i in range(k) for f in [*features, None]]
    cells = [F.struct(F.lit(model.labels[i]).alias("label"), F.lit(f or "bias").alias("feature"), F.lit(model.weights[i][j] if f else 0.0).alias("weight"), s.alias("slope")) for s, (i, j, f) in zip(sums, ((i, j, f) for i in range(k) for j, f in enumerate([*features, None])))]
    return rows.agg(F.count("*").alias("n"), F.array(*cells).alias("cells")).select("n", F.explode("cells").alias("x")).select("x.label", "x.feature", (F.col("x.slope") + F.col("x.weight") / (c * F.col("n"))).alias("gradient"), "n")


Layers = list[tuple[np.ndarray, np.ndarray]]


def packed(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for w, b in layers for part in (w, b)])


def unpacked(flat: np.ndarray, sizes: tuple[int, ...]) -> Layers:
    out, at = [], 0
    for n, m in zip(sizes, sizes[1:]):
        out.append((flat[at : at + n * m].reshape(m, n), flat[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def backward(x: np.ndarray, y: np.ndarray, layers: Layers) -> tuple[float, np.ndarray]:
    """Cross-entropy summed over rows, and its gradient: ReLU layers, a softmax at the end."""
    inputs = [x]
    for k, (w, b) in enumerate(layers):
        z = inputs[-1] @ w.T + b
        inputs.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
    p, log_total = softmax(inputs[-1])
    loss = (log_total - inputs[-1][np.arange(len(y)), y]).sum()
    p[np.arange(len(y)), y] -= 1
    out, slope = [], p
    for (w, _), own in zip(reversed(layers), reversed(inputs[:-1])):
        out.append((slope.T @ own, slope.sum(0)))
        slope = (slope @ w) * (own > 0)
    return float(loss), packed(out[::-1])


def loss_and_gradient(data: DataFrame, flat: np.ndarray, sizes: tuple[int, ...]) -> tuple[int, float, np.ndarray, int, float]:
    """Rows, loss and gradient of the rows of use 0 (the batch), rows and loss of those of use 1 (held for validation): one pass."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x, y = arrays(batch)
        held, layers = batch.column("use").to_numpy() == 1, unpacked(flat, sizes)
        loss, gradient = backward(x[~held], y[~held], layers)
        return np.concatenate([[(~held).sum(), loss, held.sum(), backward(x[held], y[held], layers)[0] if held.any() else 0], gradient])

    sums = summed(data, 4 + len(flat), of)
    return int(sums[0]), sums[1], sums[4:], int(sums[2]), sums[3]


@dataclass(frozen=True)
class Epoch:
    epoch: int
    loss: float
    validation_loss: float


def fit_mlp(
    train: DataFrame, features: list[str], key: str, hidden: tuple[int, ...] = (16, 8), rate: float = 0.01, epochs: int = 300, patience: int = 20, validation: float = 0.2, batches: int = 4, seed: int = 42
) -> tuple[Dense, list[Epoch]]:
    """A dense network of ReLU layers and a softmax, by Adam over mini-batches, stopped early; gives the network of the best epoch and all epochs.

    A batch is a share of all rows, drawn anew each epoch by a digest of the key, so a step is one pass whose gradients are summed over tasks and batches
    grow with the table. A share of the rows is held for validation; its loss after an epoch is taken in the next epoch's first pass. Training ends once that loss
    hasn't fallen for so many epochs. Draws depend on keys and seed alone, so the same rows in other partitions give the same network up to rounding.
    """
    scaler, labels = fit_scaler(train, features), fit_labels(train)
    drawn = lambda *salt: F.pmod(F.xxhash64(*map(F.lit, salt), F.col("key")), F.lit(1_000_000)) / 1_000_000.0
    data = design(scaler.apply(train), features, labels, key=F.col(key).cast("string"))
    data = data.withColumn("held", drawn(seed, -1) < validation).persist()  # a table that is read once a step; a lost part is read again
    sizes, rng = (len(features), *hidden, len(labels)), np.random.default_rng(seed)
    flat = packed([(rng.uniform(-1, 1, (m, n)) * math.sqrt(6 / (n + m)), np.zeros(m)) for n, m in zip(sizes, sizes[1:])])
    mean, square, steps = np.zeros_like(flat), np.zeros_like(flat), 0
    best, best_loss, since, told = flat, math.inf, 0, []
    for epoch in range(epochs + 1):
        total = rows = 0
        for k in range(batches):
            share = drawn(seed, epoch)
            used = ~F.col("held") & (share >= k / batches) & (share < (k + 1) / batches)
            n, loss, gradient, n_held, held_loss = loss_and_gradient(data.where(used | (F.col("held") & (k == 0))).withColumn("use", F.col("held").cast("int")), flat, sizes)
            if k == 0 and epoch:  # what the epoch before has come to
                told[-1] = Epoch(epoch, told[-1].loss, held_loss / max(n_held, 1))
                best, best_loss, since = (flat, told[-1].validation_loss, 0) if told[-1].validation_loss < best_loss or not n_held else (best, best_loss, since + 1)
            if epoch == epochs or since >= patience:
                break
            if n:
                steps += 1
                mean, square = 0.9 * mean + 0.1 * gradient / n, 0.999 * square + 0.001 * (gradient / n) ** 2
                flat = flat - rate * (mean / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.999**steps)) + 1e-7)
            total, rows = total + loss, rows + n
        else:
            told.append(Epoch(epoch + 1, total / max(rows, 1), math.nan))
            continue
        break
    data.unpersist()
    layers = tuple((tuple(tuple(map(float, row)) for row in w), tuple(map(float, b))) for w, b in unpacked(best, sizes))
    return Dense(scaler, layers, tuple(labels)), told


def network_slope(df: DataFrame, model: Dense, layer: int, step: float = 1e-5) -> tuple[float, DataFrame]:
    """The mean loss's derivative at a network along a layer's cosine direction: from the summed gradient, and as a row of central differences of scored losses (slope, n)."""
    from tremor.operators.model import score_mlp

    features, labels = list(model.scaler.features), list(model.labels)
    sizes = (len(features), *(len(b) for _, b in model.layers))
    flat = packed([(np.array(w), np.array(b)) for w, b in model.layers])
    sized = [sum(m * n + m for n, m in list(zip(sizes, sizes[1:]))[:k]) for k in range(len(sizes))]
    along = np.zeros_like(flat)
    along[sized[layer] : sized[layer + 1]] = np.cos(np.arange(sized[layer + 1] - sized[layer]))
    n, _, gradient, _, _ = loss_and_gradient(design(model.scaler.apply(df), features, labels, use=F.lit(0)), flat, sizes)
    scored = df.withColumn("_y", encode(F.col("label"), labels)).where("_y IS NOT NULL")
    for name, at in (("_up", flat + step * along), ("_down", flat - step * along)):
        moved = Dense(model.scaler, tuple((tuple(map(tuple, w.tolist())), tuple(b.tolist())) for w, b in unpacked(at, sizes)), model.labels)
        scored = score_mlp(scored, moved).withColumn(name, -F.ln(F.get("probabilities", F.col("_y").cast("int")))).drop("probabilities", "prediction", "confidence")
    return float(gradient @ along / max(n, 1)), scored.agg((F.avg(F.col("_up") - F.col("_down")) / (2 * step)).alias("slope"), F.count("*").alias("n"))
