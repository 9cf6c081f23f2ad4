"""A class-weighted multilayer perceptron trained by distributed gradients.

The network is small (its size follows from the feature width and the hidden
layers, never from the data) and is broadcast each round; every task adds up
the weighted gradient of all its rows and sends one vector.  The gradient is
over all rows, so the model does not depend on how they lie.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Perceptron:
    """Dense layers with tanh between them and a softmax at the end."""

    def __init__(self, sizes: Sequence[int], classes: Sequence, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sizes, self.classes = list(sizes), list(classes)
        self.layers = [(rng.normal(0, a ** -0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:])]

    def flat(self) -> np.ndarray:
        return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in self.layers])

    def with_flat(self, x: np.ndarray) -> Perceptron:
        out, at = Perceptron.__new__(Perceptron), 0
        out.sizes, out.classes, out.layers = self.sizes, self.classes, []
        for a, b in zip(self.sizes[:-1], self.sizes[1:]):
            out.layers.append((x[at: at + a * b].reshape(a, b), x[at + a * b: at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations of every layer; the last are class probabilities."""
        out = [x]
        for k, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            if k + 1 < len(self.layers):
                out.append(np.tanh(z))
            else:
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(e / e.sum(axis=1, keepdims=True))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted sum of cross entropies and its gradient by all parameters."""
        acts = self.forward(x)
        p = acts[-1]
        loss = float(-(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
        delta = p.copy()
        delta[np.arange(len(y)), y] -= 1.0
        delta *= weight[:, None]
        parts = []
        for k in range(len(self.layers) - 1, -1, -1):
            parts.append(np.concatenate([(acts[k].T @ delta).ravel(), delta.sum(axis=0)]))
            if k:
                delta = (delta @ self.layers[k][0].T) * (1.0 - acts[k] ** 2)
        return loss, np.concatenate(parts[::-1])


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy()
    return values.reshape(len(column), -1)


def train_perceptron(rows: DataFrame, features: str = "embedding", label: str = "label", weight: str | None = "weight",
                     hidden: Sequence[int] = (16,), rounds: int = 60, rate: float = 0.05, ridge: float = 1e-4, seed: int = 7) -> Perceptron:
    """Fit by Adam on full gradients over ``rows`` (dense ``features`` of one
    width, ``label``, row ``weight``).  They are packed in blocks that are kept
    for all rounds, in memory or on disk.  Rows with a null label or features are left out; rows
    without any class are an error."""
    rows = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    spark = rows.sparkSession
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())   # one row a class
    if not classes:
        raise ValueError("no labelled rows to train on")
    width = rows.select(F.size(features).alias("n")).first().n
    net = Perceptron([width, *hidden, len(classes)], classes, seed)
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    data = rows.select(features, at.cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    total = data.agg(F.sum("w")).first()[0]

    def blocks(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows:
                one = (_matrix(b.column(0)).astype(float), b.column(1).to_numpy(), b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in one], ["x", "y", "w"])

    def arrays(r):
        return np.frombuffer(r.x).reshape(-1, width), np.frombuffer(r.y, np.int32), np.frombuffer(r.w)
    # rows are packed once, and one vector a task comes back each round
    packed = data.mapInArrow(blocks, "x binary, y binary, w binary").rdd
    packed = packed.coalesce(2 * spark.sparkContext.defaultParallelism).map(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    x, m, v = net.flat(), 0.0, 0.0
    for k in range(1, rounds + 1):
        given = spark.sparkContext.broadcast(x)

        def part(some):
            x_ = given.value
            now, out = net.with_flat(x_), np.zeros(len(x_) + 1)
            for one in some:
                loss, g = now.gradient(*one)
                out[:-1] += g
                out[-1] += loss
            yield out
        grad = np.sum(packed.mapPartitions(part).collect(), axis=0)
        given.unpersist()
        g = grad[:-1] / total + ridge * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    packed.unpersist()
    return net.with_flat(x)


def predict_perceptron(net: Perceptron, rows: DataFrame, keep: Sequence[str], features: str = "embedding", name: str = "nn") -> DataFrame:
    """``keep`` columns, prediction, model and probability (ARRAY<DOUBLE> in
    class order) of every row; rows without features have nulls."""
    kept = rows.select(*keep, features)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            column = b.column(b.num_columns - 1)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(there)
            prob = net.forward(_matrix(column.take(pa.array(at))))[-1] if len(at) else np.zeros((0, len(net.classes)))
            best: list = [None] * b.num_rows
            probs: list = [None] * b.num_rows
            for k, i in enumerate(at.tolist()):
                best[i], probs[i] = int(net.classes[int(prob[k].argmax())]), prob[k].tolist()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.int32()), pa.array(probs, pa.list_(pa.float64()))],
                                             [*b.schema.names[:-1], "prediction", "probability"])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "prediction int", "probability array<double>"])
    return kept.mapInArrow(run, schema).select(*keep, "prediction", F.lit(name).alias("model"), "probability")
