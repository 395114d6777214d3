"""Logistic regressions of many strengths of regularisation at once.

All models look at the same rows, so a round is one pass for all of them: tasks multiply blocks of rows with the weights of all models
and sum losses and gradients; the sums of tasks are put together in a second, narrower stage. The driver takes each model a step further by
limited-memory quasi-Newton directions; models that have converged stand still. What it holds is the models, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.storage import saved

#: Numbers of all models that are fitted together at most (else strengths are taken in several goes), classes at most, numbers of a block
#: of rows times models and classes, and steps that a direction is made of.
WEIGHTS, CLASSES, BLOCK, MEMORY = 4 << 20, 10_000, 1 << 22, 10


class Models(NamedTuple):
    """weights: for each strength a row for each class, with the constant last."""

    strengths: tuple[float, ...]
    classes: list
    weights: np.ndarray


def _rows(features: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Usable rows (x, y) as a written table, and the number of features: rows with a null or non-finite feature, another length than most rows'
    longest, or a null label take no part."""
    good = features.where(F.col("y").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = saved(good, name)
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.where(F.size("x") == dim), dim


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.concatenate((flat, np.ones((len(flat), 1))), axis=1)


def _summed(rows: DataFrame, weights: np.ndarray, dim: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The loss and its gradient summed over all rows, for each model."""
    models, classes, width = weights.shape
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    step = max(1, BLOCK // (models * classes))

    def run(batches):
        flat = shared.value.reshape(models * classes, width).T
        loss, gradient = np.zeros(models), np.zeros((width, models * classes))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x, y = _matrix(part.column("x"), dim), part.column("y").to_numpy()
                z = (x @ flat).reshape(len(x), models, classes)
                z -= z.max(axis=2, keepdims=True)
                e = np.exp(z)
                total = e.sum(axis=2, keepdims=True)
                loss += (np.log(total[:, :, 0]) - z[np.arange(len(x)), :, y]).sum(axis=0)
                e /= total
                e[np.arange(len(x)), :, y] -= 1
                gradient += x.T @ e.reshape(len(x), -1)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate((loss, gradient.ravel())).tobytes()], pa.binary())], names=["g", "sums"])

    def together(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.float64) for b in table.column("sums"))
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    # tasks' sums are added in groups of a few before they reach the driver
    parts = rows.select("x", "y").mapInArrow(run, "g int, sums binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups)))
    total = sum(np.frombuffer(bytes(r["sums"]), np.float64) for r in parts.groupBy("g").applyInArrow(together, "sums binary").collect())
    shared.destroy()
    return total[:models], total[models:].reshape(width, models, classes).transpose(1, 2, 0)


class _Descent:
    """One model's way: a direction from its last steps, and half the step where the loss doesn't fall enough."""

    def __init__(self, start: np.ndarray):
        self.at, self.trial, self.loss, self.slope = start, start, np.inf, None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction, self.length, self.done = None, 1.0, False

    def told(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        """The loss and gradient at the trial point."""
        if self.slope is not None and not loss <= self.loss + 1e-4 * self.length * float(self.slope @ self.direction):
            self.length /= 2
            self.done = self.length < 1e-12
            self.trial = self.at + self.length * self.direction
            return
        if self.slope is not None:
            s, y = self.trial - self.at, gradient - self.slope
            if s @ y > 1e-12 * (y @ y):
                self.steps = [*self.steps[-MEMORY + 1 :], (s, y)]
            self.done = abs(self.loss - loss) <= tolerance * max(1.0, abs(loss)) and np.abs(gradient).max() <= 1e-3
        self.at, self.loss, self.slope = self.trial, loss, gradient
        self.done = self.done or np.abs(gradient).max() <= tolerance
        q, held = gradient.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            q -= a * y
            held.append(a)
        if self.steps:
            s, y = self.steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, float(np.linalg.norm(gradient)))
        for (s, y), a in zip(self.steps, reversed(held), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        self.direction, self.length = -q, 1.0
        self.trial = self.at + self.direction


def fitted(train: DataFrame, strengths: Sequence[float], features: str = "embedding", label: str = "label", rounds: int = 100, tolerance: float = 1e-9) -> Models:
    """Models that minimise the mean loss plus the squares of their weights (the constants not counted) over 2 * strength * rows.

    Labels are of any kind; there may be up to CLASSES of them. Rows with a null label or an unusable feature take no part. A table without rows
    gives models without classes."""
    plain = train.select(F.transform(features, lambda v: v.cast("double")).alias("x"), F.col(label).alias("label")).where("label is not null")
    classes = sorted(r[0] for r in plain.select("label").distinct().limit(CLASSES + 1).collect())
    if len(classes) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    kind = plain.schema["label"].dataType
    numbers = train.sparkSession.createDataFrame(list(zip(classes, range(len(classes)), strict=True)), T.StructType([T.StructField("label", kind), T.StructField("y", T.IntegerType())]))
    rows, dim = _rows(plain.join(F.broadcast(numbers), "label").select("x", "y"), "rows")
    n = rows.count()
    if not n:
        return Models(tuple(strengths), [], np.zeros((len(strengths), 0, dim + 1)))
    shape = (len(classes), dim + 1)
    groups = max(1, round(rows.rdd.getNumPartitions() ** 0.5))
    at_once = max(1, WEIGHTS // (shape[0] * shape[1]))
    ways = []
    for a in range(0, len(strengths), at_once):
        some = strengths[a : a + at_once]
        own = [_Descent(np.zeros(shape).ravel()) for _ in some]
        for _ in range(rounds):
            going = [i for i, w in enumerate(own) if not w.done]
            if not going:
                break
            trial = np.stack([own[i].trial.reshape(shape) for i in going])
            loss, gradient = _summed(rows, trial, dim, groups)
            for k, i in enumerate(going):
                free = trial[k].copy()
                free[:, -1] = 0
                pull = 1.0 / (some[i] * n)
                own[i].told(loss[k] / n + pull / 2 * float((free**2).sum()), (gradient[k] / n + pull * free).ravel(), tolerance)
        ways += own
    return Models(tuple(map(float, strengths)), classes, np.stack([w.at.reshape(shape) for w in ways]))


def predicted(models: Models, rows: DataFrame, features: str = "embedding", keep: Sequence[str] = ("id",)) -> DataFrame:
    """kept columns, strength, prediction: the most likely label of each row by each model, the smaller of equals; null for rows whose features can't
    be used."""
    width = models.weights.shape[2]
    kind = T.StringType() if models.classes and isinstance(models.classes[0], str) else T.DoubleType() if models.classes and isinstance(models.classes[0], float) else T.LongType()
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("strength", T.DoubleType()), T.StructField("prediction", kind)])
    shared = rows.sparkSession.sparkContext.broadcast(models)
    usable = F.coalesce((F.size("__x") == width - 1) & F.forall("__x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))

    def run(batches):
        m = shared.value
        count, classes, _ = m.weights.shape
        flat = m.weights.reshape(count * classes, width).T
        step = max(1, BLOCK // max(1, count * classes))
        arrow = {T.StringType(): pa.string(), T.DoubleType(): pa.float64(), T.LongType(): pa.int64()}[kind]
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                good = np.flatnonzero(part.column("__good").to_numpy(zero_copy_only=False))
                best = np.full((part.num_rows, count), -1)
                if len(good) and classes:
                    x = _matrix(part.column("__x").take(pa.array(good)), width - 1)
                    best[good] = (x @ flat).reshape(len(x), count, classes).argmax(axis=2)
                at = pa.array(np.repeat(np.arange(part.num_rows), count))
                told = pa.array([m.classes[i] if i >= 0 else None for i in best.ravel()], arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(len(keep))), pa.array(np.tile(m.strengths, part.num_rows)), told], names=schema.names)

    plain = rows.select(*keep, F.transform(features, lambda v: v.cast("double")).alias("__x"))
    return plain.withColumn("__good", usable).mapInArrow(run, schema)
