"""Many logistic models in one pass over the rows.

All models of a search, whatever their training ranges and penalties, move together: each iteration is one Spark job in
which every task adds up loss, gradient and curvature of all models that are still moving, in one small matrix a model.
The driver then makes a Newton step for each (coordinate descent on the quadratic model where the penalty is L1), with step
halving. So the number of jobs is that of the slowest model's iterations, not models times iterations.

What is minimised, per model: mean over its rows of weight * logistic loss, plus strength * |b| or strength / 2 * b^2 over
the coefficients b of features scaled by mean and population deviation of the same rows. The intercept is not penalised.
Weights are balanced by class or 1. strength is 1 / (C n).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.moments import summed

TOLERANCE = 1e-10   # largest violation of a first-order condition at which a model is done
EVERYTHING = (-(1 << 31), 1 << 31)


@dataclass(frozen=True)
class Job:
    """One model: penalty "none", "l1" or "l2", its C, the ordinals it is trained on (from, to)."""

    penalty: str
    c: float = 1.0
    span: tuple[int, int] = EVERYTHING
    balanced: bool = True


@dataclass
class Scaling:
    """Facts of the rows of one span: counts of all and of positive rows, feature means and population deviations."""

    rows: int
    ups: int
    mean: np.ndarray
    sd: np.ndarray

    def weights(self, balanced: bool) -> tuple[float, float]:
        """(weight of class 0, weight of class 1)"""
        return (self.rows / (2.0 * (self.rows - self.ups)), self.rows / (2.0 * self.ups)) if balanced else (1.0, 1.0)


@dataclass
class Solution:
    """Coefficients per raw unit and intercept; none where only one class was seen."""

    coefficients: np.ndarray | None
    intercept: float
    prior: float
    rows: int
    iterations: int = 0
    violation: float = 0.0


@dataclass
class _State:
    strength: float
    penalty: str
    beta: np.ndarray               # scaled coefficients and the intercept
    trial: np.ndarray
    value: float = np.inf          # objective at beta
    slope: float = 0.0             # predicted change of a whole step
    step: float = 1.0
    direction: np.ndarray | None = None
    passes: int = 0
    violation: float = np.inf
    done: bool = False


def _input(rows: DataFrame) -> DataFrame:
    ordinal = F.col("ordinal").cast("long") if "ordinal" in rows.columns else F.lit(0).cast("long")
    return rows.select(vector_to_array("features").alias("x"), F.col("target").cast("double").alias("y"), ordinal.alias("o"))


def scalings(rows: DataFrame, spans: list[tuple[int, int]]) -> list[Scaling]:
    """Scaling facts of every span in one job."""
    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y, o = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            if total is None:
                total = np.zeros((len(spans), 2 + 2 * x.shape[1]))
            for k, (a, b) in enumerate(spans):
                own = (o >= a) & (o < b)
                z = x[own]
                total[k] += np.concatenate([[len(z), y[own].sum()], z.sum(axis=0), (z * z).sum(axis=0)])
        if total is not None:
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(spans) + 1, dtype=np.int32) * total.shape[1]), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(spans), dtype=np.int32)), sums], names=["key", "sums"])

    found: dict[int, dict[int, float]] = {k: {} for k in range(len(spans))}
    for r in summed(_input(rows), run).collect():  # spans x (2 + 2 features) numbers
        found[r["key"]][r["at"]] = r["total"]
    out = []
    for k in range(len(spans)):
        v = np.array([found[k][j] for j in range(len(found[k]))])
        n, d = (int(round(v[0])), (len(v) - 2) // 2) if len(v) else (0, 0)
        mean = v[2:2 + d] / max(n, 1)
        variance = np.maximum(v[2 + d:] / max(n, 1) - mean * mean, 0.0)
        flat = variance <= 1e-14 * (v[2 + d:] / max(n, 1))  # rounding of a constant feature
        out.append(Scaling(n, int(round(v[1])) if len(v) else 0, mean, np.where(flat, 0.0, np.sqrt(variance))))
    return out


def _curvatures(rows: DataFrame, groups: list[tuple], width: int) -> dict[int, np.ndarray]:
    """Per model number: loss, gradient and the upper triangle of the curvature at its trial point.

    `groups` has (span, mean, sd, weights, model numbers, trial points) of models that share rows and weights.
    """
    def run(batches):
        upper = np.triu_indices(width)
        total = {m: np.zeros(1 + width + len(upper[0])) for g in groups for m in g[4]}
        for batch in batches:
            y, o = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for (a, b), mean, sd, (w0, w1), numbers, points in groups:
                own = (o >= a) & (o < b)
                if not own.any():
                    continue
                label = y[own]
                z = np.ones((len(label), width))
                z[:, :-1] = np.where(sd > 0, (x[own] - mean) / np.where(sd > 0, sd, 1.0), 0.0)
                w = np.where(label == 1, w1, w0)
                e = z @ points.T
                p = 1.0 / (1.0 + np.exp(-np.clip(e, -700, 700)))
                loss = w @ (np.logaddexp(0.0, e) - label[:, None] * e)
                slope = z.T @ (w[:, None] * (p - label[:, None]))
                bend = w[:, None] * p * (1.0 - p)
                for k, m in enumerate(numbers):
                    total[m] += np.concatenate([[loss[k]], slope[:, k], ((z * bend[:, k:k + 1]).T @ z)[upper]])
        size = 1 + width + len(upper[0])
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * size), pa.array(np.concatenate(list(total.values()))))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.int32)), sums], names=["key", "sums"])

    size = 1 + width + width * (width + 1) // 2
    out: dict[int, np.ndarray] = {}
    for r in summed(rows, run).collect():  # moving models x about (features^2 / 2) numbers
        out.setdefault(r["key"], np.zeros(size))[r["at"]] = r["total"]
    return out


def _violation(penalty: str, strength: float, beta: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """By how much each first-order condition fails at beta; the intercept last."""
    own, b = slope.copy(), beta[:-1]
    if penalty == "l2":
        own[:-1] += strength * b
    elif penalty == "l1":
        own[:-1] = np.where(b != 0, slope[:-1] + strength * np.sign(b), np.sign(slope[:-1]) * np.maximum(np.abs(slope[:-1]) - strength, 0.0))
    return np.abs(own)


def _penalty(penalty: str, strength: float, beta: np.ndarray) -> float:
    b = beta[:-1]
    return {"none": 0.0, "l1": strength * np.abs(b).sum(), "l2": strength / 2 * (b * b).sum()}[penalty]


def _direction(s: _State, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """The step to the least point of the quadratic model with the penalty."""
    if s.penalty != "l1":
        grad, curve = slope.copy(), bend.copy()
        if s.penalty == "l2":
            grad[:-1] += s.strength * s.beta[:-1]
            curve[np.arange(len(grad) - 1), np.arange(len(grad) - 1)] += s.strength
        return -np.linalg.lstsq(curve, grad, rcond=1e-13)[0]
    # Single numbers as Python's own floats, which are the same numbers and several times as fast as elements of arrays.
    at, curves, moved = s.beta.tolist(), bend.diagonal().tolist(), slope.copy()  # moved: slope of the quadratic model at `at`
    bounds = [s.strength / c if c > 0 else 0.0 for c in curves[:-1]] + [0.0]
    for _ in range(2000):
        largest = 0.0
        for j, curve in enumerate(curves):
            if curve <= 0:
                continue
            want = at[j] - moved.item(j) / curve
            if j < len(at) - 1:
                size = abs(want) - bounds[j]
                want = (size if want > 0 else -size) if size > 0 else 0.0
            change = want - at[j]
            if change:
                at[j] = want
                moved += change * bend[j]
                largest = max(largest, abs(change))
        if largest < 1e-13:
            break
    return np.array(at) - s.beta


def _advance(s: _State, sums: np.ndarray, n: int, width: int, most: int) -> None:
    """Take what the pass found at the trial point: accept it and make the next step, or halve the step."""
    s.passes += 1
    slope = sums[1:1 + width] / n
    bend = np.zeros((width, width))
    bend[np.triu_indices(width)] = sums[1 + width:] / n
    bend += np.triu(bend, 1).T
    value = sums[0] / n + _penalty(s.penalty, s.strength, s.trial)
    if value > s.value + 1e-4 * s.step * s.slope + 1e-14 * max(1.0, abs(s.value)) and s.step > 1e-10:
        s.step /= 2
    else:
        s.beta, s.value = s.trial, value
        s.violation = float(_violation(s.penalty, s.strength, s.beta, slope).max())
        s.direction = _direction(s, slope, bend)
        s.slope = float(slope @ s.direction) + _penalty(s.penalty, s.strength, s.beta + s.direction) - _penalty(s.penalty, s.strength, s.beta)
        if s.penalty == "l2":
            s.slope = float((slope + np.append(s.strength * s.beta[:-1], 0.0)) @ s.direction)
        s.step = 1.0
        s.done = s.violation <= TOLERANCE
    s.done = s.done or s.passes >= most
    s.trial = s.beta + s.step * s.direction


def fit_many(rows: DataFrame, jobs: list[Job], most: int = 100) -> list[Solution]:
    """Fit all jobs on rows with features, target and (if spans are used) ordinal; `most` passes at the most.

    `rows` are read once a pass, so they should be a stored table. A span without rows or with one class gives the prior alone.
    """
    spans = list(dict.fromkeys(j.span for j in jobs))
    facts = dict(zip(spans, scalings(rows, spans), strict=True))
    read = _input(rows)
    lowest, highest = min(s[0] for s in spans), max(s[1] for s in spans)
    if (lowest, highest) != EVERYTHING:
        read = read.where((F.col("o") >= lowest) & (F.col("o") < highest))
    states: dict[int, _State] = {}
    for k, job in enumerate(jobs):
        f = facts[job.span]
        if 0 < f.ups < f.rows:
            start = np.zeros(len(f.mean) + 1)
            strength = 0.0 if job.penalty == "none" else 1.0 / (job.c * f.rows)
            if not job.balanced:
                start[-1] = np.log(f.ups / (f.rows - f.ups))
            states[k] = _State(strength, job.penalty, start, start)
    width = max((len(f.mean) for f in facts.values()), default=0) + 1
    while True:
        moving: dict[tuple, list[int]] = {}
        for k, s in states.items():
            if not s.done:
                moving.setdefault((jobs[k].span, jobs[k].balanced), []).append(k)
        if not moving:
            break
        groups = []
        for (span, balanced), numbers in moving.items():
            f = facts[span]
            groups.append((span, f.mean, f.sd, f.weights(balanced), numbers, np.stack([states[k].trial for k in numbers])))
        sums = _curvatures(read, groups, width)
        for numbers in moving.values():
            for k in numbers:
                _advance(states[k], sums[k], facts[jobs[k].span].rows, width, most)
    out = []
    for k, job in enumerate(jobs):
        f = facts[job.span]
        prior = f.ups / f.rows if f.rows else 0.0
        s = states.get(k)
        if s is None:
            out.append(Solution(None, 0.0, prior, f.rows))
            continue
        raw = np.where(f.sd > 0, s.beta[:-1] / np.where(f.sd > 0, f.sd, 1.0), 0.0)
        out.append(Solution(raw, float(s.beta[-1] - raw @ f.mean), prior, f.rows, s.passes, s.violation))
    return out


def probability(x: str, coefficients: str, intercept: str) -> F.Column:
    """P(up) from array columns of features and coefficients."""
    product = F.aggregate(F.zip_with(x, coefficients, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
    return 1.0 / (1.0 + F.exp(-(F.col(intercept) + product)))


def score_many(rows: DataFrame, solutions: Mapping[tuple[int, int], tuple[Any, Solution]]) -> DataFrame:
    """(combination, fold, target, prob_up) of each fold's test rows under each of the fold's models.

    `solutions` maps (combination, fold) to (the fold's row, its solution). The models are a table of that many rows, joined on the
    fold, whose test ranges follow each other.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(c, f, [float(v) for v in s.coefficients] if s.coefficients is not None else None, float(s.intercept), float(s.prior)) for (c, f), (_, s) in solutions.items()],
        "combination int, fold int, b array<double>, a double, prior double")
    folds = {f: fold for (_, f), (fold, _) in solutions.items()}
    place = F.lit(None).cast("int")
    for f, fold in folds.items():
        place = F.when((F.col("ordinal") >= fold["test_from"]) & (F.col("ordinal") < fold["test_to"]), f).otherwise(place)
    tested = rows.select(vector_to_array("features").alias("x"), "target", place.alias("fold")).where(F.col("fold").isNotNull())
    scored = tested.join(F.broadcast(table), "fold")  # one row per model
    return scored.select("combination", "fold", "target", F.when(F.col("b").isNull(), F.col("prior")).otherwise(probability("x", "b", "a")).alias("prob_up"))


def spark_model(spark, solution: Solution):
    """The solution as Spark ML's own model, to be stored and applied like any other."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.util import Identifiable

    context = spark.sparkContext
    name = f"logreg_{Identifiable().uid.rsplit('_', 1)[-1]}"
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        name, _py2java(context, Vectors.dense([float(v) for v in solution.coefficients])), float(solution.intercept))
    return LogisticRegressionModel(made)
