"""Linear support vector machines for all classes and folds at once, with calibrated probabilities.

Every class of every fold is a two-class problem over the same rows: squared hinge loss, a quadratic penalty that holds
the intercept too, as the usual linear solver has it. One pass over the rows gives the losses and gradients of all
problems, so a step costs one job, not one for each problem; each problem keeps its own quasi-Newton state on the driver.
A sigmoid for each problem is fitted to the margins of the rows that it has not seen, again all in one pass a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``n`` rows each, which weigh ``weight`` together.
ROWS = "at array<int>, v array<double>, label int, fold int, weight double, n double"
#: Results of a pass that go to the driver at once; more are added up by twos before.
AT_ONCE = 64
MEMORY = 8


@contextmanager
def sent(rows: DataFrame, *arrays: np.ndarray) -> Iterator[list[Broadcast]]:
    """``arrays`` as broadcast variables for one step's jobs: executors share a copy, tasks do not carry them, and all are released after."""
    out = [rows.sparkSession.sparkContext.broadcast(a) for a in arrays]
    try:
        yield out
    finally:
        for b in out:
            b.destroy()


def _flat(column: pa.ListArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin and end."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), ends - ends[0]


def margins(at: np.ndarray, v: np.ndarray, ends: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows times ``w`` (terms + 1 by problems), whose last row is the intercepts."""
    total = np.zeros((len(v) + 1, w.shape[1]))
    np.cumsum(v[:, None] * w[at], 0, out=total[1:])
    return total[ends[1:]] - total[ends[:-1]] + w[-1]


def _targets(batch: pa.RecordBatch, classes: int, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row and problem: 1 or -1, and whether the row is held out. Problem number: class * folds + fold."""
    label, fold = (batch.column(c).to_numpy() for c in ("label", "fold"))
    problem = np.arange(classes * folds)
    return np.where(label[:, None] == problem // folds, 1.0, -1.0), fold[:, None] == problem % folds


def _pass(batches: Iterator[pa.RecordBatch], sent_w: Broadcast, classes: int, folds: int) -> Iterator[pa.RecordBatch]:
    """Sums over rows of the squared hinge losses and of their gradients."""
    w = sent_w.value
    loss, gradient = np.zeros(w.shape[1]), np.zeros_like(w)
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            part = batch.slice(start, 20_000)
            at, ends = _flat(part.column("at"), np.int64)
            v, _ = _flat(part.column("v"), np.float64)
            y, held = _targets(part, classes, folds)
            gap = np.maximum(0, 1 - y * margins(at, v, ends, w))
            each = np.where(held, 0, part.column("weight").to_numpy()[:, None])
            loss += (each * gap * gap).sum(0)
            slope = -2 * each * y * gap
            rows = np.repeat(np.arange(part.num_rows), np.diff(ends))
            if len(at):
                order = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
                gradient[at[order][cuts]] += np.add.reduceat((v[:, None] * slope[rows])[order], cuts, axis=0)
            gradient[-1] += slope.sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([loss.tobytes()]), pa.array([gradient.tobytes()])], ["loss", "gradient"])


def _added(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    totals = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            found = [np.frombuffer(x) for x in row]
            totals = found if totals is None else [a + b for a, b in zip(totals, found, strict=True)]
    if totals is not None:
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()]) for t in totals], columns)


def summed(rows: DataFrame, step: partial, columns: list[str], parts: int) -> list[np.ndarray]:
    """The arrays that ``step`` gives for each partition, added up."""
    schema = ", ".join(f"{c} binary" for c in columns)
    out = rows.mapInArrow(step, schema)
    while parts > AT_ONCE:
        parts = -(-parts // 8)
        out = out.repartition(parts).mapInArrow(partial(_added, columns=columns), schema)
    found = out.collect()
    return [sum(np.frombuffer(r[c]) for r in found) for c in columns]


def _direction(g: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """The quasi-Newton direction of one problem from its last steps and changes of the gradient."""
    q, saved = g.copy(), []
    for s, y in zip(reversed(steps), reversed(turns), strict=True):
        a = (s @ q) / (s @ y)
        q -= a * y
        saved.append(a)
    if steps:
        q *= (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
    for s, y, a in zip(steps, turns, reversed(saved), strict=True):
        q += (a - (y @ q) / (s @ y)) * s
    return -q


def fit_margins(rows: DataFrame, size: int, classes: int, folds: int, parts: int, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-3) -> np.ndarray:
    """Weights (size + 1 by classes * folds): each problem's |w|^2 / 2 + c * weighted squared hinge loss of the rows of other folds.

    ``rows`` (see ROWS) are read once a step: pass a written or cached table. A problem rests when its gradient has shrunk to ``tol`` of the first.
    """
    k = classes * folds
    w = np.zeros((size + 1, k))

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with sent(rows, w) as (there,):
            loss, gradient = summed(rows, partial(_pass, sent_w=there, classes=classes, folds=folds), ["loss", "gradient"], parts)
        return 0.5 * (w * w).sum(0) + c * loss, w + c * gradient.reshape(w.shape)

    value, g = at(w)
    first = np.linalg.norm(g, axis=0)
    steps: list[list[np.ndarray]] = [[] for _ in range(k)]
    turns: list[list[np.ndarray]] = [[] for _ in range(k)]
    length = np.zeros(k)  # of the step in hand; 0: a new direction is due
    way = np.zeros_like(w)
    for _ in range(max_iter):
        going = np.linalg.norm(g, axis=0) > tol * np.maximum(first, 1e-12)
        if not going.any():
            break
        for p in np.flatnonzero(going & (length == 0)):
            way[:, p] = _direction(g[:, p], steps[p], turns[p])
            length[p] = 1.0 if steps[p] else 1 / max(1.0, first[p])
        trial = w + way * np.where(going, length, 0)
        new_value, new_g = at(trial)
        fine = new_value <= value + 1e-4 * length * (way * g).sum(0)
        for p in np.flatnonzero(going):
            if fine[p]:
                s, y = trial[:, p] - w[:, p], new_g[:, p] - g[:, p]
                if s @ y > 1e-12:
                    steps[p], turns[p] = [*steps[p], s][-MEMORY:], [*turns[p], y][-MEMORY:]
                w[:, p], value[p], g[:, p], length[p] = trial[:, p], new_value[p], new_g[:, p], 0
            elif length[p] < 1e-10:
                first[p] = np.inf  # no lower point this way: as near as doubles come
            else:
                length[p] /= 4
    return w


def _platt(batches: Iterator[pa.RecordBatch], sent_w: Broadcast, ab: np.ndarray, targets: np.ndarray, classes: int, folds: int) -> Iterator[pa.RecordBatch]:
    """Sums over held-out rows: counts, loss, slope by a and b, and the curvatures aa, ab, bb, for each problem."""
    w = sent_w.value
    total = np.zeros((8, w.shape[1]))
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            part = batch.slice(start, 20_000)
            at, ends = _flat(part.column("at"), np.int64)
            v, _ = _flat(part.column("v"), np.float64)
            y, held = _targets(part, classes, folds)
            f, n = margins(at, v, ends, w), part.column("n").to_numpy()[:, None]
            z = ab[0] * f + ab[1]
            t = np.where(y > 0, targets[0], targets[1])
            p = 1 / (1 + np.exp(np.clip(z, -700, 700)))  # of the class
            d, h = t - p, p * (1 - p)
            loss = t * np.logaddexp(0, z) + (1 - t) * np.logaddexp(0, -z)
            for i, x in enumerate((y > 0, y < 0, loss, d * f, d, h * f * f, h * f, h)):
                total[i] += np.where(held, x * n, 0).sum(0)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])


def fit_sigmoids(rows: DataFrame, w: np.ndarray, classes: int, folds: int, parts: int, max_iter: int = 100) -> np.ndarray:
    """(a, b) of each problem: probability 1 / (1 + exp(a * margin + b)), by Newton's method on the held-out rows.

    Targets are drawn in from 0 and 1 by the counts of both sides, as in Platt's method.
    """
    with sent(rows, w) as (there,):
        return _fit_sigmoids(rows, there, w.shape[1], classes, folds, parts, max_iter)


def _fit_sigmoids(rows: DataFrame, there: Broadcast, k: int, classes: int, folds: int, parts: int, max_iter: int) -> np.ndarray:
    def at(ab: np.ndarray, targets: np.ndarray) -> np.ndarray:
        return summed(rows, partial(_platt, sent_w=there, ab=ab, targets=targets, classes=classes, folds=folds), ["total"], parts)[0].reshape(8, k)

    yes, no = at(np.zeros((2, k)), np.zeros((2, k)))[:2]
    targets = np.stack([(yes + 1) / (yes + 2), 1 / (no + 2)])
    ab = np.stack([np.zeros(k), np.log((no + 1) / (yes + 1))])
    now = at(ab, targets)
    length = np.ones(k)
    for _ in range(max_iter):
        loss, ga, gb, aa, mixed, bb = now[2:]
        going = np.hypot(ga, gb) > 1e-5 * np.maximum(1, yes + no)
        if not going.any():
            break
        aa, bb = aa + 1e-9, bb + 1e-9
        det = np.maximum(aa * bb - mixed * mixed, 1e-12)
        step = np.stack([-(bb * ga - mixed * gb) / det, -(aa * gb - mixed * ga) / det])
        trial = ab + step * np.where(going, length, 0)
        new = at(trial, targets)
        fine = new[2] <= loss + 1e-4 * length * (step[0] * ga + step[1] * gb)
        ab, now = np.where(fine, trial, ab), np.where(fine, new, now)
        length = np.where(fine, 1.0, length / 2)
        if (length < 1e-8).all():
            break
    return ab


def probabilities(f: np.ndarray, ab: np.ndarray, classes: int, folds: int) -> np.ndarray:
    """Rows by classes: each fold's sigmoids made to add up to 1, then the mean over folds."""
    p = 1 / (1 + np.exp(np.clip(ab[0] * f + ab[1], -700, 700)))
    p = p.reshape(len(f), classes, folds)
    total = p.sum(1, keepdims=True)
    return np.where(total > 0, p / np.where(total > 0, total, 1), 1 / classes).mean(2)


def _scored(batches: Iterator[pa.RecordBatch], sent_w: Broadcast, ab: np.ndarray, classes: int, folds: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, ends = _flat(batch.column("_at"), np.int64)
        v, _ = _flat(batch.column("_v"), np.float64)
        p = probabilities(margins(at, v, ends, sent_w.value), ab, classes, folds)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p.tolist(), pa.list_(pa.float64()))], [*keep, "probability"])


def score(rows: DataFrame, features: str, w: np.ndarray, ab: np.ndarray, classes: int, folds: int) -> DataFrame:
    """``rows`` with the array column ``probability``; the vector column ``features`` goes."""
    from pyspark.sql import types as T

    keep = [c for c in rows.columns if c not in (features, "probability")]
    vector = F.unwrap_udt(features)
    wide = rows.select(*keep, vector["indices"].alias("_at"), vector["values"].alias("_v"))
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keep), T.StructField("probability", T.ArrayType(T.DoubleType()))])
    there = rows.sparkSession.sparkContext.broadcast(w)  # released with the plan that holds it
    return wide.mapInArrow(partial(_scored, sent_w=there, ab=ab, classes=classes, folds=folds, keep=keep), schema)
