"""Many linear models over one table in common passes, and leave-one-event-out ridge by subtraction."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starfold.core import bind, checkpoint, dot

#: Doubles that the sums of one pass may take in a task; more models than fit are dealt to several runs of passes.
STATE = 1 << 20


def outputs(x: np.ndarray, theta: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, probabilities and log normalisers: (rows, models, classes) twice and (rows, models)."""
    z = np.einsum("nq,mcq->nmc", x, theta, optimize=True)
    if logistic:
        norm = np.logaddexp(0.0, z[:, :, 0])
        return z, np.exp(z - norm[:, :, None]), norm
    top = z.max(axis=2)
    norm = top + np.log(np.exp(z - top[:, :, None]).sum(axis=2))
    return z, np.exp(z - norm[:, :, None]), norm


def pass_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, logistic: bool) -> np.ndarray:
    """Weight, loss, gradient and curvature of every model over the rows; ``w`` is (rows, models), zero where a row is left out."""
    models, classes, width = theta.shape
    z, p, norm = outputs(x, theta, logistic)
    hit = y[:, None].astype("float64") if logistic else (y[:, None] == np.arange(classes)[None, :]).astype("float64")
    loss = (w * (norm - np.einsum("nmc,nc->nm", z, hit))).sum(axis=0)
    gradient = np.einsum("nmc,nq->mcq", w[:, :, None] * (p - hit[:, None, :]), x, optimize=True)
    i, j = np.triu_indices(width)
    products = x[:, i] * x[:, j]
    curve = np.zeros((models, classes, classes, width, width))
    for c in range(classes):
        for d in range(c, classes):
            half = (w * p[:, :, c] * ((c == d) - p[:, :, d])).T @ products  # one product of matrices for all models
            for own, other in ((c, d), (d, c)):
                curve[:, own, other, i, j] = curve[:, own, other, j, i] = half
    curve = curve.transpose(0, 1, 3, 2, 4)
    size = classes * width
    return np.concatenate([w.sum(axis=0)[:, None], loss[:, None], gradient.reshape(models, size), curve.reshape(models, size * size)], axis=1)


def _sums(rows: DataFrame, theta: np.ndarray, sets: Sequence[int], logistic: bool, intercept: bool) -> np.ndarray:
    """The sums of one pass over all partitions, added in two levels so that no task or driver meets all partial sums."""
    shape, chosen = (len(theta), 2 + theta[0].size + theta[0].size ** 2), np.asarray(sets)
    coefficients = theta.tobytes(), theta.shape

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, t = np.zeros(shape), np.frombuffer(coefficients[0]).reshape(coefficients[1])
        lanes = int(chosen.max()) + 1
        step = max(1, STATE // (shape[0] * t.shape[1]))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = np.asarray(b.column("x").flatten(), dtype="float64").reshape(n, -1)
            x = np.column_stack([x, np.ones(n)]) if intercept else x
            member = np.zeros((n, lanes), dtype=bool)
            given = b.column("sets")
            row, lane = np.repeat(np.arange(n), np.asarray(given.value_lengths())), np.asarray(given.flatten())
            member[row[lane < lanes], lane[lane < lanes]] = True
            y, w = np.asarray(b.column("y")), np.asarray(b.column("w"))
            for k in range(0, n, step):
                part = slice(k, k + step)
                total += pass_sums(x[part], y[part], w[part, None] * member[part][:, chosen], t, logistic)
        yield packed(TaskContext.get().partitionId(), total)

    def packed(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "s": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for b in batches:
            for s in b.column("s"):
                total, seen = total + np.frombuffer(s.as_py()).reshape(shape), True
        if seen:
            yield packed(TaskContext.get().partitionId(), total)

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.mapInArrow(local, "part int, s binary")
    for fan in (width, math.isqrt(width)) if width > 16 else (1,):
        out = out.repartition(fan, "part").mapInArrow(add, "part int, s binary")
    return sum((np.frombuffer(r["s"]).reshape(shape) for r in out.select("s").toLocalIterator()), np.zeros(shape))


def fit_models(rows: DataFrame, models: Sequence[tuple[int, float]], width: int, classes: int = 1, intercept: bool = False,
               tol: float = 1e-9, max_passes: int = 100) -> np.ndarray:
    """Coefficients (models, classes, width [+ 1 for the intercept, last]) of L2-penalised logistic or softmax models.

    ``rows`` holds x (array of ``width`` doubles), y (class number; 0 or 1 with one class), w (weight) and sets (the numbers of the
    row sets that it is in); a model is a pair (row set, penalty).  The loss of a model is the weighted mean over its set plus half
    the penalty times the squared coefficients without intercepts.  Every pass is one Spark job that sums the gradients and
    curvatures of all models, whose number does not change the number of jobs while models times squared parameters stay below
    ``STATE``; steps are Newton's, halved where the loss rose.  A model ends at a largest gradient entry of ``tol``.  Models whose
    set has no weight are NaN.  An error if ``max_passes`` do not suffice.
    """
    if not models:
        return np.zeros((0, classes, width + intercept))
    rows = checkpoint(rows.select("x", "y", "w", "sets"))
    params = classes * (width + intercept)
    chunk = max(1, STATE // (params * params))
    return np.concatenate([_newton(rows, models[k : k + chunk], width, classes, intercept, tol, max_passes) for k in range(0, len(models), chunk)])


def _newton(rows: DataFrame, models: Sequence[tuple[int, float]], width: int, classes: int, intercept: bool, tol: float, max_passes: int) -> np.ndarray:
    q = width + intercept
    size, logistic = classes * q, classes == 1
    sets, penalty = [s for s, _ in models], np.array([p for _, p in models])
    free = np.tile(np.arange(q) < width, classes).astype("float64")  # entries that the penalty pulls
    # softmax intercepts may all move together without effect; the extra term holds their sum
    held = np.outer(1 - free, 1 - free) if intercept and not logistic else np.zeros((size, size))
    theta, best = np.zeros((len(models), size)), np.full(len(models), np.inf)
    base, step, length = theta.copy(), np.zeros_like(theta), np.ones(len(models))
    open_ = np.ones(len(models), dtype=bool)
    trace = []
    for _ in range(max_passes):
        live = np.flatnonzero(open_)
        sums = _sums(rows, theta[live].reshape(len(live), classes, q), [sets[m] for m in live], logistic, intercept)
        for m, s in zip(live, sums, strict=True):
            if s[0] <= 0:
                theta[m], open_[m] = np.nan, False
                continue
            loss = s[1] / s[0] + penalty[m] / 2 * (free * theta[m] ** 2).sum()
            gradient = s[2 : 2 + size] / s[0] + penalty[m] * free * theta[m]
            if np.abs(gradient).max() <= tol:
                open_[m] = False
                continue
            if loss > best[m] + 1e-12 * abs(best[m]) and length[m] > 1e-6:
                length[m] /= 2
            else:
                curve = s[2 + size :].reshape(size, size) / s[0] + np.diag(penalty[m] * free) + held
                base[m], best[m], length[m] = theta[m], loss, 1.0
                step[m] = -np.linalg.lstsq(curve, gradient, rcond=1e-14)[0]
            theta[m] = base[m] + length[m] * step[m]
        if not open_.any():
            return theta.reshape(len(models), classes, q)
        trace.append(int(open_.sum()))
    raise RuntimeError(f"{trace[-1]} of {len(models)} models did not converge in {max_passes} passes; open per pass {trace[:3]} ... {trace[-3:]}")


def coefficient_table(like: DataFrame, keys: Sequence, theta: np.ndarray, key: str, out: str) -> DataFrame:
    """One row per fitted model: its key and its coefficients, an array per class; models without weight are left out."""
    kind = "string" if any(isinstance(k, str) for k in keys) else "double" if any(isinstance(k, float) for k in keys) else "long"
    rows = [(k, [[float(v) for v in c] for c in t]) for k, t in zip(keys, theta, strict=True) if not np.isnan(t).any()]
    return like.sparkSession.createDataFrame(rows, f"`{key}` {kind}, `{out}` array<array<double>>")


def softmax(x: Column, coef: Column) -> Column:
    """Class probabilities of a row under coefficients whose last entry per class is the intercept."""
    scores = F.transform(coef, lambda c: dot(F.array_append(x.cast("array<double>"), F.lit(1.0)), c))
    # bound: a lambda would evaluate its outer arrays again per element
    raised = bind(scores, lambda z: bind(F.array_max(z), lambda top: F.transform(z, lambda s: F.exp(s - top))))
    return bind(raised, lambda r: bind(F.aggregate(r, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(r, lambda e: e / total)))


# --- ridge -------------------------------------------------------------------------------------------------------


def event_products(rows: DataFrame, event: str) -> DataFrame:
    """Sums of products per event: ``(event, p, v)`` with entry p of the matrix of (1, x..., y) with itself.

    Rows are sorted by event inside their partition, so a batch yields few matrices; entries are then summed with partial sums
    per task, so a large event is no single group.
    """
    kind = rows.schema[event].dataType.simpleString()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = np.column_stack([np.ones(b.num_rows), np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1), np.asarray(b.column("y"))])
            code = b.column(event).dictionary_encode()
            order = np.argsort(np.asarray(code.indices), kind="stable")
            ends = np.flatnonzero(np.diff(np.asarray(code.indices)[order])) + 1
            parts = np.split(z[order], ends)
            names = code.dictionary.take(pa.array(np.asarray(code.indices)[order][np.concatenate([[0], ends])]))
            yield pa.RecordBatch.from_arrays([names, pa.array([(p.T @ p).ravel() for p in parts], pa.list_(pa.float64()))], names=[event, "m"])

    found = rows.sortWithinPartitions(event).mapInArrow(products, f"`{event}` {kind}, m array<double>")
    return found.select(event, F.posexplode("m").alias("p", "v")).groupBy(event, "p").agg(F.sum("v").alias("v"))


def loeo_ridge_coefficients(items: DataFrame, event: str, features: str, rating: str, alpha: float = 1.0) -> DataFrame:
    """``(event, coef)`` of the ridge on all other events; coef is (intercept, coefficients...).

    One aggregation gives a matrix of products per event; the table's total minus an event's own is the normal system without it,
    solved per event in tasks.  The intercept is free.  Rows without a rating or features are left out; so is the only event.
    """
    rows = items.select(event, F.col(features).cast("array<double>").alias("x"), F.col(rating).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    own = checkpoint(event_products(rows.where(F.col(event).isNotNull()), event))
    rest = own.join(own.groupBy("p").agg(F.sum("v").alias("t")), "p").select(event, F.struct("p", (F.col("t") - F.col("v")).alias("v")).alias("e"))
    rest = rest.groupBy(event).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["v"]).alias("m"))

    @F.pandas_udf("array<double>")
    def solve(matrices: pd.Series) -> pd.Series:
        out = []
        for m in matrices:
            g = np.asarray(m).reshape(math.isqrt(len(m)), -1)
            n, mean, ym = g[0, 0], g[0, 1:-1], g[0, -1]
            if n < 0.5:
                out.append(None)
                continue
            inner = g[1:-1, 1:-1] - np.outer(mean, mean) / n
            beta = np.linalg.lstsq(inner + alpha * np.eye(len(mean)), g[1:-1, -1] - mean * ym / n, rcond=None)[0]
            out.append([ym / n - mean @ beta / n, *beta])
        return pd.Series(out)

    return rest.select(event, solve("m").alias("coef")).where(F.col("coef").isNotNull())
