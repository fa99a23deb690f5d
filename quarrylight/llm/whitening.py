"""Embedding whitening: principal components by Jacobi-Davidson over distributed products.

The covariance is never formed. All that touches the rows is a product of the centred rows, transposed,
with the centred rows times a block of at most ``block`` columns, summed over the tasks; the driver keeps
a search space of at most ``2 * block`` directions and their products.

A row counts if its vector is there, holds no null and no non-finite entry and has the table's usual width
(the width most rows have; the larger one of a tie); other rows are dropped. Entries become whole numbers
``floor(scale * c) + shift`` (cast as Spark casts, so entries beyond a long saturate). Rows with the same
vector or key are rows of their own; null keys stay. Components are numbered by falling eigenvalue; those
whose variance is below ``FLAT`` of the largest aren't returned, as nothing can be divided by it: there
are none where all vectors are alike, and an empty table gives an empty result. ``deviation`` is exact
where it fits a long and the largest long beyond.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.session import settle

SCALE, SHIFT = 64, 1_000_000
#: A component's variance relative to the largest one's below which it counts as none.
FLAT = 1e-11
#: A residual at this many rounding units of the largest eigenvalue is as small as doubles make it.
UNITS = 64
LONGEST = (1 << 63) - 1
#: Rows that add up the tasks' blocks before the driver does.
SUMS = 16
Product = Callable[[np.ndarray], np.ndarray]


def whole_vectors(df: DataFrame, vector: str | Column = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``_x array<long>`` of the rows that count, beside the columns there were."""
    entries = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda c: c.cast("double"))
    finite = F.coalesce(F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    held = df.withColumn("_entries", entries).where(finite)
    widths = held.groupBy(F.size("_entries").alias("w")).count()
    usual = widths.orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    width = usual[0]["w"] if usual else 0
    whole = F.transform("_entries", lambda c: F.floor(c * scale).cast("long") + shift)
    return held.where(F.size("_entries") == width).withColumn("_x", whole).drop("_entries")


@dataclass
class Fit:
    """What the driver knows of the fit list: number of rows, exact sums, components in columns, their variances."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int = 0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else self.values


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n`` with one rounding: ``n * x - S`` is whole."""
    if len(x) and n * float(np.abs(x).max()) < 2.0**62:
        return (n * x - sums) / n
    return np.array([[(n * int(v) - int(s)) / n for v, s in zip(row, sums)] for row in x], dtype=float).reshape(x.shape)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``sum((n * x - S) ** 2)`` per row, in whole numbers."""
    if len(x) and (n * float(np.abs(x).max())) < 2.0**62:
        d = n * x - sums
        if float((d.astype(float) ** 2).sum(axis=1).max()) < 2.0**62:
            return (d * d).sum(axis=1)
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return np.array([min(v, LONGEST) for v in exact], dtype=np.int64)


def summed(rows: DataFrame, task: Callable[[Iterator[np.ndarray]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all tasks of what ``task`` makes of its blocks of vectors; a few partial sums reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = task(matrix(b.column(0)) for b in batches if b.num_rows)
        if total is not None:
            yield pa.record_batch({"sum": pa.array([np.ascontiguousarray(total, dtype=float).tobytes()], pa.binary())})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                more = np.frombuffer(raw.as_py())
                total = more.copy() if total is None else total + more
        if total is not None:
            yield pa.record_batch({"sum": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("_x").mapInArrow(part, "sum binary")
    found = parts.repartition(SUMS).mapInArrow(fold, "sum binary").collect()
    total = np.zeros(math.prod(shape))
    for row in found:
        total += np.frombuffer(row["sum"])
    return total.reshape(shape)


def covariance_product(rows: DataFrame, n: int, sums: np.ndarray) -> Product:
    """``V @ block`` for the covariance ``V`` of the rows, one pass each."""

    def product(block: np.ndarray) -> np.ndarray:
        def task(blocks):
            total = None
            for x in blocks:
                d = centred(x, n, sums)
                more = d.T @ (d @ block)
                total = more if total is None else total + more
            return total

        return summed(rows, task, block.shape) / n

    return product


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal directions of a block outside those of ``against``; what vanishes there is left out."""
    kept = against
    new = []
    for t in block.T:
        size = np.linalg.norm(t)
        if not np.isfinite(size) or size == 0:
            continue
        t = t / size
        for _ in range(3):  # once is not enough where little is left
            t = t - kept @ (kept.T @ t)
            left = np.linalg.norm(t)
            if left < 1e-10:
                break
            t = t / left
        else:
            new.append(t)
            kept = np.column_stack([kept, t])
    return np.array(new).T if new else np.zeros((len(block), 0))


def minres(product: Product, thetas: np.ndarray, rhs: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Approximate solutions of ``P (V - theta_k) P t_k = rhs_k`` for all columns at once, one product a step.

    Every column has its own Lanczos recurrence and Givens rotations; they share only the pass over the rows.
    A column whose recurrence ends keeps what it has.
    """
    v = project(rhs)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = np.divide(v, beta, out=np.zeros_like(v), where=live)
    old_v, w, old_w, t = (np.zeros_like(v) for _ in range(4))
    eta, c, s, old_c, old_s, old_beta = beta.copy(), np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = project(product(v) - v * thetas)
        alpha = (v * p).sum(axis=0)
        p = project(p - v * alpha - old_v * old_beta)
        beta = np.linalg.norm(p, axis=0)
        delta, far = c * alpha - old_c * s * old_beta, old_s * old_beta
        near, rho = s * alpha + old_c * c * old_beta, np.hypot(delta, beta)
        live &= rho > 1e-300
        safe = np.where(live, rho, 1.0)
        new_c, new_s = delta / safe, beta / safe
        new_w = (v - w * near - old_w * far) / safe
        t = t + np.where(live, new_c * eta, 0.0) * new_w
        eta = -new_s * eta
        live &= beta > 1e-14 * np.maximum(np.abs(thetas), 1e-300)
        old_v, v = v, np.divide(p, beta, out=np.zeros_like(p), where=live)
        old_w, w, old_c, old_s, c, s, old_beta = w, new_w, c, s, new_c, new_s, beta
    return t


def jacobi_davidson(product: Product, width: int, wanted: int, block: int = 48, inner: int = 6, rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their eigenvectors in columns.

    A round is Rayleigh-Ritz in the search space, locking of the leading Ritz pairs whose residual is as small
    as doubles make it, and new directions from the correction equations of the next ones, projected off the
    locked vectors and all current Ritz vectors. Residuals that lead to a lock come from a fresh product, so
    sums that drifted over restarts can't pass. Ends when all wanted pairs are locked, or when the search space
    is the whole space and fresh products bring nothing further.
    """
    wanted, block = min(wanted, width), min(block, width)
    draw = np.random.default_rng(seed)
    empty = np.zeros((width, 0))
    locked, locked_values = empty, np.zeros(0)
    space = orthonormal(draw.standard_normal((width, block)), empty)
    images = product(space)
    for _ in range(rounds):
        small = space.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn, values = turn[:, ::-1], values[::-1]
        space, images = space @ turn, images @ turn
        top = max([float(values[0]) if len(values) else 0.0, *locked_values[:1]])
        limit = UNITS * np.finfo(float).eps * max(top, np.finfo(float).tiny) * max(1.0, math.sqrt(width) / 8)
        open_ones = wanted - len(locked_values)
        ritz, thetas = space[:, :open_ones], values[:open_ones]
        residual = images[:, :open_ones] - ritz * thetas
        size = np.linalg.norm(residual, axis=0)
        whole = space.shape[1] + locked.shape[1] >= width
        if len(size) and (size[0] <= limit or whole):  # leading pairs look finished: measure them anew
            images[:, :open_ones] = product(ritz)
            thetas = (ritz * images[:, :open_ones]).sum(axis=0)
            residual = images[:, :open_ones] - ritz * thetas
            size = np.linalg.norm(residual, axis=0)
            done = len(size) if whole and (size <= 16 * limit).all() else int(np.argmin(np.append(size <= limit, False)))
            locked, locked_values = np.column_stack([locked, ritz[:, :done]]), np.append(locked_values, thetas[:done])
            space, images = space[:, done:], images[:, done:]
            if len(locked_values) >= wanted:
                break
            ritz, thetas, residual = ritz[:, done:], thetas[done:], residual[:, done:]
        if space.shape[1] + len(thetas) > 2 * block:  # restart with the best Ritz vectors
            space, images = space[:, :block], images[:, :block]
        held = np.column_stack([locked, ritz])
        off = lambda t: (lambda once: once - held @ (held.T @ once))(t - held @ (held.T @ t))  # noqa: E731, B023
        more = orthonormal(minres(product, thetas, -residual, off, inner), np.column_stack([locked, space]))
        if not more.shape[1]:
            more = orthonormal(draw.standard_normal((width, min(block, width - locked.shape[1] - space.shape[1]))), np.column_stack([locked, space]))
        if more.shape[1]:
            space, images = np.column_stack([space, more]), np.column_stack([images, product(more)])
    else:
        raise ArithmeticError(f"{len(locked_values)} of {wanted} components converged in {rounds} rounds")
    order = np.argsort(-locked_values, kind="stable")
    return locked_values[order], locked[:, order]


def fit(rows: DataFrame, components: int = 32) -> Fit:
    """Components of all rows of ``_x``; every figure covers the whole table."""
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("width")).first()
    n, width = first["n"], first["width"] or 0
    if not n or not width:
        return Fit(n, [0] * width, np.zeros((width, 0)), np.zeros(0), 0.0)
    #: Sums of longs as decimals: exact at any number of rows.
    sums = rows.agg(*(F.sum(F.get("_x", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width))).first()
    sums = [int(v) for v in sums]
    held = np.array(sums, dtype=np.int64 if max(map(abs, sums)) < 1 << 62 else object)

    def squares(blocks):
        total = None
        for x in blocks:
            more = (centred(x, n, held) ** 2).sum(axis=0)
            total = more if total is None else total + more
        return total

    trace = float(summed(rows, squares, (width,)).sum()) / n
    if trace == 0:
        return Fit(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    passes = 0
    once = covariance_product(rows, n, held)

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return once(block)

    values, vectors = jacobi_davidson(product, width, components, block=min(width, components + 16))
    real = values > FLAT * values[0]
    return Fit(n, sums, vectors[:, real], values[real], trace, passes)


def white(x: np.ndarray, model: Fit, sums: np.ndarray) -> np.ndarray:
    return centred(x, model.n, sums) @ (model.vectors / np.sqrt(model.values))


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; centred by their own mean."""
    k = len(model.values)
    if not k:
        return 0.0
    sums = np.array(model.sums)
    total = lambda blocks, of: sum((of(white(x, model, sums)) for x in blocks), start=0.0)
    mean = summed(rows, lambda blocks: some(total(blocks, lambda z: z.sum(axis=0))), (k,)) / model.n
    spread = summed(rows, lambda blocks: some(total(blocks, lambda z: (z - mean).T @ (z - mean))), (k, k)) / model.n
    return float(np.abs(spread - np.eye(k)).max())


def some(total):
    """None where a task had no rows."""
    return None if isinstance(total, float) else total


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per vector that counts and component: ``_id, component, n, deviation, whitened, explained, identity_error``."""
    rows = settle(whole_vectors(df.select(F.col(key).alias("_id"), F.col(vector).alias("_vector")), "_vector").select("_id", "_x"), "whole-vectors")
    model = fit(rows, components)
    error = identity_error(rows, model)
    sums, explained = np.array(model.sums), model.explained.tolist()
    k = len(explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column("_x"))
            z = white(x, model, sums)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k), pa.int32()), pa.array(z.ravel()))
            yield pa.record_batch({"_id": batch.column("_id"), "deviation": pa.array(deviations(x, model.n, sums)), "z": flat})

    kind = rows.schema["_id"].dataType.simpleString()
    told = rows.mapInArrow(project, f"_id {kind}, deviation long, z array<double>")
    shares = F.lit(explained).cast("array<double>") if k else F.array().cast("array<double>")
    told = told.select("_id", "deviation", F.posexplode("z").alias("place", "whitened"))
    return told.select(
        "_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
