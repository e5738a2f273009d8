"""Embedding whitening by Chebyshev-filtered subspace iteration.

The distinct vectors are packed once into blocks of rows.  Every step of the
method is one distributed pass over these blocks, which returns the centred
product XᵀXQ of a thin block Q: tasks add up their share, shares are added in a
shuffle, and d x k numbers reach the driver.  The polynomial recurrence damps
the spectrum below the wanted part; QR and Rayleigh-Ritz then give Ritz vectors
with residuals, and rounds go on until all wanted residuals are at rounding
level.  A Lanczos vector rides along in the first round's passes and shows where
the spectrum begins, which makes the filter steep.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.sources.staging import write_stage

BLOCK_ROWS = 1024
COMPONENTS, GUARD = 16, 16
FIRST_DEGREE, LAST_DEGREE, DIGITS, ROUNDS = 6, 30, 13, 24
TOLERANCE = 1e-14
# Whole numbers beyond this are held there, so that sums of a block stay exact.
LARGEST = 1 << 50


def whole_numbers(vector: str) -> Column:
    """floor(64 c) + 1000000 of every entry, as long."""
    held = lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * 64))
    return F.transform(F.col(vector), lambda c: F.floor(held(c)).cast("long") + F.lit(1_000_000).cast("long"))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite entries."""
    return df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))))


def packed(distinct: DataFrame, dims: int) -> DataFrame:
    """Rows of x in blocks: one binary of up to BLOCK_ROWS rows of ``dims`` longs."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for i in range(0, len(x), BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([x[i:i + BLOCK_ROWS].tobytes()], pa.binary())], ["block"])

    return distinct.mapInArrow(pack, "block binary")


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """The lists as rows; a shorter one ends in zeros of the source, 1000000."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.full((len(lengths), dims), 1_000_000, "int64")
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def rows_of(block: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(block, "int64").reshape(-1, dims)


@dataclass
class Model:
    """Mean and components of the fit list."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float = 0.0
    passes: int = 0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


class Passes:
    """The distributed products of a packed table."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims, self.count = blocks, dims, 0
        got = self.run(lambda x: np.column_stack([np.full(dims, len(x)), x.sum(axis=0)]), 2, "decimal(38,0)")
        self.n, self.sums = (int(got[0, 0]) if len(got) else 0), [int(v) for v in got[:, 1]]
        self.mean = np.array([s / self.n for s in self.sums])

    def run(self, share, width: int, kind: str = "double") -> np.ndarray:
        """``share`` of each block of rows, a table of ``width`` columns, added up."""
        dims = self.dims

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for d in batches:
                for block in d["block"]:
                    v = share(rows_of(block, dims))
                    total = v if total is None else total + v
            if total is not None:
                yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        self.count += 1
        shares = self.blocks.mapInPandas(part, f"at long, v {'double' if kind == 'double' else 'bigint'}")
        cells = sorted(shares.groupBy("at").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect())  # dims x width numbers
        return np.array([r["v"] for r in cells], "float64" if kind == "double" else object).reshape(-1, width)

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q, centred before multiplying."""
        mean = self.mean

        def share(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return self.run(share, q.shape[1]) / self.n

    def spread(self) -> np.ndarray:
        """Variance of each dimension."""
        mean = self.mean
        return self.run(lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], 1)[:, 0] / self.n

    def covariance(self, w: np.ndarray) -> np.ndarray:
        """Covariance of the rows times w: small, columns of w squared."""
        mean = self.mean

        def share(x: np.ndarray) -> np.ndarray:
            y = (x - mean) @ w
            return np.vstack([y.T @ y, y.sum(axis=0)])

        got = self.run(share, w.shape[1]) / self.n
        return got[:-1] - np.outer(got[-1], got[-1])


def lowest(alphas: list[float], betas: list[float]) -> float:
    """Where the spectrum begins, from Lanczos coefficients: the least Ritz value less its residual."""
    m = len(alphas)
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:m - 1], 1) + np.diag(betas[:m - 1], -1))
    return max(0.0, float(values[0] - abs(betas[m - 1] * vectors[-1, 0]))) if m else 0.0


def fit(df: DataFrame, vector: str, components: int = COMPONENTS, seed: int = 7) -> Model | None:
    """Mean and leading components of the distinct vectors of ``df``; None if there are none.

    Components whose variance is within rounding of zero are left out, so
    equal vectors have none.
    """
    x = usable(df, vector).select(whole_numbers(vector).alias("x"))
    distinct = write_stage(x.distinct(), "distinct")  # equal rows are combined before the shuffle
    dims = distinct.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    passes = Passes(write_stage(packed(distinct, dims), "blocks"), dims)
    trace = float(passes.spread().sum())
    model = Model(passes.n, passes.sums, np.empty(0), np.empty((dims, 0)), trace)
    if trace == 0:
        return model
    want = min(components, dims)
    width = min(dims, want + max(GUARD, want))
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0]
    locked, locked_values = np.empty((dims, 0)), np.empty(0)

    # Lanczos state: it advances by one step in every pass of the first round.
    v, v0, alphas, betas = rng.standard_normal(dims), np.zeros(dims), [], []
    v /= np.linalg.norm(v)
    basis = [v]

    def outside(y: np.ndarray) -> np.ndarray:
        return y - locked @ (locked.T @ y)

    def ride(y: np.ndarray) -> None:
        nonlocal v, v0
        if len(alphas) >= dims or (betas and betas[-1] < 1e-12 * trace):
            return
        alphas.append(float(v @ y))
        w = y - alphas[-1] * v - (betas[-1] * v0 if betas else 0)
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        betas.append(float(np.linalg.norm(w)))
        v0, v = v, w / (betas[-1] or 1)
        basis.append(v)

    def product(y: np.ndarray, riding: bool = False) -> np.ndarray:
        got = passes.times(np.column_stack([y, v]) if riding else y)
        if riding:
            ride(got[:, -1])
            got = got[:, :-1]
        return outside(got)

    def filtered(y: np.ndarray, degree: int, low: float, high: float, top: float, riding: bool) -> np.ndarray:
        """Chebyshev polynomial of ``degree`` over [low, high], scaled to 1 at ``top``."""
        half, middle = (high - low) / 2, (high + low) / 2
        first = scale = half / (top - middle)
        # Iterates stay outside the locked directions: to the product these are zeros of the spectrum, far below ``low``,
        # so the polynomial would blow up the rounding that leaks into them.
        before, now = y, outside((product(y, riding) - middle * y) * (scale / half))
        for _ in range(degree - 1):
            new = 1 / (2 / first - scale)
            before, now = now, outside((product(now, riding) - middle * now) * (2 * new / half) - scale * new * before)
            scale = new
        return now

    last, high = math.inf, 0.0
    for turn in range(ROUNDS):
        aq = product(q)
        ritz, turned = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        ritz, turned = ritz[::-1], turned[:, ::-1]
        q, aq = q @ turned, aq @ turned
        top = max(ritz[0], *locked_values) if len(locked_values) else ritz[0]
        left = min(want - len(locked_values), len(ritz))
        residuals = np.linalg.norm(aq[:, :left] - q[:, :left] * ritz[:left], axis=0) / top
        worst = residuals.max(initial=0)
        # Full width is exact; else go on while rounding has not been reached and rounds still help.
        if width + locked.shape[1] >= dims or worst <= TOLERANCE or (worst <= 1e-12 and worst > last / 2):
            break
        last = worst
        done = 0
        while done < left - 1 and residuals[done] <= TOLERANCE * 4:
            done += 1
        if done:
            locked, locked_values = np.column_stack([locked, q[:, :done]]), np.append(locked_values, ritz[:done])
            q, ritz, left = q[:, done:], ritz[done:], left - done
        high = max(high, float(ritz[-1]))  # Ritz values lie below the eigenvalues they stand for
        low = min(lowest(alphas, betas), high * (1 - 1e-6))
        growth = math.acosh(max(1.0, (2 * ritz[0] - high - low) / (high - low)))
        # A degree that keeps the strongest direction within DIGITS of the damped ones, so that no column drowns in rounding.
        degree = min(LAST_DEGREE if turn else FIRST_DEGREE, max(2, int(DIGITS * math.log(10) / max(growth, 1e-9))))
        q = filtered(q, degree, low, high, float(ritz[0]), turn == 0)
        for _ in range(2):
            q = np.linalg.qr(outside(q))[0]
    values, vectors = np.append(locked_values, ritz[:left]), np.column_stack([locked, q[:, :left]])
    order = np.argsort(-values, kind="stable")[:want]
    values, vectors = values[order], vectors[:, order]
    real = values > max(1e-13 * values[0], 1e-15 * trace)
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    model.values, model.vectors, model.residual = values, vectors, float(worst)
    off = passes.covariance(vectors / np.sqrt(values)) - np.eye(len(values))
    model.identity_error, model.passes = float(np.abs(off).max()), passes.count
    return model


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    far = max(abs(n * int(v.min()) - s) if len(v) else 0 for v, s in zip(x.T, sums)) if len(x) else 0
    near = max(abs(n * int(v.max()) - s) if len(v) else 0 for v, s in zip(x.T, sums)) if len(x) else 0
    if max(far, near) ** 2 * len(sums) < 2**62:
        d = np.column_stack([n * v - s for v, s in zip(x.T, sums)])
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def whiten(df: DataFrame, key: str, vector: str, model: Model | None) -> DataFrame:
    """key, x, deviation and whitened (one number a component) of every row with a usable vector."""
    rows = usable(df, vector).select(F.col(key).alias("key"), whole_numbers(vector).alias("x"))
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, x array<bigint>, deviation bigint, whitened array<double>"
    if model is None:
        return rows.limit(0).select("key", "x", F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened"))
    n, sums, mean, dims = model.n, model.sums, model.mean, len(model.sums)
    w = model.vectors / np.sqrt(model.values)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims)
            y = (x - mean) @ w
            offsets = pa.array(np.arange(len(y) + 1) * w.shape[1], pa.int32())
            white = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(y).ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(deviation(x, n, sums), pa.int64()), white], ["key", "x", "deviation", "whitened"])

    return rows.mapInArrow(each, schema)


def components(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Fits on the distinct vectors of ``df`` and gives one row per usable row and component.

    Columns: the key, component (from 1 by falling variance), n, deviation,
    whitened, explained and identity_error.  Rows whose vector is null or holds
    a null or non-finite entry are left out; repeated vectors count once in the
    fit and are all returned; a vector shorter than the longest ends in zeros;
    an empty vector is all zeros.  Without variance there are no components
    and no rows; entries beyond 2^50/64 are held there; a deviation beyond a long
    is null.  The sign of a component makes its largest entry positive.
    """
    model = fit(df, vector)
    rows = whiten(df, key, vector, model).select(F.col("key").alias(key), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.lit([float(v) for v in model.values / model.trace] if model is not None and len(model.values) else [0.0])
    return rows.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))
