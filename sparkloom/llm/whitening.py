"""Whitening of vectors from an exact integer scatter matrix.

Components become integers (``floor(scale * c)``), and the distinct integer vectors are the fit list.
Tasks take a shift away, accumulate sums and cross-products of the list as integers of any size, and
pass them on in digits, which Spark adds up.  n * X'X - S S' is formed from them exactly, whatever the
shift; only then do numbers become floating point and get decomposed (``eigh``).

A vector that is null, or holds null or non-finite components, takes no part.  Vectors of fewer
dimensions count as filled up with zeros; scaled components beyond +-2^62 count as that.  No vectors
give no rows; components without variance (one distinct vector has no others) are left out, and an
empty vector is a vector of zeros.  Repeated rows, null keys and equal keys each give their own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows whose products are added at once, and bits of a limb: limbs are at most 2^20, so a block's sums of
#: products stay below 2^52 and are exact in double precision.
ROWS, BITS = 1 << 12, 21
#: Digits in which sums travel: with values below 2^32, 2^31 tasks' digits fit a long.
DIGIT = 32
MOST = 1 << 62


def shifted(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, floor(scale * c) of their components as a matrix).

    The contract's x is that plus ``SHIFT``; every formula here is of differences from means, in which the
    shift cancels exactly, so it is taken away before anything is multiplied.
    """
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.where(vectors.is_null().to_numpy(zero_copy_only=False), -1, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    taken = np.maximum(lengths, 0)
    flat = vectors.flatten()
    value = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), taken)
    good = (lengths >= 0) & (np.bincount(row[~np.isfinite(value)], minlength=len(lengths)) == 0)
    place = np.cumsum(np.where(good, 1, 0)) - 1
    keep = good[row]
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(value[keep] * scale), -float(MOST), float(MOST)).astype(np.int64)
    out = np.zeros((int(good.sum()), int(taken[good].max(initial=0))), np.int64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(taken) - taken, taken)
    out[place[row[keep]], at[keep]] = whole
    return np.flatnonzero(good), out


def encode(matrix: np.ndarray) -> list[bytes]:
    """Each row's bytes: as few for a component as all its components fit, without zeros at the end."""
    most = np.abs(matrix).max(axis=1, initial=0)
    size = np.where(most < 1 << 7, 1, np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8)))
    used = np.where(matrix != 0, np.arange(1, matrix.shape[1] + 1), 0).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(matrix)
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        data, step = matrix[rows].astype(f"<i{s}").tobytes(), matrix.shape[1] * int(s)
        for k, r in enumerate(rows):
            out[r] = bytes([s]) + data[k * step : k * step + int(used[r]) * int(s)]
    return out


def decode(rows: list[bytes], width: int = 0) -> np.ndarray:
    width = max([width, *((len(r) - 1) // r[0] for r in rows)])
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : (len(r) - 1) // r[0]] = np.frombuffer(r, f"<i{r[0]}", offset=1)
    return out


def limbs(matrix: np.ndarray) -> list[np.ndarray]:
    """The matrix in balanced limbs of ``BITS`` bits, lowest first, as doubles."""
    out = []
    while not out or matrix.any():
        low = ((matrix + (1 << (BITS - 1))) & ((1 << BITS) - 1)) - (1 << (BITS - 1))
        out.append(low.astype(np.float64))
        matrix = (matrix - low) >> BITS
    return out


class Scatter:
    """Count, sums and cross-products of integer rows, exact at any size."""

    def __init__(self) -> None:
        self.n, self.sums, self.products = 0, np.zeros(0, object), np.zeros((0, 0), object)

    def add(self, matrix: np.ndarray) -> None:
        old = len(self.sums)
        if matrix.shape[1] > old:
            sums, products = self.sums, self.products
            self.sums, self.products = np.zeros(matrix.shape[1], object), np.zeros((matrix.shape[1],) * 2, object)  # of Python's zeros
            self.sums[:old], self.products[:old, :old] = sums, products
        for i in range(0, len(matrix), ROWS):
            parts = limbs(matrix[i : i + ROWS])
            self.n += len(parts[0])
            width = parts[0].shape[1]
            for a, x in enumerate(parts):
                self.sums[:width] += x.sum(0).astype(np.int64).astype(object) * (1 << BITS * a)
                for b, y in enumerate(parts):
                    self.products[:width, :width] += (x.T @ y).astype(np.int64).astype(object) * (1 << BITS * (a + b))

    def digits(self) -> Iterator[tuple[int, int, int, int]]:
        """(row, column, digit's place, digit): the count at (-1, -1), sums in row -1, products at column >= row."""
        width = len(self.sums)
        cells = [(-1, -1, self.n), *((-1, j, self.sums[j]) for j in range(width)), *((i, j, self.products[i, j]) for i in range(width) for j in range(i, width))]
        for i, j, value in cells:
            rest, at, sign = abs(int(value)), 0, 1 if value > 0 else -1
            while rest:
                yield i, j, at, sign * (rest & ((1 << DIGIT) - 1))
                rest, at = rest >> DIGIT, at + 1


@dataclass
class Whitening:
    """Mean sums/n (of shifted integers), unit components in columns, their variances, and the trace of all."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(n * x - S, exact; it again if its squares' sum surely fits a long)."""
        most = self.n * int(np.abs(matrix).max(initial=0)) + max(map(abs, self.sums), default=0)
        fits = most * most * max(1, len(self.sums)) < 1 << 63
        kind = np.int64 if fits else object
        exact = matrix.astype(kind) * self.n - np.array(self.sums, kind)
        return exact, exact if fits else None

    def whiten(self, exact: np.ndarray) -> np.ndarray:
        return (exact / self.n).astype(np.float64) @ self.components / np.sqrt(self.values)


def solve(n: int, sums: list[int], products: list[list[int]], k: int) -> Whitening:
    """Components of the covariance (n * P - S S') / n^2, whose integers become floats last."""
    width = len(sums)
    cov = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(width)] for i in range(width)], np.float64).reshape(width, width)
    trace = sum(n * products[i][i] - sums[i] ** 2 for i in range(width)) / (n * n)
    values, vectors = np.linalg.eigh(cov) if width else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > width * np.finfo(float).eps * values.max(initial=0)).sum())
    values, vectors = values[: min(k, rank)], vectors[:, : min(k, rank)]
    if len(values):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1, 1)
    return Whitening(n, sums, vectors, values, trace)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield decode(batch.column("x").slice(i, ROWS).to_pylist())


def distinct(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """(x): every distinct integer vector once, as bytes of ``encode``; equal ones meet first inside tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encode(shifted(batch.column(0), scale)[1]), pa.binary())], names=["x"])

    return df.select(vector).mapInArrow(run, "x binary").distinct()


def fit(listed: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list; None of an empty one.  The driver gets the digits of d * (d + 3) / 2 + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter()
        for matrix in _rows(batches):
            total.add(matrix)
        found = list(total.digits())
        if found:
            i, j, at, digit = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(at, pa.int32()), pa.array(digit, pa.int64())], names=["i", "j", "at", "digit"])

    cells: dict[tuple[int, int], int] = {}
    for i, j, at, digit in listed.mapInArrow(run, "i int, j int, at int, digit bigint").groupBy("i", "j", "at").agg(F.sum("digit")).collect():
        cells[i, j] = cells.get((i, j), 0) + (digit << DIGIT * at)
    n = cells.get((-1, -1), 0)
    if not n:
        return None
    width = 1 + max((j for _, j in cells), default=-1)
    products = [[cells.get((min(i, j), max(i, j)), 0) for j in range(width)] for i in range(width)]
    return solve(n, [cells.get((-1, j), 0) for j in range(width)], products, k)


def identity_error(listed: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened list's covariance minus the identity.

    Measured on the whitened rows themselves, which are centred before they are multiplied.
    """
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for matrix in _rows(batches):
            z = model.whiten(model.centred(_fill(matrix, len(model.sums)))[0])
            sums += z.sum(0)
            products += z.T @ z
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i - 1, pa.int32()), pa.array(j, pa.int32()), pa.array(np.vstack((sums, products)).ravel())], names=["i", "j", "value"])

    if not k:
        return 0.0
    got = {(i, j): value for i, j, value in listed.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect()}
    return max(abs(got[i, j] / model.n - got[-1, i] * got[-1, j] / model.n**2 - (i == j)) for i in range(k) for j in range(k))


def _fill(matrix: np.ndarray, width: int) -> np.ndarray:
    """The matrix at the list's width; what is cut off are zeros, which no vector of the list has further on."""
    return np.pad(matrix, ((0, 0), (0, max(0, width - matrix.shape[1]))))[:, :width]


def _deviation(exact: np.ndarray, fits: np.ndarray | None) -> tuple[pa.Array, pa.Array]:
    if fits is not None:
        return pa.array((fits * fits).sum(1), pa.int64()), pa.nulls(len(fits), pa.string())
    whole = [int(v) for v in (exact * exact).sum(1)] if exact.shape[1] else [0] * len(exact)
    return pa.array([v if v < 1 << 63 else None for v in whole], pa.int64()), pa.array([None if v < 1 << 63 else str(v) for v in whole], pa.string())


def _whitened(model: Whitening, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, matrix = shifted(batch.column(1), scale)
            keys = batch.column(0).take(pa.array(kept))
            for i in range(0, len(kept), ROWS):
                exact, fits = model.centred(_fill(matrix[i : i + ROWS], len(model.sums)))
                z = model.whiten(exact)
                each = pa.array(np.repeat(np.arange(len(z)), k))
                deviation, digits = _deviation(exact, fits)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(i, ROWS).take(each), pa.array(np.tile(np.arange(1, k + 1), len(z)), pa.int32()), deviation.take(each), pa.array(z.ravel()), pa.array(np.tile(model.values / model.trace, len(z))), digits.take(each)],
                    names=["key", "component", "deviation", "whitened", "explained", "deviation_digits"],
                )

    return run


def whiten(spark: SparkSession, df: DataFrame, key: str, vector: str, k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each whole vector of ``df`` and each of the ``k`` first components.

    Columns: the key, component (from 1, by falling variance), n (distinct vectors), deviation (sum over
    dimensions of (n*x-S)^2; null where that doesn't fit a long, and then in deviation_digits in full),
    whitened, explained (share of the variance), identity_error (one value, see ``identity_error``).
    Other columns are left out.  See the module for odd vectors.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"key {kind}, component int, deviation bigint, whitened double, explained double, deviation_digits string"
    work = Workspace(spark, "whitening")
    listed = work.save(distinct(df, vector, scale), "list")
    model = fit(listed, k) or solve(1, [], [], k)
    error = identity_error(listed, model)
    work.drop(listed)
    out = df.select(key, vector).mapInArrow(_whitened(model, scale), schema)
    return out.select(F.col("key").alias(key), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"), "deviation_digits")


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector of ``embeddings`` on the 16 first components; see ``whiten``."""
    return whiten(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
