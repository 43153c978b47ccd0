"""Whitened principal components from an exact covariance, by the polarisation identity.

Entries become whole numbers, so all sums are exact. What is aggregated are squares alone: of every
centred dimension and of the sum of every pair of centred dimensions. The variance of a sum is
``V(i + j) = V(i) + V(j) + 2 C(i, j)``, so half the difference of variances is the covariance.

Tasks centre at the whole number next to the mean and sum squares of whole numbers; what rounding
the mean leaves, less than half per entry, is put right in the totals: with ``y`` the entries centred
this way, ``n * sum(y * y) - sum(y) ** 2`` is n squared times the variance, without any rounding. The
covariance matrix is rounded once, to doubles, for ``eigh``.

Every task sends one row per pair of dimensions whatever its number of vectors, and the totals, a
number per pair of dimensions, reach the driver: a bound by the square of the dimension alone. The
vectors stay where they are; each pass is a scan.

Defined results: rows whose vector is null, or has a null, NaN or infinite entry, are left out, and so
are vectors of another length than the most frequent one (of several, the longest), since entries
are missing there. Whole numbers beyond 2**62 are held at that bound. Rows without key and repeated
rows count like all others. A direction without variance cannot be whitened: its components are 0.0
and it is left out of ``identity_error``. ``deviation`` is null where the number is beyond a long;
``deviation_exact`` holds it up to 38 digits. No vectors give no rows; a vector has as many
components as dimensions, if these are fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the whole-number entries.
SCALE, SHIFT = 1024, 100_000
HELD = 2 ** 62
COMPONENTS = 8

#: Sums are carried as ``high * 2**60 + low``.
LOW_BITS = 60
#: Below this, squares of pair sums of a million rows fit 64 bits.
NARROW = 2 ** 20
#: Entries per step of a task.
STEP = 1 << 20

RESULT = ("component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_exact decimal(38,0)")


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``(key, component, n, deviation, whitened, explained,
    identity_error, deviation_exact)``."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows, width = usable(vectors, key, vector)
    n, sums = (0, []) if not width else _sums(rows, width)
    if not n:
        return spark.createDataFrame([], f"{key} {kind}, {RESULT}")
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    covariance = polarised(rows, width, n, centre, rest)
    values, axes = components_of(covariance, components)
    trace = float(np.trace(covariance))
    flat = values <= width * np.finfo(float).eps * max(trace, 0.0)
    scale = np.where(flat, 0.0, 1.0 / np.sqrt(np.where(flat, 1.0, values)))
    project = _Projection(n, centre, rest, axes * scale)
    error = _identity_error(rows, project, n, ~flat)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    out = rows.mapInArrow(partial(_whitened, project, explained.tolist(), error), f"__id {kind}, {RESULT}")
    return out.withColumnRenamed("__id", key)


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows ``(__id, v)`` of complete, finite vectors and their length."""
    bare = vectors.select(F.col(key).alias("__id"), F.col(vector).cast("array<double>").alias("v"))
    finite = bare.where(F.forall("v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))))
    lengths = finite.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width"))
    found = lengths.first()
    width = found["width"] if found else 0
    return finite.where(F.size("v") == width), width


def whole(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Pieces of the batch's vectors as whole numbers, one row per vector."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    step = max(1, STEP // width)
    for at in range(0, len(flat), step):
        scaled = np.clip(np.floor(flat[at:at + step] * SCALE), -float(HELD), float(HELD))
        yield slice(at, at + step), scaled.astype(np.int64) + SHIFT


class _Total:
    """Exact running sums of whole numbers of any size."""

    def __init__(self, size: int):
        self.high, self.low = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.wide: np.ndarray | None = None

    def add(self, part: np.ndarray) -> None:
        if part.dtype == object:
            self.wide = part if self.wide is None else self.wide + part
            return
        total = self.low + part
        self.high += total >> LOW_BITS
        self.low = total & ((1 << LOW_BITS) - 1)

    def rows(self) -> pa.RecordBatch:
        wide = [0] * len(self.low) if self.wide is None else self.wide.tolist()
        high = [Decimal(int(h) + (w >> LOW_BITS)) for h, w in zip(self.high.tolist(), wide)]
        low = [Decimal(int(l) + (w & ((1 << LOW_BITS) - 1))) for l, w in zip(self.low.tolist(), wide)]
        kind = pa.decimal128(38, 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(low)), pa.int64()), pa.array(high, kind), pa.array(low, kind)], ["place", "high", "low"])


def _totals(rows: DataFrame, summed: partial, size: int) -> list[int]:
    """Add up what the tasks send: ``size`` whole numbers."""
    sent = rows.mapInArrow(summed, "place long, high decimal(38,0), low decimal(38,0)")
    added = sent.groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    out = [0] * size
    for row in added:
        out[row["place"]] = (int(row["high"]) << LOW_BITS) + int(row["low"])
    return out


def _narrow(numbers: np.ndarray) -> bool:
    return not numbers.size or -NARROW < numbers.min() <= numbers.max() < NARROW


def _sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""
    *sums, n = _totals(rows, partial(_sum, width), width + 1)
    return n, sums


def _sum(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _Total(width + 1)
    for batch in batches:
        for _, x in whole(batch, width):
            part = (x if _narrow(x) else x.astype(object)).sum(axis=0)
            total.add(np.append(part, np.array([len(x)], part.dtype)))
    yield total.rows()


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    y = x - np.array(centre, np.int64) if _narrow(x) else x.astype(object) - np.array(centre, object)
    return y if y.dtype == object and not _narrow(y) else y.astype(np.int64)


def _squares(width: int, centre: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _Total(width * (width + 1) // 2)
    for batch in batches:
        for _, x in whole(batch, width):
            y = np.ascontiguousarray(centred(x, centre).T)
            parts = [(y * y).sum(axis=1)]
            for i in range(width - 1):
                pair = y[i] + y[i + 1:]
                parts.append((pair * pair).sum(axis=1))
            total.add(np.concatenate(parts))
    yield total.rows()


def polarised(rows: DataFrame, width: int, n: int, centre: list[int], rest: list[int]) -> np.ndarray:
    """The covariance matrix, each entry rounded once from the exact quotient."""
    squares = iter(_totals(rows, partial(_squares, width, centre), width * (width + 1) // 2))
    alone = [n * next(squares) - r * r for r in rest]  # n squared times the variance
    out = np.zeros((width, width))
    for i in range(width):
        out[i, i] = alone[i] / (n * n)
        for j in range(i + 1, width):
            both = n * next(squares) - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - alone[i] - alone[j]) / (2 * n * n)
    return out


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their unit vectors as columns; the largest entry of each is positive."""
    values, axes = np.linalg.eigh(covariance)
    first = np.argsort(-values, kind="stable")[:most]
    values, axes = np.maximum(values[first], 0.0), axes[:, first]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    return values, axes * signs


class _Projection:
    def __init__(self, n: int, centre: list[int], rest: list[int], axes: np.ndarray):
        self.n, self.centre, self.rest, self.axes = n, centre, rest, axes
        self.off = np.array([r / n for r in rest])

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sums of ``(n * x - S) ** 2``."""
        most = int(max(abs(int(y.min())), abs(int(y.max())))) + 1
        wide = y.shape[1] * (self.n * most) ** 2 >= 2 ** 63
        y, rest = (y.astype(object), np.array(self.rest, object)) if wide else (y, np.array(self.rest, np.int64))
        apart = y * self.n - rest
        return (apart * apart).sum(axis=1).tolist()

    def __call__(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(float) - self.off) @ self.axes


def _identity_error(rows: DataFrame, project: _Projection, n: int, used: np.ndarray) -> float:
    """Largest deviation of the whitened covariance from the identity."""
    sent = rows.mapInArrow(partial(_products, project), "place long, total double")
    k = len(used)
    flat = np.zeros(k * (k + 1))
    for row in sent.groupBy("place").agg(F.sum("total").alias("total")).collect():
        flat[row["place"]] = row["total"]
    means = flat[:k] / n
    off = np.abs(flat[k:].reshape(k, k) / n - np.outer(means, means) - np.eye(k))[np.ix_(used, used)]
    return float(off.max()) if off.size else 0.0


def _products(project: _Projection, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width, k = project.axes.shape
    sums = np.zeros(k * (k + 1))
    for batch in batches:
        for _, x in whole(batch, width):
            w = project(centred(x, project.centre))
            sums += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int64()), pa.array(sums)], ["place", "total"])


def _whitened(project: _Projection, explained: list[float], error: float,
              batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width, k = project.axes.shape
    for batch in batches:
        for at, x in whole(batch, width):
            y = centred(x, project.centre)
            exact = project.deviations(y)
            rows = np.repeat(np.arange(at.start, at.start + len(y)), k)
            spread = [d for d in exact for _ in range(k)]
            yield pa.RecordBatch.from_arrays([
                batch.column("__id").take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(rows), project.n)),
                pa.array([d if d < 2 ** 63 else None for d in spread], pa.int64()),
                pa.array(project(y).ravel()),
                pa.array(explained * len(y), pa.float64()),
                pa.array(np.full(len(rows), error)),
                pa.array([Decimal(d) if d < 10 ** 38 else None for d in spread], pa.decimal128(38, 0)),
            ], ["__id", *[part.split()[0] for part in RESULT.split(", ")]])
