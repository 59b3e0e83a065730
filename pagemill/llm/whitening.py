"""Whitening of embeddings by a covariance in two passes.

Entries become whole numbers x = floor(scale * c) + shift.  The fit list holds
each distinct vector of x once.  The first pass over it sums every dimension
exactly in whole numbers, which gives n and S.  The second pass centres each
row, sums outer products as one matrix product a batch, and the sums of all
tasks are merged by treeAggregate, so the driver receives one dims x dims
matrix whatever the number of tasks.  A symmetric eigenvalue routine (LAPACK)
gives components and variances; the projection is broadcast and every row of
the table is projected.  A third pass over the fit list measures the
covariance of the whitened rows.

Centring never cancels: with S = n * q + r in whole numbers, x - S / n is
(x - q) - r / n, where x - q is exact and r / n lies between 0 and 1.

Sizes: dims is a width, not a number of rows.  A task holds one dims x dims
matrix and one Arrow batch; the broadcast is dims x components numbers.

Defined results: rows whose vector is null, or holds a null, a NaN, an
infinity or an entry whose x would be beyond 2**40, are left out, and so are
rows with another number of entries than most rows have (of equally frequent
numbers the larger counts).  Repeated rows each return their own results but
count once in the fit list.  A component whose variance is not above
dims * 2**-52 of the largest one has no scale: its whitened is null and it is left
out of identity_error.  Where no variance is left at all (one vector only)
explained and identity_error are null too.  A deviation beyond a long is null
and stands in deviation_exact, unless it has more than 38 digits.  A table
without usable rows gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

_LARGEST = 2.0**40
_SAFE = 2**62


@dataclass(frozen=True)
class WhitenPlan:
    """x = floor(scale * c) + shift; components: how many are returned at most."""

    scale: int = 64
    shift: int = 1_000_000
    components: int = 16


@dataclass(frozen=True)
class Whitening:
    """What the passes over the fit list have found; directions has one column a component, of unit length."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None

    def scales(self) -> np.ndarray:
        """1 / sqrt(variance), NaN for a component without one."""
        return _scales(self.variances, len(self.sums))


def _scales(variances: np.ndarray, dims: int) -> np.ndarray:
    top = max(float(variances[0]), 0.0) if len(variances) else 0.0
    usable = variances > top * dims * 2.0**-52
    return np.where(usable, 1 / np.sqrt(np.where(usable, variances, 1.0)), np.nan)


def whole_numbers(vector: Column, plan: WhitenPlan) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * plan.scale).cast("long") + F.lit(plan.shift).cast("long"))


def usable_rows(vectors: DataFrame, plan: WhitenPlan, vector: str, key: str) -> DataFrame:
    """(key, x) of the rows whose vectors have finite entries only."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) * plan.scale < _LARGEST, F.lit(False)))
    return vectors.filter(v.isNotNull() & fine).select(F.col(f"`{key}`").alias("key"), whole_numbers(v, plan).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _added(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))


def exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1 << 20):  # 2**20 entries below 2**41 fit a long
                x = _matrix(b.column(0).slice(lo, 1 << 20), dims)
                yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0)], pa.list_(pa.int64()))], names=["n", "sums"])

    rows = fit.select("x").mapInArrow(partial, "n long, sums array<long>").rdd
    found = rows.treeAggregate(None, lambda a, r: _added(a, (r["n"], np.array(r["sums"], object))), _added)
    return (0, []) if found is None else (int(found[0]), [int(v) for v in found[1]])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, each entry rounded once."""
    return (x - np.array([s // n for s in sums], np.int64)) - np.array([(s % n) / n for s in sums])


def products(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray | None = None) -> np.ndarray:
    """Sum of the outer products of the centred rows (times basis, where given) over all rows."""
    dims, spark = len(sums), fit.sparkSession
    shared = spark.sparkContext.broadcast((n, sums, basis))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, basis = shared.value
        total = None
        for b in batches:
            c = centred(_matrix(b.column(0), dims), n, sums)
            c = c if basis is None else c @ basis
            total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    width = dims if basis is None else basis.shape[1]
    rows = fit.select("x").mapInArrow(partial, "total binary").rdd
    found = rows.treeAggregate(None, lambda a, r: _added(a, (np.frombuffer(r["total"]).reshape(width, width),)), _added)
    shared.unpersist()
    return found[0]


def fitted(fit: DataFrame, dims: int, plan: WhitenPlan) -> Whitening | None:
    """The whitening of a table of distinct vectors x; None for an empty one."""
    n, sums = exact_sums(fit, dims)
    if not n:
        return None
    covariance = products(fit, n, sums) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: plan.components]
    directions = vectors[:, order]
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), range(len(order))] < 0, -1.0, 1.0)
    variances, trace = np.maximum(values[order], 0.0), float(np.trace(covariance))
    scales = _scales(variances, dims)
    known, error = np.isfinite(scales), None
    if known.any():
        seen = products(fit, n, sums, directions[:, known] * scales[known]) / n
        error = float(np.abs(seen - np.eye(len(seen))).max())
    return Whitening(n, sums, directions, variances, trace, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Per row the sum over dimensions of (n * x - sums) ** 2, exact."""
    off = x - np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], object)
    most = (int(np.abs(off).max(initial=0)) + 1) * n
    if most * most * max(len(sums), 1) < _SAFE:
        d = n * off - rest.astype(np.int64)
        return [int(v) for v in (d * d).sum(axis=1)]
    d = off.astype(object) * n - rest
    return [int(v) for v in (d * d).sum(axis=1)]


def whitened(vectors: DataFrame, plan: WhitenPlan | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per usable row and component, numbered from 1 by falling variance: key, component, n, deviation, whitened, explained, identity_error, variance, deviation_exact."""
    plan = plan or WhitenPlan()
    rows = usable_rows(vectors, plan, vector, key)
    kind = rows.schema["key"].dataType.simpleString()
    schema = "key " + kind + ", component int, n long, deviation long, whitened double, explained double, identity_error double, variance double, deviation_exact decimal(38,0)"
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common["dims"] if common else 0
    rows = rows.filter(F.size("x") == dims)
    model = fitted(stored(rows.select("x").distinct(), "whitening-fit"), dims, plan) if dims else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        basis, k = m.directions * m.scales(), len(m.variances)
        explained = m.variances / m.trace if m.trace > 0 else np.full(k, np.nan)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                x = _matrix(b.column(1), dims)
                z = centred(x, m.n, m.sums) @ basis
                exact = deviations(x, m.n, m.sums)
                each = np.repeat(np.arange(len(x)), k)
                column = {
                    "key": b.column(0).take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(each), m.n)),
                    "deviation": pa.array([v if v < 2**63 else None for v in exact], pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(z.ravel(), from_pandas=True),
                    "explained": pa.array(np.tile(explained, len(x)), from_pandas=True),
                    "identity_error": pa.array([m.identity_error] * len(each), pa.float64()),
                    "variance": pa.array(np.tile(m.variances, len(x))),
                    "deviation_exact": pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)).take(pa.array(each)),
                }
                yield pa.RecordBatch.from_pydict(column)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
