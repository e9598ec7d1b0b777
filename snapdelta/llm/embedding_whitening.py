"""Whitening of embeddings with refined principal components.

Entries become whole numbers ``x = floor(64 * c) + 1000000``. The covariance is that of
the distinct whole-number vectors. It is summed exactly: every dimension is centred by its
rounded mean before multiplying, products are added as whole numbers in the tasks and as
decimals by Spark, and what rounding the mean leaves is taken off exactly. So neither the
order of rows nor that of tasks shows in the result.

The components start as float32 eigenvectors and are refined by matrix products alone
(Ogita and Aishima): in double precision until the correction stops shrinking, then in
extended precision. Eigenvalues closer than the error of a step form a cluster; a cluster
is solved anew in its own subspace, shifted by its mean, before the next step.

The driver holds matrices of the vector length only. Tasks hold one batch of vectors and
one such matrix; a matrix leaves a task as rows of entries that Spark adds up.

Defined cases: rows whose vector is null, empty, or holds null, NaN or infinite entries
take no part. A null id stays null; repeated rows are whitened each and fitted once. An
entry whose whole number would pass 2^50 in size counts as 2^50. All remaining vectors
must have one length, else the job fails. A component without variance cannot be scaled:
its ``whitened`` is null, and ``explained`` too if no component has any. ``deviation`` is
null where it does not fit a long. Without rows the result is empty. Columns but the
named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.sources.shared_storage import stored

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 50)
_LONG = (1 << 63) - 1


def _usable(vector: Column) -> Column:
    def fine(entry: Column) -> Column:
        return entry.isNotNull() & ~F.isnan(entry) & (F.abs(entry) < float("inf"))

    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")

    def whole(entry: Column) -> Column:
        bounded = F.greatest(F.least(entry * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(bounded).cast("bigint") + SHIFT

    return rows.where(_usable(vector)).select(
        F.col(f"`{id_col}`").alias("vec_id"), F.transform(vector, whole).alias("x")
    )


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _entry_sums(fit: DataFrame, length: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, object]:
    """Sums over all tasks of ``part`` (a flat array per slice of vectors), by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            made = part(_matrix(batch.column(0), length))
            total = made if total is None else total + made
        if total is not None:
            values = [str(v) for v in total.tolist()] if kind == "decimal" else total.tolist()
            columns = [pa.array(range(len(total)), pa.int64()), pa.array(values, pa.string() if kind == "decimal" else pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "value"])

    exact = kind == "decimal"
    sums = fit.select("x").mapInArrow(run, f"place long, value {'string' if exact else 'double'}")
    value = F.col("value").cast("decimal(38,0)") if exact else F.col("value")
    return {r[0]: (int(r[1]) if exact else r[1]) for r in sums.groupBy("place").agg(F.sum(value)).collect()}


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Upper triangle of the sum of products, exact, as Python or 64-bit integers."""
    upper = np.triu_indices(y.shape[1])
    largest = int(np.abs(y).max(initial=0))
    if largest >= 1 << 25:  # products or their sums could pass a double's whole numbers
        wide = y.astype(object)
        return wide.T.dot(wide)[upper]
    rows = max(1, (1 << 53) // max(1, largest * largest))
    total = np.zeros(len(upper[0]), object)
    for start in range(0, len(y), rows):
        part = y[start:start + rows].astype(np.float64)
        total = total + (part.T @ part)[upper].astype(np.int64).astype(object)
    return total


def covariance(fit: DataFrame, length: int) -> tuple[int, list[int], list[list[Fraction]]]:
    """Number of vectors, sums per dimension and the exact covariance, divisor n."""
    n = fit.count()
    sums = _entry_sums(fit, length, lambda x: x.astype(object).sum(axis=0), "decimal")
    sums = [sums[i] for i in range(length)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(middle, np.int64)
    products = _entry_sums(fit, length, lambda x: _exact_products(x - centre), "decimal")
    rest = [s - n * m for s, m in zip(sums, middle)]
    matrix = [[Fraction(0)] * length for _ in range(length)]
    for place, (i, j) in enumerate(zip(*np.triu_indices(length))):
        matrix[i][j] = matrix[j][i] = Fraction(n * products[place] - rest[i] * rest[j], n * n)
    return n, sums, matrix


def _extended(value: Fraction) -> np.longdouble:
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


def _clusters(values: np.ndarray, width) -> list[slice]:
    """Runs of at least two falling eigenvalues, each within ``width`` of the next."""
    cuts = np.flatnonzero(np.abs(np.diff(values)) > width) + 1
    bounds = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:]) if b - a > 1]


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: better vectors, their eigenvalues, their error bound, what was
    left of orthogonality and of the off-diagonal before it."""
    one = np.eye(len(a), dtype=a.dtype)
    r = one - x.T @ x
    s = x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    scale = np.abs(values).max(initial=0)
    off = np.linalg.norm((s - np.diag(values)).astype(np.float64), 2)
    bound = 2 * (off + float(scale) * np.linalg.norm(r.astype(np.float64), 2))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > bound
    rest = s + values[None, :] * r
    e = np.where(apart, rest / np.where(apart, gap, 1), r / 2)
    np.fill_diagonal(rest, 0)
    left = max(float(np.abs(r).max()), float(np.abs(rest).max()) / float(scale))
    return x + x @ e, values, a.dtype.type(bound), left


def _orthonormal(x: np.ndarray, times: int = 3) -> np.ndarray:
    """Within a cluster a step may turn far; its square is then left in the products of columns."""
    for _ in range(times):
        x = x + x @ (np.eye(len(x), dtype=x.dtype) - x.T @ x) / 2
    return x


def _solved_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, width) -> np.ndarray:
    """Solves each cluster in its subspace, shifted by its mean so that no digits cancel."""
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    for run in _clusters(values, width):
        inside = x[:, run]
        mean = values[run].mean()
        small = inside.T @ (a @ inside - mean * inside)
        small = (small + small.T) / 2
        scale = np.abs(small).max()
        if scale > 0:
            x[:, run] = inside @ np.linalg.eigh((small / scale).astype(np.float64))[1].astype(a.dtype)
    return x


def eigen(matrix: list[list[Fraction]], steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, in extended precision."""
    exact = np.array([[_extended(v) for v in row] for row in matrix], np.longdouble)
    scale = np.abs(exact).max(initial=0)
    if scale == 0:
        return np.zeros(len(exact), np.longdouble), np.eye(len(exact), dtype=np.longdouble)
    exact = exact / scale
    x = np.linalg.eigh(exact.astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        a, x = exact.astype(kind), x.astype(kind)
        before = float("inf")
        for _ in range(steps):
            refined, values, bound, left = _step(a, x)
            x = _orthonormal(_solved_clusters(a, refined, values, bound))
            if left >= before / 2 and before < 1e-6:
                break
            before = left
    x = _orthonormal(_step(a, x)[0])
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


@dataclass(frozen=True)
class Model:
    """``projection[:, k]``: component k over the root of its eigenvalue (NaN without variance)."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: list[float | None]


def _projected(x: np.ndarray, model: Model) -> np.ndarray:
    centred = _deviations(x, model).astype(np.float64) / model.n
    return centred @ model.projection


def _deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """``n * x - S``, exact: 64-bit where every product fits, else Python integers."""
    if int(np.abs(x).max(initial=0)) * model.n < 1 << 62 and max(map(abs, model.sums)) < 1 << 62:
        return x * np.int64(model.n) - np.array(model.sums, np.int64)
    return x.astype(object) * model.n - np.array(model.sums, object)


def _squares(deviations: np.ndarray) -> list[int | None]:
    largest = int(np.abs(deviations).max(initial=0))
    if largest * largest * deviations.shape[1] <= _LONG:
        return (deviations * deviations).sum(axis=1).tolist()
    sums = (deviations.astype(object) ** 2).sum(axis=1).tolist()
    return [s if s <= _LONG else None for s in sums]


def fit_model(fit: DataFrame, length: int, components: int) -> Model:
    n, sums, matrix = covariance(fit, length)
    values, vectors = eigen(matrix)
    # Below this share of the largest eigenvalue there is nothing but rounding.
    held = values > values.max(initial=0) * length * np.longdouble(2.0) ** -58
    roots = np.where(held, np.sqrt(np.where(held, values, 1)), np.longdouble("nan"))
    trace = _extended(sum((matrix[i][i] for i in range(length)), Fraction(0)))
    explained = [float(v / trace) if trace > 0 else None for v in np.maximum(values, 0)[:components]]
    return Model(n, sums, (vectors / roots)[:, :components].astype(np.float64), explained)


def identity_error(fit: DataFrame, length: int, model: Model) -> float:
    """Largest entry of the whitened fit vectors' covariance minus the identity.

    Components without variance are left out. Whitened vectors are centred already; what
    rounding leaves of their mean is taken off the products.
    """
    k = model.projection.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        z = np.nan_to_num(_projected(x, model))
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    sums = _entry_sums(fit, length, part, "double")
    flat = np.array([sums[i] for i in range(k + k * k)]) / model.n
    products = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k])
    held = ~np.isnan(model.projection[0])
    return float(np.abs(products - np.eye(k))[held][:, held].max(initial=0))


def whiten(
    rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """A row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    taking_part = whole_vectors(rows, id_col, vector_col)
    fit = stored(taking_part.select("x").distinct())
    least, most = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError(f"vectors have between {least} and {most} entries")
    schema = (
        T.StructType().add(taking_part.schema["vec_id"]).add("component", "integer").add("n", "long").add("deviation", "long")
        .add("whitened", "double").add("explained", "double").add("identity_error", "double")
    )
    if least is None:
        return rows.sparkSession.createDataFrame([], schema)
    model = fit_model(fit, least, min(components, least))
    error = identity_error(fit, least, model)
    k = model.projection.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), least)
            deviations = _squares(_deviations(x, model))
            made = _projected(x, model).ravel()
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(each), model.n), pa.int64()),
                    pa.array(deviations, pa.int64()).take(pa.array(each)), pa.array(made, pa.float64(), mask=np.isnan(made)),
                    pa.array(model.explained * len(x), pa.float64()), pa.array(np.full(len(each), error), pa.float64()),
                ],
                names=schema.names,
            )

    return taking_part.mapInArrow(run, schema)
