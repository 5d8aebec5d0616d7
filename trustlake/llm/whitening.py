"""Whitening of embeddings: leading principal components, isolated by spectrum slicing.

Entries become whole numbers, so sums and deviations are exact. One scan sums
them, one sums products of deviations from the mean, each task over its rows
before they travel. The driver holds the covariance alone, a square of the
dimension whatever the number of vectors. An LDLᵀ factorisation of the covariance
less a shift has as many positive pivots as there are eigenvalues above the shift.
Bisection by that count isolates each leading eigenvalue, Rayleigh quotient
iteration then converges cubically to its vector, and the counts on both sides
certify its number. A further scan projects every vector.

Defined results
    null vectors         left out, as are vectors with null, infinite or NaN entries
    other lengths        vectors without entries, or of another length than most, are
                         left out; of equally frequent lengths the largest counts
    entries past 2^40, sums past 2^63  end the run with an error, as they have no exact place
    deviation past 2^63  null
    equal eigenvalues    any orthonormal vectors of their space, the same for all rows
    no variance          components whose eigenvalue is nothing but rounding are left out
    null vec_id, repeats a row for each component of each row; each counts in the fit
    empty table          no rows
    further columns      not read
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.llm.common import cut

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Vectors that one step inside a task holds as arrays.
ROWS = 4096
LARGEST = float(1 << 40)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


class Fit(NamedTuple):
    """``sums`` of the whole-number vectors, and the components by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # a row for each component
    explained: np.ndarray


# --- the spectrum of a symmetric matrix ------------------------------------------------

_ALPHA = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above ``shift``: the positive inertia of an LDLᵀ
    factorisation with pivots of one or two rows.
    """
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    while (n := len(a)) > 1:
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1
        largest, size = column[r - 1], 1
        if abs(a[0, 0]) < _ALPHA * largest:
            others = np.abs(a[r])
            others[r] = 0
            most = others.max()
            if abs(a[0, 0]) * most < _ALPHA * largest**2:
                to = 0 if abs(a[r, r]) >= _ALPHA * most else 1
                size = to + 1
                order = np.arange(n)
                order[[to, r]] = r, to
                a = a[np.ix_(order, order)]
        if size == 1:
            pivot = a[0, 0]
            count += bool(pivot > 0)
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / pivot) if pivot else a[1:, 1:]
        else:
            count += 1  # such a block has a value on each side of zero
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return count + int(n == 1 and a[0, 0] > 0)


def _refine(
    matrix: np.ndarray, shift: float, found: list[np.ndarray], scale: float
) -> tuple[float, np.ndarray]:
    """The eigenvalue next to ``shift`` and its vector: two steps of inverse iteration,
    then Rayleigh quotients until the residual is rounding.
    """
    n = len(matrix)
    tiny = np.finfo(float).eps * scale

    def solved(at: float, v: np.ndarray) -> np.ndarray:
        try:
            w = np.linalg.solve(matrix - at * np.eye(n), v)
        except np.linalg.LinAlgError:  # an eigenvalue to the last bit
            w = np.linalg.solve(matrix - (at + tiny) * np.eye(n), v)
        for _ in range(2):
            for u in found:
                w = w - (u @ w) * u
            w = w / np.linalg.norm(w)
        return w

    v = np.random.default_rng(n + len(found)).standard_normal(n)
    for _ in range(2):
        v = solved(shift, v)
    value = float(v @ matrix @ v)
    for _ in range(8):
        if np.linalg.norm(matrix @ v - value * v) <= 4 * tiny:
            break
        v = solved(value, v)
        value = float(v @ matrix @ v)
    return value, v


def leading(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors as rows.

    Fewer where the others are zero to rounding.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((0, n))
    tiny = np.finfo(float).eps * scale * n
    counts = {-scale * 1.5: n, scale * 1.5: 0}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    for k in range(1, min(wanted, above(2 * tiny)) + 1):
        low = max(s for s, c in counts.items() if c >= k)
        high = min(s for s, c in counts.items() if c < k)
        while True:
            alone = above(low) == k and above(high) == k - 1
            close = high - low <= tiny
            if alone or close:
                value, vector = _refine(matrix, (low + high) / 2, vectors, scale)
                if low - tiny <= value <= high + tiny:
                    break
                if close:
                    raise ArithmeticError(f"eigenvalue {k} is not to be found between {low} and {high}")
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors).reshape(-1, n)


# --- scans ----------------------------------------------------------------------------------


def _clean(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows count, the length of each, and all entries of those in order."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = pc.list_flatten(column)
    values = pc.fill_null(entries.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    counts = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    return counts, lengths, values[np.repeat(counts, lengths)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
    """Ids, dimension and whole-number vectors, by slices and lengths."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            counts, lengths, values = _clean(part.column("v"))
            if np.abs(values).max(initial=0.0) >= LARGEST:
                raise OverflowError("an entry of an embedding is past 2^40")
            whole = np.floor(values * SCALE).astype(np.int64) + SHIFT
            kept = lengths[counts]
            starts = np.cumsum(kept) - kept
            ids = part.column("vec_id").filter(pa.array(counts))
            for d in np.unique(kept).tolist():
                of = np.flatnonzero(kept == d)
                yield ids.take(pa.array(of)), d, whole[starts[of][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sums of the vectors of each length, by entry."""
    found: dict[int, list] = {}
    for _, d, x in _rows(batches):
        one = found.setdefault(d, [0, np.zeros(d, object)])
        one[0] += len(x)
        one[1] += x.sum(axis=0).astype(object)
    for d, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
             pa.array(sums.tolist(), pa.int64())], ["d", "i", "n", "s"],
        )


def _apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact; as Python's numbers where 64 bits might not do."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _products(
    batches: Iterator[pa.RecordBatch], rows: Callable[[np.ndarray], np.ndarray], d: int
) -> Iterator[pa.RecordBatch]:
    """Sums of the products of each two columns of ``rows(x)``, and of each column with 1 (``j`` = size)."""
    total = None
    for _, length, x in _rows(batches):
        if length == d:
            z = rows(x)
            z = np.column_stack((z, np.ones(len(z))))
            total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"]
        )


def _covariance(vectors: DataFrame, rows: Callable, d: int, size: int, n: int) -> np.ndarray:
    """Covariance of ``rows(x)``, which are deviations from the mean but for rounding."""
    parts = vectors.mapInArrow(lambda b: _products(b, rows, d), "i int, j int, s double")
    sums = np.zeros((size + 1, size + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r.i, r.j] = sums[r.j, r.i] = r.s
    mean = sums[:size, size] / n
    return sums[:size, :size] / n - np.outer(mean, mean)


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.selectExpr("cast(vec_id as long) vec_id", "embedding v")


def fit(embeddings: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Mean and leading components of all vectors that count; None without any."""
    vectors = _vectors(embeddings)
    parts = vectors.mapInArrow(_sums, "d int, i int, n long, s long")
    sums = cut(parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "sums")
    top = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    d, n = top.d, top.n
    mean = np.array([r.s for r in sums.where(F.col("d") == d).orderBy("i").collect()])

    def centred(x: np.ndarray) -> np.ndarray:
        return _apart(x, n, mean).astype(np.float64) / n

    covariance = _covariance(vectors, centred, d, d, n)
    values, found = leading(covariance, components)
    trace = float(np.trace(covariance))
    return Fit(n, mean, values, found, values / (trace or 1.0))


def _project(fitted: Fit, apart: np.ndarray) -> np.ndarray:
    return apart.astype(np.float64) / fitted.n @ fitted.vectors.T / np.sqrt(fitted.values)


def identity_error(embeddings: DataFrame, fitted: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""
    m = len(fitted.values)
    covariance = _covariance(
        _vectors(embeddings), lambda x: _project(fitted, _apart(x, fitted.n, fitted.sums)),
        len(fitted.sums), m, fitted.n,
    )
    return float(np.abs(covariance - np.eye(m)).max(initial=0.0))


def _whole(squares: np.ndarray) -> list[int | None]:
    return [int(s) if s < 1 << 63 else None for s in squares.tolist()]


def whiten(embeddings: DataFrame, fitted: Fit | None) -> DataFrame:
    """A row for each vector and component: ``vec_id, component, n, deviation, whitened, explained``."""
    vectors = _vectors(embeddings)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    m, d = len(fitted.values), len(fitted.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, length, x in _rows(batches):
            if length != d or not m:
                continue
            apart = _apart(x, fitted.n, fitted.sums)
            if apart.dtype == object or int(np.abs(apart).max(initial=0)) ** 2 * d >= 1 << 63:
                apart = apart.astype(object)
            squares = (apart * apart).sum(axis=1)
            rows = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(rows), m))),
                    pa.array(np.tile(np.arange(1, m + 1), rows), pa.int32()),
                    pa.array(np.full(rows * m, fitted.n), pa.int64()),
                    pa.array([s for s in _whole(squares) for _ in range(m)], pa.int64()),
                    pa.array(_project(fitted, apart).ravel()),
                    pa.array(np.tile(fitted.explained, rows)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return vectors.mapInArrow(run, RESULT)
