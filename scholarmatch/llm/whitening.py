"""Embedding whitening by polarisation covariance.

Every entry c of a vector becomes the whole number x = floor(SCALE * c) + SHIFT. What is aggregated are exact squared
centred values only: one sum for every dimension and one for every sum of two dimensions. A cross-covariance is half
the difference between the variance of a sum of two dimensions and the two variances, so the whole covariance matrix
follows without ever multiplying two dimensions; it is assembled on the driver (it has the square of the dimension
many entries, whatever the number of vectors) and goes to ``eigh``.

Centring comes before squaring and loses nothing: with n vectors, a dimension's sum S, m = S // n and r = S - n * m,
the tasks square y = x - m. As y sums to r, the squares of the true centred values n * x - S = n * y - r sum to
n^2 * sum(y^2) - n * r^2, and likewise for two dimensions with r_i + r_j. Tasks add 64-bit squares in blocks so small
that no sum can overflow, and blocks with larger entries in whole numbers of any size; partial sums travel as limbs
of LIMB_BITS bits, so their totals are exact as well. Only the last division to a double rounds.

Four passes over the vectors, none with a shuffle of them: sums, squares, whitened rows (written to the shared folder
once) and the covariance of these. Per task they hold a batch and one entry per pair of dimensions.

Defined cases: vectors that are null or empty, or hold a null, non-finite or (times SCALE) more than 61-bit entry,
are dropped; of several vector lengths the most frequent one is kept (ties: the longest) and the others are dropped;
rows with null or repeated ids count each; a component without variance (constant dimensions, one vector) has
``explained`` 0, null ``whitened`` values, and no part in ``identity_error``, which is 0 if no component has any; a
deviation beyond 38 digits is null; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmatch.sources.tables import settle

SCALE = 1024
SHIFT = 100_000
#: Components that are returned.
COMPONENTS = 8
#: Dimensions of a vector, as the matrix of their square is held by tasks and the driver; more are refused.
MAX_DIMS = 4096
#: Vectors squared at once.
BLOCK = 1024
LIMBS, LIMB_BITS = 5, 34
_EXACT = 1 << 63


def integers(lists: pa.ListArray, scale: int = SCALE, shift: int = SHIFT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, whole numbers) of the vectors that take part, for each vector length of a batch."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.filter(lists.is_valid()).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(flat[starts[at, None] + np.arange(size)] * scale)
            fit = (np.abs(scaled) < float(1 << 61)).all(axis=1)
        yield int(size), at[fit], scaled[fit].astype(np.int64) + shift


def entries(dims: int) -> list[tuple[int, int]]:
    """Every dimension with itself, then every pair of dimensions: what squares are added for, in this order."""
    return [(i, i) for i in range(dims)] + [(i, j) for i in range(dims) for j in range(i + 1, dims)]


def _column_sums(values: np.ndarray) -> np.ndarray:
    """Exact sums over the rows, as Python's whole numbers."""
    top = max(1, int(np.abs(values).max(initial=0)))
    step = _EXACT // top - 1 if top < _EXACT // 2 else 0
    if step < 1:
        return values.astype(object).sum(axis=0)
    return sum((values[k : k + step].sum(axis=0).astype(object) for k in range(0, len(values), step)), np.zeros(values.shape[1], object))


def square_sums(centred: np.ndarray) -> np.ndarray:
    """For each of ``entries``: the exact sum of the squared values, or of the squared sums of two dimensions."""
    dims = centred.shape[1]
    total = np.zeros(dims * (dims + 1) // 2, object)
    for k in range(0, len(centred), BLOCK):
        block = centred[k : k + BLOCK]
        top = 2 * max(abs(int(block.max(initial=0))), abs(int(block.min(initial=0))))
        if top * top * len(block) >= _EXACT:
            block = block.astype(object)
        columns = np.ascontiguousarray(block.T)
        pairs = [(np.square(columns[i] + columns[i + 1 :])).sum(axis=1) for i in range(dims - 1)]
        total += np.concatenate([np.square(columns).sum(axis=1), *pairs]).astype(object)
    return total


def _limbs(value: int) -> list[int]:
    mask = (1 << LIMB_BITS) - 1
    return [(value >> (LIMB_BITS * k)) & mask for k in range(LIMBS - 1)] + [value >> (LIMB_BITS * (LIMBS - 1))]


def _from_limbs(parts: Iterable[int]) -> int:
    return sum(int(p) << (LIMB_BITS * k) for k, p in enumerate(parts))


_SUMS = "size int, entry int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def _sum_rows(size: int, numbered: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    rows = [(size, entry, *_limbs(int(value))) for entry, value in numbered]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * LIMBS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["size", "entry", *[f"l{k}" for k in range(LIMBS)]])


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("size", "entry").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])


def _collected(rows: DataFrame) -> dict[int, int]:
    return {r["entry"]: _from_limbs(r[f"l{k}"] for k in range(LIMBS)) for r in rows.collect()}


def totals(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, int, list[int]]:
    """The vector length, the number of vectors and their exact sum in each dimension. ``vectors`` has the column v."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in integers(batch.column(0), scale, shift):
                own = np.concatenate([np.array([len(x)], object), _column_sums(x)])
                held[size] = held[size] + own if size in held else own
        for size, sums in held.items():
            yield _sum_rows(size, enumerate(sums, -1))

    sums = settle(_added(vectors.select("v").mapInArrow(add, _SUMS)), "vector-sums")
    most = sums.where("entry = -1 AND l0 + l1 > 0").orderBy(F.desc("l1"), F.desc("l0"), F.desc("size")).first()
    if most is None:
        return 0, 0, []
    if most["size"] > MAX_DIMS:
        raise ValueError(f"vectors of {most['size']} dimensions; at most {MAX_DIMS}")
    found = _collected(sums.where(F.col("size") == most["size"]))
    return most["size"], found[-1], [found[d] for d in range(most["size"])]


def covariance(vectors: DataFrame, dims: int, n: int, sums: list[int], scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """The covariance matrix of the whole numbers, divisor n, from variances of dimensions and of sums of two."""
    whole = np.array([s // n for s in sums], np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims * (dims + 1) // 2, object)
        for batch in batches:
            for size, _, x in integers(batch.column(0), scale, shift):
                if size == dims:
                    total += square_sums(x - whole)
        yield _sum_rows(dims, enumerate(total))

    squares = _collected(_added(vectors.select("v").mapInArrow(add, _SUMS)))
    rest = [s - n * int(m) for s, m in zip(sums, whole)]
    spread = {}
    matrix = np.zeros((dims, dims))
    for k, (i, j) in enumerate(entries(dims)):
        if i == j:
            spread[i] = n * n * squares[k] - n * rest[i] ** 2
            product = spread[i]
        else:
            product = (n * n * squares[k] - n * (rest[i] + rest[j]) ** 2 - spread[i] - spread[j]) // 2
        matrix[i, j] = matrix[j, i] = product / n**3
    return matrix


def principal(matrix: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (0 where only rounding is left) and unit eigenvectors as columns, largest first, and their shares."""
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    values = np.where(values > len(matrix) * np.finfo(float).eps * max(values.max(initial=0), 0), values, 0.0)
    trace = np.trace(matrix)
    return values, axes, values / trace if trace > 0 else np.zeros_like(values)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row per vector and component."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    dims, n, sums = totals(rows, scale, shift)
    shape = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return vectors.sparkSession.createDataFrame([], shape)
    values, axes, shares = principal(covariance(rows, dims, n, sums, scale, shift), components)
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, whole)]
    mean, square_rest = np.array([r / n for r in rest]), sum(r * r for r in rest)
    rest = np.array(rest, object)
    weights = np.divide(axes, np.sqrt(values), out=np.full_like(axes, np.nan), where=values > 0)

    def deviations(y: np.ndarray) -> list[int | None]:
        top = 1 + max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        small = top * max(top, n) * dims < _EXACT
        y, r = (y, rest.astype(np.int64)) if small else (y.astype(object), rest)
        found = n * n * np.square(y).sum(axis=1).astype(object) - 2 * n * (y * r).sum(axis=1).astype(object) + square_rest
        return [d if d < 10**38 else None for d in found]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in integers(batch.column(1), scale, shift):
                if size != dims or not len(at):
                    continue
                y = x - whole
                white = pa.array(((y - mean) @ weights).ravel(), pa.float64(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(values), pa.int32()), white)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(deviations(y), pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "w"]
                )

    white = settle(rows.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    held = [k for k in range(len(values)) if values[k] > 0]
    pairs = [(i, j) for i in held for j in held if i <= j]
    spread = white.agg(
        F.count("*").alias("rows"), *[F.sum(F.get("w", i)).alias(f"s{i}") for i in held], *[F.sum(F.get("w", i) * F.get("w", j)).alias(f"p{i}_{j}") for i, j in pairs]
    ).first()
    error = max((abs(spread[f"p{i}_{j}"] / n - spread[f"s{i}"] / n * (spread[f"s{j}"] / n) - (i == j)) for i, j in pairs), default=0.0)
    explained = F.array(*[F.lit(float(s)) for s in shares])
    opened = white.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return opened.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "k").alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
