"""Embedding whitening from singular values of the centred rows: blockwise QR, bidiagonal form, dqds, twisted factorisations.

1. Spark sums the rows exactly, in whole numbers: an entry c counts as floor(1024 * c) + 100000.
2. Every task reduces its centred rows block by block to the triangle of a QR factorisation, and triangles are stacked and
   reduced again, ``FAN_IN`` to one, until one is left. It has the singular values and right directions of all rows, without
   their covariance ever being formed.
3. On the driver, whose work depends on the dimension alone: Householder reflections make the triangle bidiagonal, dqds finds all its singular
   values to high relative accuracy, and a twisted factorisation at each of the largest gives its direction.
4. The directions travel to the rows. The covariance of the whitened values themselves says how far they are from the identity.

Defined results: vectors that are NULL or empty or hold NULL or non-finite entries are left out, as are those whose length is not the most
common one (of equally common ones, the longest). Entries beyond 2 ** 38 count as that large. Repeated rows count each; rows with
equal or NULL ids are rows of their own. Components whose variance is zero but for rounding are left out, so a table of equal
vectors, or an empty one, gives no rows. A deviation beyond a long is NULL. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staffmart.session import materialise

COMPONENTS = 8
SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 48
FAN_IN = 64  # triangles reduced to one by a task
BLOCK_ROWS = 4096
EPS = float(np.finfo(np.float64).eps)


def usable(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer matrix) of the usable vectors of each length; short pieces of a batch at a time."""
    for first in range(0, len(vectors), BLOCK_ROWS):
        piece = pa.concat_arrays([vectors.slice(first, BLOCK_ROWS)])
        lengths = pc.fill_null(pc.list_value_length(piece), 0).to_numpy(zero_copy_only=False)
        entries = pc.fill_null(piece.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        for length in np.unique(lengths[lengths > 0]):
            rows = np.flatnonzero(lengths == length)
            matrix = entries[(ends[rows] - length)[:, None] + np.arange(length)]
            fine = np.isfinite(matrix).all(axis=1)
            if fine.any():
                scaled = np.floor(SCALE * np.clip(matrix[fine], -LARGEST / SCALE, LARGEST / SCALE))
                yield first + rows[fine], scaled.astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Centre:
    """How many vectors there are and their exact sums."""

    n: int
    sums: tuple[int, ...]

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they hold it, Python's otherwise."""
        largest = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if 2 * largest < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        spread = self.spread(x)
        if spread.dtype == object or float(np.abs(spread).max(initial=0)) ** 2 * x.shape[1] >= 2.0**62:
            spread = spread.astype(object)
        return [int(d) if d < 1 << 63 else None for d in (spread * spread).sum(axis=1)]


def centre(vectors: DataFrame) -> Centre | None:
    """Count and exact sums; one row for each batch leaves the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in usable(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(places)], pa.int64()), "sums": pa.array([x.sum(axis=0).tolist()], pa.list_(pa.int64()))})

    parts = materialise(vectors.mapInArrow(run, "n long, sums array<long>"), "whitening-sums")
    length = F.size("sums").alias("length")
    most = parts.groupBy(length).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return None
    entries = parts.where(F.size("sums") == most["length"]).select(F.posexplode("sums").alias("place", "part"))
    totals = entries.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).orderBy("place")
    # One row for each dimension.
    return Centre(most["n"], tuple(int(row["total"]) for row in totals.collect()))


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle of the QR factorisation of rows."""
    short = rows.shape[1] - len(rows)
    return np.linalg.qr(np.vstack((rows, np.zeros((short, rows.shape[1])))) if short > 0 else rows, mode="r")


def reduced(vectors: DataFrame, middle: Centre) -> np.ndarray:
    """The triangle of all centred rows."""
    size = len(middle.sums)

    def pack(found: np.ndarray | None, number: int) -> Iterator[pa.RecordBatch]:
        if found is not None:
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "triangle": pa.array([found.astype("<f8").tobytes()])})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = None
        for batch in batches:
            for _, x in usable(batch.column(0)):
                if x.shape[1] == size:
                    rows = middle.centred(x)
                    found = triangle(rows if found is None else np.vstack((found, rows)))
        yield from pack(found, TaskContext.get().partitionId())

    def stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, number = None, 0
        for batch in batches:
            number = batch.column("number")[0].as_py() // FAN_IN
            for raw in batch.column("triangle"):
                rows = np.frombuffer(raw.as_py(), "<f8").reshape(size, size)
                found = triangle(rows if found is None else np.vstack((found, rows)))
        yield from pack(found, number)

    schema = "number long, triangle binary"
    made = materialise(vectors.mapInArrow(blocks, schema), "whitening-triangles")
    while (left := made.count()) > 1:
        # Triangles stacked in any order give the same one but for signs and rounding.
        made = materialise(made.repartition(-(-left // FAN_IN), "number").mapInArrow(stacks, schema), "whitening-stacks")
    only = made.first()
    return np.frombuffer(only["triangle"], "<f8").reshape(size, size)


def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit vector v and the value a with (I - 2 v v') x = (a, 0, ..., 0)."""
    norm = float(np.linalg.norm(x))
    v = x.copy()
    if norm == 0:
        return np.zeros_like(x), 0.0
    a = -norm if x[0] >= 0 else norm
    v[0] -= a
    return v / np.linalg.norm(v), a


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of U' A V, and the reflections that V is made of."""
    a = square.astype(np.float64).copy()
    size = len(a)
    diagonal, upper, rights = np.zeros(size), np.zeros(max(size - 1, 0)), []
    for k in range(size):
        v, diagonal[k] = reflection(a[k:, k])
        a[k:, k + 1 :] -= 2 * np.outer(v, v @ a[k:, k + 1 :])
        if k + 1 < size:
            w, upper[k] = reflection(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            rights.append(w)
    return diagonal, upper, rights


def two_by_two(first: float, second: float, between: float) -> tuple[float, float]:
    """Both values of a part of two rows, without cancellation."""
    large = (first + second + between) / 2 + (((first - second + between) / 2) ** 2 + second * between) ** 0.5
    return large, first * (second / large) if large > 0 else 0.0


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference transform, and its least d; None if the shift was too large."""
    d, low = q[0] - shift, float("inf")
    qs, es = [0.0] * len(q), [0.0] * len(e)
    for i in range(len(e)):
        if d < 0 or d != d:
            return None
        low = min(low, d)
        qs[i] = d + e[i]
        ratio = q[i + 1] / qs[i] if qs[i] > 0 else 0.0
        es[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0 or d != d:
        return None
    qs[-1] = d
    return qs, es, min(low, d)


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of a bidiagonal matrix's singular values, falling, by shifted quotient-difference transforms (dqds).

    The transforms neither add up nor subtract what would cancel, so small values are as accurate as large ones. A matrix
    falls apart where an off-diagonal square no longer counts; a shift above the least value is taken back.
    """
    found: list[float] = []
    open_parts = [((diagonal**2).tolist(), (upper**2).tolist(), 0.0)]
    while open_parts:
        q, e, moved = open_parts.pop()
        low = 0.0
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] == 0), None)
            if cut is not None:
                if cut < len(e) - 1:
                    open_parts.append((q[: cut + 1], e[:cut], moved))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                    continue
                found.append(q.pop() + moved)  # the last one stands alone
                e.pop()
                low = 0.0
                continue
            if len(q) == 1:
                found.append(q.pop() + moved)
                break
            if len(q) == 2:  # the last two in closed form
                large, small = two_by_two(q[0], q[1], e[0])
                found += [large + moved, small + moved]
                break
            if 1.5 * q[0] < q[-1]:  # small values settle faster at the end
                q, e = q[::-1], e[::-1]
            # A little less than the last two by two square's smaller value, never above the least d of the step before.
            shift = min(two_by_two(q[-2], q[-1], e[-1])[1], low) * (1 - 1e-8 if e[-1] < 1e-4 * q[-1] else 0.75)
            for trial in (shift, 0.25 * shift, 0.0):
                step = qd_step(q, e, trial)
                if step is not None:
                    break
            if step is None:  # rounding alone: the least value is zero
                step, trial = qd_step([max(x, 0.0) for x in q], e, 0.0), 0.0
            (q, e, low), moved = step, moved + trial
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B'B for ``value``, from the factorisations from both ends that meet where they fit best."""
    size = len(diagonal)
    tiny = EPS * EPS * max(value, float(np.abs(diagonal).max()) ** 2, 1e-300)
    safe = lambda x: x if abs(x) > tiny else (tiny if x >= 0 else -tiny)
    d = [max(float(a) ** 2, tiny) for a in diagonal]
    l = [float(b) / float(np.copysign(x**0.5, a)) for a, b, x in zip(diagonal, upper, d)]  # noqa: E741
    down_l, down_d, s = [0.0] * max(size - 1, 0), [0.0] * size, [0.0] * size
    s[0] = -value
    for i in range(size - 1):
        down_d[i] = safe(s[i] + d[i])
        down_l[i] = d[i] * l[i] / down_d[i]
        s[i + 1] = down_l[i] * l[i] * s[i] - value
    down_d[-1] = safe(s[-1] + d[-1])
    up_u, up_d, p = [0.0] * max(size - 1, 0), [0.0] * size, [0.0] * size
    p[-1] = d[-1] - value
    for i in range(size - 2, -1, -1):
        up_d[i + 1] = safe(d[i] * l[i] * l[i] + p[i + 1])
        ratio = d[i] / up_d[i + 1]
        up_u[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - value
    up_d[0] = p[0]
    gaps = [abs(s[i] + p[i] + value) for i in range(size)]
    twist = int(np.argmin(gaps))
    z = np.zeros(size)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down_l[i] * z[i + 1]
    for i in range(twist, size - 1):
        z[i + 1] = -up_u[i] * z[i]
    z /= np.linalg.norm(z)
    return z


def refined(diagonal: np.ndarray, upper: np.ndarray, value: float, z: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """``z`` after rounds of inverse iteration on B'B, orthogonal to the ``known`` vectors of values close by."""
    size = len(diagonal)
    square = np.diag(diagonal) + np.diag(upper, 1)
    shifted = square.T @ square - value * (1 + 4 * EPS) * np.eye(size)
    basis = np.array(known).reshape(len(known), size)
    if known:  # values this close may have given the same vector again
        z = np.random.default_rng(len(known)).standard_normal(size)
    for _ in range(4):
        for _ in range(2):
            z = z - basis.T @ (basis @ z)
        z = z / np.linalg.norm(z)
        try:
            z = np.linalg.solve(shifted, z)
        except np.linalg.LinAlgError:
            z = np.linalg.solve(shifted - 8 * EPS * value * np.eye(size), z)
    for _ in range(2):
        z = z / np.linalg.norm(z)
        z = z - basis.T @ (basis @ z)
    return z / np.linalg.norm(z)


def directions(square: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix, falling, and the right singular vectors of the largest as columns."""
    diagonal, upper, rights = bidiagonal(square)
    values = squared_singular_values(diagonal, upper)
    kept = [k for k in range(min(components, len(values))) if values[k] > len(values) * EPS * values[0]]
    vectors: list[np.ndarray] = []
    for k in kept:
        near = [vectors[j] for j in range(k) if values[j] - values[k] <= 1e-3 * values[j]]
        z = twisted(diagonal, upper, float(values[k]))
        image = diagonal * z + np.append(upper * z[1:], 0.0)
        back = diagonal * image + np.append(0.0, upper * image[:-1])
        if near or not np.abs(back - values[k] * z).max() < 64 * EPS * values[0]:
            z = refined(diagonal, upper, float(values[k]), z if np.isfinite(z).all() else np.ones(len(z)), near)
        vectors.append(z)
    out = np.array(vectors).reshape(len(kept), len(values)).T.copy()
    for k in range(len(rights) - 1, -1, -1):
        w = rights[k]
        out[k + 1 :] -= 2 * np.outer(w, w @ out[k + 1 :])
    return values, out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, n, deviation, whitened array, explained array, identity_error) of every usable vector."""
    only = vectors.select(F.col(vector_col).alias("v"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n long, deviation long, whitened array<double>"
    middle = centre(only)
    values, axes = (np.zeros(0), np.zeros((0, 0))) if middle is None else directions(reduced(only, middle), components)
    if not axes.size:
        full = f"{schema}, explained array<double>, identity_error double"
        return vectors.sparkSession.createDataFrame([], full)
    scaled = axes * np.sqrt(middle.n / values[: axes.shape[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in usable(batch.column("v")):
                if x.shape[1] != len(middle.sums):
                    continue
                white = middle.centred(x) @ scaled
                ends = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").take(pa.array(places)),
                    "n": pa.array(np.full(len(places), middle.n)),
                    "deviation": pa.array(middle.deviations(x), pa.int64()),
                    "whitened": pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel())),
                })

    white = materialise(rows.mapInArrow(run, schema), "whitened")
    pairs = [(i, j) for i in range(axes.shape[1]) for j in range(i + 1)]
    off = [F.abs(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) - float(i == j)) for i, j in pairs]
    error = white.agg(F.array_max(F.array(*off))).first()[0]
    explained = F.array(*[F.lit(float(v)) for v in values[: axes.shape[1]] / values.sum()])
    return white.withColumns({"explained": explained, "identity_error": F.lit(float(error))})
