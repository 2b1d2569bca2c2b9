"""Whitening of embeddings from the singular values of their centred rows.

Tasks reduce centred rows to triangular factors by QR, block after block; the factors are stacked and reduced in a
tree until one is left, as wide as the vectors have dimensions. It is made bidiagonal by Householder reflections;
shifted quotient differences (dqds) find its singular values, and a twisted factorisation each direction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Rows of a block that meets a triangular factor, and factors that a task stacks in one step of the tree.
ROWS, FAN = 2048, 32
LONG_MAX = 2**63 - 1
_EPS = np.finfo(float).eps


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, x``: floor(scale * c) of each component as double, as long, or null where that leaves 64 bits.

    Rows whose vector is null or holds a null or non-finite component go. Null ids stay.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return vectors.where(F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long"), scaled.alias("x"))


def _wide(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers; a missing component is 0."""
    out = np.zeros((len(column), dims), np.int64)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if (lengths == dims).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dims)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """A partition's number of vectors and their sums by dimension, in exact whole numbers."""
    n, sums = 0, [0] * dims
    for batch in batches:
        rows = _wide(batch.column(0), dims)
        n += len(rows)
        exact = rows if rows.size == 0 or np.abs(rows.astype(float)).max() < 2**40 else rows.astype(object)
        sums = [s + int(x) for s, x in zip(sums, exact.sum(0), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(map(str, sums), pa.string())], names=["dim", "n", "s"])


def _centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """rows - sums / n: the difference is taken in whole numbers, so that only the division rounds."""
    most = max(abs(s) for s in sums) + n * np.abs(rows.astype(float)).max(initial=0.0)
    if most < 2**62:
        return (n * rows - np.array(sums, np.int64)) / n
    return (n * rows.astype(object) - np.array(sums, object)).astype(float) / n


def _factor(batches: Iterator[pa.RecordBatch], dims: int, n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    """A partition's centred rows reduced to one triangular factor."""
    r = np.zeros((0, dims))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            r = np.linalg.qr(np.vstack([r, _centred(_wide(batch.column(0).slice(at, ROWS), dims), n, sums)]), "r")
    if len(r):
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])


def _stack(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    r = np.zeros((0, dims))
    for batch in batches:
        for own in batch.column(0).to_pylist():
            r = np.linalg.qr(np.vstack([r, np.frombuffer(own).reshape(-1, dims)]), "r")
    if len(r):
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])


def triangular(fit: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the fit list's centred rows (``x``), from a tree of QR steps in which a task takes ``FAN`` factors."""
    factors = materialize(fit.select("x").mapInArrow(partial(_factor, dims=dims, n=n, sums=sums), "r binary"))
    while True:
        left = factors.count()
        if left <= 1:
            break
        factors = materialize(factors.repartition(-(-left // FAN)).mapInArrow(partial(_stack, dims=dims), "r binary"))
    found = factors.first()
    r = np.zeros((dims, dims))
    if found:
        own = np.frombuffer(found["r"]).reshape(-1, dims)
        r[: len(own)] = own
    return r


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor Q of ``r`` = P B Q', by Householder reflections from both sides."""
    a, d = r.astype(float).copy(), len(r)
    q = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, size = x.copy(), np.linalg.norm(x)
        v[0] += math.copysign(size, x[0])
        length = v @ v
        return v, 2 / length if length > 0 else 0.0

    for k in range(d - 1):
        v, b = reflector(a[k:, k])
        a[k:, k:] -= b * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, b = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= b * np.outer(a[k:, k + 1 :] @ v, v)
            q[:, k + 1 :] -= b * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of an upper bidiagonal matrix, falling.

    Each step takes a shift below the least value from all and is refused where a quotient falls below 0, so all stay
    positive and small values keep their relative accuracy.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    parts, out = [((diagonal / scale) ** 2, (above / scale) ** 2, 0.0)], []
    while parts:
        q, e, total = parts.pop()
        q, e, least = q.tolist(), e.tolist(), None
        while q:
            if len(q) == 1:
                out.append(q[0] + total)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS * _EPS * (q[i] + total) or e[i] <= _EPS * _EPS * (q[i + 1] + total)), None)
            if cut == len(e) - 1:
                out.append(q.pop() + total)
                e.pop()
                least = None
                continue
            if cut is not None:
                parts.append((np.array(q[: cut + 1]), np.array(e[:cut]), total))
                q, e, least = q[cut + 1 :], e[cut + 1 :], None
                continue
            for part in (0.999, 0.9, 0.5, 0.1, 0.0) if least else (0.0,):
                shift = part * (least or 0.0)
                step = _dqds_step(q, e, shift)
                if step:
                    q, e, least = step
                    total += shift
                    break
    return np.sort(np.array(out))[::-1] * scale * scale


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One transformation, with the least quotient met, which the least value can't exceed; None if the shift is too large."""
    d, new_q, new_e = q[0] - shift, [], []
    least = d
    for k in range(len(e)):
        if d < 0:
            return None
        own = d + e[k]
        new_q.append(own)
        ratio = q[k + 1] / own if own > 0 else 0.0
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    return [*new_q, d], new_e, least


def _twisted(diagonal: np.ndarray, off: np.ndarray, value: float, turn: int | None = None) -> np.ndarray:
    """A unit vector z with (T - value) z near 0, for T symmetric and tridiagonal: factors from both ends meet where their pivot is least."""
    n, tiny = len(diagonal), _EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(off).max(initial=0.0), 1e-300)
    shifted = diagonal - value
    down, up = shifted.copy(), shifted.copy()
    for i in range(1, n):
        down[i] -= off[i - 1] ** 2 / (down[i - 1] if abs(down[i - 1]) > tiny * _EPS else tiny * _EPS)
    for i in range(n - 2, -1, -1):
        up[i] -= off[i] ** 2 / (up[i + 1] if abs(up[i + 1]) > tiny * _EPS else tiny * _EPS)
    at = int(np.abs(down + up - shifted).argmin()) if turn is None else turn
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -off[i] * z[i + 1] / (down[i] if abs(down[i]) > tiny * _EPS else tiny * _EPS)
    for i in range(at + 1, n):
        z[i] = -off[i - 1] * z[i - 1] / (up[i] if abs(up[i]) > tiny * _EPS else tiny * _EPS)
    return z / np.linalg.norm(z)


def directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Unit vectors of the ``k`` largest of ``values``, the squared singular values of a bidiagonal matrix B, as columns.

    They belong to the tridiagonal B'B, whose largest values are of its own size, so its factors lose nothing
    there. B'B falls apart where an off-diagonal element vanishes; equal values of different parts have vectors of
    their own. Vectors of close values are made orthogonal, and the twist goes elsewhere where that leaves no vector of the value.
    """
    n = len(diagonal)
    main = diagonal**2 + np.concatenate([[0.0], above**2])
    off = diagonal[:-1] * above
    weak = np.abs(off) <= _EPS * np.sqrt(main[:-1] * main[1:]) if n > 1 else np.zeros(0, bool)
    bounds = [0, *(np.flatnonzero(weak) + 1).tolist(), n]
    owned = sorted(((v, a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for v in _part_values(main[a:b], off[a : b - 1], diagonal[a:b], above[a : b - 1], a)), key=lambda t: -t[0])[:k]
    found: list[np.ndarray] = []
    for value, (_, a, b) in zip(values[:k], owned, strict=True):
        close = [z for z, other in zip(found, values, strict=False) if abs(other - value) <= 1e-3 * values[0] and np.abs(z[a:b]).max() > 0]
        best, least = None, np.inf
        for turn in (None, *range(b - a)):
            z = np.zeros(n)
            z[a:b] = _twisted(main[a:b], off[a : b - 1], value, turn)
            for _ in range(3):
                for other in close:
                    z -= (other @ z) * other
                z /= np.linalg.norm(z) or 1.0
            left = main * z - value * z
            left[1:] += off * z[:-1]
            left[:-1] += off * z[1:]
            if np.linalg.norm(left) < least and abs(z @ z - 1) < 1e-8:
                best, least = z, np.linalg.norm(left)
            if least <= 8 * _EPS * values[0]:
                break
        found.append(best)
    return np.array(found).reshape(len(found), n).T


def _part_values(main: np.ndarray, off: np.ndarray, diagonal: np.ndarray, above: np.ndarray, start: int) -> list[float]:
    """The values of one part of B'B; but for the first it begins with what the element above it left on the diagonal."""
    lead = main[0] - diagonal[0] ** 2 if start else 0.0
    if lead <= _EPS * main[0]:
        return dqds(diagonal, above).tolist()
    # a Cholesky factor of the part is bidiagonal again
    a, b = np.zeros(len(main)), np.zeros(len(off))
    for i in range(len(main)):
        a[i] = math.sqrt(max(main[i] - (b[i - 1] ** 2 if i else 0.0), 0.0))
        if i < len(off):
            b[i] = off[i] / a[i] if a[i] > 0 else 0.0
    return dqds(a, b).tolist()


def principal(r: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` largest eigenvalues of R'R / n, their unit vectors as columns, and the trace; values that are zero but for rounding are left out."""
    diagonal, above, q = bidiagonal(r)
    values = dqds(diagonal, above)
    size = values[0] if len(values) else 0.0
    k = min(k, int((values > (len(r) * _EPS) ** 2 * size).sum()) if size > 0 else 0)
    vectors = q @ directions(diagonal, above, values, k) if k else np.zeros((len(r), 0))
    return values[:k] / n, vectors, float((r * r).sum() / n)


def _whitened(batch: pa.RecordBatch, dims: int, n: int, sums: list[int], weights: np.ndarray) -> pa.RecordBatch:
    """Rows (vec_id, x) with their deviation and their components."""
    rows = _wide(batch.column(1), dims)
    most = max(abs(s) for s in sums) + n * np.abs(rows.astype(float)).max(initial=0.0)
    kind = np.int64 if most * most * dims < 2**62 else object
    gap = n * rows.astype(kind) - np.array(sums, kind)
    deviation = [int(x) if x <= LONG_MAX else None for x in (gap * gap).sum(1).tolist()]
    parts = _centred(rows, n, sums) @ weights
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.array(list(parts), pa.list_(pa.float64()))], names=["vec_id", "deviation", "parts"])


def whiten(vectors: DataFrame, k: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: vectors (``usable``) on their first ``k`` whitened components.

    The fit list is each distinct vector once (n of them, sums S); a vector of fewer dimensions than the longest is filled
    with 0. Components are unit eigenvectors of the fit list's covariance by falling eigenvalue; those without variance are left
    out, so fewer than ``k`` may come, and none where all vectors are equal. deviation is the sum of (n x - S)^2 over
    dimensions, null where it leaves 64 bits. identity_error is how far the fit list's whitened covariance is from the identity.
    Every row counts, repeated ones and null ids too; an empty table gives an empty result. The driver holds a matrix of
    dimensions by dimensions.
    """
    vectors = materialize(vectors.select("vec_id", "x"))
    fit = materialize(vectors.select("x").distinct())
    spark = vectors.sparkSession
    dims = fit.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    # Vectors that differ only by zeros at the end are one.
    short = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    if fit.where(F.size("x") < dims).limit(1).count():
        fit = materialize(fit.select(short.alias("x")).distinct())
    by_dim = fit.mapInArrow(partial(_sums, dims=dims), "dim int, n long, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()  # a row a dimension
    n, sums = by_dim[0]["n"], [int(r["s"]) for r in by_dim]
    values, directions_, trace = principal(triangular(fit, dims, n, sums), n, k)
    weights = directions_ / np.sqrt(values)
    bounds = {"dims": dims, "n": n, "sums": sums, "weights": weights}
    schema = "vec_id long, deviation long, parts array<double>"
    map_rows = lambda df: map_arrow(df, partial(_whitened, **bounds), schema, ROWS)
    of_fit = materialize(map_rows(fit.select(F.lit(0).cast("long").alias("vec_id"), "x")).select("parts"))
    error = _identity_error(of_fit, n, len(values))
    found = map_rows(vectors).select("vec_id", "deviation", F.posexplode("parts").alias("at", "whitened"))
    explained = F.array(*[F.lit(float(v / trace)) for v in values]) if len(values) else F.array(F.lit(0.0))
    return found.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def _identity_error(parts: DataFrame, n: int, k: int) -> float:
    """The largest entry of the covariance of ``parts`` minus the identity; centred before multiplying."""
    if not k:
        return 0.0
    mean = parts.agg(*[F.avg(F.col("parts")[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [F.col("parts")[i] - F.lit(mean[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = parts.agg(*[F.sum(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return float(max(abs(cov[at] / n - (i == j)) for at, (i, j) in enumerate(pairs)))
