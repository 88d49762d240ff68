"""Whitening of embeddings by incremental eigendecomposition.

1. Entries become whole numbers (``floor(64 c) + 1000000``); the distinct
   vectors are the fit list.
2. Every task keeps a few spectra (count, exact sums, eigenvalues and
   eigenvectors of the scatter around the mean) and adds its vectors one by
   one, each as a centred rank-one update: the eigenvalues are the roots of the
   secular equation, the new eigenvectors follow from them. Directions that the
   vector has no part in, and eigenvalues that are equal, are deflated. The
   spectra of a task advance side by side in one array.
3. Spectra are combined in rounds of ``FAN_IN``: one spectrum's eigenvectors,
   scaled, and the difference of the means are rank-one updates of the other.
4. Rayleigh-Ritz: the fit list is projected on the combined basis, the projected
   covariance is summed over all tasks and its eigenvectors turn the basis. As
   the basis is complete, this gives the covariance's own eigenvectors to double
   precision, whatever rounding the updates have gathered.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries give nothing. Repeated rows give their own rows and count once in the
fit. Components of no variance (a fit list of one vector has no others) are left
out. Vectors of different lengths, and sums over 64 bits, raise an error. An
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, stash

SCALE, SHIFT = 64.0, 1_000_000
SIDE_BY_SIDE = 8  # spectra of a task
FAN_IN = 8
EPS = np.finfo(float).eps
SMALL_STEP = 1e-9


def whole_numbers(rows: DataFrame, vector_col: str = "embedding", keep: list[str] = ()) -> DataFrame:
    """``keep`` and ``x`` (array<long>) of each row whose vector has finite entries only."""
    source = rows.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector_col}`").alias("_".join(["vector", *keep])))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("x", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for batch in slices(batches):
            vectors = batch.column(batch.num_columns - 1)
            lengths = np.diff(vectors.offsets.to_numpy()) * ~np.asarray(vectors.is_null())
            flat, begin = vectors.values, vectors.offsets.to_numpy()[:-1]
            good = np.append(np.isfinite(flat.cast(pa.float64()).to_numpy(zero_copy_only=False)), True)  # null entries are not finite here
            bad = np.concatenate([[0], np.cumsum(~good)])
            fine = np.flatnonzero((lengths > 0) & (bad[begin + lengths] == bad[begin]))
            taken = vectors.take(pa.array(fine)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = np.floor(SCALE * taken).astype(np.int64) + SHIFT
            ends = np.concatenate([[0], np.cumsum(lengths[fine])]).astype(np.int32)
            at = pa.array(fine)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], names=schema.names)

    return in_batches(source, run, schema)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows of whole numbers, less ``SHIFT``."""
    if len(column) and set(np.diff(column.offsets.to_numpy()).tolist()) != {dim}:
        raise ValueError(f"vectors of other lengths than {dim}")
    return column.flatten().to_numpy().reshape(-1, dim) - SHIFT


class Spectra:
    """Scatter matrices around the mean as eigenvalues and eigenvectors, several side by side."""

    def __init__(self, many: int, dim: int):
        self.count = np.zeros(many)
        self.sums = np.zeros((many, dim), np.int64)
        self.mean = np.zeros((many, dim))
        self.values = np.zeros((many, dim))  # ascending
        self.vectors = np.broadcast_to(np.eye(dim), (many, dim, dim)).copy()  # columns

    def add(self, x: np.ndarray) -> None:
        """One vector more to each of the first spectra."""
        k = len(x)
        self.count[:k] += 1
        n = self.count[:k, None]
        off = x - self.mean[:k]
        self.mean[:k] += off / n
        self.sums[:k] += x
        self.values[:k], self.vectors[:k] = rank_one(self.values[:k], self.vectors[:k], off * np.sqrt((n - 1) / n))

    def combine(self, others: Spectra) -> None:
        """Takes up the other spectra, one for each of the first."""
        k, dim = len(others.count), self.mean.shape[1]
        scaled = others.vectors * np.sqrt(np.maximum(others.values, 0))[:, None, :]
        for j in range(dim):
            if scaled[:, :, j].any():
                self.values[:k], self.vectors[:k] = rank_one(self.values[:k], self.vectors[:k], scaled[:, :, j])
        both = self.count[:k] + others.count
        weight = np.sqrt(self.count[:k] * others.count / np.maximum(both, 1))
        off = (others.mean - self.mean[:k]) * weight[:, None]
        self.values[:k], self.vectors[:k] = rank_one(self.values[:k], self.vectors[:k], off)
        self.count[:k] = both
        self.sums[:k] += others.sums
        self.mean[:k] = self.sums[:k] / np.maximum(both, 1)[:, None]

    def part(self, begin: int, end: int) -> Spectra:
        out = Spectra(0, self.mean.shape[1])
        for name in ("count", "sums", "mean", "values", "vectors"):
            setattr(out, name, getattr(self, name)[begin:end].copy())
        return out

    def joined(self) -> Spectra:
        """All of them combined to one, by halves."""
        now, many = self, len(self.count)
        while many > 1:
            half = (many + 1) // 2
            rest = now.part(half, many)
            now = now.part(0, half)
            now.combine(rest)
            many = half
        return now

    def row(self) -> bytes:
        return b"".join([self.count[:1].tobytes(), self.sums[0].tobytes(), self.values[0].tobytes(), np.ascontiguousarray(self.vectors[0]).tobytes()])

    @classmethod
    def of_rows(cls, rows: list[bytes], dim: int) -> Spectra:
        out = cls(len(rows), dim)
        for i, row in enumerate(rows):
            numbers = np.frombuffer(row, float)
            out.count[i], out.sums[i] = numbers[0], np.frombuffer(row, np.int64)[1 : dim + 1]
            out.values[i], out.vectors[i] = numbers[dim + 1 : 2 * dim + 1], numbers[2 * dim + 1 :].reshape(dim, dim)
        out.mean = out.sums / np.maximum(out.count, 1)[:, None]
        return out


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of ``Q diag(values) Q' + v v'``, for several at once."""
    dim = values.shape[1]
    z = np.matmul(v[:, None, :], vectors)[:, 0]
    norm = np.sqrt((z * z).sum(axis=1))
    size = np.maximum(values[:, -1], norm * norm)
    equal = np.diff(values, axis=1) <= 8 * dim * EPS * size[:, None]
    if equal.any():
        vectors = _gather_equal(values, vectors, z, equal)
    live = (np.abs(z) > 8 * EPS * norm[:, None]) & (norm > 0)[:, None]
    z = np.where(live, z, 0.0)
    roots, gaps = secular_roots(values, z, live)
    # column i: z / (values - root i), of length one; a deflated direction stays as it is
    turn = z[:, :, None] / np.where(gaps == 0, EPS, gaps)
    length = np.sqrt((turn * turn).sum(axis=1))
    turn = np.where(live[:, None, :], turn / np.where(length == 0, 1.0, length)[:, None, :], np.eye(dim))
    vectors = np.matmul(vectors, turn)
    order = np.argsort(roots, axis=1, kind="stable")
    if (order[:, 1:] < order[:, :-1]).any():
        roots, vectors = np.take_along_axis(roots, order, 1), np.take_along_axis(vectors, order[:, None, :], 2)
    return roots, vectors


def _gather_equal(values: np.ndarray, vectors: np.ndarray, z: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Turns each space of equal eigenvalues so that its last direction takes all of ``z`` there (``z`` is changed)."""
    vectors = vectors.copy()
    for k in np.flatnonzero(equal.any(axis=1)):
        at = 0
        while at < equal.shape[1]:
            if not equal[k, at]:
                at += 1
                continue
            end = at
            while end < equal.shape[1] and equal[k, end]:
                end += 1
            part = z[k, at : end + 1].copy()
            length = math.sqrt(float(part @ part))
            mirror = part.copy()
            mirror[-1] += math.copysign(length, part[-1])
            if length > 0 and (square := float(mirror @ mirror)) > 0:
                space = vectors[k, :, at : end + 1]
                vectors[k, :, at : end + 1] = space - np.outer(space @ mirror, mirror) * (2 / square)
                z[k, at : end + 1] = 0.0
                z[k, end] = -math.copysign(length, part[-1])
            at = end + 1
    return vectors


def secular_roots(values: np.ndarray, z: np.ndarray, live: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum_j z_j^2 / (values_j - root)``, one above each live value, and ``values_j - root_i`` as [., j, i].

    Each root is found as its distance from the nearer pole, where no digits
    cancel, by a rational step that holds the two poles beside it, kept within
    its bracket by bisection. A value that is not live is a root itself.
    """
    many, dim = values.shape
    squares = z * z
    above = np.where(live, values, np.inf)
    above = np.concatenate([np.minimum.accumulate(above[:, ::-1], axis=1)[:, ::-1][:, 1:], np.full((many, 1), np.inf)], axis=1)
    last = np.isinf(above)
    above = np.where(last, values + squares.sum(axis=1, keepdims=True), above)
    width = np.where(live, above - values, 1.0)
    poles = values[:, :, None] - values[:, None, :]  # [., j, i]: pole j seen from pole i
    middle = 1 + (squares[:, :, None] / np.where((d := poles - width[:, None, :] / 2) == 0, EPS, d)).sum(axis=1)
    from_right = (middle < 0) & ~last & live  # the root is in the right half
    seen = poles - np.where(from_right, width, 0.0)[:, None, :]
    low = np.where(from_right, -width / 2, 0.0)
    high = np.where(from_right, 0.0, np.where(last & (middle < 0), width, width / 2))
    low = np.where(last & (middle < 0), width / 2, low)
    near, far = np.where(from_right, -width, 0.0), np.where(from_right, 0.0, width)  # the poles on both sides
    at = (low + high) / 2
    left = (poles <= 0).astype(float)
    open_ = live.copy()
    gap, term, slope = np.empty_like(seen), np.empty_like(seen), np.empty_like(seen)
    for _ in range(most):
        np.subtract(seen, at[:, None, :], out=gap)
        gap[gap == 0] = EPS
        np.divide(squares[:, :, None], gap, out=term)
        np.divide(term, gap, out=slope)
        total = 1 + term.sum(axis=1)
        slopes = slope.sum(axis=1)
        slope_left = np.multiply(slope, left, out=slope).sum(axis=1)
        low, high = np.where(total < 0, at, low), np.where(total < 0, high, at)
        a_, b_ = near - at, far - at
        c = total - a_ * slope_left - b_ * (slopes - slope_left)
        p, q = (a_ + b_) * total - a_ * b_ * slopes, a_ * b_ * total
        c = np.where(last, total - a_ * slopes, c)  # one pole only beyond which nothing lies
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        with np.errstate(all="ignore"):
            step = np.where(last, total * a_ / np.where(c == 0, EPS, c), np.where(p > 0, 2 * q / (p + root), (p - root) / (2 * c)))
        moved = at + step
        inside = (moved >= low) & (moved <= high)
        moved = np.where(inside, moved, (low + high) / 2)
        open_ &= np.abs(total) > EPS * (1 + np.abs(slopes * at))  # else no step can better it
        small = inside & (np.abs(moved - at) <= SMALL_STEP * np.abs(moved))  # steps converge at least as squares: this one was the last
        at = np.where(open_, moved, at)
        open_ &= ~small
        if not open_.any():
            break
    at = np.where(live, at, 0.0)
    origin = np.where(from_right, values + width, values)
    gaps = seen - at[:, None, :]
    return np.where(live, origin + at, values), gaps


def partial_spectra(fit: DataFrame, dim: int, side_by_side: int = SIDE_BY_SIDE) -> DataFrame:
    """(slot, spectrum): one row for each task, of the vectors in it."""

    def run(batches):
        spectra, seen = Spectra(side_by_side, dim), 0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), side_by_side):
                spectra.add(x[at : at + side_by_side])
            seen += len(x)
        if seen:
            row = spectra.joined().row()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([row], pa.binary())], names=["slot", "spectrum"])

    return in_batches(fit.select("x"), run, "slot long, spectrum binary")


def combined_spectrum(parts: DataFrame, dim: int) -> bytes:
    """The spectrum of all rows, combined in rounds so that no task gets more than ``FAN_IN`` of them."""

    def run(table: pa.Table) -> pa.Table:
        rows = [b for _, b in sorted(zip(table.column("slot").to_pylist(), table.column("spectrum").to_pylist()))]
        return pa.table({"slot": pa.array([table.column("slot")[0].as_py() // FAN_IN], pa.int64()), "spectrum": pa.array([Spectra.of_rows(rows, dim).joined().row()], pa.binary())})

    parts = stash(parts, "spectra")
    slots = parts.agg(F.max("slot")).first()[0] + 1
    while slots > 1:
        parts = parts.groupBy(F.expr(f"slot div {FAN_IN}").alias("g")).applyInArrow(run, "slot long, spectrum binary")
        slots = -(-slots // FAN_IN)
    return bytes(parts.first()["spectrum"])  # dim * dim numbers


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exactly: as 64-bit numbers, or as Python's own where these could overflow."""
    most = int(np.abs(x).max(initial=0))
    if n * most + int(np.abs(sums).max()) < 2**62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def projected_moments(fit: DataFrame, basis: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The covariance of the fit list's centred vectors in ``basis``: tasks sum their products, Spark the tasks'."""
    dim, k = basis.shape

    def run(batches):
        total, seen = np.zeros((k, k)), 0
        for batch in batches:
            y = (_centred(_matrix(batch.column(0), dim), n, sums) / n).astype(float) @ basis
            total += y.T @ y
            seen += len(y)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["place", "value"])

    sums_of = in_batches(fit.select("x"), run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # k * k numbers
    out = np.zeros(k * k)
    for place, value in sums_of:
        out[place] = value
    return out.reshape(k, k) / n


def fit_whitening(fit: DataFrame, components: int = 16) -> dict | None:
    """n, sums, directions (columns), eigenvalues, explained shares and identity error of a stored fit list ``x``."""
    first = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if first[0] is None:
        return None
    if first[0] != first[1]:
        raise ValueError(f"vectors of lengths from {first[0]} to {first[1]}")
    dim = first[0]
    whole = Spectra.of_rows([combined_spectrum(partial_spectra(fit, dim), dim)], dim)
    n, sums = int(whole.count[0]), whole.sums[0]
    basis, _ = np.linalg.qr(whole.vectors[0])
    values, turn = np.linalg.eigh(_symmetric(projected_moments(fit, basis, n, sums)))
    values, directions = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    kept = min(components, int((values > 64 * dim * EPS * max(trace, 0.0)).sum()))
    directions, values = directions[:, :kept], values[:kept]
    largest = np.abs(directions).argmax(axis=0)
    directions = directions * np.sign(directions[largest, np.arange(kept)])
    error = 0.0
    if kept:
        error = float(np.abs(projected_moments(fit, directions / np.sqrt(values), n, sums) - np.eye(kept)).max())
    return {"n": n, "sums": sums, "directions": directions, "values": values, "explained": values / trace if trace else values, "identity_error": error}


def _symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def whiten(rows: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each valid row and component: id, component, n, deviation, whitened, explained, identity_error."""
    numbers = whole_numbers(rows.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector")), "vector", ["vec_id"])
    schema = T.StructType([numbers.schema["vec_id"], *(T.StructField(c, k) for c, k in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))])
    fit = stash(numbers.select("x").distinct(), "fit")
    model = fit_whitening(fit, components)
    if model is None or not len(model["values"]):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, directions = model["n"], model["sums"], model["directions"]
    dim, k = directions.shape
    scaled = directions / np.sqrt(model["values"])

    def run(batches):
        for batch in slices(batches, 200_000):
            off = _centred(_matrix(batch.column(1), dim), n, sums)
            if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * dim >= 2**63:
                off = off.astype(object)
            deviation = (off * off).sum(axis=1)  # beyond 64 bits the conversion below raises
            y = (off / n).astype(float) @ scaled
            m = len(y)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviation.tolist(), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(y.ravel()),
                pa.array(np.tile(model["explained"], m)),
                pa.array(np.full(m * k, model["identity_error"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_batches(numbers, run, schema)
