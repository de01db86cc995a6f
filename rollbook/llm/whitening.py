"""Whitening of embeddings by incremental eigendecomposition.

Tasks keep the spectrum of the vectors they have seen and update it by rank one for each further vector; the spectra of
tasks are merged by rank-one updates too, a few at a time; passes over all vectors then refine the result exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

SCALE, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Whitening:
    components: int = 16
    merge: int = 8  # spectra that one task merges at a time
    deflation: float = 1e-14  # of the largest weight: what is smaller changes nothing
    tiny: float = 1e-12  # eigenvalues below this share of the trace count as zero


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)) = 0, one above each of the ascending poles.

    Returns for each root its nearest pole's number and its distance from that pole, which is exact to the last places
    where the root itself would not be. All roots are sought at once: the poles up to a root and those beyond it are each
    replaced by one pole with the same value and slope, whose equation is quadratic; where its root leaves the interval
    known to hold the root, that interval is halved.
    """
    k = len(poles)
    own = np.arange(k)
    following = np.append(poles[1:], poles[-1] + weights.sum())
    middle = 0.5 * (following - poles)
    # The sign at the middle of the interval tells which of its ends is nearer.
    at_middle = 1 + (weights[None, :] / ((poles[None, :] - poles[:, None]) - middle[:, None])).sum(1)
    left = at_middle >= 0
    left[-1] = True
    near = np.where(left, own, np.minimum(own + 1, k - 1))
    gap = poles[None, :] - poles[near][:, None]
    below, above = np.tril(np.ones((k, k))), np.triu(np.ones((k, k)), 1)
    last = own == k - 1
    low = np.where(left, 0.0, -middle)
    high = np.where(left, np.where(last, following - poles, middle), 0.0)
    one, two = np.where(left, 0.0, poles - following), np.where(left, following - poles, 0.0)
    x, done = 0.5 * (low + high), np.zeros(k, bool)
    with np.errstate(all="ignore"):
        for _ in range(80):
            part = 1 / (gap - x[:, None])
            term = weights[None, :] * part
            slope = term * part
            psi, phi, psi_slope, phi_slope = (term * below).sum(1), (term * above).sum(1), (slope * below).sum(1), (slope * above).sum(1)
            f = 1 + psi + phi
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            q, s = psi_slope * (one - x) ** 2, np.where(last, 0.0, phi_slope * (two - x) ** 2)
            c = 1 + psi - psi_slope * (one - x) + np.where(last, 0.0, phi - phi_slope * (two - x))
            # c (one - t) (two - t) + q (two - t) + s (one - t) = 0; without poles beyond, c (one - t) + q = 0.
            b, e = c * (one + two) + q + s, c * one * two + q * two + s * one
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0.0))
            large = 0.5 * np.where(b >= 0, b + root, b - root)
            inside = lambda t: (t > low) & (t < high)
            first, second = np.where(last, one + q / c, large / c), e / large
            # Near the end rounding may put the guess just outside; as close as that the root is found.
            done |= np.minimum(np.abs(first - x), np.where(last, np.inf, np.abs(second - x))) <= 1e-13 * np.abs(x)
            guess = np.where(inside(first), first, np.where(~last & inside(second), second, 0.5 * (low + high)))
            x = np.where(done, x, guess)
            if done.all():
                break
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, deflation: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of the old matrix plus v v'.

    What has no share in v, and all but one direction of equal eigenvalues, is deflated: it stays as it is. The rest are
    the roots of the secular equation; eigenvectors come from weights worked out backwards from the roots, which keeps
    them orthogonal.
    """
    size = float(v @ v)
    if size == 0:
        return values, vectors
    z = vectors.T @ v
    scale = max(float(values[-1]), size)
    vectors = vectors.copy()
    # Turn directions with (nearly) equal eigenvalues so that only the last of them has a share in v.
    close = np.flatnonzero(np.diff(values) <= 64 * deflation * scale)
    for i in close:
        r = np.hypot(z[i], z[i + 1])
        if r > 0 and abs(z[i]) > 0:
            c, s = z[i + 1] / r, z[i] / r
            a, b = vectors[:, i].copy(), vectors[:, i + 1]
            vectors[:, i], vectors[:, i + 1] = c * a - s * b, s * a + c * b
            z[i], z[i + 1] = 0.0, r
    active = np.flatnonzero(z * z > deflation * size)
    # Equal poles may remain only where a turn was cut off by a deflated one; they are turned above.
    if not len(active):
        return values, vectors
    poles, weights = values[active], z[active] ** 2
    k = len(active)
    if k == 1:
        new, part = poles + weights, vectors[:, active]
    else:
        near, step = secular_roots(poles, weights)
        # diff[j, i] = root j less pole i, without loss.
        diff = (poles[near][:, None] - poles[None, :]) + step[:, None]
        apart = poles[:, None] - poles[None, :]
        np.fill_diagonal(apart, 1.0)
        ratio = diff / apart.T
        ratio[np.diag_indices(k)] = np.diag(diff)
        z_hat = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z[active])
        with np.errstate(divide="ignore", invalid="ignore"):
            u = (z_hat[None, :] / diff).T
        bad = ~np.isfinite(u).all(0)
        if bad.any():  # a root on its pole: the direction of the pole itself
            u[:, bad] = 0
            u[near[bad], np.flatnonzero(bad)] = 1
        part = vectors[:, active] @ (u / np.linalg.norm(u, axis=0))
        new = poles[near] + step
    values = values.copy()
    values[active], vectors[:, active] = new, part
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number and mean of some vectors, and eigenvalues and eigenvectors of the sum of their centred squares."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray, deflation: float):
        self.n, self.mean, self.values, self.vectors, self.deflation = n, mean, values, vectors, deflation
        self.updates = 0

    @classmethod
    def none(cls, size: int, deflation: float) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size), deflation)

    def _update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, v, self.deflation)
        self.updates += 1
        if self.updates % 256 == 0:  # rounding must not add up over many products
            self.vectors = _orthonormal(self.vectors)

    def add(self, x: np.ndarray) -> None:
        step = x - self.mean
        self._update(step * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + step / self.n

    def merge(self, other: Spectrum) -> None:
        """Adds all that `other` has seen: one update for each of its directions and one for the distance of the means."""
        if not other.n:
            return
        n = self.n + other.n
        step = other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self._update(np.sqrt(value) * vector)
        self._update(step * np.sqrt(self.n * other.n / n))
        self.n, self.mean = n, self.mean + step * (other.n / n)


def _orthonormal(q: np.ndarray) -> np.ndarray:
    full, r = np.linalg.qr(q)
    return full * np.where(np.diag(r) < 0, -1.0, 1.0)


def _rows(column: pa.ListArray, size: int, kind) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(-1, size)


def integers(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows with a whole vector and `__x`, its entries as integers; and the vectors' length.

    Vectors that are null, empty or hold a null or an entry that is not finite go; so do those whose length is not the
    most frequent one (of equally frequent ones the greater).
    """
    entry = F.transform(vector, lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    whole = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(entry, finite))
    sizes = whole.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    x = F.transform(entry, lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))
    return whole.filter(F.size(vector) == size).withColumn("__x", x), size


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries; a task sends one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = _rows(batch.column(0), size, np.int64)
            n += len(x)
            total = total + (x - SHIFT).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array([n] * size, pa.int64()), pa.array(range(size), pa.int64()), pa.array([int(t) + SHIFT * n for t in total], pa.int64())], ["n", "pos", "s"])

    rows = fit.mapInArrow(run, "n bigint, pos bigint, s bigint").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("pos").collect()
    return rows[0]["n"], [r["s"] for r in rows]


def _spectra(fit: DataFrame, size: int, setting: Whitening) -> DataFrame:
    """One spectrum for each task's vectors: part, n, mean, values, vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.none(size, setting.deflation)
        for batch in batches:
            for x in _rows(batch.column(0), size, np.int64):
                found.add((x - SHIFT).astype(np.float64))
        if found.n:
            yield _batch(TaskContext.get().partitionId(), found)

    return fit.mapInArrow(run, _SPECTRUM)


_SPECTRUM = "part bigint, n bigint, mean array<double>, values array<double>, vectors array<double>"


def _batch(part: int, s: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([x.ravel()], pa.list_(pa.float64())) for x in (s.mean, s.values, s.vectors)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), *lists], ["part", "n", "mean", "values", "vectors"])


def _merged(spectra: DataFrame, size: int, setting: Whitening) -> np.ndarray:
    """Eigenvectors of all spectra merged, in columns; a tree of merges, `merge` spectra (of size x size numbers) in a task."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["part", "n", "mean", "values", "vectors"]).to_pylist(), key=lambda r: r["part"])
        whole = None
        for r in rows:
            s = Spectrum(r["n"], np.array(r["mean"]), np.array(r["values"]), np.array(r["vectors"]).reshape(size, size), setting.deflation)
            whole = s if whole is None else whole
            if whole is not s:
                whole.merge(s)
        return pa.Table.from_batches([_batch(rows[0]["part"] // setting.merge, whole)])

    last = spectra.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    while last > 0:
        spectra = cut_lineage(spectra.groupBy(F.floor(F.col("part") / setting.merge).alias("g")).applyInArrow(run, _SPECTRUM))
        last //= setting.merge
    return _orthonormal(np.array(spectra.first()["vectors"]).reshape(size, size))


def _second_moment(fit: DataFrame, size: int, n: int, centre: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Mean of (basis' (x - centre)) (basis' (x - centre))' over all vectors; a task sends one row for each column."""
    shared, width = fit.sparkSession.sparkContext.broadcast((centre, basis)), basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, basis = shared.value
        total = np.zeros((width, width))
        for batch in batches:
            x = _rows(batch.column(0), size, np.int64)
            for top in range(0, len(x), 4096):
                y = ((x[top : top + 4096] - SHIFT) - centre) @ basis
                total += y.T @ y
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i * width + j), pa.array(total.ravel())], ["at", "s"])

    rows = fit.mapInArrow(run, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(width * width)
    for r in rows:
        out[r["at"]] = r["s"]
    out = out.reshape(width, width)
    return 0.5 * (out + out.T) / n


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", setting: Whitening = Whitening()) -> DataFrame:
    """Whitened coordinates of each row: id, component, n, deviation, whitened, explained, identity_error.

    Entries c become integers x = floor(64 c) + 1000000. Each distinct x counts once in n, the mean and the covariance
    (divisor n). Components are its unit eigenvectors by falling eigenvalue, from 1 to `components` or the vectors'
    length; `whitened` is the centred row on a component over the root of the eigenvalue, `explained` the eigenvalue's
    share of the trace, `deviation` the exact sum of (n x - sums) squared (an error once it passes 64 bits), and
    `identity_error` how far the covariance of the whitened vectors is from the identity at most.

    How: each task updates a spectrum by one centred vector at a time; spectra are merged in a tree by one update for each
    of their directions; the directions found then go to all tasks (size x size numbers, whatever the number of rows),
    which sum the exact covariance in that basis, whose small eigenproblem gives the components to double precision
    (Rayleigh-Ritz); a last pass measures the identity error.

    Rows with a null or broken vector, or one of another length than most, go. Repeated rows return each and count once in
    the fit. Where the eigenvalue is zero (all vectors equal, fewer vectors than components) `whitened` is null and the
    component does not count in the error; if that holds for all of them, `identity_error` is 0 and `explained` null.
    Rows without id stay. Very long vectors cost memory by the square of their length. Empty tables give an empty
    result; extra columns are ignored.
    """
    kind = df.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    whole, size = integers(df.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{vector}`").alias("__vector")), "__vector")
    if not size:
        return df.sparkSession.createDataFrame([], schema)
    rows = whole.select("__id", "__x")
    # Copies meet before the shuffle; the distinct rows are then dealt evenly, as each costs an update.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = cut_lineage(rows.select("__x").distinct().repartition(tasks))
    n, sums = _sums(fit, size)
    centre = np.array([(s - SHIFT * n) / n for s in sums])
    basis = _merged(cut_lineage(_spectra(fit, size, setting)), size, setting)
    ritz = _second_moment(fit, size, n, centre, basis)
    values, turn = np.linalg.eigh(ritz)
    trace = float(np.trace(ritz))
    take = np.argsort(-values, kind="stable")[: setting.components]
    directions, values = _fixed_signs(basis @ turn[:, take]), values[take]
    alive = values > setting.tiny * trace if trace > 0 else np.zeros(len(take), bool)
    scaled = directions / np.sqrt(np.where(alive, values, 1.0))
    covariance = _second_moment(fit, size, n, centre, scaled[:, alive]) if alive.any() else np.zeros((0, 0))
    error = float(np.abs(covariance - np.eye(len(covariance))).max()) if alive.any() else 0.0
    shared = df.sparkSession.sparkContext.broadcast((centre, scaled, alive, values / trace if trace > 0 else None, sums))
    return rows.mapInArrow(_coordinates(shared, n, size, id, error), schema)


def _fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """The largest entry of each is positive, so reruns agree."""
    top = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _coordinates(shared, n: int, size: int, id: str, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, scaled, alive, share, sums = shared.value
        width = scaled.shape[1]
        total = np.array([s - SHIFT * n for s in sums], np.int64)
        for batch in batches:
            for top in range(0, batch.num_rows, 2048):
                part = batch.slice(top, 2048)
                x = _rows(part.column(1), size, np.int64) - SHIFT
                many = len(x)
                if many and float((np.abs(n * x.astype(np.float64) - total) ** 2).sum(1).max()) > 9.2e18:
                    raise OverflowError("a deviation does not fit 64 bits")
                deviation = ((n * x - total) ** 2).sum(1)
                y = (x - centre) @ scaled
                whitened = pa.array(y.ravel(), pa.float64(), mask=np.tile(~alive, many))
                explained = pa.array(np.tile(share if share is not None else np.zeros(width), many), pa.float64(), mask=np.full(many * width, share is None))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(many), width)))
                columns = [ids, pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), many)), pa.array(np.full(many * width, n)), pa.array(np.repeat(deviation, width))]
                columns += [whitened, explained, pa.array(np.full(many * width, error))]
                yield pa.RecordBatch.from_arrays(columns, [id, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
