"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance is never formed: all that touches the vectors is the product V B with a few columns B, one Spark job over
the table in which every task centres its rows and sends d x columns sums, added up by place. On the driver lie only matrices of d rows and
at most SPACE + WANTED columns. Rayleigh-Ritz on a search space gives pairs; those whose residual has come down to rounding
are locked, in falling order; the others' correction equations (I - QQ')(V - theta)(I - QQ') t = -r, Q the locked and
current vectors, are solved by a few steps of MINRES, all columns in step, so that one job serves the whole block.

Entries become integers x = floor(64 c) + 1000000. Sums S and the count n are exact; rows are centred as (x - m) - (S - n m) / n with
the integer m nearest to the mean, so no digits go by the offset of a million.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import SEED, offsets, saved

#: Fixed values of the contract: steps a unit, offset, components of a row at most.
STEPS, OFFSET, WANTED = 64, 1_000_000, 32
#: Columns of a block of corrections, most columns of the search space, steps of MINRES for one correction.
BLOCK, SPACE, INNER = 16, 96, 6
#: A residual of so many times the largest eigenvalue is rounding; an eigenvalue of less than ZERO times it is none.
RESIDUAL, ZERO = 2.0**-46, 2.0**-40
#: Expansions of the search space before the method gives up.
ROUNDS = 400


def whole_vectors(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, values one after the other, length) of the vectors that are neither null nor empty and hold only finite numbers; of
    `dims` entries, if given."""
    long = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.add.reduceat(np.r_[~np.isfinite(values), False], np.minimum(offsets(long)[:-1], len(values))) if len(long) else np.zeros(0)
    good = (long > 0) & ~((bad > 0) & (long > 0)) & ((long == dims) if dims is not None else True)
    return np.flatnonzero(good), values[np.repeat(good, long)], long[good]


def integers(c: np.ndarray) -> np.ndarray:
    x = np.floor(c * STEPS)
    if len(x) and np.abs(x).max() >= 2.0**53:
        raise ValueError("an entry is too large for an exact integer")
    return x.astype(np.int64) + OFFSET


@dataclass(frozen=True)
class Fit:
    """Exact count and sums of the vectors of the commonest length."""

    dims: int
    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = np.array([(s - self.n * m) / self.n for s, m in zip(self.sums, near, strict=True)])
        return (x - np.array(near, np.int64)) - rest

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place, integers of each row)."""
        at, values, _ = whole_vectors(column, self.dims)
        return at, integers(values).reshape(-1, self.dims)


def fit(vectors: DataFrame) -> Fit | None:
    """Of vectors(v), in one pass; None without a whole vector. Of two lengths as common the longer one counts."""

    def count(batches):
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            _, values, long = whole_vectors(batch.column("v"))
            x, at = integers(values), offsets(long)
            for d in np.unique(long).tolist():
                rows = at[:-1][long == d]
                n[d] = n.get(d, 0) + len(rows)
                own = x[rows[:, None] + np.arange(d)].sum(0) if len(rows) < len(long) else x.reshape(-1, d).sum(0)
                sums[d] = sums[d] + own if d in sums else own
        for d in n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(-1, d)), pa.array(np.r_[n[d], sums[d]])], names=["d", "at", "total"])

    totals = saved(vectors.mapInArrow(count, "d long, at long, total long").groupBy("d", "at").agg(F.sum("total").alias("total")), "vector-sums")
    most = totals.where("at = -1").orderBy(F.desc("total"), F.desc("d")).first()
    if most is None:
        return None
    return Fit(most.d, most.total, tuple(r.total for r in totals.where((F.col("d") == most.d) & (F.col("at") >= 0)).orderBy("at").collect()))


def _added(vectors: DataFrame, of: Fit, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of part(centred rows) over all rows: tasks send their sums by place, and as many numbers as `shape` has come back."""

    def run(batches):
        total = None
        for batch in batches:
            _, x = of.rows(batch.column("v"))
            if len(x):
                own = part(of.centred(x))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "part"])

    got = vectors.mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).toArrow()
    out = np.zeros(shape)
    out.ravel()[got.column("at").to_numpy()] = got.column("part").to_numpy()
    return out


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The directions of new that are left beside `against`, as orthonormal columns."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(3):
        for q in against:
            new = new - q @ (q.T @ new)
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10]
    return new


def minres(times: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, tolerance: float = 0.05) -> np.ndarray:
    """Approximate solutions of A t = rhs for a block of symmetric systems in step; times(v) applies each column's own A."""
    safe = lambda x: np.where(np.abs(x) > 1e-300, x, 1.0)
    size = np.linalg.norm(rhs, axis=0)
    v, v_old, beta = rhs / safe(size), np.zeros_like(rhs), np.zeros(rhs.shape[1])
    w, w_old, t = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    c_old = c = np.ones(rhs.shape[1])
    s_old = s = np.zeros(rhs.shape[1])
    left = size.copy()
    for _ in range(steps):
        av = times(v)
        alpha = (v * av).sum(0)
        nxt = av - alpha * v - beta * v_old
        beta_new = np.linalg.norm(nxt, axis=0)
        delta = c * alpha - c_old * s * beta
        r1 = np.hypot(delta, beta_new)
        r2, r3 = s * alpha + c_old * c * beta, s_old * beta
        c_old, s_old, c, s = c, s, delta / safe(r1), beta_new / safe(r1)
        w_old, w = w, (v - r3 * w_old - r2 * w) / safe(r1)
        t = t + np.where(r1 > 1e-300, c * left, 0.0) * w
        left = -s * left
        v_old, v, beta = v, nxt / safe(beta_new), beta_new
        if (np.abs(left) <= tolerance * size).all():
            break
    return t


def leading(product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int = WANTED, block: int = BLOCK, space: int = SPACE, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of the symmetric operator `product`, to RESIDUAL."""
    wanted = min(wanted, dims)
    rng = np.random.default_rng(SEED)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    basis = _orthonormal(rng.standard_normal((dims, min(dims, block))))
    image = product(basis)
    top = 0.0
    for _ in range(ROUNDS):
        theta, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        top = max(top, abs(theta[0]) if not len(values) else abs(values[0]))
        ask = min(wanted - len(values), basis.shape[1])
        r = image[:, :ask] - basis[:, :ask] * theta[:ask]
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        done = int(np.argmax(np.r_[size > RESIDUAL * top, True]))
        if done:
            locked, values = np.c_[locked, basis[:, :done]], np.r_[values, theta[:done]]
            basis, image, theta, r = basis[:, done:], image[:, done:], theta[done:], r[:, done:]
        if len(values) >= wanted:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if basis.shape[1] + block > space:
            keep = min(basis.shape[1], space // 2)
            basis, image = basis[:, :keep], image[:, :keep]
        open_ = r[:, :block]
        if not open_.shape[1]:
            new = _orthonormal(rng.standard_normal((dims, block)), locked, basis)
        else:
            q = np.c_[locked, basis[:, : open_.shape[1]]]
            shift = theta[: open_.shape[1]]

            def corrected(v, q=q, shift=shift):
                v = v - q @ (q.T @ v)
                out = product(v) - shift * v
                return out - q @ (q.T @ out)

            new = _orthonormal(minres(corrected, -open_, inner), locked, basis)
        if not new.shape[1]:  # the space is whole: only rounding is left, and a fresh image takes out what has piled up of it
            basis = _orthonormal(basis, locked)
            image = product(basis)
            continue
        basis, image = np.c_[basis, new], np.c_[image, product(new)]
    raise RuntimeError("Jacobi-Davidson: residuals did not come down")


@dataclass(frozen=True)
class Whitener:
    """fit, eigenvalues and eigenvectors of the components, trace of the covariance, error of the whitened covariance."""

    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def learn(vectors: DataFrame, col: str = "embedding", wanted: int = WANTED) -> Whitener | None:
    """The whitening transform of a column of vectors; None if there is no whole vector or they are all alike.

    Vectors that are null, empty, of another length than the commonest, or hold null or non-finite entries are not fitted. Directions
    without variance (under ZERO of the largest) are no components. Repeated rows count as often as they occur.
    """
    rows = vectors.select(F.col(col).alias("v"))
    of = fit(rows)
    if of is None:
        return None
    trace = float(_added(rows, of, lambda x: (x * x).sum(0), (of.dims,)).sum()) / of.n
    if not trace > 0:
        return None

    def product(b: np.ndarray) -> np.ndarray:
        return _added(rows, of, lambda x: x.T @ (x @ b), b.shape) / of.n

    e, q = leading(product, of.dims, wanted)
    k = int((e > ZERO * e[0]).sum())
    w = Whitener(of, e[:k], q[:, :k], trace, 0.0)
    cov = _added(rows, of, lambda x: w.project(x).T @ w.project(x), (k, k)) / of.n
    return Whitener(of, w.values, w.vectors, trace, float(np.abs(cov - np.eye(k)).max()))


def _exact_squares(n: int, x: np.ndarray, sums: np.ndarray) -> pa.Array:
    """Sum of (n x - S)^2 of each row as decimals, whatever their size."""
    off = x.astype(object) * n - sums.astype(object) if n * max(1, int(np.abs(x).max(initial=1))) >= 1 << 62 else x * n - sums.astype(np.int64)
    most = max((abs(int(v)) for v in (off.max(initial=0), off.min(initial=0))), default=0)
    if off.dtype != object and most * most * max(1, x.shape[1]) < 1 << 63:
        return pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
    off = off.astype(object)
    return pa.array([Decimal(int(v)) for v in (off * off).sum(1)], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, whitener: Whitener | None, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each whole vector and component.

    Other vectors (see `learn`) give no rows, and none does without a whitener; null and repeated ids stay as they are; extra
    columns are ignored; vectors of any number of entries that fits in a row are read whole.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(col).alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if whitener is None:
        return rows.sparkSession.createDataFrame([], schema)
    of, k = whitener.fit, len(whitener.values)
    sums, explained = np.array(of.sums, object), whitener.values / whitener.trace

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                at, x = of.rows(part.column("v"))
                if not len(at):
                    continue
                each = pa.array(np.repeat(np.arange(len(at)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(at)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, of.n)),
                        _exact_squares(of.n, x, sums).take(each),
                        pa.array(whitener.project(of.centred(x)).ravel()),
                        pa.array(np.tile(explained, len(at))),
                        pa.array(np.full(len(at) * k, whitener.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
