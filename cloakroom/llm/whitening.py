"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the eigenpairs of its scatter matrix and takes in one centred
vector after the other: a rank-one update, whose new eigenvalues are the roots of a
secular equation, after deflation of the components that the vector doesn't touch and of
equal eigenvalues. The spectra of partitions are combined by as many rank-one updates as
the smaller one has eigenpairs, and one more for the distance of the means. A last
distributed Rayleigh-Ritz step projects the centred data on the basis so found and turns
it by the eigenvectors of the projection's covariance, which makes the components exact
to double precision however the updates rounded.

Only sums over dimensions, d x d matrices and spectra leave a partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakroom.session import materialize

SCALE, SHIFT = 64, 1_000_000
FAN_IN = 16  # spectra that are combined by one task
ROWS_EACH = 4096  # vectors that one task takes in
_EPS = np.finfo(np.float64).eps


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of diag(d) + rho z z^T for ascending distinct ``d``, non-zero ``z`` and positive ``rho``.

    Each is given as its nearest pole's index and the distance from it, the root of
    1 + rho * sum(z**2 / (d - x)) between that pole and the next. All roots are refined at
    once by two-pole rational interpolation, kept inside a shrinking bracket.
    """
    k = len(d)
    w = rho * z * z
    i = np.arange(k)
    gap = np.append(np.diff(d), w.sum())
    middle = 1 + (w / (d - (d + gap / 2)[:, None])).sum(axis=1)
    base = np.where((middle < 0) & (i < k - 1), i + 1, i)
    delta = d - d[base][:, None]
    left = base == i
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.where(i < k - 1, gap / 2, gap), 0.0)
    below = i[None, :] <= i[:, None]
    own, after = np.take_along_axis(delta, i[:, None], 1)[:, 0], delta[i, np.minimum(i + 1, k - 1)]
    tau, busy = (low + high) / 2, np.ones(k, dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(60):
            far = delta - tau[:, None]
            term = w / far
            slope = term / far
            f = 1 + term.sum(axis=1)
            busy &= (np.abs(f) > 8 * _EPS * (1 + np.abs(term).sum(axis=1))) & (high - low > 2 * _EPS * np.abs(tau))
            if not busy.any():
                break
            low, high = np.where(busy & (f < 0), tau, low), np.where(busy & (f > 0), tau, high)
            psi, phi = (slope * below).sum(axis=1), (slope * ~below).sum(axis=1)
            x, y = own - tau, after - tau
            c = f - x * psi - y * phi
            a, b = (x + y) * f - x * y * (psi + phi), x * y * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = (tau[-1] * tau[-1] * psi[-1]) / (f[-1] + tau[-1] * psi[-1]) - tau[-1]  # one pole alone
            new = tau + step
            new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
            tau = np.where(busy, new, tau)
    return base, tau


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of vectors @ diag(values) @ vectors.T + rho v v^T (``values`` ascending, ``rho`` positive)."""
    z = vectors.T @ v
    length = np.linalg.norm(z)
    if length == 0 or rho <= 0:
        return values, vectors
    z, rho = z / length, rho * length * length
    tiny = 8 * _EPS * max(abs(values[-1]), abs(values[0]), rho)
    # equal eigenvalues: turn their vectors so that one alone is touched
    near = np.diff(values) <= tiny
    if near.any():
        vectors = vectors.copy()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], near.astype(np.int8), [0]))))
        for lo, hi in zip(edge[::2], edge[1::2] + 1):
            part = z[lo:hi]
            size = np.linalg.norm(part)
            if size > 0:
                mirror = part / size
                mirror[-1] += 1.0 if mirror[-1] >= 0 else -1.0
                mirror /= np.linalg.norm(mirror)
                vectors[:, lo:hi] -= 2 * np.outer(vectors[:, lo:hi] @ mirror, mirror)
                turned = part - 2 * mirror * (mirror @ part)
                z[lo : hi - 1], z[hi - 1] = 0.0, turned[-1]
    active = np.flatnonzero(rho * np.abs(z) > tiny)
    if not len(active):
        return values, vectors
    d, k = values[active], len(active)
    base, tau = secular_roots(d, z[active], rho)
    far = (d - d[base][:, None]) - tau[:, None]  # d_j - root_i, without cancellation
    # the vector that has exactly these roots, so that the new eigenvectors are orthogonal
    apart = d[None, :] - d[:, None]
    below = np.tri(k, k, -1, dtype=bool).T  # root i below pole j
    other = np.where(below, apart, np.vstack([apart[1:], np.full(k, -1.0)]))
    exact = np.sqrt(np.abs(np.prod(far / other, axis=0))) * np.where(z[active] < 0, -1.0, 1.0)
    turn = exact / far
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    values, vectors = values.copy(), vectors.copy()
    values[active] = d[base] + tau
    vectors[:, active] = vectors[:, active] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Vectors taken in so far: their number, exact sums, and the eigenpairs of their scatter matrix."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d, dtype=np.int64), np.zeros(d), np.eye(d))

    def add(self, x: np.ndarray) -> None:
        """Take in one vector of integers."""
        if self.n:
            apart = x - self.sums / self.n
            self.values, self.vectors = rank_one(self.values, self.vectors, apart, self.n / (self.n + 1))
        self.n += 1
        self.sums = self.sums + x

    def merge(self, other: Spectrum) -> Spectrum:
        """Both together."""
        big, small = (self, other) if self.n >= other.n else (other, self)
        if not small.n:
            return big
        values, vectors = big.values, big.vectors
        for rho, v in zip(small.values, small.vectors.T):
            if rho > 0:
                values, vectors = rank_one(values, vectors, v, rho)
        apart = big.sums / big.n - small.sums / small.n
        values, vectors = rank_one(values, vectors, apart, big.n * small.n / (big.n + small.n))
        return Spectrum(big.n + small.n, big.sums + small.sums, values, vectors)

    def row(self) -> tuple:
        return self.n, self.sums.tobytes(), self.values.tobytes(), self.vectors.tobytes()

    @classmethod
    def of(cls, n: int, sums: bytes, values: bytes, vectors: bytes) -> Spectrum:
        values = np.frombuffer(values)
        return cls(n, np.frombuffer(sums, dtype=np.int64), values, np.frombuffer(vectors).reshape(len(values), -1))


_SPECTRUM = "n long, sums binary, vals binary, vecs binary"


def _matrix(cells: pd.Series) -> np.ndarray:
    return np.array(cells.tolist(), dtype=np.int64)


def spectrum(fit: DataFrame, d: int, n: int) -> Spectrum:
    """The spectrum of all rows of ``fit`` (y: d integers), combined in a tree of tasks."""

    def take_in(batches):
        state = Spectrum.empty(d)
        for df in batches:
            for x in _matrix(df["y"]) if len(df) else ():
                state.add(x)
        if state.n:
            yield pd.DataFrame([state.row()], columns=["n", "sums", "vals", "vecs"])

    def combine(df: pd.DataFrame) -> pd.DataFrame:
        state = Spectrum.empty(d)
        for r in df.sort_values(["n", "sums"]).itertuples():
            state = state.merge(Spectrum.of(r.n, r.sums, r.vals, r.vecs))
        return pd.DataFrame([state.row()], columns=["n", "sums", "vals", "vecs"])

    found = materialize(fit.repartition(max(1, -(-n // ROWS_EACH))).mapInPandas(take_in, _SPECTRUM))
    while (left := found.count()) > 1:
        group = F.pmod(F.xxhash64("sums", "n"), F.lit(-(-left // FAN_IN)))
        found = materialize(found.groupBy(group.alias("g")).applyInPandas(combine, _SPECTRUM))
    r = found.collect()[0]  # one row of d x d numbers
    return Spectrum.of(r["n"], bytes(r["sums"]), bytes(r["vals"]), bytes(r["vecs"]))


def _scatter(rows: DataFrame, project, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (over the number of rows, centred first) of ``project(y)`` over all rows of ``rows``."""

    def part(batches):
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for df in batches:
            if not len(df):
                continue
            p = project(_matrix(df["y"]))
            m, own = len(p), p.mean(axis=0)
            p = p - own
            scatter += p.T @ p + np.outer(own - mean, own - mean) * (n * m / (n + m))
            mean, n = mean + (own - mean) * (m / (n + m)), n + m
        if n:
            yield pd.DataFrame([(n, mean.tobytes(), scatter.tobytes())], columns=["n", "mean", "scatter"])

    def both(df: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for r in df.sort_values(["n", "mean"]).itertuples():
            own = np.frombuffer(r.mean)
            scatter = scatter + np.frombuffer(r.scatter).reshape(k, k) + np.outer(own - mean, own - mean) * (n * r.n / (n + r.n))
            mean, n = mean + (own - mean) * (r.n / (n + r.n)), n + r.n
        return pd.DataFrame([(n, mean.tobytes(), scatter.tobytes())], columns=["n", "mean", "scatter"])

    kind = "n long, mean binary, scatter binary"
    found = materialize(rows.mapInPandas(part, kind))
    while (left := found.count()) > 1:
        group = F.pmod(F.xxhash64("mean", "n"), F.lit(-(-left // (4 * FAN_IN))))
        found = materialize(found.groupBy(group.alias("g")).applyInPandas(both, kind))
    r = found.collect()[0]  # k x k numbers
    return np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(k, k) / r["n"]


def _whole(entry: Column) -> Column:
    return F.floor(entry * SCALE).cast("long")


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries become whole numbers (floor of 64 times the entry, plus a million); components
    are those of the covariance over the distinct vectors. Vectors that are null, empty or
    hold null or non-finite entries are dropped, and so are those whose number of entries
    isn't the most frequent one (the smaller, if two are). Repeated rows are repeated in the
    result and count once in the fit; rows of null id stay, with a null id. Components
    without variance (as all are where the vectors are equal) are left out, so there may
    be fewer than asked for. Entries and deviations beyond the range of a long are an
    error. An empty table gives an empty result. Other columns are not read.
    """
    v = F.col("v")
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    valid = valid.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    rows = valid.select("id", F.transform("v", _whole).alias("y"))  # without the million, which no covariance notices
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = rows.groupBy(F.size("y").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "d").limit(1).collect()
    if not width:
        return spark.createDataFrame([], schema)
    d = width[0]["d"]
    rows = rows.where(F.size("y") == d)
    fit = materialize(rows.select("y").distinct())
    n = fit.count()
    found = spectrum(fit, d, n)
    sums, mean = found.sums, found.sums / found.n
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])

    def centred(y: np.ndarray) -> np.ndarray:
        return (y * n - sums) / n

    _, projected = _scatter(fit, lambda y: centred(y) @ basis, d)
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    k = min(components, int((values > d * _EPS * max(values[0], 0.0)).sum()))
    if not k:
        return spark.createDataFrame([], schema)
    values, axes = values[:k], axes[:, :k]
    white = axes / np.sqrt(values)
    _, spread = _scatter(fit, lambda y: centred(y) @ white, k)
    error = float(np.abs(spread - np.eye(k)).max())

    def score(batches):
        for df in batches:
            if not len(df):
                continue
            y = _matrix(df["y"])
            out = pd.DataFrame({"id": df["id"], "deviation": df["deviation"], "white": list(centred(y) @ white)})
            yield out

    total = F.array(*[F.lit(int(s)).cast("long") for s in sums])
    away = F.zip_with("y", total, lambda y, s: F.lit(n).cast("long") * y - s)
    deviation = F.aggregate(away, F.lit(0).cast("long"), lambda acc, x: F.try_add(acc, F.try_multiply(x, x)))
    named = rows.select(F.col("id").cast("string").alias("id"), F.coalesce(deviation, F.raise_error(F.lit("deviation beyond the range of a long")).cast("long")).alias("deviation"), "y")
    scored = named.mapInPandas(score, "id string, deviation long, white array<double>")
    parts = F.array(*[F.lit(float(x)) for x in values / trace])
    each = scored.select(F.col("id").cast("long").alias("vec_id"), "deviation", F.posexplode("white").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(parts, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
