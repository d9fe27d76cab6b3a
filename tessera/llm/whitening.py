"""Embedding whitening by merged moments.

Entries become integers first: ``floor(64 * c) + 1000000``. Each task computes count,
sums and centred scatter of its batches and merges them by Chan's formula; the tasks'
moments are merged pairwise by the same formula in a ``treeReduce``, so the driver
receives a few matrices of dimensions squared. It takes eigenvectors of the
covariance by ``eigh``. A second pass whitens every vector and merges the moments of
the results the same way, which shows how far their covariance is from the identity.

Integers keep this exact: sums are integers of any size, a vector is centred by
subtracting the rounded mean in integers and then the remainder, at most a half, and
only what is left is multiplied. The mean's size (a million) so costs no digit.

The fit list: all vectors that aren't null, hold no null or non-finite entry, and
have ``dims`` entries, which is by default the commonest length (of equally common
ones the longest). Other rows are dropped.

Defined results: repeated rows and null ids count and give rows like others. Integers
beyond 62 bits are held at that bound. Directions without variance (eigenvalue at most
``dims`` times the rounding error of the largest; all of them if only one vector is
there) can't be whitened: ``whitened`` is null there and they don't enter
``identity_error``, which is null if no direction is left, as is ``explained`` without
any variance. ``deviation`` is null where it passes 64 bits. A table without vectors
gives an empty frame; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import quoted, small_batches

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
_MOST = float(1 << 62)


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors that count, and their integer entries."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    flat = column.filter(pa.array(right)).flatten()
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # a null entry becomes not-a-number
    fine = np.isfinite(c).all(1)
    x = np.clip(np.floor(c[fine] * SCALE), -_MOST, _MOST).astype(np.int64) + SHIFT
    return np.flatnonzero(right)[fine], x


def _sums(x: np.ndarray) -> list[int]:
    if len(x) and float(np.abs(x.astype(np.float64)).max()) * len(x) >= _MOST:
        return [int(s) for s in x.astype(object).sum(0)]
    return x.sum(0).tolist()


def _pivot(total: list[int], n: int) -> tuple[list[int], list[int]]:
    """The rounded means, and what the sums are beyond them."""
    p = [(2 * s + n) // (2 * n) for s in total]
    return p, [s - n * q for s, q in zip(total, p)]


def centred(x: np.ndarray, total: list[int], n: int) -> np.ndarray:
    """x less the mean of n vectors with these sums."""
    p, rest = _pivot(total, n)
    return (x - np.array(p, np.int64)).astype(np.float64) - np.array(rest, np.float64) / n


@dataclass
class Moments:
    """Count, sums (exact integers, or floats) and centred scatter of vectors."""

    n: int
    total: list
    scatter: np.ndarray

    @classmethod
    def of_integers(cls, x: np.ndarray) -> "Moments":
        total = _sums(x)
        y = centred(x, total, len(x))
        return cls(len(x), total, y.T @ y)

    @classmethod
    def of_floats(cls, z: np.ndarray) -> "Moments":
        y = z - z.mean(0)
        return cls(len(z), z.sum(0).tolist(), y.T @ y)

    def merged(self, other: "Moments") -> "Moments":
        """Chan's formula; the means' difference is taken in whole numbers where the sums are."""
        a, b = self.n, other.n
        delta = np.array([(t * a - s * b) / (a * b) for s, t in zip(self.total, other.total)], np.float64)
        return Moments(a + b, [s + t for s, t in zip(self.total, other.total)], self.scatter + other.scatter + np.outer(delta, delta) * (a * b / (a + b)))

    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def _merged_of(vectors: DataFrame, name: str, moments) -> Moments | None:
    """The moments of all vectors; ``moments``: of an Arrow array, or None if no vector counts."""

    def run(batches):
        import pickle

        own = None
        for b in batches:
            if (m := moments(b.column(name))) is not None:
                own = m if own is None else own.merged(m)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["moments"])

    def read(row):
        import pickle

        return pickle.loads(bytes(row[0]))

    parts = vectors.mapInArrow(run, "moments binary").rdd.map(read)  # one row a task
    return parts.treeReduce(lambda a, b: a.merged(b) if a and b else a or b) if parts.getNumPartitions() else None


@dataclass
class Whitening:
    """A fitted transform; of the size of the components, however many vectors it was fitted to."""

    dims: int
    n: int
    total: list[int]
    components: np.ndarray  # a row for each
    values: np.ndarray
    trace: float

    @classmethod
    def of(cls, m: Moments, dims: int, components: int = COMPONENTS) -> "Whitening":
        v = m.covariance()
        e, u = np.linalg.eigh((v + v.T) / 2)
        first = np.argsort(-e, kind="stable")[:components]
        return cls(dims, m.n, m.total, np.ascontiguousarray(u[:, first].T), e[first], float(np.trace(v)))

    def usable(self) -> np.ndarray:
        return self.values > self.dims * np.finfo(np.float64).eps * max(float(self.values[0]), 0.0)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """A row of whitened numbers for each vector; not-a-number along directions without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable(), centred(x, self.total, self.n) @ self.components.T / np.sqrt(np.where(self.usable(), self.values, np.nan)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each vector the sum of (n x - S)^2, exactly; None beyond 64 bits."""
        p, rest = _pivot(self.total, self.n)
        d = x - np.array(p, np.int64)
        most = float(np.abs(d.astype(np.float64)).max(initial=0.0)) * self.n + self.n
        if most * most * self.dims < 2.0**63:
            z = d * self.n - np.array(rest, np.int64)
            return (z * z).sum(1).tolist()
        z = d.astype(object) * self.n - np.array(rest, object)
        return [s if s < 1 << 63 else None for s in (z * z).sum(1).tolist()]


def commonest_length(vectors: DataFrame) -> int:
    """The most frequent length of the vectors, the longest of several; 0 without vectors."""
    top = vectors.where("v IS NOT NULL").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def fit(vectors: DataFrame, vector_col: str = "embedding", dims: int | None = None, components: int = COMPONENTS) -> Whitening | None:
    """The transform fitted to all vectors that count; None if there are none."""
    base = vectors.select(F.col(quoted(vector_col)).alias("v"))
    dims = dims or commonest_length(base)
    if not dims:
        return None

    def moments(column):
        x = integers(column, dims)[1]
        return Moments.of_integers(x) if len(x) else None

    m = _merged_of(base, "v", moments)
    return Whitening.of(m, dims, components) if m else None


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, by a pass over all of them."""
    use = model.usable()
    if not use.any():
        return None

    def moments(column):
        x = integers(column, model.dims)[1]
        return Moments.of_floats(model.apply(x)[:, use]) if len(x) else None

    m = _merged_of(vectors.select(F.col(quoted(vector_col)).alias("v")), "v", moments)
    return float(np.abs(m.covariance() - np.eye(int(use.sum()))).max()) if m else None


def transformed(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, whitened array<double>, deviation`` for each vector that counts; entries null along directions without variance."""
    base = vectors.select(F.col(quoted(id_col)).alias("vec_id"), F.col(quoted(vector_col)).alias("v"))
    kind = base.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, x = integers(b.column("v"), model.dims)
            z = pa.array(model.apply(x).ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(model.values), pa.int32()), z)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(at)), lists, pa.array(model.deviations(x), pa.int64())], names=["vec_id", "whitened", "deviation"])

    return base.mapInArrow(run, f"vec_id {kind}, whitened array<double>, deviation long")


def whitening(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component."""
    with small_batches(vectors.sparkSession):
        model = fit(vectors, vector_col, dims, components)
        if model is None:
            kind = vectors.schema[id_col].dataType.simpleString()
            return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
        error = identity_error(vectors, model, vector_col)
    shares = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.values])
    rows = transformed(vectors, model, id_col, vector_col).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
