"""Embedding whitening by shifted CholeskyQR.

Vectors are read as integers, ``floor(64 * entry) + 1,000,000``. The fit list holds each distinct integer vector once.
Its column sums are exact integers, and rows are centred exactly (integer part apart from the remainder of the mean)
before anything is multiplied. Each pass over the fit list solves its centred rows against the triangular factors so
far and adds up the Gram matrix of the result in its tasks; the first Cholesky factorisation is shifted, so it can't
break down, and passes go on until a Gram matrix is next to the identity. The product of the factors is the R of the
centred matrix, and its singular values and right vectors are those of the whole: small components keep the precision
that an eigendecomposition of the covariance would lose. A last pass measures the covariance of the whitened fit list.

The driver holds matrices of dimensions x dimensions only: 16 partial sums of each pass, whatever the rows.

Null vectors and those with null or non-finite entries are dropped, and so are those of another length than the
commonest (of equally common ones, the longest). Entries beyond 2^46 either way count as 2^46. Null ids, repeated rows and
further columns make no difference. Components without variance are not numbered: equal vectors alone, one row or an
empty table give no rows. ``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

SCALE, OFFSET, LIMIT = 64, 1_000_000, float(1 << 52)
COMPONENTS = 16
MAX_PASSES = 8
#: Partial Gram matrices that reach the driver in a pass.
PARTIALS = 16


def integer_rows(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(rows of id, x, and the number of entries of each x)."""
    v = pick(rows, id=id_col, v=vec_col).withColumn("v", F.transform("v", lambda c: c.cast("double")))
    v = v.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    most = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0

    def whole(c):
        return F.floor(F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))).cast("bigint") + OFFSET

    return v.filter(F.size("v") == d).select("id", F.transform("v", whole).alias("x")), d


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each column). Sums of the high and the low 32 bits stay within a long."""

    def run(batches):
        import pyarrow as pa

        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n] * d), pa.array(range(d), pa.int32()), pa.array(high), pa.array(low)], names=["n", "k", "high", "low"])

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    got = fit.mapInArrow(run, "n bigint, k int, high bigint, low bigint").groupBy("k").agg(*exact).orderBy("k").collect()
    return int(got[0]["n"]) if got else 0, [(int(r["high"]) << 32) + int(r["low"]) for r in got]


class Centre:
    """The mean of the fit list as integers: quotient and remainder of each column's sum by n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.rest = n, [s % n for s in sums]
        self.base = np.array([s // n for s in sums], np.int64)
        self.part = np.array([r / n for r in self.rest])
        self.squares = sum(r * r for r in self.rest)

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x less the whole part of the mean, x less the mean)."""
        u = x - self.base
        return u, u - self.part

    def deviations(self, u: np.ndarray) -> list[int | None]:
        """Sum over the columns of (n x - S)^2, expanded so that only three exact integers a row are large."""
        d, top = u.shape[1], max(1, int(np.abs(u).max(initial=0)))
        if top * top * d < 1 << 62 and top * self.n * d < 1 << 62:
            squares, cross = (u * u).sum(axis=1).tolist(), (u @ np.array(self.rest, np.int64)).tolist()
        else:
            rows = [r.tolist() for r in u]
            squares, cross = [sum(a * a for a in r) for r in rows], [sum(a * b for a, b in zip(r, self.rest, strict=True)) for r in rows]
        exact = [self.n * self.n * a - 2 * self.n * b + self.squares for a, b in zip(squares, cross, strict=True)]
        return [v if v < 1 << 63 else None for v in exact]


def solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``y`` times the inverse of the upper triangle ``r``, column by column."""
    q = np.empty_like(y)
    for j in range(r.shape[0]):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(fit: DataFrame, centre: Centre, map_rows, width: int) -> np.ndarray:
    """Sum over the fit list of the outer products of ``map_rows`` of its centred rows."""
    d = len(centre.rest)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for low in range(0, len(x), 4096):
                q = map_rows(centre.apart(x[low : low + 4096])[1])
                total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "g"])

    def add(batches):
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            for g in batch.column(1):
                total += np.frombuffer(g.as_py()).reshape(width, width)
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["part", "g"])

    some = fit.mapInArrow(run, "part bigint, g binary").repartition(PARTIALS, "part").sortWithinPartitions("part").mapInArrow(add, "part bigint, g binary")
    return np.sum([np.frombuffer(r["g"]).reshape(width, width) for r in some.collect()], axis=0)


def triangle(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the QR factorisation of the centred fit list, by repeated passes of shifted CholeskyQR."""
    d, unit = len(centre.rest), 2.0**-53
    factors: list[np.ndarray] = []
    live = np.arange(d)
    whole = np.eye(d)
    while len(factors) < MAX_PASSES:
        done, cols = list(factors), live

        def map_rows(y):
            y = np.ascontiguousarray(y[:, cols])
            for r in done:
                y = solved(y, r)
            return y

        g = gram(fit, centre, map_rows, len(live))
        if not factors:  # columns without variance are exactly zero
            on = np.diag(g) > 0
            live, g = live[on], g[np.ix_(on, on)]
            if not len(live):
                return np.zeros((0, d))
            whole = np.eye(d)[live]
        k, spread = len(live), np.linalg.eigvalsh(g)
        shift = 0.0 if factors and spread[0] > 1e-10 * spread[-1] else 11 * (centre.n * k + k * (k + 1)) * unit * spread[-1]
        r = np.linalg.cholesky(g + shift * np.eye(k)).T
        last = bool(factors) and np.abs(g - np.eye(k)).max() < 1e-3
        factors.append(r)
        whole = r @ whole
        if last:
            break
    return whole


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    whole, d = integer_rows(rows, id_col, vec_col)
    kind = rows.schema[id_col].dataType.simpleString()
    empty = rows.sparkSession.createDataFrame([], f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    if d == 0:
        return empty
    fit = materialize(whole.select("x").distinct(), "white-fit")
    centre = Centre(*column_sums(fit, d))
    r = triangle(fit, centre)
    if not len(r):
        return empty
    _, sigma, axes = np.linalg.svd(r, full_matrices=False)
    k = int((sigma[:components] > sigma[0] * d * 2.0**-50).sum())
    scale, share = sigma[:k] / np.sqrt(centre.n), sigma[:k] ** 2 / (sigma**2).sum()
    axes = np.ascontiguousarray(axes[:k].T)

    def project(y):
        return (y @ axes) / scale

    error = float(np.abs(gram(fit, centre, project, k) / centre.n - np.eye(k)).max())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            u, y = centre.apart(_matrix(batch.column(1), d))
            w = project(y)
            ends = pa.array(np.arange(len(u) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(u), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], names=["id", "deviation", "w"])

    out = whole.mapInArrow(run, f"id {kind}, deviation bigint, w array<double>").select("id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select(
        "id", (F.col("k") + 1).cast("int").alias("component"), F.lit(centre.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(float(s)) for s in share]), F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` on up to 16 components; null or ragged vectors go, an empty table gives no rows."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
