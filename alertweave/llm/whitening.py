"""Whitening of vectors; the eigenvectors come from QDWH spectral divide-and-conquer.

Sums and second moments of integer vectors are gathered over all rows: each task adds up its rows, centred on whole numbers next to
the means, in exact integers, and one small row a dimension and task is summed. The covariance is then split on the driver (its
size is the length of a vector, squared, whatever the number of rows): for a shift between its eigenvalues, the polar factor of
the shifted matrix is found by QDWH iterations (QR- and Cholesky-based, no eigenvalue routine); the factor plus the identity,
halved, projects onto the eigenvectors above the shift; an orthonormal basis of both sides cuts the matrix in two, and each part is
split again until it is diagonal. The whitening matrix is broadcast, and rows are projected where they lie.

Defined results: rows whose vector is null or holds a component that is null or not finite are left out; a null id stays null; rows
that repeat are all counted and returned. Shorter vectors are padded with zero components. Equal eigenvalues have any orthonormal
basis, one for all rows. A component without variance beyond rounding has explained 0 and whitened null, and is left out of the
identity's error. ``deviation`` is null where it exceeds a long. An empty table gives an empty result. Columns beyond the two named in
the call may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertweave.llm.common import read

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Components beyond this, multiplied, count as this; they would not fit in a long.
LARGEST = 9e18
EPS = np.finfo(float).eps


# ---- spectral divide and conquer ----------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH; ``a`` should not be singular."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    r = np.linalg.qr(x, mode="r")
    small = np.abs(np.diag(r)).min()
    low = min(max(small / np.sqrt(n), EPS), 1.0)
    for _ in range(60):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        q = (p - 1) ** 2 / 4
        s = p + q - 1
        before = x
        if s > 100:
            both, _ = np.linalg.qr(np.vstack((np.sqrt(s) * x, np.eye(n))))
            x = (q / s) * x + (p - q / s) / np.sqrt(s) * both[:n] @ both[n:].T
        else:
            half = np.linalg.cholesky(np.eye(n) + s * x.T @ x)
            inner = np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
            x = (q / s) * x + (p - q / s) * inner
        x = (x + x.T) / 2
        low = min(low * (p + q * square) / (1 + s * square), 1.0)
        if np.linalg.norm(x - before) <= np.cbrt(EPS) * np.sqrt(n) and abs(1 - low) < 1e-12:
            break
    # Newton-Schulz steps put back the digits that the iteration has lost.
    for _ in range(2):
        x = 1.5 * x - 0.5 * x @ x.T @ x
    return (x + x.T) / 2


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthonormal basis that makes ``a`` block diagonal, and the size of its first block; None if nothing is to split."""
    n = len(a)
    size = np.linalg.norm(a)
    if np.linalg.norm(a - np.diag(np.diag(a))) <= n * EPS * size:
        return None
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n))
    if spread <= n * EPS * size:
        return None
    draw = np.random.default_rng(n).standard_normal((n, n))
    best = None
    # The median of the diagonal halves the work; the mean always lies between eigenvalues. Moved a little, a shift that hits one is left.
    for shift in (np.median(np.diag(a)), np.trace(a) / n, *(np.trace(a) / n + f * spread / n for f in (1e-3, -1e-3, 1e-2, -1e-2))):
        project = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(project)))
        if not 0 < k < n:
            continue
        basis, _ = np.linalg.qr(np.hstack((project @ draw[:, :k], draw[:, k:])))
        basis, _ = np.linalg.qr(np.hstack((project @ basis[:, :k], basis[:, k:] - project @ basis[:, k:])))
        left = np.linalg.norm(basis[:, :k].T @ a @ basis[:, k:])
        if best is None or left < best[0]:
            best = left, basis, k
        if left <= 10 * n * EPS * size:
            break
    if best is None:
        return None
    return best[1], best[2]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(a)
    basis = np.eye(n)
    # Parts still to be split, as ranges of columns of the basis.
    parts = [(0, n)]
    while parts:
        start, stop = parts.pop()
        if stop - start < 2:
            continue
        own = basis[:, start:stop]
        part = own.T @ a @ own
        cut = _split((part + part.T) / 2)
        if cut is None:
            continue
        basis[:, start:stop] = own @ cut[0]
        parts += [(start, start + cut[1]), (start + cut[1], stop)]
    basis = 1.5 * basis - 0.5 * basis @ (basis.T @ basis)
    values = np.einsum("ij,ij->j", basis, a @ basis)
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order]


# ---- moments over all rows ----------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def integers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows that take part as ``vec_id, x``."""
    v = F.col(vector)
    held = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    x = F.transform(v, lambda c: F.floor(held(c)).cast("long") + F.lit(offset).cast("long"))
    return vectors.where(usable(v)).select(F.col(id_column).alias("vec_id"), x.alias("x"))


def rows_of(batch: pa.RecordBatch, width: int, fill: int) -> np.ndarray:
    """The vectors of a batch as a matrix; short ones end in ``fill``."""
    lists = batch.column("x")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), fill, dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _summed(df: DataFrame, width: int, part, kind: str) -> np.ndarray:
    """The sum over all batches of a matrix of ``width`` rows that ``part`` makes of each; one row a dimension and task moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = part(batch)
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "m": pa.array(list(total))})

    cells = df.mapInArrow(run, f"i long, m array<{kind}>").select("i", F.posexplode("m").alias("j", "v"))
    summed = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("m"))
    out = [[0] * width for _ in range(width)]
    for row in summed.select("i", "m.v").collect():
        out[row["i"]] = row["v"]
    return np.array(out)


@dataclass
class Whitening:
    """What was fitted: ``n`` rows, sums ``s`` by dimension (exact), eigenvalues, eigenvectors as columns, and the variance in all."""

    n: int
    s: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float
    fill: int = OFFSET
    error: float | None = None

    @property
    def width(self) -> int:
        return len(self.s)

    @property
    def alive(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.values > self.width * EPS * max(self.total, 0.0)

    def matrix(self) -> np.ndarray:
        roots = np.sqrt(np.where(self.alive, self.values, 1.0))
        return self.vectors / roots

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n without losing digits to the size of x."""
        near = np.array([v // self.n for v in self.s], dtype=np.int64)
        if np.abs(x).max(initial=0) > 2**61:
            return x.astype(float) - near - np.array([v % self.n for v in self.s], dtype=float) / self.n
        return (x - near) - np.array([v % self.n for v in self.s], dtype=float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.matrix()

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over the dimensions of (n x - S)^2; null beyond a long."""
        rough = np.sum((self.n * self.centred(x)) ** 2, axis=1)
        if rough.max(initial=0.0) < 2**62:
            near = np.array([v // self.n for v in self.s], dtype=np.int64)
            rest = np.array([v % self.n for v in self.s], dtype=np.int64)
            return pa.array(np.sum((self.n * (x - near) - rest) ** 2, axis=1))
        each = (sum((self.n * int(v) - s) ** 2 for v, s in zip(r, self.s)) for r in x)
        return pa.array([v if v < 2**63 else None for v in each], pa.int64())


def fit(rows: DataFrame, components: int = COMPONENTS, fill: int = OFFSET) -> Whitening | None:
    """Fit on all rows of ``x``; None if there are none."""
    n, width, least, most = rows.agg(
        F.count(F.lit(1)), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))
    ).first()
    if not n or not width:
        return None
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("k"))
    s = [0] * width
    for row in sums.collect():
        s[row["i"]] = int(row["s"]) + fill * (n - row["k"])
    near = np.array([v // n for v in s], dtype=np.int64)

    farthest = max(max(v - min(least, fill), max(most, fill) - v) for v in map(int, near))
    exact = n * farthest**2 < 2**63

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        y = rows_of(batch, width, fill)
        y = y - near if exact else y.astype(float) - near
        # Sums are exact in doubles up to 2^53 a batch, then in integers; only beyond a long they are rounded.
        if not exact or farthest**2 * len(y) < 2**53:
            made = y.T.astype(float) @ y.astype(float)
            return made.astype(np.int64) if exact else made
        return y.T @ y

    second = _summed(rows, width, moments, "long" if exact else "double")
    rest = np.array([v % n for v in s], dtype=float) / n
    covariance = second / n - np.outer(rest, rest)
    values, vectors = eigen(covariance)
    out = Whitening(n, s, values[:components], vectors[:, :components], float(np.trace(covariance)), fill)

    def crossed(batch: pa.RecordBatch) -> np.ndarray:
        w = out.whitened(rows_of(batch, width, fill))
        return w.T @ w

    spread = _summed(rows, min(components, width), crossed, "double") / n
    # The mean of the whitened rows is the exact mean's projection, which is zero.
    gap = np.abs(spread - np.eye(len(spread)))[np.ix_(out.alive, out.alive)]
    out.error = float(gap.max(initial=0.0))
    return out


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, fitted: Whitening | None) -> DataFrame:
    """One row for each row and component."""
    spark = rows.sparkSession
    if fitted is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        count = len(w.values)
        share = np.where(w.alive, w.values / w.total if w.total > 0 else 0.0, 0.0)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = rows_of(part, w.width, w.fill)
                size = len(x) * count
                each = pa.array(np.repeat(np.arange(len(x)), count))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column("vec_id").cast(pa.int64()).take(each),
                        "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                        "n": pa.array(np.full(size, w.n)),
                        "deviation": w.deviation(x).take(each),
                        "whitened": pa.array(w.whitened(x).ravel(), mask=np.tile(~w.alive, len(x))),
                        "explained": pa.array(np.tile(share, len(x))),
                        "identity_error": pa.array(np.full(size, w.error)),
                    }
                )

    return rows.mapInArrow(run, SCHEMA)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    rows = integers(vectors, id_column, vector)
    return transform(rows, fit(rows, components))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every vector of ``embeddings``."""
    return whiten(read(spark, sf_dir, "embeddings"))
