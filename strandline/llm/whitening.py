"""Operator 12: whitening of embeddings by shifted CholeskyQR over distributed Gram passes.

Vectors become integers, floor(64 c) + 1000000, whose number and sums are exact. Rows are centred
exactly before anything is multiplied: n x - S is an integer, divided once.

With X the centred rows, a pass sums the Gram matrix of Q = X inv(R), by a triangular solve of each
task's rows with every factor found so far. The first factor is that of the Gram matrix plus a shift,
which is positive definite however X is conditioned; the next passes orthogonalise what is left, until
Q's Gram matrix differs from the identity by rounding only. R is the product of the factors, so that
X'X = R'R without squaring the condition; the singular values and right vectors of R are the roots of n
times the covariance's eigenvalues, and its eigenvectors. One further pass measures the whitened rows'
covariance. Only matrices of the vectors' length come to the driver, and their sums are made by tasks.

Defined results: vectors that are null or hold null or non-finite entries take no part; rows without a
vec_id and repeated rows do, each; an empty vector has no components; vectors of each length are a fit
list of their own; a component without variance (against the first, to rounding) has null whitened and
explained 0 and plays no part in identity_error; entries beyond 40 bits are cut to that; a deviation
beyond a long is null; signs make a component's largest entry positive; equal eigenvalues share their
space in the order of the decomposition; an empty table has no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, sums

SCALE, BASE, COMPONENTS = 64, 1_000_000, 32
#: Passes at most, and the distance from the identity at which Q counts as orthonormal.
PASSES, CLOSE = 6, 1e-13
#: A component counts as without variance under this share of the first one's standard deviation.
FLAT = 1e-9
#: Numbers of rows worked on at once.
VALUES = 1 << 18


def prepared(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, vec (array of longs), dim of the rows that take part."""
    fit = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    edge = float(1 << 40)
    whole = F.transform(vector, lambda v: F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(v.cast("double") * SCALE).cast("double"))).cast("long") + BASE)
    some = rows.filter(F.col(vector).isNotNull()).filter(fit & (F.size(vector) > 0))
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vec"), F.size(vector).alias("dim"))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    each = max(1, VALUES // dim)
    for b in batches:
        for s in range(0, b.num_rows, each):
            cut = b.slice(s, each)
            yield cut, cut.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(cut.num_rows, dim)


def totals(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and their exact sums. Rows hold under 2**41, so a batch's sums are exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for _, x in _matrices(batches, dim):
            n += len(x)
            total += x.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(v) for v in total])], ["place", "n", "total"])

    parts = rows.select("vec").mapInArrow(run, "place int, n long, total string")
    got = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()
    return int(got[0]["n"]), [int(r["total"]) for r in got]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exact: longs, or Python's integers where those could be too short."""
    most = n * max(abs(int(x.min(initial=0))), int(x.max(initial=0))) + max(map(abs, total))
    if most < 1 << 62:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverses of upper triangular factors, by substitution a column at a time."""
    for r in factors:
        out = np.empty_like(rows)
        for k in range(len(r)):
            out[:, k] = (rows[:, k] - out[:, :k] @ r[:k, k]) / r[k, k]
        rows = out
    return rows


def _gram(rows: DataFrame, dim: int, n: int, total: list[int], factors: list[np.ndarray], last: np.ndarray | None = None) -> np.ndarray:
    """The Gram matrix of the centred rows, divided by the factors in turn, or multiplied by `last`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, part = None, 0
        for b, x in _matrices(batches, dim):
            part = b.column("part")[0].as_py()
            q = centred(x, n, total).astype(float) / n
            q = _solved(q, factors) if last is None else q @ last
            gram = q.T @ q + (0 if gram is None else gram)
        if gram is not None:
            yield sums.sliced("gram", part, gram)

    parts = rows.select("vec", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, sums.PARTS)
    got = sums.added(parts)["gram"]
    size = dim if last is None else last.shape[1]
    return got.reshape(size, size)


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor; shifted, that of the matrix plus a bound of its rounding."""
    dim = len(gram)
    size = float(np.trace(gram))
    shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps * size if shifted else 0.0
    shift = min(shift, size / dim)  # the bound is for single sums; no larger than the mean is needed
    return np.linalg.cholesky(gram + shift * np.eye(dim)).T


def decomposed(rows: DataFrame, dim: int, n: int, total: list[int]) -> np.ndarray:
    """R, upper triangular, with R'R the Gram matrix of the centred rows."""
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        gram = _gram(rows, dim, n, total, factors)
        if not gram.any():  # no variance at all
            return np.zeros((dim, dim))
        if k and np.abs(gram - np.eye(dim)).max() < CLOSE:
            break
        try:
            factors.append(_factor(gram, n, k == 0))
        except np.linalg.LinAlgError:  # directions without variance
            factors.append(_factor(gram, n, True))
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    return r


def components(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to `most` eigenvalues of the covariance, falling, and the unit eigenvectors as columns."""
    _, size, right = np.linalg.svd(r)
    vectors = right.T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(size))] < 0, -1, 1)
    return (size * size / n)[:most], vectors[:, :most]


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(rows: DataFrame, dim: int, most: int) -> DataFrame:
    n, total = totals(rows, dim)
    r = decomposed(rows, dim, n, total)
    trace = float((r * r).sum()) / n
    values, vectors = components(r, n, most)
    live = values > FLAT * FLAT * max(values[0], 0.0)
    map_ = vectors / np.sqrt(np.where(live, values, 1.0))
    explained = np.where(live, values, 0.0) / (trace or 1.0)
    error = float(np.abs(_gram(rows, dim, n, total, [], map_[:, live]) / n - np.eye(int(live.sum()))).max()) if live.any() else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for b, x in _matrices(batches, dim):
            d, m = centred(x, n, total), len(x)
            most_ = max(abs(int(d.min())), int(d.max()))
            square = (d * d).sum(1) if dim * most_ * most_ < 1 << 63 else (d.astype(object) ** 2).sum(1)
            square = [v if v < 1 << 63 else None for v in square.tolist()]
            white = d.astype(float) / n @ map_
            made = [pa.array(np.repeat(np.arange(m), k))]
            ids, deviation = b.column("vec_id").take(made[0]), pa.array(square, pa.int64()).take(made[0])
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation]
            columns += [pa.array(white.ravel(), mask=np.tile(~live, m)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "vec").mapInArrow(run, _OUT)


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """rows: as prepared() gives them. A row for each of them and each component."""
    rows = common.written(rows, "whole-vectors")
    spark = rows.sparkSession
    out = spark.createDataFrame([], _OUT)
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):  # as many as there are lengths
        out = out.unionByName(_whitened(rows.filter(F.col("dim") == dim), dim, most))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: whitened embeddings, 32 components each."""
    return whiten(prepared(common.table(spark, sf_dir, "embeddings")))
