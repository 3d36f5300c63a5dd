"""Whitening of embeddings from an exact covariance, by bit-sliced scatter.

Components become integers.  Each dimension, shifted so that its least value is 0, is cut into
bit planes, and a plane of 64 rows is one word.  The sum over rows of x_i * x_j is then the sum over
planes a of i and b of j of 2^(a+b) times the bits set in the AND of the two planes, so cross-products
are exact whatever the order in which tasks are added up.  They are centred as integers,
n * P - S * S', and only the quotient by n^2 is rounded before the eigenvectors are taken.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from packmill.llm.common import Scratch, bundled, extended, map_batches
from packmill.llm.vectors import binaries, finite, from_binaries, matrix, usual_length

GRID, OFFSET = 64, 1_000_000
COMPONENTS = 16
# rows that are cut into planes at a time
BLOCK = 16_384
# integers are held within this, so that sums of products fit the decimals they are added in
LARGEST = 1 << 40
# eigenvalues below this share of their sum are rounding errors: nothing can be divided by them
NO_VARIANCE = 1e-12


def grid(values: np.ndarray) -> np.ndarray:
    """Components as integers: floor(64 * c) + 1,000,000, held within LARGEST."""
    return np.clip(np.floor(GRID * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def bit_planes(values: np.ndarray, widths: list[int]) -> np.ndarray:
    """The planes of unsigned integers (rows, dimensions), by dimension and then bit, in words of 64 rows."""
    n = len(values)
    out = np.zeros((sum(widths), (n + 63) // 64), np.uint64)
    view, at = out.view(np.uint8), np.concatenate([[0], np.cumsum(widths)])
    for bit in range(max(widths, default=0)):
        dims = [d for d, w in enumerate(widths) if w > bit]
        packed = np.packbits(((values[:, dims] >> bit) & 1).astype(np.uint8), axis=0).T
        view[at[dims] + bit, :packed.shape[1]] = packed
    return out


def add_counts(counts: np.ndarray, planes: np.ndarray) -> None:
    """Adds the bits set in the AND of every two planes to the upper half of `counts`."""
    for p in range(len(planes)):
        counts[p, p:] += np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)


def weighted(counts: np.ndarray, widths: list[int]) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Sums per dimension and cross-products per pair (i <= j) from counts of planes."""
    at = np.concatenate([[0], np.cumsum(widths)]).tolist()
    full = counts + np.triu(counts, 1).T
    sums = [sum(int(full[at[i] + a, at[i] + a]) << a for a in range(w)) for i, w in enumerate(widths)]
    products = {}
    for i, u in enumerate(widths):
        for j in range(i, len(widths)):
            part = full[at[i]:at[i + 1], at[j]:at[j + 1]].tolist()
            products[i, j] = sum(c << (a + b) for a, line in enumerate(part) for b, c in enumerate(line))
    return sums, products


def _bounds(length: int):
    """Least and largest integer of each dimension, within the task."""
    def bounds(batches):
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                x = grid(matrix(batch.column("v"), length))
                low, high = x.min(axis=0), x.max(axis=0)
                lo, hi = (low, high) if lo is None else (np.minimum(lo, low), np.maximum(hi, high))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length)), pa.array(lo), pa.array(hi)], ["d", "lo", "hi"])
    return bounds


def _codes(lo: np.ndarray, kind: str):
    """Distances from the least values, in as few bytes as the largest needs."""
    def codes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([binaries((grid(matrix(batch.column("v"), len(lo))) - lo).astype(kind))], ["code"])
    return codes


def _scatter(widths: list[int], kind: str):
    """Per task the number of rows (-1, -1), sums (i, -1) and cross-products (i, j)."""
    def scatter(batches):
        counts, n = np.zeros((sum(widths),) * 2, np.int64), 0
        for batch in batches:
            x = from_binaries(batch.column("code"), kind, len(widths))
            n += len(x)
            for start in range(0, len(x), BLOCK):
                add_counts(counts, bit_planes(x[start:start + BLOCK], widths))
        sums, products = weighted(counts, widths)
        rows = {(-1, -1): n, **{(i, -1): s for i, s in enumerate(sums)}, **products}
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in rows], pa.int64()), pa.array([j for _, j in rows], pa.int64()),
             pa.array(list(rows.values()), pa.decimal128(38, 0))], ["i", "j", "v"])
    return scatter


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, sums and least values per dimension, the covariance, eigenvalues from the largest down,
    unit eigenvectors as columns, and the largest error of the covariance of the whitened vectors."""

    n: int
    sums: list[int]
    low: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def usable(self) -> int:
        """How many components have a variance to divide by."""
        return int((self.values > NO_VARIANCE * max(np.trace(self.covariance), 0)).sum()) if len(self.values) else 0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer vectors from which the least values are taken."""
        mean = np.array([s / self.n for s in self.sums])
        k = self.usable
        return (x.astype(np.float64) - mean) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))


def _squares(model: Whitening, kind: str):
    """Per task the sums of products of the whitened components."""
    def squares(batches):
        k = model.usable
        total = np.zeros((k, k))
        for batch in batches:
            y = model.project(from_binaries(batch.column("code"), kind, len(model.low)))
            total += y.T @ y
        i, j = np.divmod(np.arange(k * k), max(k, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])
    return squares


def fit_whitening(vectors: DataFrame, length: int, components: int = COMPONENTS) -> Whitening | None:
    """The model of vectors(v), all finite and of one length; None if there are none.

    Each distinct integer vector counts once.  To the driver come one row per dimension and one per pair.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    bounds = map_batches(vectors, _bounds(length), "d long, lo long, hi long")
    found = bounds.groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").collect()
    if not found:
        return None
    low = np.array([r.lo for r in found], np.int64)
    widths = [(r.hi - r.lo).bit_length() for r in found]
    kind = next(k for k in ("u1", "u2", "u4", "u8") if max(widths) <= 8 * np.dtype(k).itemsize)
    fit = scratch.table(map_batches(vectors, _codes(low, kind), "code binary").distinct())
    sums = map_batches(fit, _scatter(widths, kind), "i long, j long, v decimal(38,0)").groupBy("i", "j").agg(
        F.sum("v").alias("v")).collect()
    total = {(r.i, r.j): int(r.v) for r in sums}
    n, s = total[-1, -1], [total[i, -1] for i in range(length)]
    covariance = np.zeros((length, length))
    for i in range(length):
        for j in range(i, length):
            covariance[i, j] = covariance[j, i] = (n * total[i, j] - s[i] * s[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = np.maximum(values[::-1][:components], 0), axes[:, ::-1][:, :components]
    # one sign for all rows: the largest entry of an eigenvector is positive
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, s, low, covariance, values, axes)
    k, error = model.usable, 0.0
    if k:
        squares = map_batches(fit, _squares(model, kind), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        error = max(abs(r.v / n - (r.i == r.j)) for r in squares.collect())
    scratch.drop(fit)
    return Whitening(n, s, low, covariance, values, axes, error)


def _whitened(model: Whitening):
    def whitened(batches):
        n, sums = model.n, np.array(model.sums, object)
        # of 20 bits, so that products with them stay longs
        parts = [np.array([(s >> (20 * k)) & 0xFFFFF for s in model.sums], np.int64) for k in range(6)]
        square = int((sums * sums).sum())
        for batch in batches:
            x = grid(matrix(batch.column("v"), len(model.low))) - model.low
            y = model.project(x)
            if np.abs(x).max(initial=0) < 1 << 20:
                own = (x * x).sum(axis=1).tolist()
                cross = sum((x @ part).astype(object) << (20 * k) for k, part in enumerate(parts)).tolist()
            else:
                big = x.astype(object)
                own, cross = (big * big).sum(axis=1).tolist(), (big * sums).sum(axis=1).tolist()
            deviation = [n * n * a - 2 * n * b + square for a, b in zip(own, cross, strict=True)]
            fill = np.full((len(x), len(model.values) - y.shape[1]), np.nan)
            flat = np.concatenate([y, fill], axis=1).ravel()
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(model.values)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat)))
            kept = [c for c in batch.schema.names if c != "v"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array([d if d < 10**38 else None for d in deviation], pa.decimal128(38, 0)), lists],
                [*kept, "deviation", "whitened"])
    return whitened


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS,
           carry: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (struct `row`, of the columns `carry` if given) with n, deviation and the arrays whitened and explained.

    Components c of a vector become integers x = floor(64 * c) + 1,000,000, those beyond 2^40 that number.  Vectors that
    are null or hold a null or a non-finite component have no row; neither have vectors of another
    length than most have.  n counts the distinct x of the rest and S sums them; deviation is the exact sum of
    (n * x - S)^2 (null from 10^38 on), whitened the unrounded x - S / n on the eigenvectors of their covariance, over the
    root of the eigenvalue; where a component has no variance (fewer distinct vectors than dimensions) it is null
    and explained is 0.  There are as many components as dimensions, or `components` if these are more.  Repeated rows get a row
    each and count once in the fit; an empty table gives an empty one.  identity_error is the largest error of the
    covariance of the whitened distinct vectors, measured on them.
    """
    length = usual_length(vectors, F.col(f"`{vector}`"))
    rows = bundled(vectors, carry, v=F.col(f"`{vector}`")).where(finite(F.col("v")) & (F.size("v") == length))
    model = fit_whitening(rows.select("v"), length, components) if length else None
    if model is None:
        model = Whitening(0, [], np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
        rows = rows.where("false")
    trace = float(np.trace(model.covariance))
    explained = [float(e) / trace if k < model.usable else 0.0 for k, e in enumerate(model.values)]
    out = map_batches(rows, _whitened(model), extended(rows, ["v"], "deviation decimal(38,0), whitened array<double>"))
    return out.select("row", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.array(*map(F.lit, explained)).cast("array<double>").alias("explained"),
                      F.lit(model.identity_error).alias("identity_error"))


def op13_bit_sliced(spark, sf_dir: str) -> DataFrame:
    """deviation is null where it doesn't fit a long."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), carry=("vec_id",))
    return found.select("row.vec_id", F.posexplode("whitened").alias("at", "whitened"), "n", "deviation", "explained",
                        "identity_error").select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")
