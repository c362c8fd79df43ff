"""Embedding whitening by an exact scatter matrix in residue numbers (operator 11).

Each component c of a vector becomes the whole number x = floor(1024 c) + 100000. A covariance of such
numbers loses digits to their common offset if it is summed in floating point. Here the scatter of
the n vectors is exact: with S the sum of the vectors, every y = n x - S is centred and whole;
its residues modulo several primes below 2^21 are multiplied by ordinary double GEMMs, whose sums over a
block of rows stay below 2^53 and so are exact; partitions add up their residues, and the Chinese
remainder theorem gives the scatter of y, which is n^2 times that of x. As many primes are taken as the bound
n (n r)^2 of its entries asks for, r being the largest range of a dimension. Its eigenvectors then come from one
eigh in double precision.

What reaches the driver are sums by dimension and residues by pair of dimensions: sizes of the model, not of the
table. Before the residues are dealt out there is one matrix a task, and as many tasks as a few times the
cores, however many files the table has.

Defined cases: a null or empty vector, one with null or non-finite components, with one of 2^40 or more
in size (x would leave the range that doubles hold exactly), or of another length than most (on ties, the
longest) is dropped and gives no rows; null ids and repeated rows are kept; components without variance beyond rounding are not
told, so vectors that are all equal, or a single one, give no rows; an empty table gives
an empty result; labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import by_slices

SCALE, OFFSET, LARGEST = 1024, 100_000, 2.0**40


@dataclass(frozen=True)
class WhiteningConfig:
    components: int = 8
    block: int = 2048  # rows of a GEMM: with residues within 2^20 of 0 its sums stay below 2^51
    tasks_per_core: int = 4
    rank: float = 1e-12  # of the trace: eigenvalues up to it are rounding


@dataclass(frozen=True)
class Moments:
    n: int
    sums: list[int]
    spread: int  # the largest range of a dimension


@dataclass(frozen=True)
class Model:
    moments: Moments
    weights: np.ndarray  # dimension x components: eigenvectors over the roots of their eigenvalues
    eigenvalues: np.ndarray
    trace: float


def primes_below(limit: int) -> Iterator[int]:
    """Odd primes below limit, falling."""
    for p in range(limit - 1 - limit % 2, 2, -2):
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            yield p


def primes_for(bound: int) -> list[int]:
    """So many primes that a whole number of up to bound in size follows from its residues."""
    found: list[int] = []
    for p in primes_below(1 << 21):
        if prod(found) > 2 * bound:
            break
        found.append(p)
    return found


def whole(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>) of the vectors that remain."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    common = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    length = common[0]["d"] if common else 0
    return fine.where(F.size("v") == length).select("id", F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET).cast("array<long>").alias("x"))


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    column = part.column(part.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _few(rows: DataFrame, cfg: WhiteningConfig) -> DataFrame:
    """rows in few enough partitions that a matrix for each is little beside the table."""
    return rows.coalesce(cfg.tasks_per_core * rows.sparkSession.sparkContext.defaultParallelism)


def moments(rows: DataFrame, cfg: WhiteningConfig) -> Moments | None:
    """Exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, None, None, None
        for part in batches:
            if part.num_rows:
                x = _matrix(part)
                sums = np.array(x.sum(0).tolist(), object)  # below 2^63 for a slice, without a bound in all
                total = sums if n == 0 else total + sums
                low, high = (x.min(0), x.max(0)) if n == 0 else (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "total": pa.array([str(t) for t in total]), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64()), "n": pa.array([n] * len(total), pa.int64())})

    parts = _few(rows.select("x"), cfg).mapInArrow(by_slices(run, cfg.block), "dim int, total string, low long, high long, n long")
    by_dim = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("dim").collect()
    return Moments(by_dim[0]["n"], [int(r["total"]) for r in by_dim], max(r["high"] - r["low"] for r in by_dim)) if by_dim else None


def residues(x: np.ndarray, m: Moments, p: int) -> np.ndarray:
    """n x - S modulo p, as doubles nearest to 0."""
    y = ((x % p) * (m.n % p) - np.array([s % p for s in m.sums], np.int64)) % p
    return np.where(y > p // 2, y - p, y).astype(np.float64)


def remainder(found: list[int], primes: list[int]) -> int:
    """The whole number, the nearest to 0, with these residues (Chinese remainder theorem)."""
    m = prod(primes)
    value = sum(r * (m // p) * pow(m // p, -1, p) for r, p in zip(found, primes, strict=True)) % m
    return value - m if value > m // 2 else value


def scatter(rows: DataFrame, m: Moments, cfg: WhiteningConfig) -> list[list[int]]:
    """The exact scatter matrix of y = n x - S."""
    d, primes = len(m.sums), primes_for(m.n * (m.n * m.spread) ** 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((d, d), np.int64) for _ in primes]
        for part in batches:
            if part.num_rows:
                x = _matrix(part)
                for k, p in enumerate(primes):
                    r = residues(x, m, p)
                    sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        for k, s in enumerate(sums):
            yield pa.RecordBatch.from_pydict({"prime": pa.array([k] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "row": pa.array([s[i, i:] for i in range(d)], pa.list_(pa.int64()))})

    parts = _few(rows.select("x"), cfg).mapInArrow(by_slices(run, cfg.block), "prime int, i int, row array<long>")
    each = parts.select("prime", "i", F.posexplode("row").alias("j", "r")).groupBy("prime", "i", "j").agg(F.sum("r").alias("r"))
    found = each.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("prime", "r"))).alias("r")).collect()
    out = [[0] * d for _ in range(d)]
    for f in found:
        i, j = f["i"], f["i"] + f["j"]
        out[i][j] = out[j][i] = remainder([x["r"] % primes[x["prime"]] for x in f["r"]], primes)
    return out


def fit(rows: DataFrame, cfg: WhiteningConfig = WhiteningConfig()) -> Model | None:
    m = moments(rows, cfg)
    if m is None or m.spread == 0:
        return None
    exact = scatter(rows, m, cfg)
    # Division of whole numbers rounds once.
    covariance = np.array([[v / m.n**3 for v in row] for row in exact])
    trace = sum(exact[i][i] for i in range(len(exact))) / m.n**3
    values, vectors = np.linalg.eigh(covariance)
    best = np.argsort(values)[::-1][: cfg.components]
    best = best[values[best] > cfg.rank * trace]
    return Model(m, vectors[:, best] / np.sqrt(values[best]), values[best], trace)


def _centred(x: np.ndarray, m: Moments) -> np.ndarray:
    """x - S / n in double precision: the whole part of the mean is taken off as whole numbers."""
    return (x - np.array([s // m.n for s in m.sums], np.int64)).astype(np.float64) - np.array([(s % m.n) / m.n for s in m.sums])


def identity_error(rows: DataFrame, model: Model, cfg: WhiteningConfig = WhiteningConfig()) -> float:
    """The largest entry, in size, of the whitened vectors' covariance minus the identity, summed over the table."""
    k = model.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, total = np.zeros((k, k)), np.zeros(k)
        for part in batches:
            if part.num_rows:
                w = _centred(_matrix(part), model.moments) @ model.weights
                product, total = product + w.T @ w, total + w.sum(0)
        both = np.vstack([product, total])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(range(k + 1), k), pa.int32()), "j": pa.array(np.tile(range(k), k + 1), pa.int32()), "v": pa.array(both.ravel())})

    got = _few(rows.select("x"), cfg).mapInArrow(by_slices(run, cfg.block), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    both = np.zeros((k + 1, k))
    for r in got:
        both[r["i"], r["j"]] = r["v"] / model.moments.n
    return float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cfg: WhiteningConfig = WhiteningConfig()) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) for each remaining vector and component."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = whole(vectors, id_col, vector_col)
    model = fit(rows, cfg)
    if model is None:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    error = identity_error(rows, model, cfg)
    m, k = model.moments, model.weights.shape[1]
    short = len(m.sums) * (m.n * m.spread) ** 2 < 1 << 62
    kept = np.int64 if short else object
    mean, rest = np.array([s // m.n for s in m.sums], kept), np.array([s % m.n for s in m.sums], kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x = _matrix(part)
                y = (x.astype(kept) - mean) * m.n - rest
                deviation = pa.array((y * y).sum(1), pa.int64()).cast(pa.decimal128(38, 0)) if short else pa.array([str(v) for v in (y * y).sum(1)]).cast(pa.decimal128(38, 0))
                w = _centred(x, m) @ model.weights
                again = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, m.n), pa.int64()), deviation.take(again), pa.array(w.ravel()), pa.array(np.tile(model.eigenvalues / model.trace, len(x))), pa.array(np.full(len(x) * k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(by_slices(run, cfg.block), out).withColumnRenamed("id", id_col)
