"""Embedding near-duplicates by iterative quantisation (operator 1).

A rotation is learned that makes the signs of the rotated coordinates balanced binary codes
with little quantisation error (Gong and Lazebnik, "Iterative Quantization", 2011). It is
fitted on a bounded sample of vectors; every vector is then coded. Codes are cut into
substrings, one table each; a pair is retrieved if any substring differs in at most one bit
(multi-index hashing). Candidates whose whole codes are near enough are reranked by cosine in
double precision on the original vectors, so no pair below the bound is linked.

Equal vectors collapse to one class first, so copies cost no pairs; a class counts in n_links
with its size. Substring length follows the number of classes, about its binary logarithm, so a
bucket holds a few classes however large the table is. A longer substring is hit less often, so
the number of rotations follows from the length: as many as give a pair at the bound the
recall asked for by the chance of at most one differing bit in some substring.

Defined cases: null or zero vectors, vectors with null or non-finite components, or of another
length than most link with nothing; null ids are kept and link with nothing; an id that
repeats with equal vectors counts once per row; an empty table gives an empty result; labels
and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import by_slices, stage, unstage


@dataclass(frozen=True)
class ItqConfig:
    cosine: float = 0.95
    bits: int = 64  # of one rotation, at most the dimension
    rotations: int = 2  # at least
    recall: float = 0.97  # expected of pairs at the bound; pairs above it are met more often
    sample: int = 20_000
    iterations: int = 30
    seed: int = 11
    slack: float = 4.0  # standard deviations of the Hamming distance allowed beyond its mean at the bound


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    basis: np.ndarray  # dimension x bits


def plan(n: int, bits: int, cfg: ItqConfig) -> tuple[int, int]:
    """(bits of a substring, rotations) for n classes and codes of so many bits."""
    short = min(int(np.clip(np.ceil(np.log2(max(n, 2))), 8, 40)), bits)
    flip = np.arccos(cfg.cosine) / np.pi
    met = (1 - flip) ** short + short * flip * (1 - flip) ** (short - 1)
    tables = np.log(1 - cfg.recall) / np.log(1 - met)
    return short, max(cfg.rotations, int(np.ceil(tables / len(_cuts(bits, short)))))


def _cuts(bits: int, short: int) -> list[tuple[int, int]]:
    """Where the substrings of a code begin and end; what is left is one if it is more than half as long."""
    return [(s, min(s + short, bits)) for s in range(0, max(bits - short // 2, 1), short)]


def fit_rotation(x: np.ndarray, bits: int, iterations: int, seed: int) -> Rotation:
    """Principal directions, then the orthogonal matrix that brings them closest to their signs."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    centred = x - mean
    _, _, directions = np.linalg.svd(centred.T @ centred)
    v = centred @ directions[:bits].T
    r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
    for _ in range(iterations):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return Rotation(mean, directions[:bits].T @ r)


def codes(x: np.ndarray, rotation: Rotation) -> np.ndarray:
    """Bits, one column each."""
    return ((x - rotation.mean) @ rotation.basis) > 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec array<double>) of the rows that can link, and their common length (0 if there are none)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    lengths = {r["n"]: r["count"] for r in rows.groupBy(F.size("vec").alias("n")).count().collect() if r["n"] > 0}
    dim = max(lengths, key=lambda n: (lengths[n], n), default=0)
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.where((F.size("vec") == dim) & fine), dim


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cfg: ItqConfig = ItqConfig()) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    good, dim = usable(vectors, id_col, vec_col)
    alone = vectors.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.coalesce(F.col(id_col).isNotNull(), F.lit(True)).alias("kept"))
    if not dim:
        return alone
    # Equal vectors: one class with the least id; zeros of either sign are equal.
    classes = stage(good.select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).groupBy("vec").agg(F.min("id").alias("cls"), F.count("*").alias("size")), "classes")
    member = good.select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec")).join(classes, "vec").select("id", "cls")
    links = stage(class_links(classes, dim, cfg), "vector-links", narrow=True)
    sizes = classes.select("cls", "size")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy("a").agg(F.sum("size").alias("more"))
    found = components(links.select("a", "b"))
    about = sizes.join(degree.withColumnRenamed("a", "cls"), "cls", "left").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    # Repeated ids with different vectors are links of one id: the least component, and the sum.
    each = member.distinct().join(about, "cls").groupBy("id").agg(F.sum("n_links").alias("n"), F.min("component_id").alias("c"))
    return alone.select(F.col(id_col).alias("id")).join(each, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def class_links(classes: DataFrame, dim: int, cfg: ItqConfig) -> DataFrame:
    """(a, b, cosine), a < b, of classes (cls, vec) with cosine of at least cfg.cosine."""
    spark = classes.sparkSession
    n = classes.count()
    share = min(1.0, cfg.sample / max(n, 1))
    picked = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vec").limit(2 * cfg.sample).toPandas()
    x = np.stack(picked["vec"].to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits = min(cfg.bits, dim)
    short, turns = plan(n, bits, cfg)
    rotations = [fit_rotation(x, bits, cfg.iterations, cfg.seed + i) for i in range(turns)]
    cuts = [(i, s, e) for i in range(turns) for s, e in _cuts(bits, short)]
    flip = np.arccos(cfg.cosine) / np.pi
    total = bits * turns
    radius = int(np.floor(total * flip + cfg.slack * np.sqrt(total * flip * (1 - flip))))
    words = -(-total // 63)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(1), dim)
            y = y / np.abs(y).max(1, keepdims=True)
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            every = np.concatenate([codes(y, r) for r in rotations], axis=1)
            keys = [(every[:, i * bits + s : i * bits + e] @ (1 << np.arange(e - s, dtype=np.int64))) for i, s, e in cuts]
            code_words = [every[:, w * 63 : (w + 1) * 63] @ (1 << np.arange(every[:, w * 63 : (w + 1) * 63].shape[1], dtype=np.int64)) for w in range(words)]
            flat = lambda cols: pa.ListArray.from_arrays(np.arange(0, len(cols) * len(y) + 1, len(cols), dtype=np.int32), pa.array(np.stack(cols, 1).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat(keys), flat(code_words)], names=["cls", "keys", "code"])

    kind = classes.schema["cls"].dataType.simpleString()
    coded = stage(classes.select("cls", "vec").mapInArrow(by_slices(code, 4096), f"cls {kind}, keys array<long>, code array<long>"), "codes")
    table = coded.select("cls", "code", F.posexplode("keys").alias("t", "key"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(short)])
    probe = table.select(F.col("cls").alias("a"), F.col("code").alias("ca"), "t", "key").withColumn("key", F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))))
    near = sum((F.bit_count(F.col("ca")[w].bitwiseXOR(F.col("cb")[w])) for w in range(words)), F.lit(0)) <= radius
    met = probe.join(table.select(F.col("cls").alias("b"), F.col("code").alias("cb"), "t", "key"), ["t", "key"]).where("a < b").where(near).select("a", "b").distinct()
    vec = classes.select("cls", "vec")
    pairs = met.join(vec.select(F.col("cls").alias("b"), F.col("vec").alias("vb")), "b").join(vec.select(F.col("cls").alias("a"), F.col("vec").alias("va")), "a").select("a", "b", "va", "vb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            va, vb = (_matrix(batch.column(i), dim) for i in (2, 3))
            va, vb = (v / np.abs(v).max(1, keepdims=True) for v in (va, vb))  # no overflow or underflow
            cosine = np.einsum("ij,ij->i", va, vb) / (np.linalg.norm(va, axis=1) * np.linalg.norm(vb, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"]).filter(pa.array(cosine >= cfg.cosine))

    result = pairs.mapInArrow(by_slices(rerank, 4096), f"a {kind}, b {kind}, cosine double")
    return result
