"""Quality classifier (operator 3): random Fourier features of document statistics, ridge, isotonic calibration.

One pass computes statistics of every whole text. Random Fourier features approximate a
Gaussian kernel over them (Rahimi and Recht, 2007). Each partition of labelled rows sums its
part of the normal equations; the sums, of a size fixed by the number of features, are solved
for ridge scores on the driver. Raw scores of labelled rows kept out of the fit are counted in
fixed bins and made a monotone probability by pooling adjacent violators.

Labels, language, source and id are never inputs of a score; the id only decides the fold.

Defined cases: a null text is scored as the empty one; a document with several labels counts as
bad if any is; null labels and labels of unknown documents are not learned from; without
labels every score is 0.5; null ids are kept, are never learned from and are not held out;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .runtime import by_slices, crc_mod5, spread, stage

STATS = ("chars", "words", "word_len", "upper", "digit", "bang", "symbol", "bar", "other_punct", "space", "newline", "non_ascii", "distinct_words", "distinct_lines", "entropy", "wordless", "upper_words", "marked_words", "line_len", "long_words", "vowels", "repeat_word", "markup")
_CLASS = {name: np.zeros(256, bool) for name in ("upper", "digit", "symbol", "punct", "space")}
_CLASS["upper"][65:91] = True
_CLASS["digit"][48:58] = True
_CLASS["symbol"][[ord(c) for c in "#$%&*@^~+=_"]] = True
_CLASS["punct"][[ord(c) for c in ".,;:?'\"()-/"]] = True
_CLASS["space"][[32, 9, 10, 13]] = True
_MARKED = re.compile(r"[^\w\s][^\w\s]+(?=\s|$)")


def stats(text: str) -> list[float]:
    """The statistics of one text, in the order of STATS."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(np.float64)
    n = max(float(hist.sum()), 1.0)
    words = text.split()
    k = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    share = hist[hist > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    repeats = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.sum()) / k,
        *(hist[_CLASS["upper"]].sum() / n, hist[_CLASS["digit"]].sum() / n, hist[33] / n * 10, hist[_CLASS["symbol"]].sum() / n * 5, hist[124] / n * 10, hist[_CLASS["punct"]].sum() / n, hist[_CLASS["space"]].sum() / n, hist[10] / n * 10, hist[128:].sum() / n),
        len(set(words)) / k, len(set(lines)) / max(len(lines), 1), float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
        1.0 - sum(map(str.isalpha, words)) / k, sum(map(str.isupper, words)) / k, len(_MARKED.findall(text)) / k, np.log1p(len(text) / max(len(lines), 1)),
        float((lengths > 12).sum()) / k, hist[[97, 101, 105, 111, 117]].sum() / n, repeats / k, (hist[60] + hist[62] + hist[123] + hist[125]) / n * 10,
    ]


@dataclass(frozen=True)
class QualityConfig:
    features: int = 256
    width: float = 4.0  # of the Gaussian kernel, in standard deviations of the statistics
    ridge: float = 1e-3  # times the number of rows
    bins: int = 1000
    sample: int = 500_000  # labelled rows learned from, at most about so many, chosen by a hash of their ids
    threshold: float = 0.3
    seed: int = 5


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw scores at which the calibrated score is given
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        f = np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.omega + self.phase)
        return np.concatenate([f, 0.1 * z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: a rising share of ones for each bin."""
    blocks: list[list[float]] = []
    for n, y in zip(counts, ones, strict=True):
        blocks.append([n, y, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, y2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + y2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), y / n) for n, y, k in blocks]) if blocks else np.empty(0)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, stats array<double>) for every row; row tells repeated rows apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([stats(t or "") for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(STATS))
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(STATS), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["id", "stats"])

    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(by_slices(run, 256), f"id {kind}, stats array<double>")


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def fit(stat: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel | None:
    """stat: (id, stats) of all documents; labels: (id, y) with y 0 or 1, of rows that may be learned from."""
    d = len(STATS)
    bad = labels.where("id is not null and y is not null").groupBy("id").agg(F.min("y").cast("double").alias("y"))
    n = bad.count()
    if n > cfg.sample:
        bad = bad.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * cfg.sample / n))
    train = stage(stat.join(bad, "id").select("stats", "y", (F.pmod(F.crc32(F.concat(F.col("id").cast("string"), F.lit("/calibrate")).cast("binary")), F.lit(4)) == 0).alias("later")), "labelled")
    sums = train.agg(F.count("*").alias("n"), *[f(F.col("stats")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"]:
        return None
    rng = np.random.default_rng(cfg.seed)
    mean, scale = (np.array([sums[f"{k}{i}"] for i in range(d)]) for k in "ms")
    model = QualityModel(mean, np.where(scale > 1e-12, scale, 1.0), rng.standard_normal((d, cfg.features)) / cfg.width, rng.uniform(0, 2 * np.pi, cfg.features), np.zeros(0), np.zeros(0), np.zeros(0))
    size = cfg.features + d + 1

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.features(_stack(batch.column(0)))
            total += z.T @ np.concatenate([z, batch.column(1).to_numpy()[:, None]], axis=1)
        if total.any():
            keep = np.triu(np.ones(total.shape, bool))
            i, j = np.nonzero(keep)
            for at in range(0, len(i), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(i[at : at + 20_000].astype(np.int32)), pa.array(j[at : at + 20_000].astype(np.int32)), pa.array(total[keep][at : at + 20_000])], names=["i", "j", "v"])

    first = train.where("not later").select("stats", "y").coalesce(32)
    found = first.mapInArrow(normal_equations, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    a = np.zeros((size, size + 1))
    a[found["i"], found["j"]] = found["v"]
    gram = np.triu(a[:, :size]) + np.triu(a[:, :size], 1).T
    penalty = cfg.ridge * max(gram[-1, -1], 1.0) * np.eye(size)
    penalty[-1, -1] = 1e-9
    model = QualityModel(model.mean, model.scale, model.omega, model.phase, np.linalg.solve(gram + penalty, a[:, size]), np.zeros(0), np.zeros(0))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.floor(np.clip(model.raw(_stack(batch.column(0))) + 0.5, 0, 2) / 2 * cfg.bins).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(1)], names=["b", "y"])

    bins = train.where("later").select("stats", "y").mapInArrow(binned, "b long, y double").groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("b").toPandas()
    if bins.empty:
        edges, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    else:
        levels = isotonic(bins["n"].to_numpy(float), bins["y"].to_numpy(float))
        edges = (bins["b"].to_numpy() + 0.5) / cfg.bins * 2 - 0.5
    return QualityModel(model.mean, model.scale, model.omega, model.phase, model.weights, edges, levels)


def score_documents(stat: DataFrame, model: QualityModel | None) -> DataFrame:
    """(id, score) for each row of (id, stats)."""
    kind = stat.schema["id"].dataType.simpleString()
    if model is None:
        return stat.select("id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_stack(batch.column(1))))], names=["id", "score"])

    return stat.select("id", "stats").mapInArrow(run, f"id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs. Labels of fold 0 are never learned from."""
    stat = stage(document_stats(docs, id_col, text_col), "stats")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(crc_mod5(F.col("id")) != 0)
    scored = score_documents(stat, fit(stat, known, cfg))
    return scored.select(F.col("id").alias(id_col), F.coalesce(crc_mod5(F.col("id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cfg.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """docs without those whose score is below cfg.threshold.

    Statistics are first taken of labelled documents alone; each text is then judged where it is
    read, so no text is shuffled for the decision.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(crc_mod5(F.col("id")) != 0)
    bits = bloom.build(known.select("id").distinct(), "id")
    model = fit(document_stats(bloom.maybe_in(docs.select(id_col, text_col).where(F.col(id_col).isNotNull()), id_col, bits), id_col, text_col), known, cfg)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([stats(t or "") for t in batch.column(text_col).to_pylist()], np.float64).reshape(-1, len(STATS))
            yield batch.filter(pa.array(model.score(x) >= cfg.threshold))

    return docs.mapInArrow(by_slices(run, 256), docs.schema)
