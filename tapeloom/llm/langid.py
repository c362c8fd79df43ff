"""Language ID by inference of multilingual mixtures (operator 7).

Each language has a model of byte trigrams within words, hashed into a fixed number of cells,
with smoothing. A text is a mixture: every word has one language, and its likelihood under a
language is that of its trigrams. Expectation-maximisation over the words of the whole text
estimates the proportions; nested sets of the strongest languages are refitted, and the set of
best likelihood less a penalty for each language (half the log of the number of words, times a
weight) is selected. The prediction is the set's largest language, the score its proportion there.

Memory is bounded by a text's different words, not by its length: texts beyond a chunk are read piece
by piece, and equal words are one row with a weight.

Models are counted from a bounded sample of the documents with a known language outside fold 0;
language, source and id are never inputs of a prediction.

Defined cases: a null text and a text without a letter are `und` with score 0; a text whose letters
give no word gets the most frequent language; a word of more than a chunk is cut; null languages are not
learned from; without any every text is `und`; null ids are kept, never learned from and not held out; ties go to the
language first in order; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import by_slices, crc_mod5, spread
from .words import CHUNK_BYTES, mix, normal

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"\s")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(97, 123), *range(128, 256)]] = True
CELLS = 1 << 15


@dataclass(frozen=True)
class LangConfig:
    sample: int = 20_000  # documents learned from, about so many, chosen by a hash of their ids
    smoothing: float = 0.5
    rounds: int = 8
    largest_set: int = 3
    penalty: float = 4.0


@dataclass(frozen=True)
class LangModel:
    languages: list[str]
    logs: np.ndarray  # cells x languages
    prior: np.ndarray


def pieces(text: str) -> list[str]:
    """A text cut at white space into parts of about a chunk; a word of more than a chunk is cut too."""
    if len(text) <= CHUNK_BYTES:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + CHUNK_BYTES
        space = _SPACE.search(text, end, end + CHUNK_BYTES)
        end = space.start() if space else end
        out.append(text[at:end])
        at = end
    return out


def _trigrams(texts: list[str]) -> Iterator[tuple[range, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the cell of each trigram, the first trigram of each word, and the first word of each text."""
    i = 0
    while i < len(texts):
        parts, size, j = [], 0, i
        while j < len(texts) and (j == i or size < CHUNK_BYTES // 2):
            parts.append(normal(texts[j] or ""))
            size += len(parts[-1]) + 1
            j += 1
        raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
        inside = _IN_WORD[raw]
        seen = np.where(inside, raw, 32).astype(np.uint32)
        at = np.flatnonzero(inside)
        code = (seen[at - 1] << np.uint32(16)) | (seen[at] << np.uint32(8)) | seen[at + 1]
        cell = ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1))) if len(at) else np.empty(0, np.int64)
        ends = np.cumsum([len(p) + 1 for p in parts]) + 1
        yield range(i, j), cell, first, np.concatenate(([0], np.searchsorted(at[first], ends)))
        i = j


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cfg: LangConfig = LangConfig()) -> LangModel | None:
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod5(F.col("id")) != 0))
    n = known.select("id").count()
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, cfg.sample / max(n, 1))) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            parts = [(lang, i == 0, p) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, p in enumerate(pieces(t))]
            for rows, cell, first, offsets in _trigrams([p for *_, p in parts]):
                ends = np.append(first, len(cell))[offsets]
                for k, row in enumerate(rows):
                    lang, begins, _ = parts[row]
                    own = counts.setdefault(lang, np.zeros(CELLS, np.int64))
                    own += np.bincount(cell[ends[k] : ends[k + 1]], minlength=CELLS)
                    texts[lang] = texts.get(lang, 0) + begins
        for lang, c in counts.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(k) + 1)), pa.array(np.append(k, -1)), pa.array(np.append(c[k], texts[lang]))], names=["lang", "cell", "n"])

    rows = picked.select("lang", "text").mapInArrow(by_slices(run, 256), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    if not languages:
        return None
    counts, prior = np.zeros((CELLS, len(languages))), np.zeros(len(languages))
    for lang, cell, m in rows.itertuples(index=False):
        if cell < 0:
            prior[languages.index(lang)] = m
        else:
            counts[cell, languages.index(lang)] = m
    share = (counts + cfg.smoothing) / (counts.sum(0) + cfg.smoothing * CELLS)
    return LangModel(languages, np.log(share).astype(np.float32), prior)


def _mixture(p: np.ndarray, weight: np.ndarray, owner: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log-likelihoods (up to each text's constant) under the allowed languages.

    p: likelihoods (words x languages) up to a factor by word; weight: how often a word occurs.
    """
    pi = allowed / allowed.sum(1, keepdims=True)
    count = np.add.reduceat(weight, starts)[:, None]
    for _ in range(rounds):
        q = p * pi[owner]
        q *= (weight / np.maximum(q.sum(1), 1e-300))[:, None]
        pi = np.add.reduceat(q, starts, axis=0) / count
    return pi, np.add.reduceat(weight * np.log(np.maximum((p * pi[owner]).sum(1), 1e-300)), starts)


def _select(logs: np.ndarray, weight: np.ndarray, owner: np.ndarray, starts: np.ndarray, cfg: LangConfig) -> np.ndarray:
    """Proportions (texts x languages) in the selected set of each text, 0 outside it; logs: log-likelihoods of words."""
    n_lang = logs.shape[1]
    p = np.exp(logs - logs.max(1, keepdims=True))
    count = np.add.reduceat(weight, starts)
    full, _ = _mixture(p, weight, owner, starts, np.ones((len(starts), n_lang)), cfg.rounds)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = np.full(len(starts), -np.inf), np.zeros((len(starts), n_lang))
    for k in range(1, min(cfg.largest_set, n_lang) + 1):
        pi, fit_ = _mixture(p, weight, owner, starts, (rank < k) * np.maximum(full, 1e-6), cfg.rounds // 2 if k > 1 else 0)
        value = fit_ - cfg.penalty * 0.5 * k * np.log(count + 1)
        better = value > best
        best[better], chosen[better] = value[better], pi[better]
    return chosen


def _long_text(model: LangModel, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihoods and weights of the different words of a long text, piece by piece."""
    keys, logs, weight = np.empty(0, np.uint64), np.empty((0, len(model.languages))), np.empty(0)
    for piece in pieces(text):
        for _, cell, first, _ in _trigrams([piece]):
            if not len(first):
                continue
            place = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
            own = np.add.reduceat(mix(cell.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32))), first)
            keys = np.concatenate((keys, own))
            keys, at, new = np.unique(keys, return_index=True, return_inverse=True)
            weight = np.bincount(new, np.concatenate((weight, np.ones(len(own)))), len(keys))
            logs = np.concatenate((logs, np.add.reduceat(model.logs[cell], first, axis=0).astype(np.float64)))[at]
    return logs, weight


def infer(model: LangModel, texts: list[str], cfg: LangConfig = LangConfig()) -> list[tuple[list[tuple[str, float]], str, float]]:
    """For each text its selected languages with proportions, the prediction and its score."""
    shares: dict[int, np.ndarray] = {}
    long = [i for i, t in enumerate(texts) if t and len(t) > CHUNK_BYTES]
    for i in long:
        logs, weight = _long_text(model, texts[i])
        if len(weight):
            shares[i] = _select(logs, weight, np.zeros(len(weight), np.int64), np.array([0]), cfg)[0]
    for rows, cell, first, offsets in _trigrams(["" if t is None or len(t) > CHUNK_BYTES else t for t in texts]):
        have = np.flatnonzero(np.diff(offsets) > 0)
        if len(have):
            logs = np.add.reduceat(model.logs[cell], first, axis=0).astype(np.float64)
            owner = np.repeat(np.arange(len(have)), np.diff(offsets)[have])
            shares |= zip((have + rows.start).tolist(), _select(logs, np.ones(len(logs)), owner, offsets[:-1][have], cfg), strict=True)
    out = []
    common = model.languages[int(model.prior.argmax())]
    for i, t in enumerate(texts):
        if not t or not _LETTER.search(t):
            out.append(([], "und", 0.0))
        elif i not in shares:
            out.append(([(common, 1.0)], common, float(model.prior.max() / model.prior.sum())))
        else:
            own = shares[i]
            top = int(own.argmax())
            out.append(([(model.languages[j], float(own[j])) for j in np.argsort(-own, kind="stable") if own[j] > 0], model.languages[top], float(min(1.0, own[top]))))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cfg: LangConfig = LangConfig()) -> DataFrame:
    """(id, held_out, lang_pred, score, langs, shares) for every row of docs."""
    model = fit(docs, id_col, text_col, lang_col, cfg)
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = infer(model, texts, cfg) if model else [([], "und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([[x for x, _ in f[0]] for f in found], pa.list_(pa.string())), pa.array([[x for _, x in f[0]] for f in found], pa.list_(pa.float64()))], names=["id", "lang_pred", "score", "langs", "shares"])

    got = rows.mapInArrow(by_slices(run, 256), f"id {kind}, lang_pred string, score double, langs array<string>, shares array<double>")
    return got.select(F.col("id").alias(id_col), F.coalesce(crc_mod5(F.col("id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs", "shares")
