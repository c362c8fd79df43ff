"""Benchmark decontamination (operator 5): rare n-gram seeds join texts to items, then Smith-Waterman alignment.

Item and text are aligned by words (match 2, mismatch and gap -1); the score is the best local
alignment over that of the whole item, and from a threshold on the text is contaminated.

What is sought are rare groups of three or four words. Two neighbouring words of an item are a pair; in a text
they may stand side by side or with one word between them. A seed is two pairs of an item that are at most
`reach` words apart, in the item and in the text. How many seeds a copy keeps follows from the threshold. Of an
item of L words let an alignment cover A, with y of them replaced or left out and i words inserted. It reaches
2 T L points only if 3 y + i <= 2 A - 2 T L. A replaced or missing word breaks two pairs, and it takes
two inserted words to break one, so m >= A - 1 - 2 y - i / 2 pairs are kept. From one kept pair to the
next it is no further, in the item and in the text, than the words of the item plus those inserted there; these m - 1
distances add up to A - 2 + i at most, so at most (A - 2 + i) / (reach + 1) of them are beyond the reach. With
a reach of five or more the least that remains is at A = L without insertions:
L - 2 - 4 (1 - T) L / 3 - (L - 2) / (reach + 1), the bound; at a threshold of a half and the reach of eight it is
positive from nine words on. An item's seeds are ranked by how often they occur in the corpus. With `agree`
different places asked for, the commonest can be left out, as many as the bound less `agree`: every copy that
reaches the threshold keeps that many of the rest. Items too short for the bound are sought by
single pairs, of which (4 T - 1) L / 3 - 1 are kept; those of three words also by the pair of
their ends, shorter ones by single words. So no copy is lost, whatever words an item is made of.

Plan: one pass counts the seeds in all texts; they are ranked in a window by item. A
second pass finds their places, through two bit tables of bounded size, of pairs and of seeds, and joins them to the
items by an equi-join on the seed, a row for each place and item. An alignment spans at most twice the item's
length of the text, so places are counted by blocks of that length, each with the next: what an aggregate holds of a block
are the item's places, however often the text repeats them. Blocks in which `agree` places of the item meet give
windows, joined where they overlap. Only the texts with windows
are read again, once for equal texts, and their windows are joined with the items' words and aligned.
The benchmark is a table throughout: nothing of it comes to the driver, whatever its size.

Defined cases: null and empty texts and items match nothing; repeated rows and null ids are kept as
rows of the result; equal item ids are separate items; empty tables give an empty result; columns beside
ids and texts are not read. Texts are held to be equal if two 64-bit hashes of them are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .probe import BitTable, Tally, bit_table
from .runtime import by_slices, spread, stage
from .words import grams, hash_words, mix

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of digests up to which contaminated texts are broadcast.
BROADCAST_BYTES = 16 << 20
_SLICE = 512
#: Pairs of a text that are put together with those behind them at a time.
_STEP = 1 << 15


@dataclass(frozen=True)
class DecontamConfig:
    threshold: float = 0.5  # at least a half: below it the bound on kept pairs says nothing
    agree: int = 3  # places of an item that must agree, where the bound allows
    reach: int = 8  # words from one pair of a seed to the other

    def __post_init__(self) -> None:
        if not 0.5 <= self.threshold <= 1 or self.agree < 1 or self.reach < 5:
            raise ValueError("threshold must be 0.5 to 1, agree 1 or more, and reach 5 or more")

    def kept(self, n: int) -> int:
        """Seeds that every copy of an item of n words keeps, at least."""
        if (twos := self.kept_twos(n)) > 0:
            return twos
        return 1 if n < 4 else max(math.ceil((4 * self.threshold - 1) / 3 * n - 1 - 1e-9), 1)

    def kept_twos(self, n: int) -> int:
        """Seeds of two pairs that are kept; none below 1."""
        return math.ceil(n - 2 - 4 * (1 - self.threshold) * n / 3 - (n - 2) / (self.reach + 1) - 1e-9)

    def agreeing(self, n: int) -> int:
        """How many places must agree."""
        return min(self.agree, self.kept(n))


def align(items: list[np.ndarray], windows: list[np.ndarray], cells: int = 1 << 21) -> np.ndarray:
    """Best local alignment score of each item with its window, over the score of the whole item."""
    out = np.zeros(len(items))
    order = np.argsort([-len(i) * len(w) for i, w in zip(items, windows, strict=True)], kind="stable")
    at = 0
    while at < len(order):
        wide = max(len(windows[order[at]]), 1)
        take = order[at : at + max(1, cells // (wide * 8))]
        width = max(len(windows[k]) for k in take)
        take = take[: max(1, cells // (max(width, 1) * 8))]
        at += len(take)
        a = np.full((len(take), max(len(items[k]) for k in take)), -1, np.int64)
        b = np.full((len(take), max(len(windows[k]) for k in take)), -2, np.int64)
        for r, k in enumerate(take):
            a[r, : len(items[k])], b[r, : len(windows[k])] = items[k], windows[k]
        ramp = np.arange(b.shape[1], dtype=np.int32) * -GAP
        h = np.zeros((len(take), b.shape[1] + 1), np.int32)
        best = np.zeros(len(take), np.int32)
        for i in range(a.shape[1]):
            score = np.where(a[:, i : i + 1] == b, MATCH, MISMATCH).astype(np.int32)
            row = np.maximum(np.maximum(h[:, :-1] + score, h[:, 1:] + GAP), 0)
            row = np.maximum.accumulate(row + ramp, axis=1) - ramp
            h[:, 1:] = row
            np.maximum(best, row.max(1, initial=0), out=best)
        out[take] = best / (MATCH * np.array([max(len(items[k]), 1) for k in take]))
    return out


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xD6E8FEB86659FD93) + second)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _twos(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _pairs(first, ~second)


def item_seeds(words: np.ndarray, cfg: DecontamConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All seeds that an item may have, the place of each, and what they are made of."""
    if len(words) < 3:
        single = grams(words, 1)
        return single, np.arange(len(words)), single
    pairs, places = _pairs(words[:-1], words[1:]), np.arange(len(words) - 1)
    if cfg.kept_twos(len(words)) > 0:
        apart = range(1, min(cfg.reach, len(pairs) - 1) + 1)
        return np.concatenate([_twos(pairs[:-g], pairs[g:]) for g in apart]), np.concatenate([places[:-g] for g in apart]), pairs
    if len(words) == 3:
        pairs, places = np.append(pairs, _pairs(words[:1], words[2:])), np.append(places, 2)
    return pairs, places, pairs


def read_items(benchmark: DataFrame, text_col: str, item_col: str, cfg: DecontamConfig) -> DataFrame:
    """(item, k, n, agree, most, words, seeds, places, parts) of the items that have words; k is a hash of the words, most how many seeds are sought."""
    kind = benchmark.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for some, hashes, offsets in hash_words(batch.column(1).to_pylist()):
                for i, lo, hi in zip(some, offsets[:-1], offsets[1:], strict=True):
                    if hi > lo:
                        w = hashes[lo:hi]
                        seeds, places, parts = item_seeds(w, cfg)
                        n = len(w)
                        agree = cfg.agreeing(n)
                        rows.append((i, int(grams(w, n).view(np.int64)[0]), n, agree, len(seeds) - (0 if n < 4 else cfg.kept(n) - agree), w.view(np.int64), seeds.view(np.int64), places, parts.view(np.int64)))
            longs = [pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3, 4)]
            lists = [pa.array([r[c] for r in rows], pa.list_(pa.int64())) for c in (5, 6, 7, 8)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *longs, *lists], names=["item", "k", "n", "agree", "most", "words", "seeds", "places", "parts"])

    return benchmark.select(F.col(item_col), F.col(text_col).cast("string")).mapInArrow(by_slices(run, _SLICE), f"item {kind}, k long, n long, agree long, most long, words array<long>, seeds array<long>, places array<long>, parts array<long>")


@dataclass(frozen=True)
class Sought:
    """What is looked for in a text."""

    parts: BitTable
    seeds: BitTable
    reach: int
    single: bool  # there are items of one or two words
    short: bool  # there are items whose seeds are not two pairs


def _new(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (place, key) once, by place."""
    order = np.lexsort((key, at))
    at, key = at[order], key[order]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])
    return at[first], key[first]


def _found(texts: list[str], sought: Sought) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, seed, place) of what may be seeds."""
    for rows, hashes, offsets in hash_words(texts):
        own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        parts = [(np.empty(0, np.int64), np.empty(0, np.uint64))]
        for gap in ((0, 1, 2) if sought.single else (1, 2)):
            if len(hashes) <= gap:
                continue
            key = grams(hashes, 1) if gap == 0 else _pairs(hashes[:-gap], hashes[gap:])
            at = sought.parts.find(key)
            if gap:
                at = at[own[at] == own[at + gap]]
            parts.append((at, key[at]))
        at, key = _new(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for lo in range(0, len(at), _STEP):
            here = np.arange(lo, min(lo + _STEP, len(at)))
            seeds = [(at[here], key[here])] if sought.short else []
            step = 0
            while len(here):  # those that have a next one within reach, and one after that
                step += 1
                here = here[here + step < len(at)]
                apart = at[here + step] - at[here]
                here, apart = here[apart <= sought.reach], apart[apart <= sought.reach]
                two = here[(apart > 0) & (own[at[here]] == own[at[here + step]])]
                seeds.append((at[two], _twos(key[two], key[two + step])))
            place, seed = (np.concatenate(x) for x in zip(*seeds, strict=True))
            hit = sought.seeds.find(seed)
            place, seed = _new(place[hit], seed[hit])
            yield own[place] + rows.start, seed, place - offsets[own[place]]


def corpus_counts(texts: DataFrame, sought: Sought) -> DataFrame:
    """(seed, f): how often what may be a seed occurs in all texts."""
    shared = texts.sparkSession.sparkContext.broadcast(sought)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, seed, _ in _found(batch.column(0).to_pylist(), shared.value):
                tally.add(seed, np.ones(len(seed)))
            if tally.full:
                yield told(tally)
        yield told(tally)

    def told(tally: Tally) -> pa.RecordBatch:
        seed, f = tally.take()
        return pa.RecordBatch.from_arrays([_long(seed), pa.array(f.astype(np.int64))], names=["seed", "f"])

    return texts.select("text").mapInArrow(by_slices(run, _SLICE), "seed long, f long").groupBy("seed").agg(F.sum("f").alias("f"))


def seed_places(texts: DataFrame, sought: Sought) -> DataFrame:
    """(d0, d1, seed, at) of the places of what may be seeds in different texts."""
    shared = texts.sparkSession.sparkContext.broadcast(sought)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, seed, at in _found(batch.column(0).to_pylist(), shared.value):
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), _long(seed), pa.array(at)], names=["d0", "d1", "seed", "at"])

    return texts.select("text", "d0", "d1").mapInArrow(by_slices(run, _SLICE), "d0 long, d1 long, seed long, at long").distinct()


def windows(hits: DataFrame) -> DataFrame:
    """(d0, d1, k, lo, hi) in words of the text, of hits (d0, d1, at, k, n, agree, places), places being those of the seed in the item.

    A hit at place p of the item tells that the alignment starts at most n words before at - p and ends less than 2 n after it.
    """
    block = F.expr("at div (2 * n)")
    both = hits.withColumn("block", F.explode(F.array(block, block - 1))).where("block >= 0")
    met = both.groupBy("d0", "d1", "k", "block").agg(F.first("n").alias("n"), F.first("agree").alias("agree"), F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("met"), F.min(F.expr("at - array_max(places)")).alias("lo"), F.max(F.expr("at - array_min(places)")).alias("hi"))
    found = met.where("met >= agree").select("d0", "d1", "k", F.greatest(F.col("lo") - F.col("n"), F.col("block") * 2 * F.col("n"), F.lit(0)).alias("lo"), F.least(F.col("hi") + 2 * F.col("n") + 1, (F.col("block") + 2) * 2 * F.col("n")).alias("hi"))
    each = Window.partitionBy("d0", "d1", "k").orderBy("lo", "hi")
    before = F.max("hi").over(each.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("d0", "d1", "k", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def cut(texts: DataFrame) -> DataFrame:
    """(d0, d1, k, window) of texts with their windows (text, d0, d1, spans array<struct<k, lo, hi>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3).to_pylist()
            for rows, hashes, offsets in hash_words(batch.column(0).to_pylist()):
                found = [(rows.start + i, s["k"], hashes[min(lo + s["lo"], hi) : min(lo + s["hi"], hi)].view(np.int64)) for i, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) for s in spans[rows.start + i]]
                at = pa.array([i for i, *_ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array([k for _, k, _ in found], pa.int64()), pa.array([w for *_, w in found], pa.list_(pa.int64()))], names=["d0", "d1", "k", "window"])

    return texts.select("text", "d0", "d1", "spans").mapInArrow(by_slices(run, 64), "d0 long, d1 long, k long, window array<long>")


def scored(pairs: DataFrame, cfg: DecontamConfig) -> DataFrame:
    """(d0, d1, k, score) of pairs (d0, d1, k, words, window) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[x.values.to_numpy() for x in batch.column(c)] for c in (3, 4)]
            score = align(*both)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(score)], names=["d0", "d1", "k", "score"]).filter(pa.array(score >= cfg.threshold))

    return pairs.select("d0", "d1", "k", "words", "window").mapInArrow(by_slices(run, _SLICE), "d0 long, d1 long, k long, score double")


def _digests(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def search(docs: DataFrame, items: DataFrame, text_col: str, cfg: DecontamConfig) -> DataFrame | None:
    """(d0, d1, k, score, n_windows) of the different texts and items aligned with at least the threshold; None if there are no items."""
    text = F.col(text_col).cast("string")
    d0, d1 = _digests(text)
    plain = docs.select(text.alias("text"), d0.alias("d0"), d1.alias("d1")).where("text is not null")
    texts = spread(plain)
    once = items.dropDuplicates(["k"])
    every = stage(once.select("k", "n", "agree", "most", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("k", "n", "agree", "most", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place")), "item-seeds", narrow=True)
    about = every.agg(F.count("*").alias("n"), F.min("n").alias("least")).first()
    if not about["n"]:
        return None
    parts = bit_table(once.select(F.explode("parts").alias("part")), "part", about["n"])
    look = lambda seeds: Sought(parts, bit_table(seeds, "seed", about["n"]), cfg.reach, about["least"] < 3, cfg.kept_twos(about["least"]) < 1)
    common = stage(corpus_counts(texts, look(every.select("seed"))), "seed-counts", narrow=True)
    rank = Window.partitionBy("k").orderBy(F.coalesce("f", F.lit(0)), "place", "seed")
    rarest = every.join(common, "seed", "left").withColumn("rank", F.row_number().over(rank)).where("rank <= most")
    seeds = stage(rarest.groupBy("seed", "k").agg(F.first("n").alias("n"), F.first("agree").alias("agree"), F.sort_array(F.collect_set("place")).alias("places")), "seeds", narrow=True)
    spans = stage(windows(seed_places(texts, look(seeds.select("seed"))).join(seeds, "seed")), "windows", narrow=True)
    wanted = spans.groupBy("d0", "d1").agg(F.collect_list(F.struct("k", "lo", "hi")).alias("spans"))
    again = bloom.maybe_in(plain, "d0", bloom.build(spans.select("d0").distinct(), "d0")).dropDuplicates(["d0", "d1"])
    pairs = cut(again.join(wanted, ["d0", "d1"])).join(items.dropDuplicates(["k"]).select("k", "words"), "k")
    return stage(scored(pairs, cfg).groupBy("d0", "d1", "k").agg(F.max("score").alias("score"), F.count("*").alias("n_windows")), "contaminated", narrow=True)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """(id, item, score, n_windows): for each text and item aligned with at least cfg.threshold the best score, and how many windows reach it."""
    items = stage(read_items(benchmark, text_col, item_col, cfg), "items", narrow=True)
    found = search(docs, items, text_col, cfg)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    if found is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {kind}, {item_col} {item_kind}, score double, n_windows long")
    d0, d1 = _digests(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("id"), d0.alias("d0"), d1.alias("d1"))
    named = found.join(items.select("k", "item"), "k")
    return rows.join(named, ["d0", "d1"]).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "n_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """docs without those that hold a benchmark item."""
    found = search(docs, stage(read_items(benchmark, text_col, item_col, cfg), "items", narrow=True), text_col, cfg)
    if found is None:
        return docs
    bad = stage(found.select(F.col("d0").alias("_bad0"), F.col("d1").alias("_bad1")).distinct(), "bad-texts", narrow=True)
    d0, d1 = _digests(F.col(text_col).cast("string"))
    side = F.broadcast(bad) if bad.count() * 16 <= BROADCAST_BYTES else bad
    return docs.join(side, (d0 == F.col("_bad0")) & (d1 == F.col("_bad1")), "left_anti")
