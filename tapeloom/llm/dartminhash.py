"""Near-duplicate documents by DartMinHash signatures and a banded join (operator 6).

Darts are thrown at the plane of (weight, rank) of every element as a Poisson process of
rate one, in strips of weight [0,1), [1,2), [2,4), ... A dart lies under a weighted set if
its weight is below the element's. Each dart also falls in one of k coordinates; a set's
coordinate keeps the earliest dart (Christiani, "DartMinHash: Fast Sketching for Weighted
Sets", 2020). Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity. Only about k ln k darts per set are thrown, whatever its size: darts come in
order of rank and stop at a rank at which all coordinates are likely hit; a set with an
empty coordinate is thrown again up to twice that rank, which never changes earlier darts.

Shingles weigh as often as they occur. Texts that repeat some are also signed with each shingle
once, and meet others in either way; for texts without repeats both signatures are the same.

Pipeline: one pass signs every whole text; equal word sequences collapse to the smallest
doc_id; representatives meet in bands; within a band each member is paired with the
smallest member, and pairs are checked exactly on the texts. Where the members of a bucket are
not of one component of the links then, all that are of different components and may be near are
paired. In buckets beyond a size that takes rounds: some members, by hash, are pivots, are paired with the
others and leave; components are made anew, and each round has many times as many pivots. This ends
when every two members of a bucket have been compared, can't be near, or are of one component; components
of the links are the classes. Whether two may be near is told by their lengths and by an odd sketch, the
parities of a text's shingles hashed to 1024 bits (Mitzenmacher, Pagh and Pham, "Efficient Estimation
for High Similarities using Odd Sketches", 2014): two sketches differ in no more bits than the sets
have shingles that only one of them holds, so no near pair is ruled out, and of the others
nearly all are, up to about 1,500 shingles.

The measure: shingles as sets, whose Jaccard similarity must reach the bound, or counted as often
as they occur, if the sets are also `least_set` similar: one line that two texts repeat very
often does not make them copies.

Defined cases: a null text is an empty one; a text without words is in a class of its own;
a text of one to four words is one shingle of all its words; a null doc_id is kept with a
null class; repeated rows share a class; columns beside the id and the text are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .runtime import by_slices, spread, stage
from .words import grams, hash_words, mix

SKETCH_BITS = 1024
_U32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class DartConfig:
    words: int = 5
    similarity: float = 0.8
    bands: int = 25
    rows: int = 5
    slack: float = 2.0  # darts thrown at first: k (ln k + slack)
    least_set: float = 0.6  # of the sets of shingles, for a link by counted shingles
    whole: int = 2048  # members of a bucket that are all compared at once
    pivots: int = 256  # of a larger bucket in the first round
    growth: int = 16

    @property
    def k(self) -> int:
        return self.bands * self.rows


def throw(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_sets: int, k: int, slack: float = 2.0) -> np.ndarray:
    """Signatures of weighted sets: (n_sets, k) uint64, zero throughout for an empty set.

    owner: the set of each element (0 to n_sets - 1); element: its hash, once per set; weight: positive.
    """
    ids = np.zeros((n_sets, k), np.uint64)
    if not len(element):
        return ids
    total = np.bincount(owner, weight, n_sets)
    reach = np.zeros(n_sets)
    np.divide(k * (np.log(k) + slack), total, out=reach, where=total > 0)
    todo = total > 0
    while True:
        rank, dart = _earliest(owner, element, weight, reach, n_sets, k)
        done = todo & np.isfinite(rank).all(1)
        ids[done] = dart[done]
        todo &= ~done
        if not todo.any():
            return ids
        reach *= 2
        here = todo[owner]
        owner, element, weight = owner[here], element[here], weight[here]


def _earliest(owner, element, weight, reach, n_sets, k) -> tuple[np.ndarray, np.ndarray]:
    rank = np.full(n_sets * k, np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low, width, level = 0.0, 1.0, 0
    while True:
        here = weight > low
        if not here.any():
            break
        own, x, limit = owner[here], weight[here], reach[owner[here]]
        seed = mix(element[here] + np.uint64(level * 0xA24BAED4963EE407 % 2**64))
        at = np.zeros(len(own))
        n = 0
        while len(own):
            n += 1
            u = mix(seed + np.uint64(n * 0x9FB21C651E98DF25 % 2**64))
            at = at - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / width
            live = at < limit
            own, x, limit, seed, at, u = own[live], x[live], limit[live], seed[live], at[live], u[live]
            h = mix(u ^ np.uint64(0x6A09E667F3BCC909))
            hit = low + width * ((h & _LOW32).astype(np.float64) * 2.0**-32) < x
            place = own[hit] * k + (((h[hit] >> _U32) * np.uint64(k)) >> _U32).astype(np.int64)
            found.append((place, at[hit], h[hit] | np.uint64(1)))
            np.minimum.at(rank, place, at[hit])
        low, width, level = low + width, (width if level == 0 else width * 2), level + 1
    ids = np.zeros(n_sets * k, np.uint64)
    for place, at, h in found:
        first = at == rank[place]
        ids[place[first]] = h[first]
    return rank.reshape(n_sets, k), ids.reshape(n_sets, k)


def weighted_shingles(hashes: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, count) of texts given by their word hashes; a short text is one shingle of all its words."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    owner, shingle = [], []
    if len(hashes) >= words:
        every = grams(hashes, words)
        of = np.repeat(np.arange(n), length)
        inside = of[: len(every)] == of[words - 1 :]
        owner.append(of[: len(every)][inside])
        shingle.append(every[inside])
    for i in np.flatnonzero((length > 0) & (length < words)):
        owner.append(np.array([i]))
        shingle.append(grams(hashes[offsets[i] : offsets[i + 1]], int(length[i])))
    if not owner:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    own, sh = np.concatenate(owner), np.concatenate(shingle)
    order = np.lexsort((sh, own))
    own, sh = own[order], sh[order]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (sh[1:] != sh[:-1])))
    first = np.flatnonzero(new)
    return own[first], sh[first], np.diff(np.append(first, len(own))).astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; each side has sorted shingles and their counts."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (total - both))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(_as_long(x.ravel())))


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bands(ids: np.ndarray, salt: np.ndarray, cfg: DartConfig) -> np.ndarray:
    """The hash of each band of signatures."""
    ids = ids.reshape(len(ids), cfg.bands, cfg.rows)
    band = np.broadcast_to(salt, (len(ids), cfg.bands)).copy()
    for r in range(cfg.rows):
        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + ids[:, :, r])
    return band


def _odd_sketch(owner: np.ndarray, element: np.ndarray, n_sets: int) -> np.ndarray:
    """(n_sets, 16) words: of each set the parity of its elements by hash."""
    cell = owner * SKETCH_BITS + (mix(element) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    odd = np.bincount(cell, minlength=n_sets * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(n_sets, -1)


def sign(docs: DataFrame, id_col: str, text_col: str, cfg: DartConfig) -> DataFrame:
    """One row per document: its id, digest of the word sequence (d0, d1), words, different shingles, band hashes, sketch of the set of shingles, and that of the shingles as often as they occur, null if none repeats."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, cfg.bands + 1, dtype=np.uint64))
        for batch in batches:
            for rows, hashes, offsets in hash_words(batch.column(1).to_pylist()):
                n = len(rows)
                own, sh, w = weighted_shingles(hashes, offsets, cfg.words)
                band = _bands(throw(own, sh, w, n, cfg.k, cfg.slack), salt, cfg)
                length = np.diff(offsets)
                shown = np.repeat((length > 0)[:, None], cfg.bands, axis=1)
                # Texts with repeated shingles also get the bands of their set of shingles; other texts have no other bands.
                often = np.unique(own[w > 1])
                if len(often):
                    here = np.isin(own, often)
                    ids = throw(np.searchsorted(often, own[here]), sh[here], np.ones(int(here.sum())), len(often), cfg.k, cfg.slack)
                    more = np.zeros_like(band)
                    more[often] = _bands(ids, salt, cfg)
                    new = np.zeros_like(shown)
                    new[often] = more[often] != band[often]
                    band, shown = np.concatenate((band, more), axis=1), np.concatenate((shown, new), axis=1)
                digest = np.zeros((n, 2), np.uint64)
                for c, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
                    power = np.cumprod(np.full(int(length.max(initial=0)) + 1, base, np.uint64))
                    for i in range(n):
                        digest[i, c] = (hashes[offsets[i] : offsets[i + 1]] * power[: length[i]]).sum(dtype=np.uint64)
                digest = mix(digest)
                ends = pa.array(np.concatenate(([0], np.cumsum(shown.sum(1)))).astype(np.int32))
                bands = pa.ListArray.from_arrays(ends, pa.array(_as_long(band[shown])))
                counted = pa.nulls(n, pa.list_(pa.int64()))
                if len(often):
                    times = w.astype(np.int64)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    each = np.repeat(sh, times) + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                    counted = pa.array([x if k else None for k, x in zip(np.isin(np.arange(n), often), _as_long(_odd_sketch(np.repeat(own, times), each, n)), strict=True)], pa.list_(pa.int64()))
                distinct = pa.array(np.bincount(own, minlength=n).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), pa.array(_as_long(digest[:, 0].copy())), pa.array(_as_long(digest[:, 1].copy())), pa.array(length.astype(np.int64)), distinct, bands, _lists(_odd_sketch(own, sh, n)), counted], names=["doc", "d0", "d1", "n", "u", "band", "once", "often"])

    return spread(docs.select(F.col(id_col), F.col(text_col).cast("string"))).mapInArrow(by_slices(run, 128), f"doc {kind}, d0 long, d1 long, n long, u long, band array<long>, once array<long>, often array<long>")


def buckets(reps: DataFrame) -> DataFrame:
    """(key, doc, n, u, least, m) of the members of each bucket in which at least two representatives met."""
    rows = reps.select("doc", "n", "u", F.explode("band").alias("key"))
    met = rows.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("m")).where("m > 1")
    return rows.join(met, "key").select("key", "doc", "n", "u", "least", "m")


def _may_link(cfg: DartConfig) -> Column:
    """Whether the lengths and sketches of p and q, (n, u, once, often), allow a link. It never rules one out."""
    near = lambda x, y, s: F.least(x, y) >= F.greatest(x, y) * s - 1e-6
    total = lambda side: F.greatest(F.col(f"{side}.n") - (cfg.words - 1), F.lit(1))
    apart = lambda x, y: reduce(Column.__add__, [F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(SKETCH_BITS // 64)])
    # Of two sets of similarity J at most (1 - J) / (1 + J) of the sum of their sizes is in one of them alone.
    most = lambda s, x, y: (x + y) * ((1 - s) / (1 + s)) + 1e-6
    u, v, once = F.col("p.u"), F.col("q.u"), apart(F.col("p.once"), F.col("q.once"))
    often = apart(F.coalesce("p.often", "p.once"), F.coalesce("q.often", "q.once"))
    repeats = F.col("p.often").isNotNull() | F.col("q.often").isNotNull()
    by_set = near(u, v, cfg.similarity) & (once <= most(cfg.similarity, u, v))
    counted = repeats & near(total("p"), total("q"), cfg.similarity) & near(u, v, cfg.least_set) & (once <= most(cfg.least_set, u, v)) & (often <= most(cfg.similarity, total("p"), total("q")))
    return by_set | counted


def link(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, cfg: DartConfig, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component) by the links among representatives that met in a band, and by the pairs of more; and those links, (a, b) with a < b."""
    members = stage(buckets(reps), "band", narrow=True)
    first = stage(members.select(F.col("least").alias("a"), F.col("doc").alias("b")).where("a < b").distinct(), "pairs", narrow=True)
    links = stage(verify(first, docs, id_col, text_col, cfg), "links", narrow=True)
    found = stage(components(links.union(more)), "components", narrow=True)
    about = reps.select("doc", "n", "u", "once", "often")
    left = members.where("m > 2 and doc != least").select("key", "doc")
    width = cfg.pivots
    while True:
        now = stage(left.join(found, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("c")), "placed", narrow=True)
        mixed = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("key", "m")
        rest = stage(now.join(mixed, "key"), "unlinked", narrow=True)
        if not rest.take(1):
            return found, links
        known = rest.join(about, "doc")
        side = lambda df, name: df.select("key", F.struct("doc", "n", "u", "once", "often", "c").alias(name))
        small, large = known.where(F.col("m") <= cfg.whole), rest.where(F.col("m") > cfg.whole)
        near = side(small, "q").join(side(small, "p"), "key").where(F.col("p.doc") < F.col("q.doc"))
        is_large = bool(large.take(1))
        if is_large:
            slots = large.withColumn("slot", F.pmod(F.xxhash64("doc", F.lit(width)), F.lit(width)))
            pivots = stage(slots.groupBy("key", "slot").agg(F.max(F.struct(F.xxhash64("doc", "key").alias("h"), "doc")).alias("p")).select("key", F.col("p.doc").alias("doc")), "pivots", narrow=True)
            big = known.where(F.col("m") > cfg.whole)
            near = near.union(side(big, "q").join(side(big.join(pivots, ["key", "doc"]), "p"), "key"))
        near = near.where(F.col("p.c") != F.col("q.c")).where(_may_link(cfg))
        pairs = stage(near.select(F.least("p.doc", "q.doc").alias("a"), F.greatest("p.doc", "q.doc").alias("b")).distinct(), "pairs", narrow=True)
        if pairs.take(1):
            new = stage(verify(pairs, docs, id_col, text_col, cfg), "links", narrow=True)
            links = links.union(new)
            joined = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)
            found = stage(components(joined), "components", narrow=True)
        if not is_large:
            return found, links
        left = large.join(pivots, ["key", "doc"], "left_anti").select("key", "doc")
        width *= cfg.growth


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, cfg: DartConfig) -> DataFrame:
    """The pairs of a staged table that are near by the measure above, from the whole texts."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    texts = bloom.maybe_in(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null"), "doc", bloom.build(ids, "doc", n_keys=2 * pairs.count()))
    both = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sides = []
                for t in (ta, tb):
                    if t not in seen:
                        if len(seen) >= 256:
                            seen.clear()
                        parts = [h for _, h, _ in hash_words([t])]
                        h = parts[0] if parts else np.empty(0, np.uint64)
                        _, sh, w = weighted_shingles(h, np.array([0, len(h)]), cfg.words)
                        seen[t] = sh, w
                    sides.append(seen[t])
                once = weighted_jaccard(*((sh, np.ones(len(sh))) for sh, _ in sides))
                keep.append(once >= cfg.similarity or once >= cfg.least_set and weighted_jaccard(*sides) >= cfg.similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(by_slices(run, 256), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: DartConfig = DartConfig(), links: bool = False) -> DataFrame:
    """(id, exact_id, class_id, kept) for every row of docs, and linked_to if links are asked for.

    exact_id: least id with the same words in the same order; class_id: least id reachable by links
    of at least cfg.similarity; kept: whether it is the one of its class that stays (of repeated rows, all).
    linked_to: for the one of each exact_id, in order, the smaller exact_ids whose texts were compared with its own and are near;
    for copies, and where there are none, an empty list. These pairs and exact_id connect every class. Pairs of texts
    that are of one class by other links already are not compared, so the list is no count of all near texts.
    """
    signed = stage(sign(docs, id_col, text_col, cfg), "signed")
    wordy = signed.where("doc is not null and n > 0")
    # Only digests that repeat are joined, from a table of their own: a digest of very many copies can then be split over tasks.
    least = stage(wordy.groupBy("d0", "d1", "n").agg(F.min("doc").alias("exact"), F.count("*").alias("m")).where("m > 1").drop("m"), "copied", narrow=True)
    known = stage(wordy.join(least, ["d0", "d1", "n"], "left").withColumn("exact", F.coalesce("exact", "doc")).select("doc", "exact", "n", "u", *[F.when(F.col("doc") == F.col("exact"), F.col(c)).alias(c) for c in ("band", "once", "often")]), "exact", narrow=True)
    # An id that is repeated with other words links the classes of both texts.
    repeated = known.groupBy("doc").agg(F.min("exact").alias("a"), F.max("exact").alias("b")).where("a != b").select("a", "b")
    found, near = link(known.where("doc = exact").select("doc", "n", "u", "band", "once", "often"), docs, id_col, text_col, cfg, repeated)
    classes = known.groupBy("doc").agg(F.min("exact").alias("exact")).join(found.withColumnRenamed("node", "exact"), "exact", "left").select("doc", "exact", F.coalesce("component", "exact").alias("class"))
    out = [F.col("doc").alias(id_col), F.coalesce("exact", "doc").alias("exact_id"), F.coalesce("class", "doc").alias("class_id")]
    if links:
        kind = f"array<{docs.schema[id_col].dataType.simpleString()}>"
        classes = classes.join(near.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("smaller")), F.col("doc") == F.col("b"), "left")
        out.append(F.coalesce(F.when(F.col("doc") == F.col("exact"), F.col("smaller")), F.array().cast(kind)).alias("linked_to"))
    return (
        signed.select("doc")
        .join(classes, "doc", "left")
        .select(*out)
        .withColumn("kept", F.coalesce(F.col("class_id") == F.col(id_col), F.lit(True)))
    )
