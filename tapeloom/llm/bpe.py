"""BPE encoding and decoding with a minimal acyclic transducer of frequent words (operator 4).

The words of the corpus are counted; the most frequent, with their ids as outputs, are compiled
into a minimal acyclic automaton that shares prefixes and suffixes. Each transition carries the
number of smaller words it skips, so a path numbers its word and the outputs stay in one array
(Lucchesi and Kowaltowski, 1993; Daciuk et al., 2000). The automaton is one file in the shared
folder, which Spark hands to each executor once; its workers memory-map that copy, so they share its pages, and look up
all new words of a batch at once. Words that are not in it are merged exactly, by rank.

No word holds white space, so texts are cut at ASCII white space first, by Arrow, and each different piece of a group of
texts is looked up once, and new ones are cut into words, all by one pattern match. A worker keeps the ids of the words that it used most, in
bounded memory, from task to task unless told not to; ids and decoded texts of all places of a group are gathered at once.

The lexicon only saves time: every word it lacks is merged, so results never depend on it. Each
task counts its texts with bounded memory (rarest words are let go when its table is full), and
the lexicon is bounded in words and bytes, so the broadcast has a fixed size.

It follows a tokenizers file of this kind: normaliser NFC, white space, lower case; words by the
file's pattern; byte-level symbols; an end-of-word suffix; added tokens cut from the raw text. Other
kinds of file are refused.

Defined cases: a null text is an empty one, which has no ids and decodes to an empty text; texts
and words of any length are encoded whole; repeated rows and null ids are kept; an empty table gives
an empty result; columns beside the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.normalizers import NFC

from .runtime import by_slices, put_file, spread, stage, unstage

# Words, and the breaks between pieces of text.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+|\n")
# Code points that are letters or numbers since later Unicode versions than the tokenizer's; to it they are neither.
_LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 "
    "10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 "
    "16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 "
    "1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
# Capitals of later versions than Python's own, with their small letters; the two runs are capitals at a fixed distance.
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LATER_CLASS = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in _LATER.split())
_NEWER = re.compile("[" + _LATER_CLASS + "".join(map(chr, _SMALL)) + "]")
#: Below it every text is in its composed form.
_COMPOSABLE = re.compile("[\u0300-\U0010ffff]")
_SPLIT_NEWER = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER_CLASS}]]+|[\p{{N}}--[{_LATER_CLASS}]]|[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{_LATER_CLASS}]]+|\n")
# The same below U+0300, where no later version of Unicode changes anything.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ˁˆ-ˑˠ-ˤˬˮ"
_SPLIT_LOW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0{_LETTERS}0-9²³¹¼-¾]+|\n")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable ones stand for themselves, the rest follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    tokens: list[str]
    first: list[int]  # the symbol of each byte
    last: list[int]  # and at the end of a word
    ranks: dict[int, int]  # of a pair of ids, the left one times 2^20
    made: list[int]  # what each merge makes
    added: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            t = json.load(f)
        m = t["model"]
        steps = [x["type"] for x in t["normalizer"]["normalizers"]]
        splits = t["pre_tokenizer"]["pretokenizers"]
        if m["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or splits[0]["pattern"].get("Regex") != _PATTERN or [x["type"] for x in splits] != ["Split", "ByteLevel"] or t["decoder"] or m["unk_token"] or m["ignore_merges"]:
            raise ValueError(f"{path} is not a tokenizer of the kind that this operator implements")
        merges = [tuple(x if isinstance(x, list) else x.split(" ")) for x in m["merges"]]
        added = {x["content"]: x["id"] for x in t["added_tokens"]}
        size = max([*m["vocab"].values(), *added.values()]) + 1
        tokens = [""] * size
        for token, i in [*m["vocab"].items(), *added.items()]:
            tokens[i] = token
        ids, suffix = m["vocab"], m["end_of_word_suffix"] or ""
        symbols = _byte_symbols()
        return cls(tokens, [ids[c] for c in symbols], [ids[c + suffix] for c in symbols], {ids[a] << 20 | ids[b]: i for i, (a, b) in enumerate(merges)}, [ids[a + b] for a, b in merges], added)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word by exact merging: of all neighbours the pair of least rank first, leftmost on ties."""
        if not word:
            return []
        parts = [self.first[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > 200:
            return self._merge_long(parts)
        rank = self.ranks.get
        ranks = [rank(a << 20 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (r := min(ranks)) != _NEVER:
            i = ranks.index(r)
            parts[i] = m = self.made[r]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | m, _NEVER)
            if i < len(ranks):
                ranks[i] = rank(m << 20 | parts[i + 1], _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap, for words of very many bytes."""
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = self.made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, as a file without a decoder asks for."""
        return " ".join(map(self.tokens.__getitem__, ids))


_NEVER = 1 << 40


#: A longer word is not kept by a worker.
KEPT_CHARS = 64


def normal(text: str) -> str:
    """A piece of a text without added tokens, normalised."""
    if text.isascii():
        return text.lower()
    if _COMPOSABLE.search(text):
        text = NFC().normalize_str(text)  # the library's own, as its character data is not Python's
        if _NEWER.search(text):
            text = text.translate(_SMALL)
    # Lower case by character: no special form of sigma at the end of a word.
    return text.replace("Σ", "σ").lower()


def cut(pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of normalised pieces without line feeds, those of pieces below U+0300 first; the order of the pieces in it; and how many words each has."""
    raw = np.frombuffer("\n".join(pieces).encode(), np.uint8)
    far = np.zeros(len(pieces), bool)
    far[np.searchsorted(np.flatnonzero(raw == 10), np.flatnonzero(raw >= 0xCC))] = True  # the first byte of U+0300 and beyond
    found: list[str] = []
    for some in (np.flatnonzero(~far), np.flatnonzero(far)):
        text = "".join([pieces[i] + "\n" for i in some.tolist()])
        split = _SPLIT_LOW if not _COMPOSABLE.search(text) else _SPLIT_NEWER if _NEWER.search(text) else _SPLIT
        found += split.findall(text)
    breaks = np.array([i for i, word in enumerate(found) if word == "\n"], np.int64)
    return [word for word in found if word != "\n"], np.argsort(far, kind="stable"), np.diff(breaks, prepend=-1) - 1


def groups(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    """The texts in runs of at most so many characters; a longer text is alone."""
    run, size = [], 0
    for text in texts:
        if run and size + len(text) > chars:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different pieces between ASCII white space, which of them each place holds, and the places before each text and after the last."""
    found = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = found.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), found.offsets.to_numpy()


class Lexicon:
    """A minimal acyclic automaton over bytes with numbered words, and their ids, in one memory-mappable block.

    Layout, little-endian: 8 int64 of sizes; slots of an open hash table of transitions (key
    uint64 = state * 256 + byte, plus one; target uint32; skip uint32); final flag by state;
    offsets of outputs; outputs (uint32 ids).
    """

    def __init__(self, block):
        head = np.frombuffer(block, "<i8", 8)
        self.slots, self.states, self.words, self.outputs = (int(x) for x in head[:4])
        at = 64
        take = lambda kind, n: (np.frombuffer(block, kind, n, at), at + -(-n * np.dtype(kind).itemsize // 8) * 8)
        self.key, at = take("<u8", self.slots)
        self.target, at = take("<u4", self.slots)
        self.skip, at = take("<u4", self.slots)
        self.final, at = take("<u1", self.states)
        self.offsets, at = take("<u4", self.words + 1)
        self.ids, at = take("<u4", self.outputs)

    @classmethod
    def compile(cls, entries: dict[bytes, list[int]]) -> bytes:
        words = sorted(w for w in entries if w)
        edges: list[list[tuple[int, int]]] = [[]]  # of each state on the current path or kept: (byte, state)
        final = [False]
        register: dict[tuple, int] = {}
        path = [0]
        last = b""

        def freeze(keep: int) -> None:
            """Replace what lies below depth keep on the current path by equal states seen before."""
            while len(path) - 1 > keep:
                state = path.pop()
                same = register.setdefault((final[state], tuple(edges[state])), state)
                if same != state:
                    edges[path[-1]][-1] = (edges[path[-1]][-1][0], same)

        for w in words:
            common = 0
            while common < min(len(w), len(last)) and w[common] == last[common]:
                common += 1
            freeze(common)
            for b in w[common:]:
                edges.append([])
                final.append(False)
                edges[path[-1]].append((b, len(edges) - 1))
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = w
        freeze(0)
        order, number, todo = [], {}, [0]
        while todo:  # number the states that are still reached
            s = todo.pop()
            if s not in number:
                number[s] = len(order)
                order.append(s)
                todo += [t for _, t in edges[s]]
        below: dict[int, int] = {}
        stack = [0]
        while stack:  # words below each state, children first
            s = stack[-1]
            lack = [t for _, t in edges[s] if t not in below]
            if lack:
                stack += lack
            else:
                below[s] = final[s] + sum(below[t] for _, t in edges[s])
                stack.pop()
        n_edges = sum(len(edges[s]) for s in order)
        slots = 1 << max(4, (2 * n_edges).bit_length())
        key, target, skip = np.zeros(slots, "<u8"), np.zeros(slots, "<u4"), np.zeros(slots, "<u4")
        for s in order:
            passed = int(final[s])
            for b, t in edges[s]:
                k = number[s] * 256 + b + 1
                at = cls._slot(k, slots)
                while key[at]:
                    at = (at + 1) & (slots - 1)
                key[at], target[at], skip[at] = k, number[t], passed
                passed += below[t]
        outputs = [entries[w] for w in words]
        parts = [np.array([slots, len(order), len(words), sum(map(len, outputs)), 0, 0, 0, 0], "<i8"), key, target, skip, np.array([final[s] for s in order], "<u1"), np.concatenate(([0], np.cumsum([len(o) for o in outputs]))).astype("<u4"), np.array([i for o in outputs for i in o], "<u4")]
        return b"".join(p.tobytes().ljust(-(-p.nbytes // 8) * 8, b"\0") for p in parts)

    @staticmethod
    def _slot(k: int, slots: int) -> int:
        return (k * 0x9E3779B97F4A7C15 % 2**64 >> 40) & (slots - 1)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it is not in the lexicon; all are walked together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not self.words:
            return out
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        raw = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero(length > 0)
        state, count = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        depth, mask = 0, np.uint64(self.slots - 1)
        while len(live):
            k = state[live] * np.uint64(256) + raw[start[live] + depth] + np.uint64(1)
            at = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & mask
            while True:
                seen = self.key[at]
                off = (seen != k) & (seen != 0)
                if not off.any():
                    break
                at = np.where(off, (at + np.uint64(1)) & mask, at)
            hit = seen == k
            live, at = live[hit], at[hit]
            state[live] = self.target[at]
            count[live] += self.skip[at]
            depth += 1
            ended = length[live] == depth
            done = live[ended]
            done = done[self.final[state[done].astype(np.int64)] == 1]
            out[done] = count[done]
            live = live[~ended]
        return out

    def output(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


def mapped(path: str) -> Lexicon:
    """The lexicon of a file, memory-mapped."""
    with open(path, "rb") as f:
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def publish(spark: SparkSession, block: bytes) -> str:
    """Write a lexicon to the shared folder and hand it to all executors, by the name that is returned."""
    name = f"lexicon-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(put_file(spark, name, block))
    return name


@dataclass(frozen=True)
class BpeConfig:
    lexicon: int = 131_072  # words
    word_bytes: int = 64  # of a word in the lexicon, at most
    counted: int = 150_000  # distinct words that a task counts at a time
    told: int = 65_536  # words that a task tells
    cached: int = 320_000  # words whose ids a worker keeps
    grouped: int = 1 << 21  # characters of texts that are encoded together; words of four times as many are counted together
    kept: bool = True  # whether a worker keeps those words from task to task, in memory that later work lacks


def count_words(docs: DataFrame, text_col: str, cfg: BpeConfig) -> DataFrame:
    """(word, n) of the frequent words of all texts; the counts of rare ones may be low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        texts = (normal(t) for batch in batches for t in batch.column(0).drop_null().to_pylist())
        for group in groups(texts, 4 * cfg.grouped):
            different, at, _ = pieces(group)
            words, order, each = cut(different)
            for word, n in zip(words, np.repeat(np.bincount(at, minlength=len(different))[order], each).tolist(), strict=True):
                if len(word) <= cfg.word_bytes:
                    seen[word] = seen.get(word, 0) + n
            if len(seen) > cfg.counted:
                least = np.partition(np.fromiter(seen.values(), np.int64), -(cfg.counted // 2))[-(cfg.counted // 2)]
                seen = Counter({w: n for w, n in seen.items() if n > least})
        top = [(w, n) for w, n in seen.most_common(cfg.told) if len(w.encode("utf-8", "replace")) <= cfg.word_bytes]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    return spread(docs.select(F.col(text_col).cast("string"))).mapInArrow(by_slices(run, 256), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, text_col: str, vocabulary: Vocabulary, cfg: BpeConfig) -> bytes:
    """The automaton of the words that are more frequent than some count, which leaves at most cfg.lexicon of them."""
    counts = stage(count_words(docs, text_col, cfg), "words", narrow=True)
    step = F.floor(F.log2("n") * 16)  # the number of steps is bounded, whatever the corpus
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["words"]
        if total > cfg.lexicon:
            break
        least = r["step"]
    top = [] if least is None else [r[0] for r in counts.where(step >= least).select("word").collect()]
    unstage(docs.sparkSession, counts)
    return Lexicon.compile({b: vocabulary.merge(b) for b in (w.encode("utf-8") for w in top)})


def _taken(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, run r from ends[r] to ends[r + 1], one after the other for each of rows; and where each begins, and the last ends."""
    starts = ends[rows]
    lengths = ends[rows + 1] - starts
    at = np.concatenate(([0], np.cumsum(lengths)))
    index = np.repeat(starts - at[:-1], lengths)
    index += np.arange(len(index))
    return values[index], at


def joined(batches: Iterable[pa.RecordBatch], size_limit: int) -> Iterator[pa.RecordBatch]:
    """Successive batches whose texts, in the second column, have at most so many bytes together; a larger batch is alone."""
    run, size = [], 0
    for batch in batches:
        more = batch.column(1).nbytes
        if run and size + more > size_limit:
            yield pa.concat_batches(run)
            run, size = [], 0
        run.append(batch)
        size += more
    if run:
        yield pa.concat_batches(run)


class Encoder:
    """Encodes texts through a lexicon, merging the words that it lacks. Keeps the ids of a bounded number of words, those most used."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, cached: int, grouped: int = BpeConfig.grouped):
        self.vocabulary, self.lexicon, self.cached, self.grouped = vocabulary, lexicon, cached, grouped
        self.spelt = pa.array([t.encode() + b" " for t in vocabulary.tokens], pa.large_binary())
        self.special = re.compile("(" + "|".join(re.escape(a) for a in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None
        # An added token is a piece with a capital, which normalised text lacks.
        self.fixed = {f"A{i}": at for at, i in enumerate(vocabulary.added.values())}
        self.known = dict(self.fixed)  # row of a word, in order
        self.ids = np.array([*vocabulary.added.values()], np.uint32)  # of all rows
        self.ends = np.arange(len(self.known) + 1)
        self.used = np.zeros(len(self.known), np.int64)

    def _learn(self, words: list[str]) -> None:
        """Add rows for words that have none."""
        raw = [w.encode() for w in words]
        numbers = self.lexicon.numbers(raw)
        lacking = np.flatnonzero(numbers < 0)
        merged = [self.vocabulary.merge(raw[i]) for i in lacking.tolist()]
        # Runs of ids: those of the lexicon, then the merged ones.
        runs = np.concatenate((self.lexicon.ids, np.fromiter(chain.from_iterable(merged), np.uint32)))
        ends = np.concatenate((self.lexicon.offsets.astype(np.int64), len(self.lexicon.ids) + np.cumsum([len(m) for m in merged], dtype=np.int64)))
        numbers[lacking] = self.lexicon.words + np.arange(len(lacking))
        ids, at = _taken(runs, ends, numbers)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ends = np.concatenate((self.ends, len(self.ids) + at[1:]))
        self.ids = np.concatenate((self.ids, ids))
        self.used = np.concatenate((self.used, np.zeros(len(words), np.int64)))

    def _forget(self, long: list[str]) -> None:
        """Drop these words, whose rows are the last, and the less used half of the others if there are too many; what was used long ago counts less and less."""
        for word in long:
            del self.known[word]
        n = len(self.known)
        self.ends, self.used = self.ends[: n + 1], self.used[:n]
        self.ids = self.ids[: self.ends[-1]]
        if n > self.cached:
            first = len(self.fixed)
            most = first + np.sort(np.argsort(-self.used[first:], kind="stable")[: self.cached // 2])
            rows = np.concatenate((np.arange(first), most))
            names = list(self.known)
            self.known = {names[i]: row for row, i in enumerate(rows.tolist())}
            self.ids, self.ends = _taken(self.ids, self.ends, rows)
            self.used = self.used[rows] // 2

    def _prepared(self, text: str) -> str:
        if self.special is None or "<|" not in text:
            return normal(text)
        return " ".join([f"A{self.vocabulary.added[part]}" if i % 2 else normal(part) for i, part in enumerate(self.special.split(text))])

    def gathered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, memoryview, np.ndarray]:
        """Ids of a group of texts and where each text begins and the last ends; the decoded tokens in UTF-8, each before a space, likewise."""
        different, at, places = pieces([self._prepared(t) for t in texts])
        rows = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(rows < 0)
        inside, order, each = cut([different[i] for i in new.tolist()])
        words = [w for w in dict.fromkeys(inside) if w not in self.known]
        long = [w for w in words if len(w) > KEPT_CHARS]
        self._learn([w for w in words if len(w) <= KEPT_CHARS] + long)
        # A new piece has a row of its own in this group, with the ids of all its words.
        new = new[order]
        inner = np.fromiter(map(self.known.__getitem__, inside), np.int64, len(inside))
        ids, begins = _taken(self.ids, self.ends, inner)
        uses = np.bincount(at, minlength=len(rows))
        known = rows >= 0
        self.used[rows[known]] += uses[known]
        np.add.at(self.used, inner, np.repeat(uses[new], each))
        rows[new] = len(self.known) + np.arange(len(new))
        stops = len(self.ids) + begins[np.cumsum(each)]
        ids, begins = _taken(np.concatenate((self.ids, ids)), np.concatenate((self.ends, stops)), rows[at])
        self._forget(long)
        begins = begins[places]
        if not len(ids):
            return ids, begins, memoryview(b""), begins
        _, ends, spelt = self.spelt.take(pa.array(ids)).buffers()
        return ids, begins, memoryview(spelt), np.frombuffer(ends, np.int64, len(ids) + 1)[begins]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The ids of each text as little-endian unsigned 32-bit integers, and what they decode to."""
        for group in groups(texts, self.grouped):
            ids, begins, spelt, spelt_begins = self.gathered(group)
            for (a, b), (c, d) in zip(pairwise(begins.tolist()), pairwise(spelt_begins.tolist()), strict=True):
                yield ids[a:b].tobytes(), str(spelt[c : max(c, d - 1)], "utf-8")


#: The encoder that this worker used last, by the name of its lexicon.
_LAST: dict[str, Encoder] = {}


def kept_encoder(name: str, vocabulary: Vocabulary, cfg: BpeConfig) -> Encoder:
    """The encoder of a published lexicon; a worker that goes on to another task of the same run keeps it."""
    if name in _LAST:
        return _LAST[name]
    _LAST.clear()
    encoder = Encoder(vocabulary, mapped(SparkFiles.get(name)), cfg.cached, cfg.grouped)
    if cfg.kept:
        _LAST[name] = encoder
    return encoder


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", cfg: BpeConfig = BpeConfig(), digests: bool = False) -> DataFrame:
    """(id, ids array<int>, decoded) for every row; with digests (id, n_tokens, ids_sha256, decoded_sha256) instead."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    vocabulary = Vocabulary.read(tokenizer_path)
    name = publish(spark, compile_lexicon(docs, text_col, vocabulary, cfg))
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_encoder(name, shared.value, cfg)
        for part in joined(batches, cfg.grouped):
            texts = ["" if t is None else t for t in part.column(1).to_pylist()]
            if digests:
                rows = []
                for group in groups(texts, cfg.grouped):
                    ids, begins, spelt, spelt_begins = encoder.gathered(group)
                    for (a, b), (c, d) in zip(pairwise(begins.tolist()), pairwise(spelt_begins.tolist()), strict=True):
                        rows.append((b - a, hashlib.sha256(ids[a:b]).hexdigest(), hashlib.sha256(spelt[c : max(c, d - 1)]).hexdigest()))
                sizes, of_ids, of_texts = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                found = list(encoder.encode(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([d for _, d in found], pa.string())], names=["id", "ids", "decoded"])

    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else f"id {kind}, ids array<int>, decoded string"
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(by_slices(run, 256), out).withColumnRenamed("id", id_col)
