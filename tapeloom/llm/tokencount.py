r"""Token counts with a whole-token shortcut (operator 12).

Most pre-tokens of a text are one token. Which strings are is proved once, on the driver, for the vocabulary
(whose size is fixed): every entry that is valid text is merged by the exact rule, and it is proved if
its own id alone comes out. That a string is in the vocabulary is not enough, as merges of lower rank
may cut it otherwise. A pre-token that is proved counts one by a single lookup; only the others
are merged, and their counts are remembered up to a bound.

It follows a tokenizers file of this kind: byte-level BPE without normaliser, pre-tokens by the
byte-level pattern, no space put before a text, added tokens cut from the raw text (each is one token).
Other kinds of file are refused.

A pre-token never goes on from a character that is no white space to one that is, so a very long text is
counted in pieces that are cut there: what is held besides the text is bounded, unless the text
has no space at all.

Defined cases: a null text is an empty one, of no bytes and no tokens; texts of any length are counted
whole; repeated rows and null ids are kept; an empty table gives an empty result; columns beside the
id and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _LATER_CLASS, _NEWER, Vocabulary, _byte_symbols
from .runtime import by_slices, spread

_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: Letters, numbers and spaces below U+0250, spelt out, so that the plain engine gives what the byte-level pattern says.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \u0085 "
_BEYOND = re.compile("[^\0-ɏ]")
_LATIN = re.compile(rf"{_SUFFIXES}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_W = r"\p{White_Space}"
_ANY = regex.compile(rf"{_SUFFIXES}| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|{_W}+(?!\P{{White_Space}})|{_W}+")
_ANY_NEWER = regex.compile(rf"(?V1){_SUFFIXES}| ?[\p{{L}}--[{_LATER_CLASS}]]+| ?[\p{{N}}--[{_LATER_CLASS}]]+| ?[[^{_W}\p{{L}}\p{{N}}]||[{_LATER_CLASS}]]+|{_W}+(?!\P{{White_Space}})|{_W}+")
#: A place where every text may be cut.
_CUT = re.compile(r"(?<=\S) ")


@dataclass(frozen=True)
class TokenCountConfig:
    limit: int = 512  # tokens; a longer text is over it
    piece: int = 1 << 20  # characters of a long text that are counted at a time, about
    remembered: int = 400_000  # merged pre-tokens that a task remembers
    word_chars: int = 256  # of a pre-token that is remembered, at most


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    m, split = t["model"], t["pre_tokenizer"] or {}
    if m["type"] != "BPE" or t["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or m["unk_token"] or m["dropout"] or m["end_of_word_suffix"] or m["continuing_subword_prefix"] or m.get("ignore_merges") or any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in t["added_tokens"]):
        raise ValueError(f"{path} is not a tokenizer of the kind that this operator implements")
    merges = [tuple(x if isinstance(x, list) else x.split(" ")) for x in m["merges"]]
    added = {x["content"]: x["id"] for x in t["added_tokens"]}
    ids = m["vocab"]
    tokens = [""] * (max([*ids.values(), *added.values()]) + 1)
    for token, i in [*ids.items(), *added.items()]:
        tokens[i] = token
    first = [ids[c] for c in _byte_symbols()]
    return Vocabulary(tokens, first, first, {ids[a] << 20 | ids[b]: i for i, (a, b) in enumerate(merges)}, [ids[a + b] for a, b in merges], added)


def prove(vocabulary: Vocabulary) -> list[str]:
    """The strings that encode alone as one token, each shown by the exact merge."""
    byte_of = {c: b for b, c in enumerate(_byte_symbols())}
    added = set(vocabulary.added.values())
    proved = []
    for i, token in enumerate(vocabulary.tokens):
        if not token or i in added:
            continue
        raw = bytes(byte_of[c] for c in token)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue  # a part of a character is never a pre-token
        if vocabulary.merge(raw) == [i]:
            proved.append(text)
    return proved


#: A proved pre-token counts one here too, so one sum tells tokens and shortcuts.
_DIRECT = 1 << 40


class Counts(dict):
    """Tokens of a pre-token: proved ones are there from the start, others are merged when they are first met."""

    def __init__(self, vocabulary: Vocabulary, proved: list[str], cfg: TokenCountConfig):
        self.proved = dict.fromkeys(proved, 1 + _DIRECT)
        super().__init__(self.proved)
        self.vocabulary, self.cfg = vocabulary, cfg

    def __missing__(self, word: str) -> int:
        n = len(self.vocabulary.merge(word.encode("utf-8", "replace")))
        if len(word) <= self.cfg.word_chars:
            if len(self) - len(self.proved) >= self.cfg.remembered:
                self.clear()
                self.update(self.proved)
            self[word] = n
        return n


def pieces(text: str, size: int) -> Iterator[str]:
    """text, cut about every size characters where no pre-token goes on."""
    start = 0
    while len(text) - start > size and (cut := _CUT.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text without added tokens."""
    if not _BEYOND.search(text):
        return _LATIN.findall(text)
    return (_ANY_NEWER if _NEWER.search(text) else _ANY).findall(text)


class TokenCounter:
    def __init__(self, vocabulary: Vocabulary, proved: list[str], cfg: TokenCountConfig):
        self.counts, self.cfg = Counts(vocabulary, proved, cfg), cfg
        self.added = re.compile("(" + "|".join(re.escape(a) for a in sorted(vocabulary.added, key=len, reverse=True)) + ")") if vocabulary.added else None

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens that were counted directly)."""
        parts = self.added.split(text) if self.added is not None and self.added.search(text) else [text]
        total = len(parts) // 2  # each second part is an added token
        for part in parts[::2]:
            for piece in pieces(part, self.cfg.piece):
                total += sum(map(self.counts.__getitem__, pre_tokens(piece)))
        return total % _DIRECT, total // _DIRECT


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", cfg: TokenCountConfig = TokenCountConfig()) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_direct) for every row."""
    vocabulary = read_vocabulary(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, prove(vocabulary)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*shared.value, cfg)
        for part in batches:
            found = [counter.count(t or "") for t in part.column(1).to_pylist()]
            n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64())], names=["id", "n_bytes", "n_tokens", "n_direct"])

    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    counted = rows.mapInArrow(by_slices(run, 128), f"id {kind}, n_bytes long, n_tokens long, n_direct long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > cfg.limit).alias("over_limit"), "n_direct")
