r"""PII: patterns, and information-theoretic sanitisation of the terms that reveal them (operator 9).

Base patterns find emails, IPv4 addresses, card and phone numbers; a further one finds what is assigned
to the name of a secret (a key, token or password). Each value found is a protected entity. Terms near an entity (within a number of words) may give it away. Over all
different texts (copies of a text count once), n(e) of N hold the entity, n(t) the term and n(e,t) both near each other. The
information that a term tells of an entity is PMI(e;t) = log2(n(e,t) N / (n(e) n(t))), at
most the entity's own information IC(e) = -log2(n(e) / N); their ratio is the disclosure, 1
if the term occurs with the entity alone (after Sanchez and Batet, "C-sanitized", 2016). In the
documents that hold the entity a term whose disclosure reaches a bound is generalised, and
from a higher bound on it is removed. It is generalised to a broader term: of the other terms of its
contexts that are more frequent than it and disclose nothing, the one that is in most of them, at
least in half (subsumption after Sanderson and Croft, 1999); where there is none, to its kind. Every pair that met is judged, also that of an entity with a
single mention, unless so many meetings are likely by chance: with n(e) n(t) / N expected, by the
lesser of Markov's and Chernoff's bounds. One meeting of a term and an entity that each occur once
is no chance from 20 different texts on.

Every text is searched whole, and counts are taken over all documents: one pass finds entities and
contexts, a second counts the documents of candidate terms (through a bit table of fixed size
that is broadcast, then an exact join). Only documents with entities are read again.

Base patterns, leftmost and non-overlapping by kind, failing matches dropped without retry:
email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits). Each takes time in
proportion to the text: an ip can only begin where a run of digits does, so runs are never rescanned.

Defined cases: a null text is an empty one, with no spans; a null id is kept; repeated rows are
rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .probe import Tally, bit_table
from .runtime import by_slices, spread, stage
from .words import WORD, hash_terms, hash_words

KINDS = ("email", "ip", "card", "phone")
SECRET, TERM = "secret", "term"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Names of secrets.
_SECRET = re.compile(r"""(?i)(?:api[_-]?key|secret|token|password|passwd)["']?\s{0,8}[:=]\s{0,8}["']?([A-Za-z0-9+/_.-]{8,})""")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern matches from left to right: an address needs its own @, so each is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, ordered by start, then kind as listed."""
    found = [(s, e, 0) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        found += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


def entity_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans and those of secrets, in the same order."""
    found = base_spans(text)
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), SECRET) for m in _SECRET.finditer(text)]
    return sorted(found, key=_place)


def _place(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], _ORDER[span[2]]


_ORDER = {k: i for i, k in enumerate((*KINDS, SECRET, TERM))}


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=_place))


def entity(text: str, span: tuple[int, int, str]) -> str:
    """The protected value: an address in lower case, a number as its digits, a secret as it is."""
    s, e, kind = span
    value = text[s:e]
    return f"{kind}:{value.lower() if kind == 'email' else value if kind in ('ip', SECRET) else _digits(value)}"


@dataclass(frozen=True)
class PiiConfig:
    window: int = 6  # words on either side of an entity
    letters: int = 3  # of a term, at least
    chance: float = 0.05  # probability of so many meetings, if term and entity were independent, at most
    generalise: float = 0.8  # disclosure from which a term is generalised
    remove: float = 0.95  # and from which it is removed
    broader: float = 0.5  # share of a term's contexts that hold the term it is generalised to


def contexts(text: str, spans: list[tuple[int, int, str]], cfg: PiiConfig) -> list[tuple[str, list[str]]]:
    """(entity, the terms of its context) for each span; terms are words near it that are no part of a span."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    starts = np.array([s for s, _ in words])
    covered = [any(s < be and e > bs for bs, be, _ in spans) for s, e in words] if len(spans) * len(words) < 200_000 else _covered(words, spans)
    out = []
    for span in spans:
        left, right = int(np.searchsorted(starts, span[0])), int(np.searchsorted(starts, span[1]))
        near = [k for k in [*range(max(0, left - cfg.window), left), *range(right, min(len(words), right + cfg.window))] if not covered[k]]
        terms = [text[words[k][0] : words[k][1]].lower() for k in near]
        out.append((entity(text, span), sorted({t for t in terms if len(t) >= cfg.letters and not any(c.isdigit() for c in t)})))
    return out


def _covered(words: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[bool]:
    size = max([e for _, e in words] + [e for _, e, _ in spans])
    mark = np.zeros(size + 1, bool)
    for s, e, _ in spans:
        mark[s:e] = True
    total = np.concatenate(([0], np.cumsum(mark)))
    return [bool(total[e] > total[s]) for s, e in words]


def _text_key(text: Column) -> Column:
    """A text by two 64-bit hashes."""
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text))).alias("_key")


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("digest")


FOUND = "base string, own string, n_email long, n_ip long, n_card long, n_phone long, text string, near array<struct<entity: string, terms: array<string>>>"
_NEAR = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))


def scan(docs: DataFrame, id_col: str, text_col: str, cfg: PiiConfig) -> DataFrame:
    """One row per document: a hash of its text, base spans and counts; for documents with entities also the text and the contexts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = entity_spans(text or "")
                base = [x for x in spans if x[2] != SECRET]
                n = [sum(1 for *_, k in base if k == kind) for kind in KINDS]
                near = [{"entity": e, "terms": t} for e, t in contexts(text, spans, cfg)] if spans else None
                rows.append((join_spans(base), join_spans(spans), *n, text if spans else None, near))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), _NEAR]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["id", "digest", "base", "own", "n_email", "n_ip", "n_card", "n_phone", "text", "near"])

    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _digest(text_col))).mapInArrow(by_slices(run, 256), f"id {kind}, digest long, {FOUND}")


def _count_terms(docs: DataFrame, text_col: str, terms: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, n) different texts that hold each term of (term), over all texts; a text with m copies by (digest, m) counts 1/m in each."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hash_terms(batch.column(0).to_pylist()).view(np.int64))], names=["term", "h"])

    wanted = stage(terms.mapInArrow(hashed, "term string, h long"), "terms", narrow=True)
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "h", wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            each = 1.0 / batch.column(1).to_numpy(zero_copy_only=False)
            for rows, hashes, offsets in hash_words(batch.column(0).to_pylist()):
                at = shared.value.find(hashes)
                own = np.searchsorted(offsets, at, "right") - 1
                pair = np.unique(np.stack([own.astype(np.uint64), hashes[at]], 1), axis=0) if len(at) else np.empty((0, 2), np.uint64)
                tally.add(pair[:, 1], each[rows.start + pair[:, 0].astype(np.int64)])
            if tally.full:
                yield told(tally)
        yield told(tally)

    def told(tally: Tally) -> pa.RecordBatch:
        h, n = tally.take()
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    # Texts without a copy stay where they are read; only those that may have copies are shuffled, to learn how many.
    marked = bloom.mark(docs.select(F.col(text_col).cast("string").alias("text"), _digest(text_col)), "digest", bloom.build(copies, "digest"), "copied")
    single = marked.where("not copied").select("text", F.lit(1).cast("long").alias("m"))
    weighed = single.union(marked.where("copied").join(copies, "digest", "left").select("text", F.coalesce("m", F.lit(1).cast("long")).alias("m")))
    counts = weighed.mapInArrow(by_slices(run, 256), "h long, n double").groupBy("h").agg(F.round(F.sum("n")).cast("long").alias("n"))
    return wanted.join(counts, "h").select("term", "n")


def disclosures(found: DataFrame, docs: DataFrame, text_col: str, cfg: PiiConfig) -> DataFrame | None:
    """(entity, term, disclosure, broader) of the terms that reach cfg.generalise; None if no term met an entity."""
    near = found.where("near is not null").select("digest", F.explode("near").alias("x")).select("digest", "x.entity", "x.terms")
    met = near.select("digest", "entity", F.explode("terms").alias("term"))
    pairs = met.groupBy("entity", "term").agg(F.countDistinct("digest").alias("both"))
    pairs = stage(pairs, "term-pairs", narrow=True)
    if not pairs.take(1):
        return None
    texts = stage(found.groupBy("digest").agg(F.count("*").alias("m")), "texts", narrow=True)
    n = texts.count()
    of_entity = near.groupBy("entity").agg(F.countDistinct("digest").alias("ne"))
    of_term = stage(_count_terms(docs, text_col, pairs.select("term").distinct(), texts.where("m > 1")).withColumnRenamed("n", "nt"), "term-counts", narrow=True)
    pmi = F.log2(F.col("both") * F.lit(n) / (F.col("ne") * F.greatest("nt", "both")))
    ic = -F.log2(F.col("ne") / F.lit(n))
    told = F.when(ic > 0, pmi / ic).otherwise(0.0)
    expected = F.col("ne") * F.greatest("nt", "both") / F.lit(n)
    by_chance = F.least(expected / F.col("both"), F.when(expected < F.col("both"), F.exp(F.col("both") - expected + F.col("both") * F.log(expected / F.col("both")))).otherwise(1.0))
    out = pairs.join(of_entity, "entity").join(of_term, "term").withColumn("disclosure", told).where(by_chance <= cfg.chance)
    out = stage(out.where(F.col("disclosure") >= cfg.generalise).select("entity", "term", "disclosure", "nt"), "disclosures", narrow=True)
    return out.join(_broader(out, met.distinct(), of_term, cfg), "term", "left").select("entity", "term", "disclosure", "broader")


def _broader(told: DataFrame, met: DataFrame, of_term: DataFrame, cfg: PiiConfig) -> DataFrame:
    """(term, broader) of the terms to generalise for which the contexts (digest, entity, term) hold a broader term."""
    own = met.join(told.where(F.col("disclosure") < cfg.remove).select("term", "nt").distinct(), "term")
    held = own.groupBy("term").agg(F.count("*").alias("contexts"))
    other = met.withColumnRenamed("term", "broader").join(told.select(F.col("term").alias("broader")).distinct(), "broader", "left_anti")
    beside = own.join(other, ["digest", "entity"]).groupBy("term", "nt", "broader").agg(F.count("*").alias("k"))
    fit = beside.join(of_term.select(F.col("term").alias("broader"), F.col("nt").alias("nb")), "broader").where("nb > nt").join(held, "term").where(F.col("k") >= cfg.broader * F.col("contexts"))
    return fit.groupBy("term").agg(F.max(F.struct("k", "nb", "broader")).alias("m")).select("term", F.col("m.broader").alias("broader"))


_CLUES = "array<struct<term: string, d: double, broader: string>>"


def _mark(text: str, own: list[tuple[int, int, str]], clues: list[dict], cfg: PiiConfig) -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
    """All spans of a text given its disclosing terms, and (start, what takes its place) of the terms."""
    bound = {c["term"]: (c["d"], c["broader"]) for c in clues}
    terms = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text) if m.group().lower() in bound] if bound else []
    hidden = _covered([(s, e) for s, e, _ in terms], own) if terms else []
    terms = [t for t, h in zip(terms, hidden, strict=True) if not h]
    instead = [(s, "" if bound[t][0] >= cfg.remove else bound[t][1] or f"[{TERM.upper()}]") for s, _, t in terms]
    return [*own, *((s, e, TERM) for s, e, _ in terms)], instead


def _clues(found: DataFrame, told: DataFrame) -> DataFrame:
    """(row, clues) of the documents that hold an entity with disclosing terms."""
    near = found.where("near is not null").select("row", F.explode("near.entity").alias("entity")).distinct()
    return near.join(told, "entity").groupBy("row", "term").agg(F.max("disclosure").alias("d"), F.max("broader").alias("broader")).groupBy("row").agg(F.collect_list(F.struct("term", "d", "broader")).alias("clues"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans, terms) for every row of docs.

    spans: base spans, those of secrets and of disclosing terms; terms: of each disclosing term the start and what takes its place.
    """
    found = stage(scan(docs, id_col, text_col, cfg).withColumn("row", F.monotonically_increasing_id()), "pii")
    told = disclosures(found, docs, text_col, cfg)
    out = [F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base"]
    kind = "array<struct<start: int, instead: string>>"
    if told is None:
        return found.select(*out, F.col("own").alias("spans"), F.array().cast(kind).alias("terms"))
    texts = found.where("near is not null").select("row", "text").join(_clues(found, told), "row")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = [_mark(t, entity_spans(t), clues, cfg) for t, clues in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            instead = [[{"start": s, "instead": x} for s, x in i] for _, i in marked]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([join_spans(m) for m, _ in marked], pa.string()), pa.array(instead, pa.list_(pa.struct([("start", pa.int32()), ("instead", pa.string())])))], names=["row", "more", "instead"])

    more = texts.mapInArrow(by_slices(mark, 512), f"row long, more string, instead {kind}")
    return found.drop("text", "near", "digest").join(more, "row", "left").select(*out, F.coalesce("more", "own").alias("spans"), F.coalesce("instead", F.array().cast(kind)).alias("terms"))


def redact(text: str, spans: list[tuple[int, int, str]], instead: list[tuple[int, str]]) -> str:
    """The text with entities replaced by their kind, and terms by what takes their place. Overlapping spans are one, of the first's kind."""
    out, at, terms = [], 0, dict(instead)
    for s, e, kind in sorted(spans, key=_place):
        if s >= at:
            out += [text[at:s], terms[s] if kind == TERM else f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """docs with their texts redacted, all columns kept; texts without entities are unchanged."""
    found = stage(scan(docs, id_col, text_col, cfg).withColumn("row", F.monotonically_increasing_id()), "pii")
    told = disclosures(found, docs, text_col, cfg)
    columns = docs.columns
    if told is None:
        joined = docs.withColumn("_clues", F.lit(None).cast(_CLUES))
    else:  # what reveals the entities of a text depends on the text alone
        texts = found.where("near is not null").select("row", _text_key(F.col("text")))
        clues = stage(texts.join(_clues(found, told), "row").groupBy("_key").agg(F.first("clues").alias("_clues")), "clues", narrow=True)
        size = clues.agg(F.coalesce(F.sum(64 + 64 * F.size("_clues")), F.lit(0))).first()[0]
        joined = bloom.attach(docs.withColumn("_key", _text_key(F.col(text_col).cast("string"))), "_key", clues, "_clues", size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            clues = batch.column(batch.num_columns - 1).to_pylist()
            for i, text in enumerate(texts):
                if own := entity_spans(text or ""):
                    texts[i] = redact(text, *_mark(text, own, clues[i] or [], cfg))
            kept = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield kept.select(columns)

    return joined.select(*columns, "_clues").mapInArrow(by_slices(run, 256), docs.schema)
