r"""Conversation structure repair by error-correcting Earley parsing (operator 13).

Rows of a conversation, in order, are tokens. A weighted grammar says which role sequences are sound,
(s?(ua)+)?, and its error productions what a repair may do: delete a row, give it another role, insert an
empty one. The grammar is left-linear, so all items of a chart's column begin at the conversation's
start; each keeps the least (cost, audit) of its derivations, the audit being the initials of the edits in order. The
completed chart gives the cheapest repair, and of equally cheap ones that whose audit is ASCII-least.

Why one audit an item is enough: derivations of an item that cost the same have consumed the same rows, so
neither audit is a longer form of the other (more insertions would cost more), and whatever follows
leaves their order as it is.

Scale: rows are dealt out by ranges of (conversation, turn, role, text) and streamed in that order, so no conversation,
however long, has to fit in a task. One that lies within a range is parsed there and then. What may
go on in a neighbouring range, or is longer than a segment, becomes segments of bounded size: each gives its
chart for every way of entering it, a row of at most sixteen items; the charts of a conversation are
joined in order; and each segment is then repaired by its part of the audit. A text seen in an earlier segment is
found by an aggregate over digests that a segment tells once each.

Faults, of which a row has the first that fits: blank (nothing but white space), duplicate (role and text as in an earlier
row), truncated (ends without . ! or ?). Blank and duplicate rows must go.

Defined cases: null conversation ids form one conversation; a null role or text is one space, and so is a null id
or turn where a row's damage is drawn; rows of the same turn are taken by role, then text; a role
counts by its first character, and an empty one has none; empty and very long texts are rows like others; a
conversation whose rows are all dropped gets zeros, an empty audit and no turns; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stage, text_batches

# The grammar. A rule (X, t) of a symbol goes on from X by terminal t; Open begins with nothing.
RULES = {
    "Open": [("Open", "delete")],
    "Sys": [("Open", "system"), ("Sys", "delete")],
    "User": [("Open", "user"), ("Sys", "user"), ("Done", "user"), ("User", "delete")],
    "Done": [("User", "assistant"), ("Done", "delete")],
}
COMPLETE = ("Open", "Done")
KEEP, REROLE, DELETE, INSERT = (0, "K"), (2, "R"), (3, "D"), (2, "I")
TRUNCATED = 1
ROLES = ("user", "assistant")
LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]
#: Items X -> Y . t by their Y: where a completed Y leads.
_AFTER = {y: [(x, t) for x, rules in RULES.items() for z, t in rules if z == y] for y in RULES}


@dataclass(frozen=True)
class RepairConfig:
    segment_rows: int = 4096
    segment_bytes: int = 4 << 20
    ranges: int = 0  # of the order; 0: as many as the session's shuffles have, or its cores if they are more


@lru_cache(maxsize=4096)
def options(token: tuple[str, str]) -> dict[str, Weight]:
    """What a row (first character of its role, fault) can be scanned as: terminal -> (cost, initial)."""
    initial, fault = token
    out = {"delete": DELETE}
    if fault in ("blank", "duplicate"):
        return out
    more = TRUNCATED if fault == "truncated" else 0
    if initial == "s":
        out["system"] = (KEEP[0] + more, KEEP[1])
    for role in ROLES:
        cost, letter = KEEP if initial == role[0] else REROLE
        out[role] = (cost + more, letter)
    return out


def completed(column: dict[str, Weight]) -> dict[str, Weight]:
    """A column with what insertions complete in it."""
    todo = list(column)
    while todo:
        y = todo.pop()
        cost, audit = column[y]
        for x, t in _AFTER[y]:
            if t in ROLES and (new := (cost + INSERT[0], audit + INSERT[1])) < column.get(x, _NEVER):
                column[x] = new
                todo.append(x)
    return column


_NEVER = (1 << 60, "")


def scanned(column: dict[str, Weight], token: tuple[str, str]) -> dict[str, Weight]:
    """The next column: each item X -> Y . t goes on by what the row can be."""
    can, out = options(token), {}
    for y, (cost, audit) in column.items():
        for x, t in _AFTER[y]:
            if (edit := can.get(t)) and (new := (cost + edit[0], audit + edit[1])) < out.get(x, _NEVER):
                out[x] = new
    return completed(out)


def settle(column: dict[str, Weight], head: list[str]) -> dict[str, Weight]:
    """Move what all audits of a column begin with to head, so they stay short however many rows there are."""
    shared = commonprefix([a for _, a in column.values()])
    head.append(shared)
    return {x: (cost, a[len(shared) :]) for x, (cost, a) in column.items()}


def chart(tokens: list[tuple[str, str]], start: str = "Open") -> dict[str, Weight]:
    """The last column for these rows, entered with start completed: symbol -> (cost, audit)."""
    column, head = completed({start: (0, "")}), []
    for k, token in enumerate(tokens):
        column = scanned(column, token)
        if k % 64 == 63:
            column = settle(column, head)
    front = "".join(head)
    return {x: (cost, front + a) for x, (cost, a) in column.items()}


@lru_cache(maxsize=65536)
def _short_repair(tokens: tuple[tuple[str, str], ...]) -> Weight:
    last = chart(list(tokens))
    return min(last[x] for x in COMPLETE if x in last)


def parse(tokens: list[tuple[str, str]]) -> Weight:
    """(cost, audit) of the cheapest repair of a whole conversation."""
    if len(tokens) <= 16:
        return _short_repair(tuple(tokens))
    last = chart(tokens)
    return min(last[x] for x in COMPLETE if x in last)


def apply(audit: str, rows: list[tuple[str, str]], spoken: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The repaired rows (role, text), and how many of users and assistants there are then; spoken: those before these rows."""
    out, at = [], 0
    for letter in audit:
        role, text = (ROLES[spoken % 2], "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        out.append((ROLES[spoken % 2] if letter in "RI" else role, text))
        spoken += not (letter == "K" and role[:1] == "s")
    return out, spoken


@dataclass
class Segment:
    """Rows of one conversation, in order. Rows come with the number of times they are repeated in place."""

    turns: list[int | None] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    size: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self.turns.append(turn)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text) + len(role) + 64

    def digests(self) -> list[bytes]:
        return [hashlib.blake2b(f"{len(r)}:{r}{t}".encode("utf-8", "replace"), digest_size=16).digest() for r, t in zip(self.roles, self.texts, strict=True)]

    def tokens(self, seen: set[bytes]) -> list[tuple[str, str]]:
        """(first character of the role, fault or nothing) by row; seen: digests of earlier rows, which grow."""
        out = []
        for role, text, digest in zip(self.roles, self.texts, self.digests(), strict=True):
            full = text.rstrip(_SPACE)
            fault = "blank" if not full else "duplicate" if digest in seen else "truncated" if full[-1] not in ".!?" else ""
            seen.add(digest)
            out.append((role[:1], fault))
        return out

    def facts(self, tokens: list[tuple[str, str]]) -> dict:
        """What of a report adds up over segments, and the ends that meet their neighbours'."""
        known = [t for t in self.turns if t is not None]
        initials = [i for i, _ in tokens]
        faults = [f for _, f in tokens]
        return {
            "n_rows": len(tokens), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "n_turns": len(set(known)),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None, "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        } | {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations with faults drawn by each row's key; copies of 0 stand for a dropped row."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text, role = name("text"), name("role")
    faulty = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), drawn.alias("drawn"))
    text = F.when(F.col("drawn").isin(0, 1), "").when(F.col("drawn") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("drawn") == 4, "user").otherwise(F.col("role"))
    return faulty.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("drawn") == 0, 0).when(F.col("drawn") == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """conversations as they are, in the form that repair takes."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


_TURNS = "array<struct<role: string, text: string>>"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FACTS = "n_rows long, first_turn long, last_turn long, n_turns long, first string, last string, illegal long, blank long, duplicate long, truncated long"
_NAMES = [c.split()[0] for c in REPORT.split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_ARROW = {
    **{n: _KINDS[k] for n, k in (c.split() for c in f"{REPORT}, {_FACTS}, seg long, part long, is_open boolean, conv string, entered string".split(", "))},
    "turns": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), "at": pa.list_(pa.int64()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "digests": pa.list_(pa.binary()),
    "items": pa.list_(pa.struct([("enter", pa.string()), ("leave", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])),
}


def _batches(rows: Iterator[dict], names: list[str], conv: str, kind: pa.DataType, most: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches bounded in number and, by _size, in bytes."""
    held, weight = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], kind if n == conv else _ARROW[n]) for n in names], names=names)

    for row in rows:
        weight += row.pop("_size", 0)
        held.append(row)
        if len(held) >= most or weight >= size:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def _report(facts: list[dict], cost: int, audit: str) -> dict:
    """A conversation's report from the facts of its segments, in order."""
    facts = [f for f in facts if f["n_rows"]]
    add = lambda name: sum(f[name] for f in facts)
    dated = [f for f in facts if f["n_turns"]]
    shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:]))
    met = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(facts, facts[1:]))
    gaps = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - (add("n_turns") - shared) if dated else 0
    return {"gaps": gaps, "blank": add("blank"), "duplicate": add("duplicate"), "truncated": add("truncated"), "illegal": add("illegal") + met, "cost": cost, "audit": audit}


@dataclass(frozen=True)
class Repaired:
    """Conversations that one task saw as a whole, with their turns; and those that came in segments, with their turns in parts."""

    whole: DataFrame  # (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns)
    long: DataFrame  # (conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)
    parts: DataFrame  # (conv, conv_id, part, turns)

    @property
    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation."""
        return self.whole.select("conv_id", *_NAMES).union(self.long.select("conv_id", *_NAMES))

    @property
    def turns(self) -> DataFrame:
        """(conv_id, part, turns array<struct<role, text>>): the repaired rows, those of a long conversation in several parts, in their order."""
        return self.whole.select("conv_id", F.lit(0).cast("long").alias("part"), "turns").union(self.parts.select("conv_id", "part", "turns"))


def _order(cfg: RepairConfig, rows: DataFrame) -> DataFrame:
    """rows in ranges of (conversation, turn, role, text), sorted. Rows that are equal in all may be parted: then their order says nothing."""
    spark = rows.sparkSession
    n = cfg.ranges or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    front = F.substring("text", 1, 256)
    salt = F.when(F.length("text") <= 256, F.xxhash64(F.monotonically_increasing_id())).otherwise(0)
    by: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), front, salt]
    return rows.repartitionByRange(n, *by).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _first_pass(rows: DataFrame, cfg: RepairConfig) -> DataFrame:
    """Reports and turns of conversations that lie within a range and a segment, and the segments of the others."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "is_open", *_NAMES, "turns", "seg", "at", "roles", "texts", "digests"]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Segment, bool]]:
        """(conversation, segment, whether it ends the conversation here)."""
        now, conv = None, None
        for part in batches:
            for start in range(0, part.num_rows, 256):
                for c, turn, role, text, copies in zip(*(col.to_pylist() for col in part.slice(start, 256).columns), strict=True):
                    if now is None or c != conv:
                        if now is not None:
                            yield conv, now, True
                        now, conv = Segment(), c
                    elif now.size >= cfg.segment_bytes or len(now.turns) >= cfg.segment_rows:
                        yield conv, now, False
                        now = Segment()
                    now.add(turn, role, text, copies)
        if now is not None:
            yield conv, now, True

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base, k, going_on = TaskContext.get().partitionId() << 40, 0, True  # the first conversation may go on from the range before
        todo = None
        for item in segments(batches):
            if todo is not None:
                yield result(*todo, base + k, going_on or not todo[2])
                going_on, k = not todo[2], k + 1
            todo = item
        if todo is not None:  # and the last in the range after
            yield result(*todo, base + k, True)

    def result(conv: object, s: Segment, _: bool, seg: int, is_open: bool) -> dict:
        out = {"conv_id": conv, "is_open": is_open, "_size": s.size}
        if is_open:
            return out | {"seg": seg, "at": s.turns, "roles": s.roles, "texts": s.texts, "digests": sorted(set(s.digests()))}
        tokens = s.tokens(set())
        cost, audit = parse(tokens)
        said = apply(audit, list(zip(s.roles, s.texts, strict=True)))[0]
        return out | _report([s.facts(tokens)], cost, audit) | {"turns": [{"role": r, "text": t} for r, t in said]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(results(batches), names, "conv_id", arrow)

    arrow = _conv_type(rows)
    text_batches(rows.sparkSession)
    schema = f"conv_id {kind}, is_open boolean, {REPORT}, turns {_TURNS}, seg long, at array<long>, roles array<string>, texts array<string>, digests array<binary>"
    return _order(cfg, rows.select("conv_id", "turn", "role", "text", "copies")).mapInArrow(run, schema)


def _conv_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def _key() -> Column:
    """The conversation as a text that is never null."""
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))


def _charts(segments: DataFrame) -> DataFrame:
    """(conv, conv_id, seg, facts, items) of segments (with seen, the digests that earlier ones hold)."""
    names = ["conv", "conv_id", "seg", *(c.split()[0] for c in _FACTS.split(", ")), "items"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in batches:
            for r in (x for at in range(part.num_rows) for x in part.slice(at, 1).to_pylist()):
                s = Segment(r["at"], r["roles"], r["texts"])
                tokens = s.tokens(set(r["seen"] or ()))
                items = [{"enter": y, "leave": x, "cost": c, "audit": a} for y in RULES for x, (c, a) in chart(tokens, y).items()]
                yield {"conv": r["conv"], "conv_id": r["conv_id"], "seg": r["seg"], "items": items, "_size": 16 * len(tokens)} | s.facts(tokens)

    kind = _conv_type(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), names, "conv_id", kind)

    schema = f"conv string, conv_id {segments.schema['conv_id'].dataType.simpleString()}, seg long, {_FACTS}, items array<struct<enter: string, leave: string, cost: long, audit: string>>"
    return segments.select("conv", "conv_id", "seg", "at", "roles", "texts", "seen").mapInArrow(run, schema)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
    return groupby((r for part in batches for at in range(part.num_rows) for r in part.slice(at, 1).to_pylist()), key=lambda r: r["conv"])


def _stitched(charts: DataFrame) -> DataFrame:
    """For each conversation its report (seg null), and for each segment its part of the audit and what was said before it."""
    names = ["conv", "conv_id", "seg", *_NAMES, "entered"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv, parts in _by_conversation(batches):
            live, head, facts, paths = {"Open": (0, "")}, [], [], []
            for r in parts:
                after: dict[str, Weight] = {}
                came: dict[str, tuple[str, int]] = {}  # of a symbol: the one that its best path entered by, and the edits since
                for i in r.pop("items"):
                    if i["enter"] in live:
                        cost, audit = live[i["enter"]]
                        if (new := (cost + i["cost"], audit + i["audit"])) < after.get(i["leave"], _NEVER):
                            after[i["leave"]], came[i["leave"]] = new, (i["enter"], len(i["audit"]))
                live = settle(after, head)
                facts.append(r)
                paths.append(came)
            (cost, tail), at = min((live[x], x) for x in COMPLETE if x in live)
            audit = "".join([*head, tail])
            yield {"conv": conv, "conv_id": facts[0]["conv_id"], "_size": len(audit)} | _report(facts, cost, audit)
            end = len(audit)
            for f, came in zip(reversed(facts), reversed(paths), strict=True):
                at, n = came[at]
                yield {"conv": conv, "conv_id": f["conv_id"], "seg": f["seg"], "audit": audit[end - n : end], "entered": at, "_size": n}
                end -= n

    kind = _conv_type(charts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), names, "conv_id", kind)

    schema = f"conv string, conv_id {charts.schema['conv_id'].dataType.simpleString()}, seg long, {REPORT}, entered string"
    return charts.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(run, schema)


def _rendered(segments: DataFrame) -> DataFrame:
    """(conv, conv_id, part, turns) of segments joined with their part of the audit."""
    names = ["conv", "conv_id", "part", "turns"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in batches:
            for r in (x for at in range(part.num_rows) for x in part.slice(at, 1).to_pylist()):
                said = apply(r["audit"], list(zip(r["roles"], r["texts"], strict=True)), r["entered"] == "User")[0]
                yield {"conv": r["conv"], "conv_id": r["conv_id"], "part": r["seg"], "turns": [{"role": a, "text": t} for a, t in said], "_size": sum(len(t) + 64 for _, t in said)}

    kind = _conv_type(segments)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), names, "conv_id", kind)

    schema = f"conv string, conv_id {segments.schema['conv_id'].dataType.simpleString()}, part long, turns {_TURNS}"
    return segments.select("conv", "conv_id", "seg", "roles", "texts", "audit", "entered").mapInArrow(run, schema)


def repair(rows: DataFrame, cfg: RepairConfig = RepairConfig()) -> Repaired:
    """Reports and repaired rows of conversations (conv_id, turn, role, text, copies), as damaged or undamaged gives them."""
    first = stage(_first_pass(rows, cfg), "conversations")
    segments = first.where("is_open").select(_key().alias("conv"), "conv_id", "seg", "at", "roles", "texts", "digests")
    told = segments.select("conv", "seg", F.explode("digests").alias("digest"))
    first_seen = told.groupBy("conv", "digest").agg(F.min("seg").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    seen = told.join(first_seen, ["conv", "digest"]).where("seg > first").groupBy("conv", "seg").agg(F.collect_list("digest").alias("seen"))
    stitched = stage(_stitched(_charts(segments.join(seen, ["conv", "seg"], "left"))), "charts")
    parts = _rendered(segments.join(stitched.where("seg is not null").select("conv", "seg", "audit", "entered"), ["conv", "seg"]))
    return Repaired(first.where("not is_open").select("conv_id", *_NAMES, "turns"), stitched.where("seg is null").select("conv", "conv_id", *_NAMES), parts)


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _digest_of_parts(parts: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the parts of a conversation go through the hash in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in _by_conversation(batches):
            sha, before = hashlib.sha256(), False
            for r in rows:
                if r["says"]:
                    sha.update((b"\n" if before else b"") + r["lines"].encode("utf-8", "replace"))
                    before = True
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([sha.hexdigest()])], names=["conv", "repaired_sha256"])

    said = parts.select("conv", "part", _lines(F.col("turns")).alias("lines"), (F.size("turns") > 0).alias("says"))
    return said.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, "conv string, repaired_sha256 string")


def with_digests(done: Repaired) -> DataFrame:
    """The report with the hash of the repaired rows as lines role:text. Only conversations of several parts are moved for it."""
    whole = done.whole.select("conv_id", *_NAMES, F.sha2(_lines(F.col("turns")).cast("binary"), 256).alias("repaired_sha256"))
    return whole.union(done.long.join(_digest_of_parts(done.parts), "conv").select("conv_id", *_NAMES, "repaired_sha256"))
