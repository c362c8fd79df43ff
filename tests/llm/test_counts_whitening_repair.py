"""Operators 11 to 13 against plain versions, brute force and hard rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import tokencount, turnrepair, whitening
from tapeloom.llm.queries import BYTE_TOKENIZER, QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"


# Whitening


def exact(vectors):
    """n, sums and the scatter of n x - S by Python's whole numbers."""
    x = [[int(np.floor(float(np.float64(c)) * 1024)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    return n, sums, y, [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 9, 6)).tolist()) for i in range(300)]
    rows = whitening.whole(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    n, sums, _, scatter = exact([v for _, v in vectors])
    cfg = whitening.WhiteningConfig(block=64)
    m = whitening.moments(rows, cfg)
    assert (m.n, m.sums) == (n, sums)
    assert len(whitening.primes_for(m.n * (m.n * m.spread) ** 2)) >= 5
    assert whitening.scatter(rows, m, cfg) == scatter


def test_remainder_and_primes():
    primes = whitening.primes_for(10**30)
    assert all(p < 1 << 21 for p in primes) and len(set(primes)) == len(primes)
    for value in (0, 1, -1, 10**30, -(10**30), 123456789012345678901234567):
        assert whitening.remainder([value % p for p in primes], primes) == value


def test_whitening_of_the_table(spark):
    rows = QUERIES["op11_residue_whitening"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, sums, y, scatter = exact([vectors[i] for i in ids])
    values, axes = np.linalg.eigh(np.array([[s / n**3 for s in r] for r in scatter]))
    values, axes = values[::-1], axes[:, ::-1]
    plain = np.array([[v / n for v in r] for r in y]) @ axes[:, :8] / np.sqrt(values[:8])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == 8 * n
    for k in range(8):
        mine = np.array([got[i, k + 1].whitened for i in ids])
        assert np.allclose(mine * np.sign(mine @ plain[:, k]), plain[:, k], rtol=0, atol=1e-9)
        assert got[ids[0], k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert all(got[i, 1].deviation == sum(v * v for v in r) and got[i, 1].n == n for i, r in zip(ids, y, strict=True))
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_whitening_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    kind = "vec_id long, embedding array<double>, label int, x int, id string, component string"
    more = (None, 1, "c", "c")
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [2.0**41, 1.0]), (7, [1.0, 2.0, 3.0])]
    good = [(8, [1.0, 2.0]), (9, [-1.0, 2.5]), (9, [-1.0, 2.5]), (None, [0.5, -3.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, *more) for r in bad + good], kind)).collect()
    n, _, y, _ = exact([v for _, v in good])
    assert sorted((r.vec_id is None, r.vec_id, r.component, r.n, r.deviation) for r in got if r.vec_id is not None) == sorted((False, i, c, n, Decimal(sum(v * v for v in r))) for (i, _), r in zip(good, y, strict=True) if i is not None for c in (1, 2))
    assert len(got) == 8 and {r.identity_error < 1e-9 for r in got} == {True}
    for none in ([], bad[:6], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(none, "vec_id long, embedding array<double>")).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1.0)


def test_deviation_beyond_a_long(spark):
    vectors = [(i, [(-1.0) ** i * 2.0**39, float(i)]) for i in range(50)]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect() if r.component == 1}
    _, _, y, _ = exact([v for _, v in vectors])
    assert all(got[i].deviation == Decimal(sum(v * v for v in r)) > 2**63 for (i, _), r in zip(vectors, y, strict=True))


# Token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_TOKENIZER)


@pytest.fixture(scope="module")
def counter():
    vocabulary = tokencount.read_vocabulary(BYTE_TOKENIZER)
    return tokencount.TokenCounter(vocabulary, tokencount.prove(vocabulary), tokencount.TokenCountConfig())


def test_counts_of_the_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op12_token_counts"](spark, SF).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_proof(library):
    vocabulary = tokencount.read_vocabulary(BYTE_TOKENIZER)
    proved = set(tokencount.prove(vocabulary))
    assert len(proved) > 40_000
    for i, token in enumerate(vocabulary.tokens):
        text = library.decode([i], skip_special_tokens=False)
        if "�" not in text and token not in vocabulary.added:
            alone = [t for t, _ in library.pre_tokenizer.pre_tokenize_str(text)] == [token]
            if alone:
                assert (text in proved) == (library.encode(text, add_special_tokens=False).ids == [i]), token


def test_every_code_point(library, counter):
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} " for c in points[at : at + 64])
        assert counter.count(text)[0] == len(library.encode(text, add_special_tokens=False).ids), hex(points[at])


def test_texts_of_all_kinds(library, counter):
    rng = random.Random(5)
    parts = ["a", "The", " the", "  ", "\n", "\n\n ", "\t", "'s", "'S", "é", "ß", "日本", "١٢", "½", "<|endoftext|>", "<|endoftext", "|>", " ", "\u0085", "\x1c", "é", "🙂", "1234", "!!", "-", "ǅ", "x" * 40]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert counter.count(text)[0] == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_long_texts_are_cut_where_nothing_goes_on(library):
    vocabulary = tokencount.read_vocabulary(BYTE_TOKENIZER)
    small = tokencount.TokenCounter(vocabulary, tokencount.prove(vocabulary), tokencount.TokenCountConfig(piece=7, remembered=20, word_chars=6))
    rng = random.Random(6)
    for _ in range(100):
        text = "".join(rng.choice(["word", " ", "  ", "\n", " é", "'ll", "12", "...", "<|endoftext|>", "y" * 30]) for _ in range(40))
        assert "".join(tokencount.pieces(text, 7)) == text
        assert small.count(text)[0] == len(library.encode(text, add_special_tokens=False).ids)
    assert small.count("z" * 200_000)[0] == len(library.encode("z" * 200_000, add_special_tokens=False).ids)


def test_counts_of_hard_rows(spark):
    kind = "doc_id long, text string, id string, n_tokens int, n_bytes string"
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (4, " " * 100_000), (5, "ab " * 300_000)]
    got = tokencount.count_tokens(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], kind), BYTE_TOKENIZER).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got)[:4] == [(0, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False)]
    assert len(got) == 6 and {r.doc_id: r.over_limit for r in got}[5]
    assert tokencount.count_tokens(spark.createDataFrame([], kind), BYTE_TOKENIZER).count() == 0
    with pytest.raises(ValueError, match="kind"):
        tokencount.read_vocabulary(TOKENIZER)


# Repair of conversations


def damage(rows):
    """The rows (turn, role, text) of each conversation after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        name = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        if k:
            out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        full = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits of each row, with every short run of insertions before, between and after."""
    runs = ["", "u", "a", "ua", "au"]
    edits = []
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        more = fault == "truncated"
        can = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            can += [("K", more, (role, text)), ("R", 2 + more, ("user", text)), ("R", 2 + more, ("assistant", text))]
        edits.append(can)
    best = None
    for choice in itertools.product(*edits):
        for gaps in itertools.product(runs, repeat=len(rows) + 1):
            said, audit, cost = [], "", 0
            for gap, edit in itertools.zip_longest(gaps, choice):
                said += [("user" if c == "u" else "assistant", "") for c in gap]
                audit, cost = audit + "I" * len(gap), cost + 2 * len(gap)
                if edit:
                    audit, cost = audit + edit[0], cost + edit[1]
                    said += [edit[2]] if edit[2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in said)):
                best = min(best, (cost, audit, said)) if best else (cost, audit, said)
    return best


def plain_audit(rows):
    """The same for conversations of any length, by a table over the states of the sequence read so far."""
    states = {"": (0, "", [])}

    def more(found):
        for _ in range(3):
            for q, (cost, audit, said) in list(found.items()):
                role = "assistant" if q == "u" else "user"
                new = (cost + 2, audit + "I", [*said, (role, "")])
                if role[0] not in found or new[:2] < found[role[0]][:2]:
                    found[role[0]] = new
        return found

    states = more(states)
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        after = {}
        for q, (cost, audit, said) in states.items():
            tries = [(q, cost + 3, "D", None)]
            if fault not in ("blank", "duplicate"):
                extra, want = fault == "truncated", "assistant" if q == "u" else "user"
                tries.append((want[0], cost + 2 + extra, "R", (want, text)))
                if role[:1] == want[0] or role[:1] == "s" and q == "":
                    tries.append((role[0], cost + extra, "K", (role, text)))
            for to, c, letter, row in tries:
                new = (c, audit + letter, said + [row] if row else said)
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        states = more(after)
    return min((states[q] for q in ("", "a") if q in states), key=lambda x: x[:2])


def report(rows, cost, audit, said):
    turns = [t for t, _, _ in rows if t is not None]
    found = faults(rows)
    initials = [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def as_rows(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_cheapest_edits_by_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "no", "", "What?"])) for i in range(rng.randrange(4))]
        cost, audit, said = cheapest(rows)
        tokens = [(r[:1], f) for (_, r, _), f in zip(rows, faults(rows), strict=True)]
        assert turnrepair.parse(tokens) == (cost, audit)
        assert turnrepair.apply(audit, [(r, t) for _, r, t in rows])[0] == said == plain_audit(rows)[2]


def test_long_charts():
    rng = random.Random(2)
    for n in (70, 200, 513):
        rows = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "", "What?", f"{i}."])) for i in range(n)]
        tokens = [(r[:1], f) for (_, r, _), f in zip(rows, faults(rows), strict=True)]
        assert turnrepair.parse(tokens) == plain_audit(rows)[:2]


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = {c: report(r, *plain_audit(r)) for c, r in damage(rows).items()}
    assert as_rows(QUERIES["op13_turn_repair"](spark, SF)) == expected


def test_conversations_in_segments(spark):
    """Long conversations, in ranges and segments of few rows, give what they give as a whole."""
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(["Yes.", "no", "", None, "What?", f"{i}."])) for c, n in ((1, 160), (2, 3), (None, 40), (3, 1), (4, 90)) for i in range(n)]
    expected = {c: report(r, *plain_audit(r)) for c, r in damage(rows).items()}
    table = spark.createDataFrame([(*r, 7, "x", True) for r in rows], "conv_id long, turn long, role string, text string, seg long, audit string, is_open boolean")
    for cfg in (turnrepair.RepairConfig(segment_rows=7, ranges=5), turnrepair.RepairConfig(segment_bytes=300, ranges=1), turnrepair.RepairConfig()):
        assert as_rows(turnrepair.with_digests(turnrepair.repair(turnrepair.damaged(table), cfg))) == expected
    done = turnrepair.repair(turnrepair.damaged(table), turnrepair.RepairConfig(segment_rows=7, ranges=5))
    said = defaultdict(list)
    for r in done.turns.orderBy("part").collect():
        said[r.conv_id] += [(t.role, t.text) for t in r.turns]
    assert said == {c: plain_audit(r)[2] for c, r in damage(rows).items()}
    assert done.report.count() == 5


def test_conversations_of_equal_rows(spark):
    """A key with most rows is dealt out, and its rows are equal in all."""
    table = spark.range(3000).select(F.lit(1).alias("conv_id"), F.lit(None).cast("int").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    got = as_rows(turnrepair.with_digests(turnrepair.repair(turnrepair.undamaged(table), turnrepair.RepairConfig(segment_rows=100, ranges=8))))
    assert got == {1: (0, 0, 2999, 0, 2999, 2999 * 3 + 2, "D" * 0 + "K" + "D" * 2999 + "I", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())}


def test_repair_of_hard_rows(spark):
    kind = "conv_id long, turn int, role string, text string"
    empty = turnrepair.with_digests(turnrepair.repair(turnrepair.damaged(spark.createDataFrame([], kind))))
    assert empty.count() == 0 and empty.columns == ["conv_id", *NAMES]
    gone = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    long = "x" * 3_000_000
    rows = [(9, gone, "user", "Hi."), (1, None, None, None), (2, 1, "user", long), (2, 2, "assistant", long + "."), (None, None, "system", "S.")]
    got = as_rows(turnrepair.with_digests(turnrepair.repair(turnrepair.damaged(spark.createDataFrame(rows, kind)))))
    assert got == {c: report(r, *plain_audit(r)) for c, r in damage(rows).items()}
    assert got[9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
