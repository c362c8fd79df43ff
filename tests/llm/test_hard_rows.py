"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names, for every operator and stage."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import bpe, chat, dartminhash, decontam, itq, langid, pii, quality, urlfilter, warc
from tapeloom.llm.probe import Tally
from tapeloom.llm.queries import TOKENIZER, URL_RULES

LONG = "alpha beta gamma delta " * 120_000
EXTRA = ", id long, row string, doc string, n int, u long, v long, block string, key string, band string, d0 int, a int, b int, cls int, text_ string, stats string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA
FILL = (9, "r", "d", 3, 1, 2, "k", "q", "z", 4, 5, 6, 7, "t", "s")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t), *FILL) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def hard(spark):
    body = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(1, None, "en"), (2, "", None), (3, LONG, "en"), (4, body, "en"), (4, body, "en"), (5, body, "en"), (None, body, None), (None, None, None), (6, "mail a@b.co or +1 234 567 8901", None), (7, "12 34", "de"), (8, "\u2028\ud7ff …", "en"), (9, "x" * 500_000, "en"), (10, "9" * 1_000_000 + ". 1.2.3.4", None)]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def labels(spark, rows=((4, 1, 0), (4, 0, 0), (3, None, None), (None, 1, 0), (99, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_near_duplicates(hard, none):
    got = {(r.doc_id, r.class_id, r.kept) for r in dartminhash.near_duplicates(hard).collect()}
    assert (5, 4, False) in got and (4, 4, True) in got and (1, 1, True) in got and (None, None, True) in got
    assert dartminhash.near_duplicates(hard).count() == hard.count() and dartminhash.near_duplicates(none).count() == 0


def test_quality(spark, hard, none):
    got = quality.classify(hard, labels(spark)).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(none, labels(spark)).count() == 0
    assert {r.score for r in quality.classify(hard, labels(spark, [])).collect()} == {0.5}
    assert quality.keep_good(hard, labels(spark, [])).count() == hard.count()


def test_bpe(hard, none):
    got = {r.doc_id: r for r in bpe.encode_documents(hard, TOKENIZER, digests=True).collect()}
    assert got[1].n_tokens == 0 == got[2].n_tokens and got[3].n_tokens == 480_000
    assert bpe.encode_documents(none, TOKENIZER).count() == 0


def test_language(hard, none):
    got = {r.doc_id: r for r in langid.identify(hard).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and got[3].lang_pred != "und"
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pii(hard, none):
    got = {r.doc_id: r for r in pii.find(hard).collect()}
    assert got[6].base == "email:5:11,phone:15:30" and got[1].spans == "" and len(got) == 11 and got[10].base == "ip:1000002:1000009"
    assert pii.find(none).count() == 0 == pii.sanitise(none).count()
    clean = {r.doc_id: r.text for r in pii.sanitise(hard).collect()}
    assert clean[6] == "mail [EMAIL] or [PHONE]" and clean[1] is None and clean[3] == LONG


def test_decontamination(spark, hard, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and"), (2, None), (3, ""), (3, "far away"), (None, "quick brown fox jumps over the lazy dog and")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(hard, items).collect()}
    assert {(4, 1), (5, 1), (None, 1), (4, 3), (5, None)} <= got and not any(i in (1, 2, 6) for i, _ in got)
    assert decontam.contaminated(none, items).count() == 0 == decontam.contaminated(hard, items.limit(0)).count()
    assert {r.doc_id for r in decontam.decontaminate(hard, items).collect()} & {4, 5} == set()


def test_vectors(spark):
    one = [0.5] * 8
    rows = [(1, one), (2, [x * 2 for x in one]), (3, None), (4, [0.0] * 8), (5, [float("nan")] * 8), (6, [None] + one[1:]), (7, [1.0, 2.0]), (8, one), (8, one), (None, one), (9, [-x for x in one])]
    frame = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cls int, key int, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_vectors(frame).collect()), key=str)
    assert (1, 3, 1, True) in got and (2, 3, 1, False) in got and (3, 0, 3, True) in got and (9, 0, 9, True) in got and (None, 0, None, True) in got and len(got) == 11
    assert itq.near_vectors(frame.limit(0)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.example.com/en/x?y"), (3, "http://WWW.example.com/en/x?y"), (4, "https://a.b.example.com/en/"), (5, "x://shop.com"), (None, "http://q.net/es/#a"), (6, "http://"), (7, "http://notexample.com/en/" + "z" * 200_000), (8, "http://" + "a." * 100_000 + "net/es/x"), (10, "https://www.site.org:443/p/index.html?s=1"), (11, "http://site.org/p/"), (12, "http://site.org/q"), (12, "http://site.org/q")]
    frame = spark.createDataFrame([(i, u, "h", "p", 1, 2) for i, u in rows], "page_id long, url string, host string, path string, row int, key int")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urlfilter.filter_urls(frame, rules).collect()}
    assert got[3] == ("www.example.com", "www.example.com/en/", "allow") and got[4][1:] == ("example.com/en/", "block") and got[5] == ("shop.com", None, "allow")
    assert got[None][2] == "block" and got[1] == ("", None, "allow") and got[7][1] == "com/"
    assert got[8][1:] == ("net/es/", "block")
    listed = urlfilter.several_spellings(frame)
    assert [r[0] for r in listed.collect()] == ["site.org/p"]
    by_list = {r.page_id: (r.verdict, r.listed) for r in urlfilter.filter_urls(frame, rules, listed).collect()}
    assert by_list[10] == by_list[11] == ("block", True) and by_list[12] == ("allow", False) and by_list[3] == ("allow", False) and by_list[1] == ("allow", False)
    assert urlfilter.several_spellings(frame.limit(0)).count() == 0 and urlfilter.filter_urls(frame, rules, listed.limit(0)).where("listed").count() == 0
    assert urlfilter.filter_urls(frame, rules).count() == 14 == urlfilter.filter_urls(frame, rules.limit(0)).count() and urlfilter.filter_urls(frame.limit(0), rules).count() == 0


def test_warc(spark):
    page = "<p>" + "w" * 200
    rows = [(1, "http://a", page), (2, None, page), (3, "u\r\nv", None), (4, "v", ""), (5, "w", "WARC/1.1\r\n\r\n" * 30), (6, "w", "é" * 3_000_000), (7, "z", "short"), (8, "z", "short"), (None, "q", page), (9, "d", page), (9, "d", page)]
    frame = spark.createDataFrame([(i, u, h, 1, 2) for i, u, h in rows], "page_id long, url string, html string, digest int, payload int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.n_requests, r.n_metadata) for r in warc.round_trip(frame).collect()), key=str)
    assert (1, 203, "response", None, 1, 1) in got and (2, 203, "revisit", 1, 1, 1) in got and got.count((9, 203, "revisit", 1, 1, 1)) == 2
    assert (3, 0, "response", None, 1, 1) in got and (6, 6_000_000, "response", None, 1, 1) in got and (8, 5, "response", None, 1, 1) in got and len(got) == 11
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "\\<|im_end|>\n"), (2, 0, "a\\n\nb", "<\\|" * 1000), (None, 0, "user", "x"), (3, 0, "assistant", "c" * 500_000)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, msg int, seq int")
    got = {r.conv_id: r for r in chat.format_conversations(frame).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[3].loss_chars == 500_000 and got[None].n_turns == 1
    turns = chat.read_back(chat.render(chat.fold(chat.events_from_rows(frame), chat.KEY), chat.KEY)).where("conv = 2").first().turns
    assert [(t.role, t.text) for t in turns] == [("", "\\<|im_end|>\n"), ("a\\n\nb", "<\\|" * 1000)]
    many = spark.createDataFrame([(7, k, "user", f"text {k}") for k in range(200)], frame.schema.fieldNames()[:4])
    kinds = {r.kind: r.n for r in chat.events_from_rows(many).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert min(kinds.get(k, 0) for k in ("start", "delta", "edit", "regenerate", "delete")) > 20
    assert chat.format_conversations(many).first().n_turns == 200
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_stages(spark, hard, none, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "something else entirely that nobody wrote down")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for frame in (hard, none):
            out = stage(spark, frame, str(tmp_path))
            n = out.count()
            assert n <= frame.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns
    kept = corpus_pipeline.drop_near_duplicates(spark, hard, str(tmp_path)).where("doc_id in (4, 5)").count()
    assert kept == 1
    # An id with two texts is two documents: neither goes for the other, nor do copies of either for the id.
    body = "one two three four five six seven eight nine ten eleven twelve"
    two = docs(spark, [(1, body, None), (1, body[::-1], None), (1, body, None), (2, body[::-1], None), (3, body + " more", None), (4, "z", None)])
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, two, str(tmp_path)).collect())
    assert left == sorted([(1, body), (1, body[::-1]), (4, "z")])


@pytest.mark.parametrize(("url", "canonical"), [("http://a.com/x" + "/" * 1_000_000, "a.com/x"), ("http://a.com" + "." * 1_000_000, "a.com"), ("http://a.com/" + "/x" * 500_000, "a.com/" + "/x" * 500_000), ("http://" + "a." * 500_000 + "com/", "a." * 500_000 + "com")])
def test_long_urls_in_linear_time(spark, url, canonical):
    host, path = urlfilter.split_url(F.col("url"))
    rows = spark.createDataFrame([(url,)], "url string")
    rows.select(urlfilter.canonical(host, path)).first()  # code is compiled
    began = time.perf_counter()
    assert rows.select(urlfilter.canonical(host, path)).first()[0] == canonical
    assert time.perf_counter() - began < 5


def test_record_keys_do_not_hang_on_partitions(spark, tmp_path):
    """A read that is split otherwise gives the same keys, so what a revisit names is there."""
    rows = [(i % 40, f"http://a.com/{i}", "x" * (150 + i % 7)) for i in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/pages")
    keys = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        keys.append(sorted(r.key for r in warc.plan_captures(spark.read.parquet(f"{tmp_path}/pages"))[0].select("key").collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert keys[0] == keys[1] and len(set(keys[0])) == 300
    shuffled = spark.read.parquet(f"{tmp_path}/pages").repartition(3)
    warc.write_archives(shuffled, f"{tmp_path}/warc")
    found = warc.read_records(spark, f"{tmp_path}/warc").where("kind in ('response', 'revisit')").collect()
    known = {r.record_id for r in found if r.kind == "response"}
    assert len(found) == 300 and all(r.refers_to in known for r in found if r.kind == "revisit") and len(known) < 300


def test_a_tally_that_was_just_emptied_keeps_its_types():
    """A task tells its sums in parts; where the last part is empty it has the types of the others, or Arrow refuses it."""
    tally = Tally(most=1)
    tally.add(np.arange(5, dtype=np.uint64), np.full(5, 0.5))
    assert tally.full
    first, last = tally.take(), tally.take()
    assert [x.dtype for x in first] == [x.dtype for x in last] == [np.uint64, np.float64] and (len(first[0]), len(last[0])) == (5, 0)
