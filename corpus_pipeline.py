"""The corpus pipeline: each stage is one training-data operator, applied to all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next one's docs. All but the last return the columns
of documents. run(spark, sf_dir) applies them to the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bloom, bpe, dartminhash, decontam, pii, quality
from tapeloom.llm.queries import TOKENIZER
from tapeloom.llm.runtime import stage, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates. Of rows that repeat both id and text one stays; an id with several texts is as many documents."""
    again = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated", narrow=True)
    if not again.take(1):
        gone = stage(dartminhash.near_duplicates(docs).where("not kept").select("doc_id"), "copies", narrow=True)
        return bloom.without(docs, "doc_id", gone)
    key = F.when(F.col("doc_id").isNotNull(), F.concat(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    keyed = docs.withColumn("_key", key)
    gone = stage(dartminhash.near_duplicates(keyed, "_key").where("not kept").select("_key").distinct(), "copies", narrow=True)
    rest = keyed.join(gone, "_key", "left_anti").select(*docs.columns, "_key")
    once = rest.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(rest.join(again, "doc_id", "left_semi").dropDuplicates(["_key"]).select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and what reveals it replaced; n_chars follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and what they decode to, as digests."""
    return bpe.encode_documents(docs, TOKENIZER, digests=True, cfg=bpe.BpeConfig(cached=80_000, grouped=1 << 18, kept=False))  # beside what earlier stages leave in the executors


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", hide_pii),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express these stages; tests/llm holds it against the operators, and those against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
