r"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join (operator 8).

Two lists decide, each by a blocked Bloom filter of its keys and an exact hash join that removes
the filter's false positives.

Rules are a host and a path prefix with a verdict. A rule fits its host and all subdomains if the path
starts with its own; the longest wins, of equally long ones that with the longer host, between an
allow and a block of the same key, block. The candidate keys of a URL are the endings of its host with
as many labels as a listed host has, each with the path's beginnings of a listed length; no
other ending is ever built, so a host of very many labels costs no more than a short one.

Listed canonical URLs decide where no rule fits: their pages are blocked, all others get the
default. The canonical form of a URL is its host without a leading `www.` or `m.`, closing dots and a
port of 80 or 443, and its path without closing slashes after one closing `.html` or `index.html` is
taken off; scheme, query and fragment are left out. `several_spellings` learns a list from a table: the
canonical URLs that occur in it under two or more different URLs, as tracking parameters, mirrors and
session ids give rise to. The list grows with the table; its filter is broadcast only while it is below
the bound that bloom.py checks.

Defined cases: null or no "://" gives an empty host and path: no rule fits, and the canonical form is
null, which is never listed; null ids and repeated rows are kept; an empty table or empty lists work;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Canonical form: what is taken off hosts and paths, in this order. DuckDB reads the same patterns.
HOST_CUTS = (r"^(www|m)\.", r":(80|443)\z", r"\.+\z")
PATH_CUTS = (r"(index)?\.html\z", r"/+\z")
#: Patterns of one closing character: trimming takes it off in one pass, where the pattern would be tried from every place of a long run.
TRIMMED = {r"\.+\z": ".", r"/+\z": "/"}


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as defined above; only A-Z are lower-cased."""
    rest = F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.substr(url, F.locate("://", url) + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return F.translate(host, _UP, _LOW), path


def canonical(host: Column, path: Column) -> Column:
    """The canonical URL of a host and path; null without a host."""

    def without(part: Column, cuts: tuple[str, ...]) -> Column:
        for cut in cuts:
            part = F.rtrim(part, F.lit(TRIMMED[cut])) if cut in TRIMMED else F.regexp_replace(part, cut, "")
        return part

    return F.when(host != "", F.concat(without(host, HOST_CUTS), without(path, PATH_CUTS)))


def several_spellings(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(canonical) of the canonical URLs that occur under different URLs."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(url_col).alias("url"), canonical(host, path).alias("canonical")).where("canonical is not null")
    # The least and the largest hash differ if any two URLs do; both are combined before the shuffle, however common a URL is.
    spelt = F.xxhash64("url")
    return urls.groupBy("canonical").agg(F.min(spelt).alias("lo"), F.max(spelt).alias("hi")).where("lo != hi").select("canonical")


def _by_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, best) of the urls (row, host, path) that a rule fits."""
    listed = rules.select(F.concat("host", F.lit("\t"), "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), "verdict").groupBy("key", "rule", "host_len").agg(F.max("verdict").alias("verdict"))
    shapes = rules.select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("chars")).distinct().collect()  # of the list, which is a parameter
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in sorted({r["labels"] for r in shapes})]))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted({r["chars"] for r in shapes})])
    keys = urls.where("host != ''").select("row", "path", F.explode(hosts).alias("h")).select("row", "h", F.explode(prefixes).alias("p")).where("p is not null").select("row", F.concat("h", F.lit("\t"), "p").alias("key"))
    hits = bloom.maybe_in(keys, "key", bloom.build(listed, "key")).join(listed, "key")
    return hits.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule", "verdict")).alias("best"))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, listed) for each row; rules: (host, path, verdict); listed: (canonical)."""
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    ruled = urls.withColumn("best", F.lit(None).cast("struct<rule: string, verdict: string>")) if rules.isEmpty() else urls.join(_by_rule(urls.select("row", "host", "path"), rules), "row", "left")
    hit = F.lit(False)
    if listed is not None:
        key = listed.select(F.col("canonical").alias("key")).where("key is not null").distinct()
        open_ = urls.select("row", canonical(F.col("host"), F.col("path")).alias("key")).where("key is not null")
        found = bloom.maybe_in(open_, "key", bloom.build(key, "key")).join(key, "key").select("row", F.lit(True).alias("found"))
        ruled = ruled.join(found, "row", "left")
        hit = F.coalesce("found", F.lit(False))
    verdict = F.coalesce("best.verdict", F.when(hit, "block"), F.lit(default))
    return ruled.select(id_col, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), hit.alias("listed"))
