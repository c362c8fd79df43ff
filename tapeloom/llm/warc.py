r"""WARC archives and transaction assembly (operator 2).

Writing: each page becomes a request, a response (or a revisit, if an equal payload of a
smaller page was stored) and a metadata record, tied by WARC-Concurrent-To. Records are
written by Spark's own text writer, whose committer makes retries safe on any file system;
the two line ends that close a record are its line separator. Files are gzip-compressed and
bounded in bytes: pages are written by classes of size, each with as many pages to a file as keep it
below FILE_BYTES uncompressed (a page beyond that has a file of its own), as each file is read as one
value. A revisit names the record that it refers to, so any reader can resolve it.

Reading: each file is parsed by declared lengths, record by record, never by searching its
payloads. Assembly then joins request, response and metadata records through their
concurrent-to identifiers and emits one nested row per capture. Payload bytes are hashed where
they are read; they travel only if asked for.

Defined cases: a null html is an empty payload; a null url or page_id is written as an empty
header and read back as null; empty and very long payloads are kept whole; every row is a
capture of its own, repeated rows too (record ids are unique); an empty table gives empty
archives and an empty result; columns beside page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .runtime import shared_path, stage

CRLF, CLOSE = "\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are stored again rather than revisited.
MIN_REVISIT_BYTES = 100
#: Uncompressed bytes of a file, and the payloads up to which a page is of each class of size.
FILE_BYTES = 256 << 20
CLASS_BYTES = (256 << 10, 4 << 20)


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, list[int]]:
    """Each page with its payload, digest, key and the page and key (or null) of the response that it revisits; and the largest payload of each class of size.

    The key of a row is its page, its file and its number in that file, so every read of the table gives the same,
    however it is split and whatever executors there are. A table that does not come from files is written to some first.
    """
    try:
        place = pages.select(id_col, url_col, html_col, F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit("."), F.col("_metadata.row_index").cast("string")).alias("_at"))
        place.schema  # analysed here
    except AnalysisException:
        return plan_captures(stage(pages.select(id_col, url_col, html_col), "pages"), id_col, url_col, html_col)
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    page = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = place.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.concat(page, F.lit(":"), "_at").alias("key"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    seen = Observation("warc-pages")
    edges = (0, *CLASS_BYTES, 1 << 62)
    of_class = [F.max(F.when((F.col("bytes") >= lo) & (F.col("bytes") < hi), F.col("bytes"))).alias(f"c{k}") for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    first = rows.observe(seen, *of_class).where(F.col("bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key"))).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = stage(first, "equal-payloads", narrow=True)  # its size is then known before the payloads are joined: small, it is broadcast and they stay in place
    largest = [-1 if seen.get[f"c{k}"] is None else seen.get[f"c{k}"] for k in range(len(of_class))]
    revisit = F.col("page_id") != F.col("first.page_id")
    return rows.join(first, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("first.key"))).drop("first"), largest


def _head(kind: str, rid: Column, extra: list[Column], block_bytes: Column, content_type: str) -> Column:
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    return F.concat(F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", rid), line("WARC-Date", F.lit("2024-01-01T00:00:00Z")), *extra, line("Content-Type", F.lit(content_type)), line("Content-Length", block_bytes.cast("string")), F.lit(CRLF))


def records(captures: DataFrame) -> DataFrame:
    """Three records per capture, one text value each, without the closing line ends."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")
    c = captures.withColumn("page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).withColumn("uri", clean(F.col("url")))
    rid = lambda part: F.concat(F.lit(f"<urn:{part}:"), F.col("key"), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CLOSE))
    revisit = F.col("refers_to").isNotNull()
    ask = F.concat(F.lit("GET "), F.col("uri"), F.lit(f" HTTP/1.1{CLOSE}"))
    note = F.concat(F.lit("page: "), F.col("page"), F.lit(CRLF))
    target = [line("WARC-Target-URI", F.col("uri"))]
    digest = [*target, line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))]
    body = F.col("payload").cast("string")
    response = F.concat(_head("response", rid("capture"), digest, F.octet_length(http) + F.col("bytes"), "application/http; msgtype=response"), http, body)
    again = F.concat(_head("revisit", rid("capture"), [*digest, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("refers_to"), F.lit(">")))], F.octet_length(http), "application/http; msgtype=response"), http)
    beside = [*target, line("WARC-Concurrent-To", rid("capture"))]
    request = F.concat(_head("request", rid("request"), beside, F.octet_length(ask), "application/http; msgtype=request"), ask)
    metadata = F.concat(_head("metadata", rid("metadata"), beside, F.octet_length(note), "application/warc-fields"), note)
    return c.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    captures, largest = plan_captures(pages, id_col, url_col, html_col)
    edges = (0, *CLASS_BYTES, 1 << 62)
    for k, most in enumerate(largest):
        if most >= 0 or k == 0:  # an empty table still gives archives
            each = max(1, FILE_BYTES // min(max(most, 1), edges[k + 1]) if k else FILE_BYTES // edges[1])
            part = captures.where((F.col("bytes") >= edges[k]) & (F.col("bytes") < edges[k + 1]))
            records(part).write.mode("append").option("lineSep", CLOSE).option("compression", "gzip").option("maxRecordsPerFile", 3 * each).text(path)
    return path


def _inflate(blob: bytes) -> Iterator[bytes]:
    """Pieces of a plain or gzip file, members joined."""
    if blob[:2] != b"\x1f\x8b":
        yield blob
        return
    rest = blob
    while rest:
        d = zlib.decompressobj(31)
        while rest and not d.eof:
            yield d.decompress(rest, 1 << 22)
            rest = d.unconsumed_tail if not d.eof else d.unused_data
        rest = rest.lstrip(b"\0")


def parse_records(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; header names in lower case. Memory: one record and a few MB."""
    pieces, buf = _inflate(blob), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        buf.extend(piece)
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("truncated WARC header")
                return
        lines = bytes(buf[:end]).decode("utf-8", "replace").lstrip("\r\n").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        while len(buf) < stop + 4 and more():
            pass
        if len(buf) < stop:
            raise ValueError("truncated WARC block")
        yield head, bytes(buf[end + 4 : stop])
        del buf[: stop + 4]


RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target_uri string, block_bytes long, payload_bytes long, payload_digest string, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under path. payload_bytes and payload_digest are of the full payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])
        for batch in batches:
            for blob in batch.column(0):
                rows, size = [], 0
                for head, block in parse_records(blob.as_py()):
                    kind, payload, n, digest = head.get("warc-type"), None, None, None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
                        if kind == "response":
                            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            if head.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
                                raise ValueError(f"payload digest of {head.get('warc-record-id')} does not match")
                        else:
                            n, digest = int(fields[b"content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                    rows.append((kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri") or None, len(block), n, digest, payload if with_payload else None))
                    size += len(block) if with_payload else 200
                    if size > 8 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").load(path).select("content").mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and the requests and metadata concurrent to it."""
    main = found.where("kind in ('response', 'revisit')").select(F.col("record_id").alias("capture"), F.struct("kind", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload").alias("response"))
    side = lambda kind: found.where(F.col("kind") == kind).groupBy(F.col("concurrent_to").alias("capture")).agg(F.collect_list(F.struct("record_id", "target_uri", "block_bytes")).alias(kind))
    return main.join(side("request"), "capture", "left").join(side("metadata"), "capture", "left")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives of pages to the shared folder, read them back and assemble the captures."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    path = write_archives(pages, shared_path(spark, "warc"), id_col, url_col, html_col)
    page = lambda c: F.when(F.regexp_extract(c, r"^<urn:[a-z]+:([^:>]*)", 1) != "", F.regexp_extract(c, r"^<urn:[a-z]+:([^:>]*)", 1)).cast(kind)
    done = assemble(stage(read_records(spark, path), "records"))  # parsed once for the three sides of the join
    return done.select(page(F.col("capture")).alias(id_col), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), page(F.col("response.refers_to")).alias("refers_to"), F.size("request").alias("n_requests"), F.size("metadata").alias("n_metadata"))
