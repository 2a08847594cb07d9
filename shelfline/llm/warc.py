"""WARC archives in which equal payloads stand once.

A *crawl* is a written table with one row per record: row (its identity), page_id,
url, payload, payload_bytes, payload_digest (SHA-256, lower-case hex), revisits.

``from_pages`` and ``from_archives`` make a crawl.  ``write`` resolves revisits:
headers alone (row, page_id, digest) are shuffled by the payload digest, each
digest with several rows finds its original, and the rows that revisit one are
handed back to the crawl.  Archives get fresh headers; of equal payloads one is
written.  ``records`` reads archives, ``resolved`` joins revisit records to the
responses they refer to.

Archives are written by Spark's text writer, so they lie wherever Spark can write
and a lost task leaves nothing behind: a record's two closing line ends are the
separator.  Each file is one gzip stream.  They are read as a stream of lines from
which records are cut by their Content-Length, so a task holds one batch of lines
and one record, whatever the file's size.

Defined cases: a null html or url is empty; an empty url has no target header.
Payloads under LEAST bytes are responses, equal ones too.  The original is the
response with the smallest page_id, null last, then the first row.  Rows that
repeat a page_id are records of their own.  A revisit in a source archive whose
original is not there stays a revisit of the id it names, without a known size.
A digest that does not fit its payload, and a broken record, raise.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfline.session import written

from .groups import with_groups

#: Bytes from which equal payloads are written once.
LEAST = 100
#: Revisits up to which their list (24 bytes each) is sent to the tasks that write; a longer one is shuffled.
SENT_ROWS = 500_000
#: Bytes of payloads that are handed on at a time.
BATCH_BYTES = 8 << 20
END = "\r\n"

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT = "application/http;msgtype=response"

RECORD = ("record_id string, record_type string, page_id long, url string, refers_record string, "
          "payload binary, payload_bytes long, payload_digest string")


# -- writing -------------------------------------------------------------------


def from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"),
        payload.alias("payload"))
    return _crawl(rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"),
                              F.sha2("payload", 256).alias("payload_digest"), F.lit(None).cast("string").alias("revisits")))


def from_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of archives, revisits too, to be written anew."""
    found = records(spark, path)
    return _crawl(found.select("page_id", "url", "payload", "payload_bytes", "payload_digest",
                               F.col("refers_record").alias("revisits")))


def _crawl(rows: DataFrame) -> DataFrame:
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "warc-crawl")


def _record_id(row: Column, digest: Column) -> Column:
    hashed = F.sha2(F.concat_ws(":", row.cast("string"), digest), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.substring(hashed, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def revisits(crawl: DataFrame) -> DataFrame:
    """row, original: the rows that repeat another row's payload."""
    heads = crawl.where(F.coalesce("payload_bytes", F.lit(LEAST)) >= LEAST).select(
        "row", "page_id", "payload_digest", F.col("payload").isNull().alias("bare"))
    # The row with the payload and the smallest page_id; combined before the shuffle.
    first = F.min(F.struct("bare", F.col("page_id").isNull().alias("unknown"), "page_id", "row"))
    groups = written(
        heads.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .where("group_size > 1 AND NOT first.bare")
        .select("payload_digest", "group_size", F.col("first.row").alias("original")), "warc-groups")
    return with_groups(heads.select("row", "payload_digest"), groups, "payload_digest").where(
        "original IS NOT NULL AND row <> original").select("row", "original")


def _clean(url: Column) -> Column:
    """A url that stays whole in its header line."""
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _header(name: str, value: Column) -> Column:
    """One header line; null without a value, and then left out."""
    return F.concat(F.lit(f"{name}: "), value)


def write(crawl: DataFrame, path: str, date: Column | None = None) -> None:
    """Archives of ``crawl`` below ``path``."""
    known = written(revisits(crawl), "warc-revisits")
    few = known.count() <= SENT_ROWS
    rows = crawl.join(F.broadcast(known) if few else known, "row", "left")
    date = F.date_format(F.current_timestamp() if date is None else date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    repeated = F.col("original").isNotNull() | F.col("payload").isNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"),
                    F.coalesce(_header("Content-Length", F.concat(F.col("payload_bytes").cast("string"), F.lit(END))), F.lit("")),
                    F.lit(END))
    body = F.when(repeated, F.lit(b"")).otherwise(F.col("payload"))
    refers = F.when(F.col("original").isNotNull(), _record_id(F.col("original"), F.col("payload_digest"))).otherwise(F.col("revisits"))
    head = F.concat_ws(
        END, F.lit(VERSION), _header("WARC-Type", F.when(repeated, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _record_id(F.col("row"), F.col("payload_digest"))),
        _header("WARC-Date", date), _header("WARC-Target-URI", F.nullif(_clean(F.col("url")), F.lit(""))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(repeated, _header("WARC-Profile", F.lit(PROFILE))), F.when(repeated, _header("WARC-Refers-To", refers)),
        _header("X-Page-ID", F.col("page_id").cast("string")), _header("Content-Type", F.lit(CONTENT)),
        _header("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")))
    record = F.concat(head.cast("binary"), F.lit((END * 2).encode()), http.cast("binary"), body)
    rows.select(record.cast("string").alias("value")).write.option("compression", "gzip").option(
        "lineSep", END * 2).text(path)


# -- reading -------------------------------------------------------------------


def _parsed(stream: bytearray, file: str) -> Iterator[tuple]:
    """The whole records at the front of ``stream``, which keeps the rest."""
    at = 0
    while True:
        while stream[at:at + 1] in (b"\r", b"\n"):
            at += 1
        gap = stream.find(b"\r\n\r\n", at)
        if gap < 0:
            break
        first, *lines = bytes(stream[at:gap]).decode("utf-8", "replace").split(END)
        if not first.startswith("WARC/1."):
            raise ValueError(f"{file}: no record begins with {first[:40]!r}")
        head = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        if len(stream) < gap + 4 + size:
            break
        block = bytes(stream[gap + 4:gap + 4 + size])
        at = gap + 4 + size
        kind = head.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        payload, named = None, head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
            digest = hashlib.sha256(payload).hexdigest()
            if named is not None and len(named) == 64 and named != digest:
                raise ValueError(f"{file}: the payload of {head.get('warc-record-id')} does not fit its digest")
            named = digest
        page = head.get("x-page-id")
        yield (head.get("warc-record-id"), kind, None if page is None else int(page), head.get("warc-target-uri", ""),
               head.get("warc-refers-to"), payload, None if payload is None else len(payload), named)
    del stream[:at]


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of the archives below ``path``."""
    kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                       ("url", pa.string()), ("refers_record", pa.string()), ("payload", pa.binary()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def whole(rest: bytearray, file: str) -> None:
        if rest.strip(b"\r\n"):
            raise ValueError(f"{file}: the last record is not whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, current, rows, held = bytearray(), None, [], 0
        for batch in batches:
            files = batch.column(1).dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero(np.diff(files, prepend=-1, append=-1)).tolist()
            for a, b in zip(cuts, cuts[1:]):
                file = batch.column(1)[a].as_py()
                if batch.column(2)[a].as_py():
                    raise ValueError(f"{file}: only a gzip archive may be longer than a partition of files")
                if file != current:
                    whole(stream, current)
                    stream, current = bytearray(), file
                stream += b"\n".join(batch.column(0).slice(a, b - a).to_pylist()) + b"\n"
                for row in _parsed(stream, file):
                    held += len(row[5] or b"")
                    rows.append(row if payloads else (*row[:5], None, *row[6:]))
                    if held >= BATCH_BYTES:
                        yield table(rows)
                        rows, held = [], 0
            if rows:
                yield table(rows)
                rows, held = [], 0
        whole(stream, current)

    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    return lines.mapInArrow(run, RECORD)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of every record.

    Size and digest of a revisit are those of the response it refers to.
    """
    heads = written(records(spark, path, payloads=False).drop("payload"), "warc-heads")
    found = heads.where("record_type = 'revisit'")
    wanted = found.groupBy("refers_record").agg(F.count(F.lit(1)).alias("group_size"))
    originals = heads.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"))
    groups = written(wanted.join(originals, "refers_record"), "warc-originals")
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    revisited = with_groups(found, groups, "refers_record").withColumns({
        "payload_bytes": F.col("full_bytes"), "payload_digest": F.coalesce("full_digest", "payload_digest")})
    return heads.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(
        columns).unionByName(revisited.select(columns))
