"""Legacy archive converter: ARC files in, equivalent WARC files out.

ARC.  An archive opens with a ``filedesc://`` record whose body names the version
and the fields of each record's header line.  Version 1 has five fields (URL,
IP-address, Archive-date, Content-type, Archive-length), version 2 ten (with
Result-code, Checksum, Location, Offset, Filename before the length).  A record
is its header line, the declared number of bytes, and a line end.

WARC.  Each document becomes a record with an identifier made from its page id,
a WARC-Date from the 14-digit ARC date, a type and SHA-1 digests.  Of records
with equal payloads of ``least`` or more bytes, that with the smallest page id
is the response; the others are revisits without payload that refer to it.

Archives are gzip files in the shared folder, written by Spark.  A record's end,
CR LF CR LF, serves as the text writer's line separator, so any file system
that Spark knows will do.  Readers go by declared lengths alone.

Defined results: null html is an empty payload, a null url an empty target; rows
that repeat page id and payload are alike (all responses if the id is the
smallest); a null page id sorts last and is its own identifier; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path

CRLF = "\r\n"
_V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
_V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_ARC_BYTES = 1 << 20
NULL_ID = -(1 << 63)


# ---------------------------------------------------------------- ARC


def arc_opening(version: int, name: str, date: str = "20200101000000") -> bytes:
    """The ``filedesc://`` record that opens an archive."""
    fields = {1: _V1_FIELDS, 2: _V2_FIELDS}[version]
    body = f"{version} 0 legacy\n{fields}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        head += f" 200 - - 0 {name}"
    return f"{head} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes, kind: str = "text/html") -> bytes:
    """One document: header line, content, line end.  White space in a URL is percent-coded."""
    target = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    head = f"{target} 0.0.0.0 {date} {kind}"
    if version == 2:
        head += f" 200 {hashlib.md5(content).hexdigest()} - 0 -"
    return f"{head} {len(content)}\n".encode("utf-8", "surrogatepass") + content + b"\n"


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an archive; the opening record tells which header fields follow."""
    line, at = _line(data, 0)
    opening = line.split(" ")
    if not opening[0].startswith("filedesc://"):
        raise ValueError("an ARC file opens with a filedesc record")
    size = _declared(opening[-1])
    body = data[at : at + size].decode()
    version, names = body.split(" ", 1)[0], body.split("\n")[1].split(" ")
    if (version, len(names)) not in (("1", 5), ("2", 10)):
        raise ValueError(f"ARC version {version} with {len(names)} fields is unknown")
    at += size + 1
    while at < len(data):
        line, at = _line(data, at)
        parts = line.split(" ")
        if len(parts) != len(names):
            raise ValueError(f"header line of {len(parts)} fields, {len(names)} declared")
        record = dict(zip(names, parts, strict=True))
        size = _declared(record["Archive-length"])
        if at + size > len(data):
            raise ValueError("a record is shorter than declared")
        content = data[at : at + size]
        if version == "2" and record["Checksum"] not in ("-", hashlib.md5(content).hexdigest()):
            raise ValueError("checksum does not match")
        yield record | {"content": content}
        at += size + 1


def _line(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\n", at)
    if end < 0:
        raise ValueError("truncated header line")
    return data[at:end].decode("utf-8", "surrogatepass"), end + 1


def _declared(text: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise ValueError(f"declared length {text!r} is no number")
    return int(text)


# ---------------------------------------------------------------- WARC


def record_id(page_id: int, payload_sha1: bytes) -> str:
    """A version-8 UUID: 48 bits of the digest, then the page id's 64 bits around the fixed fields."""
    u = page_id & (1 << 64) - 1
    value = int.from_bytes(payload_sha1[:6]) << 80 | 8 << 76 | (u >> 62) << 64 | 2 << 62 | u & (1 << 62) - 1
    h = f"{value:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(record: str) -> int:
    value = int(record[10:-1].replace("-", ""), 16)
    u = (value >> 64 & 3) << 62 | value & (1 << 62) - 1
    return u - (1 << 64) if u >> 63 else u


def warc_date(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def warc_record(page_id: int, url: str, arc_date: str, http_head: bytes, payload: bytes, sha1: bytes, refers_to: int | None, refers_sha1: bytes | None = None) -> bytes:
    """A response record, or a revisit of ``refers_to``; without the closing CR LF CR LF."""
    block = http_head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha1)}",
        f"WARC-Date: {warc_date(arc_date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{b32(sha1)}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: {record_id(refers_to, sha1)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return (CRLF.join(lines) + CRLF * 2).encode("utf-8", "surrogatepass") + block


def read_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record, by declared lengths; block digests are checked."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError("no WARC record where one should begin")
        lines = data[at:end].decode("utf-8", "surrogatepass").split(CRLF)
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = _declared(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is shorter or longer than declared")
        if f"sha1:{b32(hashlib.sha1(block).digest())}" != headers["WARC-Block-Digest"]:
            raise ValueError("block digest does not match")
        yield headers, block
        at = end + 8 + size


# ---------------------------------------------------------------- tables


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(archive binary): each partition's pages as gzipped ARC files of about 1 MB, versions 1 and 2 in turn.

    The stored content is an HTTP response whose headers carry the page id.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), F.coalesce("url", F.lit("")), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, made, size = 1, [], 0

        def closed():
            whole = gzip.compress(arc_opening(version, "legacy.arc") + b"".join(made), 1, mtime=0)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["archive"])

        for batch in batches:
            for page, url, html in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                body = html.as_py()
                i = NULL_ID if page.as_py() is None else page.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {i}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                made.append(arc_record(version, url.as_py(), "20200101000000", head + body))
                size += len(made[-1])
                if size >= _ARC_BYTES:
                    yield closed()
                    version, made, size = 3 - version, [], 0
        if made:
            yield closed()

    return rows.mapInArrow(run, "archive binary")


def convert(archives: DataFrame) -> DataFrame:
    """ARC archives -> (page_id, url, arc_date, head, payload, sha1), a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                out = []
                for r in read_arc(gzip.decompress(archive.as_py())):
                    head, _, payload = r["content"].partition(b"\r\n\r\n")
                    page = int(re.search(rb"X-Page-Id: (-?\d+)", head)[1])
                    out.append((page, r["URL"], r["Archive-date"], head + b"\r\n\r\n", payload, hashlib.sha1(payload).digest()))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=["page_id", "url", "arc_date", "head", "payload", "sha1"],
                    )

    return archives.mapInArrow(run, "page_id bigint, url string, arc_date string, head binary, payload binary, sha1 binary")


def decide(ids: DataFrame, least: int) -> DataFrame:
    """(page_id, sha1, n) -> (d_page, d_sha1, refers_to), one row per page id and digest.

    Digests are salted on the way back, so copies of one payload spread out.
    """
    distinct = ids.groupBy("page_id", "sha1", "n").count()
    order = F.when(F.col("page_id") == NULL_ID, None).otherwise(F.col("page_id"))
    first = distinct.filter(F.col("n") >= least).groupBy("sha1", "n").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("pages"))
    shared = first.filter("pages > 1").select("sha1", "n", F.coalesce("first", F.lit(NULL_ID)).alias("first"))
    salts = 32
    spread = shared.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = distinct.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["sha1", "n", "salt"], "left").select(
        F.col("page_id").alias("d_page"), F.col("sha1").alias("d_sha1"),
        F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"),
    )


def write_warc(archives: DataFrame, path: str, least: int = 0, records_per_file: int = 1000) -> None:
    """Convert stored ARC archives to WARC files under ``path``: once for the ids, once for the payloads."""
    records = convert(archives)
    ids = cut(records.select("page_id", "sha1", F.octet_length("payload").alias("n")), "ids")
    verdict = decide(ids, least)
    joined = records.join(verdict, (records.page_id == verdict.d_page) & (records.sha1 == verdict.d_sha1)).select(
        "page_id", "url", "arc_date", "head", "payload", "sha1", "refers_to"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                rows = batch.slice(k, 128).to_pylist()
                made = [warc_record(r["page_id"], r["url"], r["arc_date"], r["head"], r["payload"], r["sha1"], r["refers_to"]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    made = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), a row per stored record.

    Length and digest of a response are those of its stored bytes; a revisit
    tells them in its headers.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for headers, block in read_warc(gzip.decompress(content.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    page, to = page_of(headers["WARC-Record-ID"]), None
                    if headers["WARC-Type"] == "response":
                        if len(payload) != size or b32(hashlib.sha1(payload).digest()) != told:
                            raise ValueError("payload does not match its headers")
                    else:
                        to = page_of(headers["WARC-Refers-To"])
                    out.append((None if page == NULL_ID else page, size, told, headers["WARC-Type"], None if to == NULL_ID else to))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                    )

    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages -> stored ARC archives -> WARC files -> rows read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(cut(pages_to_arc(pages), "arc"), path, least)
    return read_archives(spark, path)
