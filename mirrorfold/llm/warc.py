"""WARC archives: writing with revisit records, and a reader that salvages.

Records are gzip members, one each, written by Spark's own text writer (so a
lost task is simply run again) with one zero byte between members, which gzip
allows as padding. Equal payloads are stored once: the largest ``page_id``
becomes the response, the others revisit records that refer to it.

The reader takes compressed and plain archives. A record counts only if its
member or length, its end, its block digest and, for responses, its payload
digest and HTTP length are right. Where a check fails, it searches for the
next gzip member or version line that starts a valid record and goes on there;
the bytes between are returned as a gap with the reason. So damage costs the
records it touches and no others.

Null and empty payloads are empty payloads. Null ids sort below all others and
are written as "none". Repeated rows of the largest id are all responses. Line
breaks and control characters of URLs are percent-encoded. Empty tables write
no archive, and reading no archive gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from mirrorfold.llm.common import text_or_empty

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# At most so many records in one file.
MAX_ROWS = 10_000
FEED = 1 << 16

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
END = b"\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str,
           size: int, date: str = DATE) -> bytes:
    """One record, uncompressed; a revisit has the HTTP head of the page but no payload."""
    def name(i):
        return f"<urn:page:{'none' if i is None else i}>"

    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    uri = "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in (url or "about:blank").encode())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
             f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def write_archives(pages: DataFrame, folder: str) -> None:
    """A record for every row of ``pages`` into archives under ``folder``. *Action.*"""
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"))
    rows = rows.withColumn("payload_key", F.sha1(F.col("html").cast("binary")))
    # The response of each payload; minima and maxima combine before the shuffle, and the join can be split.
    chosen = rows.groupBy("payload_key").agg(F.max("page_id").alias("response_id"))
    put = rows.join(chosen, "payload_key").select("page_id", "url", "html", "response_id")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                for page, url, html, response in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    payload = html.encode()
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    made = record(page, url, payload, response, page != response, sha1_base32(payload), len(payload))
                    out.append(packer.compress(made) + packer.flush())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = put.mapInArrow(run, "member binary")
    # Cast to text, the bytes stay as they are.
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option(
        "compression", "none").option("maxRecordsPerFile", MAX_ROWS).text(folder)


class Broken(Exception):
    """A record that fails a check."""


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at``, and where it ends."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if pos >= len(data):
                raise Broken("member is cut off")
            piece = data[pos:pos + FEED]
            out.append(unpack.decompress(piece))
            pos += len(piece)
    except zlib.error as error:
        raise Broken(f"member: {error}") from None
    return b"".join(out), pos - len(unpack.unused_data)


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` of uncompressed bytes, checked, and where it ends."""
    if not re.fullmatch(rb"WARC/1\.[0-9]\r\n", data[at:at + 10]):
        raise Broken("no version line")
    stop = at + 8
    fields: dict[str, str] = {}
    name = ""
    # Line by line, so that a false start ends at its first line without a name, and a header may have any length.
    while True:
        begin = stop + 2
        stop = data.find(b"\r\n", begin)
        if stop < 0:
            raise Broken("no end of the header")
        if stop == begin:
            break
        line = data[begin:stop].decode(errors="replace")
        if line[:1] in (" ", "\t") and name:  # goes on with the line before
            fields[name] += f" {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Broken("header line without a name")
        fields[name] = value.strip()
    if not re.fullmatch("[0-9]{1,15}", fields.get("content-length", "")):
        raise Broken("no length")
    start = stop + 2
    end = start + int(fields["content-length"])
    if end + len(END) > len(data) or data[end:end + len(END)] != END:
        raise Broken("length is wrong or the record is cut off")
    block = data[start:end]
    if (said := fields.get("warc-block-digest")) and said != f"sha1:{sha1_base32(block)}":
        raise Broken("block digest is wrong")
    out = {"fields": fields, "payload": None, "http_length": None}
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(END)
        if found := re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,15})", http):
            out["http_length"] = int(found[1])
        if fields.get("warc-type") == "response":
            digest = f"sha1:{sha1_base32(payload)}"
            if fields.get("warc-payload-digest", digest) != digest or out["http_length"] not in (None, len(payload)):
                raise Broken("payload digest or HTTP length is wrong")
            out["payload"] = payload
    return out, end + len(END)


def salvage(data: bytes):
    """``(record, start, end, None)`` for every valid record of an archive and
    ``(None, start, end, reason)`` for every gap between them, in order."""
    view, at, bad, why = memoryview(data), 0, None, ""
    starts = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
    while at < len(data):
        if data[at] == 0 and bad is None:
            at += 1  # padding
            continue
        try:
            if data.startswith(MAGIC, at):
                content, end = _member(view, at)
                found, size = _parse(content, 0)
                if size != len(content):
                    raise Broken("more than one record in a member")
            else:
                found, end = _parse(data, at)
        except Broken as error:
            if bad is None:
                bad, why = at, str(error)
            hit = starts.search(data, at + 1)
            at = hit.start() if hit else len(data)
            continue
        if bad is not None:
            yield None, bad, at, why
            bad = None
        yield found, at, end, None
        at = end
    if bad is not None:
        yield None, bad, len(data), why


RECORD = ("path string, start bigint, end bigint, gap string, record_type string, page_id bigint, target_uri string, "
          "refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record and every gap of the archives under ``folder``; ``gap`` has the
    reason of a gap and is null for records. Archives are dealt out whole, so
    the writer keeps them small."""
    def number(value: str | None) -> int | None:
        found = re.search(r":(-?[0-9]+)>", value or "")
        return int(found[1]) if found else None

    def run(batches):
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for found, start, end, why in salvage(content):
                    if found is None:
                        rows.append((path, start, end, why, *[None] * 7))
                    else:
                        f = found["fields"]
                        digest = f.get("warc-payload-digest", "")
                        rows.append((path, start, end, None, f.get("warc-type"), number(f.get("warc-record-id")),
                                     f.get("warc-target-uri"), number(f.get("warc-refers-to")), digest.removeprefix("sha1:"),
                                     found["http_length"], found["payload"] if with_payload else None))
                    if len(rows) == 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)],
                                      names=[n for n, _ in columns])


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` as archives to ``folder`` and returns what the reader finds there;
    a gap in what was just written is an error. *Action.*"""
    write_archives(pages, folder)
    whole = F.expr("case when gap is null then true else raise_error(concat(path, ' at ', start, ': ', gap)) end")
    return read_archives(pages.sparkSession, folder, with_payload=False).filter(whole).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
