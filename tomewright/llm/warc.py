"""WARC archives: a writer with payload deduplication and a salvage reader.

Writer.  Records are plain WARC/1.1 text; the payload of a ``response`` is the
HTML in UTF-8 behind a minimal HTTP head.  Of the rows with equal payloads (of
at least ``min_bytes`` bytes) the one with the smallest page_id becomes the
response, the others become ``revisit`` records that name it.  Rows sharing
that smallest page_id are all responses; a null page_id counts behind all
others.  Null HTML is an empty payload, a null url an empty target.  Columns
other than page_id, url, html are ignored.  Payloads of like size share files,
so many to a file that it stays near FILE_BYTES.  The archives are written by
Spark's text writer, so a lost or repeated task leaves no trace, on any file
system Spark knows; an empty table gives an empty archive.

Reader.  Files of any name are read whole by Spark (so each must stay below
2 GB) and may be plain or gzip with one member per record.  A record is taken if its
version line, headers, Content-Length, closing blank lines and, where it can
be computed, its payload digest hold.  After a failed check the reader looks
for the next valid gzip member or version line behind the failed start, goes
on there, and logs the bytes between as a gap with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.common import byte_rows, map_batches
from tomewright.session import cut_lineage

EOL = "\r\n"
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
MEMBER = b"\x1f\x8b\x08"
FILE_BYTES = 64 << 20           # about what a file holds
TIERS = (32 << 10, 256 << 10, 2 << 20)      # payload bytes up to which records share a file size
MEMBER_BYTES = 1 << 30          # a gzip member that unpacks to more is taken for damaged
BROADCAST_DIGESTS = 200_000     # repeated digests are broadcast up to this count, about 20 MB
RECORDS = ("path string, offset long, length long, status string, reason string, record_type string, page_id string, "
           "url string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digests(pages: DataFrame) -> DataFrame:
    """Add payload_bytes and payload_digest (base32 SHA-1) to page_id, url, html."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, off = byte_rows(b.column(2))
        parts = [raw[x:y].tobytes() for x, y in zip(off[:-1], off[1:])]
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array([len(p) for p in parts], pa.int64()),
             pa.array([payload_digest(p) for p in parts])], names=["page_id", "url", "html", "payload_bytes", "payload_digest"])
    cols = pages.select("page_id", "url", "html")
    return map_batches(cols, run, "html", f"page_id {cols.schema['page_id'].dataType.simpleString()}, url string, html string, "
                                          "payload_bytes long, payload_digest string")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Decide response or revisit: adds ``refers_to`` (null on a response)."""
    d = digests(pages)
    # one narrow row per digest, combined before the shuffle; only payloads that several rows hold are joined back
    first = cut_lineage(digests(pages).where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    if first.count() <= BROADCAST_DIGESTS:          # else the pages are shuffled by digest, skewed ones split by AQE
        first = F.broadcast(first)
    j = d.join(first, "payload_digest", "left")
    return j.withColumn("refers_to", F.when(F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")),
                                            F.col("_first"))).drop("_first")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 2000) -> None:
    """Write the archive of all rows below ``path``, at most ``records_per_file`` and about FILE_BYTES to a file."""
    size = F.octet_length(F.coalesce(F.col("html"), F.lit("")))
    tier = F.coalesce(*[F.when(size <= t, F.lit(i)) for i, t in enumerate(TIERS)], F.lit(len(TIERS)))
    most = {r["tier"]: r["most"] for r in pages.groupBy(tier.alias("tier")).agg(F.max(size).alias("most")).collect()}
    rows = plan_records(pages, min_bytes)
    for k in sorted(most) or [0]:
        records = max(min(records_per_file, FILE_BYTES // max(TIERS[k] if k < len(TIERS) else most[k], 1)), 1)
        _write_records(rows.where(tier == k) if len(most) > 1 else rows, path, records)


def _write_records(rows: DataFrame, path: str, records_per_file: int) -> None:
    revisit = F.col("refers_to").isNotNull()
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]", "")
    name = lambda c: F.concat(F.lit("<urn:page:"), text(c), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(EOL * 2))
    block = F.concat(head, F.when(revisit, "").otherwise(F.coalesce(F.col("html"), F.lit(""))))
    record = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{EOL}WARC-Record-ID: "), name("page_id"), F.lit(f"{EOL}WARC-Target-URI: "), text("url"),
        F.lit(f"{EOL}WARC-Date: 2000-01-01T00:00:00Z{EOL}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{EOL}WARC-Refers-To: "), name("refers_to"), F.lit(
            f"{EOL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"{EOL}Content-Type: application/http; msgtype=response{EOL}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(EOL * 2), block)
    (rows.select(record.alias("value")).write.mode("append").option("lineSep", EOL * 2)
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the offset behind it; ValueError names the failed check."""
    m = VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    stop = re.compile(rb"\r?\n\r?\n").search(data, m.end() - 2)
    if not stop:
        raise ValueError("headers don't end")
    fields = {}
    for line in data[m.end():stop.start()].decode("utf-8", "replace").splitlines():
        k, sep, v = line.partition(":")
        if not sep:
            raise ValueError("bad header line")
        fields[k.strip().lower()] = v.strip()
    if not fields.get("content-length", "").isdecimal():
        raise ValueError("no content length")
    end = stop.end() + int(fields["content-length"])
    if end > len(data):
        raise ValueError("record is cut off")
    tail = re.compile(rb"\r?\n\r?\n").match(data, end)
    if not tail:
        raise ValueError("no blank lines at the end")
    head, sep, payload = data[stop.end():end].partition(b"\r\n\r\n")
    if not sep:
        head, payload = b"", data[stop.end():end]
    length = re.search(rb"(?i)content-length:\s*(\d+)", head)
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    if kind == "response" and digest and digest != payload_digest(payload):
        raise ValueError("payload digest differs")
    bare = lambda s: re.sub(r"^<urn:page:(.*)>$", r"\1", s)
    return {"record_type": kind, "page_id": bare(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri", ""),
            "refers_to": bare(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
            "payload_bytes": int(length[1]) if kind == "revisit" and length else len(payload),
            "payload_digest": digest or payload_digest(payload), "payload": payload}, tail.end()


def unzip_member(data: bytes, at: int, step: int = 1 << 14) -> tuple[bytes, int]:
    """The gzip member at ``at`` unpacked, and the offset behind it; only its own bytes are read."""
    if data[at:at + 3] != MEMBER:
        raise ValueError("no gzip member")
    z, view, out, size, end = zlib.decompressobj(31), memoryview(data), [], 0, at
    while not z.eof and end < len(data):
        part = view[end:end + step]
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            raise ValueError(f"gzip: {e}") from None
        end += len(part)
        step = min(2 * step, 1 << 20)
        if (size := size + len(out[-1])) > MEMBER_BYTES:
            raise ValueError("member is too large")
    if not z.eof:
        raise ValueError("member is cut off")
    return b"".join(out), end - len(z.unused_data)


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one file, in order; offsets count bytes of the file."""
    zipped, at, bad, why = MEMBER in data[:3] or (not VERSION.search(data) and MEMBER in data), 0, None, ""
    while at < len(data):
        try:
            if zipped:
                plain, end = unzip_member(data, at)
                rec, used = parse_record(plain, 0)
                if used != len(plain):
                    raise ValueError("bytes behind the record")
            else:
                rec, end = parse_record(data, at)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            if zipped:
                at = data.find(MEMBER, at + 1)
            else:
                m = VERSION.search(data, at + 1)
                at = m.start() if m else -1
            if at < 0:
                break
            continue
        if bad is not None:
            yield {"offset": bad, "length": at - bad, "status": "gap", "reason": why}
            bad = None
        yield {"offset": at, "length": end - at, "status": "record", **rec}
        at = end
    if bad is not None:
        yield {"offset": bad, "length": len(data) - bad, "status": "gap", "reason": why}


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records (status 'record') and quarantined byte gaps (status 'gap') of all files below ``path``."""
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in
                        (c.strip().split(" ") for c in RECORDS.split(","))])

    def run(it):
        for b in it:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for r in salvage(data.as_py()):
                    rows.append({"path": name, **r})
                    size += len(r.get("payload") or b"")
                    if size > (8 << 20):
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)
