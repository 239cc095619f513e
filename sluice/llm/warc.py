"""Legacy archives to WARC.

The converter reads ARC files of version 1 (five header fields) and version 2 (ten), plain or
gzip, record by record by their declared lengths, and makes equivalent WARC records: an
identifier from the archive's name and the record's offset, the date in ISO form, the type from
the scheme, digests of block and payload.  Of records with equal payloads one is the response;
the others become revisits that refer to it and carry headers only.

Archives are written by Spark's own committer, so a lost task leaves no half file, and read
through Spark, so any store will do.  A task writes one archive with its own first record; a
rebalance keeps archives near the advisory partition size, and only a file's worth of records
is in memory at once.  The first of two reads of the legacy archives only yields digests; which
record is the response is a maximum per digest, added up before the shuffle.

Defined results: null html is an empty payload, and empty payloads are equal.  Null url becomes
about:blank.  A row without page_id comes back with null page_id, and is a response only where no
equal payload has an id.  Of rows with equal page_id and payload one is the response.  A record
cut short by the file's end keeps what is there.  Header lines that can't be read are skipped up
to the next that can.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed by the formats.
ARC_FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], 2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Groups of equal payloads whose responses may be broadcast.
BROADCAST_GROUPS = 200_000
BATCH_BYTES = 8 << 20


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- reading


class Source:
    """Bytes of a file in order, unpacked on the way if they are gzip members."""

    def __init__(self, data: bytes):
        self.raw = io.BytesIO(data)
        self.zipped = data[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.zipped else None
        self.buffer, self.at, self.offset = b"", 0, 0

    def _more(self) -> bool:
        chunk = self.raw.read(1 << 18)
        if self.zipped:
            out = []
            while True:
                if not chunk and not self.inflate.unconsumed_tail:
                    break
                out.append(self.inflate.decompress(chunk))
                chunk = b""
                if self.inflate.eof and self.inflate.unused_data[:2] == b"\x1f\x8b":
                    chunk = self.inflate.unused_data
                    self.inflate = zlib.decompressobj(31)
            got = b"".join(out)
            if not got and self.raw.tell() < self.raw.getbuffer().nbytes:
                return self._more()
        else:
            got = chunk
        self.buffer, self.at = self.buffer[self.at :] + got, 0
        return bool(got)

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        seen = self.at
        while (end := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer) - self.at
            if not self._more():
                rest = self.buffer[self.at :]
                self.at = len(self.buffer)
                self.offset += len(rest)
                return rest or None
        out = self.buffer[self.at : end]
        self.offset += end + 1 - self.at
        self.at = end + 1
        return out

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need > 0:
            part = self.buffer[self.at : self.at + need]
            self.at += len(part)
            need -= len(part)
            parts.append(part)
            if need and not self._more():
                break
        out = b"".join(parts)
        self.offset += len(out)
        return out


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file: url, ip, date, mime, block, offset; the version block sets the fields."""
    source, fields = Source(data), ARC_FIELDS[1]
    while True:
        offset = source.offset
        line = source.line()
        if line is None:
            return
        text = line.decode("utf-8", "replace").rstrip("\r")
        parts = text.rsplit(" ", len(fields) - 1) if not text.startswith("filedesc:") else text.split(" ")
        if text.startswith("filedesc:"):
            # the length comes last in both versions
            if not parts[-1].isdigit():
                continue
            block = source.take(int(parts[-1]))
            version = block.split(b" ", 1)[0].strip()
            fields = ARC_FIELDS[2 if version == b"2" else 1]
            continue
        if len(parts) != len(fields) or not parts[-1].isdigit() or not re.fullmatch(r"\d{4,17}", parts[fields.index("Archive-date")]):
            continue  # blank lines between records, and what can't be read
        head = dict(zip(fields, parts))
        yield {"url": head["URL"], "ip": head["IP-address"], "date": head["Archive-date"], "mime": head["Content-type"], "block": source.take(int(head["Archive-length"])), "offset": offset}


def iso_date(s: str) -> str:
    """ARC's yyyymmdd[hhmmss] as ISO; missing or impossible parts become their least value."""
    s = (s + "00000101000000"[len(s) :])[:14] if len(s) < 14 else s[:14]
    y, mo, d, h, mi, se = s[:4], s[4:6], s[6:8], s[8:10], s[10:12], s[12:14]
    mo = mo if "01" <= mo <= "12" else "01"
    d = d if "01" <= d <= "31" else "01"
    return f"{y}-{mo}-{d}T{h if h < '24' else '00'}:{mi if mi < '60' else '00'}:{se if se < '60' else '00'}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers with their empty line, and payload, of an HTTP message; a block without headers is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for mark in (b"\r\n\r\n", b"\n\n"):
        if (k := block.find(mark)) >= 0:
            return block[: k + len(mark)], block[k + len(mark) :]
    return block, b""


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file: named fields in lower case, and the block."""
    source = Source(data)
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := source.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, source.take(int(fields.get("content-length", 0)))


# ---- writing


def _write(df: DataFrame, path: str, line_end: str) -> None:
    df.select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", line_end).text(path)


def _batches(values: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for v in values:
        some.append(v)
        size += len(v)
        if size >= BATCH_BYTES or len(some) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["value"])
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["value"])


def arc_line(version: int, url: str, date: str, mime: str, length: int) -> str:
    safe = re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]), url) or "-"
    more = " 200 - - 0 -" if version == 2 else ""
    return f"{safe} 0.0.0.0 {date} {mime}{more} {length}"


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """``pages(page_id, url, html)`` as ARC files, by turns of version 1 and 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2

        def values():
            about = f"{version} 0 sluice\n{' '.join(ARC_FIELDS[version])}\n".encode()
            yield arc_line(version, "filedesc://pages.arc", date, "text/plain", len(about)).encode() + b"\n" + about
            for b in batches:
                for i, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    payload = html or b""
                    own = f"X-Page-Id: {i}\r\n" if i is not None else ""
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload
                    yield arc_line(version, url or "about:blank", date, "text/html", len(block)).encode() + b"\n" + block

        yield from _batches(values())

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    _write(rows.hint("rebalance").mapInArrow(run, "value binary"), path, "\n")


def arc_records(spark: SparkSession, path: str, blocks: bool) -> DataFrame:
    """Records of the ARC files under a path, with WARC identity; the block only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                some, size = [], 0
                for r in read_arc(data.as_py()):
                    head, payload = split_http(r["block"])
                    number = header(head, "X-Page-Id")
                    size += len(r["block"]) if blocks else 64
                    some.append({
                        "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name.rsplit('/', 1)[-1]}#{r['offset']}")), "number": int(number) if number and re.fullmatch(r"-?\d{1,18}", number) else None,
                        "url": r["url"], "ip": r["ip"], "date": iso_date(r["date"]), "mime": r["mime"], "payload_bytes": len(payload), "digest": digest(payload), "block": r["block"] if blocks else None,
                    })
                    if size >= BATCH_BYTES or len(some) >= 1000:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    schema = pa.schema([("record_id", pa.string()), ("number", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("block", pa.binary())])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "record_id string, number long, url string, ip string, date string, mime string, payload_bytes long, digest string, block binary")


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record up to its last CRLF, which the writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n"


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """ARC files to WARC files; equal payloads of ``least_bytes`` or more become revisits of one."""
    known = arc_records(spark, arc_path, blocks=False).where(F.col("payload_bytes") >= least_bytes)
    best = (
        known.groupBy("digest", "payload_bytes")
        .agg(F.max(F.struct(F.coalesce("number", F.lit(-(1 << 62))).alias("n"), F.col("record_id").alias("to_id"), F.col("url").alias("to_url"), F.col("date").alias("to_date"))).alias("best"), F.count("*").alias("copies"))
        .where("copies > 1").select("digest", "payload_bytes", "best.to_id", "best.to_url", "best.to_date")
    )
    ws = common.Workspace(spark, "warc")
    best = ws.save(best, "responses")
    records = arc_records(spark, arc_path, blocks=True)
    few = best.count() <= BROADCAST_GROUPS
    joined = records.join(F.broadcast(best) if few else best, ["digest", "payload_bytes"], "left").select("record_id", "url", "ip", "date", "mime", "digest", "block", "to_id", "to_url", "to_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def values():
            about = b"software: sluice\r\nformat: WARC File Format 1.1\r\n"
            yield warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], about)
            for b in batches:
                for r in (dict(zip(b.schema.names, x)) for x in zip(*(c.to_pylist() for c in b.columns))):
                    head, _ = split_http(r["block"])
                    http = r["url"].lower().startswith(("http:", "https:", "about:")) or bool(head)
                    again = r["to_id"] is not None and r["to_id"] != r["record_id"]
                    block = head if again else r["block"]
                    kind = "revisit" if again else "response" if http else "resource"
                    fields = [
                        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
                        ("WARC-Payload-Digest", f"sha1:{r['digest']}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response" if head else r["mime"]),
                    ]
                    if again:
                        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{r['to_id']}>"), ("WARC-Refers-To-Target-URI", r["to_url"]), ("WARC-Refers-To-Date", r["to_date"])]
                    yield warc_record(fields, block)

        yield from _batches(values())

    _write(joined.mapInArrow(run, "value binary"), warc_path, "\r\n")
    ws.drop(best)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """Page records of the WARC files under a path: identity, type, what they refer to, digests, page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                some = []
                for f, block in read_warc(data.as_py()):
                    if f.get("warc-type") not in ("response", "revisit", "resource"):
                        continue
                    head, payload = split_http(block)
                    own = header(head, "X-Page-Id")
                    length = header(head, "Content-Length")
                    again = f["warc-type"] == "revisit"
                    some.append({
                        "record_id": f.get("warc-record-id"), "record_type": f["warc-type"], "to_id": f.get("warc-refers-to"), "url": f.get("warc-target-uri"), "date": f.get("warc-date"), "page_id": int(own) if own else None,
                        "payload_bytes": int(length) if again and length and length.isdigit() else len(payload), "payload_digest": f.get("warc-payload-digest", "").partition(":")[2] if again else digest(payload),
                    })
                    if len(some) >= 5000:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("to_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record_id string, record_type string, to_id string, url string, date string, page_id long, payload_bytes long, payload_digest string")


def archive(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back."""
    spark = pages.sparkSession
    ws = common.Workspace(spark, "archive")
    arc, warc = ws.path("arc"), ws.path("warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    common.remove(spark, arc)
    back = ws.save(warc_records(spark, warc), "records")
    common.remove(spark, warc)
    return back


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive(common.read(spark, sf_dir, "pages"))
    again = back.where("to_id is not null").select(F.col("to_id").alias("record_id")).distinct()
    to = back.where("to_id is null").join(again, "record_id", "left_semi").toDF(*[f"r_{c}" for c in back.columns])
    return back.join(to, F.col("to_id") == F.col("r_record_id"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("r_page_id").alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, row_number() OVER (PARTITION BY h ORDER BY page_id DESC) AS k FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM b
"""
