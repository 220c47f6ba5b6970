"""Legacy archives: ARC records of versions 1 and 2 become WARC records, which are written and read again.

An ARC file starts with a ``filedesc`` record whose block names the version; a record is a header line of space-separated
fields, the last of which is the length of the block, then the block and a newline. Version 1 has five fields (URL, IP
address, date, content type, length); version 2 has ten (URL, IP address, date, content type, result code, checksum,
location, offset, file name, length).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm.common import bounded_batches, cut, release

#: Bytes of blocks, and records, after which a new ARC archive is begun; the limits bound what a task holds at once.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 8 << 20, 500
#: Equal payloads shorter than this are all kept in full.
LEAST_REVISIT = 100
_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def _escaped(url: str) -> str:
    """An ARC header is split at spaces, so white space in a URL is percent-encoded."""
    return _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The ``filedesc`` record that begins an ARC file."""
    fields = "URL IP-address Archive-date Content-type Archive-length"
    if version == 2:
        fields = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    block = f"{version} 0 glossmill\n{fields}\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, offset: int, name: str) -> bytes:
    middle = "" if version == 1 else f" 200 {zlib.crc32(block):08x} - {offset} {name}"
    return f"{_escaped(url)} 0.0.0.0 {date} text/html{middle} {len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, date: str = "20080430000000") -> DataFrame:
    """Archives of ``pages(page_id, url, html)``: ``(version, content)``, of versions 1 and 2 in turn.

    A block is an HTTP answer whose payload is the html in UTF-8 (null: empty); the page_id travels as a header of it
    (none for null). An archive holds at most about ``ARCHIVE_BYTES`` or one longer record. Other columns are not used;
    repeated rows are repeated records; an empty table gives no archive.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, pieces, size = 0, [], 0
        for part in batches:
            for page, url, html in zip(part["page_id"], part["url"], part["html"], strict=True):
                version, name = 1 + number % 2, f"pages-{number}.arc"
                if not pieces:
                    pieces = [arc_head(version, name, date)]
                    size = len(pieces[0])
                html = html or b""
                mark = "" if pd.isna(page) else f"X-Page-Id: {int(page)}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n{mark}\r\n".encode() + html
                pieces.append(arc_record(version, url or "", date, block, size, name))
                size += len(pieces[-1])
                if size >= ARCHIVE_BYTES or len(pieces) > ARCHIVE_RECORDS:
                    yield pd.DataFrame({"version": [version], "content": [b"".join(pieces)]})
                    number, pieces = number + 1, []
        if pieces:
            yield pd.DataFrame({"version": [version], "content": [b"".join(pieces)]})

    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    return rows.mapInPandas(run, "version int, content binary")


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records of an ARC archive. The first is the head, ``filedesc``, whose block declares the version; any other is a
    page's, whatever its URL says.

    Header lines are split from the right by the fields of the version, so that a URL may hold spaces; a block is as
    long as declared. What cannot be read (a header line without end or with other fields, a block that is cut off) is
    one last record of its bytes with an ``error``, since nothing tells where the next one would begin.
    """
    at, version, size, head = 0, 1, len(content), True
    while at < size:
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.find(b"\n", at)
        start = end + 1
        parts: list[str] = []
        if end >= 0:
            line = content[at:end].decode("utf-8", "replace").rstrip("\r")
            if head and line.startswith("filedesc:"):
                version = 2 if content[start : start + 1] == b"2" else 1
            parts = line.rsplit(" ", len(_FIELDS[version]) - 1)
        length = int(parts[-1]) if len(parts) == len(_FIELDS[version]) and re.fullmatch(r"\d{1,18}", parts[-1]) else -1
        if length < 0 or start + length > size:
            yield {"offset": at, "error": f"broken record at byte {at}", "block": content[at:]}
            return
        record = dict(zip(_FIELDS[version], parts, strict=True))
        yield record | {"offset": at, "head": head and line.startswith("filedesc:"), "block": content[start : start + length]}
        at, head = start + length, False


RECORD = (
    "page_id long, record_id string, record_type string, target string, date string, content_type string, "
    "http binary, payload binary, digest string"
)


def convert_arc(archives: DataFrame) -> DataFrame:
    """WARC records equivalent to the records of ``archives(content)``, plain or gzip: ``RECORD``.

    The head of an archive becomes ``warcinfo`` and every other record ``response``; a lookup (a block of type
    ``text/dns`` under a ``dns:`` URL) becomes ``resource``. What cannot be read becomes a ``conversion`` record without
    page_id, whose type is ``application/octet-stream`` and whose payload is the bytes from there on, so that broken
    archives are set aside and counted, not lost. The record identifier is a name-based UUID of URL, date, offset and
    block, so that a repeated conversion gives the same; the 14-digit date becomes ISO 8601 (the epoch if it is none);
    the digest is SHA-256 of the payload, which begins after the HTTP header if the block has one.
    """

    def record(r: dict) -> tuple:
        block = r["block"]
        if "error" in r:
            r, kind = {"url": r["error"], "date": "", "type": "application/octet-stream", "offset": r["offset"]}, "conversion"
        else:
            lookup = r["url"].startswith("dns:") and r["type"] == "text/dns"
            kind = "warcinfo" if r["head"] else "resource" if lookup else "response"
        start = block.find(b"\r\n\r\n") + 4 if kind == "response" and block.startswith(b"HTTP/") else 0
        http, payload = block[: max(start, 0)], block[max(start, 0) :]
        mark = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http)
        d = r["date"] if re.fullmatch(r"\d{14}", r["date"]) else "19700101000000"
        seed = f"{r['url']} {d} {r['offset']} {hashlib.sha256(block).hexdigest()}"
        return (
            int(mark[1]) if mark else None,
            f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>",
            kind,
            r["url"],
            f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
            "application/http;msgtype=response" if http else r["type"],
            http,
            payload,
            hashlib.sha256(payload).hexdigest(),
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for content in part["content"]:
                plain = gunzip(content) if content.startswith(b"\x1f\x8b") else content
                frame = pd.DataFrame.from_records([record(r) for r in parse_arc(plain)], columns=[x.split()[0] for x in RECORD.split(", ")])
                frame["page_id"] = frame["page_id"].astype("Int64")
                yield frame

    return archives.select("content").mapInPandas(run, RECORD)


def mark_revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``records`` with ``refers_to`` (page_id) and ``refers_id``: equal payloads are kept once.

    Of response records with one digest and at least ``least`` bytes, that with the smallest page_id stays a response
    (all of its rows, if it is repeated; null ids come last) and the others become revisits of it. The smallest of each
    digest is found with a combined aggregate; only digests that occur twice are joined back, and AQE can split that
    join when one payload holds a large share of the rows.
    """
    first = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")
    twice = (
        records.where((F.col("record_type") == "response") & (F.octet_length("payload") >= least))
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min(first).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
    )
    twice = cut(twice, "repeated-payloads")  # an aggregate right under the join would keep AQE from splitting it
    again = (F.col("record_type") == "response") & F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    out = records.join(twice, F.col("digest") == F.col("d"), "left").withColumn("again", again)
    return out.select(
        *[c for c in records.columns if c != "record_type"],
        F.when(F.col("again"), "revisit").otherwise(F.col("record_type")).alias("record_type"),
        F.when(F.col("again"), F.col("first.page_id")).alias("refers_to"),
        F.when(F.col("again"), F.col("first.record_id")).alias("refers_id"),
    )


def record_bytes() -> Column:
    """A WARC record from the columns of :func:`mark_revisits`, without the two newlines that end it."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    revisit = F.col("record_type") == "revisit"
    kept = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    length = F.octet_length("http") + F.octet_length(kept)
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(F.col("record_type") != "warcinfo", F.col("target"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.col("refers_id")),
        line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), F.col("http"), kept)


#: Bytes of records in a WARC file, about; a reader holds one file at a time. A longer record has one for itself.
FILE_BYTES = 16 << 20


def write_warc(records: DataFrame, path: str, file_records: int = 500, file_bytes: int = FILE_BYTES) -> None:
    """Write records as WARC files, gzip-compressed, of at most ``file_records`` records each.

    No file holds more than about ``file_bytes``: records are dealt to files of so many records that even the longest of
    them stay below, by their size's power of two. An empty table gives no file with records.
    """
    sized = records.withColumn("_size", F.octet_length("http") + F.octet_length("payload"))
    long = F.col("_size") > file_bytes // file_records
    lines = sized.where(~long).select(record_bytes().cast("string").alias("value"))
    out = lambda rows, most, mode: rows.write.mode(mode).option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)
    out(lines, file_records, "error")
    power = F.floor(F.log2(F.col("_size").cast("double"))).cast("int")
    # The long records are computed once, whatever their sizes; the writes below only copy them.
    large = cut(sized.where(long).select(power.alias("power"), record_bytes().cast("string").alias("value")), "long-records")
    for (p,) in sorted(large.select("power").distinct().collect()):  # a few dozen at most
        out(large.where(F.col("power") == p).select("value"), max(1, file_bytes >> (p + 1)), "append")
    release(large)


READ = (
    "record_type string, record_id string, target string, date string, page_id long, payload_bytes long, "
    "payload_digest string, refers_to long, refers_id string, payload binary"
)


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC file, by the declared lengths.

    From where no record can be read, the bytes are one last record with only an ``error`` in its head.
    """
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        version, *lines = content[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines if ": " in x)
        length = head.get("Content-Length", "")
        stop = end + 4 + int(length) if length.isdecimal() else -1
        if end < 0 or not version.startswith("WARC/") or stop < 0 or content[stop : stop + 4] != b"\r\n\r\n":
            yield {"error": f"broken record at byte {at}"}, content[at:]
            return
        yield head, content[end + 4 : stop]
        at = stop + 4


def gunzip(content: bytes) -> bytes:
    """All members of a gzip file, compressed whole or record by record, as far as they can be read."""
    out = []
    while content:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content) + member.flush())
        except zlib.error:
            break
        content = member.unused_data
    return b"".join(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``: ``READ``. The length and digest are those of the full payload.

    The digest of a stored payload is computed again; a revisit has its declared digest and the length that its HTTP
    header gives. Broken records, and those whose digest is not the declared one, come back with the type ``broken``,
    without page_id, so that they can be counted. No file or an empty one gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for content in part["content"]:
                out = []
                for head, block in parse_warc(gunzip(content)):
                    split = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                    http, payload = block[: max(split, 0)], block[max(split, 0) :]
                    kind, size, own = head.get("WARC-Type"), len(payload), hashlib.sha256(payload).hexdigest()
                    digest = head.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    if kind == "revisit":
                        full = re.search(rb"\r\nContent-Length: (\d+)\r\n", http)
                        size = int(full[1]) if full else 0
                    elif kind is None or "WARC-Payload-Digest" in head and own != digest:
                        kind = "broken"
                    mark = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", http) if kind != "broken" else None
                    refers = head.get("X-Refers-To-Page-Id")
                    out.append(
                        (
                            kind,
                            head.get("WARC-Record-ID"),
                            head.get("WARC-Target-URI", head.get("error")),
                            head.get("WARC-Date"),
                            int(mark[1]) if mark else None,
                            size,
                            digest or own,
                            int(refers) if refers else None,
                            head.get("WARC-Refers-To"),
                            payload,
                        )
                    )
                frame = pd.DataFrame.from_records(out, columns=[x.split()[0] for x in READ.split(", ")])
                for name in ("page_id", "refers_to"):
                    frame[name] = frame[name].astype("Int64")
                yield frame

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, READ)
