"""WARC archives: writing pages as gzip members, and a reader that splits files anywhere.

Every record is a gzip member of its own, so a file is a row of members. A
reader task gets a byte range. It looks for the gzip magic in it, takes each
place as a candidate, and accepts a candidate if a WARC header decodes from it;
bytes that look like the magic inside compressed data do not decode. A record
belongs to the range its first byte lies in and is read beyond the range's end
if it must be. So files of any size are read by many tasks, whatever they hold.

Files are reached through ``pyarrow.fs`` by URI, as Spark has no writer of raw
bytes; the folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# gzip's magic with the only compression method there is, and the words of a WARC record.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 20


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the folder's path in it; ``file:/x`` is as good as ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 in upper case: eight times twenty bits of the hex digest, as four letters each."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit without it.

    Both carry an HTTP header with the payload's length, so a revisit tells it as well.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        # Spaces, controls and line ends may not stand in a header.
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": None if refers_to is None else REVISIT_PROFILE,
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to) from pages with ``html``.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is
    the response and the others refer to it. Rows that repeat that id are
    responses too, and so are all if no row of the group has an id. The least
    id per digest is summed before the shuffle; only digests that occur more
    than once are joined back, and that join may be split on a hot digest.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", payload_digest(F.col("payload")))
    first = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND _first IS NOT NULL")
        .select(F.col("payload_digest").alias("_digest"), "_first")
    )
    joined = rows.join(first, F.col("payload_digest") == F.col("_digest"), "left")
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", F.when(other, F.col("_first")).alias("refers_to")
    )


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """(file, records, bytes) of the archives written to the folder ``path``, one per task.

    A task writes under a name of its own and renames at the end, so a task
    that is lost leaves no archive and one that runs twice replaces its own
    file. The frame is lazy: read it once, or write it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = open_folder(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft = f"{folder}/_{name}.{uuid.uuid4().hex}"
        count = 0
        with store.open_output_stream(draft) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(encode_record(*(row[c] for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))))
                    count += 1
            size = out.tell()
        if count:
            store.move(draft, f"{folder}/{name}")
        else:
            store.delete_file(draft)
        yield pa.record_batch([pa.array([name]), pa.array([count]), pa.array([size])], ["file", "records", "bytes"])

    columns = records.select("page_id", "url", "payload", "payload_digest", "refers_to")
    return columns.mapInArrow(run, "file string, records bigint, bytes bigint").where("records > 0")


class _Window:
    """Bytes of a file by absolute position, read ahead in chunks and forgotten behind."""

    def __init__(self, source, start: int):
        self.source, self.begin, self.data, self.ended = source, start, b"", False
        source.seek(start)

    def upto(self, end: int) -> bool:
        """Read until ``end`` is in the window; false if the file ends before."""
        while self.begin + len(self.data) < end and not self.ended:
            more = self.source.read(max(_CHUNK, end - self.begin - len(self.data)))
            self.ended = not more
            self.data += more
        return self.begin + len(self.data) >= end

    def forget(self, before: int) -> None:
        if before - self.begin > _CHUNK:
            self.data = self.data[before - self.begin :]
            self.begin = before


@dataclass(frozen=True)
class Member:
    head: dict[str, str]
    block: bytes
    end: int


def _parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """The header fields and where the block begins; None if this is no WARC record."""
    if not data.startswith(VERSION + b"\r\n"):
        return None
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = (line.partition(b":") for line in data[:stop].split(b"\r\n")[1:])
    return {k.strip().decode(): v.strip().decode() for k, _, v in fields}, stop + 4


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member that begins at ``at`` and where it ends; None unless it begins like a WARC record and ends well."""
    unpacker, out, place = zlib.decompressobj(31), [], at
    began = 0
    while not unpacker.eof:
        if not window.upto(place + 1):
            return None
        piece = window.data[place - window.begin : place - window.begin + (4096 if began < len(VERSION) else _CHUNK)]
        try:
            out.append(unpacker.decompress(piece))
        except zlib.error:
            return None
        place += len(piece) - len(unpacker.unused_data)
        if began < len(VERSION):
            # Most false candidates end here, after a few bytes.
            joined = b"".join(out)
            began = len(joined)
            if not (VERSION.startswith(joined) or joined.startswith(VERSION)):
                return None
    return b"".join(out), place


def scan_members(source, start: int, end: int) -> Iterator[Member]:
    """The WARC members of an open file whose first byte lies in ``[start, end)``.

    A range may begin inside a member; what looks like the magic there is
    tried and does not decode. After a member the search goes on at its end.
    """
    window, place = _Window(source, start), start
    while place < end:
        window.forget(place)
        # The magic may begin before the end of the range and go on behind it.
        window.upto(min(place + _CHUNK, end + len(GZIP_MAGIC) - 1))
        limit = min(end + len(GZIP_MAGIC) - 1, window.begin + len(window.data))
        found = window.data.find(GZIP_MAGIC, place - window.begin, limit - window.begin)
        if found < 0:
            if limit >= end + len(GZIP_MAGIC) - 1 or window.ended:
                return
            place = max(place, limit - len(GZIP_MAGIC) + 1)
            continue
        place = window.begin + found
        member = _inflate(window, place)
        parsed = member and _parse_head(member[0])
        if not parsed or len(member[0]) < parsed[1] + int(parsed[0].get("Content-Length", -1)) or "Content-Length" not in parsed[0]:
            place += 1
            continue
        head, at = parsed
        yield Member(head, member[0][at : at + int(head["Content-Length"])], member[1])
        place = member[1]


_PAGE = re.compile(r"<urn:page:(-?\d*)>")


def _row(member: Member) -> tuple:
    """A record's columns; a response's digest and length come from its payload, a revisit's from its headers."""
    page = lambda field: int(m[1]) if (m := _PAGE.fullmatch(member.head.get(field, ""))) and m[1] else None
    http, _, payload = member.block.partition(b"\r\n\r\n")
    kind, digest = member.head["WARC-Type"], member.head["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response":
        if _base32_sha1(payload) != digest or len(payload) != size:
            raise ValueError(f"the payload of {member.head['WARC-Record-ID']} does not match its digest")
    return page("WARC-Record-ID"), member.head.get("WARC-Target-URI"), kind, page("WARC-Refers-To"), digest, size, payload if kind == "response" else None


def read_archives(spark: SparkSession, files: DataFrame, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """The records of the archives in ``path``: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    ``files`` has the columns file and bytes. Each file is cut into ranges of
    ``split_bytes``, dealt evenly over the tasks; a range gives the records
    that begin in it, so every record comes once, however files are cut. A
    response whose payload does not match its digest is an error. Bytes that
    are no WARC member are skipped.
    """
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(split_bytes).cast("bigint"))
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    n = max(1, ranges.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_folder(path)
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for part in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{folder}/{part['file']}") as source:
                    for member in scan_members(source, part["start"], min(part["start"] + split_bytes, part["bytes"])):
                        rows.append(_row(member))
                        held += len(member.block)
                        if len(rows) == 1000 or held > 8 * _CHUNK:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return ranges.repartition(n).mapInArrow(run, RECORDS)
