"""WARC records in ZIP-packaged archives, written and range-read by Spark tasks.

An archive is a ZIP file whose members are stored, not compressed: ``archive/*.warc.gz`` (a gzip member per record),
``indexes/index.cdxj`` (a line per record with file name, offset and length) and ``datapackage.json``.  The writer puts ZIP64 fields into every
entry and a ZIP64 end record; the reader takes either form.  Each writing task streams one archive through
Spark's own text writer, so any file system of the cluster will do and a lost task leaves no half archive; that writer ends every row with
a newline, which falls between members, and the last one is the archive's one-byte comment.

The reader finds the end record in an archive's tail, parses its central directory, locates the index, and turns its lines into byte
ranges.  Ranges are dealt out anew, and each task reads neighbouring ones together; nothing is extracted.

Archives.  Their number follows from all payload bytes, so that one holds about 64 MB; a writing task holds its index lines and one member.  Ranges are
read by as many tasks as their bytes ask for.

Equal payloads.  The largest page id of a payload is found by one aggregation over digests, and ids join it by digest; Spark splits
a payload that holds many rows.  Revisit records carry no payload.

Defined results: null html counts as empty; rows that repeat both page id and payload are all responses or all revisits; null page ids never
answer for others, and where a payload has no other id they are responses; ids are of any type and stand in records as escaped text; a very long payload makes a large
member of its own size; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, written
from .textblock import slices

#: Bytes of payload in an archive, at most about ARCHIVE, and at least about LEAST before more are made; bytes of a member, and of one range read.
ARCHIVE, LEAST = 64 << 20, 4 << 20
MEMBER = 8 << 20
TOGETHER = 1 << 20
#: Bytes of archives that one reading task takes.
READ = 16 << 20
_U32, _U16 = 0xFFFFFFFF, 0xFFFF
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, response_id``; ``digest`` is the payload's SHA-1 in hexadecimal, ``response_id`` answers for all records of it.

    Digests with ids are written once, without html.  Only ids meet in the aggregation and in the join by digest, which Spark splits where a payload
    is hot; html then joins by page, over as many partitions as archives shall be.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.sha1(html.cast("binary"))
    ids = written(pages.select("page_id", digest.alias("digest"), F.octet_length(html).cast("bigint").alias("bytes")), "digests")
    total = ids.agg(F.sum("bytes")).first()[0] or 0
    archives = max(1, -(-total // ARCHIVE), min(spark.sparkContext.defaultParallelism, -(-total // LEAST)))
    largest = ids.groupBy("digest").agg(F.max("page_id").alias("response_id"))
    one = ids.select("page_id", "digest").distinct().join(largest, "digest")
    # The page and its digest as one key, that also holds for null ids.
    key = lambda digest: F.concat(digest, F.coalesce(F.concat(F.lit("="), F.col("page_id").cast("string")), F.lit("-")))
    roles = one.select(key(F.col("digest")).alias("key"), "digest", "response_id").repartition(archives, "key")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), key(digest).alias("row_key")).repartition(archives, "row_key")
    return rows.join(roles.hint("shuffle_hash"), F.col("row_key") == F.col("key")).select("page_id", "url", "html", "digest", "response_id")


def base32_of(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def urn_of(page_id) -> str:
    """``urn:page``, and the id as text with all but letters and digits escaped, if there is one."""
    return "urn:page" + ("" if page_id is None else ":" + quote(str(page_id), safe=""))


def id_of(urn: str | None) -> str | None:
    """The text of the id in ``<urn:page:...>``."""
    return unquote(urn[10:-1]) if urn is not None and urn.startswith("<urn:page:") else None


def record(page_id, url: str | None, payload: bytes, digest: str, response_id) -> bytes:
    """One WARC record."""
    revisit = page_id != response_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{urn_of(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head.append(f"WARC-Refers-To: <{urn_of(response_id)}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    block = http if revisit else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ZipWriter:
    """Pieces of a ZIP file of stored members, each followed by one byte that the sink adds."""

    def __init__(self):
        self.at, self.entries = 0, []

    def member(self, name: str, data: bytes) -> bytes:
        raw, size, crc = name.encode(), len(data), zlib.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        local = struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0, 0, 0, 33, crc, _U32, _U32, len(raw), len(extra)) + raw + extra
        self.entries.append((raw, crc, size, self.at))
        self.at += len(local) + size + 1
        return local + data

    def end(self) -> bytes:
        """Central directory, ZIP64 end record and locator, end record; its comment is the byte that the sink adds."""
        out, start = bytearray(), self.at
        for raw, crc, size, offset in self.entries:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            out += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0, 0, 0, 33, crc, _U32, _U32, len(raw), len(extra), 0, 0, 0, 0, _U32) + raw + extra
        n, size = len(self.entries), len(out)
        out += struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, start + size, 1)
        return bytes(out + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, _U16, _U16, _U32, _U32, 1))


def write_archives(rows: DataFrame, folder: str) -> None:
    """An archive for each partition of ``rows`` (``with_roles``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped, index, member, held = ZipWriter(), [], [], 0
        out = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["piece"])
        name = lambda: f"archive/data-{len(zipped.entries):05d}.warc.gz"
        for batch in batches:
            for part in slices(batch, "html"):
                for row in part.to_pylist():
                    payload = (row["html"] or "").encode()
                    packed = gzip.compress(record(row["page_id"], row["url"], payload, base32_of(row["digest"]), row["response_id"]), 1, mtime=0)
                    index.append(json.dumps({"urn": urn_of(row["page_id"]), "filename": name(), "offset": held, "length": len(packed)}))
                    member.append(packed)
                    held += len(packed)
                    if held >= MEMBER:
                        yield out(zipped.member(name(), b"".join(member)))
                        member, held = [], 0
        if not index:
            return
        if member:
            yield out(zipped.member(name(), b"".join(member)))
        yield out(zipped.member("indexes/index.cdxj", "\n".join(index).encode()))
        yield out(zipped.member("datapackage.json", json.dumps({"profile": "data-package", "resources": [raw.decode() for raw, *_ in zipped.entries]}).encode()))
        yield out(zipped.end())

    columns = rows.select("page_id", "url", "html", "digest", "response_id")
    columns.mapInArrow(run, "piece binary").select(F.col("piece").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


ReadAt = Callable[[int, int], bytes]


def directory(size: int, read_at: ReadAt) -> dict[str, tuple[int, int]]:
    """Name to (offset of the local header, size) of a ZIP file's stored members."""
    tail_at = max(0, size - 22 - _U16)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("not a ZIP file: no end record")
    _, _, _, count, length, start, _ = struct.unpack("<4H2IH", tail[at + 4 : at + 22])
    if count == _U16 or length == _U32 or start == _U32:
        locator = tail_at + at - 20
        signature, _, end64, _ = struct.unpack("<4sIQI", read_at(locator, 20))
        if signature != b"PK\6\7":
            raise ValueError("the ZIP64 locator is missing")
        count, length, start = struct.unpack("<32xQQQ", read_at(end64, 56))
    raw, found, p = read_at(start, length), {}, 0
    for _ in range(count):
        signature, method, packed, plain, names, extras, comment, offset = struct.unpack("<4s6xH8xIIHHH8xI", raw[p : p + 46])
        if signature != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        name, extra = raw[p + 46 : p + 46 + names].decode(), raw[p + 46 + names : p + 46 + names + extras]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == _U32 else plain
                packed = wide.pop(0) if packed == _U32 else packed
                offset = wide.pop(0) if offset == _U32 else offset
            extra = extra[4 + n :]
        if method == 0:
            found[name] = (offset, packed)
        p += 46 + names + extras + comment
    return found


def data_start(offset: int, read_at: ReadAt) -> int:
    """Where a member's bytes begin: its local header has name and extra lengths of its own."""
    signature, names, extras = struct.unpack("<4s22xHH", read_at(offset, 30))
    if signature != b"PK\3\4":
        raise ValueError("no local header where the directory says")
    return offset + 30 + names + extras


def ranges(size: int, read_at: ReadAt) -> list[tuple[int, int]]:
    """Absolute (offset, length) of every record that the archive's indexes list."""
    members = directory(size, read_at)
    starts, found = {}, []
    for name, (offset, length) in members.items():
        if name.startswith("indexes/"):
            for line in read_at(data_start(offset, read_at), length).split(b"\n"):
                if line:
                    entry = json.loads(line)
                    if entry["filename"] not in starts:
                        starts[entry["filename"]] = data_start(members[entry["filename"]][0], read_at)
                    found.append((starts[entry["filename"]] + entry["offset"], entry["length"]))
    return found


def parsed(raw: bytes) -> dict:
    """Page id (as text), payload size, digest, type and reference of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out = {"page_id": id_of(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": id_of(fields.get("WARC-Refers-To"))}
    if fields["WARC-Type"] == "response":
        out |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload)}
    else:
        length = next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        out |= {"payload_bytes": int(length.split(b":")[1]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    return out


def _opened(path: str) -> pa.NativeFile:
    uri = path if "://" in path else path.replace("file:", "file://", 1)
    system, inner = fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


def _reader(file: pa.NativeFile) -> ReadAt:
    return lambda at, n: file.read_at(n, at)


_RECORD = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
_COLUMNS = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives of a folder; a folder without archives gives none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    found = ranges(row["length"], _reader(file))
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["path", "at", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, i = batch.to_pylist(), [], 0
            while i < len(rows):
                path, first = rows[i]["path"], rows[i]["at"]
                with _opened(path) as file:
                    while i < len(rows) and rows[i]["path"] == path:
                        first, j = rows[i]["at"], i
                        while j < len(rows) and rows[j]["path"] == path and rows[j]["at"] + rows[j]["length"] - first <= TOGETHER:
                            j += 1
                        j = max(j, i + 1)
                        raw = file.read_at(rows[j - 1]["at"] + rows[j - 1]["length"] - first, first)
                        out += [parsed(gzip.decompress(raw[r["at"] - first : r["at"] - first + r["length"]])) for r in rows[i:j]]
                        i = j
            yield pa.RecordBatch.from_pylist(out, _RECORD)

    # Ranges are tiny rows that stand for large reads, so their tasks are counted by the bytes they read.
    count, total = files.agg(F.count("*"), F.sum("length")).first()
    if not count:
        return spark.createDataFrame([], _COLUMNS)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, count), -(-total // READ))
    planned = files.select("path", "length").repartition(min(count, tasks), "path").mapInArrow(plan, "path string, at bigint, length bigint")
    stretch = F.floor(F.col("at") / TOGETHER)
    return planned.repartition(tasks, "path", stretch).sortWithinPartitions("path", "at").mapInArrow(fetch, _COLUMNS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row, from the archives."""
    folder = new_folder(pages.sparkSession, "archives")
    write_archives(with_roles(pages), folder)
    kind = pages.schema["page_id"].dataType
    read = read_archives(pages.sparkSession, folder)
    return read.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
