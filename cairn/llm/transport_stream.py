"""Media columns: texts as private data in MPEG transport streams, and back.

Writing.  A payload (UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576) is cut into access units of eight times
576 bytes.  Each becomes a packetized elementary stream (PES) packet with a time stamp and is laid out in transport packets of 188
bytes.  Every sixteenth unit is a random-access point: program association and program map tables stand before it, and its first packet has
the random-access flag and a clock reference.

Reading.  The tables are parsed and their checksums held, continuity counters are checked for every packet identifier, PES packets
are put together again, and each one's time stamp is kept with its packet number and whether it is a random-access point.

Reading takes all programs and streams, sections over several packets, packets sent twice and announced breaks; a unit that lost bytes is marked.

Each document is one row; nothing is shuffled.  Packets of a stream are laid out and taken apart as one array.  ``stored`` writes the media column as
a table in the shared folder, and what is read is that table.

Defined results: null text counts as empty, whose payload is 576 bytes 255; equal texts give equal values; repeated rows come back once
each; a very long text makes one long stream, alone in its slice; null ids pass through; ids are of any type; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .textblock import slices

UNIT = 576
UNITS = 8
GROUP = 16
PACKET = 188
# Fixed values of the stream layout: identifiers, stream type and clock.
PROGRAM, PMT_PID, MEDIA_PID, PRIVATE_DATA, STREAM_ID = 1, 0x100, 0x101, 0x06, 0xBD
TICKS = 1080 * UNITS


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return tuple(out)


def crc32_mpeg(data: bytes) -> int:
    table, c = _crc_table(), 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _section_packet(pid: int, table_id: int, extension: int, body: bytes) -> np.ndarray:
    length = len(body) + 9
    section = bytes([table_id, 0xB0 | length >> 8, length & 255, extension >> 8, extension & 255, 0xC1, 0, 0]) + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    packet = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(packet.ljust(PACKET, b"\xff"), np.uint8)


@cache
def table_packets() -> np.ndarray:
    """The two packets of the program association and program map tables, continuity counters zero."""
    pid = lambda x: bytes([0xE0 | x >> 8, x & 255])
    association = _section_packet(0, 0, 1, PROGRAM.to_bytes(2, "big") + pid(PMT_PID))
    program = _section_packet(PMT_PID, 2, PROGRAM, pid(MEDIA_PID) + b"\xf0\0" + bytes([PRIVATE_DATA]) + pid(MEDIA_PID) + b"\xf0\0")
    return np.stack((association, program))


@cache
def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Packets of a PES packet of ``size`` bytes with everything but its bytes, and the places of those bytes."""
    rest = size - 176
    packets = 1 + -(-rest // 184)
    template = np.zeros((packets, PACKET), np.uint8)
    template[:, 0], template[:, 1], template[:, 2], template[:, 3] = 0x47, MEDIA_PID >> 8, MEDIA_PID & 255, 0x10
    template[0, 1] |= 0x40
    template[0, 3], template[0, 4], template[0, 5] = 0x30, 7, 0x10
    starts = np.full(packets, 4)
    starts[0] = 12
    if stuffing := (packets - 1) * 184 - rest:
        template[-1, 3], template[-1, 4] = 0x30, stuffing - 1
        template[-1, 6 : 4 + stuffing] = 0xFF
        starts[-1] = 4 + stuffing
    places = np.concatenate([np.arange(s, PACKET) + i * PACKET for i, s in enumerate(starts)])
    return template.reshape(-1), places


def _stamp(ticks: np.ndarray) -> np.ndarray:
    """The five bytes of 33-bit time stamps."""
    t = ticks.astype(np.int64)
    return np.stack((0x21 | t >> 29 & 14, t >> 22 & 255, 1 | t >> 14 & 254, t >> 7 & 255, 1 | t << 1 & 254), 1).astype(np.uint8)


def _units(units: np.ndarray, first: int) -> np.ndarray:
    """Transport packets of access units of equal size, one row a unit; the counters are still zero."""
    n, size = units.shape
    length = size + 8
    head = np.zeros((n, 14), np.uint8)
    head[:, 2], head[:, 3], head[:, 4], head[:, 5] = 1, STREAM_ID, length >> 8, length & 255
    head[:, 6], head[:, 7], head[:, 8] = 0x80, 0x80, 5
    number = np.arange(first, first + n)
    head[:, 9:] = _stamp(number * TICKS)
    template, places = _layout(size + 14)
    out = np.tile(template, (n, 1))
    out[:, places] = np.concatenate((head, units), 1)
    clock = number.astype(np.int64) * TICKS
    out[:, 6], out[:, 7], out[:, 8], out[:, 9], out[:, 10] = clock >> 25 & 255, clock >> 17 & 255, clock >> 9 & 255, clock >> 1 & 255, (clock & 1) << 7 | 0x7E
    out[number % GROUP == 0, 5] |= 0x40
    return out


def padded(raw: bytes) -> bytes:
    """Filled up with bytes 255 to a positive multiple of 576."""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\xff")


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose size is a positive multiple of 576."""
    data, size = np.frombuffer(payload, np.uint8), UNIT * UNITS
    whole = len(data) // size
    parts = [_units(data[: whole * size].reshape(-1, size), 0).reshape(whole, -1, PACKET)] if whole else []
    if whole * size < len(data):
        parts.append(_units(data[None, whole * size :], whole).reshape(1, -1, PACKET))
    units = [u for p in parts for u in p]
    tables, out = table_packets(), []
    for i in range(0, len(units), GROUP):
        counted = tables.copy()
        counted[:, 3] |= i // GROUP % 16
        out += [counted, *units[i : i + GROUP]]
    stream = np.concatenate(out)
    media = np.flatnonzero((stream[:, 2] == MEDIA_PID & 255) & (stream[:, 1] & 0x1F == MEDIA_PID >> 8))
    stream[media, 3] |= (np.arange(len(media)) % 16).astype(np.uint8)
    return stream.tobytes()


def sections(packets: np.ndarray) -> list[bytes]:
    """Whole sections of the packets of one identifier, put together across packets, with their checksums held."""
    found, open_ = [], None
    for packet in packets:
        raw = packet.tobytes()
        if not raw[3] & 0x10:
            continue
        data = raw[4 + (1 + raw[4] if raw[3] & 0x20 else 0) :]
        if raw[1] & 0x40:  # a pointer to the first section that begins here; what stands before it ends the open one
            begin = 1 + data[0]
            if open_ is not None:
                open_ += data[1:begin]
                _whole(open_, found)
            open_ = data[begin:]
        elif open_ is not None:
            open_ += data
        if open_ is not None:
            open_ = _whole(open_, found)
    return found


def _whole(data: bytes, found: list[bytes]) -> bytes | None:
    """Move the whole sections at the head of ``data`` to ``found``; what is left of one that goes on comes back, or None at stuffing."""
    while data and data[0] != 0xFF:
        if len(data) < 3 or len(data) < (size := 3 + ((data[1] & 15) << 8 | data[2])):
            return data
        if crc32_mpeg(data[:size]):
            raise ValueError("a program table's checksum is wrong")
        found.append(data[:size])
        data = data[size:]
    return None


def programs(packets: np.ndarray, pid: np.ndarray) -> dict[int, dict[int, tuple[int, int]]]:
    """Program number to its map table's identifier and streams: ``{number: {pid: (stream type, map pid)}}``; later tables replace earlier ones."""
    out: dict[int, dict[int, tuple[int, int]]] = {}
    maps: dict[int, int] = {}
    seen: set[bytes] = set()
    for section in sections(packets[pid == 0]):
        if section in seen:
            continue
        seen.add(section)
        for at in range(8, len(section) - 4, 4):
            number = section[at] << 8 | section[at + 1]
            if number:  # program 0 names the network's own table
                maps[number] = (section[at + 2] & 0x1F) << 8 | section[at + 3]
    for map_pid in sorted(set(maps.values())):
        for section in dict.fromkeys(sections(packets[pid == map_pid])):
            if section[0] != 2:
                continue
            number, at, streams = section[3] << 8 | section[4], 12 + ((section[10] & 15) << 8 | section[11]), {}
            while at < len(section) - 4:
                streams[(section[at + 1] & 0x1F) << 8 | section[at + 2]] = (section[at], map_pid)
                at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
            if maps.get(number) == map_pid:
                out[number] = streams
    return out


def counted(packets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one identifier's packets with payload: which to keep (a packet may be sent twice), and before which of those the counter breaks."""
    if not len(packets):
        return np.zeros(0, bool), np.zeros(0, bool)
    counters = packets[:, 3] & 15
    step = (counters[1:].astype(np.int16) - counters[:-1]) % 16
    # A second copy has the counter and the bytes of the one before it, but for the clock in its adaptation field.
    alike = step == 0
    if alike.any():
        at = np.flatnonzero(alike)
        same = packets[at + 1] == packets[at]
        clock = (packets[at, 3] & 0x20 != 0) & (packets[at, 4] > 6) & (packets[at, 5] & 0x10 != 0)
        same[:, 6:12] |= clock[:, None]
        alike[at] = same.all(1)
    keep = np.concatenate(([True], ~alike))
    announced = (packets[:, 3] & 0x20 != 0) & (packets[:, 4] > 0) & (packets[:, 5] & 0x80 != 0)
    kept = counters[keep].astype(np.int16)
    breaks = np.concatenate(([False], (kept[1:] - kept[:-1]) % 16 != 1)) & ~announced[keep]
    return keep, breaks


def elementary(packets: np.ndarray, numbers: np.ndarray) -> dict:
    """``payload, units, breaks`` of one stream's packets, whose places in the transport stream are ``numbers``.

    A unit is (time stamp or None, packet number, random access, whole): it is not whole if the counter breaks inside it or bytes are missing.
    Bytes before the first unit are left out.
    """
    keep, broken = counted(packets)
    media, numbers = packets[keep], numbers[keep]
    begins = np.minimum(PACKET, 4 + np.where(media[:, 3] & 0x20 != 0, 1 + media[:, 4].astype(np.int32), 0))
    data = media[np.arange(PACKET) >= begins[:, None]].tobytes()
    starts = np.flatnonzero(media[:, 1] & 0x40)
    offsets = np.concatenate(([0], np.cumsum(PACKET - begins)))
    edges = [*offsets[starts].tolist(), len(data)]
    access = ((media[starts, 3] & 0x20 != 0) & (media[starts, 4] > 0) & (media[starts, 5] & 0x40 != 0)).tolist()
    inside = np.concatenate(([0], np.cumsum(broken)))
    lost = (inside[np.append(starts[1:], len(media))] - inside[np.minimum(starts + 1, len(media))]).tolist() if len(starts) else []
    parts, units = [], []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        if data[a : a + 3] != b"\0\0\1":
            raise ValueError("a PES packet has no start code")
        declared = int.from_bytes(data[a + 4 : a + 6], "big")
        end = min(b, a + 6 + declared) if declared else b
        stamp = None
        if data[a + 7] & 0x80:
            t = data[a + 9 : a + 14]
            stamp = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
        parts.append(data[a + 9 + data[a + 8] : end])
        units.append((stamp, int(numbers[starts[i]]), access[i], not lost[i] and (not declared or b >= a + 6 + declared)))
    return {"payload": b"".join(parts), "units": units, "breaks": int(broken.sum())}


def demux(stream: bytes) -> dict:
    """All programs and streams: ``programs`` as in ``programs``, ``streams`` by identifier, ``breaks`` of all identifiers together.

    The first stream of the lowest program stands at the top too: ``payload, units, pid, kind``.
    """
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("a packet lost its sync byte")
    pid = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    has_payload = packets[:, 3] & 0x10 != 0
    tables = programs(packets, pid)
    streams, breaks = {}, 0
    for streams_of in tables.values():
        for media_pid, (kind, _) in streams_of.items():
            numbers = np.flatnonzero((pid == media_pid) & has_payload)
            streams[media_pid] = elementary(packets[numbers], numbers) | {"kind": kind}
            breaks += streams[media_pid]["breaks"]
    for p in {0, *(map_pid for streams_of in tables.values() for _, map_pid in streams_of.values())}:
        breaks += int(counted(packets[(pid == p) & has_payload])[1].sum())
    out = {"programs": tables, "streams": streams, "breaks": breaks, "payload": b"", "units": [], "pid": None, "kind": None}
    if tables and (first := next(iter(tables[min(tables)]), None)) is not None:
        out |= {"payload": streams[first]["payload"], "units": streams[first]["units"], "pid": first, "kind": streams[first]["kind"]}
    return out


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes`` and ``media``, the stored stream of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()]
                media = pa.array([mux(padded(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def stored(docs: DataFrame) -> DataFrame:
    """The media column as a written table."""
    return written(store(docs), "media")


def feature_of(found: dict) -> str:
    """Identifier, type, units, continuity breaks, last time stamp, and time stamp@packet of each random-access point."""
    points = ",".join(f"{t}@{n}" for t, n, access, _ in found["units"] if access)
    return f"pid={found['pid']};type={found['kind']};units={len(found['units'])};breaks={found['breaks']};last={found['units'][-1][0]};access={points}"


def described(stored: DataFrame) -> DataFrame:
    """Digests and features of stored streams (``doc_id, n_bytes, media``), from the payload that is read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for part in slices(batch, "media"):
                rows = []
                for stream in part.column("media").to_pylist():
                    found = demux(stream)
                    payload = found["payload"]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature_of(found)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
