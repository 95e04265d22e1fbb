"""MPEG transport streams as a media column: writing texts into them, and a parser that reads them back.

A payload is cut into access units of 576 bytes. Each unit is one packetised elementary stream (PES)
packet with a presentation time, carried by four transport packets of 188 bytes: the first has an
adaptation field with the program clock, and the random-access flag on every sixteenth unit; the last is
filled up by its adaptation field. A program association table and a program map table stand in front.
The parser takes nothing of this layout for granted: it follows the tables to the elementary stream,
reads adaptation fields, checks continuity counters, drops repeated packets, reassembles PES packets by
their start flags and keeps the times and the random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import slices, text_or_empty

UNIT = 576
PACKET = 188
PROGRAM, PMT_PID, DATA_PID = 1, 0x100, 0x101
#: Private data in PES packets, by the table of stream types.
PRIVATE = 0x06
STREAM_ID = 0xBD
#: Ticks of the 90 kHz clock between units, and units between random-access points.
TICKS, ACCESS = 2160, 16
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Further columns of what is read back: the time of every unit, and the numbers of the units where reading can begin.
PLACES = ", pts array<long>, access_points array<long>"


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 24
    for _ in range(8):
        table = np.where(table & 0x80000000, (table << np.uint32(1)) ^ np.uint32(0x04C11DB7), table << np.uint32(1))
    return table


_CRC = [int(x) for x in _crc_table()]


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    body = b"\x00" + section
    return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10]) + body + b"\xff" * (184 - len(body))


TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def pad(data: bytes) -> bytes:
    """Up to a positive multiple of the unit, with bytes 255."""
    return data + b"\xff" * (UNIT - len(data) if not data else -len(data) % UNIT)


def write_stream(payload: bytes) -> bytes:
    """A transport stream of a payload whose length is a positive multiple of 576."""
    units = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    n = len(units)
    i = np.arange(n, dtype=np.int64)
    out = np.full((n, 4, PACKET), 0xFF, dtype=np.uint8)
    out[:, :, 0] = 0x47
    out[:, :, 1] = DATA_PID >> 8
    out[:, :, 2] = DATA_PID & 255
    out[:, 0, 1] |= 0x40
    out[:, :, 3] = np.array([0x30, 0x10, 0x10, 0x30]) | ((4 * i[:, None] + np.arange(4)) & 15)
    pts = i * TICKS & (1 << 33) - 1
    first = out[:, 0]
    first[:, 4] = 7
    first[:, 5] = np.where(i % ACCESS, 0x10, 0x50)
    first[:, 6], first[:, 7], first[:, 8], first[:, 9] = pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255
    first[:, 10] = (pts & 1) << 7 | 0x7E
    first[:, 11] = 0
    first[:, 12:21] = np.frombuffer(b"\x00\x00\x01" + bytes([STREAM_ID]) + (8 + UNIT).to_bytes(2, "big") + b"\x84\x80\x05", dtype=np.uint8)
    first[:, 21] = 0x21 | (pts >> 30 & 7) << 1
    first[:, 22] = pts >> 22 & 255
    first[:, 23] = (pts >> 15 & 127) << 1 | 1
    first[:, 24] = pts >> 7 & 255
    first[:, 25] = (pts & 127) << 1 | 1
    at = PACKET - 26
    first[:, 26:] = units[:, :at]
    out[:, 1, 4:] = units[:, at : at + 184]
    out[:, 2, 4:] = units[:, at + 184 : at + 368]
    rest = UNIT - at - 368
    out[:, 3, 4] = 183 - rest
    out[:, 3, 5] = 0
    out[:, 3, PACKET - rest :] = units[:, at + 368 :]
    return TABLES + out.tobytes()


@dataclass
class Stream:
    """What a transport stream holds: the payload of its first elementary stream, times and access points by unit."""

    payload: bytes = b""
    programs: list[int] = field(default_factory=list)
    stream_type: int = -1
    pid: int = -1
    pts: list[int] = field(default_factory=list)
    unit_bytes: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)
    packets: int = 0
    discontinuities: int = 0
    repeated: int = 0
    errors: int = 0


def _section_of(packets: np.ndarray, starts: np.ndarray, pid: np.ndarray, want: int, table_id: int) -> bytes | None:
    """The first whole section of a table whose checksum holds."""
    data = b""
    for k in np.flatnonzero(pid == want):
        part = packets[k, starts[k] :].tobytes()
        if packets[k, 1] & 0x40:
            if not part:
                continue
            data = part[1 + part[0] :]
        elif data:
            data += part
        if len(data) >= 3 and data[0] == table_id and len(data) >= (size := 3 + ((data[1] & 15) << 8 | data[2])):
            if crc32_mpeg(data[:size]) == 0:
                return data[:size]
            data = b""
    return None


def read_stream(media: bytes | None) -> Stream:
    """Parse a transport stream. Packets without sync byte, with the error flag or with a bad adaptation field count as errors and are left out."""
    s = Stream()
    if not media:
        return s
    whole = len(media) // PACKET
    s.errors += int(len(media) % PACKET > 0)
    p = np.frombuffer(media, dtype=np.uint8, count=whole * PACKET).reshape(-1, PACKET)
    s.packets = whole
    control = p[:, 3] >> 4 & 3
    field_len = np.where(control >= 2, p[:, 4].astype(np.int64) + 1, 0)
    starts = 4 + field_len
    good = (p[:, 0] == 0x47) & (p[:, 1] & 0x80 == 0) & (starts <= PACKET)
    s.errors += int((~good).sum())
    pid = np.where(good, (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2], -1)
    pat = _section_of(p, starts, pid, 0, 0)
    if pat is None:
        return s
    entries = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(pat) - 4, 4)]
    s.programs = [a for a, _ in entries if a]
    if not s.programs:
        return s
    pmt = _section_of(p, starts, pid, next(b for a, b in entries if a), 2)
    if pmt is None:
        return s
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    if at + 5 > len(pmt) - 4:
        return s
    s.stream_type, s.pid = pmt[at], (pmt[at + 1] & 31) << 8 | pmt[at + 2]
    own = np.flatnonzero(pid == s.pid)
    own = own[control[own] & 1 == 1]
    if not len(own):
        return s
    q, begin = p[own], starts[own]
    has_field = (control[own] >= 2) & (field_len[own] > 1)
    flags = np.where(has_field, q[:, 5], 0)
    step = np.diff(q[:, 3].astype(np.int64) & 15) & 15
    same = np.concatenate([[False], (step == 0) & (q[1:] == q[:-1]).all(axis=1)])
    s.repeated = int(same.sum())
    jump = np.concatenate([[False], (step != 1)]) & ~same & (flags & 0x80 == 0)
    s.discontinuities = int(jump.sum())
    q, begin, flags = q[~same], begin[~same], flags[~same]
    sizes = PACKET - begin
    data = q[np.arange(PACKET)[None, :] >= begin[:, None]]
    ends = np.cumsum(sizes)
    unit_first = np.flatnonzero(q[:, 1] & 0x40)
    if not len(unit_first):
        s.errors += 1
        return s
    edges = np.append((ends - sizes)[unit_first], ends[-1])
    # units whose header has the usual form are read together
    a, b = edges[:-1], edges[1:]
    ok = b - a >= 9
    head = data[np.minimum(a[:, None] + np.arange(14), len(data) - 1)].astype(np.int64)
    ok &= (head[:, 0] == 0) & (head[:, 1] == 0) & (head[:, 2] == 1)
    declared = (head[:, 4] << 8 | head[:, 5]) + 6
    stop = np.where(declared > 6, np.minimum(a + declared, b), b)
    first = a + 9 + head[:, 8]
    ok &= (first <= stop) & ((declared == 6) | (declared <= b - a))
    s.errors += int((~ok).sum())
    timed = (head[:, 7] & 0x80 > 0) & (b - a >= 14)
    pts = np.where(timed, (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | (head[:, 11] >> 1) << 15 | head[:, 12] << 7 | head[:, 13] >> 1, -1)
    size = np.where(ok, stop - first, 0)
    keep = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(keep, first[ok], 1)
    np.add.at(keep, stop[ok], -1)
    s.payload = data[np.cumsum(keep[:-1], dtype=np.int8) > 0].tobytes()
    s.pts, s.unit_bytes = pts[ok].tolist(), size[ok].tolist()
    s.access_points = np.flatnonzero(flags[unit_first][ok] & 0x40).tolist()
    return s


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as a transport stream. Null is empty, and an empty text has one unit of padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                data = batch.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([write_stream(pad(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, MEDIA)


def feature(s: Stream) -> str:
    """Counts, times and access points in one line."""
    times = [t for t in s.pts if t >= 0]
    return f"programs={len(s.programs)};type={s.stream_type};pid={s.pid};packets={s.packets};units={len(s.unit_bytes)};access={len(s.access_points)};pts={min(times, default=-1)}-{max(times, default=-1)};jumps={s.discontinuities};repeated={s.repeated};errors={s.errors}"


def read_back(media: DataFrame) -> DataFrame:
    """The stored streams parsed again: digests of the payload and of the stream, the features, the times of the units and the random-access points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                rows = []
                for i, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    s = read_stream(data)
                    x = s.payload
                    rows.append({"doc_id": i, "n_bytes": n, "payload_bytes": len(x), "payload_sha256": hashlib.sha256(x).hexdigest(), "tail_crc32": zlib.crc32(x[-32:]), "media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest(), "feature": feature(s), "pts": s.pts, "access_points": s.access_points})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(k, kinds[t]) for k, t in (x.split() for x in (FEATURES + PLACES).split(", "))])
    return media.mapInArrow(run, FEATURES + PLACES)


def timeline(media: DataFrame) -> DataFrame:
    """doc_id, pts, unit_bytes, access_points: the time and size of every unit, and the numbers of those where reading can begin."""
    schema = "doc_id long, pts array<long>, unit_bytes array<long>, access_points array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for whole in batches:
            for batch in slices(whole, "media"):
                streams = [read_stream(x) for x in batch.column("media").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([getattr(s, c) for s in streams], kind) for c in ("pts", "unit_bytes", "access_points")]], ["doc_id", "pts", "unit_bytes", "access_points"])

    return media.select("doc_id", "media").mapInArrow(run, schema)
