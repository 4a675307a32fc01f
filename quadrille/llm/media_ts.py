"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``mux`` stores a payload losslessly as the private data stream of a one-program transport stream: a program
association table, a program map table, and packetised elementary-stream packets that each start at a random-access
point with a clock reference and a presentation timestamp. ``demux`` reads any transport stream: program tables with
their checksums, continuity counters, elementary packets put together again, timestamps and random-access points.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal streams; null ids pass through; repeated rows
are stored each for itself; very long texts are stored whole; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents_of, read_table, text_bytes

# Fixed values of the format.
PACKET = 188
SYNC = 0x47
NULL_PID = 0x1FFF
PRIVATE_STREAM_1 = 0xBD
#: Stream ids whose elementary packets carry no optional header.
BARE_STREAMS = frozenset({0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF})

# Choices of this writer.
PMT_PID = 0x1000
DATA_PID = 0x0100
DATA_TYPE = 0x06
UNIT_BYTES = 16_384
CLOCK_STEP = 3_600


def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint64) << 24
    for _ in range(8):
        rows = np.where(rows & 0x80000000, (rows << 1) ^ 0x04C11DB7, rows << 1) & 0xFFFFFFFF
    return rows


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables; 0 over a whole section that is intact."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ b]
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([DATA_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def stamp(value: int) -> bytes:
    """A 33-bit presentation timestamp with its marker bits."""
    return bytes([0x21 | (value >> 29) & 0x0E, (value >> 22) & 255, 0x01 | (value >> 14) & 0xFE, (value >> 7) & 255, 0x01 | (value << 1) & 0xFE])


def unstamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """``payload`` as a transport stream."""
    out, counter = [_PAT, _PMT], 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        clock = unit * CLOCK_STEP & (1 << 33) - 1
        part = payload[at : at + UNIT_BYTES]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(clock) + part
        # length, flags (random access, clock reference), the reference's 33-bit base, reserved bits, extension 0
        field_ = bytes([7, 0x50]) + (clock << 15 | 0x7E00).to_bytes(6, "big")
        first = PACKET - 4 - len(field_)
        if len(pes) < first:
            field_ = bytes([PACKET - 5 - len(pes)]) + field_[1:] + b"\xff" * (first - len(pes))
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter]) + field_ + pes[:first])
        counter = counter + 1 & 15
        rest = np.frombuffer(pes, np.uint8)[first:]
        whole, left = divmod(len(rest), PACKET - 4)
        if whole:
            rows = np.empty((whole, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            rows[:, 3] = 0x10 | (counter + np.arange(whole)) & 15
            rows[:, 4:] = rest[: whole * (PACKET - 4)].reshape(whole, -1)
            out.append(rows.tobytes())
            counter = counter + whole & 15
        if left:
            stuffing = PACKET - 5 - left
            pad = bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter]) + pad + rest[len(rest) - left :].tobytes())
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet: its data, timestamps (90 kHz), whether decoding can start here, and its first packet's place."""

    data: bytes
    pts: int | None
    dts: int | None
    random_access: bool
    packet: int
    stream_id: int
    complete: bool


@dataclass
class Report:
    packets: int = 0
    lost_sync: int = 0
    transport_errors: int = 0
    bad_sections: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    units: dict[int, list[Unit]] = field(default_factory=dict)


def _sections(pieces: np.ndarray, lengths: np.ndarray, starts: np.ndarray, report: Report) -> list[bytes]:
    """The intact sections of one table's payloads."""
    found, buffer = [], None
    at = 0
    data = pieces.tobytes()
    for n, start in zip(lengths.tolist(), starts.tolist(), strict=True):
        part = data[at : at + n]
        at += n
        if start and part:
            skip = part[0] + 1
            if buffer is not None:
                buffer += part[1:skip]
                found.append(buffer)
            buffer = part[skip:]
        elif buffer is not None:
            buffer += part
    if buffer is not None:
        found.append(buffer)
    out = []
    for x in found:
        while len(x) > 3 and x[0] != 0xFF:
            n = ((x[1] & 0x0F) << 8 | x[2]) + 3
            if len(x) < n or n < 12 or section_crc(x[:n]):
                report.bad_sections += 1
                break
            out.append(x[:n])
            x = x[n:]
    return out


def demux(stream: bytes) -> Report:
    """Everything a transport stream says about itself, and its elementary packets. Damaged packets are counted and left out."""
    report = Report(packets=len(stream) // PACKET)
    if not report.packets:
        return report
    rows = np.frombuffer(stream, np.uint8)[: report.packets * PACKET].reshape(-1, PACKET)
    good = rows[:, 0] == SYNC
    report.lost_sync = int((~good).sum())
    broken = good & (rows[:, 1] & 0x80 != 0)
    report.transport_errors = int(broken.sum())
    good &= ~broken
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    adapted = control & 2 != 0
    length = np.where(adapted, rows[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(adapted & (length > 1), rows[:, 5], 0)
    offset = np.where(control & 1 != 0, np.minimum(4 + length, PACKET), PACKET)
    good &= (pids != NULL_PID) & (control != 0)
    column = np.arange(PACKET)

    def payloads(pid: int):
        """Payload bytes, their lengths, starts, random-access flags and packet numbers; continuity is checked on the way."""
        at = np.flatnonzero(good & (pids == pid) & (control & 1 != 0))
        if not len(at):
            return None
        count = rows[at, 3] & 15
        step = np.concatenate([[1], (count[1:].astype(np.int16) - count[:-1]) & 15])
        again = step == 0
        again[1:] &= (rows[at[1:], 4:] == rows[at[:-1], 4:]).all(axis=1) if again.any() else False
        report.duplicates += int(again.sum())
        jump = (step != 1) & ~again & (flags[at] & 0x80 == 0)
        report.continuity_errors += int(jump.sum())
        # a jump that follows a duplicate is judged from the duplicate, which has the same counter
        jump, at = jump[~again], at[~again]
        mask = column[None, :] >= offset[at][:, None]
        return rows[at][mask], PACKET - offset[at], rows[at, 1] & 0x40 != 0, flags[at] & 0x40 != 0, at, jump

    if (found := payloads(0)) is None:
        return report
    maps: dict[int, int] = {}
    for s in _sections(found[0], found[1], found[2], report):
        if s[0] == 0x00:
            for i in range(8, len(s) - 4, 4):
                if number := s[i] << 8 | s[i + 1]:
                    maps[number] = (s[i + 2] & 0x1F) << 8 | s[i + 3]
    for number, pid in sorted(maps.items()):
        streams = report.programs.setdefault(number, {})
        if (found := payloads(pid)) is None:
            continue
        for s in _sections(found[0], found[1], found[2], report):
            if s[0] != 0x02 or (s[3] << 8 | s[4]) != number:
                continue
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = s[i]
                i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    for pid in sorted({p for streams in report.programs.values() for p in streams}):
        if (found := payloads(pid)) is not None:
            report.units[pid] = _units(*found)
    return report


def _units(data, lengths, starts, access, packets, jump) -> list[Unit]:
    ends = np.cumsum(lengths)
    begin = np.flatnonzero(starts)
    raw, out = data.tobytes(), []
    for k, i in enumerate(begin.tolist()):
        j = int(begin[k + 1]) if k + 1 < len(begin) else len(lengths)
        x = raw[int(ends[i] - lengths[i]) : int(ends[j - 1])]
        if len(x) < 6 or x[:3] != b"\x00\x00\x01":
            continue
        n, head, pts, dts = x[4] << 8 | x[5], 6, None, None
        if x[3] not in BARE_STREAMS and len(x) >= 9:
            head = 9 + x[8]
            if x[7] & 0x80 and len(x) >= 14:
                pts = dts = unstamp(x[9:14])
            if x[7] & 0x40 and len(x) >= 19:
                dts = unstamp(x[14:19])
        end = 6 + n if n else len(x)
        out.append(Unit(x[head:end], pts, dts, bool(access[i]), int(packets[i]), x[3], len(x) >= end and not jump[i + 1 : j].any()))
    return out


def feature_text(report: Report) -> str:
    """One line of features: table counts, errors, and each stream's timestamps with its random-access points."""
    out = [f"packets={report.packets}", f"programs={len(report.programs)}", f"continuity={report.continuity_errors}", f"damaged={report.lost_sync + report.transport_errors + report.bad_sections}"]
    for pid, units in report.units.items():
        stamps = [u.pts for u in units if u.pts is not None]
        kind = next(s[pid] for s in report.programs.values() if pid in s)
        points = ",".join(f"{u.pts}@{u.packet}" for u in units if u.random_access)
        out.append(f"pid={pid} type={kind} units={len(units)} pts={min(stamps, default=-1)}-{max(stamps, default=-1)} access={points}")
    return ";".join(out)


def padded(data: bytes) -> bytes:
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``, the text's padded bytes as a transport stream."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mux(padded(x)) for x in text_bytes(b.column(1))], pa.binary())], ["doc_id", "media"])

    return documents_of(docs).mapInArrow(run, "doc_id long, media binary")


def index_media(media: DataFrame) -> DataFrame:
    """One row per elementary packet of the streams in ``media``: the timestamp and random-access index."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(d, pid, n, u.packet, u.pts, u.dts, u.random_access, len(u.data), u.complete) for d, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for pid, units in demux(m or b"").units.items() for n, u in enumerate(units)]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
            names = ["doc_id", "pid", "unit", "packet", "pts", "dts", "random_access", "n_bytes", "complete"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, pid int, unit int, packet long, pts long, dts long, random_access boolean, n_bytes long, complete boolean")


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text as a stream, reads the stored bytes back, and describes both."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for x in text_bytes(b.column(1)):
                media = mux(padded(x))
                report = demux(media)
                back = b"".join(u.data for units in report.units.values() for u in units)
                rows.append((len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_text(report)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    return documents_of(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(read_table(spark, sf_dir, "documents"))
