"""Media columns as MPEG transport streams: multiplex payloads, store them, parse them back.

``mux`` writes a programme with one private-data elementary stream: PAT and PMT sections (with CRC), access units as PES
packets with presentation timestamps, continuity counters, clock references and random-access flags.  ``demux`` parses
programme tables, checks continuity counters, reassembles the elementary packets and lists the timestamps with the
random-access points and the place of each access unit in the payload.  ``store`` keeps that index beside the stream, so
a reader can seek; ``features`` holds it against the stream it reads back.

Defined cases: null and empty texts are one block of 64 zero bytes; texts of any length are stored whole (an access unit
is at most UNIT bytes); equal texts have equal streams; repeated rows are stored each; a null doc_id stays null; empty
tables give no rows; extra columns are ignored; bytes that are not UTF-8 are stored as they are.  A stream with lost, repeated or damaged packets is parsed as far as it
goes and the faults are counted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import scratch_dir, sub_batches

PACKET = 188
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PROGRAM = 1
#: ISO/IEC 13818-1: stream_type of private PES data, stream_id of private_stream_1.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Bytes of payload in an access unit; units from one random-access point to the next; 90 kHz ticks between units.
UNIT, GROUP, TICKS, FIRST_PTS = 4096, 8, 3600, 90_000
PAD = 64


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of MPEG sections: polynomial 04C11DB7, no reflection, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _make_tables() -> tuple[bytes, ...]:
    """Payloads of the PAT's and the PMT's packet."""
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return tuple((b"\x00" + s).ljust(PACKET - 4, b"\xff") for s in (pat, pmt))


_TABLES = _make_tables()


def _timestamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 0xFF, (t >> 15 & 0x7F) << 1 | 1, t >> 7 & 0xFF, (t & 0x7F) << 1 | 1])


def pad(text: str | bytes | None) -> bytes:
    raw = text or b""
    raw = raw.encode("utf-8") if isinstance(raw, str) else raw
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b"\x00")


def mux(payload: bytes) -> bytes:
    return mux_indexed(payload)[0]


def mux_indexed(payload: bytes) -> tuple[bytes, list[tuple[int, int, bool]]]:
    """The stream, and of each access unit its timestamp, its place in the payload and whether a reader can begin there."""
    out: list[bytes] = []
    index: list[tuple[int, int, bool]] = []
    count = {PAT_PID: 0, PMT_PID: 0, DATA_PID: 0}
    heads = {p: [bytes([0x47, p >> 8 & 0x1F, p & 0xFF, 0x10 | c]) for c in range(16)] for p in (DATA_PID,)}[DATA_PID]

    def table(pid: int, body: bytes) -> None:
        out.append(bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10 | count[pid] & 15]) + body)
        count[pid] += 1

    for i, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        entry, pts = i % GROUP == 0, (FIRST_PTS + i * TICKS) & (1 << 33) - 1
        index.append((pts, at, entry))
        if entry:
            for pid, body in zip((PAT_PID, PMT_PID), _TABLES, strict=True):
                table(pid, body)
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(2, pts) + unit
        # a clock reference and the random-access flag with the first packet of an entry
        field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big") if entry else b""
        start = True
        done = 0
        while done < len(pes):
            c = count[DATA_PID] & 15
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            body = pes[done : done + room]
            head = heads[c]
            if start:
                head = bytes([head[0], head[1] | 0x40, head[2], head[3]])
            spare = room - len(body)
            if field_ or spare:
                content = field_ or (b"\x00" if spare > 1 else b"")
                stuffing = spare - (0 if field_ else min(spare, 2))
                head = head[:3] + bytes([head[3] | 0x20, len(content) + stuffing]) + content + b"\xff" * stuffing
            out.append(head + body)
            done += len(body)
            count[DATA_PID] += 1
            start, field_ = False, b""
    return b"".join(out), index


@dataclass
class Stream:
    """What a transport stream held."""

    payload: bytes = b""
    packets: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    damaged: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int, bool]] = field(default_factory=list)  # pts, place in the payload, random access

    def feature(self) -> str:
        index = zlib.crc32(",".join(f"{p}:{o}:{int(r)}" for p, o, r in self.units).encode())
        entry = [o for _, o, r in self.units if r]
        return f"packets={self.packets};programs={len(self.programs)};streams={len(self.streams)};units={len(self.units)};entries={len(entry)};first_pts={self.units[0][0] if self.units else -1};last_pts={self.units[-1][0] if self.units else -1};last_entry={entry[-1] if entry else -1};cc_errors={self.continuity_errors};damaged={self.damaged};index={index:08x}"


def _section_of(body: bytes) -> tuple[int, bytes] | None:
    """(table id, content between header and CRC) of a section that its CRC proves whole."""
    start = 1 + body[0]
    if start + 3 > len(body):
        return None
    end = start + 3 + ((body[start + 1] & 0x0F) << 8 | body[start + 2])
    section = body[start:end]
    if len(section) < 12 or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        return None
    return section[0], section[8:-4]


#: Sections met before, as streams repeat a few; emptied when it has grown.
_SECTIONS: dict[bytes, tuple[int, bytes] | None] = {}


def _known_section(body: bytes) -> tuple[int, bytes] | None:
    if body not in _SECTIONS:
        if len(_SECTIONS) >= 1000:
            _SECTIONS.clear()
        _SECTIONS[body] = _section_of(body)
    return _SECTIONS[body]


def demux(stream: bytes) -> Stream:
    out, last, at = Stream(), {}, 0
    chunks: list[bytes] = []
    pes: list[bytes] = []
    size, entry = 0, False

    def close() -> None:
        nonlocal size
        if not pes:
            return
        whole = b"".join(pes)
        pes.clear()
        if whole[:3] != b"\x00\x00\x01" or len(whole) < 9:
            out.damaged += 1
            return
        end = int.from_bytes(whole[4:6], "big") + 6
        if len(whole) != end:
            out.damaged += 1
        body = whole[9 + whole[8] : end]
        pts = -1
        if whole[7] & 0x80 and len(whole) >= 14:
            t = whole[9:14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1
        out.units.append((pts, size, entry))
        chunks.append(body)
        size += len(body)

    while at + PACKET <= len(stream):
        if stream[at] != 0x47:  # look for the next sync byte
            out.damaged += 1
            at = stream.find(b"\x47", at + 1)
            if at < 0:
                break
            continue
        b1, b2, b3 = stream[at + 1], stream[at + 2], stream[at + 3]
        pid, control, counter = (b1 & 0x1F) << 8 | b2, b3 >> 4 & 3, b3 & 15
        begin, access = at + 4, False
        if control & 2:
            length = stream[begin]
            access = length > 0 and bool(stream[begin + 1] & 0x40)
            begin += 1 + length
        out.packets += 1
        end, at = at + PACKET, at + PACKET
        if not control & 1:
            continue
        before = last.get(pid)
        if before is not None and counter != (before + 1 & 15):
            if counter == before:
                out.duplicates += 1
                continue
            out.continuity_errors += 1
        last[pid] = counter
        if pid == PAT_PID or pid in out.programs.values():
            section = _known_section(stream[begin:end]) if b1 & 0x40 else None
            if section is None:
                out.damaged += 1
            elif section[0] == 0x00:
                c = section[1]
                out.programs |= {int.from_bytes(c[i : i + 2], "big"): int.from_bytes(c[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(c) - 3, 4)}
            elif section[0] == 0x02:
                c, i = section[1], 4 + (int.from_bytes(section[1][2:4], "big") & 0x0FFF)
                while i + 5 <= len(c):
                    out.streams[int.from_bytes(c[i + 1 : i + 3], "big") & 0x1FFF] = c[i]
                    i += 5 + (int.from_bytes(c[i + 3 : i + 5], "big") & 0x0FFF)
        elif pid in out.streams:
            if b1 & 0x40:
                close()
                entry = access
            elif not pes:
                continue  # the rest of a packet whose start is lost
            pes.append(stream[begin:end])
    close()
    out.payload = b"".join(chunks)
    return out


_UNIT_TYPE = "array<struct<pts: bigint, offset: bigint, random_access: boolean>>"
_MEDIA = f"doc_id long, n_bytes long, media binary, access_units {_UNIT_TYPE}"
_RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("random_access", pa.bool_())]))


def _unit_array(lists: list[list[tuple[int, int, bool]]]) -> pa.Array:
    return pa.array([[{"pts": p, "offset": o, "random_access": r} for p, o, r in units] for units in lists], _UNITS)


def _mux_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "text"):
        texts = batch.column("text").cast(pa.binary()).to_pylist()  # bytes as they are, be they UTF-8 or not
        made = [mux_indexed(pad(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([m for m, _ in made], pa.binary()), _unit_array([u for _, u in made])], names=["doc_id", "n_bytes", "media", "access_units"])


def _demux_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "media"):
        rows = []
        for doc, n, media, units in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "access_units")), strict=True):
            s = demux(media)
            held = [(u["pts"], u["offset"], u["random_access"]) for u in units or []]
            rows.append((doc, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), f"{s.feature()};stored_index={'same' if held == s.units else 'differs'}"))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sub_batches(batches, "media"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _unit_array([demux(m).units for m in batch.column("media").to_pylist()])], names=["doc_id", "access_units"])


def store(docs: DataFrame) -> DataFrame:
    """Write a media table to the shared folder and return it as read back.

    A row has doc_id, n_bytes, media (the transport stream) and access_units: timestamp, place in the payload and random
    access of each unit, so that a reader can seek by them without parsing the stream.
    """
    spark = docs.sparkSession
    path = scratch_dir(spark, "media-ts")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_mux_rows, _MEDIA).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_MEDIA).parquet(path)


def features(media: DataFrame) -> DataFrame:
    """Facts of each stored stream, computed from the stored bytes, and whether its stored index is the stream's."""
    return media.select("doc_id", "n_bytes", "media", "access_units").mapInArrow(_demux_rows, _RESULT)


def access_units(media: DataFrame) -> DataFrame:
    """The index of streams (doc_id, media) that came without one, parsed out of them."""
    return media.select("doc_id", "media").mapInArrow(_index_rows, f"doc_id long, access_units {_UNIT_TYPE}")
