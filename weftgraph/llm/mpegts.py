"""Media columns as MPEG transport streams.

A payload is cut into elementary packets (PES) of private data, each with a
presentation timestamp; they travel in 188-byte packets after a program
association and a program map table.  Reading parses the tables to find the
stream, checks the continuity counters, reassembles the elementary packets and
notes their timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import batch_of, columns, keyed, run, slices

#: Fixed values of the container format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, STUFFING = 188, 0x47, 0x0000, 0xFF
PRIVATE_STREAM, PRIVATE_TYPE = 0xBD, 0x06
CLOCK = 90_000

PMT_PID, DATA_PID, PROGRAM = 0x0100, 0x0101, 1
UNIT = 192
#: Payload bytes of an elementary packet, and ticks between their timestamps.
PES_BYTES, PES_TICKS = 170 * UNIT, CLOCK // 25
#: Every so many elementary packets starts a random-access point.
GROUP = 8


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A packet with one table section."""
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (5 + len(body) + 4), number, 0xC1, 0, 0) + body
    head += struct.pack(">I", crc_mpeg(head))
    packet = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + head
    return packet.ljust(PACKET, bytes([STUFFING]))


TABLES = _section(PAT_PID, 0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)) + _section(
    PMT_PID, 2, PROGRAM, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000)
)


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), PES_BYTES)):
        part = payload[at : at + PES_BYTES]
        pes = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(part) + 8, 0x84, 0x80, 5) + _stamp(k * PES_TICKS) + part
        # The first packet has an adaptation field with the random-access flag and the clock; the last one is stuffed.
        flags = (0x40 if k % GROUP == 0 else 0) | 0x10
        base = k * PES_TICKS
        first = struct.pack(">BIH", flags, base >> 1, (base & 1) << 15 | 0x7E00)
        room = PACKET - 4 - 1 - len(first)
        if len(pes) < room:
            first += bytes([STUFFING]) * (room - len(pes))
            room = len(pes)
        out.append(struct.pack(">BHBB", SYNC, 0x4000 | DATA_PID, 0x30 | counter, len(first)) + first + pes[:room])
        counter = counter + 1 & 15
        full, tail = divmod(len(pes) - room, PACKET - 4)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
            block[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), room).reshape(full, -1)
            out.append(block.tobytes())
            counter = counter + full & 15
        if tail:
            pad = PACKET - 4 - tail
            fill = bytes([pad - 1]) + (b"\0" + bytes([STUFFING]) * (pad - 2) if pad > 1 else b"")
            out.append(struct.pack(">BHB", SYNC, DATA_PID, 0x30 | counter) + fill + pes[-tail:])
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    packets: int
    stamps: list[int] = field(default_factory=list)
    #: Numbers of the transport packets at which decoding can start.
    random_access: list[int] = field(default_factory=list)
    breaks: int = 0


def _find_stream(packets: np.ndarray) -> int:
    """PID of the program's first elementary stream, by the two tables."""
    pid = ((packets[:, 1].astype(int) & 0x1F) << 8) | packets[:, 2]

    def body(of: int, table: int) -> bytes:
        at = np.flatnonzero((pid == of) & (packets[:, 1] & 0x40 != 0))
        if not len(at):
            raise ValueError(f"no table on PID {of}")
        raw = packets[at[0]].tobytes()
        raw = raw[5 + raw[4] :]
        size = 3 + (struct.unpack(">H", raw[1:3])[0] & 0xFFF)
        if raw[0] != table or crc_mpeg(raw[:size]):
            raise ValueError(f"bad table on PID {of}")
        return raw[8 : size - 4]

    entries = body(PAT_PID, 0)
    for k in range(0, len(entries), 4):
        number, to = struct.unpack(">HH", entries[k : k + 4])
        if number:
            program = body(to & 0x1FFF, 2)
            skip = 4 + (struct.unpack(">H", program[2:4])[0] & 0xFFF)
            return struct.unpack(">H", program[skip + 1 : skip + 3])[0] & 0x1FFF
    raise ValueError("no program")


def demux(stream: bytes) -> Stream:
    """Read a transport stream; raises ValueError where it is damaged beyond its counters."""
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    wanted = _find_stream(packets[: 1 + min(len(packets), 64)])
    pid = ((packets[:, 1].astype(np.int32) & 0x1F) << 8) | packets[:, 2]
    at = np.flatnonzero(pid == wanted)
    own = packets[at]
    counter = own[:, 3] & 15
    breaks = int((np.diff(counter.astype(int)) % 16 != 1).sum())
    adapted = own[:, 3] & 0x20 != 0
    skip = np.where(adapted, own[:, 4].astype(int) + 5, 4)
    starts = np.flatnonzero(own[:, 1] & 0x40 != 0)
    out = Stream(b"", len(packets), breaks=breaks)
    out.random_access = at[adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)].tolist()
    parts = []
    keep = np.arange(PACKET) >= skip[:, None]
    for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
        pes = own[a:b][keep[a:b]].tobytes()
        code, size, _, has, extra = struct.unpack(">IHBBB", pes[:9])
        if code != 0x100 | PRIVATE_STREAM or len(pes) != size + 6:
            raise ValueError("bad elementary packet")
        if has & 0x80:
            x, y, z = struct.unpack(">BHH", pes[9:14])
            out.stamps.append((x & 0x0E) << 29 | (y >> 1) << 15 | z >> 1)
        parts.append(pes[9 + extra :])
    out.payload = b"".join(parts)
    return out


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def feature(s: Stream) -> str:
    """What the stream tells of itself: packets, elementary packets, breaks, last timestamp, random-access points, mean and deviation of its samples."""
    samples = np.frombuffer(s.payload, np.uint8)
    mean = int(samples.sum(dtype=np.int64)) / len(samples)
    power = int((np.bincount(samples, minlength=256) * np.arange(256) ** 2).sum()) / len(samples)
    return f"packets={s.packets};pes={len(s.stamps)};breaks={s.breaks};last_pts={s.stamps[-1]};rap={','.join(map(str, s.random_access))};mean={mean:.4f};dev={max(0.0, power - mean * mean) ** 0.5:.4f}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Store each whole text as a transport stream and read it back.

    Returns doc_id, n_bytes and either media binary, payload binary (read back,
    padded), stamps array<long> and random_access array<int>, or with ``digests``
    the columns of the digest.  Null texts count as empty; a payload has one unit
    at least.  Map-only; equal texts give equal values; repeated rows come
    through; other columns are left out.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64())]
    if digests:
        fields += [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    else:
        fields += [("media", pa.binary()), ("payload", pa.binary()), ("stamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int32())), ("feature", pa.string())]
    schema = pa.schema(fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            for a, b in slices(texts, most=1 << 22):
                rows = []
                for i, t in zip(ids[a:b], texts[a:b], strict=True):
                    data = (t or "").encode()
                    media = mux(pad(data))
                    back = demux(media)
                    if digests:
                        rows.append((i, len(data), len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
                    else:
                        rows.append((i, len(data), media, back.payload, back.stamps, back.random_access, feature(back)))
                yield batch_of(schema, list(zip(*rows, strict=True)))

    out = "doc_id long, n_bytes long, " + (
        "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
        if digests
        else "media binary, payload binary, stamps array<long>, random_access array<int>, feature string"
    )
    return run(keyed(df, id_col, text_col), kernel, out)
