"""Media columns (operator 9): MPEG transport streams.

A payload of bytes is carried losslessly as one private elementary stream in a
transport stream of 188-byte packets: a program association table and a program
map table, then one packetized elementary (PES) packet per access unit, with a
presentation time stamp, a clock reference and, every ``gap`` units, a random
access point.  Reading takes any stream: it parses both tables (with their CRC), follows
the first elementary stream of the first program, checks its continuity counter,
reassembles the PES packets, checks their lengths and returns the payload with the time
stamps and the packet number of each random access point.

Null and empty texts are a payload of blanks.  Equal texts give equal streams.  Texts of
any length are stored whole, repeated rows once each.  Columns other than id and text
aren't read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_column

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x0000, 0x0100, 0x0101, 1, 0x06, 0xBD
#: Payload is a multiple of this many bytes; access units have so many of them.
UNIT, UNITS = 192, 32
#: 8-bit samples a second, and ticks of the 90 kHz clock a sample.
RATE, TICKS, GAP = 9000, 10, 8


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, most significant bit first, no final xor."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, table: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + table).ljust(PACKET, b"\xff")


TABLES = table_packet(PAT_PID, section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID,
    section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def read_pts(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def write_stream(payload: bytes, gap: int = GAP) -> bytes:
    """The transport stream that holds ``payload``."""
    packets, size, counter = [], UNIT * UNITS, 0
    for unit, at in enumerate(range(0, len(payload), size)):
        part, pts = payload[at : at + size], (at * TICKS) % (1 << 33)
        head = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + pts_bytes(pts)
        # first packet: adaptation field with flags and clock reference (8 bytes)
        flags = 0x10 | (0x40 if unit % gap == 0 else 0)
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        body = head + part
        room = PACKET - 4 - 8
        first = body[:room]
        stuffing = room - len(first)
        field = bytes([7 + stuffing, flags]) + clock + b"\xff" * stuffing
        packets.append(bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big") + bytes([0x30 | counter & 15]) + field + first)
        counter += 1
        rest = body[room:]
        full = len(rest) // (PACKET - 4)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            block[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            packets.append(block.tobytes())
            counter += full
        if tail := rest[full * (PACKET - 4) :]:
            pad = PACKET - 4 - len(tail)
            field = bytes([pad - 1]) + (b"\x00" + b"\xff" * (pad - 2) if pad > 1 else b"")
            packets.append(bytes([SYNC]) + DATA_PID.to_bytes(2, "big") + bytes([0x30 | counter & 15]) + field + tail)
            counter += 1
    return TABLES + b"".join(packets)


@dataclass
class Stream:
    payload: bytes  # of whole access units, in order
    pts: list[int | None]  # by access unit; null where a unit has none
    random_access: list[int]  # packet numbers
    packets: int
    cc_errors: int
    stream_type: int
    pid: int
    damaged: list[int]  # access units that lost packets; they have no payload


def check_section(whole: bytes, table_id: int) -> bytes:
    """Body of a section; its length and CRC are checked."""
    if len(whole) < 12 or whole[0] != table_id or crc32_mpeg(whole):
        raise ValueError("damaged program table")
    return whole[8:-4]


def read_section(packets: np.ndarray, begin: np.ndarray, table_id: int) -> bytes:
    """Body of the first whole section that begins in these packets of one PID."""
    whole = b""
    for packet, at in zip(packets, begin):
        data = packet[at:].tobytes()
        if packet[1] & 0x40:  # the pointer leads past the end of the section before
            whole = data[1 + data[0] :] if data else b""
        elif whole:
            whole += data
        if len(whole) >= 3 and len(whole) >= (size := 3 + (int.from_bytes(whole[1:3], "big") & 0xFFF)):
            return _section(whole[:size], table_id)
    raise ValueError("no whole program table")


_KNOWN: dict[tuple[bytes, int], bytes] = {}


def _section(whole: bytes, table_id: int) -> bytes:
    """check_section(), with sections checked before looked up (streams mostly share them)."""
    key = (whole, table_id)
    if key not in _KNOWN:
        if len(_KNOWN) > 1000:
            _KNOWN.clear()
        _KNOWN[key] = check_section(whole, table_id)
    return _KNOWN[key]


def read_pes(pes: bytes) -> tuple[bytes | None, int | None]:
    """Payload and time stamp of a PES packet; no payload where it is cut short."""
    if pes[:3] != b"\x00\x00\x01":
        raise ValueError("no PES start code")
    if len(pes) < 9 or len(pes) < 9 + pes[8]:
        return None, None
    pts = read_pts(pes[9:14]) if pes[7] & 0x80 and pes[8] >= 5 else None
    end = 6 + int.from_bytes(pes[4:6], "big")
    if end == 6:  # of unbounded length
        end = len(pes)
    return (pes[9 + pes[8] : end] if 9 + pes[8] <= end <= len(pes) else None), pts


def read_stream(data: bytes, strict: bool = False) -> Stream:
    """Parse a transport stream.

    Adaptation fields may stand in any packet, tables may span packets, and a packet
    that is sent twice counts once.  A unit is damaged if packets are missing in it (by
    the continuity counter, unless a discontinuity is announced), or if it is shorter than its
    PES header says; one of known length isn't touched by what is lost behind its end.  Packets
    without a beginning, before the first unit or behind the end of one, and a gap between whole
    units of known length, are a damaged unit of their own, without a time stamp.  Where
    ``strict``, any of these is an error.  Raises ValueError where sync, tables, fields or start codes are
    damaged or missing, and where packets of the stream are scrambled.
    """
    if len(data) % PACKET:
        raise ValueError("length isn't a multiple of the packet size")
    grid = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    has_field, has_payload = grid[:, 3] & 0x20 != 0, grid[:, 3] & 0x10 != 0
    begin = np.where(has_field, 5 + grid[:, 4].astype(np.int64), 4)
    if (begin > PACKET).any():
        raise ValueError("adaptation field beyond its packet")
    if (grid[:, 1] & 0x80 != 0).any():
        raise ValueError("packet with a transport error")

    def section(pid: int, table_id: int) -> bytes:
        own = np.flatnonzero((pids == pid) & has_payload)
        return read_section(grid[own], begin[own], table_id)

    pat = section(PAT_PID, 0x00)
    programs = [pat[k : k + 4] for k in range(0, len(pat) - 3, 4) if pat[k : k + 2] != b"\0\0"]  # 0 names the network
    if not programs:
        raise ValueError("no program")
    pmt = section(int.from_bytes(programs[0][2:], "big") & 0x1FFF, 0x02)
    at = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
    if len(pmt) < at + 5:
        raise ValueError("no elementary stream")
    stream_type, pid = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF

    rows = np.flatnonzero((pids == pid) & has_payload)
    if not len(rows):
        raise ValueError("no packet of the elementary stream")
    if (grid[rows, 3] & 0xC0 != 0).any():
        raise ValueError("scrambled packet")
    flags = np.where(has_field & (grid[:, 4] > 0), grid[:, 5], 0)
    step = np.diff(grid[rows, 3] & 15) & 15
    same = np.r_[False, step == 0]
    same[same] = (grid[rows[same], 4:] == grid[rows[np.flatnonzero(same) - 1], 4:]).all(axis=1)
    lost = np.r_[False, step != 1] & ~same & (flags[rows] & 0x80 == 0)
    rows, lost = rows[~same], lost[~same]
    starts = np.flatnonzero(grid[rows, 1] & 0x40 != 0)
    inside = np.arange(PACKET) >= begin[rows, None]
    body = grid[rows][inside].tobytes()
    upto = np.r_[0, np.cumsum(PACKET - begin[rows])]
    parts, pts, damaged = [], [], []

    def beginning_lost() -> None:
        damaged.append(len(pts))
        pts.append(None)

    if not len(starts) or starts[0]:
        beginning_lost()
    for a, b in zip(starts, np.r_[starts[1:], len(rows)]):
        pes = body[upto[a] : upto[b]]
        part, stamp = read_pes(pes)
        bounded = int.from_bytes(pes[4:6], "big")
        # a unit of known length ends with the packet that fills it, whatever follows
        end = int(np.searchsorted(upto, upto[a] + 6 + bounded)) if bounded and part is not None else b
        after = b < len(rows) and lost[b]  # what a unit of unbounded length may have lost at its end
        whole = part is not None and not lost[a + 1 : end].any() and (bounded or not after)
        if whole:
            parts.append(part)
        else:
            damaged.append(len(pts))
        pts.append(stamp)
        if whole and bounded and (end < b or after):
            beginning_lost()
    errors = int(lost.sum())
    if strict and (errors or damaged or not len(starts)):
        raise ValueError(f"{errors} gaps in the continuity counter, damaged units {damaged} of {len(starts)}")
    random_access = rows[flags[rows] & 0x40 != 0].tolist()
    return Stream(b"".join(parts), pts, random_access, len(grid), errors, stream_type, pid, damaged)


def payload_of(text: bytes) -> bytes:
    """The text and blanks up to a positive multiple of 192 bytes."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b" ")


def feature(stream: Stream) -> str:
    """Stream facts and the level of the samples in eight parts of the payload."""
    samples = np.frombuffer(stream.payload, np.uint8)
    levels = "/".join(f"{p.mean():.3f}" for p in np.array_split(samples, 8))
    points = hashlib.sha256(",".join(map(str, stream.random_access)).encode()).hexdigest()[:16]
    return (
        f"pid={stream.pid:#x};type={stream.stream_type};packets={stream.packets};cc_errors={stream.cc_errors};"
        f"pts={stream.pts[0]}-{stream.pts[-1]};units={len(stream.pts)};rap={len(stream.random_access)}:{points};levels={levels}"
    )


def store_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, media): the stored form of each row's whole text."""
    return map_column(docs, lambda: lambda texts: {"media": [write_stream(payload_of(t)) for t in texts]}, "media binary", text, (id_col,), binary=True)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each row's text as a stream, read it back, and describe both."""

    def work(texts: list[bytes]) -> dict:
        out = []
        for t in texts:
            media = write_stream(payload_of(t))
            back = read_stream(media, strict=True)
            p = back.payload
            out.append((
                len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media),
                hashlib.sha256(media).hexdigest(), feature(back), back.pts, back.random_access,
            ))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access")
        return dict(zip(names, zip(*out))) if out else {n: [] for n in names}

    schema = (
        "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, pts array<long>, random_access array<long>"
    )
    return map_column(docs, lambda: work, schema, text, (id_col,), binary=True)
