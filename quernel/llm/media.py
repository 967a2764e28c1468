"""Media columns: payloads in MPEG transport streams, and what a demultiplexer reads back.

Writing: a payload is cut into access units of UNIT bytes; each is a packet of an elementary stream
(private stream 1) with its presentation time, carried in transport packets of 188 bytes. Every
unit begins with an adaptation field that holds the clock, and each RAP-th is a random-access
point, before which the program tables stand again.

Reading: program tables are parsed, over as many packets as they take, and their checksums tested,
continuity counters checked, the elementary packets of a program's stream reassembled from whatever
packets carry them, and each unit's time, place and random-access flag kept. Streams of other
writers may hold several programs and streams, packets without a payload, packets sent twice and
units without a length or a time. Damaged tables raise an error; counters out of step are counted.

Null and empty texts have a payload of 64 zero bytes. Equal texts give equal streams. Rows are
taken one by one, so ties, repeated rows, null ids and empty tables need no care; a very long text
takes a few times its own size in one worker. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.llm.common import id_text, raw, ship, slices, stored, tidy

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, STREAM_ID, PRIVATE_TYPE = 188, 0x47, 0, 0xBD, 0x06
PMT_PID, PES_PID, PROGRAM = 0x1000, 0x0100, 1
#: Bytes in an access unit, units between random-access points, ticks of 90 kHz between units.
UNIT, RAP, TICKS = 4096, 8, 3600
_HEAD = 14
#: Kinds of elementary packets without the optional header, padding among them.
_PLAIN = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (5 + len(body) + 4)).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    p = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return np.frombuffer(p.ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack([
    _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | PES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | PES_PID).to_bytes(2, "big") + b"\xf0\x00")),
])


def _units(units: np.ndarray, first: int) -> np.ndarray:
    """Access units of one length (m, n) as transport packets (m, packets, 188), without counters."""
    m, n = units.shape
    pts = (np.arange(first, first + m, dtype=np.int64) * TICKS) & ((1 << 33) - 1)
    pes = np.empty((m, _HEAD + n), np.uint8)
    pes[:, :9] = [0, 0, 1, STREAM_ID, (8 + n) >> 8, (8 + n) & 0xFF, 0x84, 0x80, 5]
    pes[:, 9], pes[:, 10], pes[:, 11] = 0x21 | (pts >> 29 & 0xE), pts >> 22 & 0xFF, 1 | (pts >> 14 & 0xFE)
    pes[:, 12], pes[:, 13], pes[:, _HEAD:] = pts >> 7 & 0xFF, 1 | (pts << 1 & 0xFE), units
    total = pes.shape[1]
    middle, rest = divmod(max(0, total - 176), 184)
    k = 1 + middle + (rest > 0)
    out = np.full((m, k, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = SYNC, PES_PID >> 8, PES_PID & 0xFF, 0x10
    head = min(total, 176)
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] = 0x30
    out[:, 0, 4] = 183 - head
    out[:, 0, 5] = 0x10 | np.where(np.arange(first, first + m) % RAP == 0, 0x40, 0)
    # The clock is the time itself: 33 bits, 6 reserved, 9 of extension.
    clock = (pts << 15) | 0x7E00
    for i in range(6):
        out[:, 0, 6 + i] = clock >> 8 * (5 - i) & 0xFF
    out[:, 0, PACKET - head :] = pes[:, :head]
    if middle:
        out[:, 1 : 1 + middle, 4:] = pes[:, 176 : 176 + 184 * middle].reshape(m, middle, 184)
    if rest:
        out[:, -1, 3] = 0x30
        out[:, -1, 4] = 183 - rest
        if rest < 183:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - rest :] = pes[:, total - rest :]
    return out


def mux(payload: bytes) -> bytes:
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    parts = []
    full = _units(data[: whole * UNIT].reshape(whole, UNIT), 0) if whole else None
    tail = _units(data[whole * UNIT :][None, :], whole) if len(data) > whole * UNIT or not whole else None
    runs = [full[i : i + RAP].reshape(-1, PACKET) for i in range(0, whole, RAP)]
    if tail is not None:
        if whole % RAP:
            runs[-1] = np.concatenate([runs[-1], tail[0]])
        else:
            runs.append(tail[0])
    for r in runs:
        parts += [_TABLES, r]
    out = np.concatenate(parts)
    is_pes = out[:, 2] == (PES_PID & 0xFF)
    is_pes &= (out[:, 1] & 0x1F) == PES_PID >> 8
    counters = np.cumsum(is_pes) - 1
    tables = np.cumsum(~is_pes)
    out[:, 3] |= np.where(is_pes, counters & 15, (tables - 1) // 2 & 15).astype(np.uint8)
    return out.tobytes()


def _sections(packets: np.ndarray, table: int) -> list[bytes]:
    """The bodies of a table's sections, which may go over several packets; each must be whole."""
    if not len(packets):
        raise ValueError("a program table is missing")
    bodies: dict[bytes, None] = {}
    starts = np.flatnonzero(packets[:, 1] & 0x40)
    # Tables are sent again and again; those like an earlier one are read once.
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(packets)]):
        data = b"".join(bytes(p[5 + p[4] if p[3] & 0x20 else 4 :]) for p in packets[i:j] if p[3] & 0x10)
        bodies[data] = None
    out: dict[bytes, None] = {}
    for data in bodies:
        at = 1 + data[0]
        while at + 3 <= len(data) and data[at] != 0xFF:
            section = data[at : at + 3 + ((data[at + 1] & 0x0F) << 8 | data[at + 2])]
            if section[0] == table:
                if crc32_mpeg(section) != 0:
                    raise ValueError("a program table is damaged")
                out[section[8:-4]] = None
            at += max(len(section), 3)
    if not out:
        raise ValueError("a program table is missing")
    return list(out)


def streams(packets: np.ndarray, pid: np.ndarray) -> list[tuple[int, int, int]]:
    """(program, type, pid) of each elementary stream, as the program tables have them."""
    out = []
    for pat in _sections(packets[pid == PAT_PID], 0):
        for k in range(0, len(pat) - 3, 4):
            program, at = int.from_bytes(pat[k : k + 2], "big"), int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF
            if program == 0:  # the network's table, no program
                continue
            for pmt in _sections(packets[pid == at], 2):
                i = 4 + (int.from_bytes(pmt[2:4], "big") & 0x0FFF)
                while i + 5 <= len(pmt):
                    out.append((program, pmt[i], int.from_bytes(pmt[i + 1 : i + 3], "big") & 0x1FFF))
                    i += 5 + (int.from_bytes(pmt[i + 3 : i + 5], "big") & 0x0FFF)
    return out


def demux(media: bytes | memoryview, stream: int | None = None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, dict]:
    """payload, times (-1: none), places in the payload and random-access flags of a stream's units, and
    counts. stream: its packet identifier; without one the first stream of the first program.

    Packets without a payload don't count; a packet sent twice counts once. A unit without a length
    goes on to the next one. What stands before the first unit's beginning is left out.
    """
    if len(media) % PACKET:
        raise ValueError("the last packet is cut off")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if not (packets[:, 0] == SYNC).all():
        raise ValueError("a packet doesn't begin with the sync byte")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    known = streams(packets, pid)
    chosen = [x for x in known if stream is None or x[2] == stream]
    if not chosen:
        raise ValueError("no program has such a stream")
    program, kind, stream = chosen[0]
    p = packets[pid == stream]
    p = p[(p[:, 3] & 0x10) != 0]
    field = (p[:, 3] & 0x20) != 0
    flags = np.where(field & (p[:, 4] > 0), p[:, 5], 0)
    step = (p[1:, 3].astype(np.int16) - p[:-1, 3]) & 15
    again = step == 0
    if again.any():
        again[again] = (p[1:][again, 4:] == p[:-1][again, 4:]).all(axis=1)
    lost = int(((step != 1) & ~again & ((flags[1:] & 0x80) == 0)).sum())
    first = np.concatenate([np.ones(min(len(p), 1), bool), ~again])
    p, field, flags = p[first], field[first], flags[first]
    begin = np.where(field, 5 + p[:, 4].astype(np.int64), 4)
    body = p[np.arange(PACKET)[None, :] >= begin[:, None]]
    sizes = np.maximum(PACKET - begin, 0)
    starts = np.flatnonzero(p[:, 1] & 0x40)
    at = (np.cumsum(sizes) - sizes)[starts]
    to = np.append(at[1:], len(body)) if len(at) else at
    head = np.concatenate([body, np.zeros(_HEAD, np.uint8)])[at[:, None] + np.arange(_HEAD)].astype(np.int64)
    if (head[:, :3] != [0, 0, 1]).any():
        raise ValueError("an elementary packet doesn't begin with its start code")
    plain = np.isin(head[:, 3], _PLAIN)
    skip = np.where(plain, 6, 9 + head[:, 8])
    length = head[:, 4] << 8 | head[:, 5]
    last = np.where(length == 0, to, np.minimum(at + 6 + length, to))
    data = np.minimum(at + skip, last)
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | (head[:, 11] >> 1) << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    pts = np.where(~plain & ((head[:, 7] & 0x80) != 0), pts, -1)
    edge = np.zeros(len(body) + 1, np.int8)
    np.add.at(edge, data, 1)
    np.add.at(edge, last, -1)
    payload = body[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
    rap = (flags[starts] & 0x40) != 0
    counts = {"program": program, "type": kind, "streams": len(known), "packets": len(packets), "units": len(starts), "lost": lost, "repeated": int(again.sum()), "tables": int((pid == PAT_PID).sum())}
    size = last - data
    return payload, pts, np.cumsum(size) - size, rap, counts


def payload_of(text: bytes | memoryview) -> bytes:
    n = len(text)
    return bytes(text).ljust(max(64, -(-n // 64) * 64), b"\0")


def write(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each text, stored in the shared folder."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = raw(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return stored(id_text(docs).mapInArrow(tidy(run), "doc_id long, n_bytes long, media binary"))


def read(media: DataFrame, payload: bool = True) -> DataFrame:
    """Each stored stream (doc_id, n_bytes, media) read back: its payload, where asked for, and the
    payload's digests, the units (time, place, random_access), a feature string and the packets lost."""
    ship(media.sparkSession)
    unit = pa.struct([("pts", pa.int64()), ("at", pa.int64()), ("random_access", pa.bool_())])
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets", "lost", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column=2):
                rows, units = [], []
                for m in raw(part.column(2)):
                    data, pts, at, rap, n = demux(m)
                    units.append((pts, at, rap))
                    samples = np.frombuffer(data, np.uint8)
                    feature = f"program={n['program']};type={n['type']};packets={n['packets']};tables={n['tables']};units={n['units']};lost={n['lost']};first={pts[0]};last={pts[-1]};random_access={int(rap.sum())};sum={int(samples.sum(dtype=np.int64))};max={int(samples.max())}"
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature, n["packets"], n["lost"], data if payload else None))
                bounds = pa.array(np.cumsum([0, *(len(u[0]) for u in units)]), pa.int32())
                flat = [np.concatenate(x) for x in zip(*units)]
                listed = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(flat, unit)], fields=list(unit)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), listed], ["doc_id", "n_bytes", *names, "units"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long, lost long, payload binary, units array<struct<pts: long, at: long, random_access: boolean>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), schema)
