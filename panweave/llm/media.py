"""Media columns: payloads stored as MPEG transport streams.

A stream has a program association table, a program map table, and one elementary stream of private data cut into
elementary packets of UNIT payload bytes. Each packet carries a presentation timestamp; every RAP_EVERY-th one
begins at a random-access point with a clock reference. Reading parses the tables (of any program whose sections may span
packets), checks the continuity counters, and puts the elementary packets together again. It takes what the format allows:
packets sent twice are read once, packets without payload don't count, a marked discontinuity is no error, and an elementary
packet of unstated length ends where the next one begins.

Defined cases: a null text counts as empty, and an empty one is stored as 192 spaces. Empty tables give empty
results. Repeated rows are stored one by one, to equal bytes. A stored null reads back as null. A damaged stream
raises MediaError when no tables, no sync byte or a wrong length is found; lost and faulty packets are counted as
continuity errors. An elementary packet without a timestamp has null there. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panweave.llm.common import map_texts, sliced, stored

# Fixed values of the transport stream format.
PACKET, SYNC, PAT_PID, PRIVATE_STREAM, PRIVATE_DATA = 188, 0x47, 0x0000, 0xBD, 0x06
CLOCK = 90_000

PMT_PID, STREAM_PID, PROGRAM = 0x100, 0x101, 1
BLOCK, UNIT, RAP_EVERY, PTS_STEP = 192, 192 * 64, 8, CLOCK // 25
FIELDS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_units long, n_random_access long, last_pts long, continuity_errors long, timestamps array<long>, random_access array<int>"
)
#: Kinds of elementary packets that have no header fields after their length.
BARE = {0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF}


class MediaError(ValueError):
    pass


class Stream(NamedTuple):
    payload: bytes
    timestamps: list[int | None]
    random_access: list[int]  # numbers of the elementary packets
    continuity_errors: int


@cache
def crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def section_crc(data: bytes) -> int:
    """CRC-32 of a table section: most significant bit first, not inverted."""
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ crc_table()[c >> 24 ^ x]
    return c


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def packet(pid: int, starts: bool, counter: int, payload: bytes, clock: int | None = None) -> bytes:
    """One transport packet; an adaptation field fills it up and, with a clock, marks a random-access point."""
    room = PACKET - 4 - len(payload)
    field = b""
    if clock is not None:
        field = b"\x50" + (clock % 2**33 << 15 | 0x7E00).to_bytes(6, "big")
    if clock is not None or room:
        field = (field or b"\x00")[: room - 1] if room > 1 or clock is not None else b""
        field += b"\xff" * (room - 1 - len(field))
        field = bytes([len(field)]) + field
    return bytes([SYNC, starts << 6 | pid >> 8, pid & 0xFF, (0x30 if field else 0x10) | counter & 15]) + field + payload


@cache
def tables() -> bytes:
    programs = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    streams = (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    return b"".join(packet(pid, True, 0, (b"\x00" + x).ljust(184, b"\xff")) for pid, x in ((PAT_PID, programs), (PMT_PID, section(2, PROGRAM, streams))))


def stamp(pts: int) -> bytes:
    pts %= 2**33
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream that holds this payload."""
    out, counter = [tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        body = payload[at : at + UNIT]
        data = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(k * PTS_STEP) + body
        clock = k * PTS_STEP if k % RAP_EVERY == 0 else None
        first = 184 if clock is None else 176
        out.append(packet(STREAM_PID, True, counter, data[:first], clock))
        counter, rest = counter + 1, data[first:]
        if n := len(rest) // 184:
            rows = np.empty((n, PACKET), np.uint8)
            rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
            rows[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
            rows[:, 4:] = np.frombuffer(rest, np.uint8, n * 184).reshape(n, 184)
            out.append(rows.tobytes())
            counter += n
        if rest := rest[n * 184 :]:
            out.append(packet(STREAM_PID, False, counter, rest))
            counter += 1
    return b"".join(out)


def payload_begins(rows: np.ndarray) -> np.ndarray:
    """Where the payload of each packet begins: after its header and its adaptation field; PACKET without payload."""
    begin = np.where(rows[:, 3] & 0x20 != 0, rows[:, 4].astype(int) + 5, 4)
    if (begin > PACKET).any():
        raise MediaError("adaptation field too long")
    return np.where(rows[:, 3] & 0x10 != 0, begin, PACKET)


def read_section(rows: np.ndarray, starts: np.ndarray, pid: np.ndarray, wanted: int, table_id: int) -> bytes:
    """The body of the first table section under this packet identifier."""
    own = np.flatnonzero(pid == wanted)
    found = own[starts[own]]
    if not len(found):
        raise MediaError(f"no table under packet identifier {wanted}")
    data, size = b"", 3
    for i in own[own >= found[0]].tolist():
        part = rows[i, payload_begins(rows[i : i + 1])[0] :].tobytes()
        data += part[1 + part[0] :] if i == found[0] and part else part
        if len(data) >= 3:
            size = (int.from_bytes(data[1:3], "big") & 0xFFF) + 3
        if len(data) >= size > 3:
            break
    data = data[:size]
    if len(data) < 12 or data[0] != table_id or section_crc(data):
        raise MediaError(f"table under packet identifier {wanted} is damaged")
    return data[8:-4]


def program_pid(programs: bytes) -> int:
    """The packet identifier of the first program's map; number 0 is the network's."""
    for at in range(0, len(programs) - 3, 4):
        if int.from_bytes(programs[at : at + 2], "big"):
            return int.from_bytes(programs[at + 2 : at + 4], "big") & 0x1FFF
    raise MediaError("no program")


def stream_pid(program: bytes) -> int:
    """The packet identifier of the first stream of private data, else of the first stream."""
    at, found = 4 + (int.from_bytes(program[2:4], "big") & 0xFFF), []
    while at + 5 <= len(program):
        found.append((program[at] != PRIVATE_DATA, len(found), int.from_bytes(program[at + 1 : at + 3], "big") & 0x1FFF))
        at += 5 + (int.from_bytes(program[at + 3 : at + 5], "big") & 0xFFF)
    if not found:
        raise MediaError("no stream")
    return min(found)[2]


def sequence(rows: np.ndarray) -> tuple[np.ndarray, int]:
    """The packets with payload, each once, and the errors of their continuity counters."""
    bad = rows[:, 1] & 0x80 != 0
    errors = int(bad.sum())
    rows = rows[~bad & (rows[:, 3] & 0x10 != 0)]
    step = (rows[1:, 3].astype(int) - rows[:-1, 3]) & 15
    again = np.flatnonzero(step == 0) + 1
    again = again[(rows[again, :4] == rows[again - 1, :4]).all(1) & (rows[again, -64:] == rows[again - 1, -64:]).all(1)]
    told = (rows[:, 3] & 0x20 != 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x80 != 0)
    wrong = np.concatenate([[False], step != 1])[: len(rows)] & ~told
    wrong[again] = False
    keep = np.ones(len(rows), bool)
    keep[again] = False
    return rows[keep], errors + int(wrong.sum())


def demux(media: bytes) -> Stream:
    """What a stored stream holds."""
    if not media or len(media) % PACKET:
        raise MediaError("not a whole number of transport packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise MediaError("sync byte missing")
    pid = (rows[:, 1] & 0x1F).astype(int) << 8 | rows[:, 2]
    starts = rows[:, 1] & 0x40 != 0
    program = read_section(rows, starts, pid, program_pid(read_section(rows, starts, pid, PAT_PID, 0)), 2)
    rows, errors = sequence(rows[pid == stream_pid(program)])
    begin = payload_begins(rows)
    data = rows[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    firsts = np.flatnonzero(rows[:, 1] & 0x40 != 0)
    where = [*(ends[firsts] - (PACKET - begin[firsts])).tolist(), len(data)]
    marked = (rows[:, 3] & 0x20 != 0) & (rows[:, 4] > 0) & (rows[:, 5] & 0x40 != 0)
    bodies, stamps = [], []
    for a, b in zip(where, where[1:], strict=False):
        if data[a : a + 3] != b"\x00\x00\x01":
            raise MediaError("start code missing")
        size = int.from_bytes(data[a + 4 : a + 6], "big")
        stop = min(b, a + 6 + size) if size else b
        if data[a + 3] in BARE:
            stamps.append(None)
            bodies.append(data[a + 6 : stop])
            continue
        x = data[a + 9 : a + 14]
        stamps.append((x[0] & 0x0E) << 29 | x[1] << 22 | (x[2] & 0xFE) << 14 | x[3] << 7 | x[4] >> 1 if data[a + 7] & 0x80 and len(x) == 5 else None)
        bodies.append(data[a + 9 + data[a + 8] : stop])
    return Stream(b"".join(bodies), stamps, np.flatnonzero(marked[firsts]).tolist(), errors)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these padded with spaces to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" ")


def digest(size: int, media: bytes) -> tuple:
    """The FIELDS of one stored stream, from what is read back."""
    got = demux(media)
    last = max((x for x in got.timestamps if x is not None), default=0)
    tail = zlib.crc32(got.payload[-16:])
    feature = f"mpegts packets={len(media) // PACKET} units={len(got.timestamps)} access={','.join(map(str, got.random_access))} pts=0..{last} errors={got.continuity_errors}"
    return (
        size, len(got.payload), hashlib.sha256(got.payload).hexdigest(), tail, len(media), hashlib.sha256(media).hexdigest(), feature,
        len(got.timestamps), len(got.random_access), last, got.continuity_errors, got.timestamps, got.random_access,
    )


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of every document."""

    def of(texts: list) -> list[pa.Array]:
        rows = [payload_of(x) for x in texts]
        return [pa.array([n for n, _ in rows], pa.int64()), pa.array([mux(x) for _, x in rows], pa.binary())]

    return map_texts(docs, of, "n_bytes long, media binary")


def read_media(table: DataFrame, *, ids: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """ids, payload, timestamps, random_access and continuity_errors of every stored stream."""
    fields = [table.schema[i] for i in ids] + list(T._parse_datatype_string("payload binary, timestamps array<long>, random_access array<int>, continuity_errors long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [None if x is None else demux(x) for x in batch.column(len(ids)).to_pylist()]
            kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
            made = [pa.array([None if g is None else g[i] for g in got], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(ids))), *made], [f.name for f in fields])

    return table.select(*ids, media).mapInArrow(run, T.StructType(fields))


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id and FIELDS of every document: its stream is stored in a media column of a table, and read back from there."""
    table = stored(store_media(docs), "media")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32())]
    schema = T.StructType([table.schema["doc_id"], *T._parse_datatype_string(FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [digest(n, x) for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], schema.fieldNames())

    return table.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
