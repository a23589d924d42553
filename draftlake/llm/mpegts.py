"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

A payload is cut into access units of 576 bytes. Each is one packetised elementary packet of private data with a
presentation time stamp, in four transport packets of which the first carries a program clock reference; every
RAP_EVERY-th unit starts with the random access indicator. A program association table and a program map table, both
with their CRC, come first and again before every random access point but the first, so that reading can start there.

The reader finds the program and its elementary stream from the tables, checks sync bytes and continuity counters,
puts the packets together again, and gives the payload, time stamps and random access points. A packet lost in the
middle makes a continuity error, and the unit that it belonged to is left out.

Defined cases: a null text is an empty one; an empty payload is padded to one unit; equal texts give equal bytes;
broken or empty media give error counts and an empty payload, never an exception.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from draftlake.llm.common import apart

UNIT = 576
PACKET = 188
SYNC, PAT_PID, PMT_PID, ES_PID, PROGRAM, PRIVATE = 0x47, 0x0000, 0x1000, 0x0100, 1, 0x06
PES_HEADER = 14
TICKS = 3600  # of a 90 kHz clock for each unit
RAP_EVERY = 25
#: Payload bytes in the four packets of a unit; the first has 8 bytes of adaptation field, the last is stuffed.
ROOM = (176, 184, 184, UNIT + PES_HEADER - 176 - 184 - 184)

PARSED = [
    T.StructField("payload", T.BinaryType()),
    T.StructField("programs", T.IntegerType()),
    T.StructField("stream_pid", T.IntegerType()),
    T.StructField("packets", T.LongType()),
    T.StructField("sync_errors", T.LongType()),
    T.StructField("continuity_errors", T.LongType()),
    T.StructField("units", T.LongType()),
    T.StructField("pts", T.ArrayType(T.LongType())),
    T.StructField("rap_units", T.ArrayType(T.LongType())),
    T.StructField("rap_bytes", T.ArrayType(T.LongType())),
]


@cache
def _crc_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table[i] = c
    return table


def crc32_mpeg(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(table[(c >> 24) ^ b])
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF]) + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


@cache
def _tables() -> np.ndarray:
    """The two table packets, continuity counters zero."""
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    out = np.full((2, PACKET), 0xFF, dtype=np.uint8)
    for row, pid, section in zip(out, (PAT_PID, PMT_PID), (pat, pmt), strict=True):
        head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
        row[: len(head)] = np.frombuffer(head, dtype=np.uint8)
    return out


def _stamp(out: np.ndarray, pts: np.ndarray) -> None:
    out[:, 0] = 0x21 | (pts >> 29 & 0x0E)
    out[:, 1] = pts >> 22 & 0xFF
    out[:, 2] = 0x01 | (pts >> 14 & 0xFE)
    out[:, 3] = pts >> 7 & 0xFF
    out[:, 4] = 0x01 | (pts << 1 & 0xFE)


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text padded with bytes 255 to a positive multiple of UNIT)."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload whose length is a multiple of UNIT."""
    units = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    n = len(units)
    pes = np.empty((n, PES_HEADER + UNIT), dtype=np.uint8)
    size = UNIT + PES_HEADER - 6
    pes[:, :9] = (0, 0, 1, 0xBD, size >> 8, size & 0xFF, 0x84, 0x80, 5)
    pts = np.arange(n, dtype=np.int64) * TICKS + TICKS
    _stamp(pes[:, 9:14], pts & ((1 << 33) - 1))
    pes[:, PES_HEADER:] = units
    packets = np.full((n, 4, PACKET), 0xFF, dtype=np.uint8)
    packets[:, :, 0], packets[:, :, 1], packets[:, :, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    packets[:, 0, 1] |= 0x40
    counter = (np.arange(4 * n) & 0x0F).astype(np.uint8).reshape(n, 4)
    packets[:, :, 3] = 0x10 | counter
    packets[:, (0, 3), 3] |= 0x20
    rap = np.arange(n) % RAP_EVERY == 0
    clock = (pts - TICKS) & ((1 << 33) - 1)
    packets[:, 0, 4], packets[:, 0, 5] = 7, 0x10 | (rap << 6)
    for i, shift in enumerate((25, 17, 9, 1)):
        packets[:, 0, 6 + i] = clock >> shift & 0xFF
    packets[:, 0, 10], packets[:, 0, 11] = (clock & 1) << 7 | 0x7E, 0
    stuffing = PACKET - 5 - ROOM[3]
    packets[:, 3, 4], packets[:, 3, 5] = stuffing, 0
    at = 0
    for k, room in enumerate(ROOM):
        packets[:, k, PACKET - room :] = pes[:, at : at + room]
        at += room
    groups = -(-n // RAP_EVERY)
    tables = np.repeat(_tables()[None], groups, axis=0)
    tables[:, :, 3] |= (np.arange(groups) & 0x0F).astype(np.uint8)[:, None]
    flat = packets.reshape(-1, PACKET)
    step = 4 * RAP_EVERY
    return b"".join(x.tobytes() for g in range(groups) for x in (tables[g], flat[g * step : (g + 1) * step]))


def _sections(packets: np.ndarray, offsets: np.ndarray, pid: np.ndarray, start: np.ndarray, wanted: int, table_id: int) -> list[bytes]:
    """Distinct whole sections of a table with the right CRC."""
    out = []
    for i in np.flatnonzero((pid == wanted) & start & (offsets < PACKET)):
        body = packets[i, offsets[i] :].tobytes()
        body = body[1 + body[0] :]
        if len(body) > 3 and body[0] == table_id:
            size = 3 + ((body[1] & 0x0F) << 8 | body[2])
            section = body[:size]
            if len(section) == size and size >= 12 and section not in out and crc32_mpeg(section[:-4]) == int.from_bytes(section[-4:], "big"):
                out.append(section)
    return out


def demux(media: bytes | None) -> dict:
    """What PARSED lists, of a transport stream."""
    raw = np.frombuffer(media or b"", dtype=np.uint8)
    whole = raw[: len(raw) // PACKET * PACKET].reshape(-1, PACKET)
    good = whole[:, 0] == SYNC
    out = {"payload": b"", "programs": 0, "stream_pid": None, "packets": len(whole), "sync_errors": int((~good).sum()) + (len(raw) % PACKET > 0), "continuity_errors": 0, "units": 0, "pts": [], "rap_units": [], "rap_bytes": []}
    place, packets = np.flatnonzero(good) * PACKET, whole[good]
    if not len(packets):
        return out
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    start = (packets[:, 1] & 0x40) > 0
    adapted, loaded = (packets[:, 3] & 0x20) > 0, (packets[:, 3] & 0x10) > 0
    offsets = np.where(loaded, np.minimum(4 + np.where(adapted, 1 + packets[:, 4].astype(np.int32), 0), PACKET), PACKET)
    maps = [int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for s in _sections(packets, offsets, pid, start, PAT_PID, 0x00) for i in range(8, len(s) - 4, 4) if s[i : i + 2] != b"\0\0"]
    out["programs"] = len(set(maps))
    streams = []
    for map_pid in dict.fromkeys(maps):
        for s in _sections(packets, offsets, pid, start, map_pid, 0x02):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
            while i + 5 <= len(s) - 4:
                streams.append((s[i], int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF))
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)
    wanted = [p for kind, p in streams if kind == PRIVATE]
    if not wanted:
        return out
    out["stream_pid"] = wanted[0]
    mine = (pid == wanted[0]) & loaded
    if not mine.any():
        return out
    place, packets, offsets, start, adapted = place[mine], packets[mine], offsets[mine], start[mine], adapted[mine]
    counter = packets[:, 3] & 0x0F
    step = np.diff(counter.astype(np.int16)) & 0x0F
    fresh = np.r_[True, step != 0]  # a packet may be sent twice
    broken = np.r_[False, step > 1]
    out["continuity_errors"] = int(broken.sum())
    place, packets, offsets, start, adapted, broken = place[fresh], packets[fresh], offsets[fresh], start[fresh], adapted[fresh], broken[fresh]
    if not start.any():
        return out
    sizes = PACKET - offsets
    first = np.flatnonzero(start)
    ends = np.r_[first[1:], len(packets)]
    stream = packets[np.arange(PACKET)[None, :] >= offsets[:, None]]
    at = np.r_[0, np.cumsum(sizes)]
    begin, stop = at[first], at[ends]
    bad = np.r_[0, np.cumsum(broken)]
    lost = bad[ends] - bad[np.minimum(first + 1, len(packets))] > 0
    room = stop - begin >= PES_HEADER
    head = stream[np.minimum(begin[:, None] + np.arange(PES_HEADER), len(stream) - 1)].astype(np.int64)
    size = head[:, 4] << 8 | head[:, 5]
    ok = room & ~lost & (head[:, 0] == 0) & (head[:, 1] == 0) & (head[:, 2] == 1) & (size + 6 == stop - begin) & ((head[:, 7] & 0x80) > 0) & (9 + head[:, 8] <= stop - begin)
    first, begin, stop, head = first[ok], begin[ok], stop[ok], head[ok]
    keep = np.zeros(len(stream) + 1, dtype=np.int8)
    keep[begin + 9 + head[:, 8]] += 1
    keep[stop] -= 1
    pts = (head[:, 9] >> 1 & 0x07) << 30 | head[:, 10] << 22 | (head[:, 11] >> 1) << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    rap = np.flatnonzero(adapted[first] & (packets[first, 4] > 0) & ((packets[first, 5] & 0x40) > 0))
    out |= {"payload": stream[np.cumsum(keep[:-1]) > 0].tobytes(), "units": len(first), "pts": pts.tolist(), "rap_units": rap.tolist(), "rap_bytes": place[first[rap]].tolist()}
    return out


def store_media(docs: DataFrame) -> DataFrame:
    """docs without `text`, with `media`, its transport stream, and `n_bytes`, its size before padding."""
    docs = apart(docs, ["media", "n_bytes"])
    names = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in _slices(table, "text"):
                sized = [padded(t) for t in part["text"].to_pylist()]
                out = part.select(names).append_column("n_bytes", pa.array([n for n, _ in sized], pa.int64()))
                yield from out.append_column("media", pa.array([mux(p) for _, p in sized], pa.binary())).to_batches()

    return docs.mapInArrow(run, schema)


def read_media(media: DataFrame, drop_payload: bool = False) -> DataFrame:
    """media with what PARSED lists and the digests of payload and media; the columns `media` and, if asked, `payload` go."""
    media = apart(media, [f.name for f in PARSED] + ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])
    names = [c for c in media.columns if c != "media"]
    parsed = [f for f in PARSED if not (drop_payload and f.name == "payload")]
    digests = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType())]
    schema = T.StructType([*[media.schema[c] for c in names], *parsed, *digests])
    types = {f.name: t for f, t in zip(parsed, _arrow(parsed), strict=True)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(pa.Table.from_batches([batch]), "media"):
                stored = part["media"].to_pylist()
                found = [demux(m) for m in stored]
                out = part.select(names)
                for name, kind in types.items():
                    out = out.append_column(name, pa.array([x[name] for x in found], kind))
                body = [x["payload"] for x in found]
                out = out.append_column("payload_bytes", pa.array(map(len, body), pa.int64()))
                out = out.append_column("payload_sha256", pa.array([hashlib.sha256(p).hexdigest() for p in body]))
                out = out.append_column("tail_crc32", pa.array([zlib.crc32(p[-32:]) for p in body], pa.int64()))
                out = out.append_column("media_bytes", pa.array([len(m or b"") for m in stored], pa.int64()))
                yield from out.append_column("media_sha256", pa.array([hashlib.sha256(m or b"").hexdigest() for m in stored])).to_batches()

    return media.mapInArrow(run, schema)


def _arrow(fields: list[T.StructField]) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def _slices(table, column: str, size: int = 8 << 20):
    """Parts of the table with about `size` bytes of the column: memory does not follow the number of rows in a batch."""
    import pyarrow.compute as pc

    at = sofar = 0
    for i, n in enumerate(pc.binary_length(table[column]).fill_null(0).to_pylist()):
        if sofar and sofar + n > size:
            yield table.slice(at, i - at)
            at, sofar = i, 0
        sofar += n
    if at < table.num_rows:
        yield table.slice(at)
