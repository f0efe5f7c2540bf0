"""MPEG audio columns: write payload bytes into frames, and read any such stream back.

``write_stream`` makes an MPEG-1 Layer III stream: an ID3v2 tag with the payload's
length, an information frame with a Xing table (frames, bytes, seek table), then
frames at 320 kbit/s whose last one takes the smallest bit rate that holds the
rest. Each frame has a CRC-16 and empty side information, so its whole data part
is ancillary data: a decoder plays silence, and the bytes come back unchanged.

``read_stream`` reads any stream. It skips tags, searches for a header
whose frame is followed by another header of its kind (or the end), walks from
frame to frame, searches again where the chain breaks, verifies every checksum,
parses the variable-bitrate table and gives the exact duration and the byte
offset of each frame. Defined cases: null is the empty text; every payload has
at least 64 bytes; bytes that are no frame count as skipped; ``TAG`` 128 bytes
before the end is an ID3v1 tag only where no frame lies over it. The one thing the
reader takes from the writer is the note of the payload's length, without which
the zeros that fill the last frame could not be told from the payload's. Repeated
rows are stored alike; an empty table gives no row; a text is one stream, however
long; columns named like an output, and all others but doc_id, are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textmill.llm.frames import schema_of

# Fixed values of the format: kbit/s by index for MPEG-1 layers I to III and MPEG-2 layers I and II/III, and sample rates.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
MULTIPLE = 64


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005) & 0xFFFF if c & 0x8000 else (c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(raw: bytes) -> int:
    """The format's CRC: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    c = 0xFFFF
    for b in raw:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


@lru_cache(maxsize=8192)
def header(raw: bytes) -> tuple | None:
    """(version, layer, protected, bit rate, sample rate, size, samples, side bytes, channels) of four header bytes."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    rate, kbit, pad = raw[2] >> 2 & 3, raw[2] >> 4, raw[2] >> 1 & 1
    if version is None or layer == 4 or rate == 3 or kbit in (0, 15):
        return None
    bits = BITRATES[1 if version == 1 else 2, layer][kbit] * 1000
    hz = RATES[version][rate]
    if layer == 1:
        size, samples = (12 * bits // hz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        size = samples // 8 * bits // hz + pad
    mono = raw[3] >> 6 == 3
    side = ((17 if mono else 32) if version == 1 else (9 if mono else 17)) if layer == 3 else 0
    return version, layer, not raw[1] & 1, bits, hz, size, samples, side, 1 if mono else 2


def _same_kind(a: tuple, b: tuple) -> bool:
    return a[0] == b[0] and a[1] == b[1] and a[4] == b[4]


def _frame(kbit: int, body: bytes) -> bytes:
    """A protected mono 32 kHz frame with empty side information; the body is filled up with zeros."""
    head = bytes((0xFF, 0xFA, kbit << 4 | 2 << 2, 0xC0))
    side = bytes(17)
    size = header(head)[5]
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side + body.ljust(size - 23, b"\0")


_ROOM = {k: header(bytes((0xFF, 0xFA, k << 4 | 2 << 2, 0xC0)))[5] - 23 for k in range(1, 15)}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """The payload as tag, information frame and frames; equal payloads give equal streams."""
    room = _ROOM[14]
    frames = [_frame(14, payload[i : i + room]) for i in range(0, len(payload) - room, room)]
    rest = payload[len(frames) * room :]
    frames.append(_frame(next(k for k in range(1, 15) if _ROOM[k] >= len(rest)), rest))
    total = sum(map(len, frames))
    note = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag_frame = b"TXXX" + _syncsafe(len(note)) + b"\0\0" + note
    info_size = _ROOM[6] + 23
    ends, at = [], info_size
    for f in frames:
        ends.append(at)
        at += len(f)
    toc = bytes(min(255, ends[min(len(ends) - 1, p * len(ends) // 100)] * 256 // at) for p in range(100))
    info = b"Xing" + struct.pack(">III", 7, len(frames), total + info_size) + toc
    return b"ID3\x04\0\0" + _syncsafe(len(tag_frame)) + tag_frame + _frame(6, info) + b"".join(frames)


def read_tag(raw: bytes) -> tuple[int, dict[str, str]]:
    """(bytes that an ID3v2 tag at the start takes, its text frames); (0, {}) without one."""
    if raw[:3] != b"ID3" or len(raw) < 10 or any(b & 0x80 for b in raw[6:10]):
        return 0, {}
    size = raw[6] << 21 | raw[7] << 14 | raw[8] << 7 | raw[9]
    end, at, found = min(len(raw), 10 + size), 10, {}
    while at + 10 <= end and raw[at : at + 4].strip(b"\0"):
        part = raw[at + 4 : at + 8]
        n = part[0] << 21 | part[1] << 14 | part[2] << 7 | part[3] if raw[3] == 4 else int.from_bytes(part, "big")
        name, value = raw[at : at + 4].decode("latin-1"), raw[at + 10 : min(end, at + 10 + n)]
        if name.startswith("T") and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace")
            key, _, rest = text.partition("\0")
            found[f"{name}:{key}" if name == "TXXX" else name] = rest if name == "TXXX" else text.rstrip("\0")
        at += 10 + n
    return 10 + size + (10 if raw[5] & 0x10 else 0), found


def _xing(raw: bytes, at: int, side: int, protected: bool) -> dict | None:
    p = at + 4 + 2 * protected + side
    if raw[p : p + 4] not in (b"Xing", b"Info"):
        return None
    flags, p = int.from_bytes(raw[p + 4 : p + 8], "big"), p + 8
    out: dict = {"frames": None, "bytes": None, "toc": None}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name], p = int.from_bytes(raw[p : p + 4], "big"), p + 4
    if flags & 4:
        out["toc"] = list(raw[p : p + 100])
    return out


def _vbri(raw: bytes, at: int) -> dict | None:
    """The other table of variable-bitrate streams: 32 bytes after the header, its entries the bytes of runs of frames."""
    p = at + 36
    if raw[p : p + 4] != b"VBRI" or len(raw) < p + 26:
        return None
    _, _, _, size, frames, entries, scale, width, step = struct.unpack(">HHHIIHHHH", raw[p + 4 : p + 26])
    if not 1 <= width <= 4 or len(raw) < p + 26 + entries * width:
        return {"frames": frames, "bytes": size, "toc": None}
    runs = [int.from_bytes(raw[p + 26 + i * width : p + 26 + (i + 1) * width], "big") * scale for i in range(entries)]
    return {"frames": frames, "bytes": size, "toc": runs, "frames_per_entry": step}


def read_stream(raw: bytes) -> dict:
    """What a stream holds: tags, vbr table, frames with offsets, checksum results, duration and carried bytes."""
    at, tags = read_tag(raw)
    start, end = at, len(raw)
    tag = end - 128 if raw[-128:-125] == b"TAG" else -1  # an ID3v1 tag, unless a frame of the chain lies over it
    offsets: list[int] = []
    data: list[bytes] = []
    vbr, bad, checked, skipped, resyncs, samples, hz = None, 0, 0, 0, 0, 0, 0
    kind: tuple | None = None
    rates: set[int] = set()
    while at + 4 <= end:
        if at == tag:
            end = tag
            break
        h = header(raw[at : at + 4])
        fits = h is not None and h[5] > 4 and at + h[5] <= end and (kind is None or _same_kind(kind, h))
        if fits and kind is None and at + h[5] + 4 <= end:
            after = header(raw[at + h[5] : at + h[5] + 4])
            fits = after is not None and _same_kind(h, after)
        if fits and at < tag < at + h[5] < end:
            after = header(raw[at + h[5] : at + h[5] + 4])
            fits = after is not None and _same_kind(h, after)
        if not fits:
            nxt = raw.find(b"\xff", at + 1, tag if at < tag else end)
            nxt = (tag if at < tag else end) if nxt < 0 else nxt
            resyncs += skipped == 0 or kind is not None
            skipped += nxt - at
            at, kind = nxt, None
            continue
        kind = h
        _, layer, protected, bits, hz, size, n, side, _ = h
        body = at + 4 + 2 * protected + side
        good = True
        if protected and layer == 3:
            checked += 1
            good = crc16(raw[at + 2 : at + 4] + raw[at + 6 : body]) == int.from_bytes(raw[at + 4 : at + 6], "big")
            bad += not good
        table = (_xing(raw, at, side, protected) or _vbri(raw, at)) if not offsets and vbr is None and layer == 3 else None
        if table:
            vbr = table
        else:
            offsets.append(at)
            data.append(raw[body : at + size])
            samples += n
            rates.add(bits)
        at += size
    body = b"".join(data)
    length = tags.get("TXXX:payload_bytes", "")
    return {
        "tag_bytes": start, "tags": tags, "vbr": vbr, "offsets": offsets, "frames": len(offsets), "bad_crc": bad, "checked": checked,
        "skipped": skipped + max(0, end - at), "resyncs": resyncs, "samples": samples, "sample_rate": hz, "bitrates": sorted(rates),
        "payload": body[: int(length)] if length.isascii() and length.isdecimal() and int(length) <= len(body) else body,
    }


def exact_duration(info: dict) -> str:
    """Seconds as a reduced fraction."""
    if not info["sample_rate"]:
        return "0/1"
    d = gcd(info["samples"], info["sample_rate"]) or 1
    return f"{info['samples'] // d}/{info['sample_rate'] // d}"


def feature(info: dict) -> str:
    vbr = info["vbr"] or {}
    seek = zlib.crc32(struct.pack(f"<{len(info['offsets'])}Q", *info["offsets"]))
    consistent = int(vbr.get("frames") == info["frames"])
    return (
        f"frames={info['frames']};seconds={exact_duration(info)};rates={','.join(str(b // 1000) for b in info['bitrates'])};"
        f"crc={info['checked'] - info['bad_crc']}/{info['checked']};vbr={consistent};skipped={info['skipped']};seek={seek:08x}"
    )


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text with zero bytes up to a positive multiple of 64)."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(MULTIPLE, -(-len(raw) // MULTIPLE) * MULTIPLE), b"\0")


def _map(df: DataFrame, columns: list[str], schema: T.StructType, row) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True)
                made = list(zip(*[row(*r) for r in rows], strict=True)) or [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary): each text stored as an MPEG audio stream."""
    schema = schema_of([docs.schema["doc_id"]], [("n_bytes", "long"), ("media", "binary")])

    def row(doc_id, text):
        n, payload = payload_of(text)
        return doc_id, n, write_stream(payload)

    return _map(docs, ["doc_id", "text"], schema, row)


def from_media(media: DataFrame) -> DataFrame:
    """The columns of ``media`` but the stream itself, with what reading it back gives."""
    keep = [f for f in media.schema.fields if f.name != "media"]
    schema = schema_of(keep, [("payload", "binary"), ("media_bytes", "long"), ("media_sha256", "string"), ("duration", "string"), ("seek_offsets", "array<long>"), ("feature", "string")])

    def row(*values):
        raw = bytes(values[-1] or b"")
        info = read_stream(raw)
        return *values[:-1], info["payload"], len(raw), hashlib.sha256(raw).hexdigest(), exact_duration(info), info["offsets"], feature(info)

    return _map(media, [*[f.name for f in keep], "media"], schema, row)
