"""Media columns: MPEG audio streams that carry payloads, and a reader of such streams.

A payload goes losslessly into the ancillary bytes of silent MPEG-1 Layer III frames, 576 bytes a frame with their
CRC-32. The stream has an ID3v2 tag with the payload's length, a frame with a variable-bitrate table, and a CRC-16 in
each frame. The reader takes any stream of MPEG-1/2/2.5 Layer III frames: it skips tags, finds frames again where bytes
were lost, reads Xing, Info and VBRI tables, verifies checksums, and stores exact durations and frame offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import texts

UNIT = 576
# Fixed values of the MPEG audio format: kbit/s of Layer III by index, for MPEG-1 and for MPEG-2 and 2.5; sample rates of MPEG-1.
KBITS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = (44100, 48000, 32000)


@dataclass(frozen=True)
class Header:
    version: int  # 1: MPEG-1, 2: MPEG-2, 4: MPEG-2.5
    protected: bool
    kbits: int
    rate: int
    length: int
    samples: int
    side: int  # bytes of side information


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """The four bytes of a Layer III frame's header, or None where they are no header of known length."""
    if len(raw) < 4 or raw[0] != 255 or raw[1] & 0xE6 != 0xE2:
        return None
    version = {3: 1, 2: 2, 0: 4}.get(raw[1] >> 3 & 3)
    bits, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or bits in (0, 15) or rate == 3:
        return None
    kbits, hz, samples = KBITS[1 if version == 1 else 2][bits], RATES[rate] // version, 1152 if version == 1 else 576
    mono = raw[3] >> 6 == 3
    side = (17 if mono else 32) if version == 1 else 9 if mono else 17
    return Header(version, not raw[1] & 1, kbits, hz, samples // 8 * kbits * 1000 // hz + (raw[2] >> 1 & 1), samples, side)


def _crc16_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


CRC16 = _crc16_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of a frame: over the header's last two bytes and the side information."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ CRC16[c >> 8 ^ b]
    return c


#: MPEG-1 Layer III, protected, 224 kbit/s, 48 kHz, stereo: 672 bytes and 1152 samples a frame.
HEAD = bytes([0xFF, 0xFA, 0xC4, 0x00])
SIDE = bytes(32)
FRAME, AT = 672, 4 + 2 + 32
START = HEAD + struct.pack(">H", crc16(HEAD[2:] + SIDE)) + SIDE


def write_stream(data: bytes) -> bytes:
    """data, with bytes 255 appended up to a positive multiple of 576, as a stream of MPEG audio."""
    n = max(1, -(-len(data) // UNIT))
    payload = np.frombuffer(data + b"\xff" * (n * UNIT - len(data)), np.uint8).reshape(n, UNIT)
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :AT] = np.frombuffer(START, np.uint8)
    frames[1:, AT : AT + UNIT] = payload
    frames[1:, AT + UNIT : AT + UNIT + 4] = np.array([zlib.crc32(p) for p in payload], ">u4").view(np.uint8).reshape(n, 4)
    size = (n + 1) * FRAME
    toc = bytes(min(255, ((k * n // 100 + 1) * FRAME * 256) // size) for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, size) + toc
    frames[0, AT : AT + len(table)] = np.frombuffer(table, np.uint8)
    note = b"\x03payload\x00" + str(len(data)).encode()
    tag = b"TXXX" + _synchsafe(len(note)) + b"\x00\x00" + note
    return b"ID3\x04\x00\x00" + _synchsafe(len(tag)) + tag + frames.tobytes()


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsynchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: str = "none"  # Xing, Info or VBRI
    table_frames: int = 0
    table_bytes: int = 0
    toc: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)  # of frames with sound
    samples: int = 0
    micros: int = 0
    kbits: set[int] = field(default_factory=set)
    rate: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    payload: bytes = b""
    payload_bad: int = 0


def _id3v2(data: bytes, out: Stream) -> int:
    """Reads a tag at the start, if there is one; the place after it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, at = 10 + _unsynchsafe(data[6:10]), 10
    while at + 10 <= end and data[at : at + 1].isalnum():
        size = _unsynchsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if data[at : at + 1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            name, _, value = text.partition("\x00")
            key = data[at : at + 4].decode("latin-1")
            out.tags[f"{key}:{name}" if key == "TXXX" else key] = value if key == "TXXX" else name
        at += 10 + size
    return end


def _table(frame: bytes, h: Header, out: Stream) -> bool:
    """Reads a variable-bitrate table, if the frame holds one."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out.table, flags, at = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if flags & 1:
            out.table_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 2:
            out.table_bytes, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out.toc = list(frame[at : at + 100])
        return True
    if frame[36:40] == b"VBRI":
        out.table = "VBRI"
        out.table_bytes, out.table_frames, entries, scale, size = struct.unpack(">IIHHH", frame[46:60])
        out.toc = [int.from_bytes(frame[62 + k * size : 62 + (k + 1) * size], "big") * scale for k in range(entries)]
        return True
    return False


def read_stream(data: bytes, carried: bool = True) -> Stream:
    """What a stream holds. carried: whether its frames carry payload as write_stream() lays it out."""
    out, parts = Stream(), []
    at, first, numerator = _id3v2(data, out), True, {}
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is None or at + h.length > end and at + 4 < end and not first and at + h.length > len(data):
            # resynchronise: the next place with a header whose frame another header, or the end, follows
            go = at + 1
            while (go := data.find(b"\xff", go, end)) >= 0:
                n = header(data[go : go + 4])
                if n and (go + n.length == end or header(data[go + n.length : go + n.length + 4])):
                    break
                go += 1
            out.resyncs += 1
            out.skipped += (end if go < 0 else go) - at
            if go < 0:
                break
            at = go
            continue
        frame = data[at : at + h.length]
        if h.protected:
            good = crc16(frame[2:4] + frame[6 : 6 + h.side]) == int.from_bytes(frame[4:6], "big")
            out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
        if not (first and _table(frame, h, out)):
            out.offsets.append(at)
            out.samples += h.samples
            numerator[h.rate] = numerator.get(h.rate, 0) + h.samples
            out.kbits.add(h.kbits)
            if carried and h.length == FRAME:
                unit = frame[AT : AT + UNIT]
                out.payload_bad += zlib.crc32(unit) != int.from_bytes(frame[AT + UNIT : AT + UNIT + 4], "big")
                parts.append(unit)
        out.rate, first = h.rate, False
        at += h.length
    out.micros = sum(n * 1_000_000 // rate for rate, n in numerator.items())
    out.payload = b"".join(parts)
    return out


def store(text: Column) -> Column:
    """binary: the UTF-8 bytes of a text as a stream of MPEG audio. Null counts as empty, which makes one frame of 255s."""

    @F.pandas_udf("binary")
    def write(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([write_stream(t.encode()) for t in batch.fillna("")], dtype=object)

    return write(text)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, duration_us long, n_frames int, crc_bad int, resyncs int, seek_offsets array<long>, feature string"


def read(media: Column) -> Column:
    """struct of FEATURES: the payload's digests, exact duration and offsets of frames (one a second), from the bytes
    of a stream. Null for null; bytes without frames have empty payload and no offsets."""

    def features(data: bytes) -> tuple:
        s = read_stream(data)
        second = max(1, round(s.rate / 1152)) if s.rate else 1
        seek = s.offsets[::second]
        mean = float(np.frombuffer(s.payload, np.uint8).mean()) if s.payload else 0.0
        checked = s.table_frames == len(s.offsets) and s.crc_bad == 0 and s.payload_bad == 0
        feature = f"{s.table};frames={len(s.offsets)};rate={s.rate};kbit={'/'.join(map(str, sorted(s.kbits)))};samples={s.samples};us={s.micros};seek={zlib.crc32(np.array(seek, '<i8').tobytes()):08x};checked={int(checked)};mean={mean:.3f}"
        return (len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), s.micros, len(s.offsets), s.crc_bad + s.payload_bad, s.resyncs, seek, feature)

    @F.pandas_udf(FEATURES)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in FEATURES.split(", ")]
        for batch in batches:
            yield pd.DataFrame([features(bytes(b)) if b is not None else (None,) * len(names) for b in batch], columns=names, dtype=object)

    return parse(media)


def op4_mpeg_media(spark, sf_dir: str) -> DataFrame:
    rows = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), read(store(F.col("text"))).alias("m"))
    return rows.select("doc_id", "n_bytes", *(f"m.{c}" for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us")))
