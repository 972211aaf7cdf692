"""MPEG audio columns: frames around a payload, and a reader that resynchronises, parses tags and tables and checks checksums."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import common

#: Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, for (MPEG-1, layer) and (MPEG-2, layer).
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz by index, for MPEG-1, 2 and 2.5.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}


BLOCK = 576  # bytes of payload, and samples, of a frame
_OVERHEAD = 4 + 2 + 9  # header, checksum, side information of a mono MPEG-2 frame
#: MPEG-2 layer III, protected, 144 kbit/s (index 13), 16 kHz (index 2), mono: frames of 648 bytes and 576 samples.
_HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC0])
_FRAME = 648


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for i in range(256):
        crc = i << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
        table[i] = crc
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frame checksum of each row of bytes (polynomial 0x8005, from 0xFFFF)."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ _CRC[(crc >> np.uint16(8)) ^ column]
    return crc


def _sealed(frames: np.ndarray) -> np.ndarray:
    """Frames with their checksums over the header's last two bytes and the side information."""
    crc = crc16(np.concatenate([frames[:, 2:4], frames[:, 6:15]], 1))
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 0xFF
    return frames


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A tagged stream: ID3v2 (with the length before padding), a frame with the variable-bitrate table, one frame for each 576 bytes."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    frames = np.zeros((len(blocks) + 1, _FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(_HEADER, np.uint8)
    frames[1:, _OVERHEAD : _OVERHEAD + BLOCK] = blocks
    toc = bytes(min(255, 256 * i // 100) for i in range(100))  # frames are of one size: places are in proportion
    table = b"Xing" + struct.pack(">III", 7, len(blocks), frames.size) + toc
    frames[0, 4 + 9 + 2 : 4 + 9 + 2 + len(table)] = np.frombuffer(table, np.uint8)
    text = b"\x03payload_bytes\x00" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + _sealed(frames).tobytes()


@dataclass
class Stream:
    """What a stream holds. offsets: of the frames that carry audio; samples and duration are theirs."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    duration: Fraction = Fraction(0)
    checked: int = 0
    broken: int = 0
    skipped: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""


def header(data: bytes, at: int) -> tuple[int, int, int, int, bool, int] | None:
    """(version, layer, rate, length, protected, side bytes) of the frame header at a place, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 25}.get(data[at + 1] >> 3 & 3)
    layer, rate_at, bit_at = 4 - (data[at + 1] >> 1 & 3), data[at + 2] >> 2 & 3, data[at + 2] >> 4
    if version is None or layer == 4 or rate_at == 3 or bit_at in (0, 15) or data[at + 3] & 3 == 2:
        return None
    rate, kbps, padded = RATES[version][rate_at], BITRATES[min(version, 2), layer][bit_at], data[at + 2] >> 1 & 1
    if layer == 1:
        length = (12 * kbps * 1000 // rate + padded) * 4
    else:
        length = (72 if layer == 3 and version != 1 else 144) * kbps * 1000 // rate + padded
    mono = data[at + 3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return version, layer, rate, length, not data[at + 1] & 1, side


def _samples(version: int, layer: int) -> int:
    return 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576


def _tag(data: bytes, out: Stream) -> int:
    """Parses an ID3v2 tag at the start; the place after it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, at = 10 + sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0))), 10
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        name, size = data[at : at + 4].decode("latin-1"), struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[key] = value.rstrip("\0")
        at += 10 + size
    return min(end, len(data))


def parse(data: bytes) -> Stream:
    """Reads a stream: ID3 tags, Xing/Info table, frames.

    A frame counts where its header is valid and the next frame, of the same version, layer and rate, follows at its end (or
    the stream ends there, or nothing but an ID3v1 tag follows: one inside a frame is audio); else the reader moves on by a byte, counted in `skipped`. Checksums of layer III frames are
    verified, and a frame that fails is counted in `broken` and still placed. Runs of equal headers are taken at once.
    """
    out = Stream()
    at = _tag(data, out)
    end = len(data)
    last_tag = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else -1
    raw, first = np.frombuffer(data, np.uint8), True
    while at + 4 <= end and at != last_tag:
        head = header(data, at)
        if head is None or at + head[3] > end:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped, at = out.skipped + nxt - at, nxt
            continue
        version, layer, rate, length, protected, side = head
        follower = header(data, at + length) if at + length < end and at + length != last_tag else head
        if follower is None or (follower[0], follower[1], follower[2]) != (version, layer, rate):
            out.skipped, at = out.skipped + 1, at + 1
            continue
        body = 4 + 2 * protected + side
        if first and layer == 3 and (found := _table(data, at, length, side)):
            out.table_frames, out.table_bytes, out.toc = found
            first, at = False, at + length
            continue
        first = False
        rows = raw[at : at + (end - at) // length * length].reshape(-1, length)
        same = (rows[:, :4] == rows[0, :4]).all(1)
        rows = rows[: len(rows) if same.all() else int(same.argmin())]
        if protected and layer == 3:
            crc = crc16(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + side]], 1))
            good = int((crc == rows[:, 4].astype(np.uint16) * 256 + rows[:, 5]).sum())
            out.checked, out.broken = out.checked + good, out.broken + len(rows) - good
        out.offsets += range(at, at + len(rows) * length, length)
        out.bodies.append(rows[:, body:].tobytes() if layer != 3 or (version, side) != (2, 9) else np.ascontiguousarray(rows[:, body : body + BLOCK]).tobytes())
        out.samples, out.rate = out.samples + _samples(version, layer) * len(rows), rate
        out.duration += Fraction(_samples(version, layer) * len(rows), rate)
        at += len(rows) * length
    return out


def _table(data: bytes, at: int, length: int, side: int) -> tuple[int | None, int | None, bytes] | None:
    for place in (at + 4 + side, at + 6 + side):
        if data[place : place + 4] in (b"Xing", b"Info"):
            flags, place = struct.unpack(">I", data[place + 4 : place + 8])[0], place + 8
            frames = size = None
            if flags & 1:
                frames, place = struct.unpack(">I", data[place : place + 4])[0], place + 4
            if flags & 2:
                size, place = struct.unpack(">I", data[place : place + 4])[0], place + 4
            return frames, size, data[place : place + 100] if flags & 4 else b""
    return None


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary) of each row of `docs`: its whole text as UTF-8, padded, in MPEG audio frames. Null texts count as empty."""
    common.tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in common.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(pad(d), len(d)) for d in data], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


READ = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, tags map<string,string>, frame_offsets array<long>, samples long, sample_rate int, duration_num long, duration_den long, frames_checked long, frames_broken long, bytes_skipped long, table_frames long"


def read(media: DataFrame) -> DataFrame:
    """One row per stored stream: the payload read back, tags, exact duration (a fraction of seconds), the offset of every frame, checks.

    A null or foreign stream gives an empty payload and no frames. Repeated rows stay; no shuffle.
    """
    import hashlib

    common.tune(media.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int32()] + [pa.int64()] * 6
    schema = pa.schema(list(zip([x.split()[0] for x in READ.split(", ")], kinds)))

    def one(doc_id: int | None, data: bytes) -> tuple:
        s = parse(data)
        payload, length = b"".join(s.bodies), s.tags.get("payload_bytes", "")
        return doc_id, int(length) if length.isdigit() else None, payload, len(data), hashlib.sha256(data).hexdigest(), list(s.tags.items()), s.offsets, s.samples, s.rate, s.duration.numerator, s.duration.denominator, s.checked, s.broken, s.skipped, s.table_frames

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (one(i, d or b"") for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield from common.batches(rows, schema, 64)

    return media.select("doc_id", "media").mapInArrow(run, READ)


def report(found: DataFrame) -> DataFrame:
    """Digests of what read() returns. feature: duration, frames, checks and the checksum of the seek table, as text."""
    seek = F.crc32(F.array_join("frame_offsets", ",").cast("binary"))
    feature = F.concat(
        F.lit("frames="), F.size("frame_offsets"), F.lit(";samples="), "samples", F.lit(";rate="), "sample_rate", F.lit(";seconds="), "duration_num", F.lit("/"), "duration_den",
        F.lit(";checked="), "frames_checked", F.lit(";broken="), "frames_broken", F.lit(";skipped="), "bytes_skipped", F.lit(";table="), F.coalesce(F.col("table_frames"), F.lit(-1)), F.lit(";seek="), seek,
    )
    return found.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )
