"""MPEG audio columns: frames are resynchronised, tags and variable-bitrate tables parsed, checksums verified, and exact
durations and frame offsets stored.

`store` writes bytes into MPEG-1 Layer III frames: an ID3v2 tag with the payload's length, an information frame with the
variable-bitrate table, then CRC-protected frames of silence that carry the bytes as ancillary data, each frame of the
smallest bitrate that holds what is left. `read` takes any MPEG audio: it finds frames of MPEG-1, 2 and 2.5, all layers,
by headers that chain (a header counts if it stands right after a frame of its kind, or if another header or the end
stands where its own frame ends), skips what is no frame and counts those bytes. Frames of free format reach to the next
header of their kind, whose distance then holds for all. A tag at the end counts only where it stands right behind a whole
frame (or alone), so carried bytes are never taken for one. Seek tables of Xing, Info and VBRI frames are read as byte
offsets from the table's frame. Layer III checksums are verified; other layers' are counted as unchecked.

Defined results: null text is empty text; null media give null values; media without any frame give 0 frames, 0 samples
and a null payload; texts of any length are stored whole; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import small_arrow_batches

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by bitrate index 1-14, for (MPEG-1?, layer); Hz by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
OWNER = b"leafmill payload bytes"


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def kind(self) -> tuple[int, int, int]:
        """What does not change from frame to frame."""
        return self.version, self.layer, self.rate

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, if they are one. Free format has bitrate 0 and, for length, its padding alone."""
    if len(four) < 4:
        return None
    word = int.from_bytes(four, "big")
    version, layer, bits, hz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or bits == 15 or hz == 3 or word & 3 == 2:
        return None
    rate, pad = RATES[version][hz], word >> 9 & 1
    kbits = BITRATES[version == 3, layer][bits - 1] if bits else 0
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12000 * kbits // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // rate + pad
    return Header(version, layer, not word >> 16 & 1, kbits, rate, word >> 6 & 3 == 3, length, samples)


def free_length(data: bytes, at: int, end: int, h: Header) -> int | None:
    """The length without padding of the free-format frame at a place: to the next header of its kind; None without one."""
    least = 4 + 2 * h.protected + (h.side if h.layer == 3 else 16)
    found = data.find(b"\xff", at + least, end)
    while 0 <= found:
        other = header(data[found : found + 4])
        if other and not other.bitrate and other.kind == h.kind:
            return found - at - h.length
        found = data.find(b"\xff", found + 1, end)
    return None


def _crc_table() -> list[int]:
    table = []
    for top in range(256):
        c = top << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(covered: bytes) -> int:
    """The frame checksum: polynomial 0x8005, all ones at first, high bits first."""
    c = 0xFFFF
    for b in covered:
        c = (c << 8 ^ CRC[c >> 8 ^ b]) & 0xFFFF
    return c


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


@lru_cache(maxsize=32)
def frame_head(index: int) -> tuple[bytes, int]:
    """Header, checksum and silent side information of a mono 32 kHz frame, and the bytes left for data."""
    four = (0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
    h = header(four)
    side = bytes(h.side)
    return four + crc16(four[2:] + side).to_bytes(2, "big") + side, h.length - 6 - h.side


ROOM = [(frame_head(i)[1], i) for i in range(1, 15)]


def write(payload: bytes) -> bytes:
    """An MPEG audio file that carries the payload."""
    frames, at, n = [], 0, len(payload)
    while at < n:
        room, index = next((x for x in ROOM if x[0] >= n - at), ROOM[-1])
        head, _ = frame_head(index)
        frames.append(head + payload[at : at + room].ljust(room, b"\0"))
        at += room
    body = b"PRIV" + struct.pack(">IH", len(OWNER) + 9, 0) + OWNER + b"\0" + n.to_bytes(8, "big")
    length_ms = str((len(frames) + 1) * 1152 * 1000 // 32000).encode()
    body += b"TLEN" + struct.pack(">IH", len(length_ms) + 1, 0) + b"\0" + length_ms
    tag = b"ID3\x03\x00\x00" + syncsafe(len(body)) + body
    head, room = frame_head(8)
    offsets, total = [], len(head) + room
    for f in frames:
        offsets.append(total)
        total += len(f)
    toc = bytes(min(255, 256 * offsets[k * len(offsets) // 100] // total) if offsets else 0 for k in range(100))
    info = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join([tag, head, info.ljust(room, b"\0"), *frames])


@dataclass
class Audio:
    """What a file holds; offsets are of frames with sound, from the file's start."""

    payload: bytes | None = None
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    version: int = -1
    layer: int = 0
    bitrates: set[int] = field(default_factory=set)
    crc_good: int = 0
    crc_bad: int = 0
    unchecked: int = 0
    skipped: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    seek: list[int] = field(default_factory=list)
    end_tag: bool = False
    tags: dict[str, list[bytes]] = field(default_factory=dict)


def read_tags(data: bytes) -> tuple[dict[str, list[bytes]], int]:
    """ID3v2 frames at the start (versions 2.3 and 2.4), all of each name, and where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    unsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end = min(len(data), 10 + unsafe(data[6:10]) + (10 if data[5] & 16 else 0))
    tags, at = {}, 10
    if data[5] & 64 and end >= 14:
        at += unsafe(data[10:14]) if data[3] == 4 else 4 + int.from_bytes(data[10:14], "big")
    while data[3] in (3, 4) and at + 10 <= end and data[at] and data[at : at + 4].isalnum():
        size = unsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        tags.setdefault(data[at : at + 4].decode("latin-1"), []).append(data[at + 10 : min(end, at + 10 + size)])
        at += 10 + size
    return tags, end


def variable_table(frame: bytes, h: Header) -> tuple[int | None, int | None, list[int]] | None:
    """Frames, bytes and seek offsets (bytes from this frame's begin) that a Xing, Info or VBRI table names; None without table."""
    number = lambda at, n: int.from_bytes(frame[at : at + n], "big")
    for at in (4 + h.side, 6 + h.side) if h.layer == 3 else ():
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at, found = number(at + 4, 4), at + 8, []
            for bit in (1, 2):
                found.append(number(at, 4) if flags & bit else None)
                at += 4 if flags & bit else 0
            toc = frame[at : at + 100] if flags & 4 else b""
            return found[0], found[1], [x * found[1] // 256 for x in toc] if found[1] else []
    if frame[36:40] == b"VBRI":
        entries, scale, size = number(54, 2), number(56, 2), number(58, 2)
        offsets, total = [], len(frame)
        for k in range(entries if 1 <= size <= 4 else 0):
            offsets.append(total)
            total += number(62 + k * size, size) * scale
        return number(50, 4), number(46, 4), offsets
    return None


def parse(data: bytes) -> Audio:
    """Everything that one pass over the file finds."""
    out = Audio()
    out.tags, at = read_tags(data)
    end = len(data)
    carried, first, last, begin, free = [], True, None, at, None
    while at + 4 <= end:
        if at == begin and end - at == 128 and data[at : at + 3] == b"TAG":  # right behind a whole frame, or alone
            out.end_tag, at = True, end
            break
        h = header(data[at : at + 4])
        follows = h is not None and at == begin and last is not None and h.kind == last.kind
        length = h.length if h else 0
        if h is not None and not h.bitrate:
            free = free if follows and free else free_length(data, at, end, h)
            length = h.length + free if free else end - at + 1
        after = at + length
        tagged = end - after == 128 and data[after : after + 3] == b"TAG"
        if h is None or after > end or (not follows and not tagged and after + 4 <= end and header(data[after : after + 4]) is None):
            sync = data.find(b"\xff", at + 1, end)  # the next place where a header may begin
            out.skipped += (end if sync < 0 else sync) - at
            at = end if sync < 0 else sync
            continue
        frame = data[at:after]
        if h.protected and h.layer == 3:
            good = crc16(frame[2:4] + frame[6 : 6 + h.side]) == int.from_bytes(frame[4:6], "big")
            out.crc_good += good
            out.crc_bad += not good
        else:
            out.unchecked += 1
        table = variable_table(frame, h) if first else None
        first = False
        if table is not None:
            out.table_frames, out.table_bytes, seek = table
            out.seek = [at + x for x in seek]
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.bitrates.add(h.bitrate)
            if h.layer == 3:
                carried.append(frame[4 + 2 * h.protected + h.side :])
        out.rate, out.version, out.layer = h.rate, h.version, h.layer
        at = begin = after
        last = h
    out.skipped += max(0, end - at)
    for private in out.tags.get("PRIV", []):
        owner, _, size = private.partition(b"\0")
        if owner == OWNER and out.payload is None:
            out.payload = b"".join(carried)[: int.from_bytes(size, "big")]
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's bytes in UTF-8, padded with zeros to a positive multiple of 64, and their number before that."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text and `media`, a file that carries it."""
    small_arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [padded(t) for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in kept], pa.int64()), pa.array([write(p) for _, p in kept], pa.binary())], names=["doc_id", "n_bytes", "media"])

    narrow = docs.select("doc_id", F.col(text).alias("__text"))
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


FOUND = (
    "payload binary, frames long, samples long, sample_rate int, duration_s double, crc_good long, crc_bad long, unchecked long, skipped_bytes long, "
    "table_frames long, table_bytes long, frame_offsets array<long>, seek_offsets array<long>, feature string"
)


def read(media: DataFrame, keys: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """The keys, media and what `parse` finds in each `media` value."""
    small_arrow_batches(media.sparkSession)
    narrow = media.select(*keys, "media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields) + ", " + FOUND
    names = [x.split()[0] for x in FOUND.split(", ")]

    def values(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(names)
        a = parse(data)
        vbr = len(a.bitrates) > 1
        words = {"mpeg": {3: "1", 2: "2", 0: "2.5"}.get(a.version, "-"), "layer": a.layer, "rate": a.rate, "frames": len(a.offsets), "samples": a.samples, "vbr": int(vbr), "kbps": "/".join(map(str, sorted(a.bitrates))) or "-", "crc_good": a.crc_good, "crc_bad": a.crc_bad, "skipped": a.skipped, "table": a.table_frames, "last_frame": a.offsets[-1] if a.offsets else "-"}
        return (a.payload, len(a.offsets), a.samples, a.rate, a.samples / a.rate if a.rate else 0.0, a.crc_good, a.crc_bad, a.unchecked, a.skipped, a.table_frames, a.table_bytes, a.offsets, a.seek, ";".join(f"{k}={v}" for k, v in words.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), *[pa.int64()] * 6, *[pa.list_(pa.int64())] * 2, pa.string()]
        for b in batches:
            rows = [values(m) for m in b.column("media").to_pylist()]
            found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("media"), *found], names=[*keys, "media", *names])

    return narrow.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "frames",
        "samples",
        "sample_rate",
        "duration_s",
        "frame_offsets",
    )
