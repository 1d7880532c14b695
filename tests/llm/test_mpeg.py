"""MPEG audio: exact round trips, resynchronisation, checksums, other layers and rates."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import mpeg


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=5000))
def test_any_bytes_come_back(payload):
    data = mpeg.write(payload)
    a = mpeg.parse(data)
    assert a.payload == payload and a.crc_bad == 0 and a.skipped == 0
    assert a.table_frames == len(a.offsets) and a.samples == 1152 * len(a.offsets)
    assert a.table_bytes == len(data) - (len(data) - a.table_bytes)


def test_offsets_stand_at_headers():
    data = mpeg.write(b"\xff\xfb" * 9000)
    a = mpeg.parse(data)
    assert len(a.offsets) > 5 and all(mpeg.header(data[o : o + 4]) for o in a.offsets) and a.payload == b"\xff\xfb" * 9000


def test_resynchronisation_and_checksums():
    data = mpeg.write(bytes(range(250)) * 40)
    clean = mpeg.parse(data)
    at = clean.offsets[2]
    assert mpeg.parse(data[:at] + b"junk\xff\xff junk" + data[at:]).payload == clean.payload
    spoiled = bytearray(data)
    spoiled[at + 8] ^= 255  # side information under the checksum
    a = mpeg.parse(bytes(spoiled))
    assert a.crc_bad == 1 and a.crc_good == clean.crc_good - 1
    cut = mpeg.parse(data[:-10])
    assert len(cut.offsets) == len(clean.offsets) - 1 and cut.skipped > 0
    tagged = mpeg.parse(data + b"TAG" + bytes(125))
    assert tagged.payload == clean.payload and tagged.skipped == 0


@pytest.mark.parametrize(
    ("four", "length", "samples", "rate"),
    [("fffb9000", 417, 1152, 44100), ("fffb9200", 418, 1152, 44100), ("fff39000", 261, 576, 22050), ("fffd9000", 522, 1152, 44100), ("ffff9000", 312, 384, 44100), ("ffe39000", 522, 576, 11025)],
)
def test_known_headers(four, length, samples, rate):
    h = mpeg.header(bytes.fromhex(four))
    assert (h.length, h.samples, h.rate) == (length, samples, rate)


@pytest.mark.parametrize("four", ["fffbf000", "ffeb9000", "fffb9c00", "00000000", "fff99000"])
def test_no_headers(four):
    assert mpeg.header(bytes.fromhex(four)) is None


def test_constant_rate_layers():
    frame = bytes.fromhex("fffd9000") + bytes(518)
    a = mpeg.parse(b"ID3\x04\x00\x00" + mpeg.syncsafe(20) + bytes(20) + frame * 4)
    assert (len(a.offsets), a.samples, a.layer, a.unchecked, a.payload) == (4, 4608, 2, 4, None)


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3", b"no audio at all", b"\xff" * 500])
def test_no_audio(data):
    a = mpeg.parse(data)
    assert a.offsets == [] and a.payload is None


def test_checksum_is_the_standard_one():
    assert mpeg.crc16(b"") == 0xFFFF and mpeg.crc16(b"123456789") == 0xAEE7


def test_query_and_nulls(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in mpeg.query(spark, sf).collect()}
    for d in docs.collect():
        raw = (d["text"] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    odd = spark.createDataFrame([(1, None, 1), (None, "", 1), (2, "é" * 200_000, 1), (2, "é" * 200_000, 1)], "doc_id long, text string, media int")
    rows = mpeg.read(mpeg.store(odd)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], len(r["payload"])) for r in rows) == [(0, 0, 64), (1, 0, 64), (2, 400_000, 400_000), (2, 400_000, 400_000)]
    assert mpeg.read(mpeg.store(odd.limit(0))).count() == 0
    none = mpeg.read(spark.createDataFrame([(1, None)], "doc_id long, media binary"), keys=("doc_id",)).first()
    assert none["payload"] is None and none["frames"] is None


@pytest.mark.parametrize("mark", [b"TAG", b"ID3\x03\x00\x00\x00\x00\x01\x00", b"\xff\xfb\x90\x00", b"Xing", b"VBRI"])
def test_marks_inside_the_payload_are_carried(mark):
    for size in (64, 128, 192, 256, 512, 1024):
        for at in range(size - len(mark) + 1):
            payload = (b"." * at + mark).ljust(size, b".")
            a = mpeg.parse(mpeg.write(payload))
            assert a.payload == payload and a.skipped == 0 and not a.end_tag


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"TAG", b"ID3", b"\xff\xfb", b"\xff", b"\0", b"abc", b"x" * 61]), max_size=60).map(b"".join))
def test_payloads_of_marks_with_a_tag_behind(payload):
    data = mpeg.write(payload)
    tagged = mpeg.parse(data + b"TAG" + bytes(125))
    assert tagged.payload == payload == mpeg.parse(data).payload and tagged.end_tag and tagged.skipped == 0


def test_seek_tables():
    a = mpeg.parse(mpeg.write(bytes(range(256)) * 400))
    assert len(a.seek) == 100 and a.seek[0] <= a.offsets[0] and a.seek == sorted(a.seek)
    per = 100 * (a.offsets[-1] - a.offsets[0]) // len(a.offsets)
    assert all(abs(x - a.offsets[k * len(a.offsets) // 100]) <= per for k, x in enumerate(a.seek))
    frame = bytes.fromhex("fffb9000") + bytes(413)
    table = b"VBRI" + bytes(6) + (4 * 417).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"".join(n.to_bytes(2, "big") for n in (3, 1, 2, 1)) + 3 * (417).to_bytes(2, "big")
    vbri = mpeg.parse(frame[:36] + table + frame[36 + len(table) :] + frame * 3)
    assert (vbri.table_frames, vbri.table_bytes, vbri.seek) == (3, 4 * 417, [417, 834, 1251]) and vbri.seek == vbri.offsets


def test_free_format():
    frame = bytes.fromhex("fffb0000") + b"\x01" * 496
    padded = bytes.fromhex("fffb0200") + b"\x01" * 497
    a = mpeg.parse(frame + padded + frame + padded + b"TAG" + bytes(125))
    assert a.offsets == [0, 500, 1001, 1501] and a.samples == 4 * 1152 and a.skipped == 0 and a.bitrates == {0}
    assert mpeg.parse(frame).offsets == []


def test_all_private_tags_are_kept():
    data = mpeg.write(b"held")
    own = b"PRIV" + (6).to_bytes(4, "big") + b"\0\0" + b"other\0"
    size = (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    a = mpeg.parse(data[:6] + mpeg.syncsafe(size + len(own)) + own + data[10:])
    assert a.payload == b"held" and len(a.tags["PRIV"]) == 2
