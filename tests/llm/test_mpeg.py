import hashlib
import os
import zlib
from fractions import Fraction

from loomset.llm import mpeg
from tests.llm.conftest import ODD


def slow_crc(data):
    crc = 0xFFFF
    for byte in data:
        for bit in range(7, -1, -1):
            top = crc >> 15 & 1
            crc = crc << 1 & 0xFFFF
            if top ^ (byte >> bit & 1):
                crc ^= 0x8005
    return crc


def slow_frames(data, at):
    """Frame by frame, by the length in each header."""
    places = []
    while at + 4 <= len(data):
        places.append(at)
        at += 72 * mpeg.BITRATES[2, 3][data[at + 2] >> 4] * 1000 // 16000
    return places


def test_round_trip_and_every_frame():
    for text in [b"", b"x", b"\xff" * 5000, os.urandom(5760), b"\xff\xf2\xd8\xc0" * 500]:
        payload = mpeg.pad(text)
        media = mpeg.encode(payload, len(text))
        s = mpeg.parse(media)
        assert b"".join(s.bodies) == payload and s.tags == {"payload_bytes": str(len(text))}
        tag = 10 + int.from_bytes(media[8:10], "big") // 256 * 128 + media[9]
        assert s.offsets == slow_frames(media, tag)[1:]
        assert s.table_frames == len(s.offsets) == len(payload) // 576 and s.table_bytes == len(media) - tag
        assert s.duration == Fraction(len(s.offsets) * 576, 16000) and s.checked == len(s.offsets) and not s.broken and not s.skipped
        for at in s.offsets:
            assert slow_crc(media[at + 2 : at + 4] + media[at + 6 : at + 15]) == int.from_bytes(media[at + 4 : at + 6], "big")


def test_resynchronises_and_finds_broken_checksums():
    media = mpeg.encode(mpeg.pad(os.urandom(3000)), 3000)
    tag = mpeg.parse(media).offsets[0] - 648
    junk = media[:tag] + b"\xff\xfbjunk\xff" + media[tag : tag + 1296] + b"\xff\xf2\xd8" + media[tag + 1296 :] + b"TAG" + bytes(125)
    s = mpeg.parse(junk)
    assert len(s.offsets) in (5, 6) and s.skipped >= 7 and s.checked == len(s.offsets)
    bad = bytearray(media)
    bad[tag + 648 + 7] ^= 1
    s = mpeg.parse(bytes(bad))
    assert (s.broken, s.checked, len(s.offsets)) == (1, 5, 6)
    for at in range(400, 576):  # TAG in the last frame is payload
        text = b"a" * at + b"TAG" + b"b" * (573 - at) if at <= 573 else b"a" * 570 + b"TAGTAG"[: 576 - 570]
        tagged = mpeg.encode(mpeg.pad(text), len(text))
        assert b"".join(mpeg.parse(tagged).bodies) == text and b"".join(mpeg.parse(tagged + b"TAG" + bytes(125)).bodies) == text
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(b"no audio \xff\xff here").offsets == []


def test_query_digests(spark, docs_of):
    rows = {r.doc_id: r for r in mpeg.report(mpeg.read(mpeg.store(docs_of([(10, "né" * 700), *ODD]).selectExpr("*", "1 as media")))).collect()}
    for i, text in [(10, "né" * 700), (1, ""), (4, "one"), (6, "a b c d " * 20000)]:
        raw, r = text.encode(), rows[i]
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = mpeg.encode(payload, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[1].feature == rows[2].feature
    assert mpeg.report(mpeg.read(mpeg.store(docs_of([])))).count() == 0
