"""Media containers: exact round trip, nested boxes, fragments and broken files."""

import hashlib
import random
import struct
import zlib

from quillspan.llm.media import _box, _full, describe, describe_media, media_columns, media_digest, padded, write_container


def test_round_trip():
    for n in (0, 1, 63, 64, 65, 2048, 2049, 100_000):
        data = bytes(i * 7 % 251 for i in range(n))
        payload = padded(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
        media = write_container(payload)
        d = describe(media)
        assert d["error"] is None and d["codec"] == "raw " and d["duration"] == len(payload) and d["n_samples"] == len(payload) // 64
        assert b"".join(media[k["start"] : k["start"] + k["length"]] for k in d["keyframes"]) == payload
        assert len(d["keyframes"]) == -(-d["n_samples"] // 16)


def test_variable_sizes_and_chunks():
    sizes = [5, 7, 11, 13]
    head = _box(b"ftyp", b"isom")
    body = bytes(range(36))
    mdat_at = len(head) + 8
    stbl = _box(b"stbl", _full(b"stsd", struct.pack(">I", 1), _box(b"avc1", bytes(70))), _full(b"stts", struct.pack(">III", 1, 4, 10)), _full(b"stss", struct.pack(">3I", 2, 1, 3)), _full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 2, 1)), _full(b"stsz", struct.pack(">6I", 0, 4, *sizes)), _full(b"stco", struct.pack(">3I", 2, mdat_at, mdat_at + 12)))
    moov = _box(b"moov", _box(b"trak", _box(b"mdia", _full(b"mdhd", struct.pack(">IIIII", 0, 0, 600, 40, 0)), _box(b"minf", stbl))))
    d = describe(head + _box(b"mdat", body) + moov)
    assert d["codec"] == "avc1" and (d["timescale"], d["duration"]) == (600, 40)
    assert d["keyframes"] == [{"start": mdat_at, "length": 12}, {"start": mdat_at + 12, "length": 24}]


def test_fragments():
    trak = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, 0)), _box(b"mdia", _full(b"mdhd", struct.pack(">IIIII", 0, 0, 90, 0, 0)), _box(b"minf", _box(b"stbl", _full(b"stsd", struct.pack(">I", 1), _box(b"mp4a"))))))
    moov = _box(b"moov", trak, _box(b"mvex", _full(b"trex", struct.pack(">5I", 1, 1, 3, 4, 0x10000))))
    fragment = lambda offset: _box(b"moof", _box(b"traf", _full(b"tfhd", struct.pack(">I", 1)), _full(b"trun", struct.pack(">IiI", 3, offset, 0), flags=5)))
    size = len(fragment(0))
    d = describe(moov + fragment(size + 8) + _box(b"mdat", bytes(12)))
    assert d["codec"] == "mp4a" and d["duration"] == 9 and d["n_samples"] == 3
    assert d["keyframes"] == [{"start": len(moov) + size + 8, "length": 12}]


def test_broken_files():
    media = write_container(padded(b"x" * 500))
    for bad in (None, b"", b"abc", media[:200], media[:-100], media[:20] + b"\xff" * 4 + media[24:]):
        d = describe(bad)
        assert d["error"] and d["codec"] is None and d["keyframes"] is None


def crafted():
    """Well-formed boxes whose numbers are absurd."""
    deep = b""
    for _ in range(3000):
        deep = _box(b"moov", deep)
    yield deep
    stsd = _full(b"stsd", struct.pack(">I", 1), _box(b"avc1"))
    head = lambda duration, *tables: _box(b"moov", _box(b"trak", _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQ", 0, 0, 600, duration), version=1), _box(b"minf", _box(b"stbl", stsd, *tables)))))
    one = [_full(b"stsc", struct.pack(">4I", 1, 1, 1, 1)), _full(b"stsz", struct.pack(">3I", 0, 1, 4))]
    yield head(0, *one, _full(b"co64", struct.pack(">IQ", 1, 2**64 - 1)))
    yield head(2**64 - 1, *one, _full(b"co64", struct.pack(">IQ", 1, 0)))
    yield head(0, _full(b"stsc", struct.pack(">4I", 1, 1, 1, 1)), _full(b"stsz", struct.pack(">2I", 2**32 - 1, 1)), _full(b"stco", struct.pack(">2I", 1, 0)))
    yield head(0, _full(b"stts", struct.pack(">I", 2**32 - 1)))


def test_describe_stored_media(spark):
    good = write_container(padded(b"hello" * 90))
    rng = random.Random(13)
    broken = [bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in good) for _ in range(300)]
    rows = [(1, good, "x"), (1, good, "x"), (2, None, "x"), (3, b"", "x")] + [(i, m, "x") for i, m in enumerate([*crafted(), *broken], 10)]
    df = spark.createDataFrame(rows, "id long, media binary, codec string")
    got = describe_media(df).collect()
    assert len(got) == len(rows) and all((r.error is None) == (r.keyframes is not None) for r in got)
    assert [(r.codec, r.n_samples) for r in got if r.id == 1] == [("raw ", 8)] * 2
    assert all(r.error for r in got if r.id in (2, 3, 10, 11, 12, 13, 14))
    assert describe_media(df.limit(0)).count() == 0


def test_frames(spark):
    rows = [(1, "héllo", "x", "y"), (1, "héllo", "x", "y"), (2, None, "x", "y"), (None, "", "x", "y"), (3, "z" * 100_000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _read string, _media string")
    assert all(r._read == "x" and r._media == "y" for r in media_columns(df).collect())
    got = media_digest(media_columns(df)).collect()
    assert len(got) == 5
    want = {}
    for i, t, *_ in rows:
        p = padded((t or "").encode())
        want[i] = (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id] for r in got)
    assert media_digest(media_columns(df.limit(0))).count() == 0
