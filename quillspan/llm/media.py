"""Media columns: ISO media containers (ISO/IEC 14496-12 box layout).

write_container() stores bytes losslessly as 8-bit mono PCM samples; describe() walks the nested boxes
of any container, decodes its sample tables and gives codec, duration and the byte ranges that begin
with a keyframe, without touching media payloads.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, kept, slices

#: Fixed values of the format: boxes that hold boxes, with the bytes that come before their children.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"udta": 0}
#: Samples of SAMPLE_BYTES each; a chunk has CHUNK_SAMPLES, a keyframe comes every KEY_EVERY samples.
SAMPLE_BYTES, CHUNK_SAMPLES, KEY_EVERY, TIMESCALE = 64, 32, 16, 8000
#: Bytes of text that a worker turns into media at a time.
BATCH_BYTES = 4 << 20
MEDIA = "struct<media:binary,n_bytes:bigint,codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<start:bigint,length:bigint>>,error:string>"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """Zero bytes added up to a positive multiple of SAMPLE_BYTES."""
    return data + b"\0" * (SAMPLE_BYTES - len(data) if len(data) < SAMPLE_BYTES else -len(data) % SAMPLE_BYTES)


def write_container(payload: bytes) -> bytes:
    """A QuickTime-brand file whose only track has the payload as unsigned 8-bit samples."""
    n = len(payload) // SAMPLE_BYTES
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks, rest = divmod(n, CHUNK_SAMPLES)
    runs = [(1, CHUNK_SAMPLES)] * (chunks > 0) + [(chunks + 1, rest)] * (rest > 0)
    keys = range(1, n + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    head = _box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
    n_chunks, span = chunks + (rest > 0), CHUNK_SAMPLES * SAMPLE_BYTES

    def moov(first: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, SAMPLE_BYTES)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", c, k, 1) for c, k in runs]),
            _full(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            _full(b"co64", struct.pack(f">I{n_chunks}Q", n_chunks, *[first + i * span for i in range(n_chunks)])),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, len(payload), 0x55C4, 0)), _full(b"hdlr", b"mhlr", b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, len(payload), 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    size = len(moov(0))
    return head + moov(len(head) + size + 16) + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload


def boxes(buf: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of the boxes side by side in a range.

    32-bit and 64-bit sizes and size 0 (to the end) are read; a size that leaves the range or is
    smaller than its header raises ValueError."""
    while start < end:
        if end - start < 8:
            raise ValueError("box header is cut off")
        size, kind = struct.unpack_from(">I4s", buf, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("box header is cut off")
            (size,) = struct.unpack_from(">Q", buf, body)
            body += 8
        elif size == 0:
            size = end - start
        stop = start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} leaves its parent")
        yield kind, body, stop
        start = stop


@dataclass
class Track:
    handler: bytes = b""
    codec: str | None = None
    timescale: int = 0
    duration: int = 0
    deltas: list[tuple[int, int]] = field(default_factory=list)
    sync: list[int] | None = None
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    runs: list[tuple[int, int]] = field(default_factory=list)
    chunks: tuple[int, ...] = ()
    fragments: list[tuple[int, np.ndarray, list[int]]] = field(default_factory=list)  # base, sizes, keyframes

    def offsets(self) -> np.ndarray:
        """The first byte of each sample, from the chunk table."""
        counts = np.zeros(len(self.chunks), np.int64)
        stops = [*[r[0] - 1 for r in self.runs[1:]], len(self.chunks)]
        for (first, per), stop in zip(self.runs, stops, strict=False):
            counts[first - 1 : stop] = per
        if counts.sum() != len(self.sizes):
            raise ValueError("the chunk table does not hold all samples")
        if not len(self.sizes):
            return self.sizes
        before = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        chunk = np.repeat(np.arange(len(counts)), counts)
        return np.asarray(self.chunks, np.int64)[chunk] + before - before[np.minimum(first, len(before) - 1)][chunk]


def _entries(buf: memoryview, at: int, end: int, form: str) -> list[tuple[int, ...]]:
    (n,) = struct.unpack_from(">I", buf, at + 4)
    one = struct.calcsize(">" + form)
    if at + 8 + n * one > end:
        raise ValueError("a sample table is cut off")
    return list(struct.iter_unpack(">" + form, buf[at + 8 : at + 8 + n * one]))


def tracks(buf: memoryview) -> list[Track]:
    found: list[Track] = []
    by_id: dict[int, Track] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    state: dict[str, int] = {}

    def read(kind: bytes, at: int, stop: int, track: Track | None) -> None:
        if kind == b"trex":
            number, _, delta, size, flags = struct.unpack_from(">5I", buf, at + 4)
            defaults[number] = delta, size, flags
        elif kind == b"tfhd":
            fragment_header(at)
        elif kind == b"trun":
            run(at, stop)
        elif track is None:
            return
        elif kind == b"tkhd":
            by_id[struct.unpack_from(">I", buf, at + (20 if buf[at] else 12))[0]] = track
        elif kind == b"mdhd":
            track.timescale, track.duration = struct.unpack_from(">IQ", buf, at + 20) if buf[at] else struct.unpack_from(">II", buf, at + 12)
        elif kind == b"hdlr":
            track.handler = bytes(buf[at + 8 : at + 12])
        elif kind == b"stsd":
            track.codec = next((k.decode("latin-1") for k, _, _ in boxes(buf, at + 8, stop)), None)
        elif kind == b"stts":
            track.deltas = _entries(buf, at, stop, "II")
        elif kind == b"stss":
            track.sync = [x for (x,) in _entries(buf, at, stop, "I")]
        elif kind == b"stsc":
            track.runs = [(a, b) for a, b, _ in _entries(buf, at, stop, "III")]
        elif kind in (b"stco", b"co64"):
            track.chunks = tuple(x for (x,) in _entries(buf, at, stop, "Q" if kind == b"co64" else "I"))
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", buf, at + 4)
            if not same and at + 12 + 4 * n > stop or n > len(buf):
                raise ValueError("a sample table is cut off")
            track.sizes = np.full(n, same, np.int64) if same else np.frombuffer(buf, ">u4", n, at + 12).astype(np.int64)

    def fragment_header(at: int) -> None:
        flags, number = struct.unpack_from(">II", buf, at)
        at += 8
        delta, size, sample_flags = defaults.get(number, (0, 0, 0))
        base = state["moof"]
        if flags & 1:
            (base,) = struct.unpack_from(">Q", buf, at)
            at += 8
        at += 4 * bool(flags & 2)
        got = []
        for bit, usual in ((8, delta), (16, size), (32, sample_flags)):
            got.append(struct.unpack_from(">I", buf, at)[0] if flags & bit else usual)
            at += 4 * bool(flags & bit)
        state.update(track=number, base=base, delta=got[0], size=got[1], flags=got[2])

    def run(at: int, stop: int) -> None:
        flags, n = struct.unpack_from(">II", buf, at)
        flags &= 0xFFFFFF
        at += 8
        base, first = state["base"], None
        if flags & 1:
            base += struct.unpack_from(">i", buf, at)[0]
            at += 4
        if flags & 4:
            (first,) = struct.unpack_from(">I", buf, at)
            at += 4
        names = [name for bit, name in ((0x100, "delta"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
        if n > len(buf) or at + 4 * n * len(names) > stop:
            raise ValueError("a fragment run is cut off")
        table = np.frombuffer(buf, ">u4", n * len(names), at).reshape(n, len(names)).astype(np.int64)
        column = lambda name: table[:, names.index(name)] if name in names else np.full(n, state[name], np.int64)
        sample_flags = column("flags").copy()
        if first is not None and n:
            sample_flags[0] = first
        track = by_id.get(state["track"])
        if track is None:
            raise ValueError("a fragment names no track")
        track.duration += int(column("delta").sum())
        track.fragments.append((base, column("size"), np.flatnonzero(sample_flags & 0x10000 == 0).tolist()))
        state["base"] = base + int(column("size").sum())

    open_boxes: list[tuple[Iterator[tuple[bytes, int, int]], Track | None]] = [(boxes(buf, 0, len(buf)), None)]
    while open_boxes:  # a stack of its own: nesting may be of any depth
        inside, track = open_boxes[-1]
        box = next(inside, None)
        if box is None:
            open_boxes.pop()
            continue
        kind, at, stop = box
        if kind == b"trak":
            track = Track()
            found.append(track)
        elif kind == b"moof":
            state["moof"] = at - 8
        if kind in CONTAINERS:
            open_boxes.append((boxes(buf, at + CONTAINERS[kind], stop), track))
        else:
            read(kind, at, stop, track)
    return found


def describe(media: bytes) -> dict:
    """codec, timescale, duration, n_samples and keyframes [(start, length)] of the first track that
    has samples, else of the first track. A keyframe's range runs to the next keyframe or gap between
    samples. Null, empty, cut off or inconsistent containers give nulls and an `error`."""
    none = {"codec": None, "timescale": None, "duration": None, "n_samples": None, "keyframes": None}
    if not media:
        return none | {"error": "no media"}
    try:
        found = tracks(memoryview(media))
        if not found:
            return none | {"error": "no track"}
        track = next((t for t in found if len(t.sizes) or t.fragments), found[0])
        offsets, sizes = [track.offsets()], [track.sizes]
        keys = [i - 1 for i in track.sync] if track.sync is not None else list(range(len(track.sizes)))
        total = len(track.sizes)
        for base, more, fragment_keys in track.fragments:
            offsets.append(base + np.concatenate(([0], np.cumsum(more)[:-1])) if len(more) else more)
            sizes.append(more)
            keys += [total + k for k in fragment_keys]
            total += len(more)
        if any(len(x) and int(x.max()) > len(media) for x in [*offsets, *sizes]):
            raise ValueError("samples lie outside the file")
        at, size = np.concatenate(offsets), np.concatenate(sizes)
        if len(at) and (int(at.min()) < 0 or int((at + size).max()) > len(media)):
            raise ValueError("samples lie outside the file")
        if keys and not (0 <= min(keys) and max(keys) < total):
            raise ValueError("a keyframe is no sample")
        gaps = (np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1).tolist() if total else []
        stops = sorted({*keys, *gaps, total})
        ranges = []
        for k in sorted(set(keys)):
            last = stops[bisect_right(stops, k)] - 1
            ranges.append({"start": int(at[k]), "length": int(at[last] + size[last] - at[k])})
        duration = track.duration or sum(n * d for n, d in track.deltas)
        if duration >= 1 << 63:
            raise ValueError("the duration is out of range")
        return {"codec": track.codec, "timescale": track.timescale, "duration": duration, "n_samples": total, "keyframes": ranges, "error": None}
    except (ValueError, struct.error, KeyError, IndexError, OverflowError) as error:
        return none | {"error": str(error)[:200]}


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_FACTS = [("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", _RANGES), ("error", pa.string())]
_MEDIA = pa.struct([("media", pa.binary()), ("n_bytes", pa.int64()), *_FACTS])
_CHECKS = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])


def _parts(data: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about BATCH_BYTES, so that a worker's memory does not grow with the batch."""
    yield from slices(len(data), pc.fill_null(pc.binary_length(data), 0).to_pylist(), BATCH_BYTES)


def text_to_media(text: Column) -> Column:
    """Struct MEDIA for a text: its UTF-8 bytes, padded, as samples of a container, and what describe()
    reads from that container. Null counts as empty; equal texts give equal values."""

    @F.arrow_udf(MEDIA)
    def media(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data = batch.cast(pa.binary())
            for a, b in _parts(data):
                rows = []
                for value in data[a:b]:
                    text_bytes = value.as_py() or b""
                    stored = write_container(padded(text_bytes))
                    rows.append({"media": stored, "n_bytes": len(text_bytes)} | describe(stored))
                yield pa.array(rows, _MEDIA)

    return media(text)


def read_payload(media: Column, keyframes: Column) -> Column:
    """Checksums of the sample bytes that the keyframe ranges name in a stored container.

    Null for null media; without ranges the payload is empty."""

    @F.arrow_udf("struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string>")
    def read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for stored, ranges in batches:
            rows = []
            for value, keys in zip(stored, ranges, strict=True):
                blob = value.as_py()
                if blob is None:
                    rows.append(None)
                    continue
                payload = b"".join(blob[k["start"] : k["start"] + k["length"]] for k in keys.as_py() or ())
                rows.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest()})
            yield pa.array(rows, _CHECKS)

    return read(media, keyframes)


def media_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the fields of MEDIA for every row; rows are kept one for one, other columns stay, columns of
    these names are replaced; an empty table gives an empty result."""
    names = ["media", "n_bytes", *(n for n, _ in _FACTS)]
    return beside(df, text_to_media(F.col(text_col))).select(*kept(df, *names), *[F.col(f"new.{n}") for n in names])


def describe_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add codec, timescale, duration, n_samples, keyframes and error, read from a column of stored
    containers (binary) without decoding payloads.

    Null, empty, cut off or inconsistent media give nulls and an error text, whatever their bytes are.
    Rows are kept one for one, repeated rows too; an empty table gives an empty result; columns of
    these names are replaced, others stay."""

    @F.arrow_udf("struct<" + MEDIA[MEDIA.index("codec:") :])
    def facts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([describe(value.as_py()) for value in batch], pa.struct(_FACTS))

    names = [n for n, _ in _FACTS]
    return beside(df, facts(F.col(media_col))).select(*kept(df, *names), *[F.col(f"new.{n}") for n in names])


def media_digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Checksums and a feature string, read back from the stored bytes of media_columns()."""
    needed = df.select(key, "media", "n_bytes", "codec", "timescale", "duration", "n_samples", "keyframes")
    out = needed.withColumn("_read", read_payload(F.col("media"), F.col("keyframes")))
    ranges = F.sha2(F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["start"], k["length"])), ","), 256)
    feature = F.concat_ws(";", F.concat(F.lit("codec="), F.trim("codec")), F.concat(F.lit("rate="), F.col("timescale")), F.concat(F.lit("duration="), F.col("duration")), F.concat(F.lit("samples="), F.col("n_samples")), F.concat(F.lit("keyframes="), F.size("keyframes")), F.concat(F.lit("ranges="), ranges))
    return out.select(key, "n_bytes", "_read.*", feature.alias("feature"))
