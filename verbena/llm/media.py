"""ISO media columns: payloads as samples of an ISO base media file, and a walker that reads such files.

``walk`` visits the nested boxes of any ISO base media file and decodes the sample tables (``stsd``, ``stts``,
``stsc``, ``stsz`` or ``stz2``, ``stco``/``co64``, ``stss``) and the runs of movie fragments (``trex``, ``tfhd``, ``trun``): codec,
duration and the byte range of every keyframe come from the tables alone; the samples' payload is never decoded. ``store`` writes bytes
as uncompressed 8-bit samples.

Defined cases: a null or empty text becomes one sample of padding; equal texts give equal files; null
media or bytes that are no such file (tables that don't fit the file, too) give null features; boxes may nest to any depth; a very long
text becomes one large file; repeated rows give repeated rows; an empty table gives an empty table; columns that are called as a
feature are replaced by it, further columns are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verbena.llm.shared import documents_of, text_bytes, trimmed

#: One sample: 8 x 8 picture elements of three 8-bit parts.
SAMPLE = 192
TIMESCALE, SAMPLE_TICKS = 25, 1
#: Every so many samples one is marked as a keyframe.
KEYFRAME_EVERY = 12
#: Samples in one chunk of the file.
CHUNK_SAMPLES = 24
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"])


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(kind: bytes, rows: np.ndarray, head: bytes = b"", width: str = ">u4") -> bytes:
    return full(kind, head, struct.pack(">I", len(rows)), rows.astype(width).tobytes())


def padded(text: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of ``SAMPLE``."""
    return text.ljust(max(1, -(-len(text) // SAMPLE)) * SAMPLE, b" ")


def store(payload: bytes) -> bytes:
    """An ISO media file whose samples, in order, are exactly ``payload`` (a positive multiple of ``SAMPLE``)."""
    n = len(payload) // SAMPLE
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = len(payload) + 16 >= 1 << 32
    mdat = (struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat")) + payload
    first = len(ftyp) + (16 if wide else 8)
    chunks = -(-n // CHUNK_SAMPLES)
    offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK_SAMPLES * SAMPLE
    runs = [(1, CHUNK_SAMPLES, 1)] if n % CHUNK_SAMPLES == 0 else [(1, CHUNK_SAMPLES, 1)] * (chunks > 1) + [(chunks, n % CHUNK_SAMPLES, 1)]
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        table(b"stts", np.array([[n, SAMPLE_TICKS]])),
        table(b"stsc", np.array(runs)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        table(b"co64", offsets, width=">u8") if wide else table(b"stco", offsets),
        table(b"stss", np.arange(1, n + 1, KEYFRAME_EVERY)),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
    hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"payload\0")
    mdhd = full(b"mdhd", struct.pack(">4I2H", 0, 0, TIMESCALE, n * SAMPLE_TICKS, 0x55C4, 0))
    tkhd = full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, n * SAMPLE_TICKS), bytes(16), unity, struct.pack(">2I", 8 << 16, 8 << 16), flags=7)
    mvhd = full(b"mvhd", struct.pack(">4I", 0, 0, TIMESCALE, n * SAMPLE_TICKS), struct.pack(">IH", 0x10000, 0x100), bytes(10), unity, bytes(24), struct.pack(">I", 2))
    return ftyp + mdat + box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes that stand side by side in ``data[start:end]``."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        stop = end if size == 0 else start + size
        if stop > end or stop < start + head:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield kind, start + head, stop
        start = stop


def numbers(data: bytes, at: int, columns: int, width: str = ">u4") -> np.ndarray:
    """The rows of a table box: a count, then ``columns`` numbers for each row."""
    n = struct.unpack_from(">I", data, at)[0]
    out = np.frombuffer(data, width, n * columns, at + 4).astype(np.int64)
    return out.reshape(-1, columns) if columns > 1 else out


def sample_sizes(t: dict[bytes, tuple[int, int]], data: bytes) -> np.ndarray:
    """The length of every sample, from a plain or a compact size table."""
    if b"stsz" in t:
        at = t[b"stsz"][0] + 4
        each, n = struct.unpack_from(">II", data, at)
        if not each:
            return numbers(data, at + 4, 1)
        if each * n > len(data):
            raise ValueError("more samples than the file has bytes for")
        return np.full(n, each, np.int64)
    at = t[b"stz2"][0] + 4
    bits, n = struct.unpack_from(">II", data, at)
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 8)
        return np.stack((pairs >> 4, pairs & 15), 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, {8: ">u1", 16: ">u2"}[bits], n, at + 8).astype(np.int64)


def sample_ranges(t: dict[bytes, tuple[int, int]], data: bytes) -> np.ndarray:
    """(offset, length) of every sample, from the chunk and size tables."""
    sizes = sample_sizes(t, data)
    n = len(sizes)
    if not n:
        return np.empty((0, 2), np.int64)
    chunks = numbers(data, t[b"co64"][0] + 4, 1, ">u8") if b"co64" in t else numbers(data, t[b"stco"][0] + 4, 1)
    runs = numbers(data, t[b"stsc"][0] + 4, 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
    per_chunk = np.diff(np.minimum(np.cumsum(per_chunk), n), prepend=0)
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    return np.stack([chunks[chunk] + before - before[np.minimum(first, n - 1)[chunk]], sizes], 1)


@dataclass
class Track:
    """The boxes of a track, and what its movie fragments add."""

    boxes: dict[bytes, tuple[int, int]] = field(default_factory=dict)
    ranges: list[np.ndarray] = field(default_factory=list)
    sync: list[np.ndarray] = field(default_factory=list)
    ticks: int = 0


def read_boxes(data: bytes) -> tuple[list[Track], list[tuple[int, dict[bytes, list[tuple[int, int]]]]], dict[int, tuple[int, ...]]]:
    """(tracks, fragments, defaults): each track's boxes; (start of its moof, boxes by kind) of each track fragment; ``trex`` by track.

    The open boxes lie on a stack of their own, so the depth of nesting is free.
    """
    tracks: list[Track] = []
    fragments: list[tuple[int, dict[bytes, list[tuple[int, int]]]]] = []
    defaults: dict[int, tuple[int, ...]] = {}
    stack = [(boxes(data, 0, len(data)), None, None, 0)]
    while stack:
        inner, track, fragment, moof = stack[-1]
        found = next(inner, None)
        if found is None:
            stack.pop()
            continue
        kind, a, b = found
        if kind == b"trak":
            track = Track()
            tracks.append(track)
        elif kind == b"moof":
            moof = a - 8
        elif kind == b"traf":
            fragment = {}
            fragments.append((moof, fragment))
        elif kind == b"trex":
            defaults[struct.unpack_from(">I", data, a + 4)[0]] = struct.unpack_from(">4I", data, a + 8)
        if kind in CONTAINERS:
            stack.append((boxes(data, a, b), track, fragment, moof))
        elif fragment is not None:
            fragment.setdefault(kind, []).append((a, b))
        elif track is not None:
            track.boxes[kind] = (a, b)
    return tracks, fragments, defaults


def add_fragment(data: bytes, moof: int, own: dict[bytes, list[tuple[int, int]]], by_id: dict[int, Track], defaults: dict[int, tuple[int, ...]]) -> None:
    """The samples of a track fragment's runs, with the track's or the fragment's defaults for what a run leaves out."""
    at = own[b"tfhd"][0][0]
    flags, name = struct.unpack_from(">II", data, at)
    flags &= 0xFFFFFF
    at += 8
    base = moof
    if flags & 1:
        base = struct.unpack_from(">Q", data, at)[0]
        at += 8
    at += 4 * bool(flags & 2)
    _, ticks, size, sample_flags = defaults.get(name, (1, 0, 0, 0))
    values = []
    for bit, default in ((8, ticks), (16, size), (32, sample_flags)):
        values.append(struct.unpack_from(">I", data, at)[0] if flags & bit else default)
        at += 4 * bool(flags & bit)
    ticks, size, sample_flags = values
    track, place = by_id[name], base
    for a, _ in own.get(b"trun", []):
        run_flags, n = struct.unpack_from(">II", data, a)
        run_flags &= 0xFFFFFF
        a += 8
        if run_flags & 1:
            place = base + struct.unpack_from(">i", data, a)[0]
            a += 4
        first_flags = struct.unpack_from(">I", data, a)[0] if run_flags & 4 else None
        a += 4 * bool(run_flags & 4)
        columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if run_flags & bit]
        if not columns and n * size > len(data):
            raise ValueError("more samples than the file has bytes for")
        rows = np.frombuffer(data, ">u4", n * len(columns), a).astype(np.int64).reshape(n, len(columns))
        column = {bit: rows[:, i] for i, bit in enumerate(columns)}
        sizes = column.get(0x200, np.full(n, size, np.int64))
        marks = column.get(0x400, np.full(n, sample_flags, np.int64)).copy()
        if n and first_flags is not None and 0x400 not in column:
            marks[0] = first_flags
        track.ranges.append(np.stack([place + np.cumsum(sizes) - sizes, sizes], 1))
        track.sync.append(marks & 0x10000 == 0)
        track.ticks += int(column[0x100].sum()) if 0x100 in column else n * ticks
        place += int(sizes.sum())


def walk(data: bytes) -> list[dict]:
    """For each track, those with pictures first: codec, timescale, duration in seconds, samples and the byte ranges of its keyframes."""
    tracks, fragments, defaults = read_boxes(data)
    by_id = {struct.unpack_from(">I", data, t.boxes[b"tkhd"][0] + (20 if data[t.boxes[b"tkhd"][0]] else 12))[0]: t for t in tracks if b"tkhd" in t.boxes}
    for moof, own in fragments:
        add_fragment(data, moof, own, by_id, defaults)
    out = []
    for track in tracks:
        t = track.boxes
        if b"stsz" not in t and b"stz2" not in t:
            continue
        version = data[t[b"mdhd"][0]]
        scale = struct.unpack_from(">I", data, t[b"mdhd"][0] + (20 if version else 12))[0]
        times = numbers(data, t[b"stts"][0] + 4, 2)
        ranges = sample_ranges(t, data)
        sync = np.zeros(len(ranges), bool)
        sync[numbers(data, t[b"stss"][0] + 4, 1) - 1 if b"stss" in t else slice(None)] = True
        ranges, sync = np.concatenate([ranges, *track.ranges]), np.concatenate([sync, *track.sync])
        out.append({
            "codec": data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1"),
            "timescale": scale,
            "duration": float(((times[:, 0] * times[:, 1]).sum() + track.ticks) / max(1, scale)),
            "samples": ranges,
            "keyframes": ranges[sync],
            "pictures": b"hdlr" in t and data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12] == b"vide",
        })
    return sorted(out, key=lambda t: not t["pictures"])


def read_samples(data: bytes, track: dict) -> bytes:
    """The stored samples in order; samples that stand side by side are copied as one run."""
    r = track["samples"]
    if not len(r):
        return b""
    cut = np.flatnonzero(np.append(True, r[1:, 0] != r[:-1, 0] + r[:-1, 1]))
    stop = np.append(cut[1:], len(r)) - 1
    return b"".join(data[a:b] for a, b in zip(r[cut, 0].tolist(), (r[stop, 0] + r[stop, 1]).tolist(), strict=True))


def feature(track: dict) -> str:
    """The track's columns in one string; the keyframe ranges as a checksum, as they are returned in full too."""
    keys = track["keyframes"]
    return f"codec={track['codec'].strip()};duration={track['duration']:.3f};samples={len(track['samples'])};keyframes={len(keys)};ranges={zlib.crc32(keys.astype('<i8').tobytes()):08x}"


FEATURES = "codec string, duration double, n_samples long, keyframes array<struct<offset: long, length: long>>"


def media_columns(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with codec, duration, n_samples and keyframe byte ranges of the ``media`` files' first picture track (else their first track)."""
    schema = df.schema
    keep = [c for c in df.columns if c not in ("codec", "duration", "n_samples", "keyframes")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for x in part.column(keep.index(media)).to_pylist():
                try:
                    t = walk(x)[0] if x else None
                except (ValueError, KeyError, IndexError, OverflowError, struct.error):
                    t = None
                rows.append(t)
            keys = [None if t is None else [{"offset": a, "length": b} for a, b in t["keyframes"].tolist()] for t in rows]
            cols = [pa.array([t and t["codec"] for t in rows], pa.string()), pa.array([t and t["duration"] for t in rows], pa.float64()), pa.array([None if t is None else len(t["samples"]) for t in rows], pa.int64()), pa.array(keys, pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*keep, "codec", "duration", "n_samples", "keyframes"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in keep)
    return df.select(*keep).mapInArrow(trimmed(run), f"{own}, {FEATURES}")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, padded, as an ISO media file."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = list(text_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([store(padded(x)) for x in texts], pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents_of(docs).mapInArrow(trimmed(run), "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, " + FEATURES


def stored_digest(docs: DataFrame) -> DataFrame:
    """Each text stored as a media file and read back from it: digests of both and the file's features.

    One narrow pass: the file lives only while its row is worked on.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                media = store(padded(text))
                track = walk(media)[0]
                back = read_samples(media, track)
                out.append({"doc_id": doc, "n_bytes": len(text), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(track), "codec": track["codec"], "duration": track["duration"], "n_samples": len(track["samples"]), "keyframes": [{"offset": a, "length": b} for a, b in track["keyframes"].tolist()]})
            types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(types))

    return documents_of(docs).mapInArrow(trimmed(run), DIGEST)
