"""ISO media containers as columns.

``store_as_media`` writes each payload as a small ISO base media file: raw
8-bit grey frames of 24 by 24 samples, one sample-table entry per frame, a
sync-sample table that marks each eighth frame.

``media_metadata`` reads any such file without decoding its payload: it walks
the nested boxes (32-bit, 64-bit and to-the-end sizes), decodes the sample
tables (stts, stsc, stsz, stco or co64, stss) of each track, and stores codec,
duration and the byte ranges of key frames.

Defined results: a null payload is an empty one. Bytes that are no container,
or whose tables contradict the file's size, give null metadata and an
``error`` text; they do not fail the job: boxes lie within their parents, 32
deep at most, tables within their boxes, samples within the file. Files whose
samples are in fragments (moof) are told apart by their error. Without stss
every sample is a key. Columns may have any names; those called like a result
are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices

FRAME = 576
SIDE = 24
KEY_EVERY = 8
TIMESCALE = 25
MOST_DEEP = 32
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex")
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad_payload(data: bytes) -> bytes:
    """The data and bytes 255 up to a positive multiple of a frame."""
    return data + b"\xff" * (-len(data) % FRAME or (0 if data else FRAME))


def write_container(payload: bytes) -> bytes:
    """A file whose samples are the payload's frames, byte for byte."""
    frames = len(payload) // FRAME
    keys = range(1, frames + 1, KEY_EVERY)
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes([8]) + b"8-bit grey".ljust(31, b"\0"), struct.pack(">Hh", 40, -1)
    )

    def movie(at: int) -> bytes:
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, frames, 1)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64", struct.pack(">IQ", 1, at)),
        )
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7), media)
        head = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", head, track)

    start = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    at = len(start) + len(movie(0)) + 8
    return start + movie(at) + _box(b"mdat", payload)


def walk_boxes(data: memoryview):
    """(path, body start, body end) of each box, parents first."""
    open_boxes: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]  # where to go on, the end, the path
    while open_boxes:
        start, end, path = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("box header is cut")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} leaves its parent")
        here = (*path, kind)
        yield here, start + head, start + size
        open_boxes.append((start + size, end, path))
        if kind in NESTED:
            if len(here) >= MOST_DEEP:
                raise ValueError("boxes are nested too deep")
            open_boxes.append((start + head, start + size, here))


def _field(data: memoryview, box: tuple[int, int], form: str, at: int) -> tuple:
    """Numbers of a box's body, which must hold them."""
    if box[0] + at + struct.calcsize(form) > box[1]:
        raise ValueError("box is cut")
    return struct.unpack_from(form, data, box[0] + at)


def _rows(data: memoryview, box: tuple[int, int], n: int, columns: int, at: int, kind: str = ">u4") -> np.ndarray:
    if box[0] + at + n * columns * np.dtype(kind).itemsize > box[1]:
        raise ValueError("table is cut")
    rows = np.frombuffer(data, kind, n * columns, box[0] + at)
    if kind == ">u8" and len(rows) and int(rows.max()) > len(data):
        raise ValueError("a chunk leaves the file")
    return rows.astype(np.int64).reshape(n, columns)


def _counted(data: memoryview, box: tuple[int, int], columns: int, kind: str = ">u4") -> np.ndarray:
    """A table of a full box: its count, then rows."""
    return _rows(data, box, _field(data, box, ">I", 4)[0], columns, 8, kind)


def read_tracks(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration, sample offsets and sizes, key samples."""
    view, tracks, boxes, fragments = memoryview(data), [], None, False
    for path, at, end in walk_boxes(view):
        fragments = fragments or path[-1] == b"moof"
        if path[-1] == b"trak":
            boxes = {}
            tracks.append(boxes)
        elif boxes is not None and b"trak" in path:
            boxes[path[-1]] = (at, end)
    if fragments:
        raise ValueError("samples are in fragments")
    if not tracks:
        raise ValueError("no track")
    out = []
    for boxes in tracks:
        if missing := [k.decode() for k in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if k not in boxes]:
            raise ValueError(f"no {missing[0]}")
        version = _field(view, boxes[b"mdhd"], ">B", 0)[0]
        timescale, duration = _field(view, boxes[b"mdhd"], ">IQ", 20) if version == 1 else _field(view, boxes[b"mdhd"], ">II", 12)
        codec = _field(view, boxes[b"stsd"], "4s", 12)[0].decode("latin-1")
        fixed, n = _field(view, boxes[b"stsz"], ">II", 4)
        if n > len(data):
            raise ValueError("more samples than bytes")
        sizes = np.full(n, fixed, np.int64) if fixed else _rows(view, boxes[b"stsz"], n, 1, 12)[:, 0]
        if b"co64" in boxes:
            chunks = _counted(view, boxes[b"co64"], 1, ">u8")[:, 0]
        elif b"stco" in boxes:
            chunks = _counted(view, boxes[b"stco"], 1)[:, 0]
        else:
            raise ValueError("no chunk offsets")
        groups = _counted(view, boxes[b"stsc"], 3)
        runs = np.diff(np.append(groups[:, 0], len(chunks) + 1)) if len(groups) else np.zeros(0, np.int64)
        if (runs < 0).any() or (len(groups) and groups[0, 0] != 1):
            raise ValueError("chunk runs go back")
        per_chunk = np.repeat(groups[:, 1], runs)[: len(chunks)] if len(groups) else np.zeros(0, np.int64)
        if int(per_chunk.max(initial=0)) > n or per_chunk.sum() != n:
            raise ValueError("chunks and sizes differ in samples")
        chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)
        ends = np.cumsum(sizes)
        first = np.cumsum(per_chunk) - per_chunk
        before = ends - sizes
        offsets = chunks[chunk_of] + before - before[first[chunk_of]] if n else np.zeros(0, np.int64)
        if n and (offsets + sizes).max() > len(data):
            raise ValueError("a sample leaves the file")
        keys = _counted(view, boxes[b"stss"], 1)[:, 0] - 1 if b"stss" in boxes else np.arange(n)
        if len(keys) and (keys.min() < 0 or keys.max() >= n):
            raise ValueError("a key sample does not exist")
        times = _counted(view, boxes[b"stts"], 2)
        out.append({"codec": codec, "timescale": timescale, "duration": duration, "ticks": int((times[:, 0] * times[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "keys": keys})
    return out


def read_payload(data: bytes) -> bytes:
    """The first track's samples in order."""
    track = read_tracks(data)[0]
    offsets, sizes = track["offsets"], track["sizes"]
    if len(offsets) and (offsets[1:] == offsets[:-1] + sizes[:-1]).all():
        return data[int(offsets[0]) : int(offsets[-1] + sizes[-1])]
    return b"".join(data[o : o + s] for o, s in zip(offsets.tolist(), sizes.tolist()))


def store_as_media(table: DataFrame, text_col: str = "text", media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_bytes of the text and a container that holds it."""
    names = [c for c in (keep if keep is not None else table.columns) if c not in (media_col, "n_bytes")]
    source = table.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(f"`{text_col}`").cast("binary").alias("bytes"))
    schema = T.StructType([table.schema[c] for c in names] + [T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])

    def run(batches):
        for batch in slices(batches):
            data = [b or b"" for b in batch.column(len(names)).to_pylist()]
            media = [write_container(pad_payload(b)) for b in data]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([len(b) for b in data], pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return in_batches(source, run, schema)


METADATA = T.StructType(
    [
        T.StructField("codec", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("key_ranges", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("error", T.StringType()),
    ]
)


def _metadata(data: bytes | None) -> dict:
    try:
        track = read_tracks(data or b"")[0]
    except (ValueError, struct.error, OverflowError) as e:
        return {"codec": None, "duration_s": None, "n_samples": None, "key_ranges": None, "error": str(e)}
    keys = track["keys"]
    starts = track["offsets"][keys]
    ranges = [{"start": s, "end": e} for s, e in zip(starts.tolist(), (starts + track["sizes"][keys]).tolist())]
    return {"codec": track["codec"], "duration_s": track["duration"] / track["timescale"] if track["timescale"] else None, "n_samples": len(track["sizes"]), "key_ranges": ranges, "error": None}


def media_metadata(table: DataFrame, media_col: str = "media", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """``keep`` columns and METADATA's; with ``digests`` also those of payload and file."""
    more = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType())] if digests else []
    added = [*METADATA.names, *(n for n, _ in more)]
    names = [c for c in (keep if keep is not None else table.columns) if c != media_col and c not in added]
    source = table.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(f"`{media_col}`").alias("media"))
    schema = T.StructType([table.schema[c] for c in names] + METADATA.fields + [T.StructField(n, t) for n, t in more])
    arrow = pa.struct([("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("key_ranges", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("error", pa.string())])

    def digest(data: bytes | None, error: str | None) -> tuple:
        data = data or b""
        payload = b"" if error else read_payload(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest()

    def run(batches):
        for batch in slices(batches):
            data = batch.column(len(names)).to_pylist()
            rows = [_metadata(d) for d in data]
            columns = [*batch.columns[: len(names)], *pa.array(rows, arrow).flatten()]
            if digests:
                found = list(zip(*(digest(d, r["error"]) for d, r in zip(data, rows)))) or [()] * 5
                columns += [pa.array(list(c), pa.string() if n.endswith("sha256") else pa.int64()) for c, (n, _) in zip(found, more)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_batches(source, run, schema)
