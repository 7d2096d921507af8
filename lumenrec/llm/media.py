"""Media columns: bytes as 8-bit grey PNG images, with a cosine-transform hash.

Encoding: bytes fill rows of ``width`` samples, 255 up to a positive multiple of
``width``.  Each row takes the filter (none, sub, up) with the smallest sum of
absolute differences.  The filtered rows are one zlib stream in IDAT chunks.

Decoding reads the chunks with their checksums, inflates, and undoes all five
PNG filters in numpy.  A broken signature, length, checksum or stream raises
``ValueError``.

The feature is a perceptual hash: the image averaged to 32 x 32, its 8 x 8
lowest cosine-transform terms, each bit telling whether a term exceeds their
median (the constant term left out).  16 hex digits.

Defined results: null is an empty payload, which still makes one row of 255;
equal inputs have equal images; an empty table gives no rows; rows that repeat
are done each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, text_or_empty

WIDTH = 576
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_IDAT_BYTES = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes, width: int = WIDTH) -> bytes:
    return data + b"\xff" * (-len(data) % width if data else width)


def encode(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    """A PNG of the payload, whose length must be a positive multiple of ``width``."""
    if not payload or len(payload) % width:
        raise ValueError("payload must be a positive multiple of the width")
    x = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = x.copy(), x.copy()
    sub[:, 1:] -= x[:, :-1]
    up[1:] -= x[:-1]
    rows = (x, sub, up)
    cost = np.stack([np.abs(r.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for r in rows])
    kind = cost.argmin(axis=0).astype(np.uint8)
    out = np.empty((len(x), width + 1), np.uint8)
    out[:, 0] = kind
    for k, r in enumerate(rows):
        mine = kind == k
        out[mine, 1:] = r[mine]
    packed = zlib.compress(out.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(x), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[k : k + _IDAT_BYTES]) for k in range(0, len(packed), _IDAT_BYTES))
    return _SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("truncated chunk")
        n, kind = struct.unpack_from(">I4s", png, at)
        if at + 12 + n > len(png):
            raise ValueError("truncated chunk")
        data = png[at + 8 : at + 8 + n]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind!r} does not match")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def unfilter(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undo the row filters of one-byte samples.  Stretches of unfiltered rows stay as they are."""
    out = rows.copy()
    width = out.shape[1]
    zero = np.zeros(width, np.uint8)
    for r in np.flatnonzero(kinds):
        prior = out[r - 1] if r else zero
        row, kind = out[r], kinds[r]
        if kind == 1:
            np.cumsum(row, dtype=np.uint8, out=row)
        elif kind == 2:
            row += prior
        elif kind in (3, 4):
            left = corner = 0
            for k in range(width):
                above = int(prior[k])
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner)))[2]
                    corner = above
                left = (int(row[k]) + guess) & 255
                row[k] = left
        else:
            raise ValueError(f"unknown filter {kind}")
    return out


def decode(png: bytes) -> np.ndarray:
    """The samples, (height, width) uint8, of an 8-bit grey PNG without interlace."""
    head, packed = None, []
    for kind, data in _chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG without interlace")
    width, height = head[:2]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as broken:
        raise ValueError("broken image data") from broken
    if len(raw) != height * (width + 1):
        raise ValueError("image data of the wrong length")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(rows[:, 1:], rows[:, 0])


_GRID = 32
_COSINE = np.cos(np.pi * (2 * np.arange(_GRID)[None, :] + 1) * np.arange(8)[:, None] / (2 * _GRID))


def _shrink(x: np.ndarray, n: int) -> np.ndarray:
    """Rows averaged to ``n`` bands of nearly equal height; fewer rows repeat."""
    edges = np.arange(n) * len(x) // n
    stop = np.maximum(np.append(edges[1:], len(x)), edges + 1)
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=np.float64)])
    return (total[stop] - total[edges]) / (stop - edges)[:, None]


def feature(samples: np.ndarray) -> str:
    bands = samples.reshape(len(samples), _GRID, -1).mean(axis=2) if samples.shape[1] % _GRID == 0 else _shrink(samples.T, _GRID).T
    low = (_COSINE @ _shrink(bands, _GRID) @ _COSINE.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return f"{int(np.packbits(bits).view('>u8')[0]):016x}"


def images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) for every row."""
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.encode(text_or_empty(quoted(text_col)), "UTF-8").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # small outgoing batches bound the memory
                part = batch.slice(k, 256)
                data = [b.as_py() for b in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(b) for b in data], pa.int64()), pa.array([encode(pad(b)) for b in data], pa.binary())],
                    names=["id", "n_bytes", "media"],
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


def stored(media: DataFrame) -> DataFrame:
    """The media column written to the shared folder and read back."""
    return cut(media, "media")


def describe(media: DataFrame) -> DataFrame:
    """Reads the media column back: payload size, digests and feature of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.column(2):
                png = m.as_py()
                samples = decode(png)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature(samples)))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(
        run,
        f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )
