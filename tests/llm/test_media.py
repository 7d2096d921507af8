import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lumenrec.llm import media


def test_round_trip_and_size():
    r = random.Random(5)
    for n in (0, 1, 575, 576, 577, 5000, 70_000):
        data = bytes(r.randrange(256) for _ in range(n))
        payload = media.pad(data)
        assert len(payload) == max(1, -(-n // 576)) * 576 and payload[n:] == b"\xff" * (len(payload) - n)
        assert media.decode(media.encode(payload)).tobytes() == payload


def png_with(rows, kinds, width):
    raw = b"".join(bytes([k]) + bytes(r) for k, r in zip(kinds, rows, strict=True))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return media._SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(raw)) + media._chunk(b"IEND", b"")


def test_all_five_filters_undo():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (10, 24), dtype=np.uint8).astype(int)
    kinds, rows = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0], []
    for r, kind in enumerate(kinds):
        up = x[r - 1] if r else np.zeros(24, int)
        left, corner = np.append(0, x[r, :-1]), np.append(0, up[:-1])
        p = left + up - corner
        d = np.stack([abs(p - left), abs(p - up), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, up, corner])
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        rows.append(((x[r] - guess) % 256).astype(np.uint8))
    assert (media.decode(png_with(rows, kinds, 24)) == x).all()


def test_damage_is_noticed():
    png = bytearray(media.encode(media.pad(b"some text")))
    for at in (3, 20, len(png) // 2, len(png) - 20):
        broken = bytearray(png)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(broken))
    with pytest.raises(ValueError):
        media.decode(bytes(png[:-15]))


def test_table(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "é" * 600, 1), (3, "é" * 600, 1), (None, "long text " * 100_000, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, media int")
    got = media.describe(media.images(d)).collect()
    want = []
    for i, t, _ in rows:
        p = media.pad((t or "").encode())
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted(((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    same = [(r.media_bytes, r.media_sha256, r.feature) for r in got if r.id == 3]
    assert same[0] == same[1]
    assert media.describe(media.images(spark.createDataFrame([], d.schema))).count() == 0


def test_feature_is_stable_under_small_change():
    x = np.random.default_rng(3).integers(0, 256, (40, 576), dtype=np.uint8)
    y = x.copy()
    y[5, 7] ^= 3
    a, b = int(media.feature(x), 16), int(media.feature(y), 16)
    assert (a ^ b).bit_count() <= 4
