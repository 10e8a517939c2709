"""Image readers, area resizing and the text media query."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import media


@given(st.integers(1, 9), st.integers(1, 9), st.randoms(use_true_random=False))
@settings(max_examples=30, deadline=None)
def test_round_trips(h, w, rng):
    grey = np.array([[rng.randrange(256) for _ in range(w)] for _ in range(h)], np.uint8)
    colour = np.stack([grey, 255 - grey, grey // 2], axis=2)
    for image in (grey, colour):
        assert (media.read_netpbm(media.netpbm_bytes(image)) == image).all()
        assert (media.read_bmp(media.bmp_bytes(image)) == image).all()
        assert (media.npy_array(media.npy_bytes(image)) == image).all()


def test_plain_kinds_and_comments():
    assert media.read_netpbm(b"P1\n# c\n3 2\n1 0 1\n0 1 0").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.read_netpbm(b"P2 2 1 255\n7 8").tolist() == [[7, 8]]
    assert media.read_netpbm(b"P3\n1 1 255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.read_netpbm(b"P4\n9 1\n\xff\x80").tolist() == [[1] * 9]
    assert media.read_netpbm(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]


@pytest.mark.parametrize("data", [b"", b"P7 1 1", b"P5\n2 2\n255\nab", b"BM", b"P2 2 2 0\n1 1 1 1"])
def test_broken(data):
    with pytest.raises(media.MediaError):
        media.decode_image(data)


def test_area_resize_is_the_mean_over_areas():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (7, 10)).astype(np.uint8)
    big = np.kron(image, np.ones((8 * 9, 9 * 8)))  # every target cell is whole cells of this
    small = media.area_resize(image, 8, 9)
    want = big.reshape(8, big.shape[0] // 8, 9, big.shape[1] // 9).mean(axis=(1, 3))
    assert np.allclose(small, want)


def test_text_media(spark):
    rows = [(1, "abc"), (2, ""), (3, None), (4, "é" * 1000), (4, "é" * 1000), (None, "x" * 64)]
    df = spark.createDataFrame([(*r, 9, "f") for r in rows], "doc_id long, text string, n_bytes int, feature string")
    got = media.text_media(df).collect()
    assert len(got) == 6
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        data = text.encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        stored = b"".join(media.npy_bytes(image[i : i + media.TILE_ROWS]) for i in range(0, len(image), media.TILE_ROWS))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.text_media(df.limit(0)).count() == 0


def test_tiles(spark):
    image = np.arange(200, dtype=np.uint8).reshape(10, 20)
    df = spark.createDataFrame([(1, media.bmp_bytes(image)), (2, b"junk"), (3, None)], "id long, data binary")
    got = media.media_tiles(df, "id", "data", tile=8).collect()
    whole = np.zeros_like(image)
    for r in got:
        if r["media_id"] == 1:
            y, x = r["tile_row"] * 8, r["tile_col"] * 8
            whole[y : y + r["height"], x : x + r["width"]] = media.npy_array(r["npy"])
    assert (whole == image).all() and [r["media_id"] for r in got if r["error"]] == [2, 3]


def bmp(width, height, bits, packing, body, table=b"", used=0, masks=b""):
    start = 54 + len(masks) + len(table)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + len(body), 0, 0, start, 40, width, height, 1, bits, packing, len(body), 0, 0, used, 0) + masks + table + body


def test_bit_fields_and_broken_palettes():
    masks = struct.pack("<III", 0xF800, 0x7E0, 0x1F)
    assert media.read_bmp(bmp(2, 1, 16, 3, struct.pack("<HH", 0xF800, 0x001F), masks=masks)).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    assert media.read_bmp(bmp(1, 1, 32, 3, struct.pack("<I", 0x00FF8000), masks=struct.pack("<III", 0xFF0000, 0xFF00, 0xFF))).tolist() == [[[255, 128, 0]]]
    with pytest.raises(media.MediaError):
        media.read_bmp(bmp(1, 1, 8, 0, b"\x09\0\0\0", bytes(8), used=2))


def test_one_bad_file_is_one_row(spark):
    files = [(1, b"P5\n0 0\n255\n"), (2, bmp(1, 1, 8, 0, b"\x09\0\0\0", bytes(8), used=2)), (3, b"BM"), (4, b"P5 2 2 65535\n" + struct.pack(">4H", 1000, 2000, 40000, 65535)), (5, None), (6, b"")]
    df = spark.createDataFrame(files, "id long, data binary")
    got = {r["media_id"]: r for r in media.media_tiles(df, "id", "data", resize=(1, 2)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and [i for i in got if got[i]["error"] is None] == [4]
    assert media.npy_array(got[4]["npy"]).tolist() == [[(1000 + 40000) // 2, (2000 + 65535 + 1) // 2]]


def test_a_text_of_many_tiles(spark):
    text = "0123456789abcdef" * 40_000
    (r,) = media.text_media(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["n_tiles"] == -(-len(text) // 64 // media.TILE_ROWS) and r["payload_sha256"] == hashlib.sha256(text.encode()).hexdigest()
