"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles and difference hashes.

Images are decoded by the two readers below, without an image library. `area_resize` takes exact means over
rectangles with fractional edges from an integral image, so its cost does not depend on the scale. The stored form
of an image is an NPY tile (`npy_bytes`), read back by `npy_array`; `difference_hash` is its feature.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.batches import flat_utf8, keyed_text, map_batches

#: Samples in a row of a payload image; payloads are whole rows.
ROW_SAMPLES = 64
_TOKEN = re.compile(rb"(?:\s+|#[^\n\r]*[\n\r])*([^\s#]+)")


class MediaError(ValueError):
    """Bytes that are not a whole image of a supported kind."""


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16 samples, height x width (x 3); bitmaps as 0 (white) and 1."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise MediaError("not a Netpbm file")
    at, numbers, plain = 2, [], kind in (b"P1", b"P2", b"P3")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        found = _TOKEN.match(data, at)
        if not found or not found[1].isdigit():
            raise MediaError("bad header")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, top = (*numbers, 1)[:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < top < 65536:
        raise MediaError("bad sample range")
    if not width or not height:
        raise MediaError("no samples")
    n = width * height * depth
    dtype = np.dtype(np.uint8 if top < 256 else ">u2")
    if plain:
        body = re.sub(rb"#[^\n\r]*", b" ", data[at:])
        cells = re.findall(rb"[01]", body) if kind == b"P1" else body.split()
        out = np.array([int(x) for x in cells[:n]], dtype)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, offset=at + 1)[: height * ((width + 7) // 8)]
        if len(rows) < height * ((width + 7) // 8):
            raise MediaError("too few samples")
        return np.unpackbits(rows.reshape(height, -1), axis=1)[:, :width]
    else:
        out = np.frombuffer(data, dtype, offset=at + 1)[:n] if len(data) > at + 1 else np.zeros(0, dtype)
    if len(out) < n:
        raise MediaError("too few samples")
    out = out.astype(dtype.newbyteorder("="), copy=False)
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def netpbm_bytes(image: np.ndarray) -> bytes:
    """Binary greymap or pixmap of 8-bit samples."""
    height, width = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits a pixel, with bit-field masks too; grey palettes give height x width, others x 3 (RGB)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not a BMP file")
    start, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    used = struct.unpack_from("<I", data, 46)[0]
    flip, height = height > 0, abs(height)
    if packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or (packing == 3 and bits not in (16, 32)):
        raise MediaError("unsupported BMP")
    stride = (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, offset=start)[: stride * height]
    if len(raw) < stride * height:
        raise MediaError("too few samples")
    rows = raw.reshape(height, stride)[:: -1 if flip else 1]
    if bits == 16 or packing == 3:
        cells = np.ascontiguousarray(rows[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
        return np.stack([_masked(cells, m) for m in masks], axis=2)
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1])
    if bits < 8:
        cells = np.unpackbits(rows, axis=1)
        cells = cells if bits == 1 else np.packbits(cells.reshape(height, -1, 4), axis=2, bitorder="big")[:, :, 0] >> 4
        rows = cells
    index = rows[:, :width]
    table = np.frombuffer(data, np.uint8, count=4 * (used or 1 << bits), offset=14 + size).reshape(-1, 4)[:, 2::-1]
    if len(table) <= int(index.max(initial=0)):
        raise MediaError("a palette index beyond the palette")
    if (table == table[:, :1]).all():
        return np.ascontiguousarray(table[:, 0])[index]
    return table[index]


def _masked(cells: np.ndarray, mask: int) -> np.ndarray:
    """A colour's bits as 0 to 255."""
    if not mask:
        return np.zeros(cells.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    return np.rint(((cells & np.uint32(mask)) >> np.uint32(low)) * (255.0 / (mask >> low))).astype(np.uint8)


def bmp_bytes(image: np.ndarray) -> bytes:
    """8-bit grey or 24-bit colour BMP, rows bottom-up."""
    height, width = image.shape[:2]
    bits = 24 if image.ndim == 3 else 8
    stride = (width * bits + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * bits // 8] = (image[:, :, ::-1] if bits == 24 else image).reshape(height, -1)
    table = b"" if bits == 24 else b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(table)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, width, height, 1, bits, 0, rows.size, 2835, 2835, len(table) // 4, 0)
    return head + table + rows[::-1].tobytes()


def decode_image(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


def integral_image(image: np.ndarray) -> np.ndarray:
    """s[y, x] = sum of image[:y, :x]."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    np.cumsum(image, axis=1, dtype=np.int64, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], axis=0, out=out[1:, 1:])
    return out


def _at_edges(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of the integral image at fractional heights."""
    low = np.minimum(edges.astype(np.int64), sums.shape[0] - 2)
    part = (edges - low)[:, None]
    return sums[low] * (1 - part) + sums[low + 1] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the samples that each target cell covers, fractions of samples counted by their area."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, k], height, width) for k in range(image.shape[2])], axis=2)
    h, w = image.shape
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    corners = _at_edges(_at_edges(integral_image(image), ys).T, xs).T
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8 x 9 reduction is darker than its right neighbour."""
    grey = image if image.ndim == 2 else image.mean(axis=2)
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def npy_array(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def tiles(image: np.ndarray, height: int, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, part) of a grid; parts at the right and lower edge may be smaller."""
    for y in range(0, image.shape[0], height):
        for x in range(0, image.shape[1], width):
            yield y // height, x // width, image[y : y + height, x : x + width]


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of ROW_SAMPLES."""
    return text + bytes(-len(text) % ROW_SAMPLES or (0 if text else ROW_SAMPLES))


def stored_tiles(image: np.ndarray, rows: int) -> bytes:
    """The image's NPY tiles of `rows` rows, one after another."""
    return b"".join(npy_bytes(part) for _, _, part in tiles(image, rows, image.shape[1]))


def image_of_tiles(stored: bytes) -> np.ndarray:
    """Such tiles read back and put together."""
    source, parts = io.BytesIO(stored), []
    while source.tell() < len(stored):
        parts.append(np.lib.format.read_array(source, allow_pickle=False))
    return np.concatenate(parts)


#: Rows of a payload image's tile.
TILE_ROWS = 1024
MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as an 8-bit image, stored as NPY tiles, read back, with its digests and difference hash.

    One row for each input row, repeated rows included; a null or empty text is one row of 64 zero samples. Equal
    texts give equal values. Nothing is shuffled; a task holds one Arrow batch and one image.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        flat, offs = flat_utf8(batch.column(1))
        out: dict[str, list] = {name.split()[0]: [] for name in MEDIA_SCHEMA.split(", ")[1:]}
        whole = flat.tobytes()
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            payload = payload_of(whole[a:b])
            image = decode_image(netpbm_bytes(np.frombuffer(payload, np.uint8).reshape(-1, ROW_SAMPLES)))
            stored = stored_tiles(image, TILE_ROWS)
            back = image_of_tiles(stored)
            samples = back.tobytes()
            out["n_bytes"].append(b - a)
            out["payload_bytes"].append(len(samples))
            out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            out["tail_crc32"].append(zlib.crc32(samples[-64:]))
            out["media_bytes"].append(len(stored))
            out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
            out["feature"].append(difference_hash(back))
            out["n_tiles"].append(-(-len(back) // TILE_ROWS))
        yield {"doc_id": batch.column(0), **out}

    return map_batches(keyed_text(df, id_col, text_col), run, MEDIA_SCHEMA)


TILE_SCHEMA = "media_id long, tile_row int, tile_col int, height int, width int, dhash string, npy binary, error string"


def media_tiles(df: DataFrame, id_col: str, data_col: str, tile: int = 256, resize: tuple[int, int] | None = None) -> DataFrame:
    """NPY tiles with difference hashes of a binary column of Netpbm or BMP files, resized first if asked for.

    A row for each tile; one row with `error` and no tile for null or broken data.
    """
    from pyspark.sql import functions as F

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        names = [x.split()[0] for x in TILE_SCHEMA.split(", ")]
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            try:
                if data is None:
                    raise MediaError("no data")
                image = decode_image(data)
                if resize:
                    image = np.clip(np.rint(area_resize(image, *resize)), 0, np.iinfo(image.dtype).max).astype(image.dtype)
                rows += [(key, y, x, *part.shape[:2], difference_hash(part), npy_bytes(part), None) for y, x, part in tiles(image, tile, tile)]
            except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as e:  # MediaError too
                rows = [(key, None, None, None, None, None, None, str(e))]
            if rows:
                yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(df.select(F.col(f"`{id_col}`").cast("long").alias("media_id"), F.col(f"`{data_col}`").cast("binary").alias("data")), run, TILE_SCHEMA)
