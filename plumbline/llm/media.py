"""Media columns: lossless images in binary columns, decoded to numpy arrays.

Netpbm (P1-P6) and uncompressed BMP (8, 24, 32 bit) are decoded; arrays are
resized by area means taken from integral images; difference hashes and NPY
tiles are made from them.  Media that is null, cut short, empty, of another
format or whose header promises more than its bytes hold has no pixels: its
digests of pixels are null and it gives no tile.
"""

from __future__ import annotations

import io
import math
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._text import slices, string_bytes

_HEAD = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """PGM (P5) of a 2-d array or PPM (P6) of a 3-channel array of 8-bit samples."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def decode_netpbm(raw: bytes) -> np.ndarray:
    """Samples as stored: (height, width) or (height, width, 3); bitmaps as 0 (black) and 1 turned to 255 for white."""
    m = _HEAD.match(raw)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, width, height = int(m[1]), int(m[2]), int(m[3])
    bitmap = kind in (1, 4)
    at = m.end(3) if bitmap else m.end()
    most = 1 if bitmap else int(m[4] or 0)
    if not 0 < most < 1 << 16:
        raise ValueError("Netpbm without a largest value")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = math.prod(shape)
    body = raw[at + 1 :]
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(body, np.uint8, height * -(-width // 8)).reshape(height, -1), axis=1)[:, :width]
        return np.where(bits, 0, 255).astype(np.uint8)
    if kind == 1:
        bits = np.array([c == 49 for c in body if c in b"01"][:n]).reshape(shape)
        return np.where(bits, 0, 255).astype(np.uint8)
    if kind in (2, 3):
        return np.array(re.sub(rb"#[^\n]*", b"", body).split()[:n], dtype=np.uint16 if most > 255 else np.uint8).reshape(shape)
    if most > 255:
        return np.frombuffer(body, ">u2", n).astype(np.uint16).reshape(shape)
    return np.frombuffer(body, np.uint8, n).reshape(shape)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed BMP: 8-bit grey with a palette, or 24-bit from (height, width, 3) RGB."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    body = pixels if grey else pixels[:, :, ::-1].reshape(h, 3 * w)
    row = body.shape[1]
    padded = np.zeros((h, -(-row // 4) * 4), np.uint8)
    padded[:, :row] = body[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    at = 54 + palette.size
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, padded.size, 2835, 2835, 256 if grey else 0, 0)
    return struct.pack("<2sIHHI", b"BM", at + padded.size, 0, 0, at) + info + palette.tobytes() + padded.tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """(height, width) where the palette is grey, else (height, width, 3) RGB; alpha is dropped."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP image")
    at = struct.unpack_from("<I", raw, 10)[0]
    size, w, h, _, bits, method = struct.unpack_from("<IiiHHI", raw, 14)
    if method not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and method {method} isn't supported")
    rows = abs(h)
    stride = -(-w * bits // 32) * 4
    body = np.frombuffer(raw, np.uint8, rows * stride, at).reshape(rows, stride)
    if h > 0:
        body = body[::-1]
    if bits == 8:
        n = struct.unpack_from("<I", raw, 46)[0] or 256
        palette = np.frombuffer(raw, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        out = palette[body[:, :w]]
        return out[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else out
    return body[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]


def decode(raw: bytes) -> np.ndarray:
    """Pixels of an image; ValueError where it has none."""
    try:
        pixels = decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)
    except (struct.error, OverflowError, IndexError) as e:
        raise ValueError(f"not a whole image: {e}") from e
    if not pixels.size:
        raise ValueError("an image without pixels")
    return pixels


def decoded(raw: bytes | None) -> np.ndarray | None:
    """Pixels of an image, or None where it has none."""
    try:
        return decode(raw) if raw is not None else None
    except ValueError:
        return None


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each target sample covers, from an integral image; edges count by their share."""

    def along(sums: np.ndarray, n: int, axis: int) -> np.ndarray:
        size = sums.shape[axis] - 1
        edges = np.arange(n + 1) * size / n
        low = np.minimum(edges.astype(np.int64), size - 1)
        share = (edges - low).reshape([-1 if a == axis else 1 for a in range(sums.ndim)])
        at = np.take(sums, low, axis) * (1 - share) + np.take(sums, low + 1, axis) * share
        return np.diff(at, axis=axis) * (n / size)

    if pixels.ndim == 3:
        return np.stack([area_resize(pixels[:, :, c], height, width) for c in range(pixels.shape[2])], axis=2)
    integral = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])
    return along(along(integral, height, 0), width, 1)


def difference_hash(pixels: np.ndarray, size: int = 8) -> str:
    """size*size bits as hex: is each mean of the (size, size + 1) reduction below its right neighbour's."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    small = np.round(area_resize(grey, size, size + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tiles(pixels: np.ndarray, tile: int) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY bytes) of tiles of at most tile x tile."""
    out = []
    for y in range(0, pixels.shape[0], tile):
        for x in range(0, pixels.shape[1], tile):
            f = io.BytesIO()
            np.save(f, np.ascontiguousarray(pixels[y : y + tile, x : x + tile]))
            out.append((y // tile, x // tile, f.getvalue()))
    return out


def text_media(docs: DataFrame, width: int = 64, bmp_from: int = 8192, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each whole text's UTF-8 bytes as an 8-bit grey image `width` samples wide.

    Texts of fewer than `bmp_from` bytes are PGM, longer ones BMP (whose
    palette is then small beside the samples).  Bytes 0 fill the last row; an
    empty or null text gives one row of zeros.  Adds n_bytes (without the
    filling) and media; repeated rows give equal rows, an empty table none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    frame = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    out = StructType(frame.select(*keep).schema.fields + StructType.fromDDL("n_bytes long, media binary").fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for batch in slices(batches, "__text"):
            data, offsets = string_bytes(batch.column(len(keep)))
            sizes = np.diff(offsets)
            media = []
            for a, n in zip(offsets[:-1].tolist(), sizes.tolist(), strict=True):
                pixels = np.zeros((max(1, -(-n // width)), width), np.uint8)
                pixels.reshape(-1)[:n] = data[a : a + n]
                media.append(encode_netpbm(pixels) if n < bmp_from else encode_bmp(pixels))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(sizes), pa.array(media, pa.binary())], schema=schema)

    return frame.mapInArrow(run, out)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TILES = "tiles array<struct<tile_y: int, tile_x: int, npy: binary>>"


def media_features(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes"), tail: int = 64, height: int = 16, width: int = 32, tile: int = 16) -> DataFrame:
    """Digests of the samples and of the stored bytes, the difference hash, and the NPY tiles of the image area-resized to height x width.

    One row per row of `media`, which may repeat.  Where there are no pixels,
    payload_bytes, payload_sha256, tail_crc32 and feature are null and there
    are no tiles; media_bytes and media_sha256 are null for null media only.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    frame = media.select(*keep, F.col(column).alias("__media"))
    out = StructType(frame.select(*keep).schema.fields + StructType.fromDDL(f"{FEATURES}, {TILES}").fields)

    def made(raw: bytes | None) -> tuple:
        stored = (None, None) if raw is None else (len(raw), sha256(raw).hexdigest())
        pixels = decoded(raw)
        if pixels is None:
            return None, None, None, *stored, None, []
        payload = pixels.tobytes()
        small = np.clip(np.round(area_resize(pixels, height, width)), 0, 65535).astype(pixels.dtype)
        cut = [{"tile_y": y, "tile_x": x, "npy": b} for y, x, b in npy_tiles(small, tile)]
        return len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), *stored, difference_hash(pixels), cut

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for batch in slices(batches, "__media"):
            rows = [made(raw.as_py()) for raw in batch.column(len(keep))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[len(keep) :], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], schema=schema)

    return frame.mapInArrow(run, out)


def tiles(featured: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per tile of what media_features returns: tile_y, tile_x, npy and the image's difference hash as dhash."""
    return featured.select(*keep, F.explode("tiles").alias("_tile"), F.col("feature").alias("dhash")).select(*keep, "_tile.*", "dhash")


def store_texts(docs: DataFrame, folder: str) -> None:
    """Write each whole text as an image to the table `media`, read that back, and write features and tiles to the table `features`."""
    spark = docs.sparkSession
    text_media(docs).write.option("compression", "zstd").parquet(f"{folder}/media")
    media_features(spark.read.parquet(f"{folder}/media")).write.option("compression", "zstd").parquet(f"{folder}/features")
