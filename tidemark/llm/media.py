"""Media columns: Netpbm and BMP images in a binary column, decoded to arrays, area-resized, kept as NPY tiles.

Images are encoded and decoded inside tasks over Arrow batches; the stored form is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm.common import batches_of, keep

#: Pixels in a row of a payload's image; payloads are padded to whole rows.
WIDTH = 64
#: Edge of a tile.
TILE = 16
CHUNK = 8 << 20

_HEAD = re.compile(rb"(P[2356])(?:\s+#[^\n]*\n|\s)+?\s*(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A grey 8-bit image as binary Netpbm."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """A grey 8-bit image as BMP with a grey palette, rows from bottom to top, padded to 4 bytes."""
    h, w = pixels.shape
    stride = -(-w // 4) * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, :w] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, body.size, 2835, 2835, 256, 0) + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The pixels of a Netpbm (P2, P3, P5, P6; 8 bits) or BMP image (8 or 24 bits, not compressed): rows by columns, and by 3 where it has colours."""
    if data[:2] == b"BM":
        start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        if packing or bits not in (8, 24):
            raise ValueError("only plain 8-bit and 24-bit BMP")
        stride = -(-w * bits // 32) * 4
        rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
        rows = rows[::-1] if h > 0 else rows
        if bits == 24:
            return rows.reshape(abs(h), w, 3)[:, :, ::-1]
        palette = np.frombuffer(data, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        out = palette[rows]
        return out[:, :, 0] if (palette == palette[:, :1]).all() else out
    m = _HEAD.match(data)
    if not m or int(m[4]) > 255:
        raise ValueError("neither 8-bit Netpbm nor BMP")
    w, h, deep = int(m[2]), int(m[3]), 3 if m[1] in (b"P3", b"P6") else 1
    if m[1] in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, w * h * deep, m.end())
    else:
        flat = np.array(data[m.end() :].split()[: w * h * deep], np.uint8)
    return flat.reshape((h, w, 3) if deep == 3 else (h, w))


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that the new pixels cover: the integral image, interpolated at their edges. Takes grey images."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    y, fy = edges(h, height)
    x, fx = edges(w, width)
    rows = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(grid, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each pixel of the 8 x 9 means is darker than its right neighbour."""
    small = np.round(area_resize(pixels, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(pixels: np.ndarray, edge: int = TILE) -> bytes:
    """The resized image as an NPY file of 8-bit values."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(pixels, edge, edge)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload(text: str | None) -> np.ndarray:
    """A text's UTF-8 bytes, zeros after them up to a positive number of whole rows."""
    raw = (text or "").encode()
    out = np.zeros(max(1, -(-len(raw) // WIDTH)) * WIDTH, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1, WIDTH)


def store_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every whole text as an image (id, n_bytes, media) and returns the stored table.

    Payloads with an odd checksum become BMP, others Netpbm, so equal texts have equal images. Null texts are empty.
    """
    fields = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    schema = StructType([fields.schema["id"], StructField("n_bytes", LongType()), StructField("media", BinaryType())])

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, "body", CHUNK):
                sizes, media = [], []
                for t in part.column("body").to_pylist():
                    pixels = payload(t)
                    sizes.append(len((t or "").encode()))
                    media.append(encode_bmp(pixels) if zlib.crc32(pixels) & 1 else encode_pgm(pixels))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return keep(fields.mapInArrow(run, schema), "media")


def tiles(media: DataFrame, edge: int = TILE) -> DataFrame:
    """Decodes each image of a table (id, media and any others but tile, feature and payload columns) and adds: payload (grey pixels read back) facts, tile (NPY) and feature (difference hash). Null media give nulls."""
    made = [("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("tile", BinaryType()), ("feature", StringType())]
    schema = StructType([*(f for f in media.schema.fields if f.name != "media"), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), *(StructField(n, t) for n, t in made)])
    held = [f.name for f in media.schema.fields if f.name != "media"]

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.column("media"):
                data = m.as_py()
                if data is None:
                    rows.append((None,) * 7)
                    continue
                pixels = decode(data)
                grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
                raw = pixels.tobytes()
                rows.append((len(data), hashlib.sha256(data).hexdigest(), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), tile(grey, edge), difference_hash(grey)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=[*held, "media_bytes", "media_sha256", *(n for n, _ in made)])

    return media.mapInArrow(run, schema)


def media_digest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts as images, reads them back, writes the tiles and returns the query's columns."""
    done = keep(tiles(store_texts(documents, id_col, text_col)), "tiles")
    return done.select(F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.octet_length("tile").cast("long").alias("tile_bytes"), F.sha2("tile", 256).alias("tile_sha256"))
