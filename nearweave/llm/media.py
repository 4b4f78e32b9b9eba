"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

Images travel as binary columns; a stored image is decoded, resized exactly (integer arithmetic on the integral image,
so equal pixels give equal tiles everywhere) and written as an NPY tile with the 64-bit difference hash of its luma. The
integral image is summed in bands of rows, and only the rows that the target needs are held.

Texts are stored as images 64 pixels wide: as BMP where the number of rows is odd, else as PPM.

Defined results: an image that is null, without pixels or unreadable has a null size, tile and hash; a null text is stored
as the empty text; the empty text is stored as blanks; repeated rows give repeated rows; an empty table gives an empty
table; other columns are ignored.
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

from .common import doc_texts

#: Bytes of a stored row of pixels: 64 of three samples.
ROW = 192
#: Samples of a band that is summed at once.
BAND = 1 << 22
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*(\d+)")


def encode_ppm(samples: np.ndarray) -> bytes:
    """Height x width x 3 samples of 8 bits as binary PPM."""
    h, w, _ = samples.shape
    return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Height x width x 3 samples as BMP with 24 bits a pixel."""
    h, w, _ = samples.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = samples[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + rows.size, 0, 0, 54, 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, 8 or 16 bits a sample, as height x width x channels; bitmaps become 0 and 255."""
    kind, at, head = data[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm image")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if m is None or len(m[1]) > 18:
            raise ValueError("the header can't be read")
        head.append(int(m[1]))
        at = m.end()
    w, h, most = (*head, 1)[:3]
    channels = 3 if kind in (b"P3", b"P6") else 1
    row = (w + 7) // 8 if kind == b"P4" else w * channels * (2 if kind in (b"P5", b"P6") and most > 255 else 1)
    if not w or not h or not 0 < most < 65536 or h * row > len(data):  # every sample takes a byte or more in plain form, too
        raise ValueError("a size or the largest sample is out of range")
    if kind in (b"P4", b"P5", b"P6"):
        body = memoryview(data)[at + 1 :]
        if kind == b"P4":
            bits = np.unpackbits(np.frombuffer(body, np.uint8, h * row).reshape(h, row), axis=1)[:, :w]
            return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
        out = np.frombuffer(body, ">u2" if most > 255 else np.uint8, h * w * channels)
    else:
        text = re.sub(rb"#[^\r\n]*", b"", data[at:])
        values = re.findall(rb"[01]", text) if kind == b"P1" else text.split()
        out = np.array(values[: h * w * channels], dtype=np.int64)
        if len(out) and (out.min() < 0 or out.max() > most):
            raise ValueError("a sample is out of range")
        if kind == b"P1":
            return ((1 - out) * 255).astype(np.uint8).reshape(h, w, 1)
        out = out.astype(np.uint16 if most > 255 else np.uint8)
    return out.reshape(h, w, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits a pixel as height x width x 3."""
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits is read")
    stride = (w * bits // 8 + 3) // 4 * 4
    if w <= 0 or not h or start + abs(h) * stride > len(data):
        raise ValueError("a size is out of range")
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)[:, : w * bits // 8]
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)
        out = colours[rows][:, :, 2::-1]
    else:
        out = rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    return out[::-1] if h > 0 else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _between(total: np.ndarray, rows: np.ndarray, size: int, to: int) -> np.ndarray:
    """Sums between the places i * size / to of a running total along axis 0, times ``to``; ``rows`` are the total's places."""
    place = np.arange(to + 1) * size
    low, part = place // to, (place % to).reshape(-1, *[1] * (total.ndim - 1))
    lower, upper = (np.searchsorted(rows, x) for x in (low, np.minimum(low + 1, size)))
    at = total[lower] * (to - part) + total[upper] * part
    return at[1:] - at[:-1]


def _needed_rows(size: int, to: int) -> np.ndarray:
    low = np.arange(to + 1) * size // to
    return np.unique(np.concatenate([low, np.minimum(low + 1, size)]))


def area_resize(samples: np.ndarray, height: int, width: int, band: int = BAND) -> np.ndarray:
    """Mean over each target pixel's area, partly covered pixels in proportion, rounded half up; exact in integers."""
    h, w = samples.shape[:2]
    rows, step = _needed_rows(h, height), max(1, band // max(1, samples[:1].size))
    integral = np.zeros((len(rows), *samples.shape[1:]), np.int64)
    before = np.zeros(samples.shape[1:], np.int64)
    for a in range(0, h, step):
        sums = np.cumsum(samples[a : a + step], axis=0, dtype=np.int64)
        sums += before
        i, j = np.searchsorted(rows, [a, a + len(sums)], "right")
        integral[i:j] = sums[rows[i:j] - a - 1]
        before = sums[-1].copy()
    across = np.zeros((w + 1, height, *samples.shape[2:]), np.int64)
    np.cumsum(_between(integral, rows, h, height).swapaxes(0, 1), axis=0, out=across[1:])
    sums = _between(across, np.arange(w + 1), w, width).swapaxes(0, 1)
    return (2 * sums + h * w) // (2 * h * w)


def luma(samples: np.ndarray, band: int = BAND) -> np.ndarray:
    if samples.shape[2] == 1:
        return samples[:, :, 0]
    out, step = np.empty(samples.shape[:2], samples.dtype.newbyteorder("=")), max(1, band // max(1, samples[:1].size))
    for a in range(0, len(samples), step):
        out[a : a + step] = (samples[a : a + step].astype(np.int64) @ np.array([299, 587, 114])) // 1000
    return out


def difference_hash(grey: np.ndarray) -> str:
    """64 bits, each telling whether a cell of an 8 x 9 reduction is darker than its right neighbour, in hexadecimal."""
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(samples: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(area_resize(samples, side, side).astype(samples.dtype.newbyteorder("="))), allow_pickle=False)
    return out.getvalue()


def tiles(images: DataFrame, key: str = "doc_id", column: str = "image", side: int = 32) -> DataFrame:
    """key, height, width, tile (NPY bytes) and dhash of every image of a binary column; nulls where it can't be read."""

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode(data or b"")
                    rows.append((*image.shape[:2], npy_tile(image, side), difference_hash(luma(image))))
                except (ValueError, OverflowError, struct.error, IndexError):
                    rows.append((None, None, None, None))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.record_batch([batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.string())], names=["key", "height", "width", "tile", "dhash"])

    return images.select(F.col(key).cast("long").alias("key"), F.col(column).cast("binary").alias("image")).mapInArrow(run, "key long, height int, width int, tile binary, dhash string").withColumnRenamed("key", key)


def store_text(text: str | None) -> bytes:
    """The text as UTF-8, padded with blanks to full rows of 64 pixels, as a BMP (an odd number of rows) or a PPM image."""
    data = (text or "").encode()
    rows = max(1, -(-len(data) // ROW))
    return (encode_bmp if rows % 2 else encode_ppm)(np.frombuffer(data.ljust(rows * ROW), np.uint8).reshape(rows, ROW // 3, 3))


def store(docs: DataFrame) -> DataFrame:
    """doc_id and image: every whole text as a stored image."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([store_text(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "image"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, image binary")


def text_media(docs: DataFrame, side: int = 8) -> DataFrame:
    """Store each text, read the stored bytes back and describe them; tile holds NPY bytes."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string", "binary"]
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def describe(text: str | None) -> tuple:
        stored = store_text(text)
        image = decode(stored)
        payload = image.tobytes()
        return (
            len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
            len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(luma(image)), npy_tile(image, side),
        )

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(describe, batch.column(1).to_pylist()))) or [[]] * 8
            yield pa.record_batch([batch.column(0), *(pa.array(c, arrow[k]) for c, k in zip(cols, kinds[1:]))], names=names)

    return doc_texts(docs).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
