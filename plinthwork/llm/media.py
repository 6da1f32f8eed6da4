"""Media in binary columns: lossless PNG by zlib chunks, and low-frequency cosine-transform hashes.

The writer makes 8-bit PNG files with a filter chosen for each row; the reader checks the signature, every
chunk's checksum, the header and the size of the inflated data before it undoes the filters with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # by colour type: grey, RGB, grey and alpha, RGB and alpha
WIDTH, GRID, LOW = 64, 32, 8


class MediaError(ValueError):
    """Bytes that are no PNG file this reader takes, with the reason."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _shifted(rows: np.ndarray, bpp: int):
    """Each byte's neighbours: left, above, and above left."""
    left, up, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, bpp:] = rows[:, :-bpp]
    up[1:] = rows[:-1]
    corner[1:, bpp:] = rows[:-1, :-bpp]
    return left, up, corner


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """PNG of 8-bit samples, (height, width) or (height, width, channels); each row takes the filter of none,
    left and above whose signed sum is least."""
    if samples.ndim == 2:
        samples = samples[:, :, None]
    height, width, n = samples.shape
    colour = {v: k for k, v in CHANNELS.items()}[n]
    rows = np.ascontiguousarray(samples, np.uint8).reshape(height, width * n)
    left, up, _ = _shifted(rows, n)
    tried = (rows, rows - left, rows - up)
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in tried]
    pick = np.argmin(np.stack(cost), axis=0)
    body = np.empty((height, width * n + 1), np.uint8)
    body[:, 0] = pick
    for k, x in enumerate(tried):
        body[pick == k, 1:] = x[pick == k]
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """8-bit samples (height, width, channels) of a PNG file; MediaError where it is not sound."""
    if not data.startswith(SIGNATURE):
        raise MediaError("signature")
    at, head, parts, ended = len(SIGNATURE), None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise MediaError("truncated chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + size > len(data):
            raise MediaError("truncated chunk")
        body = data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError("chunk checksum")
        if kind == b"IHDR":
            if size != 13:
                raise MediaError("header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise MediaError("critical chunk")
        at += 12 + size
    if head is None or not ended:
        raise MediaError("missing chunk")
    width, height, depth, colour, packing, filtering, interlace = head
    if depth != 8 or colour not in CHANNELS or packing or filtering or interlace or not width or not height:
        raise MediaError("kind of image")
    n = CHANNELS[colour]
    stride = width * n + 1
    try:
        inflater = zlib.decompressobj()
        raw = inflater.decompress(b"".join(parts), height * stride + 1)
    except zlib.error:
        raise MediaError("compressed data") from None
    if len(raw) != height * stride or not inflater.eof:
        raise MediaError("size of data")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, stride), n).reshape(height, width, n)


def _unfilter(body: np.ndarray, bpp: int) -> np.ndarray:
    kinds, rows = body[:, 0], body[:, 1:].copy()
    if kinds.max() > 4:
        raise MediaError("filter")
    height, stride = rows.shape
    sides = np.flatnonzero(kinds == 1)
    if len(sides):  # rows that look left only are independent of each other
        rows[sides] = np.cumsum(rows[sides].reshape(len(sides), -1, bpp), axis=1, dtype=np.uint8).reshape(len(sides), stride)
    begins = np.flatnonzero((kinds >= 2) & (np.concatenate(([0], kinds[:-1])) != kinds) | (kinds >= 3))
    for y in begins.tolist():
        above = rows[y - 1] if y else np.zeros(stride, np.uint8)
        if kinds[y] == 2:  # a run of rows that look up is one running sum
            stop = y + 1
            while stop < height and kinds[stop] == 2:
                stop += 1
            rows[y:stop] = np.cumsum(rows[y:stop], axis=0, dtype=np.uint8) + above
            continue
        row, up = rows[y].tolist(), above.tolist()
        for x in range(stride):
            a = row[x - bpp] if x >= bpp else 0
            if kinds[y] == 3:
                row[x] = (row[x] + (a + up[x]) // 2) & 255
                continue
            b, c = up[x], up[x - bpp] if x >= bpp else 0
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            row[x] = (row[x] + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
        rows[y] = row
    return rows


_COSINES = np.cos(np.pi / GRID * np.outer(np.arange(LOW), np.arange(GRID) + 0.5))


def _cells(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last sample of each of GRID cells over n samples; no cell is empty."""
    first = np.arange(GRID) * n // GRID
    return first, np.maximum(first + 1, (np.arange(GRID) + 1) * n // GRID)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: signs of the low frequencies of the image's means over a grid, against their median."""
    grey = samples.reshape(*samples.shape[:2], -1)[:, :, :3].mean(axis=2) if samples.ndim == 3 and samples.shape[2] > 2 else samples.reshape(*samples.shape[:2], -1)[:, :, 0]
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    (y0, y1), (x0, x1) = _cells(grey.shape[0]), _cells(grey.shape[1])
    sums = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    low = _COSINES @ (sums / np.outer(y1 - y0, x1 - x0)) @ _COSINES.T
    values = np.round(low.ravel(), 6)
    return np.packbits(values > np.median(values[1:])).tobytes().hex()


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of the image's width."""
    body = text or b""
    return body + bytes(-len(body) % WIDTH if body else WIDTH)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *keep, n_bytes, media``: each text as the samples of a grey PNG 64 wide; a null text is empty."""

    def run(batches):
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            media = [encode_png(np.frombuffer(payload_of(b), np.uint8).reshape(-1, WIDTH)) for b in bodies]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(b or b"") for b in bodies], pa.int64()), pa.array(media, pa.binary())], [*batch.schema.names[1:], "n_bytes", "media"])

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (doc_id, *keep)]
    return docs.select(F.col(text).cast("binary").alias("__body"), doc_id, *keep).mapInArrow(run, ", ".join([*kept, "n_bytes bigint, media binary"]))


READ = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int, channels int, error string"


def read_media(images: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` columns and what was read of each image: its samples' size and digests, hash, shape.

    Bytes that are no sound PNG, and null ones, give nulls and the reason in ``error``.
    """
    names = [x.split()[0] for x in READ.split(", ")]

    def look(data):
        if data is None:
            return dict.fromkeys(names) | {"error": "null"}
        seen = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            samples = decode_png(data)
        except MediaError as e:
            return dict.fromkeys(names) | seen | {"error": str(e)}
        raw = samples.tobytes()
        return seen | {"payload_bytes": len(raw), "payload_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-64:]), "feature": cosine_hash(samples), "height": samples.shape[0], "width": samples.shape[1], "channels": samples.shape[2], "error": None}

    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            seen = [look(d.as_py()) for d in batch.column(0)]
            cols = [pa.array([s[n] for s in seen], kinds[x.split()[1]]) for n, x in zip(names, READ.split(", "))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], *names])

    kept = [f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep]
    return images.select(F.col(media).alias("__media"), *keep).mapInArrow(run, ", ".join([*kept, READ]))
