"""Binary media columns: PNG images written and read chunk by chunk, and low-frequency cosine hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialize, text_bytes

WIDTH = 576
_HEAD = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """The rows' bytes after PNG filter `kind` for one byte a pixel."""
    x = rows.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    guess = [0, left, up, (left + up) // 2, _paeth(left, up, corner)][kind]
    return ((x - guess) & 255).astype(np.uint8)


def _paeth(left, up, corner):
    p = left + up - corner
    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def choose_filters(pixels: np.ndarray) -> np.ndarray:
    """For each row none, left or up (0, 1, 2), whichever gives the least sum of differences taken as signed bytes; ties go to the first."""
    x = pixels.astype(np.int16)
    left, up = x.copy(), x.copy()
    left[:, 1:] -= x[:, :-1]
    up[1:] -= x[:-1]
    # a filter must quarter the sum to be worth the repeated strings that text loses by it; padded rows pass that
    sums = np.stack([np.abs(x).sum(1), 4 * np.abs(left.astype(np.int8).astype(np.int16)).sum(1), 4 * np.abs(up.astype(np.int8).astype(np.int16)).sum(1)])
    return sums.argmin(0).astype(np.uint8)


def encode_png(pixels: np.ndarray, kinds: int | np.ndarray | None = None, level: int = 6) -> bytes:
    """An 8-bit grey PNG of a (height, width) byte array; `kinds` is the filter of each row, or of all, chosen if not given."""
    height, width = pixels.shape
    body = np.empty((height, width + 1), np.uint8)
    body[:, 0] = choose_filters(pixels) if kinds is None else kinds
    body[:, 1:] = pixels
    for kind in np.unique(body[:, 0]).tolist():
        if kind:
            at = body[:, 0] == kind
            body[at, 1:] = _filtered(pixels, kind)[at]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _HEAD + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows' bytes before their filters. Rows of filters 0 to 2 are undone whole; where a row needs its own left
    neighbours and those above (3, 4), diagonals are, all of whose bytes depend on earlier diagonals only."""
    height, width = rows.shape
    out = rows.copy()
    if kinds.max(initial=0) < 3:
        out[kinds == 1] = np.cumsum(out[kinds == 1], axis=1, dtype=np.uint8)
        for y in np.flatnonzero(kinds == 2):
            if y:
                out[y] += out[y - 1]
        return out
    x = np.zeros((height + 1, width + 1), np.int16)
    x[1:, 1:] = out
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        at = d - y
        left, up, corner = x[y + 1, at], x[y, at + 1], x[y, at]
        guess = np.choose(kinds[y], [np.zeros_like(left), left, up, (left + up) // 2, _paeth(left, up, corner)])
        x[y + 1, at + 1] = (x[y + 1, at + 1] + guess) & 255
    return x[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """The (height, width) bytes of an 8-bit grey PNG without interlacing. ValueError on damage: each chunk's checksum is tested."""
    if data[:8] != _HEAD:
        raise ValueError("not a PNG")
    at, head, packed, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        crc = data[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit grey PNG")
    width, height = head[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError("damaged image data") from e
    if len(raw) != height * (width + 1):
        raise ValueError("image data of a wrong size")
    rows = raw.reshape(height, width + 1)
    if rows[:, 0].max(initial=0) > 4:
        raise ValueError("unknown filter")
    return unfilter(rows[:, 0], rows[:, 1:])


_N = 32
_COSINES = np.cos(np.pi / _N * (np.arange(_N) + 0.5) * np.arange(8)[:, None])


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: the 8 x 8 lowest cosine coefficients of the image averaged to 32 x 32, against their median."""
    small = pixels.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        if n >= _N:
            edges = np.arange(_N) * n // _N
            size = np.diff(edges, append=n)
            small = np.add.reduceat(small, edges, axis=axis) / (size[:, None] if axis == 0 else size)
        else:
            small = small.take(np.arange(_N) * n // _N, axis=axis)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A stored table (id, n_bytes, media): each text's UTF-8 bytes, padded with 255 to a positive multiple of `width`, as PNG.

    Null texts count as empty: one row of padding. Equal texts give equal images. Rows with null or repeated ids are images
    of their own; other columns are not read; texts of any length are stored whole, an empty table gives an empty one."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for body in text_bytes(batch.column(1)):
                sizes.append(len(body))
                full = max(1, -(-len(body) // width)) * width
                media.append(encode_png(np.frombuffer(body + b"\xff" * (full - len(body)), np.uint8).reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "id long, n_bytes long, media binary"), "media")


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload, feature, error) of a media table: bytes read back and their cosine hash.

    A null or damaged image gives null payload and feature and says why in `error`; other rows have a null there."""
    bounded_batches(media.sparkSession)

    def run(batches):
        for batch in batches:
            payload, feature, error = [], [], []
            for data in batch.column(2).to_pylist():
                try:
                    pixels = decode_png(data or b"")
                    payload.append(pixels.tobytes()), feature.append(cosine_hash(pixels)), error.append(None)
                except ValueError as e:
                    payload.append(None), feature.append(None), error.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(payload, pa.binary()), pa.array(feature, pa.string()), pa.array(error, pa.string())], [id_col, "n_bytes", "media", "payload", "feature", "error"])

    kind = f"{id_col} long, n_bytes long, media binary, payload binary, feature string, error string"
    return media.select("id", "n_bytes", "media").mapInArrow(run, kind)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of read_media's result."""
    size = F.octet_length("payload").cast("long")
    return found.select(
        id_col,
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
