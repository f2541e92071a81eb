"""Media columns: texts as PNG images in binary columns, read back under checksum tests, and hashed.

`encode` writes 8-bit grey PNG (one byte a sample, 64 samples a row) through zlib; `decode` tests the
CRC of every chunk and zlib's own Adler sum and undoes all five PNG row filters with numpy. `feature`
is a low-frequency cosine-transform hash: the signs of 8x8 low-frequency coefficients against their
median. Its cosines are whole numbers, so sums are exact and equal texts have equal hashes anywhere.

Defined results: a null text counts as empty; an empty text is one row of 64 zero bytes. Repeated rows
each get their own equal result. An empty table gives an empty result. Only the key and text columns
are read, so further columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from codeloom.llm.common import saved, table
from codeloom.llm.words import utf8

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + bytes(-len(raw) % unit if raw else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """PNG of the payload, whose length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    # the filter whose residues, as signed bytes, are smallest in sum
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    above = rows.copy()
    above[1:] -= rows[:-1]
    cost = [int(np.minimum(x, np.negative(x)).sum(dtype=np.int64)) for x in (rows, left, above)]
    kind = int(np.argmin(cost))
    lines = np.empty((rows.shape[0], width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = (rows, left, above)[kind]
    head = struct.pack(">IIBBBBB", width, rows.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, bpp: int = 1) -> np.ndarray:
    """Samples of filtered PNG rows (first byte of each: its filter)."""
    kinds, data = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown PNG filter")
    if not kinds.any():
        return data
    at, n = 0, len(data)
    while at < n:
        kind, stop = kinds[at], at + 1
        if kind in (0, 1, 2):  # runs of these go together
            while stop < n and kinds[stop] == kind:
                stop += 1
        part = data[at:stop]
        if kind == 1:
            for k in range(bpp):
                part[:, k::bpp] = np.cumsum(part[:, k::bpp], axis=1, dtype=np.uint8)
        elif kind == 2:
            if at:
                part[0] += data[at - 1]
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (3, 4):
            up = data[at - 1].astype(int).tolist() if at else [0] * data.shape[1]
            row = part[0].tolist()
            for i in range(len(row)):
                a, b = (row[i - bpp] if i >= bpp else 0), up[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = up[i - bpp] if i >= bpp else 0
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i] = (row[i] + guess) & 255
            part[0] = row
        at = stop
    return data


def decode(png: bytes) -> np.ndarray:
    """Rows of samples; ValueError where a checksum or the structure is wrong."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("cut chunk")
        (size,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(body) < size or png[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"wrong checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey, plain PNG")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    width, height = head[:2]
    if len(raw) != (width + 1) * height:
        raise ValueError("wrong image size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _cosines(n: int, k: int = 8, scale: int = 4096) -> np.ndarray:
    i = np.arange(n)
    return np.rint(scale * np.cos(np.pi * (2 * i[None, :] + 1) * np.arange(k)[:, None] / (2 * n)))


_BY_WIDTH = _cosines(WIDTH)


def feature(image: np.ndarray) -> str:
    """16 hexadecimal digits: bit (u, v) tells whether that coefficient is above the median of all but the mean's."""
    by_row = _cosines(image.shape[0]) @ image.astype(np.float64)  # whole numbers below 2^53: exact
    by_width = _BY_WIDTH if image.shape[1] == WIDTH else _cosines(image.shape[1])
    c = (by_row.astype(np.int64) @ by_width.T.astype(np.int64)).ravel()
    bits = c > int(np.sort(c[1:])[31])
    return np.packbits(bits).tobytes().hex()


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and the text's PNG in the binary column `media`. One pass; a worker holds one batch."""
    import pyarrow as pa

    frame = docs.select(key, text)
    kind = frame.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], names=[key, "n_bytes", "media"])

    return frame.mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def describe(stored: DataFrame, key: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """key and COLUMNS of what store() made, all but n_bytes from the bytes in `media`, which keep_media passes on."""
    import pyarrow as pa

    frame = stored.select(key, "n_bytes", "media")
    kind = frame.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def one(png: bytes) -> tuple:
        image = decode(png)
        back = image.tobytes()
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(png), hashlib.sha256(png).hexdigest(), feature(image)

    def run(batches):
        for b in batches:
            done = [one(x) for x in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1)] + [pa.array([d[i] for d in done], pa.string() if n.endswith(("sha256", "feature")) else pa.int64()) for i, n in enumerate(names[1:])]
            yield pa.RecordBatch.from_arrays(columns + [b.column(2)] * keep_media, names=[key, *names, *["media"] * keep_media])

    return frame.mapInArrow(run, f"`{key}` {kind}, {COLUMNS}" + ", media binary" * keep_media)


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """key, the columns of COLUMNS as read back from the stored table, and (keep_media) the PNG itself as `media`.

    The binary column is written to the shared folder and read again; no shuffle.
    """
    return describe(saved(store(docs, key, text), "media"), key, keep_media)


def op5_media_columns(spark, sf_dir):
    return media_columns(table(spark, sf_dir, "documents"), keep_media=False)
