"""Images in files: a portable-anymap and PNG codec, a reader over binaryFile, and sinks.

Pixels go to and from the relation (image_id, x, y, v | r, g, b, a). 16-bit values
are kept, which Spark's own image source narrows.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import linear_range


def encode_pnm(pixels: np.ndarray, top: int = 255) -> bytes:
    """P5 for (h, w), P6 for (h, w, 3)."""
    kind = "P5" if pixels.ndim == 2 else "P6"
    raw = pixels.astype(">u2" if top > 255 else "u1").tobytes()
    return f"{kind}\n{pixels.shape[1]} {pixels.shape[0]}\n{top}\n".encode() + raw


def decode_pnm(data: bytes) -> tuple[np.ndarray, int]:
    m = re.match(rb"(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not m:
        raise ValueError("not a binary anymap")
    w, h, top = int(m[2]), int(m[3]), int(m[4])
    shape = (h, w) if m[1] == b"P5" else (h, w, 3)
    return np.frombuffer(data, ">u2" if top > 255 else "u1", int(np.prod(shape)), m.end()).reshape(shape).astype(np.int64), top


_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode_png(pixels: np.ndarray, top: int = 255) -> bytes:
    """Gray, gray + alpha, RGB or RGBA of 8 or 16 bits, unfiltered rows."""
    pixels = pixels[..., None] if pixels.ndim == 2 else pixels
    h, w, c = pixels.shape
    kind = {v: k for k, v in _CHANNELS.items()}[c]
    raw = pixels.astype(">u2" if top > 255 else "u1").reshape(h, -1)
    rows = b"".join(b"\0" + r.tobytes() for r in raw)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", w, h, 16 if top > 255 else 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed = 8, []
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, bits, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed.append(body)
        at += 12 + n
    if kind not in _CHANNELS or bits not in (8, 16) or interlace:
        raise ValueError("only plain 8 and 16 bit gray and RGB are read")
    c, size = _CHANNELS[kind], bits // 8
    step, line = c * size, w * c * size
    raw = zlib.decompress(b"".join(packed))
    before, rows = np.zeros(line, np.int64), []
    for y in range(h):
        mode = raw[y * (line + 1)]
        row = np.frombuffer(raw, "u1", line, y * (line + 1) + 1).astype(np.int64)
        if mode == 2:
            row = (row + before) & 255
        elif mode:
            row = row.copy()
            for i in range(line):
                a = row[i - step] if i >= step else 0
                b, d = before[i], before[i - step] if i >= step else 0
                if mode == 1:
                    p = a
                elif mode == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - d
                    p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - d), 2, d))[2]
                row[i] = (row[i] + p) & 255
        rows.append(row)
        before = row
    out = np.array(rows).astype("u1").reshape(h, -1).view(">u2" if bits == 16 else "u1").reshape(h, w, c).astype(np.int64)
    return (out[..., 0] if c == 1 else out), (1 << bits) - 1


def decode(data: bytes) -> tuple[np.ndarray, int]:
    return decode_png(data) if data[:4] == b"\x89PNG" else decode_pnm(data)


PIXELS = "file string, x long, y long, r long, g long, b long, a long, top long"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of all files that a glob names; gray images have r = g = b, images without alpha a = top."""

    def run(parts):
        for pdf in parts:
            for file, data in zip(pdf["path"], pdf["content"]):
                px, top = decode(bytes(data))
                px = px[..., None] if px.ndim == 2 else px
                h, w, c = px.shape
                y, x = np.indices((h, w))
                gray = c < 3
                channel = lambda i, px=px: px[..., i].ravel()
                alpha = channel(c - 1) if c in (2, 4) else np.full(h * w, top)
                rgb = [channel(0)] * 3 if gray else [channel(i) for i in range(3)]
                yield pd.DataFrame({"file": file, "x": x.ravel(), "y": y.ravel(), "r": rgb[0], "g": rgb[1], "b": rgb[2], "a": alpha, "top": top})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PIXELS)


def import_alpha(a: Column, top: int) -> Column:
    """Validity: alpha from half of its range up."""
    return a.between(top // 2, top)


def rescale(v: Column, top: int, new_top: int) -> Column:
    return F.floor(linear_range(v, 0, top, 0, new_top) + 0.5).cast("long")


def export_alpha(valid: Column, top: int) -> Column:
    return F.when(valid, F.lit(top)).otherwise(F.lit(0)).cast("long")


def encode_images(df: DataFrame, keys: list[str], values: list[str], top: int = 255, png: bool = True) -> DataFrame:
    """One row (keys, content) per image; places without a row are 0. A group is one image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        out = np.zeros((h, w, len(values)), np.int64)
        out[pdf["y"], pdf["x"]] = pdf[values].to_numpy()
        out = out[..., 0] if len(values) == 1 else out
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "content": [encode_png(out, top) if png else encode_pnm(out, top)]})

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", content binary")


def write_levels(levels: DataFrame, path: str) -> None:
    """A pyramid or mask relation, one folder a level."""
    levels.write.mode("overwrite").partitionBy("level").parquet(path)


def load_mask(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """A gray mask (x, y, m) from a file; its size must be the canvas's."""
    px = read_images(spark, path)
    bad = px.filter("r <> g or g <> b").limit(1).count()
    size = px.agg(F.max("x") + 1, F.max("y") + 1).first()
    if bad:
        raise ValueError("a mask must be gray")
    if tuple(size) != (width, height):
        raise ValueError(f"the mask is {size[0]}x{size[1]}, the canvas {width}x{height}")
    return px.select("x", "y", F.floor(F.col("r") * 255 / F.col("top") + 0.5).cast("long").alias("m"))
