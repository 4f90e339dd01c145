"""Channels as fixed-point planes of a blending space, into pyramids and back.

A pixel type has a number of integer bits, among them the headroom that differences need, and of fraction bits.
``identity`` keeps the channels, gray or colour. ``lab`` and ``luv`` scale lightness and shifted chroma to whole
numbers first, ``jch`` stores lightness and chroma as a vector of its hue. On the way back colours outside the
gamut lose chroma at their hue and lightness until they fit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import appearance, colour
from tessera.functions.scalar import from_fixed, half_away, half_up, to_fixed

Planes = tuple[Column, ...]

# Integer and fraction bits of the pyramids of each pixel type.
BITS = {"uint8": (9, 7), "uint16": (17, 7), "uint32": (33, 23)}
SPACES = ("identity", "lab", "luv", "jch")
#: Halvings of the chroma's share that fits.
REPAIR_STEPS = 12
#: How far outside a channel may be, as a share of its range, without repair.
TOLERANCE = 1e-3


def bits(kind: str) -> tuple[int, int]:
    if kind not in BITS:
        raise ValueError(f"unknown pixel type {kind!r}; known: {', '.join(BITS)}")
    return BITS[kind]


def top(kind: str) -> int:
    """The largest value of a channel."""
    bits(kind)
    return (1 << int(kind.removeprefix("uint"))) - 1


def _check(channels: Planes, space: str) -> None:
    if space not in SPACES:
        raise ValueError(f"unknown blending space {space!r}; known: {', '.join(SPACES)}")
    if space != "identity" and len(channels) != 3:
        raise ValueError("gray images have no blending space")


def into(channels: Planes, space: str = "identity", kind: str = "uint8") -> Planes:
    """Fixed-point planes of whole channels."""
    _check(channels, space)
    whole, fraction = bits(kind)
    most = top(kind)
    if space == "identity":
        return tuple(to_fixed(c, fraction) for c in channels)
    if space == "jch":
        jch = appearance.jch(*(c / most for c in channels))
        scale, hue = float(1 << (whole - 8)), F.radians(jch["h"])
        return tuple(to_fixed(v * scale, fraction) for v in (jch["j"], jch["c"] * F.sin(hue), jch["c"] * F.cos(hue)))
    convert = colour.to_lab if space == "lab" else colour.to_luv
    return tuple(to_fixed(c, fraction) for c in colour.encode_lab(convert(channels, most), whole))


def _light(c: np.ndarray) -> np.ndarray:
    return np.where(c <= 0.0031308, 12.92 * c, 1.055 * np.maximum(c, 0.0031308) ** (1 / 2.4) - 0.055)


def _lab_back(light: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    fy = (light + 16) / 116
    f = np.array([fy + a / 500, fy, fy - b / 200])
    xyz = np.where(f * f * f > colour.EPSILON, f * f * f, (116 * f - 16) / colour.KAPPA) * np.array(colour.WHITE)[:, None]
    return _light(np.array(colour.FROM_XYZ) @ xyz)


def _luv_back(light: np.ndarray, us: np.ndarray, vs: np.ndarray) -> np.ndarray:
    some = light > 0
    y = np.where(light > colour.KAPPA * colour.EPSILON, ((light + 16) / 116) ** 3, light / colour.KAPPA)
    by = np.where(some, 13 * light, 1.0)
    u, v = np.where(some, us / by, 0.0) + colour.LUV_WHITE[0], np.where(some, vs / by, 0.0) + colour.LUV_WHITE[1]
    x, z = np.where(some, y * 9 * u / (4 * v), 0.0), np.where(some, y * (12 - 3 * u - 20 * v) / (4 * v), 0.0)
    return _light(np.array(colour.FROM_XYZ) @ np.array([x, y, z]))


def fitted(light: np.ndarray, one: np.ndarray, two: np.ndarray, back: Callable[..., np.ndarray]) -> np.ndarray:
    """Channels [3, n] as shares of their range of lightness and two chroma axes; where a channel is outside, chroma shrinks, by halving the interval, until all fit."""
    rgb = back(light, one, two)
    outside = lambda c: np.maximum(-c, c - 1.0).max(axis=0) > TOLERANCE
    bad = np.nonzero(outside(rgb))[0]
    if len(bad):
        low, high = np.zeros(len(bad)), np.ones(len(bad))
        for _ in range(REPAIR_STEPS):
            middle = (low + high) / 2
            out = outside(back(light[bad], one[bad] * middle, two[bad] * middle))
            low, high = np.where(out, low, middle), np.where(out, middle, high)
        rgb[:, bad] = back(light[bad], one[bad] * low, two[bad] * low)
    return np.clip(rgb, 0.0, 1.0)


def _fit(space: str, coordinates: Planes) -> Column:
    """Struct (r, g, b) of fitted channels, by batches."""

    @F.pandas_udf("struct<r:double,g:double,b:double>")
    def run(light: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rgb = fitted(*(c.to_numpy(float) for c in (light, one, two)), _lab_back if space == "lab" else _luv_back)
        return pd.DataFrame(rgb.T, columns=list("rgb"))

    return run(*coordinates)


def out(planes: Planes, space: str = "identity", kind: str = "uint8") -> Planes:
    """Whole channels of fixed-point planes, halves up, within the type's range."""
    _check(planes, space)
    whole, fraction = bits(kind)
    most = top(kind)
    if space == "identity":
        return tuple(F.least(F.greatest(from_fixed(p, fraction), F.lit(0)), F.lit(most)).cast("long") for p in planes)
    if space == "jch":
        scale = float(1 << (whole - 8)) * (1 << fraction)
        j, x, y = (p / scale for p in planes)
        rgb = appearance.rgb(j, F.sqrt(x * x + y * y), F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0)))
        return tuple(half_up(rgb[n] * most) for n in "rgb")
    lab = colour.decode_lab(tuple(from_fixed(p, fraction) for p in planes), whole)
    rgb = _fit(space, lab)
    return tuple(half_away(rgb[n] * most) for n in "rgb")
