"""CIECAM02 as vectorised numpy, for pandas UDFs, with repair of colours that leave the gamut.

Adopted white D50, luminance adapting field 4 cd/m2, background 20, average surround;
channels are sRGB in [0, 1].
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.colour import FROM_XYZ, TO_XYZ, WHITE
from tessera.functions.minimise import brent_rows, multi_start

# Fixed values of the model.
CAT02 = np.array([[0.7328, 0.4296, -0.1624], [-0.7036, 1.6975, 0.0061], [0.0030, 0.0136, 0.9834]])
HPE = np.array([[0.38971, 0.68898, -0.07868], [-0.22981, 1.18340, 0.04641], [0.0, 0.0, 1.0]])
SURROUND_F, SURROUND_C, SURROUND_NC = 1.0, 0.69, 1.0
ADAPTING, BACKGROUND = 4.0, 20.0

_white = np.array(WHITE) * 100
_k = 1 / (5 * ADAPTING + 1)
_FL = 0.2 * _k**4 * 5 * ADAPTING + 0.1 * (1 - _k**4) ** 2 * np.cbrt(5 * ADAPTING)
_n = BACKGROUND / _white[1]
_NBB = 0.725 * (1 / _n) ** 0.2
_Z = 1.48 + np.sqrt(_n)
_D = SURROUND_F * (1 - 1 / 3.6 * np.exp((-ADAPTING - 42) / 92))
_gain = _D * _white[1] / (CAT02 @ _white) + 1 - _D
_TO_CONE = HPE @ np.linalg.inv(CAT02) @ np.diag(_gain) @ CAT02
_FROM_CONE = np.linalg.inv(_TO_CONE)


def _compress(x: np.ndarray) -> np.ndarray:
    t = (_FL * np.abs(x) / 100) ** 0.42
    return np.sign(x) * 400 * t / (t + 27.13) + 0.1


def _decompress(x: np.ndarray) -> np.ndarray:
    y = x - 0.1
    a = np.minimum(np.abs(y), 399.9)
    return np.sign(y) * 100 / _FL * (27.13 * a / (400 - a)) ** (1 / 0.42)


def _achromatic(cone: np.ndarray) -> np.ndarray:
    return (2 * cone[0] + cone[1] + cone[2] / 20 - 0.305) * _NBB


_AW = _achromatic(_compress(_TO_CONE @ _white))


def _linear(c: np.ndarray) -> np.ndarray:
    return np.where(c <= 0.04045, c / 12.92, ((np.maximum(c, 0) + 0.055) / 1.055) ** 2.4)


def _gamma(c: np.ndarray) -> np.ndarray:
    return np.where(c <= 0.0031308, 12.92 * c, 1.055 * np.maximum(c, 0.0) ** (1 / 2.4) - 0.055)


def to_jch(rgb: np.ndarray) -> np.ndarray:
    """Lightness J, chroma C and hue h in degrees of sRGB rows (3, n)."""
    r, g, b = _compress(_TO_CONE @ (np.array(TO_XYZ) @ _linear(rgb)) * 100)
    ca, cb = r - 12 * g / 11 + b / 11, (r + g - 2 * b) / 9
    h = np.degrees(np.arctan2(cb, ca)) % 360
    e = (np.cos(np.radians(h) + 2) + 3.8) / 4
    lightness = 100 * np.maximum(_achromatic((r, g, b)) / _AW, 0) ** (SURROUND_C * _Z)
    t = 50_000 / 13 * SURROUND_NC * _NBB * e * np.hypot(ca, cb) / (r + g + 21 * b / 20)
    chroma = t**0.9 * np.sqrt(lightness / 100) * (1.64 - 0.29**_n) ** 0.73
    return np.array([lightness, chroma, h])


def _unclipped(jch: np.ndarray) -> np.ndarray:
    lightness, chroma, h = jch
    safe = np.maximum(lightness, 1e-9)
    t = (np.maximum(chroma, 0) / (np.sqrt(safe / 100) * (1.64 - 0.29**_n) ** 0.73)) ** (1 / 0.9)
    hr = np.radians(h)
    e = (np.cos(hr + 2) + 3.8) / 4
    p2 = _AW * (safe / 100) ** (1 / (SURROUND_C * _Z)) / _NBB + 0.305
    # gamma in front of cos and sin of the hue, from t and the sums of the opponent signals
    top = 50_000 / 13 * SURROUND_NC * _NBB * e
    size = np.where(t > 0, 23 * p2 * t / (23 * top + 11 * t * np.cos(hr) + 108 * t * np.sin(hr)), 0.0)
    a, b = size * np.cos(hr), size * np.sin(hr)
    cone = np.array([460 * p2 + 451 * a + 288 * b, 460 * p2 - 891 * a - 261 * b, 460 * p2 - 220 * a - 6300 * b]) / 1403
    return np.where(lightness > 0, _gamma(np.array(FROM_XYZ) @ (_FROM_CONE @ _decompress(cone)) / 100), 0.0)


def _outside(rgb: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(-rgb, rgb - 1), 0).max(axis=0)


def from_jch(jch: np.ndarray, tolerance: float = 1e-3) -> np.ndarray:
    """sRGB in [0, 1]; colours outside lose chroma until they fit, or, where that fails, lightness too."""
    rgb = _unclipped(jch)
    bad = np.nonzero(~(_outside(rgb) <= tolerance))[0]
    if len(bad):
        rgb[:, bad] = repair(jch[:, bad], tolerance)
    return np.clip(np.nan_to_num(rgb), 0, 1)


def repair(jch: np.ndarray, tolerance: float = 1e-3) -> np.ndarray:
    """The displayable colours nearest in chroma, at the same hues; rows (3, n)."""
    at = lambda j, c, h: np.nan_to_num(_unclipped(np.array([j, c, h])), nan=9.0)
    cost = lambda i, c: 1e3 * _outside(at(jch[0, i], c, jch[2, i])) + np.abs(c - jch[1, i]) / 100
    chroma = brent_rows(cost, np.zeros(jch.shape[1]), np.maximum(jch[1], 1e-6))
    rgb = at(jch[0], chroma, jch[2])
    for i in np.nonzero(~(_outside(rgb) <= tolerance))[0]:
        rgb[:, i] = _repair_both(jch[:, i], chroma[i])
    return rgb


def _repair_both(jch: np.ndarray, chroma: float) -> np.ndarray:
    """The displayable colour nearest in lightness and chroma, where less chroma alone does not help."""
    at = lambda j, c: np.nan_to_num(_unclipped(np.array([[j], [c], [jch[2]]])), nan=9.0)
    miss = lambda j, c: float(_outside(at(j, c))[0])
    both = lambda p: 1e3 * miss(p[0], abs(p[1])) + abs(p[0] - jch[0]) + abs(abs(p[1]) - jch[1]) / 100
    (j, c), _ = multi_start(both, [np.array([jch[0], chroma]), np.array([50.0, chroma / 2]), np.array([min(jch[0], 100.0), 0.0])], 5.0)
    return np.clip(at(j, abs(c))[:, 0], 0, 1)


_JCH = "struct<j:double,c:double,h:double>"
_RGB = "struct<r:double,g:double,b:double>"


def jch(r: Column, g: Column, b: Column) -> Column:
    """Struct (j, c, h) of channels in [0, 1], by batches."""

    @F.pandas_udf(_JCH)
    def run(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(to_jch(np.array([r, g, b], float)).T, columns=list("jch"))

    return run(r.cast("double"), g.cast("double"), b.cast("double"))


def rgb(j: Column, c: Column, h: Column) -> Column:
    @F.pandas_udf(_RGB)
    def run(j: pd.Series, c: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(from_jch(np.array([j, c, h], float)).T, columns=list("rgb"))

    return run(j, c, h)
