"""Colour as Column builders: gray projectors, saturation, hue, differences, and CIE spaces.

Channels are columns in [0, top]. The CIE conversions take linear light of sRGB
primaries relative to D50, the adopted white of profile connection spaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import half_away

Channels = tuple[Column, Column, Column]

# Luma weights; sRGB to XYZ (D50); D50 white; CIE epsilon and kappa.
LUMA = (0.3, 0.59, 0.11)
TO_XYZ = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))
FROM_XYZ = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
WHITE = (0.96422, 1.0, 0.82521)
EPSILON, KAPPA = 216 / 24389, 24389 / 27


def lightness_star(y: Column) -> Column:
    """CIE L* of relative luminance."""
    return F.when(y > EPSILON, 116 * F.cbrt(y) - 16).otherwise(KAPPA * y)


def linear_light(c: Column) -> Column:
    """sRGB transfer curve undone; c in [0, 1]."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def gamma(c: Column) -> Column:
    return F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def _luminance(r: Column, g: Column, b: Column) -> Column:
    x = TO_XYZ[1]
    return r * x[0] + g * x[1] + b * x[2]


def channel_mixer(wr: float, wg: float, wb: float) -> Callable[[Channels, float], Column]:
    """Weighted mean of the channels; weights are normalised and may not be negative."""
    total = wr + wg + wb
    if min(wr, wg, wb) < 0 or not total:
        raise ValueError("channel weights must not be negative, nor all zero")
    return lambda c, top: (c[0] * wr + c[1] * wg + c[2] * wb) / total


PROJECTORS: dict[str, Callable[[Channels, float], Column]] = {
    "average": lambda c, top: (c[0] + c[1] + c[2]) / 3,
    "l-star": lambda c, top: lightness_star(_luminance(*(x / top for x in c))) / 100 * top,
    "pl-star": lambda c, top: lightness_star(_luminance(*(linear_light(x / top) for x in c))) / 100 * top,
    "lightness": lambda c, top: (F.least(*c) + F.greatest(*c)) / 2,
    "value": lambda c, top: F.greatest(*c) * 1.0,
    "anti-value": lambda c, top: F.least(*c) * 1.0,
    "luminance": lambda c, top: c[0] * LUMA[0] + c[1] * LUMA[1] + c[2] * LUMA[2],
}


def projector(name: str) -> Callable[[Channels, float], Column]:
    """By name; ``channel-mixer:r:g:b`` mixes by weights."""
    if name.startswith("channel-mixer:"):
        parts = name.split(":")[1:]
        if len(parts) != 3:
            raise ValueError("channel-mixer takes three weights")
        return channel_mixer(*map(float, parts))
    try:
        return PROJECTORS[name]
    except KeyError:
        raise ValueError(f"unknown projector {name!r}; known: {', '.join(PROJECTORS)}, channel-mixer:r:g:b") from None


def saturation(c: Channels, top: float) -> Column:
    """HSL saturation in [0, 1]; grays have none."""
    hi, lo = F.greatest(*c), F.least(*c)
    total, d = hi + lo, hi - lo
    return F.when(d == 0, F.lit(0.0)).when(total <= top, d / total).otherwise(d / (2 * top - total))


def hue(c: Channels, top: float) -> Column:
    """Hue as a share of the circle times ``top``, rounded; grays get ``top``."""
    r, g, b = c
    hi, lo = F.greatest(*c), F.least(*c)
    d = hi - lo
    sixth = F.when(hi == r, (g - b) / d).when(hi == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d)
    return F.when(d == 0, F.lit(int(top)).cast("long")).otherwise(half_away(F.when(sixth < 0, sixth + 6).otherwise(sixth) / 6 * top))


def hue_luminance_difference(a: Channels, b: Channels, top: float, hue_weight: float = 1.0, luminance_weight: float = 1.0) -> Column:
    """The larger of the hue distance around the circle and the distance of whole luminances, by weights that add up to 1."""
    total = hue_weight + luminance_weight
    dh = F.abs(hue(a, top) - hue(b, top))
    around = F.when(dh > top / 2, top - dh).otherwise(dh)
    dl = F.abs(half_away(PROJECTORS["luminance"](a, top)) - half_away(PROJECTORS["luminance"](b, top)))
    return F.greatest(around * (hue_weight / total), dl * (luminance_weight / total))


def _f(t: Column) -> Column:
    return F.when(t > EPSILON, F.cbrt(t)).otherwise((KAPPA * t + 16) / 116)


def _f_inverse(t: Column) -> Column:
    return F.when(t * t * t > EPSILON, t * t * t).otherwise((116 * t - 16) / KAPPA)


def _times(m: tuple, c: Channels) -> Channels:
    return tuple(row[0] * c[0] + row[1] * c[1] + row[2] * c[2] for row in m)


def to_lab(c: Channels, top: float) -> Channels:
    x, y, z = _times(TO_XYZ, tuple(linear_light(v / top) for v in c))
    fx, fy, fz = _f(x / WHITE[0]), _f(y / WHITE[1]), _f(z / WHITE[2])
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def from_lab(lab: Channels, top: float) -> Channels:
    fy = (lab[0] + 16) / 116
    fx, fz = fy + lab[1] / 500, fy - lab[2] / 200
    xyz = (_f_inverse(fx) * WHITE[0], _f_inverse(fy) * WHITE[1], _f_inverse(fz) * WHITE[2])
    return tuple(gamma(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))) * top for v in _times(FROM_XYZ, xyz))


_WHITE_SUM = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
LUV_WHITE = _U0, _V0 = 4 * WHITE[0] / _WHITE_SUM, 9 * WHITE[1] / _WHITE_SUM


def to_luv(c: Channels, top: float) -> Channels:
    x, y, z = _times(TO_XYZ, tuple(linear_light(v / top) for v in c))
    total = x + 15 * y + 3 * z
    lum = lightness_star(y)
    u = F.when(total > 0, 4 * x / total).otherwise(F.lit(_U0))
    v = F.when(total > 0, 9 * y / total).otherwise(F.lit(_V0))
    return lum, 13 * lum * (u - _U0), 13 * lum * (v - _V0)


def from_luv(luv: Channels, top: float) -> Channels:
    lum, us, vs = luv
    y = F.when(lum > KAPPA * EPSILON, F.pow((lum + 16) / 116, F.lit(3.0))).otherwise(lum / KAPPA)
    u, v = F.when(lum > 0, us / (13 * lum)).otherwise(F.lit(0.0)) + _U0, F.when(lum > 0, vs / (13 * lum)).otherwise(F.lit(0.0)) + _V0
    x = F.when(lum > 0, y * 9 * u / (4 * v)).otherwise(F.lit(0.0))
    z = F.when(lum > 0, y * (12 - 3 * u - 20 * v) / (4 * v)).otherwise(F.lit(0.0))
    return tuple(gamma(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))) * top for t in _times(FROM_XYZ, (x, y, z)))


def encode_lab(lab: Channels, integer_bits: int) -> Channels:
    """Perceptual coordinates in pyramid integers: lightness over its range, chroma shifted by its limit."""
    s, span = 1 << (integer_bits - 2), 200.0
    return half_away(s * lab[0] / 100), half_away(s * (span + lab[1]) / (2 * span)), half_away(s * (span + lab[2]) / (2 * span))


def decode_lab(enc: Channels, integer_bits: int) -> Channels:
    s, span = 1 << (integer_bits - 2), 200.0
    return enc[0] * 100.0 / s, enc[1] * (2 * span) / s - span, enc[2] * (2 * span) / s - span


def delta_e(a: Channels, b: Channels, top: float, luminance_weight: float = 1.0, chrominance_weight: float = 1.0) -> Column:
    """Colour distance of two pixels in Lab, over 128; the weights of lightness and of the two chroma axes add up to 1."""
    total = luminance_weight + 2 * chrominance_weight
    la, lb = to_lab(a, top), to_lab(b, top)
    d = [x - y for x, y in zip(la, lb)]
    return F.sqrt(luminance_weight / total * d[0] * d[0] + chrominance_weight / total * (d[1] * d[1] + d[2] * d[2])) / 128.0
