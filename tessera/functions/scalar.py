"""Scalar pixel arithmetic as Column builders: clamps, switches, rounding, fixed point, option values."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round half away from zero for non-negative values: floor(x + 0.5)."""
    return F.floor(x + 0.5).cast("long")


def half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")


def clamp(x: Column, lo: float, lo_value: float, up: float, up_value: float) -> Column:
    """lo_value at or below lo, up_value at or above up, else x; every channel by its own value."""
    return F.when(x <= lo, F.lit(lo_value)).when(x >= up, F.lit(up_value)).otherwise(x)


def fill_in(x: Column, y: Column, threshold: float, scale_x: float, scale_y: float) -> Column:
    """scale_x * x where x reaches the threshold, else scale_y * y."""
    return F.when(x >= threshold, x * scale_x).otherwise(y * scale_y)


def saturating_subtract(a: Column, b: Column) -> Column:
    return F.when(a > b, a - b).otherwise(F.lit(0).cast("long"))


def mask_multiply(p: Column, m: Column, top: float) -> Column:
    return half_away(p * m / top)


def lerp_masked(mask: Column, white: Column, black: Column) -> Column:
    """White where mask >= 1, black where mask <= 0, else linear; in that order, so an undefined side never leaks."""
    return F.when(mask >= 1, white).when(mask <= 0, black).otherwise(mask * white + (1 - mask) * black)


def linear_range(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """[a, b] mapped affinely to [c, d]."""
    return (x - a) * ((d - c) / (b - a)) + c


def wrap(x: Column, lo: float, hi: float) -> Column:
    """x moved into [lo, hi) by whole periods."""
    return F.pmod(x - lo, F.lit(hi - lo)) + lo


def limit(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def to_fixed(v: Column, fraction_bits: int) -> Column:
    """Fixed point of an integer or real value."""
    return F.floor(v * (1 << fraction_bits) + 0.5).cast("long")


def from_fixed(q: Column, fraction_bits: int) -> Column:
    """Nearest integer, halves up: the deterministic form of a dithered rounding."""
    whole = F.shiftright(q, fraction_bits)
    rest = q - whole * (1 << fraction_bits)
    return whole + F.when(rest >= 1 << (fraction_bits - 1), 1).otherwise(0)


def _draw(n: int, seed: int, place: tuple[Column, ...]) -> Column:
    """A number from 0 to n - 1 that the place decides, so reruns agree."""
    digest = F.md5(F.concat_ws(",", F.lit(str(seed)), *(p.cast("string") for p in place)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def from_fixed_dithered(q: Column, fraction_bits: int, *place: Column, seed: int = 0) -> Column:
    """Fractions under a quarter go down, from three quarters up; between, a draw by place decides."""
    one = 1 << fraction_bits
    whole = F.shiftright(q, fraction_bits)
    rest = q - whole * one
    draw = _draw(one // 2, seed, place) + one // 4
    return whole + F.when(rest < one // 4, 0).when(rest >= 3 * one // 4, 1).otherwise(F.when(draw <= rest, 1).otherwise(0))


#: Steps of a dithered fraction.
DITHER_STEPS = 1 << 20


def dither(v: Column, *place: Column, seed: int = 0) -> Column:
    """The integer below or above a real value: fractions under a quarter go down, from three quarters up; between, a draw by place decides."""
    rest = v - F.floor(v)
    draw = 0.25 + (_draw(DITHER_STEPS, seed, place) + 0.5) / (2 * DITHER_STEPS)
    return F.floor(v).cast("long") + F.when(rest < 0.25, 0).when(rest >= 0.75, 1).otherwise(F.when(draw <= rest, 1).otherwise(0))


def log_map(v: Column) -> Column:
    """Real values to a range without extremes: 1 + ln(1 + v) from zero up, 1 / (1 - v) below."""
    return F.when(v >= 0, 1 + F.log1p(v)).otherwise(1 / (1 - v))


def log_unmap(u: Column) -> Column:
    return F.when(u >= 1, F.expm1(u - 1)).otherwise(1 - 1 / u)


@dataclass(frozen=True)
class Amount:
    """An option that is absolute or a percentage of a range; a negative one counts from the top."""

    value: float
    percent: bool = False

    @classmethod
    def parse(cls, text: str) -> Amount:
        m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)\s*(%?)\s*", text)
        if not m:
            raise ValueError(f"not a number or percentage: {text!r}")
        return cls(float(m[1]), m[2] == "%")

    def of(self, top: float) -> float:
        x = self.value * top / 100 if self.percent else self.value
        return top + x if self.value < 0 or (self.value == 0 and math.copysign(1, self.value) < 0) else x

    def text(self) -> str:
        return f"{self.value:g}{'%' if self.percent else ''}"
