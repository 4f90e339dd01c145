"""Bounded scalar and multidimensional minimisers, for kernels that repair colours."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np

# Factor, increment and modulus of the random sequence, and the seed of searches.
LCG = (1_103_515_245, 12_345, 1 << 31)
SEED = 1_000_003


def random_sequence(seed: int = SEED) -> Iterator[float]:
    """Reproducible numbers in [0, 1)."""
    factor, increment, modulus = LCG
    state = seed
    while True:
        state = (state * factor + increment) % (1 << 32)
        yield state % modulus / modulus


def bracket(f: Callable[[float], float], x: float, a: float, b: float, tries: int = 100, seed: int = SEED) -> float | None:
    """A point of (a, b) where f is less than at both ends: ``x`` or a random one, None if no try hits one."""
    bound = min(f(a), f(b))
    inner = (a + (b - a) * (0.001 + 0.998 * u) for u in random_sequence(seed))
    return next((p for p in itertools.chain([x], itertools.islice(inner, tries)) if f(p) < bound), None)


def spaced_starts(n: int, a: float, b: float, centre: float, power: float = 2.0) -> list[float]:
    """n starting points of a search, from ``centre`` out to both ends in turn, denser around it the higher the power."""
    share = lambda k, count: (k / count) ** power if count else 0.0
    right, left = (n - 1) // 2, n // 2
    out = [centre]
    for k in range(1, left + 1):
        out.append(centre - (centre - a) * share(k, left))
        if k <= right:
            out.append(centre + (b - centre) * share(k, right))
    return out


_PHI = (math.sqrt(5) - 1) / 2


def golden_section(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-8) -> tuple[float, float]:
    """Minimum of a unimodal f on [a, b]: (x, f(x))."""
    c, d = b - _PHI * (b - a), a + _PHI * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - _PHI * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + _PHI * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return x, f(x)


def brent(f: Callable[[float], float], a: float, b: float, tolerance: float = 1e-8, rounds: int = 100) -> tuple[float, float]:
    """Parabolic steps where they behave, golden ones elsewhere."""
    x = w = v = a + (1 - _PHI) * (b - a)
    fx = fw = fv = f(x)
    step = last = 0.0
    for _ in range(rounds):
        middle = (a + b) / 2
        eps = tolerance * abs(x) + 1e-12
        if abs(x - middle) <= 2 * eps - (b - a) / 2:
            break
        use_golden = True
        if abs(last) > eps:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            before, last = last, step
            if abs(p) < abs(q * before / 2) and q * (a - x) < p < q * (b - x):
                step = p / q
                use_golden = False
                if x + step - a < 2 * eps or b - x - step < 2 * eps:
                    step = math.copysign(eps, middle - x)
        if use_golden:
            last = (b if x < middle else a) - x
            step = (1 - _PHI) * last
        u = x + (step if abs(step) >= eps else math.copysign(eps, step))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def brent_rows(f: Callable[[np.ndarray, np.ndarray], np.ndarray], a: np.ndarray, b: np.ndarray, tolerance: float = 1e-8, rounds: int = 100) -> np.ndarray:
    """The x of ``brent`` for many functions at once; ``f`` takes row numbers and one place for each."""
    a, b = np.array(a, float), np.array(b, float)
    x = a + (1 - _PHI) * (b - a)
    w, v = x.copy(), x.copy()
    fx = f(np.arange(len(x)), x)
    fw, fv = fx.copy(), fx.copy()
    step, last = np.zeros(len(x)), np.zeros(len(x))
    live = np.arange(len(x))
    for _ in range(rounds):
        live = live[~(np.abs(x - (a + b) / 2) <= 2 * (tolerance * np.abs(x) + 1e-12) - (b - a) / 2)[live]]
        if not len(live):
            break
        a_, b_, x_, w_, v_, fx_, fw_, fv_, step_, last_ = (s[live] for s in (a, b, x, w, v, fx, fw, fv, step, last))
        middle, eps = (a_ + b_) / 2, tolerance * np.abs(x_) + 1e-12
        r, q = (x_ - w_) * (fx_ - fv_), (x_ - v_) * (fx_ - fw_)
        p, q = (x_ - v_) * q - (x_ - w_) * r, 2 * (q - r)
        p, q = np.where(q > 0, -p, p), np.abs(q)
        tried = np.abs(last_) > eps
        before, last_ = last_, np.where(tried, step_, last_)
        fits = tried & (np.abs(p) < np.abs(q * before / 2)) & (q * (a_ - x_) < p) & (p < q * (b_ - x_))
        parabola = p / np.where(fits, q, 1)
        near = (x_ + parabola - a_ < 2 * eps) | (b_ - x_ - parabola < 2 * eps)
        last_ = np.where(fits, last_, np.where(x_ < middle, b_, a_) - x_)
        step_ = np.where(fits, np.where(near, np.copysign(eps, middle - x_), parabola), (1 - _PHI) * last_)
        u = x_ + np.where(np.abs(step_) >= eps, step_, np.copysign(eps, step_))
        fu = f(live, u)
        better = fu <= fx_
        second = ~better & ((fu <= fw_) | (w_ == x_))
        third = ~better & ~second & ((fu <= fv_) | (v_ == x_) | (v_ == w_))
        right = u >= x_
        a[live] = np.where(better, np.where(right, x_, a_), np.where(right, a_, u))
        b[live] = np.where(better, np.where(right, b_, x_), np.where(right, u, b_))
        v[live], fv[live] = np.where(better | second, w_, np.where(third, u, v_)), np.where(better | second, fw_, np.where(third, fu, fv_))
        w[live], fw[live] = np.where(better, x_, np.where(second, u, w_)), np.where(better, fx_, np.where(second, fu, fw_))
        x[live], fx[live], step[live], last[live] = np.where(better, u, x_), np.where(better, fu, fx_), step_, last_
    return x


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, size: float = 1.0, tolerance: float = 1e-9, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Downhill simplex from ``start`` with sides ``size``."""
    n = len(start)
    points = np.vstack([start, start + size * np.eye(n)])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] < tolerance and np.abs(points[1:] - points[0]).max() < math.sqrt(tolerance):
            break
        centre = points[:-1].mean(axis=0)
        at = lambda t: centre + t * (points[-1] - centre)
        reflected = at(-1.0)
        fr = f(reflected)
        if fr < values[0]:
            far = at(-2.0)
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            near = at(-0.5 if fr < values[-1] else 0.5)
            fn = f(near)
            if fn < min(fr, values[-1]):
                points[-1], values[-1] = near, fn
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], float(values[best])


def multi_start(f: Callable[[np.ndarray], float], starts: list[np.ndarray], size: float = 1.0) -> tuple[np.ndarray, float]:
    """The best of several simplex runs."""
    return min((nelder_mead(f, np.asarray(s, float), size) for s in starts), key=lambda r: r[1])
