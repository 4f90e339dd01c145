"""Seam geometry on one raster at a time: sequential algorithms as numpy kernels.

Each kernel takes the costs or mask of one overlap region, whose size bounds its
memory; :func:`per_image` runs one per image in parallel.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BLOCKED = 255
Point = tuple[int, int]


def per_image(df: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], list[tuple]], schema: str, value: str = "v") -> DataFrame:
    """``kernel`` on each image as an array [y, x] (absent places are BLOCKED); its tuples, after the keys, are the rows."""
    kinds = dict(df.dtypes)
    names = [part.split()[0] for part in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.full((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), BLOCKED, np.int64)
        image[pdf["y"], pdf["x"]] = pdf[value]
        out = pd.DataFrame(kernel(image), columns=names)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


#: Places of whole images that one call of :func:`per_images` takes at least, where a task has so many.
PLACES_AT_ONCE = 1 << 14


def per_images(df: DataFrame, keys: list[str], kernel: Callable[[list[np.ndarray]], list[list[tuple]]], schema: str, value: str = "v") -> DataFrame:
    """:func:`per_image` for kernels that take many images at once: small ones come by the PLACES_AT_ONCE, so a task holds that many places and one image more."""
    kinds = dict(df.dtypes)
    names = [part.split()[0] for part in schema.split(",")]

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        """The first row of each image."""
        new = np.zeros(len(pdf), bool)
        new[:1] = True
        for k in keys:
            c, before = pdf[k], pdf[k].shift()
            new |= ((c != before) & ~(c.isna() & before.isna())).to_numpy()
        return np.flatnonzero(new)

    def work(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        x, y, v = (pdf[c].to_numpy() for c in ("x", "y", value))
        images = []
        for a, b in zip(cuts, [*cuts[1:], len(pdf)]):
            image = np.full((int(y[a:b].max()) + 1, int(x[a:b].max()) + 1), BLOCKED, np.int64)
            image[y[a:b], x[a:b]] = v[a:b]
            images.append(image)
        found = kernel(images)
        out = pd.DataFrame([row for rows in found for row in rows], columns=names)
        own = pdf[keys].iloc[np.repeat(cuts, [len(rows) for rows in found])].reset_index(drop=True)
        return pd.concat([own, out], axis=1)

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in parts:
            held.append(pdf)
            size += len(pdf)
            if size < PLACES_AT_ONCE:
                continue
            whole = pd.concat(held, ignore_index=True)
            cuts = starts(whole)
            held, size = [whole], 0
            if len(cuts) > 1:  # the last image may go on
                yield work(whole.iloc[: cuts[-1]], cuts[:-1])
                held = [whole.iloc[cuts[-1] :]]
        if held:
            whole = pd.concat(held, ignore_index=True)
            if len(whole):
                yield work(whole, starts(whole))

    rows = df.select(*keys, "x", "y", value).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def step_cost(cost: int) -> int:
    """Entering a pixel costs at least 1; blocked pixels are all but closed."""
    return max(1, cost) * (65_536 if cost == BLOCKED else 1)


def cheapest_path(cost: np.ndarray, start: Point, end: Point) -> list[Point]:
    """The 8-connected path of least total cost between two (x, y), both ends left out; diagonal steps cost 1.4 times, truncated."""
    h, w = cost.shape
    best = {end: 0}
    parent: dict[Point, Point] = {}
    queue = [(0, end)]
    while queue:
        d, (x, y) = heapq.heappop(queue)
        if (x, y) == start:
            break
        if d > best[x, y]:
            continue
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                nx, ny = x + dx, y + dy
                if (dx or dy) and 0 <= nx < w and 0 <= ny < h:
                    c = step_cost(int(cost[ny, nx]))
                    nd = d + (int(c * 1.4) if dx and dy else c)
                    if nd < best.get((nx, ny), 1 << 62):
                        best[nx, ny] = nd
                        parent[nx, ny] = (x, y)
                        heapq.heappush(queue, (nd, (nx, ny)))
    path, at = [], start
    while at != end and at in parent:
        at = parent[at]
        path.append(at)
    return path[:-1]


def path_cost(cost: np.ndarray, path: list[Point]) -> int:
    total, last = 0, None
    for x, y in path:
        c = step_cost(int(cost[y, x]))
        total += int(c * 1.4) if last and last[0] != x and last[1] != y else c
        last = (x, y)
    return total


def boundary(mask: np.ndarray) -> list[list[Point]]:
    """Closed crack contours of the non-zero region: corner points (x, y), region on the right hand, longest run first."""
    inside = np.pad(mask != 0, 1)
    edges: dict[Point, list[Point]] = {}
    ys, xs = np.nonzero(inside)
    for y, x in zip(ys.tolist(), xs.tolist()):
        px, py = x - 1, y - 1
        for open_, a, b in (
            (not inside[y - 1, x], (px, py), (px + 1, py)),
            (not inside[y, x + 1], (px + 1, py), (px + 1, py + 1)),
            (not inside[y + 1, x], (px + 1, py + 1), (px, py + 1)),
            (not inside[y, x - 1], (px, py + 1), (px, py)),
        ):
            if open_:
                edges.setdefault(a, []).append(b)
    contours = []
    while edges:
        start = min(edges, key=lambda p: (p[1], p[0]))
        contour, at, came = [start], start, (1, 0)
        while True:
            nexts = edges[at]
            # where two cracks leave a corner, turn right, so touching regions stay apart
            to = max(nexts, key=lambda b: came[0] * (b[1] - at[1]) - came[1] * (b[0] - at[0]))
            nexts.remove(to)
            if not nexts:
                del edges[at]
            came = (to[0] - at[0], to[1] - at[1])
            at = to
            if at == start:
                break
            contour.append(at)
        contours.append(contour)
    return sorted(contours, key=len, reverse=True)


def vectorise(mask: np.ndarray, distance: int = 4) -> list[list[tuple[bool, int, int]]]:
    """Contours thinned to a vertex every ``distance`` corners; vertices on the image border can't move."""
    h, w = mask.shape
    out = []
    for contour in boundary(mask):
        kept = contour[::distance]
        out.append([(0 < x < w and 0 < y < h, x, y) for x, y in kept])
    return out


def movable_runs(contour: list[tuple[bool, int, int]]) -> list[list[tuple[bool, int, int]]]:
    """The contour cut into segments of movable vertices with the frozen vertex on either side."""
    n = len(contour)
    if all(v[0] for v in contour):
        return [contour]
    if not any(v[0] for v in contour):
        return []
    first = next(i for i, v in enumerate(contour) if not v[0])
    ring = contour[first:] + contour[: first + 1]
    runs, now = [], [ring[0]]
    for v in ring[1:]:
        now.append(v)
        if not v[0]:
            if len(now) > 2:
                runs.append(now)
            now = [v]
    return runs if n > 1 else []


def raster(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of straight lines from a to b, rows (x, y), without their ends: [line, step, 2], and which steps each line has.

    Step t of a line whose longer side is n moves by t / n of both sides, truncated.
    """
    d = b - a
    n = np.abs(d).max(axis=1)
    t = np.arange(int(n.max(initial=0)))
    moved = (t[None, :, None] * np.abs(d)[:, None, :]) // np.maximum(n, 1)[:, None, None]
    return a[:, None, :] + np.sign(d)[:, None, :] * moved, t[None, :] < n[:, None]


#: Lines under this length are penalised.
SHORT_LINE = 8


#: Steps of lines that are looked up at once.
STEPS_AT_ONCE = 1 << 20


class _Costs:
    """The costs of several images, one after the other."""

    def __init__(self, images: list[np.ndarray]) -> None:
        self.flat = np.concatenate([c.ravel() for c in images])
        self.start = np.cumsum([0, *(c.size for c in images[:-1])])
        self.h, self.w = np.array([c.shape for c in images]).T

    def under(self, image: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:func:`line_costs` of lines of these images."""
        out = np.empty(len(a), np.int64)
        long = np.abs(b - a).max(axis=1)
        step = max(1, STEPS_AT_ONCE // max(1, int(long.max(initial=0))))
        for i in range(0, len(a), step):
            of = image[i : i + step]
            at, on = raster(a[i : i + step], b[i : i + step])
            x, y, w, h = at[..., 0], at[..., 1], self.w[of, None], self.h[of, None]
            inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            cost = np.where(inside, self.flat[self.start[of, None] + np.where(inside, y * w + x, 0)], BLOCKED)
            out[i : i + step] = (cost * on).sum(axis=1)
        return out + BLOCKED * np.maximum(0, SHORT_LINE - long)


def line_costs(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs under lines from a to b, their ends left out; a line shorter than SHORT_LINE pays for each pixel it lacks, so vertices do not clump."""
    return _Costs([cost]).under(np.zeros(len(a), np.int64), a, b)


def states(cost: np.ndarray, before: Point, at: Point, after: Point, k_max: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Places a vertex may take, with half their distance: on both sides of it along the normal, every few pixels, up to the border or the first blocked pixel."""
    h, w = cost.shape
    nx, ny = -(after[1] - before[1]), after[0] - before[0]
    length = math.hypot(nx, ny)
    here, still = np.array([at]), (np.array([at]), np.array([0]))
    if not length:
        return still
    reach = min(w, h) // 3
    way = np.rint(np.array([nx, ny]) * reach / length).astype(int)
    whole = int(np.abs(2 * way).max())
    if not whole:
        return still
    gap = math.ceil(whole / k_max)
    points = []
    for sign, first, n in ((1, 0, (whole + 1) // 2), (-1, 1, 1 + whole // 2)):
        line, on = raster(here, here + 2 * sign * way)  # as far again, so the end of the reach is there
        line = line[0][on[0]][:n]
        x, y = line.T
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        shut = ~inside | (cost[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)] == BLOCKED)
        if sign < 0:
            shut[:1] = False  # the vertex itself is the other side's
        stop = int(np.argmax(shut)) if shut.any() else len(line)
        points.append(line[first:stop][(np.arange(first, stop) % gap) == 0])
    found = np.concatenate(points)
    return (found, np.abs(found - here).max(axis=1) // 2) if len(found) else still


def preferences(energy: np.ndarray) -> np.ndarray:
    """How far each state j is preferred to each other state i, [..., i, j]; 0 for states without a finite energy."""
    real = np.isfinite(energy)
    e = np.where(real, energy, 0.0)
    d = np.clip(e[..., None, :] - e[..., :, None], -700, 700)
    return (real[..., :, None] & real[..., None, :] & ~np.eye(energy.shape[-1], dtype=bool)) / (1 + np.exp(d))


def update(p: np.ndarray, preferred: np.ndarray) -> np.ndarray:
    """One round of the deterministic annealing of vertices' state probabilities, [..., state]."""
    new = p * (1 + preferred.sum(axis=-2)) + np.matmul(p[..., None, :], preferred)[..., 0, :]
    return new / new.sum(axis=-1, keepdims=True)


Contour = list[tuple[bool, int, int]]


def anneal(cost: np.ndarray, contour: Contour, *settings: float, **cooling: float) -> Contour:
    """:func:`anneal_all` of one contour."""
    return anneal_all([(cost, contour)], *settings, **cooling)[0]


def anneal_all(jobs: list[tuple[np.ndarray, Contour]], distance_weight: float = 12.0, mismatch_weight: float = 1.0, tau: float = 0.75, delta_max: float = 7000.0, delta_min: float = 5.0, k_max: int = 32) -> list[Contour]:
    """Move the vertices of contours, each over its image's costs, to cheap places nearby: mean-field annealing over each vertex's states, cooling from delta_max to delta_min.

    Contours whose vertices have as many states are annealed side by side, each at its own temperature.
    """
    done = [contour for _, contour in jobs]
    alike: dict[int, list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]] = {}
    for j, (cost, contour) in enumerate(jobs):
        n = len(contour)
        spots = [states(cost, contour[i - 1][1:], (x, y), contour[(i + 1) % n][1:], k_max) if movable else (np.array([(x, y)]), np.array([0])) for i, (movable, x, y) in enumerate(contour)]
        k = max((len(s) for s, _ in spots), default=0)
        if k > 1:
            alike.setdefault(k, []).append((j, spots))
    total = distance_weight + mismatch_weight
    weights = 2 * distance_weight / total, 2 * mismatch_weight / total
    for k, same in alike.items():
        mean = _anneal([jobs[j][0] for j, _ in same], [spots for _, spots in same], k, weights, tau, delta_max, delta_min)
        at = 0
        for j, spots in same:
            done[j] = [(m, int(x), int(y)) for (m, _, _), (x, y) in zip(done[j], mean[at : at + len(spots)])]
            at += len(spots)
    return done


def _anneal(images: list[np.ndarray], spots: list[list[tuple[np.ndarray, np.ndarray]]], k: int, weights: tuple[float, float], tau: float, delta_max: float, delta_min: float) -> np.ndarray:
    """Final places of all contours' vertices, one contour after the other; ``k`` is the most states that a vertex has, the same in each contour.

    A pass is one round of every contour that still cools. All vertices are updated at once from their neighbours' last
    estimates; only the energies next to an estimate that moved are computed anew.
    """
    size = np.array([len(c) for c in spots])
    first = np.cumsum([0, *size[:-1]])
    of = np.repeat(np.arange(len(size)), size)
    n = len(of)
    left, right = np.arange(n) - 1, np.arange(n) + 1
    left[first], right[first + size - 1] = first + size - 1, first
    costs = _Costs(images)
    every = [v for c in spots for v in c]
    count = np.array([len(s) for s, _ in every])
    place, far, there = np.zeros((n, k, 2), int), np.zeros((n, k)), np.arange(k) < count[:, None]
    for i, (s, f) in enumerate(every):
        place[i, : len(s)], far[i, : len(s)] = s, f
    prob = there / count[:, None]
    estimate = lambda rows: np.floor((prob[rows][..., None] * place[rows]).sum(axis=1) + 0.5).astype(int)
    mean = estimate(np.arange(n))
    wd, wm = weights
    many = k > 2
    t = np.full(len(size), float(math.ceil(delta_max / math.log(k / (k - 2))) if many else delta_max))
    stop = delta_min / math.log(k * k - k - 1) if many else delta_min
    most = np.full(len(size), k)  # states that a vertex of the contour still has
    rounds, cooling = np.zeros(len(size), int), np.ones(len(size), bool)
    energy, preferred = np.full((n, k), np.inf), np.zeros((n, k, k))
    stale, far_off = np.ones(n, bool), np.ones(n, bool)  # preferences, and energies, to be computed anew
    moved = np.zeros(n, bool)

    def estimated(rows: np.ndarray) -> None:
        now = estimate(rows)
        moved[rows] = (now != mean[rows]).any(axis=1)
        mean[rows] = now

    while True:
        for c in np.flatnonzero(cooling & (rounds == 0)).tolist():
            now, heat = int(most[c]), float(t[c])
            if heat > stop and now > 1:
                rounds[c] = max(1, math.ceil(math.log(1 / now) / math.log(min(1 - 1e-9, (now - 2) / (2 * now) * math.exp(-heat / delta_max) + 0.5))))
                stale[first[c] : first[c] + size[c]] = True  # the temperature is another
            else:
                cooling[c] = False
        if not cooling.any():
            return mean
        live = np.flatnonzero(cooling[of])
        busy = live[there[live].sum(axis=1) > 1]
        new = busy[stale[busy]]
        own = new[far_off[new]]
        i, j = np.nonzero(there[own])
        if len(i):
            i = own[i]
            energy[i, j] = wd * far[i, j] + wm * (costs.under(of[i], mean[left[i]], place[i, j]) + costs.under(of[i], place[i, j], mean[right[i]]))
        preferred[new] = preferences(np.where(there[new], energy[new], np.inf) / t[of[new], None])
        last, prob[busy] = prob[busy], update(prob[busy], preferred[busy])
        estimated(live)
        stale[live] = far_off[live] = moved[left[live]] | moved[right[live]]
        rounds[cooling] -= 1
        # further rounds at this temperature change nothing
        change = np.zeros(len(size))
        np.maximum.at(change, of[busy], np.abs(prob[busy] - last).max(axis=1))
        calm = cooling & ~np.logical_or.reduceat(moved, first) & (change < 1e-11)
        rounds[calm] = 0
        ended = cooling & (rounds == 0)
        if ended.any():
            rows = np.flatnonzero(ended[of])
            least = np.where(prob[rows].max(axis=1) > 0.99, 0.5, 1e-5)[:, None]
            there[rows] &= prob[rows] >= least
            kept = np.where(there[rows], prob[rows], 0.0)
            prob[rows] = kept / kept.sum(axis=1, keepdims=True)
            estimated(rows)
            far_off[rows] |= moved[left[rows]] | moved[right[rows]]
            most[ended] = np.maximum.reduceat(there.sum(axis=1), first)[ended]
            t[ended] *= tau


def drop_blocked(cost: np.ndarray, contour: list[tuple[bool, int, int]]) -> list[tuple[bool, int, int]]:
    """Without the movable vertices that ended on blocked pixels."""
    h, w = cost.shape
    ok = lambda x, y: 0 <= x < w and 0 <= y < h and cost[y, x] != BLOCKED
    return [v for v in contour if not v[0] or ok(v[1], v[2])]


def refine(cost: np.ndarray, contour: list[tuple[bool, int, int]], radius: int = 25) -> list[Point]:
    """The contour's vertices joined by cheapest paths, each sought within ``radius`` of its two ends."""
    h, w = cost.shape
    out: list[Point] = []
    n = len(contour)
    for i in range(n):
        (_, x, y), (_, x2, y2) = contour[i], contour[(i + 1) % n]
        out.append((x, y))
        x0, y0 = max(0, min(x, x2) - radius), max(0, min(y, y2) - radius)
        x1, y1 = min(w, max(x, x2) + radius + 1), min(h, max(y, y2) + radius + 1)
        if not (x0 <= x < x1 and x0 <= x2 < x1 and y0 <= y < y1 and y0 <= y2 < y1):
            continue
        out += [(px + x0, py + y0) for px, py in cheapest_path(cost[y0:y1, x0:x1], (x - x0, y - y0), (x2 - x0, y2 - y0))]
    return out


def optimise(cost: np.ndarray, contour: Contour, chain: tuple[str, ...] = ("anneal", "dijkstra"), radius: int = 25, **cooling: float) -> Contour:
    """:func:`optimise_all` of one contour."""
    return optimise_all([(cost, contour)], chain, radius, **cooling)[0]


def optimise_all(jobs: list[tuple[np.ndarray, Contour]], chain: tuple[str, ...] = ("anneal", "dijkstra"), radius: int = 25, **cooling: float) -> list[Contour]:
    """Contours, each over its image's costs, after a chain of optimizers; ``cooling`` are the settings of :func:`anneal_all`."""
    costs, contours = [cost for cost, _ in jobs], [contour for _, contour in jobs]
    for name in chain:
        if name == "anneal":
            contours = anneal_all(list(zip(costs, contours)), **cooling)
        elif name == "dijkstra":
            contours = [[(True, x, y) for x, y in refine(cost, contour, radius)] for cost, contour in zip(costs, contours)]
        else:
            raise ValueError(f"unknown optimizer {name!r}")
        contours = [drop_blocked(cost, contour) for cost, contour in zip(costs, contours)]
    return contours


def segments_cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether the open segments ab and cd cross."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def fill(contours: list[list[Point]], shape: tuple[int, int]) -> np.ndarray:
    """Even-odd fill at pixel centres; corners are (x, y), contours cancel where they overlap."""
    h, w = shape
    out = np.zeros((h, w), bool)
    centres = np.arange(w) + 0.5
    for contour in contours:
        for y in range(h):
            line_y, crossings = y + 0.5, []
            for (x1, y1), (x2, y2) in zip(contour, contour[1:] + contour[:1]):
                if (y1 <= line_y) != (y2 <= line_y):
                    crossings.append(x1 + (line_y - y1) * (x2 - x1) / (y2 - y1))
            if crossings:
                out[y] ^= (np.searchsorted(np.sort(crossings), centres) % 2).astype(bool)
    return out
