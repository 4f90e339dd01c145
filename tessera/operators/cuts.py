"""Graph cuts of one overlap: the nearest-feature border, its legs through the overlap replaced by cheapest ways.

Corners between pixels are the vertices of the dual grid, 0..w by 0..h; a step from one corner to the next
separates the two pixels beside it. All loops run over whole rows or columns.
"""

from __future__ import annotations

import numpy as np

from tessera.operators.seams import BLOCKED, Point, boundary, fill, optimise_all, vectorise

#: No way: larger than any sum of costs.
CLOSED = 1 << 60
#: A step besides its cost, so that of equal ways the shorter one is taken.
_STEP = 20


def step_costs(difference: np.ndarray, overlap: np.ndarray, light: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the steps down from corner (x, y), [h, w + 1], and right from it, [h + 1, w].

    A step costs the differences of the two pixels that it separates, times the slopes of ``light`` along it at the pixels
    up and left of its two corners where these are not 0. Both pixels must be in the overlap.
    """
    h, w = difference.shape
    d = difference.astype(np.int64)
    # symmetric gradients; at the border the image is reflected, so there is none
    gx, gy = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    gx[:, 1:-1] = np.abs(light[:, 2:] - light[:, :-2]) // 2
    gy[1:-1] = np.abs(light[2:] - light[:-2]) // 2
    down, right = np.full((h, w + 1), CLOSED), np.full((h + 1, w), CLOSED)

    def cost(one: np.ndarray, other: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return (one + other) * np.where(slope > 0, slope, 1)

    above, left = np.pad(gy, ((1, 0), (0, 0)))[:-1], np.pad(gx, ((0, 0), (1, 0)))[:, :-1]
    free = overlap[:, :-1] & overlap[:, 1:]
    down[:, 1:-1] = np.where(free, cost(d[:, :-1], d[:, 1:], (above + gy)[:, :-1]), CLOSED)
    free = overlap[:-1] & overlap[1:]
    right[1:-1] = np.where(free, cost(d[:-1], d[1:], (left + gx)[:-1]), CLOSED)
    return down, right


def cheapest_corners(down: np.ndarray, right: np.ndarray, start: Point, end: Point, taken: np.ndarray) -> list[Point] | None:
    """The cheapest way between two corners that meets no other corner of ``taken``; None where there is none.

    Distances are corrected by sweeps of whole rows and columns in the four directions until none falls.
    """
    shut = taken.copy()
    shut[start[1], start[0]] = shut[end[1], end[0]] = False
    grow = lambda c, a, b: np.where((c >= CLOSED) | a | b, CLOSED, (c << _STEP) + 1)
    down, right = grow(down, shut[:-1], shut[1:]), grow(right, shut[:, :-1], shut[:, 1:])
    far = np.full((down.shape[0] + 1, right.shape[1] + 1), CLOSED)
    far[start[1], start[0]] = 0
    while True:
        before = far.copy()
        for x in range(right.shape[1]):
            np.minimum(far[:, x + 1], far[:, x] + right[:, x], out=far[:, x + 1])
        for x in range(right.shape[1] - 1, -1, -1):
            np.minimum(far[:, x], far[:, x + 1] + right[:, x], out=far[:, x])
        for y in range(down.shape[0]):
            np.minimum(far[y + 1], far[y] + down[y], out=far[y + 1])
        for y in range(down.shape[0] - 1, -1, -1):
            np.minimum(far[y], far[y + 1] + down[y], out=far[y])
        if (far == before).all():
            break
    if far[end[1], end[0]] >= CLOSED:
        return None
    path = [end]
    while path[-1] != start:
        x, y = path[-1]
        for to, cost in (
            ((x - 1, y), right[y, x - 1] if x else CLOSED),
            ((x + 1, y), right[y, x] if x < right.shape[1] else CLOSED),
            ((x, y - 1), down[y - 1, x] if y else CLOSED),
            ((x, y + 1), down[y, x] if y < down.shape[0] else CLOSED),
        ):
            if cost < CLOSED and far[to[1], to[0]] + cost == far[y, x]:
                path.append(to)
                break
    return path[::-1]


def chains(guide: np.ndarray) -> list[list[Point]]:
    """The border of the non-zero region as corners, that region on the right hand, without what runs along the image's edge. Closed ones end where they start."""
    h, w = guide.shape
    out = []
    for contour in boundary(guide):
        ring = [*contour, contour[0]]
        edge = [(a[0] == b[0] and a[0] in (0, w)) or (a[1] == b[1] and a[1] in (0, h)) for a, b in zip(ring, ring[1:])]
        if not any(edge):
            out.append(ring)
            continue
        first = edge.index(True)
        now: list[Point] = []
        for k in range(len(contour)):
            i = (first + k) % len(contour)
            if edge[i]:
                if len(now) > 1:
                    out.append(now)
                now = []
            else:
                now = now or [ring[i]]
                now.append(ring[i + 1])
        if len(now) > 1:
            out.append(now)
    return out


def _free(a: Point, b: Point, down: np.ndarray, right: np.ndarray) -> bool:
    x, y = min(a, b)
    return bool((down[y, x] if a[0] == b[0] else right[y, x]) < CLOSED)


def legs(chain: list[Point], down: np.ndarray, right: np.ndarray) -> list[tuple[bool, list[Point]]]:
    """A chain as runs of corners, and whether they go through the overlap; the last corner of a run is the first of the next."""
    out: list[tuple[bool, list[Point]]] = []
    for a, b in zip(chain, chain[1:]):
        free = _free(a, b, down, right)
        if out and out[-1][0] == free:
            out[-1][1].append(b)
        else:
            out.append((free, [a, b]))
    return out


def cut(difference: np.ndarray, overlap: np.ndarray, guide: np.ndarray, light: np.ndarray) -> list[list[Point]]:
    """Walls between what the white and the black image give: for each border of the guide its corners, legs through the overlap replaced.

    Entry and exit of a leg are the corners where the border enters and leaves the overlap. Legs never
    meet: corners of the legs before and of the parts that stay are taken. Where that leaves no way, or a leg is closed
    in itself, the guide's own run stays.
    """
    down, right = step_costs(difference, overlap, light)
    taken = np.zeros((down.shape[0] + 1, right.shape[1] + 1), bool)
    runs = [legs(c, down, right) for c in chains(guide)]
    for free, run in (r for parts in runs for r in parts):
        for x, y in (run[0], run[-1]) if free else run:
            taken[y, x] = True
    out = []
    # the longest legs have their choice first, as the longest border is the seam
    order = sorted(((i, j) for i, parts in enumerate(runs) for j, (free, _) in enumerate(parts) if free), key=lambda k: -len(runs[k[0]][k[1]][1]))
    for i, j in order:
        run = runs[i][j][1]
        way = cheapest_corners(down, right, run[0], run[-1], taken) if run[0] != run[-1] else None
        if way:
            runs[i][j] = (True, way)
        for x, y in runs[i][j][1]:
            taken[y, x] = True
    for parts in runs:
        wall = [parts[0][1][0]]
        for _, run in parts:
            wall += run[1:]
        out.append(wall)
    return out


def cut_cost(walls: list[list[Point]], down: np.ndarray, right: np.ndarray) -> int:
    """What the steps of the walls through the overlap cost."""
    total = 0
    for wall in walls:
        for a, b in zip(wall, wall[1:]):
            x, y = min(a, b)
            c = int(down[y, x] if a[0] == b[0] else right[y, x])
            total += c if c < CLOSED else 0
    return total


def regions(open_right: np.ndarray, open_down: np.ndarray) -> np.ndarray:
    """Numbers of the 4-connected regions of a grid: ``open_right`` [h, w - 1] and ``open_down`` [h - 1, w] say where neighbours are joined."""
    h, w = open_right.shape[0], open_down.shape[1]
    # runs of joined pixels in each row are the nodes, joints between rows the edges
    starts = np.ones((h, w), bool)
    starts[:, 1:] = ~open_right
    run = np.cumsum(starts.ravel()).reshape(h, w) - 1
    a, b = run[:-1][open_down], run[1:][open_down]
    return smallest(int(run[-1, -1]) + 1, a, b)[run]


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that edges a-b connect it with, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def sides(walls: list[list[Point]], guide: np.ndarray) -> np.ndarray:
    """255 on the right hand of the walls, 0 on their left.

    Each step of a wall says of the pixel on its right that it is white and of the one on its left that it is black; the
    regions between walls go by the majority of what was said, then of the guide.
    """
    h, w = guide.shape
    open_right, open_down = np.ones((h, w - 1), bool), np.ones((h - 1, w), bool)
    votes = np.zeros((h, w), np.int64)
    steps = np.array([(*a, *b) for wall in walls for a, b in zip(wall, wall[1:])], np.int64).reshape(-1, 4)
    ax, ay, bx, by = steps.T
    x, y = np.minimum(ax, bx), np.minimum(ay, by)
    up_down = ax == bx
    open_right[y[up_down], x[up_down] - 1] = False
    open_down[y[~up_down] - 1, x[~up_down]] = False
    # going down the right hand is the left pixel; going right it is the lower one
    way = np.where(up_down, by - ay, bx - ax)
    for on, dx, dy, sign in ((up_down, -1, 0, 1), (up_down, 0, 0, -1), (~up_down, 0, 0, 1), (~up_down, 0, -1, -1)):
        np.add.at(votes, (y[on] + dy, x[on] + dx), sign * way[on])
    number = regions(open_right, open_down)
    said = np.bincount(number.ravel(), votes.ravel())
    agreed = np.bincount(number.ravel(), np.where(guide != 0, 1, -1).ravel())
    return np.where(np.where(said != 0, said, agreed)[number] > 0, 255, 0)


def cut_mask(difference: np.ndarray, overlap: np.ndarray, guide: np.ndarray, light: np.ndarray) -> np.ndarray:
    """The guide, 255 or 0, with its border moved to the cheapest cut of the overlap."""
    walls = cut(difference, overlap, guide, light)
    return sides(walls, guide) if walls else np.where(guide != 0, 255, 0)


Overlap = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def create_masks(overlaps: list[Overlap], distance: int = 4, chain: tuple[str, ...] = ("anneal", "dijkstra"), graph_cut: bool = False, **settings: float) -> list[np.ndarray]:
    """The seams of overlaps (cost, overlap, guide, light): each the guide mask, or a graph cut along it; its contours thinned, moved to cheap pixels, and filled again.

    Without optimizers the masks stay as they are. Contours of all overlaps are moved side by side.
    """
    masks = [cut_mask(cost, overlap, guide, light) if graph_cut else np.where(guide != 0, 255, 0) for cost, overlap, guide, light in overlaps]
    if not chain:
        return masks
    found, jobs, at = [], [], []
    for mask, (cost, overlap, _, _) in zip(masks, overlaps):
        shut = np.where(overlap, cost, BLOCKED)
        found.append(vectorise(mask, distance))
        for i, contour in enumerate(found[-1]):
            if len(contour) > 2:
                jobs.append((shut, contour))
                at.append((len(found) - 1, i))
    for (k, i), contour in zip(at, optimise_all(jobs, chain, **settings)):
        found[k][i] = contour
    return [np.where(fill([[(x, y) for _, x, y in c] for c in contours], mask.shape), 255, 0) for contours, mask in zip(found, masks)]


def create_mask(cost: np.ndarray, overlap: np.ndarray, guide: np.ndarray, light: np.ndarray, distance: int = 4, chain: tuple[str, ...] = ("anneal", "dijkstra"), graph_cut: bool = False, **settings: float) -> np.ndarray:
    """:func:`create_masks` of one overlap."""
    return create_masks([(cost, overlap, guide, light)], distance, chain, graph_cut, **settings)[0]


def coarse_seams(overlaps: list[Overlap], factor: int, **options: object) -> list[np.ndarray]:
    """:func:`create_masks` on every ``factor``-th row and column, each place of a result spread over the places it stands for."""
    masks = create_masks([tuple(a[::factor, ::factor] for a in o) for o in overlaps], **options)
    return [m.repeat(factor, axis=0).repeat(factor, axis=1)[: o[0].shape[0], : o[0].shape[1]] for m, o in zip(masks, overlaps)]


def coarse_seam(cost: np.ndarray, overlap: np.ndarray, guide: np.ndarray, light: np.ndarray, factor: int, **options: object) -> np.ndarray:
    """:func:`coarse_seams` of one overlap."""
    return coarse_seams([(cost, overlap, guide, light)], factor, **options)[0]
