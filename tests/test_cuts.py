"""Graph cuts, annealing and line rasters against plain twins."""

import heapq
import math
import random
import time

import numpy as np
import pytest

from tessera.operators import cuts, lines, seams
from tessera.plans.config import BlendConfig


def cheapest(down, right, start, end, taken):
    """One corner after the other."""
    best, queue = {start: 0}, [(0, start)]
    h, w = down.shape[0], right.shape[1]
    while queue:
        c, (x, y) = heapq.heappop(queue)
        if (x, y) == end:
            return c
        if c > best[x, y]:
            continue
        near = ((x - 1, y, right[y, x - 1] if x else cuts.CLOSED), (x + 1, y, right[y, x] if x < w else cuts.CLOSED), (x, y - 1, down[y - 1, x] if y else cuts.CLOSED), (x, y + 1, down[y, x] if y < h else cuts.CLOSED))
        for nx, ny, k in near:
            if k < cuts.CLOSED and ((nx, ny) in (start, end) or not taken[ny, nx]) and c + k < best.get((nx, ny), math.inf):
                best[nx, ny] = int(c + k)
                heapq.heappush(queue, (int(c + k), (nx, ny)))
    return None


def flood(mask):
    """Number of regions of equal neighbours, one pixel after the other."""
    seen, n = set(), 0
    h, w = mask.shape
    for at in ((x, y) for y in range(h) for x in range(w)):
        if at in seen:
            continue
        n += 1
        todo = [at]
        seen.add(at)
        while todo:
            x, y = todo.pop()
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if 0 <= p[0] < w and 0 <= p[1] < h and p not in seen and mask[p[1], p[0]] == mask[y, x]:
                    seen.add(p)
                    todo.append(p)
    return n


def test_step_costs_one_step_at_a_time():
    rnd = np.random.default_rng(1)
    h, w = 5, 7
    d, light, overlap = rnd.integers(0, 256, (h, w)), rnd.integers(0, 511, (h, w)), rnd.random((h, w)) < 0.8
    down, right = cuts.step_costs(d, overlap, light)
    gx = lambda x, y: abs(int(light[y, x + 1] - light[y, x - 1])) // 2 if 0 < x < w - 1 and y >= 0 else 0
    gy = lambda x, y: abs(int(light[y + 1, x] - light[y - 1, x])) // 2 if 0 < y < h - 1 and x >= 0 else 0
    for y in range(h):
        for x in range(w + 1):
            open_ = 0 < x < w and overlap[y, x - 1] and overlap[y, x]
            slope = gy(x - 1, y - 1) + gy(x - 1, y)
            assert down[y, x] == ((d[y, x - 1] + d[y, x]) * (slope or 1) if open_ else cuts.CLOSED)
    for y in range(h + 1):
        for x in range(w):
            open_ = 0 < y < h and overlap[y - 1, x] and overlap[y, x]
            slope = gx(x - 1, y - 1) + gx(x, y - 1)
            assert right[y, x] == ((d[y - 1, x] + d[y, x]) * (slope or 1) if open_ else cuts.CLOSED)


@pytest.mark.parametrize("shape", [(8, 8), (20, 20), (12, 40), (3, 2)])
def test_a_cut_of_a_whole_overlap_has_two_sides_and_least_cost(shape):
    rnd = np.random.default_rng(sum(shape))
    h, w = shape
    for _ in range(40):
        d, light = rnd.integers(0, 256, shape), rnd.integers(0, 511, shape)
        guide = np.where(np.arange(w) < rnd.integers(1, w), 255, 0) * np.ones((h, 1), np.int64)
        overlap = np.ones(shape, bool)
        down, right = cuts.step_costs(d, overlap, light)
        (chain,) = cuts.chains(guide)
        # entry and exit are corners of the image's border, where the guide's border starts and ends
        assert chain[0][1] in (0, h) and chain[-1][1] in (0, h) and chain[0][0] == chain[-1][0]
        walls = cuts.cut(d, overlap, guide, light)
        mask = cuts.cut_mask(d, overlap, guide, light)
        assert set(np.unique(mask)) == {0, 255} and flood(mask) == 2
        assert cuts.cut_cost(walls, down, right) == cheapest(down, right, chain[0], chain[-1], np.zeros((h + 1, w + 1), bool))
        # what the cost is of: the steps between pixels of different sides
        a, b = mask[:, 1:] != mask[:, :-1], mask[1:] != mask[:-1]
        assert down[:, 1:-1][a].sum() + right[1:-1][b].sum() == cuts.cut_cost(walls, down, right)
        # the border column and row outside the overlap stay on their sides
        assert mask[0, 0] == 255 and mask[-1, -1] == 0


def test_legs_through_an_overlap_with_holes():
    rnd = np.random.default_rng(9)
    for _ in range(60):
        h, w = rnd.integers(6, 24, 2)
        d, light = rnd.integers(0, 256, (h, w)), rnd.integers(0, 511, (h, w))
        overlap = rnd.random((h, w)) < 0.85
        guide = np.where(np.add.outer(np.arange(h), np.arange(w)) < rnd.integers(2, h + w - 2), 255, 0)
        down, right = cuts.step_costs(d, overlap, light)
        walls = cuts.cut(d, overlap, guide, light)
        mask = cuts.cut_mask(d, overlap, guide, light)
        assert set(np.unique(mask)) == {0, 255}
        stays = [cuts.legs(c, down, right) for c in cuts.chains(guide)]
        for wall, parts in zip(walls, stays):
            assert wall[0] == parts[0][1][0] and wall[-1] == parts[-1][1][-1]
            assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(wall, wall[1:]))
            assert len(set(wall)) == len(wall)  # legs share no corner
            for free, run in parts:
                if not free:
                    assert set(run) <= set(wall)
        assert cuts.cut_cost(walls, down, right) <= cuts.cut_cost(cuts.chains(guide), down, right)
        assert flood(mask) == 2


def test_any_guide_and_closed_borders():
    rnd = np.random.default_rng(4)
    for _ in range(40):
        h, w = rnd.integers(2, 16, 2)
        guide = np.where(rnd.random((h, w)) < rnd.choice([0.1, 0.5]), 255, 0)
        mask = cuts.cut_mask(rnd.integers(0, 256, (h, w)), rnd.random((h, w)) < 0.7, guide, rnd.integers(0, 511, (h, w)))
        assert set(np.unique(mask)) == set(np.unique(guide))
    guide = np.zeros((9, 9), int)
    guide[3:6, 3:6] = 255  # closed in itself: stays
    assert (cuts.cut_mask(rnd.integers(0, 256, (9, 9)), np.ones((9, 9), bool), guide, np.zeros((9, 9), int)) == guide).all()
    assert (cuts.cut_mask(np.ones((1, 1)), np.ones((1, 1), bool), np.array([[255]]), np.ones((1, 1), int)) == 255).all()


def test_regions_equal_a_flood_fill():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        image = rnd.integers(0, 2, rnd.integers(1, 30, 2))
        number = cuts.regions(image[:, 1:] == image[:, :-1], image[1:] == image[:-1])
        assert len(np.unique(number)) == flood(image)
        assert ((number[:, 1:] == number[:, :-1]) == (image[:, 1:] == image[:, :-1])).all()


def test_lines_exclude_their_end_and_pay_for_what_they_lack():
    cost = np.full((9, 9), 3)
    of = lambda a, b: int(seams.line_costs(cost, np.array([a]), np.array([b]))[0])
    assert of((0, 0), (3, 0)) == 3 * 3 + 255 * 5 and of((0, 0), (8, 4)) == 8 * 3 and of((4, 4), (4, 4)) == 255 * 8
    assert of((-2, 0), (6, 0)) == 2 * 255 + 6 * 3
    at, on = seams.raster(np.array([(0, 0), (5, 5), (1, 1)]), np.array([(4, 2), (2, 6), (1, 1)]))
    assert [tuple(p) for p in at[0][on[0]]] == [(0, 0), (1, 0), (2, 1), (3, 1)] and [tuple(p) for p in at[1][on[1]]] == [(5, 5), (4, 5), (3, 5)] and not on[2].any()


def test_states_stop_at_the_first_blocked_pixel():
    cost = np.full((60, 60), 10)
    cost[:, 33] = 255
    found, far = seams.states(cost, (30, 20), (30, 30), (30, 40), 8)
    assert (found[:, 0] < 33).all() and (found[:, 1] == 30).all() and (30, 30) in map(tuple, found) and (far == np.abs(found[:, 0] - 30) // 2).all()
    assert found[:, 0].min() < 20
    still, _ = seams.states(cost, (30, 30), (30, 30), (30, 30))
    assert still.tolist() == [[30, 30]]


def plain_anneal(cost, contour, wd=12.0, wm=1.0, tau=0.75, hot=7000.0, cold=5.0, k_max=32):
    """One vertex and one pair of states after the other."""
    n = len(contour)
    line = lambda a, b: int(seams.line_costs(cost, np.array([a]), np.array([b]))[0])
    spots = [[list(map(int, p)) for p in seams.states(cost, contour[i - 1][1:], (x, y), contour[(i + 1) % n][1:], k_max)[0]] if m else [[x, y]] for i, (m, x, y) in enumerate(contour)]
    far = [[max(abs(p[0] - x), abs(p[1] - y)) // 2 for p in s] for s, (_, x, y) in zip(spots, contour)]
    prob = [[1 / len(s)] * len(s) for s in spots]
    mean = lambda: [tuple(math.floor(sum(q * p[c] for q, p in zip(ps, s)) + 0.5) for c in (0, 1)) for ps, s in zip(prob, spots)]
    at, k = mean(), max(map(len, spots))
    wd, wm = 2 * wd / (wd + wm), 2 * wm / (wd + wm)
    t, stop = (math.ceil(hot / math.log(k / (k - 2))), cold / math.log(k * k - k - 1)) if k > 2 else (hot, cold)
    while t > stop and k > 1:
        for _ in range(max(1, math.ceil(math.log(1 / k) / math.log(min(1 - 1e-9, (k - 2) / (2 * k) * math.exp(-t / hot) + 0.5))))):
            new = []
            for i, (s, f, p) in enumerate(zip(spots, far, prob)):
                e = [(wd * d + wm * (line(at[i - 1], q) + line(q, at[(i + 1) % n]))) / t for q, d in zip(s, f)]
                q = [(p[j] + sum((p[i] + p[j]) / (1 + math.exp(max(-700, min(700, e[j] - e[i])))) for i in range(len(s)) if i != j)) / len(s) for j in range(len(s))]
                new.append([v / sum(q) for v in q])
            prob, at = new, None
            at = mean()
        for i in range(n):
            least = 0.5 if max(prob[i]) > 0.99 else 1e-5
            keep = [j for j, p in enumerate(prob[i]) if p >= least]
            total = sum(prob[i][j] for j in keep)
            spots[i], far[i], prob[i] = [spots[i][j] for j in keep], [far[i][j] for j in keep], [prob[i][j] / total for j in keep]
        at, k = mean(), max(map(len, spots))
        t *= tau
    return at


@pytest.mark.parametrize("k_max", [4, 6])
def test_annealing_equals_one_vertex_after_the_other(k_max):
    rnd = random.Random(k_max)
    cost = np.array([[rnd.randint(0, 254) for _ in range(14)] for _ in range(12)])
    contour = [(False, 0, 6), (True, 3, 6), (True, 6, 5), (True, 9, 7), (False, 13, 6)]
    moved = seams.anneal(cost, contour, k_max=k_max)
    assert [v[1:] for v in moved] == plain_anneal(cost, contour, k_max=k_max)


def test_two_states_cool_down():
    cost = np.full((6, 9), 250)
    cost[3, :] = 1
    contour = [(False, 0, 3), (True, 4, 4), (False, 8, 3)]
    found, _ = seams.states(cost, (0, 3), (4, 4), (8, 3), 3)
    assert len(found) >= 2
    moved = seams.anneal(cost, contour, 1.0, 12.0, k_max=3)
    assert moved[1][2] == 3


def test_many_vertices_anneal_in_time():
    rnd = np.random.default_rng(0)
    cost = rnd.integers(0, 255, (400, 400))
    turn = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    contour = [(True, int(200 + 150 * math.cos(a)), int(200 + 150 * math.sin(a))) for a in turn]
    began = time.perf_counter()
    moved = seams.anneal(cost, contour)
    assert time.perf_counter() - began < 60 and len(moved) == 400


def test_default_options_depend_on_the_images():
    fine = BlendConfig().for_images(100)
    assert (fine.coarse_factor, fine.optimizers, fine.vectorize_distance) == (1, (), 20)
    coarse = BlendConfig().for_images(8 * 64)
    assert (coarse.coarse_factor, coarse.optimizers, coarse.vectorize_distance) == (8, ("anneal", "dijkstra"), 4)
    assert BlendConfig(seam="nearest").for_images(100).optimizers == ("anneal", "dijkstra")
    assert BlendConfig(coarse_factor=1, vectorize_distance=3).for_images(9) == BlendConfig(coarse_factor=1, vectorize_distance=3)
    for bad in ({"difference": "other"}, {"luminance_weight": 0, "chrominance_weight": 0}, {"luminance_weight": -1}):
        with pytest.raises(ValueError):
            BlendConfig(**bad)


def test_line_relations_equal_the_kernels(spark):
    rnd = np.random.default_rng(3)
    image = rnd.integers(0, 255, (9, 11))
    ends = rnd.integers(-2, 12, (60, 4))
    raster = spark.createDataFrame([(0, x, y, int(image[y, x])) for y in range(9) for x in range(11)], "image_id long, x long, y long, v long")
    given = spark.createDataFrame([(0, i, *map(int, e)) for i, e in enumerate(ends)], "image_id long, line long, ax long, ay long, bx long, by long")
    got = {r.line: r.cost for r in lines.costs(given, raster, ["image_id", "line"], ["image_id"]).collect()}
    want = seams.line_costs(image, ends[:, :2], ends[:, 2:])
    assert got == dict(enumerate(want.tolist()))
    at, on = seams.raster(ends[:, :2], ends[:, 2:])
    found = {(r.line, r.ord): (r.x, r.y) for r in lines.pixels(given, ["line"]).collect()}
    assert found == {(i, t): tuple(map(int, at[i, t])) for i in range(60) for t in np.nonzero(on[i])[0]}


def test_contours_annealed_side_by_side_end_where_each_ends_alone():
    rnd = np.random.default_rng(5)
    images = [rnd.integers(0, 256, (8, 8)) for _ in range(12)] + [rnd.integers(0, 256, (23, 17)), np.zeros((3, 3), np.int64)]
    jobs = [(image, contour) for image in images for contour in seams.vectorise(np.where(image > 128, 255, 0), 2)]
    together = seams.anneal_all(jobs)
    assert together == [seams.anneal(*job) for job in jobs]
    assert together != [contour for _, contour in jobs]
    whole = [(image, np.ones_like(image, bool), np.where(np.arange(image.shape[1]) < 2, 255, 0) * np.ones((len(image), 1), int), image) for image in images[:6]]
    for mask, one in zip(cuts.create_masks(whole, 2, graph_cut=True), whole):
        assert (mask == cuts.create_mask(*one, 2, graph_cut=True)).all()
    assert seams.anneal_all([]) == [] and cuts.create_masks([]) == []


def test_small_images_come_to_a_kernel_together(spark, monkeypatch):
    monkeypatch.setattr(seams, "PLACES_AT_ONCE", 40)
    rows = [(i, x, y, i * 100 + y * 10 + x) for i in range(30) for x in range(1 + i % 4) for y in range(1 + i % 3)]
    df = spark.createDataFrame([(None, 0, 0, 7), *rows], "image_id long, x long, y long, v long").repartition(1)

    def alone(image):
        return [(x, y, int(image[y, x]), 1) for y in range(image.shape[0]) for x in range(image.shape[1])]

    got = seams.per_images(df, ["image_id"], lambda images: [[(x, y, v, len(images)) for x, y, v, _ in alone(i)] for i in images], "x long, y long, v long, n long").collect()
    one = seams.per_image(df, ["image_id"], alone, "x long, y long, v long, n long").collect()
    assert sorted((str(r.image_id), *r[1:4]) for r in got) == sorted((str(r.image_id), *r[1:4]) for r in one)
    assert max(r.n for r in got) > 1
