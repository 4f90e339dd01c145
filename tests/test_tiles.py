"""Tiles give what the pixel form gives, whatever their side."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import planes
from tessera.operators import cuts, paths, pyramid, regions, seams, tiles, windows

KEYS = ["image_id"]


def pixels(spark, sizes, seed=0, top=256):
    rnd = np.random.default_rng(seed)
    rows = [(i, x, y, int(rnd.integers(-top, top)), bool(rnd.random() < 0.7)) for i, (w, h) in enumerate(sizes) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, x long, y long, v long, alpha boolean")


def cells(df, *names):
    return sorted(tuple(r) for r in df.select(*KEYS, "x", "y", *names).collect())


SIZES = [(1, 1), (2, 3), (9, 5), (17, 16), (8, 8)]


@pytest.mark.parametrize("side", [4, 8, 64])
def test_pack_and_unpack(spark, side):
    df = pixels(spark, SIZES)
    t = tiles.pack(df, KEYS, ["v"], ["alpha"], side)
    assert cells(tiles.unpack(t, KEYS, ["v", "alpha"], side), "v", "alpha") == cells(df, "v", "alpha")
    assert t.agg(F.max(F.size("v"))).first()[0] <= side * side


@pytest.mark.parametrize("side", [4, 64])
@pytest.mark.parametrize("wrap", [False, True])
@pytest.mark.parametrize("alpha", [None, "alpha"])
def test_levels_equal_the_pixel_form(spark, side, wrap, alpha):
    if wrap and not alpha:
        pytest.skip("the pixel form has no plain ring")
    df = pixels(spark, SIZES if not wrap else [(9, 5), (16, 6), (7, 3)])
    names = ["v", *([alpha] if alpha else [])]
    t = tiles.pack(df, KEYS, ["v"], [alpha] if alpha else [], side)
    want = pyramid.gaussian(df, KEYS, ["v"], 3, alpha, wrap)
    got = tiles.gaussian(t, KEYS, ["v"], 3, alpha, wrap, side)
    for a, b in zip(got, want, strict=True):
        assert cells(tiles.unpack(a, KEYS, names, side), *names) == cells(b, *names)
    want = pyramid.laplacian(df, KEYS, ["v"], 3, alpha, wrap)
    got = tiles.laplacian(t, KEYS, ["v"], 3, alpha, wrap, side)
    for a, b in zip(got, want, strict=True):
        assert cells(tiles.unpack(a, KEYS, ["v"], side), "v") == cells(b, "v")
    back = tiles.unpack(tiles.collapse(got, KEYS, ["v"], wrap, side), KEYS, ["v"], side)
    assert cells(back, "v") == cells(df, "v")


@pytest.mark.parametrize("side", [4, 64])
def test_blends_equal_the_pixel_form(spark, side):
    white, black = pixels(spark, [(13, 9)], 1), pixels(spark, [(13, 9)], 2)
    m = white.select("image_id", "x", "y", F.when(F.col("x") < 6, 255).otherwise(0).cast("long").alias("m"))
    want = pyramid.collapse(pyramid.blend_levels(pyramid.gaussian(m, KEYS, ["m"], 2), pyramid.laplacian(white, KEYS, ["v"], 2, "alpha"), pyramid.laplacian(black, KEYS, ["v"], 2, "alpha"), KEYS, ["v"]), KEYS, ["v"])
    p = lambda df, flags: tiles.pack(df, KEYS, [c for c in df.columns if c in "vm"], flags, side)
    mixed = tiles.blend_levels(tiles.gaussian(p(m, []), KEYS, ["m"], 2, side=side), *(tiles.laplacian(p(d, ["alpha"]), KEYS, ["v"], 2, "alpha", side=side) for d in (white, black)), KEYS, ["v"])
    got = tiles.unpack(tiles.collapse(mixed, KEYS, ["v"], side=side), KEYS, ["v"], side)
    assert cells(got, "v") == cells(want, "v")


def test_stacks_are_summed_in_order_of_arrival(spark):
    df = pixels(spark, [(9, 5)] * 5).withColumn("m", F.col("x") * 20 % 256)
    t = tiles.pack(df, KEYS, ["v", "m"], side=4).withColumn("scene", F.col("image_id") % 2).drop("image_id")
    got = tiles.unpack(tiles.weighted_sum(t, ["scene"], ["v"], "m", 255, 4), ["scene"], ["v"], 4)
    p = F.col("v") * F.col("m") / 255
    want = df.groupBy((F.col("image_id") % 2).alias("scene"), "x", "y").agg(F.sum(F.when(p >= 0, F.floor(p + 0.5)).otherwise(F.ceil(p - 0.5))).alias("v"))
    order = lambda d: sorted(tuple(r) for r in d.select("scene", "x", "y", "v").collect())
    assert order(got) == order(want)


def test_empty(spark):
    df = pixels(spark, [])
    t = tiles.pack(df, KEYS, ["v"], ["alpha"])
    assert tiles.unpack(tiles.collapse(tiles.laplacian(t, KEYS, ["v"], 3, "alpha"), KEYS, ["v"]), KEYS, ["v"]).count() == 0


def test_regions_across_tiles_equal_one_array(spark):
    rnd = np.random.default_rng(1)
    images = [rnd.integers(0, 2, (9, 13)), (np.add.outer(np.arange(30), np.arange(41)) // 3) % 2, rnd.integers(0, 2, (1, 20)), np.zeros((10, 10), int)]
    rows = [(i, x, y, int(v)) for i, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    got = {(r.image_id, r.x, r.y): r.region for r in regions.connected(spark.createDataFrame(rows, "image_id long, x long, y long, v long"), KEYS, "v", 4).collect()}
    want = {}
    for i, image in enumerate(images):
        number = cuts.regions(image[:, 1:] == image[:, :-1], image[1:] == image[:-1])
        first = {}
        for (y, x), n in np.ndenumerate(number):
            want[i, x, y] = first.setdefault(n, y * regions.WIDE + x)
    assert got == want


def dijkstra(cost, source):
    h, w = cost.shape
    best, queue = {source: 0}, [(0, source)]
    while queue:
        c, (x, y) = heapq.heappop(queue)
        if c > best[x, y]:
            continue
        for dx, dy in paths.AROUND:
            p = x + dx, y + dy
            if 0 <= p[0] < w and 0 <= p[1] < h:
                k = seams.step_cost(int(cost[p[1], p[0]])) * (14 if dx and dy else 10) // 10
                if c + k < best.get(p, 1 << 62):
                    best[p] = c + k
                    heapq.heappush(queue, (c + k, p))
    return best


def test_relaxing_a_tile_equals_dijkstra():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        image = rnd.integers(0, 256, rnd.integers(1, 14, 2))
        d = np.full((image.shape[0] + 2, image.shape[1] + 2), paths.FAR)
        d[1, 1] = 0
        got = paths.relax(d, paths.pixels_entered({"cost": image}))[1:-1, 1:-1]
        assert {(x, y): v for (y, x), v in np.ndenumerate(got)} == dijkstra(image, (0, 0))


def test_paths_across_tiles_equal_dijkstra(spark):
    rnd = np.random.default_rng(2)
    images = [rnd.integers(0, 256, (11, 9)), np.where(rnd.random((14, 14)) < 0.4, 255, 1)]
    rows = [(i, x, y, int(v)) for i, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    df = spark.createDataFrame(rows, "image_id long, x long, y long, cost long")
    ends = [(0, 8, 10, 0, 0), (1, 0, 13, 13, 0)]
    want = [dijkstra(images[i], (x2, y2)) for i, _, _, x2, y2 in ends]
    sources = spark.createDataFrame([(i, x2, y2) for i, _, _, x2, y2 in ends], "image_id long, x long, y long")
    got = {(r.image_id, r.x, r.y): r.d for r in paths.distances(df, KEYS, ["cost"], sources, side=4).collect()}
    assert got == {(i, *p): v for i, best in enumerate(want) for p, v in best.items()}
    walked = sorted(tuple(r) for r in paths.cheapest(df, KEYS, ["cost"], spark.createDataFrame(ends, "image_id long, x long, y long, x2 long, y2 long"), side=4).collect())
    for i, x, y, x2, y2 in ends:
        path = [r[2:] for r in walked if r[0] == i]
        assert path[0] == (x, y) and path[-1] == (x2, y2) and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:]))
        assert sum(seams.step_cost(int(images[i][a[1], a[0]])) * (14 if a[0] != b[0] and a[1] != b[1] else 10) // 10 for a, b in zip(path, path[1:])) == want[i][x, y]


def test_corners_are_searched_along_their_steps():
    rnd = np.random.default_rng(3)
    shape = (7, 9)
    down, right = cuts.step_costs(rnd.integers(0, 256, shape), rnd.random(shape) < 0.9, rnd.integers(0, 511, shape))
    near = lambda c: np.where(c >= cuts.CLOSED, paths.CLOSED, c)
    shut = np.full((8, 10), paths.CLOSED)
    planes = {n: shut.copy() for n in ("up", "down", "left", "right")}
    planes["up"][1:], planes["down"][:-1], planes["left"][:, 1:], planes["right"][:, :-1] = near(down), near(down), near(right), near(right)
    d = np.full((10, 12), paths.FAR)
    d[1, 5] = 0
    got = paths.relax(d, paths.corners_entered(planes))[1:-1, 1:-1]
    for end in ((4, 7), (2, 3), (9, 4)):
        way = cuts.cheapest_corners(down, right, (4, 0), end, np.zeros((8, 10), bool))
        assert (got[end[1], end[0]] >= paths.CLOSED) if way is None else got[end[1], end[0]] == cuts.cut_cost([way], down, right)


@pytest.mark.parametrize("half", [1, 2, 6])
def test_sliding_entropy_equals_each_window(half):
    rnd = np.random.default_rng(half)
    image, valid = rnd.integers(0, 6, (15, 17)), rnd.random((15, 17)) < 0.7
    got = windows.sliding_entropy(image, valid, half)
    for (y, x), e in np.ndenumerate(got):
        want = 0.0
        if half <= y < 15 - half and half <= x < 17 - half:
            cut = np.s_[y - half : y + half + 1, x - half : x + half + 1]
            _, c = np.unique(image[cut][valid[cut]], return_counts=True)
            p = c / max(c.sum(), 1)
            want = float(-(p * np.log(p)).sum() / np.log(len(c))) if len(c) > 1 else 0.0
        assert e == pytest.approx(want, abs=1e-9)


def test_entropy_across_tiles(spark):
    df = pixels(spark, [(19, 13), (4, 30)], top=5)
    of = lambda side: sorted((r.image_id, r.x, r.y, round(r.entropy, 9)) for r in windows.local_entropy(df, KEYS, 5, side=side).collect())
    assert of(4) == of(64) and {r[0] for r in of(64)} == {0}


def test_planes_there_and_back(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, *map(int, c)) for i, c in enumerate([*rnd.integers(0, 256, (200, 3)), (0, 0, 0), (255, 255, 255), (255, 0, 0)])]
    df = spark.createDataFrame(rows, "i long, r long, g long, b long")
    rgb = tuple(map(F.col, "rgb"))
    for space, kind, most in (("identity", "uint8", 0), ("lab", "uint8", 12), ("luv", "uint8", 16), ("jch", "uint8", 1)):
        p = df.select("*", *(c.alias(f"p{i}") for i, c in enumerate(planes.into(rgb, space, kind))))
        back = p.select("*", *(c.alias(f"o{n}") for n, c in zip("rgb", planes.out(tuple(F.col(f"p{i}") for i in range(3)), space, kind)))).collect()
        # planes of 8-bit Lab and Luv have steps of some units of colour
        miss = [abs(r[c] - r[f"o{c}"]) for r in back for c in "rgb"]
        assert sum(miss) / len(miss) <= most / 3 and all(0 <= r[f"o{c}"] <= 255 for r in back for c in "rgb"), space
        assert len(back) == len(rows) and dict(p.dtypes)["p0"] == "bigint"
    with pytest.raises(ValueError):
        planes.into((F.col("r"),), "lab")
    with pytest.raises(ValueError):
        planes.into(rgb, "other")
    assert planes.top("uint16") == 65_535


def test_colours_outside_the_gamut_lose_chroma_only():
    light, one, two = np.array([50.0, 60.0, 30.0]), np.array([5.0, 150.0, -150.0]), np.array([5.0, 150.0, 120.0])
    rgb = planes.fitted(light, one, two, planes._lab_back)
    assert ((rgb >= 0) & (rgb <= 1)).all() and np.allclose(rgb[:, 0], planes._lab_back(light, one, two)[:, 0])
    # the same hue and lightness with a little more chroma does not fit
    for k in (1, 2):
        shares = np.linspace(0, 1, 2000)
        fits = np.array([max(-c.min(), c.max() - 1) <= planes.TOLERANCE for c in (planes._lab_back(light[k : k + 1], one[k : k + 1] * t, two[k : k + 1] * t) for t in shares)])
        best = shares[np.argmin(fits) - 1]
        assert np.abs(rgb[:, k] - np.clip(planes._lab_back(light[k : k + 1], one[k : k + 1] * best, two[k : k + 1] * best)[:, 0], 0, 1)).max() < 0.01
