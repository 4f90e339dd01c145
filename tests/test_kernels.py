"""Kernels against plain twins, and the properties that pyramids, masks and codecs must have."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import appearance, exposure, minimise, scalar
from tessera.operators import cuts, masks, pyramid, seams, stack
from tessera.plans import blend, fuse
from tessera.plans.config import BlendConfig, FuseConfig, Parameters, override
from tessera.sources import catalog, images


def image(rnd, w, h, top=256):
    return np.array([[rnd.randrange(top) for _ in range(w)] for _ in range(h)])


def frame(spark, px, **more):
    h, w = px.shape
    rows = [(0, x, y, int(px[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, x long, y long, v long").withColumns({k: F.lit(v) for k, v in more.items()})


def bellman_ford(cost, end):
    h, w = cost.shape
    best = {(x, y): 1 << 60 for x in range(w) for y in range(h)}
    best[end] = 0
    for _ in range(w * h):
        changed = False
        for (x, y), d in list(best.items()):
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    p = (x + dx, y + dy)
                    if (dx or dy) and p in best:
                        c = seams.step_cost(int(cost[p[1], p[0]]))
                        nd = d + (int(c * 1.4) if dx and dy else c)
                        if nd < best[p]:
                            best[p], changed = nd, True
        if not changed:
            return best


def test_cheapest_path_is_cheapest():
    rnd = random.Random(1)
    for _ in range(20):
        cost = image(rnd, 7, 6)
        path = [(0, 0), *seams.cheapest_path(cost, (0, 0), (6, 5)), (6, 5)]
        assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:]))
        total = 0
        for a, b in zip(path[::-1], path[::-1][1:]):
            c = seams.step_cost(int(cost[b[1], b[0]]))
            total += int(c * 1.4) if a[0] != b[0] and a[1] != b[1] else c
        assert total == bellman_ford(cost, (6, 5))[0, 0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_boundary_encloses_the_region(seed):
    rnd = random.Random(seed)
    mask = image(rnd, rnd.randint(1, 7), rnd.randint(1, 7), 2)
    inside = np.zeros_like(mask)
    for contour in seams.boundary(mask):
        ring = [*contour, contour[0]]
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(ring, ring[1:]))
        for y in range(mask.shape[0]):
            for x in range(mask.shape[1]):  # crossings of vertical cracks to the left
                inside[y, x] ^= sum(a[0] == b[0] and a[0] <= x and min(a[1], b[1]) == y for a, b in zip(ring, ring[1:])) % 2
    assert (inside == mask).all()


def along(cost, contour):
    at = np.array([v[1:] for v in contour])
    return int(seams.line_costs(cost, at[:-1], at[1:]).sum())


def test_line_annealing_and_runs():
    cost = np.full((20, 20), 200)
    cost[6, :] = 1
    start = [(False, 0, 6)] + [(True, x, 10) for x in (4, 8, 12, 16)] + [(False, 19, 6)]
    before = along(cost, start)
    moved = seams.anneal(cost, start, distance_weight=1, mismatch_weight=12)
    assert moved[0] == start[0] and moved[-1] == start[-1]
    assert along(cost, moved) <= before
    p = seams.update(np.full(4, 0.25), seams.preferences(np.array([0.0, 1, 2, 3])))
    assert abs(p.sum() - 1) < 1e-12 and p[0] == p.max()
    runs = seams.movable_runs(start)
    assert len(runs) == 1 and len(runs[0]) == 6
    assert seams.drop_blocked(np.full((3, 3), 255), [(True, 1, 1), (False, 0, 0)]) == [(False, 0, 0)]
    assert seams.segments_cross((0, 0), (4, 4), (0, 4), (4, 0)) and not seams.segments_cross((0, 0), (1, 1), (2, 2), (3, 3))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.none()), min_size=1, max_size=30))
def test_envelope_equals_brute_force(values):
    f = np.array([np.inf if v is None else float(v) for v in values])
    want = [min((p - q) ** 2 + f[q] for q in range(len(f))) for p in range(len(f))]
    assert np.allclose(masks.envelope(f), want, equal_nan=True)


def test_distance_on_wide_rows(spark):
    rnd = random.Random(2)
    px = image(rnd, 150, 3, 40)
    got = {(r.x, r.y): r.d for r in masks.distance_transform(frame(spark, px), ["image_id"], F.col("v") == 0).collect()}
    on = [(x, y) for y in range(3) for x in range(150) if px[y, x] == 0]
    assert all(got[x, y] == min((x - a) ** 2 + (y - b) ** 2 for a, b in on) for x in range(150) for y in range(3))


@pytest.mark.parametrize(("w", "h", "levels"), [(2, 2, 2), (7, 5, 3), (12, 9, 3), (1, 6, 2)])
def test_laplacian_collapses_to_the_image(spark, w, h, levels):
    rnd = random.Random(w)
    px = image(rnd, w, h)
    df = frame(spark, px).withColumn("alpha", F.col("v") > 90)
    for alpha in ("alpha", None):
        back = pyramid.collapse(pyramid.laplacian(df if alpha else df.drop("alpha"), ["image_id"], ["v"], levels, alpha), ["image_id"], ["v"])
        assert {(r.x, r.y): r.v for r in back.collect()} == {(x, y): px[y, x] for x in range(w) for y in range(h)}


def test_constant_images_and_sides(spark):
    df = frame(spark, np.full((5, 9), 77)).withColumn("alpha", F.lit(True))
    for level in pyramid.gaussian(df, ["image_id"], ["v"], 3, "alpha") + pyramid.gaussian(df.drop("alpha"), ["image_id"], ["v"], 3):
        assert {r.v for r in level.collect()} == {77}
    wrapped = pyramid.laplacian(frame(spark, np.full((4, 8), 9)).withColumn("alpha", F.lit(True)), ["image_id"], ["v"], 2, "alpha", wrap=True)
    assert {r.v for r in wrapped[0].collect()} == {0}
    assert [pyramid.filter_half_width(i) for i in (1, 2, 3)] == [0, 4, 12]
    assert [pyramid.natural_levels(s) for s in (8, 9, 16, 17, 100)] == [1, 2, 2, 3, 5] and pyramid.natural_levels(100, 2) == 2 and pyramid.natural_levels(100, -3) == 2


def test_fusion_and_blending_stay_in_range(spark):
    rows = [(0, o, x, y, (x * 13 + y * 7 + o * 60) % 256) for o in range(3) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(rows, "scene_id long, ord long, x long, y long, v long")
    out = {(r.x, r.y): r.v for r in fuse.fuse(df, ["scene_id"], FuseConfig(levels=1)).collect()}
    for x in range(8):
        for y in range(8):
            vs = [(x * 13 + y * 7 + o * 60) % 256 for o in range(3)]
            assert min(vs) - 2 <= out[x, y] <= max(vs) + 2
    hard = fuse.fuse(df, ["scene_id"], FuseConfig(hard_mask=True, levels=1)).collect()
    assert len(hard) == 64
    masked = stack.hard_mask(df.withColumn("w", F.lit(0.0)), ["scene_id", "x", "y"])
    assert {round(r.m, 6) for r in masked.collect()} == {85.0}
    band = lambda a, b, c: [(0, x, y, c, True) for x in range(12) for y in range(a, b)]
    m = spark.createDataFrame([(0, *r) for r in band(0, 8, 40)] + [(1, *r) for r in band(5, 12, 90)], "ord long, mosaic_id long, x long, y long, v long, alpha boolean")
    got = blend.blend(m, ["mosaic_id"], 12, 12, 2, 2).collect()
    assert len(got) == 144 and all(r.alpha for r in got) and all(38 <= r.v <= 92 for r in got)
    assert all(r.v == 40 for r in got if r.y == 0) and all(r.v == 90 for r in got if r.y == 11)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([255, 65_535]), st.sampled_from([1, 3]))
def test_codecs_round_trip(seed, top, channels):
    rnd = np.random.default_rng(seed)
    shape = (int(rnd.integers(1, 9)), int(rnd.integers(1, 9))) + ((3,) if channels == 3 else ())
    px = rnd.integers(0, top + 1, shape)
    for encode in (images.encode_pnm, images.encode_png):
        back, t = images.decode(encode(px, top))
        assert t == top and (back == px).all()


def test_image_files(spark, tmp_path):
    px = np.arange(12).reshape(3, 4) * 20
    (tmp_path / "a.png").write_bytes(images.encode_png(px))
    (tmp_path / "b.ppm").write_bytes(images.encode_pnm(np.stack([px, px, px + 1], axis=-1)))
    got = images.read_images(spark, str(tmp_path / "*.p*"))
    assert got.count() == 24 and got.filter("file like '%a.png' and r <> y * 80 + x * 20").count() == 0
    assert images.load_mask(spark, str(tmp_path / "a.png"), 4, 3).count() == 12
    with pytest.raises(ValueError):
        images.load_mask(spark, str(tmp_path / "a.png"), 5, 3)
    with pytest.raises(ValueError):
        images.load_mask(spark, str(tmp_path / "b.ppm"), 4, 3)


def test_response_files(tmp_path):
    (tmp_path / "one.tif").write_text("")
    (tmp_path / "two.tif").write_text("")
    (tmp_path / "inner.txt").write_text("# layer-selector: last\none.tif\n")
    (tmp_path / "list.txt").write_text("# a comment\n@inner.txt\n# glob: wildcard\n*.tif # all\nx.tif[2]\n")
    got = [(f.split("/")[-1], s) for f, s, _ in catalog.unfold(f"@{tmp_path}/list.txt")]
    assert got == [("one.tif", "last"), ("one.tif", "all"), ("two.tif", "all"), ("x.tif", "2")]
    (tmp_path / "loop.txt").write_text("@loop.txt\n")
    with pytest.raises(ValueError):
        catalog.unfold(f"@{tmp_path}/loop.txt")
    assert catalog.looks_like_response_file(f"{tmp_path}/list.txt")
    (tmp_path / "prose.txt").write_text("just words\nand more words\n")
    assert not catalog.looks_like_response_file(f"{tmp_path}/prose.txt")
    with pytest.raises(ValueError):
        catalog.parse_indices("a")
    with pytest.raises(ValueError):
        catalog.parse_indices("0")
    with pytest.raises(ValueError):
        catalog.parse_geometry("40")


def test_options():
    assert scalar.Amount.parse("50%").of(200) == 100 and scalar.Amount.parse("-10").of(255) == 245
    with pytest.raises(ValueError):
        scalar.Amount.parse("x")
    with pytest.raises(ValueError):
        FuseConfig(exposure_weight=2)
    with pytest.raises(ValueError):
        BlendConfig(wrap="sideways")
    p = Parameters.parse("a=3:b=0.5:c")
    assert (p.integer("a", 0), p.real("b", 0), p.flag("c", False), p.flag("d", True)) == (3, 0.5, True, True)


def test_weights_and_minimisers(spark):
    assert all(exposure.validate(spark, n).first().valid for n in ("gauss", "lorentz", "halfsine", "fullsine", "bisquare"))
    exposure.register_weight("bad", lambda z: z * 0 - 1)
    assert not exposure.validate(spark, "bad", n=100).first().valid
    with pytest.raises(ValueError):
        exposure.weight("nope", F.lit(0.5))
    f = lambda x: (x - 1.25) ** 2 + 3
    assert abs(minimise.golden_section(f, -4, 9)[0] - 1.25) < 1e-4 and abs(minimise.brent(f, -4, 9)[0] - 1.25) < 1e-4
    x, v = minimise.nelder_mead(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2, np.array([5.0, 5.0]))
    assert np.allclose(x, [1, -2], atol=1e-3) and v < 1e-5


def test_appearance_model():
    rnd = np.random.default_rng(0)
    rgb = rnd.random((3, 200))
    jch = appearance.to_jch(rgb)
    assert np.allclose(appearance.from_jch(jch), rgb, atol=1e-4)
    white = appearance.to_jch(np.ones((3, 1)))
    assert abs(white[0, 0] - 100) < 0.1 and white[1, 0] < 3  # adaptation is not complete
    wild = jch.copy()
    wild[1] *= 2
    fixed = appearance.from_jch(wild)
    assert (fixed >= 0).all() and (fixed <= 1).all()


def test_brent_of_rows_equals_brent():
    k = np.linspace(-3, 8, 40)
    f = lambda i, x: np.abs(x - k[i]) + np.maximum(x - 2, 0) * 50
    rows = minimise.brent_rows(f, np.full(40, -4.0), np.full(40, 9.0))
    one = [minimise.brent(lambda x, i=i: float(f(np.array([i]), np.array([x]))[0]), -4.0, 9.0)[0] for i in range(40)]
    assert np.allclose(rows, one, atol=1e-9)


def test_gamut_repair_covers_every_pixel(spark, tmp_path):
    from tessera.plans.pixel_queries import c17
    from tessera.sources import fixtures

    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.random(64) - 0.5).tolist()) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    place = lambda df: {(r.image_id, r.x, r.y) for r in df.collect()}
    got = place(c17(spark, str(tmp_path)))
    assert len(got) == 128 and got == place(fixtures.rgb(spark, str(tmp_path)))


def test_stream_folds_like_a_batch(spark, tmp_path):
    from tessera.streaming import incremental

    rows = [(0, o, x, 0, o * 10 + x, x >= o) for o in range(3) for x in range(4)]
    schema = "mosaic_id long, ord long, x long, y long, v long, alpha boolean"
    for o in range(3):
        spark.createDataFrame([r for r in rows if r[1] == o], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{o}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = incremental.fold_images(stream, ["mosaic_id"], str(tmp_path / "out"), incremental.overlay_step(["mosaic_id"]))
    q.awaitTermination(120)
    got = {r.x: r.v for r in incremental.latest(spark, str(tmp_path / "out"), 2).collect()}
    assert got == {0: 0, 1: 11, 2: 22, 3: 23}


def test_search_helpers():
    first = list(itertools.islice(minimise.random_sequence(), 2000))
    assert first == list(itertools.islice(minimise.random_sequence(), 2000)) and all(0 <= u < 1 for u in first) and 0.45 < sum(first) / 2000 < 0.55
    valley = lambda x: min((x - 7.0) ** 2, 4.0)
    assert abs(minimise.bracket(valley, 1.0, 0.0, 10.0) - 7) < 2 and minimise.bracket(valley, 6.5, 0.0, 10.0) == 6.5
    assert minimise.bracket(lambda x: -abs(x), 0.0, -1.0, 1.0) is None
    for n in (1, 2, 5, 8):
        got = minimise.spaced_starts(n, 0.0, 100.0, 30.0)
        assert len(got) == n == len(set(got)) and got[0] == 30 and all(0 <= x <= 100 for x in got) and (n < 3 or {0.0, 100.0} <= set(got))


def test_options_are_used_or_refused():
    with pytest.raises(ValueError):
        FuseConfig(exposure_weight=0)
    assert FuseConfig(exposure_weight=0, saturation_weight=1).saturation_weight == 1
    changed = override(FuseConfig(), Parameters.parse("contrast-window=7:hard-mask=yes:exposure-width=0.3:projector=value"))
    assert (changed.contrast_window, changed.hard_mask, changed.exposure_width, changed.projector) == (7, True, 0.3, "value")
    assert override(BlendConfig(), Parameters.parse("k-max=9")).k_max == 9
    for text in ("no-such-option=1", "optimizers=anneal"):
        with pytest.raises(ValueError):
            override(BlendConfig(), Parameters.parse(text))
    with pytest.raises(ValueError):
        BlendConfig(optimizers=("magic",))


def test_each_criterion_changes_the_score(spark):
    rnd = np.random.default_rng(2)
    rows = [(0, o, x, y, *map(int, rnd.integers(0, 256, 3)), bool(rnd.random() < 0.8)) for o in range(2) for x in range(9) for y in range(9)]
    df = spark.createDataFrame(rows, "scene_id long, ord long, x long, y long, r long, g long, b long, alpha boolean")
    of = lambda **kw: {(r.ord, r.x, r.y): r.w for r in fuse.score(df, ["scene_id", "ord"], FuseConfig(**kw), channels=fuse.RGB, alpha="alpha").collect()}
    plain = of()
    for kw in ({"saturation_weight": 0.5}, {"contrast_weight": 0.5}, {"contrast_weight": 0.5, "edge_scale": 0.6}, {"contrast_weight": 0.5, "edge_scale": 0.6, "min_curvature": 0.3}, {"contrast_weight": 0.5, "edge_scale": 0.6, "lce_scale": 0.7, "lce_factor": 2.0}, {"entropy_weight": 0.5}, {"projector": "value"}, {"exposure_lower": 0.2}, {"exposure_upper": 0.8}):
        assert of(**kw) != plain, kw
    assert of(contrast_weight=0.5, edge_scale=0.6) != of(contrast_weight=0.5, edge_scale=0.6, min_curvature=0.3)
    assert of(contrast_weight=0.5, edge_scale=0.6) != of(contrast_weight=0.5, edge_scale=0.6, lce_scale=0.7, lce_factor=2.0)
    assert of(contrast_weight=0.5, edge_scale=0.6) == pytest.approx(of(contrast_weight=0.5, edge_scale=0.6, lce_scale=0.7))  # no strength, no sharpening
    assert of(entropy_weight=0.5) != of(entropy_weight=0.5, entropy_lower=0.4, entropy_upper=0.6)
    with pytest.raises(ValueError):
        FuseConfig(entropy_lower=0.7, entropy_upper=0.6)
    assert all(plain[o, x, y] == 0 for _, o, x, y, *_, a in rows if not a)
    fused = fuse.fuse(df, ["scene_id"], FuseConfig(saturation_weight=0.3), 16, channels=fuse.RGB, alpha="alpha").collect()
    assert len(fused) == 81 and all(0 <= v <= 255 for r in fused for v in (r.r, r.g, r.b)) and all(r.r == r.g == r.b == 0 for r in fused if not r.alpha)


def two_images(spark, colour=False):
    """Two images that overlap in the middle of a wide canvas."""
    rnd = np.random.default_rng(5)
    value = lambda: tuple(map(int, rnd.integers(0, 256, 3 if colour else 1)))
    rows = [(0, o, x, y, *value(), bool(rnd.random() < 0.95)) for o, (a, b) in enumerate(((0, 60), (40, 96))) for x in range(a, b) for y in range(20)]
    names = "r long, g long, b long" if colour else "v long"
    return spark.createDataFrame(rows, f"mosaic_id long, ord long, x long, y long, {names}, alpha boolean")


def test_the_region_of_a_seam_gives_what_the_canvas_gives(spark, monkeypatch):
    df = two_images(spark)
    part = blend.blend(df, ["mosaic_id"], 96, 20, 2, 3).collect()
    region = blend._region
    monkeypatch.setattr(blend, "_region", lambda *a: region(*a).selectExpr("mosaic_id", "0L as x0", "0L as y0", "95L as x1", "19L as y1"))
    whole = blend.blend(df, ["mosaic_id"], 96, 20, 2, 3).collect()
    assert sorted(part) == sorted(whole) and len(part) == 96 * 20


@pytest.mark.parametrize("colour", [False, True])
def test_graph_cut_masks_equal_the_kernel_on_the_overlap(spark, colour):
    df = two_images(spark, colour)
    channels = ("r", "g", "b") if colour else ("v",)
    config = BlendConfig(optimizers=("dijkstra",), vectorize_distance=3, coarse_factor=2, smallest_coarse=1, dijkstra_radius=9)
    got = {(r.x, r.y): r.m for r in blend.blend(df, ["mosaic_id"], 96, 20, 2, 2, channels=channels, config=config, masks_only=True).collect()}
    near = {(r.x, r.y): r.m for r in blend.blend(df, ["mosaic_id"], 96, 20, 2, 2, channels=channels, masks_only=True).collect()}
    at = {(r.ord, r.x, r.y): r for r in df.filter("alpha").collect()}
    shared = [(x, y) for x in range(96) for y in range(20) if (0, x, y) in at and (1, x, y) in at]
    x0, x1 = min(x for x, _ in shared), max(x for x, _ in shared)
    y0, y1 = min(y for _, y in shared), max(y for _, y in shared)
    cost, guide, light = np.full((y1 - y0 + 1, x1 - x0 + 1), 255), *(np.zeros((y1 - y0 + 1, x1 - x0 + 1), int) for _ in range(2))
    for x in range(x0, x1 + 1):
        for y in range(y0, y1 + 1):
            guide[y - y0, x - x0] = near[x, y]
    if not colour:
        for x, y in shared:
            cost[y - y0, x - x0] = abs(at[0, x, y].v - at[1, x, y].v)
        every = {(r.ord, r.x, r.y): r.v for r in df.collect()}
        for x in range(x0, x1 + 1):
            for y in range(y0, y1 + 1):
                light[y - y0, x - x0] = every[0, x, y] + every[1, x, y]
        overlap = np.zeros(cost.shape, bool)
        overlap[[y - y0 for _, y in shared], [x - x0 for x, _ in shared]] = True
        mask = cuts.coarse_seam(cost, overlap, guide, light, 2, distance=3, chain=("dijkstra",), graph_cut=True, radius=9)
        assert all(got[x, y] == mask[y - y0, x - x0] for x, y in shared)
    assert all(got[p] == near[p] for p in got if p not in set(shared)) and set(got.values()) == {0, 255}


def test_pre_assembled_images_join_together(spark):
    rows = [(0, o, x, y, 50 * o + 10, True) for o, a in enumerate((0, 20, 8, 28)) for x in range(a, a + 10) for y in range(8)]
    df = spark.createDataFrame(rows, "mosaic_id long, ord long, x long, y long, v long, alpha boolean")
    steps = blend.blend(df, ["mosaic_id"], 40, 8, 4, 1, config=BlendConfig(seam="nearest", optimizers=(), pre_assemble=True), masks_only=True)
    assert {r.step for r in steps.filter("m > 0").select("step").distinct().collect()} == {1}
    assert {(r.a, r.b) for r in blend.overlaps(df, ["mosaic_id"]).collect()} == {(0, 2), (1, 3)}


def test_canvas_that_wraps_around(spark):
    rows = [(0, 0, x, 0, 10, True) for x in range(0, 10)] + [(0, 1, x, 0, 90, True) for x in [*range(8, 16), 0, 1]]
    df = spark.createDataFrame(rows, "mosaic_id long, ord long, x long, y long, v long, alpha boolean")
    of = lambda wrap: {r.x: r.m for r in blend.blend(df, ["mosaic_id"], 16, 1, 2, 1, config=BlendConfig(wrap=wrap, seam="nearest", optimizers=()), masks_only=True).collect()}
    assert of("none")[0] == 0 and of("horizontal")[0] == 255 and of("horizontal")[1] == 0
