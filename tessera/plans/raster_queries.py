"""Queries of windows, pyramids, aggregates, stacks and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import exposure
from tessera.operators import masks, pyramid, stack, tiles, windows
from tessera.operators import pixelwise as px
from tessera.plans.pixel_queries import _R, _weights, r6
from tessera.plans.registry import query
from tessera.sources import fixtures as fx

KEYS = ["image_id"]
PLACE = ["image_id", "x", "y"]

# Windows -------------------------------------------------------------------


def _window(k: int) -> str:
    return f"JOIN gray q ON q.image_id = p.image_id AND q.x BETWEEN p.x - {k} AND p.x + {k} AND q.y BETWEEN p.y - {k} AND p.y + {k}"


def _inner(k: int, t: str = "p") -> str:
    return f"{t}.x BETWEEN {k} AND {7 - k} AND {t}.y BETWEEN {k} AND {7 - k}"


@query("w01_local_stddev", f"SELECT p.image_id, p.x, p.y, {_R.format('coalesce(stddev_samp(q.v) FILTER (q.alpha), 0)')} AS stddev FROM gray p {_window(2)} WHERE p.alpha AND {_inner(2)} GROUP BY p.image_id, p.x, p.y", "gray")
def w01(spark, sf):
    return windows.local_stddev(fx.gray(spark, sf), KEYS, 5).withColumn("stddev", r6(F.col("stddev")))


@query(
    "w02_local_entropy",
    f""", c AS (SELECT p.image_id, p.x, p.y, q.v, count(*) AS c FROM gray p {_window(1)} WHERE p.alpha AND q.alpha AND {_inner(1)} GROUP BY ALL),
    t AS (SELECT image_id, x, y, sum(c) AS n, count(*) AS bins, sum(c * ln(c)) AS t FROM c GROUP BY ALL)
    SELECT image_id, x, y, CASE WHEN bins <= 1 THEN 0 ELSE {_R.format('(ln(n) - t / n) / ln(bins) * 255')} END AS entropy FROM t""",
    "gray",
)
def w02(spark, sf):
    return windows.local_entropy(fx.gray(spark, sf), KEYS, 3).withColumn("entropy", r6(F.col("entropy")))


def _kernel_sql(kernel: dict[tuple[int, int], float]) -> str:
    return "(VALUES " + ", ".join(f"({dx}, {dy}, {w!r}::DOUBLE)" for (dx, dy), w in kernel.items()) + ") k(dx, dy, w)"


_LOG = windows.laplacian_of_gaussian(0.7, 9)
_SHARP = windows.gaussian_sharpening(0.8, 0.5, 9)


def _r3(x: str) -> str:
    return f"floor(({x}) * 1e3 + 0.5) / 1e3"


def r3(c):
    return F.floor(c * 1e3 + 0.5) / 1e3


@query("w04_laplacian_of_gaussian", f"SELECT p.image_id, p.x, p.y, {_r3('abs(sum(k.w * q.v)) + 1e-7')} AS magnitude FROM gray p, {_kernel_sql(_LOG)} JOIN gray q ON q.image_id = p.image_id AND q.x = p.x + k.dx AND q.y = p.y + k.dy GROUP BY p.image_id, p.x, p.y", "gray")
def w04(spark, sf):
    return windows.convolve(fx.gray(spark, sf), KEYS, _LOG).select(*PLACE, r3(F.abs("out") + 1e-7).alias("magnitude"))


@query("w05_sharpened", f"SELECT p.image_id, p.x, p.y, {_r3('sum(k.w * q.v) / sum(k.w) + 1e-7')} AS v FROM gray p, {_kernel_sql(_SHARP)} JOIN gray q ON q.image_id = p.image_id AND q.x = p.x + k.dx AND q.y = p.y + k.dy GROUP BY p.image_id, p.x, p.y", "gray")
def w05(spark, sf):
    return windows.convolve(fx.gray(spark, sf), KEYS, _SHARP, normalise=True).select(*PLACE, r3(F.col("out") / sum(_SHARP.values()) + 1e-7).alias("v"))


@query(
    "w06_gradients",
    """SELECT image_id, x, y, coalesce((lead(v) OVER r - lag(v) OVER r) / 2, 0)::DOUBLE AS gx, coalesce((lead(v) OVER c - lag(v) OVER c) / 2, 0)::DOUBLE AS gy
    FROM gray WINDOW r AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)""",
    "gray",
)
def w06(spark, sf):
    return windows.gradients(fx.gray(spark, sf), KEYS)


@query("w07_plus_kernel", f"SELECT p.image_id, p.x, p.y, {_R.format('sum(k.w * q.v) / sum(k.w) * 5')} AS v FROM gray p, {_kernel_sql(windows.PLUS)} JOIN gray q ON q.image_id = p.image_id AND q.x = p.x + k.dx AND q.y = p.y + k.dy GROUP BY p.image_id, p.x, p.y", "gray")
def w07(spark, sf):
    return windows.convolve(fx.gray(spark, sf), KEYS, windows.PLUS, normalise=True).select(*PLACE, r6(F.col("out")).alias("v"))


_BINARY = ", bin AS (SELECT image_id, x, y, CASE WHEN v >= 90 THEN 255 ELSE 0 END::BIGINT AS m FROM gray)"


def _binary(spark, sf, name="m"):
    return fx.gray(spark, sf).select(*PLACE, F.when(F.col("v") >= 90, 255).otherwise(0).cast("long").alias(name))


@query(
    "w08_isolated_points",
    _BINARY + " SELECT image_id, x, y FROM bin p WHERE m = 0 AND NOT EXISTS (SELECT 1 FROM bin q WHERE q.image_id = p.image_id AND q.m = 0 AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND (q.x <> p.x OR q.y <> p.y))",
    "gray",
)
def w08(spark, sf):
    return windows.isolated_points(_binary(spark, sf, "v"), KEYS)


@query(
    "w09_transition_bounds",
    _BINARY
    + """, l AS (SELECT *, lag(m) OVER (PARTITION BY image_id, y ORDER BY x) <> m AS h, lag(m) OVER (PARTITION BY image_id, x ORDER BY y) <> m AS k FROM bin)
    SELECT image_id, min(CASE WHEN h THEN x - 1 ELSE x END) AS x0, min(CASE WHEN k THEN y - 1 ELSE y END) AS y0, max(x) AS x1, max(y) AS y1 FROM l WHERE h OR k GROUP BY image_id""",
    "gray",
)
def w09(spark, sf):
    return windows.transition_bounds(_binary(spark, sf), KEYS)


# Pyramids -------------------------------------------------------------------

_TAPS = "(VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))"


def _reduce_sql(src: str, n: int, values: tuple[str, ...] = ("v",), alpha: bool = True) -> str:
    """One level down of ``src`` (square images of side n)."""
    half = (n + 1) // 2
    if alpha:
        cols = ", ".join(f"CASE WHEN sum(k) > 0 THEN (sum(k * {v}) // sum(k))::BIGINT ELSE 0 END AS {v}" for v in values)
        return f"""SELECT image_id, i AS x, j AS y, {cols}, sum(k) > 0 AS alpha FROM (
            SELECT s.image_id, d.i, e.j, tx.w * ty.w * CASE WHEN s.alpha THEN 1 ELSE 0 END AS k, {", ".join(f"s.{v}" for v in values)}
            FROM range({half}) d(i), range({half}) e(j), {_TAPS} tx(o, w), {_TAPS} ty(o, w), {src} s WHERE s.x = 2 * d.i + tx.o AND s.y = 2 * e.j + ty.o) GROUP BY image_id, i, j"""
    cols = ", ".join(f"(sum(tx.w * ty.w * s.{v}) // 256)::BIGINT AS {v}" for v in values)
    return f"""SELECT s.image_id, d.i AS x, e.j AS y, {cols} FROM range({half}) d(i), range({half}) e(j), {_TAPS} tx(o, w), {_TAPS} ty(o, w), {src} s
        WHERE s.x = least(greatest(2 * d.i + tx.o, 0), {n - 1}) AND s.y = least(greatest(2 * e.j + ty.o, 0), {n - 1}) GROUP BY s.image_id, d.i, e.j"""


_UP = "(VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1))"


def _expand_sql(src: str, n: int, values: tuple[str, ...] = ("v",)) -> str:
    """One level up of ``src``, to square images of side n."""
    cols = ", ".join(f"(sum(tx.w * ty.w * s.{v}) // sum(tx.w * ty.w))::BIGINT AS {v}" for v in values)
    return f"""SELECT s.image_id, 2 * s.x + tx.o AS x, 2 * s.y + ty.o AS y, {cols} FROM {src} s, {_UP} tx(o, w), {_UP} ty(o, w)
        WHERE 2 * s.x + tx.o BETWEEN 0 AND {n - 1} AND 2 * s.y + ty.o BETWEEN 0 AND {n - 1} GROUP BY ALL"""


def _level(df: DataFrame, *values: str) -> DataFrame:
    return df.select(*PLACE, *(values or ("v",)))


@query("m01_reduce_masked", f" {_reduce_sql('gray', 8)}", "gray")
def m01(spark, sf):
    return pyramid.reduce_masked(pyramid.with_size(fx.gray(spark, sf), KEYS), KEYS, ["v"]).select(*PLACE, "v", "alpha")


@query("m02_reduce_plain", _reduce_sql("gray", 8, alpha=False), "gray")
def m02(spark, sf):
    return _level(pyramid.reduce_plain(pyramid.with_size(fx.gray(spark, sf), KEYS), KEYS, ["v"]))


@query("m02_reduce_plain_odd", f", odd AS (SELECT * FROM gray WHERE x < 7 AND y < 5) {_reduce_sql('odd', 7, alpha=False).replace('range(4) e(j)', 'range(3) e(j)').replace('0), 6) AND s.y', '0), 6) AND s.y').replace('ty.o, 0), 6)', 'ty.o, 0), 4)')}", "gray")
def m02_odd(spark, sf):
    odd = fx.gray(spark, sf).filter("x < 7 and y < 5")
    return _level(pyramid.reduce_plain(pyramid.with_size(odd, KEYS), KEYS, ["v"]))


@query("m03_expand", f", half AS (SELECT image_id, x, y, v - 128 AS v FROM gray) {_expand_sql('half', 16)}", "gray")
def m03(spark, sf):
    half = fx.gray(spark, sf).withColumn("v", F.col("v") - 128)
    sizes = half.select("image_id").distinct().withColumns({"w": F.lit(16).cast("long"), "h": F.lit(16).cast("long")})
    return _level(pyramid.expand(half, sizes, KEYS, ["v"]))


@query("m03_expand_odd", f", half AS (SELECT image_id, x, y, v FROM gray) {_expand_sql('half', 15)}", "gray")
def m03_odd(spark, sf):
    half = fx.gray(spark, sf)
    sizes = half.select("image_id").distinct().withColumns({"w": F.lit(15).cast("long"), "h": F.lit(15).cast("long")})
    return _level(pyramid.expand(half, sizes, KEYS, ["v"]))


@query(
    "m04_reduce_wraparound",
    f""", w AS (SELECT s.image_id, d.i, e.j, tx.w * ty.w * CASE WHEN s.alpha THEN 1 ELSE 0 END AS k, s.v FROM range(4) d(i), range(4) e(j), {_TAPS} tx(o, w), {_TAPS} ty(o, w), gray s
    WHERE s.x = (2 * d.i + tx.o + 8) % 8 AND s.y = 2 * e.j + ty.o)
    SELECT image_id, i AS x, j AS y, CASE WHEN sum(k) > 0 THEN (sum(k * v) // sum(k))::BIGINT ELSE 0 END AS v, sum(k) > 0 AS alpha FROM w GROUP BY image_id, i, j""",
    "gray",
)
def m04(spark, sf):
    return pyramid.reduce_masked(pyramid.with_size(fx.gray(spark, sf), KEYS), KEYS, ["v"], wrap=True).select(*PLACE, "v", "alpha")


_GAUSS = f", g1 AS ({_reduce_sql('gray', 8)}), g2 AS ({_reduce_sql('g1', 4)})"


@query("m05_gaussian_pyramid", _GAUSS + " SELECT 0::BIGINT AS level, image_id, x, y, v, alpha FROM gray UNION ALL SELECT 1, image_id, x, y, v, alpha FROM g1 UNION ALL SELECT 2, image_id, x, y, v, alpha FROM g2", "gray")
def m05(spark, sf):
    return pyramid.stack_levels(pyramid.gaussian(fx.gray(spark, sf), KEYS, ["v"], 3, "alpha")).select("level", *PLACE, "v", "alpha")


@query("m06_gaussian_pyramid_plain", f", g1 AS ({_reduce_sql('gray', 8, alpha=False)}), g2 AS ({_reduce_sql('g1', 4, alpha=False)}) SELECT 0::BIGINT AS level, image_id, x, y, v FROM gray UNION ALL SELECT 1, * FROM g1 UNION ALL SELECT 2, * FROM g2", "gray")
def m06(spark, sf):
    levels = pyramid.gaussian(fx.gray(spark, sf).drop("alpha"), KEYS, ["v"], 3)
    return pyramid.stack_levels(levels).select("level", *PLACE, "v")


_LAPLACE = (
    _GAUSS
    + f""", e0 AS ({_expand_sql("g1", 8)}), e1 AS ({_expand_sql("g2", 4)}),
    l0 AS (SELECT image_id, x, y, a.v - b.v AS v FROM gray a JOIN e0 b USING (image_id, x, y)),
    l1 AS (SELECT image_id, x, y, a.v - b.v AS v FROM g1 a JOIN e1 b USING (image_id, x, y))"""
)


@query("m07_laplacian_pyramid", _LAPLACE + " SELECT 0::BIGINT AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, image_id, x, y, v FROM g2", "gray")
def m07(spark, sf):
    levels = pyramid.laplacian(fx.gray(spark, sf), KEYS, ["v"], 3, "alpha")
    return pyramid.stack_levels([x.select(*PLACE, "v") for x in levels]).select("level", *PLACE, "v")


@query("m08_collapse", "SELECT image_id, x, y, v FROM gray", "gray")
def m08(spark, sf):
    # a level is an exchange of tiles, not a row for every place and tap
    packed = tiles.pack(fx.gray(spark, sf), KEYS, ["v"], ["alpha"])
    return tiles.unpack(tiles.collapse(tiles.laplacian(packed, KEYS, ["v"], 3, "alpha"), KEYS, ["v"]), KEYS, ["v"])


@query(
    "m09_pyramid_blend",
    _LAPLACE
    + f""", mask AS (SELECT image_id, x, y, CASE WHEN x < 4 THEN 255 ELSE 0 END::BIGINT AS v FROM gray), k1 AS ({_reduce_sql("mask", 8, alpha=False)}),
    lo AS (SELECT image_id, x, y, a.v - b.v AS v FROM gray a JOIN e0 b USING (image_id, x, y)),
    b0 AS (SELECT a.image_id, x, y, CASE WHEN m.v >= 255 THEN a.v WHEN m.v <= 0 THEN b.v ELSE m.v / 255::DOUBLE * a.v + (1 - m.v / 255::DOUBLE) * b.v END AS t
        FROM lo a JOIN lo b USING (x, y) JOIN mask m USING (x, y) WHERE b.image_id = a.image_id + 1 AND m.image_id = a.image_id),
    b1 AS (SELECT a.image_id, x, y, CASE WHEN m.v >= 255 THEN a.v WHEN m.v <= 0 THEN b.v ELSE m.v / 255::DOUBLE * a.v + (1 - m.v / 255::DOUBLE) * b.v END AS t
        FROM g1 a JOIN g1 b USING (x, y) JOIN k1 m USING (x, y) WHERE b.image_id = a.image_id + 1 AND m.image_id = a.image_id),
    r0 AS (SELECT image_id, x, y, CASE WHEN t >= 0 THEN floor(t + 0.5) ELSE ceil(t - 0.5) END::BIGINT AS v FROM b0),
    r1 AS (SELECT image_id, x, y, CASE WHEN t >= 0 THEN floor(t + 0.5) ELSE ceil(t - 0.5) END::BIGINT AS v FROM b1),
    up AS ({_expand_sql("r1", 8)})
    SELECT image_id, x, y, r0.v + up.v AS v FROM r0 JOIN up USING (image_id, x, y)""",
    "gray",
)
def m09(spark, sf):
    g = fx.gray(spark, sf)
    white = pyramid.laplacian(g, KEYS, ["v"], 2, "alpha")
    black = [x.withColumn("image_id", F.col("image_id") - 1) for x in pyramid.laplacian(g, KEYS, ["v"], 2, "alpha")]
    mask = pyramid.gaussian(g.select(*PLACE, F.when(F.col("x") < 4, 255).otherwise(0).cast("long").alias("m")), KEYS, ["m"], 2)
    return _level(pyramid.collapse(pyramid.blend_levels(mask, white, black, KEYS, ["v"]), KEYS, ["v"]))


_HALVINGS = """, h AS (SELECT file, layer_no, least(w, h) * 20 AS side, 1::BIGINT AS levels, 0::BIGINT AS half_width FROM layers
    UNION ALL SELECT file, layer_no, (side + 1) // 2, levels + 1, 2 * half_width + 4 FROM h WHERE side > 8)"""


def _short_side() -> F.Column:
    return F.least("w", "h") * 20


@query("m11_filter_half_width", _HALVINGS + " SELECT file, layer_no, max(half_width) AS half_width FROM h GROUP BY file, layer_no", "layers")
def m11(spark, sf):
    """How far a pixel of each layer reaches through the levels that suit it."""
    return fx.layers(spark, sf).select("file", "layer_no", pyramid.half_width_of(pyramid.natural_levels_of(_short_side())).alias("half_width"))


@query("m12_natural_levels", _HALVINGS + ", m AS (SELECT max(levels) AS levels FROM h GROUP BY file, layer_no) SELECT levels, greatest(levels - 2, 1) AS fewer, least(levels, 3) AS capped, count(*) AS n FROM m GROUP BY levels", "layers")
def m12(spark, sf):
    side = _short_side()
    levels = fx.layers(spark, sf).select(pyramid.natural_levels_of(side).alias("levels"), pyramid.natural_levels_of(side, -2).alias("fewer"), pyramid.natural_levels_of(side, 3).alias("capped"))
    return levels.groupBy("levels", "fewer", "capped").agg(F.count("*").alias("n"))


# Aggregates -----------------------------------------------------------------


@query("a01_bounding_box", "SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM gray WHERE alpha GROUP BY image_id", "gray")
def a01(spark, sf):
    return masks.bounding_box(fx.gray(spark, sf), KEYS)


@query(
    "a02_box_union_intersection",
    """, b AS (SELECT mosaic_id, ord, min(x) AS x0, max(x) AS x1 FROM mosaic WHERE v >= 100 GROUP BY ALL)
    SELECT a.mosaic_id, a.ord, least(a.x0, b.x0) AS u0, greatest(a.x1, b.x1) AS u1, greatest(a.x0, b.x0) AS i0, least(a.x1, b.x1) AS i1 FROM b a JOIN b ON b.mosaic_id = a.mosaic_id AND b.ord = a.ord + 1""",
    "mosaic",
)
def a02(spark, sf):
    box = masks.bounding_box(fx.mosaic(spark, sf).withColumn("alpha", F.col("v") >= 100), ["mosaic_id", "ord"]).select("mosaic_id", "ord", "x0", "x1")
    rows = px.combine(box, box.withColumn("ord", F.col("ord") - 1), ["mosaic_id", "ord"])
    return rows.select("mosaic_id", "ord", F.least("x0_a", "x0_b").alias("u0"), F.greatest("x1_a", "x1_b").alias("u1"), F.greatest("x0_a", "x0_b").alias("i0"), F.least("x1_a", "x1_b").alias("i1"))


_PAIR = ", pair AS (SELECT a.image_id, x, y, a.v >= 100 AS white, b.v >= 100 AS black FROM gray a JOIN gray b USING (x, y) WHERE b.image_id = a.image_id + 1)"


def _pair(spark, sf, at=100):
    g = fx.gray(spark, sf).select(*PLACE, "v")
    rows = px.combine(g, g.withColumn("image_id", F.col("image_id") - 1), PLACE)
    return rows.select(*PLACE, (F.col("v_a") >= at).alias("white"), (F.col("v_b") >= at).alias("black"))


@query("a03_overlap_class", _PAIR + " SELECT image_id, CASE WHEN NOT bool_or(white AND black) THEN 'none' WHEN bool_or(white AND NOT black) THEN 'partial' ELSE 'complete' END AS overlap FROM pair GROUP BY image_id", "gray")
def a03(spark, sf):
    return masks.overlap_class(_pair(spark, sf), KEYS)


@query("a04_conditional_mean_variance", f"SELECT image_id, {_R.format('avg(v) FILTER (alpha)')} AS mean, {_R.format('var_pop(v) FILTER (alpha)')} AS variance FROM gray GROUP BY image_id", "gray")
def a04(spark, sf):
    v = F.when(F.col("alpha"), F.col("v"))
    return fx.gray(spark, sf).groupBy("image_id").agg(r6(F.avg(v)).alias("mean"), r6(F.var_pop(v)).alias("variance"))


@query("a05_min_max", "SELECT image_id, min(v) AS lo, max(v) AS hi FROM gray GROUP BY image_id", "gray")
def a05(spark, sf):
    return fx.gray(spark, sf).groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("a06_bounded_tally", _BINARY + " SELECT image_id, least(count(*) FILTER (m <> 0), 40) AS n FROM bin GROUP BY image_id", "gray")
def a06(spark, sf):
    return masks.tally(_binary(spark, sf), KEYS, "m", 40)


@query("a07_excessive_overlap", _PAIR + " SELECT image_id, greatest(count(*) FILTER (white AND NOT black), count(*) FILTER (black AND NOT white)) < 2 * (8 + 8) AS excessive FROM pair GROUP BY image_id", "gray")
def a07(spark, sf):
    only = lambda a, b: F.count_if(F.col(a) & ~F.col(b))
    return _pair(spark, sf).groupBy("image_id").agg((F.greatest(only("white", "black"), only("black", "white")) < 32).alias("excessive"))


@query("a08_label_agreement", _PAIR + " SELECT image_id, count(*) FILTER (white = black) AS agree FROM pair GROUP BY image_id", "gray")
def a08(spark, sf):
    return _pair(spark, sf).groupBy("image_id").agg(F.count_if(F.col("white") == F.col("black")).alias("agree"))


@query("a09_normalisation_image", "SELECT scene_id, x, y, sum(v) AS total FROM bracket GROUP BY scene_id, x, y", "bracket")
def a09(spark, sf):
    return fx.bracket(spark, sf).groupBy("scene_id", "x", "y").agg(F.sum("v").alias("total"))


@query("a10_alpha_union", "SELECT scene_id, x, y, bool_or(v >= 128) AS alpha FROM bracket GROUP BY scene_id, x, y", "bracket")
def a10(spark, sf):
    return stack.alpha_union(fx.bracket(spark, sf).withColumn("alpha", F.col("v") >= 128), ["scene_id", "x", "y"])


@query(
    "a11_movable_vertex_box",
    """, s AS (SELECT image_id, i.x * 8 + i.y AS ord, x, y, v >= 140 AS movable FROM gray i WHERE y = 3 OR x = 2),
    n AS (SELECT *, coalesce(lag(movable) OVER o, false) OR coalesce(lead(movable) OVER o, false) AS near FROM s WINDOW o AS (PARTITION BY image_id ORDER BY ord))
    SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM n WHERE movable OR near GROUP BY image_id""",
    "gray",
)
def a11(spark, sf):
    from pyspark.sql import Window as W

    s = fx.gray(spark, sf).filter("y = 3 or x = 2").select("image_id", (F.col("x") * 8 + F.col("y")).alias("ord"), "x", "y", (F.col("v") >= 140).alias("movable"))
    o = W.partitionBy("image_id").orderBy("ord")
    near = F.coalesce(F.lag("movable").over(o), F.lit(False)) | F.coalesce(F.lead("movable").over(o), F.lit(False))
    return masks.bounding_box(s.withColumn("alpha", F.col("movable") | near), KEYS)


@query("a12_polygon_extent", "SELECT l_orderkey AS contour, min(l_partkey % 40) AS x0, min(l_suppkey % 30) AS y0, max(l_partkey % 40) AS x1, max(l_suppkey % 30) AS y1 FROM lineitem GROUP BY l_orderkey")
def a12(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contour"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 30).alias("y"), F.lit(True).alias("alpha"))
    return masks.bounding_box(li, ["contour"])


@query("a13_histogram", ", c AS (SELECT 'r' AS channel, r AS value FROM rgb UNION ALL SELECT 'g', g FROM rgb UNION ALL SELECT 'b', b FROM rgb) SELECT channel, value, count(*) AS n FROM c GROUP BY ALL", "rgb")
def a13(spark, sf):
    return fx.rgb(spark, sf).selectExpr("stack(3, 'r', r, 'g', g, 'b', b) as (channel, value)").groupBy("channel", "value").agg(F.count("*").alias("n"))


# Stacks ---------------------------------------------------------------------

SCENE = ["scene_id", "x", "y"]
_SCORED = f", scored AS (SELECT *, {_weights('v / 255')['gaussian']} AS w FROM bracket)"


def _scored(spark, sf):
    return fx.bracket(spark, sf).withColumn("w", exposure.weight("gaussian", F.col("v") / 255))


@query("f01_exposure_score", _SCORED + f" SELECT scene_id, ord, x, y, {_R.format('w')} AS w FROM scored", "bracket")
def f01(spark, sf):
    return _scored(spark, sf).select("scene_id", "ord", "x", "y", r6(F.col("w")).alias("w"))


@query("f02_exposure_cutoff", f"SELECT image_id, x, y, {_R.format('CASE WHEN least(r, g, b) >= 20 AND greatest(r, g, b) <= 235 THEN ' + _weights('((r + g + b) / 3 / 255)')['gaussian'] + ' ELSE 0 END')} AS w FROM rgb", "rgb")
def f02(spark, sf):
    score = exposure.weight("gaussian", (F.col("r") + F.col("g") + F.col("b")) / 3 / 255)
    cut = stack.exposure_with_cutoff(score, F.least("r", "g", "b"), F.greatest("r", "g", "b"), 20, 235)
    return fx.rgb(spark, sf).select(*PLACE, r6(cut).alias("w"))


@query(
    "f03_contrast_score",
    f", s AS (SELECT p.image_id, p.x, p.y, coalesce(stddev_samp(q.v) FILTER (q.alpha), 0) AS sd FROM gray p {_window(2)} WHERE p.alpha AND {_inner(2)} GROUP BY p.image_id, p.x, p.y) SELECT g.image_id, g.x, g.y, {_R.format('coalesce(sd, 0) / 255 * 0.5')} AS w FROM gray g LEFT JOIN s USING (image_id, x, y)",
    "gray",
)
def f03(spark, sf):
    g = fx.gray(spark, sf)
    sd = windows.local_stddev(g, KEYS, 5)
    return g.join(sd, PLACE, "left").select(*PLACE, r6(F.coalesce("stddev", F.lit(0.0)) / 255 * 0.5).alias("w"))


@query(
    "f04_saturation_score",
    f"SELECT image_id, x, y, {_R.format('0.4 * CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) + least(r, g, b) <= 255 THEN (greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + least(r, g, b)) ELSE (greatest(r, g, b) - least(r, g, b)) / (510 - greatest(r, g, b) - least(r, g, b)) END::DOUBLE')} AS w FROM rgb",
    "rgb",
)
def f04(spark, sf):
    from tessera.functions import colour

    return fx.rgb(spark, sf).select(*PLACE, r6(0.4 * colour.saturation((F.col("r"), F.col("g"), F.col("b")), 255)).alias("w"))


def _channel_entropy(c: str) -> str:
    return f"""e{c} AS (SELECT image_id, x, y, CASE WHEN count(*) <= 1 THEN 0 ELSE (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) * 255 END AS e FROM (
        SELECT p.image_id, p.x, p.y, q.{c}, count(*) AS c FROM rgb p JOIN rgb q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 WHERE {_inner(1)} GROUP BY ALL) GROUP BY image_id, x, y)"""


@query("f05_entropy_score", f", {', '.join(map(_channel_entropy, 'rgb'))} SELECT image_id, x, y, {_R.format('least(er.e, eg.e, eb.e) / 255')} AS w FROM er JOIN eg USING (image_id, x, y) JOIN eb USING (image_id, x, y)", "rgb")
def f05(spark, sf):
    rows = fx.rgb(spark, sf).withColumn("alpha", F.lit(True))
    parts = [windows.local_entropy(rows, KEYS, 3, value=c).withColumnRenamed("entropy", f"e{c}") for c in "rgb"]
    out = parts[0].join(parts[1], PLACE).join(parts[2], PLACE)
    return out.select(*PLACE, r6(F.least("er", "eg", "eb") / 255).alias("w"))


@query("f06_total_score", f"SELECT image_id, x, y, {_R.format('CASE WHEN r >= 80 THEN ' + _weights('((r + g + b) / 3 / 255)')['gaussian'] + ' + 0.2::DOUBLE * CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) + least(r, g, b) <= 255 THEN (greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + least(r, g, b)) ELSE (greatest(r, g, b) - least(r, g, b)) / (510 - greatest(r, g, b) - least(r, g, b)) END ELSE 0 END')} AS w FROM rgb", "rgb")
def f06(spark, sf):
    from tessera.functions import colour

    c = (F.col("r"), F.col("g"), F.col("b"))
    score = stack.total_score(F.col("r") >= 80, exposure.weight("gaussian", (c[0] + c[1] + c[2]) / 3 / 255), 0.2 * colour.saturation(c, 255))
    return fx.rgb(spark, sf).select(*PLACE, r6(score).alias("w"))


@query("f07_soft_masks", _SCORED + f" SELECT scene_id, ord, x, y, {_R.format('CASE WHEN sum(w) OVER p > 0 THEN 255 * w / sum(w) OVER p ELSE 255 // count(*) OVER p END')} AS m FROM scored WINDOW p AS (PARTITION BY scene_id, x, y)", "bracket")
def f07(spark, sf):
    return stack.normalise(_scored(spark, sf), SCENE).select("scene_id", "ord", "x", "y", r6(F.col("m")).alias("m"))


@query(
    "f08_hard_masks",
    ", s AS (SELECT *, 255 - abs(v - 128) AS w FROM bracket) SELECT scene_id, ord, x, y, CASE WHEN row_number() OVER (PARTITION BY scene_id, x, y ORDER BY w DESC, ord) = 1 THEN 255 ELSE 0 END::DOUBLE AS m FROM s",
    "bracket",
)
def f08(spark, sf):
    s = fx.bracket(spark, sf).withColumn("w", 255 - F.abs(F.col("v") - 128))
    return stack.hard_mask(s, SCENE).select("scene_id", "ord", "x", "y", "m")


@query(
    "fuse_single_level",
    ", s AS (SELECT *, 255 - abs(v - 128) AS w FROM bracket) SELECT scene_id, x, y, floor(sum(v * w) / sum(w) + 0.5)::BIGINT AS v FROM s GROUP BY scene_id, x, y",
    "bracket",
)
def fuse_single_level(spark, sf):
    s = fx.bracket(spark, sf).withColumn("w", 255 - F.abs(F.col("v") - 128))
    return stack.weighted_average(s, SCENE, mask="w")


# Masks and distances -----------------------------------------------------------


@query("g01_distance_euclidean", ", f AS (SELECT image_id, x, y FROM gray WHERE v >= 190) SELECT p.image_id, p.x, p.y, min((p.x - f.x) ** 2 + (p.y - f.y) ** 2)::BIGINT AS d FROM gray p LEFT JOIN f ON f.image_id = p.image_id GROUP BY p.image_id, p.x, p.y", "gray")
def g01(spark, sf):
    return masks.distance_transform(fx.gray(spark, sf), KEYS, F.col("v") >= 190)


@query("g01_distance_manhattan", ", f AS (SELECT image_id, x, y FROM gray WHERE v >= 190) SELECT p.image_id, p.x, p.y, min(abs(p.x - f.x) + abs(p.y - f.y)) AS d FROM gray p LEFT JOIN f ON f.image_id = p.image_id GROUP BY p.image_id, p.x, p.y", "gray")
def g01_manhattan(spark, sf):
    return masks.distance_transform(fx.gray(spark, sf), KEYS, F.col("v") >= 190, "manhattan")


@query("g02_distance_periodic", ", f AS (SELECT image_id, x + 8 * k AS x, y FROM gray, (VALUES (-1), (0), (1)) s(k) WHERE v >= 190) SELECT p.image_id, p.x, p.y, min((p.x - f.x) ** 2 + (p.y - f.y) ** 2)::BIGINT AS d FROM gray p LEFT JOIN f ON f.image_id = p.image_id GROUP BY p.image_id, p.x, p.y", "gray")
def g02(spark, sf):
    return masks.periodic(fx.gray(spark, sf), KEYS, F.col("v") >= 190, 8, 8)


@query(
    "g03_nearest_feature",
    _PAIR.replace(">= 100", ">= 150")
    + """, d AS (SELECT p.image_id, p.x, p.y, min((p.x - f.x) ** 2 + (p.y - f.y) ** 2) FILTER (f.white AND NOT f.black) AS dw, min((p.x - f.x) ** 2 + (p.y - f.y) ** 2) FILTER (f.black AND NOT f.white) AS db FROM pair p JOIN pair f USING (image_id) GROUP BY p.image_id, p.x, p.y)
    SELECT image_id, x, y, CASE WHEN dw IS NOT NULL AND (db IS NULL OR dw < db) THEN 255 ELSE 0 END::BIGINT AS m FROM d""",
    "gray",
)
def g03(spark, sf):
    return masks.nearest_feature(_pair(spark, sf, 150), KEYS)


@query("g07_mismatch", f"SELECT a.image_id, x, y, CASE WHEN a.v >= 60 AND b.v >= 60 THEN abs(a.v - b.v) ELSE 255 END AS cost FROM gray a JOIN gray b USING (x, y) WHERE b.image_id = a.image_id + 1", "gray")
def g07(spark, sf):
    g = fx.gray(spark, sf).select(*PLACE, "v")
    rows = px.combine(g, g.withColumn("image_id", F.col("image_id") - 1), PLACE)
    return rows.select(*PLACE, F.when((F.col("v_a") >= 60) & (F.col("v_b") >= 60), F.abs(F.col("v_a") - F.col("v_b"))).otherwise(255).alias("cost"))


@query("g09_coarse_mask", "SELECT image_id, x // 2 AS x, y // 2 AS y, v FROM gray WHERE x % 2 = 0 AND y % 2 = 0", "gray")
def g09(spark, sf):
    return px.stride(fx.gray(spark, sf), 2, 2).drop("alpha")


_TRIANGLES = ", t AS (SELECT image_id, 0 AS ord, r % 17 AS x, g % 13 AS y FROM rgb WHERE x = 0 AND y = 0 UNION ALL SELECT image_id, 1, r % 19, g % 14 FROM rgb WHERE x = 3 AND y = 2 UNION ALL SELECT image_id, 2, r % 20, g % 15 FROM rgb WHERE x = 6 AND y = 5)"


@query(
    "g05_polygon_fill",
    _TRIANGLES
    + """, e AS (SELECT image_id, x, y, coalesce(lead(x) OVER o, first(x) OVER o) AS x2, coalesce(lead(y) OVER o, first(y) OVER o) AS y2 FROM t WINDOW o AS (PARTITION BY image_id ORDER BY ord)),
    c AS (SELECT image_id, l.y AS line, e.x + (l.y - e.y) * (x2 - e.x)::DOUBLE / (y2 - e.y) AS at FROM e, range(16) l(y) WHERE e.y <> y2 AND l.y >= least(e.y, y2) AND l.y < greatest(e.y, y2))
    SELECT p.image_id, px.x, py.y FROM (SELECT DISTINCT image_id FROM t) p, range(21) px(x), range(16) py(y)
    WHERE (SELECT count(*) FROM c WHERE c.image_id = p.image_id AND c.line = py.y AND c.at <= px.x) % 2 = 1""",
    "rgb",
)
def g05(spark, sf):
    rgb = fx.rgb(spark, sf)
    corner = lambda o, x, y, mx, my: rgb.filter(f"x = {x} and y = {y}").select("image_id", F.lit(0).alias("contour"), F.lit(o).alias("ord"), (F.col("r") % mx).alias("x"), (F.col("g") % my).alias("y"))
    t = corner(0, 0, 0, 17, 13).unionByName(corner(1, 3, 2, 19, 14)).unionByName(corner(2, 6, 5, 20, 15))
    return masks.fill_polygons(t, KEYS, 21, 16)


def _wrapped_taps(n: int) -> list[tuple[int, int, int]]:
    """(destination, source, weight) of expanding a ring of (n + 1) div 2 places to n: an odd ring's ends lie side by side and weigh 4."""
    half = (n + 1) // 2
    out = []
    for d in range(n):
        if d % 2:
            out += [(d, d // 2, 4), (d, (d // 2 + 1) % half, 4)]
        else:
            s = d // 2
            out += [(d, (s - 1) % half, 4 if n % 2 and s == 0 else 1), (d, s, 6), (d, (s + 1) % half, 4 if n % 2 and s == half - 1 else 1)]
    return out


def _wrap_sql(n: int) -> str:
    taps = "(VALUES " + ", ".join(map(str, _wrapped_taps(n))) + ") tx(d, s, w)"
    return f""", half AS (SELECT image_id, x, y, v - 99 AS v FROM gray)
    SELECT s.image_id, tx.d::BIGINT AS x, 2 * s.y + ty.o AS y, (sum(tx.w * ty.w * s.v) // sum(tx.w * ty.w))::BIGINT AS v FROM half s, {taps}, {_UP} ty(o, w)
    WHERE s.x = tx.s AND 2 * s.y + ty.o BETWEEN 0 AND 15 GROUP BY ALL"""


def _expand_wrapped(spark, sf, n: int) -> DataFrame:
    half = fx.gray(spark, sf).withColumn("v", F.col("v") - 99)
    sizes = half.select("image_id").distinct().withColumns({"w": F.lit(n).cast("long"), "h": F.lit(16).cast("long")})
    return _level(pyramid.expand(half, sizes, KEYS, ["v"], wrap=True))


@query("m04_expand_wraparound", _wrap_sql(16), "gray")
def m04_expand(spark, sf):
    return _expand_wrapped(spark, sf, 16)


@query("m04_expand_wraparound_odd", _wrap_sql(15), "gray")
def m04_expand_odd(spark, sf):
    return _expand_wrapped(spark, sf, 15)
