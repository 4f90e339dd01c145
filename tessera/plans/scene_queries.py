"""Queries of sources and sinks, assembly, fusion and blending."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import masks, pyramid
from tessera.operators import pixelwise as px
from tessera.plans import blend, fuse
from tessera.plans.config import BlendConfig, FuseConfig
from tessera.plans.pixel_queries import _R, _weights, r6
from tessera.plans.raster_queries import _expand_sql, _reduce_sql
from tessera.plans.registry import query
from tessera.sources import catalog
from tessera.sources import fixtures as fx
from tessera.sources import images
from tessera.storage import materialize

PLACE = ["image_id", "x", "y"]


@query("s01_import_alpha", "SELECT image_id, x, y, r AS v, b BETWEEN 127 AND 255 AS alpha FROM rgb", "rgb")
def s01(spark, sf):
    return fx.rgb(spark, sf).select(*PLACE, F.col("r").alias("v"), images.import_alpha(F.col("b"), 255).alias("alpha"))


@query("s02_range_map", "SELECT image_id, x, y, v * 257 AS wide, floor(v / 255 * 1000 + 0.5)::BIGINT AS mapped FROM gray", "gray")
def s02(spark, sf):
    return fx.gray(spark, sf).select(*PLACE, images.rescale(F.col("v"), 255, 65_535).alias("wide"), F.floor(F.col("v") / 255 * 1000 + 0.5).alias("mapped"))


@query("s03_export_round_trip", "SELECT image_id, x, y, v FROM gray", "gray")
def s03(spark, sf):
    import numpy as np
    import pandas as pd

    files = images.encode_images(fx.gray(spark, sf), ["image_id"], ["v"])

    def run(parts):
        for pdf in parts:
            for i, data in zip(pdf["image_id"], pdf["content"]):
                v, _ = images.decode(bytes(data))
                y, x = np.indices(v.shape)
                yield pd.DataFrame({"image_id": i, "x": x.ravel(), "y": y.ravel(), "v": v.ravel()})

    return files.mapInPandas(run, "image_id long, x long, y long, v long")


@query("s05_checkpoint_projection", "SELECT image_id, x, y, CASE WHEN alpha THEN 255 ELSE 0 END::BIGINT AS a, v * 257 // 257 AS v FROM gray", "gray")
def s05(spark, sf):
    wide = fx.gray(spark, sf).withColumn("v", F.col("v") * 257)
    return wide.select(*PLACE, images.export_alpha(F.col("alpha"), 255).alias("a"), F.expr("v div 257").alias("v"))


@query("s07_mask_sink", "SELECT image_id % 4 AS step, image_id, x, y, CASE WHEN alpha THEN 255 ELSE 0 END::BIGINT AS m FROM gray", "gray")
def s07(spark, sf):
    mask = fx.gray(spark, sf).select((F.col("image_id") % 4).alias("step"), *PLACE, F.when(F.col("alpha"), 255).otherwise(0).cast("long").alias("m"))
    return materialize(mask, "masks", partition_by="step")


@query(
    "s08_filename_templates",
    """SELECT s_suppkey, 'mask-' || lpad(s_suppkey::VARCHAR, greatest(4, length(s_suppkey::VARCHAR))::INTEGER, '0') || '_' || lpad((s_suppkey - 1)::VARCHAR, greatest(3, length((s_suppkey - 1)::VARCHAR))::INTEGER, '0')
        || '-' || lpad(s_suppkey::VARCHAR, greatest(6, length(s_suppkey::VARCHAR))::INTEGER, '#') || ' /in/' || s_nationkey || ' ' || s_name || '.x.tif ' || s_name || '.x .tif /in/' || s_nationkey || '/' || s_name || '.x.tif'
        || ' % out out.png . .png' AS name FROM supplier""",
)
def s08(spark, sf):
    s = fx.table(spark, sf, "supplier").withColumn("file", F.concat(F.lit("/in/"), F.col("s_nationkey"), F.lit("/"), F.col("s_name"), F.lit(".x.tif")))
    name = catalog.expand_template("mask-%04n_%i-%#6n %d %b %f %e %p %% %F %B %D %E", F.col("s_suppkey") - 1, F.col("file"), "out.png", images=999)
    return s.select("s_suppkey", name.alias("name"))


@query("s12_layer_specs", "SELECT p_partkey, p_name AS file, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS spec FROM part")
def s12(spark, sf):
    p = fx.table(spark, sf, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("["), F.col("p_size").cast("string"), F.lit("]"))).otherwise(F.col("p_name"))
    file, spec = catalog.split_spec(F.col("name"))
    return p.withColumn("name", name).select("p_partkey", file.alias("file"), spec.alias("spec"))


@query(
    "s13_layer_selectors",
    """, ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY layer_no) AS a, row_number() OVER (PARTITION BY file ORDER BY layer_no DESC) AS b,
        row_number() OVER (PARTITION BY file ORDER BY w * h DESC, layer_no) AS c FROM layers)
    SELECT 'first' AS selector, file, layer_no, w, h FROM ranked WHERE a = 1 UNION ALL SELECT 'last', file, layer_no, w, h FROM ranked WHERE b = 1 UNION ALL SELECT 'largest', file, layer_no, w, h FROM ranked WHERE c = 1""",
    "layers",
)
def s13(spark, sf):
    layers = fx.layers(spark, sf)
    pick = lambda s: catalog.select_layers(layers, s).select(F.lit(s).alias("selector"), "file", "layer_no", "w", "h")
    return pick("first").unionByName(pick("last")).unionByName(pick("largest"))


@query(
    "s14_indexed_layers",
    """, n AS (SELECT file, max(layer_no) AS last FROM layers GROUP BY file),
    parts AS (SELECT file, 0 AS part, last - layer_no AS nth, layer_no FROM layers JOIN n USING (file) WHERE layer_no >= 2
        UNION ALL SELECT file, 1, 0, 1 FROM n UNION ALL SELECT file, 2, 0, last FROM n)
    SELECT file, row_number() OVER (PARTITION BY file ORDER BY part, nth) - 1 AS pos, layer_no, w, h FROM parts JOIN layers USING (file, layer_no)""",
    "layers",
)
def s14(spark, sf):
    return catalog.select_layers(fx.layers(spark, sf), "reverse 2..-1,1,-1").select("file", "pos", "layer_no", "w", "h")


@query("s15_layer_metadata", "SELECT file, count(*) AS n_layers, max(w * h) AS largest_area FROM layers GROUP BY file", "layers")
def s15(spark, sf):
    return fx.layers(spark, sf).groupBy("file").agg(F.count("*").alias("n_layers"), F.max(F.col("w") * F.col("h")).alias("largest_area"))


@query(
    "s16_compatibility",
    "SELECT count(DISTINCT layer_no % 2 = 0) <= 1 AS same_color, true AS same_type, min(least(w, h)) AS min_side, min(layer_no * 3) AS x0, min(file % 5) AS y0, max(layer_no * 3 + w) AS x1, max(file % 5 + h) AS y1 FROM layers",
    "layers",
)
def s16(spark, sf):
    rows = fx.layers(spark, sf).select("w", "h", (F.col("layer_no") % 2 == 0).alias("is_color"), F.lit("UINT8").alias("pixel_type"), (F.col("layer_no") * 3).alias("x0"), (F.col("file") % 5).alias("y0"))
    return catalog.check_compatible(rows)


@query(
    "s17_metadata_passthrough",
    "SELECT p_partkey, 'own' AS title, p_brand AS maker, NULL::VARCHAR AS thumbnail, p_type AS lens FROM part",
)
def s17(spark, sf):
    p = fx.table(spark, sf, "part")
    own = F.create_map(F.lit("Title"), F.lit("own"))
    source = F.create_map(F.lit("Title"), F.col("p_name"), F.lit("Maker"), F.col("p_brand"), F.lit("Thumbnail.Size"), F.col("p_name"), F.lit("Lens"), F.col("p_type"))
    meta = p.select("p_partkey", catalog.pass_metadata(own, source, r"^(Thumbnail|Preview)").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return meta.select("p_partkey", get("Title").alias("title"), get("Maker").alias("maker"), get("Thumbnail.Size").alias("thumbnail"), get("Lens").alias("lens"))


@query("s19_output_geometry", "SELECT mosaic_id, least(min(x), -2)::BIGINT AS x0, least(min(y), 1)::BIGINT AS y0, greatest(max(x) + 1, 38)::BIGINT AS x1, greatest(max(y) + 1, 31)::BIGINT AS y1 FROM mosaic GROUP BY mosaic_id", "mosaic")
def s19(spark, sf):
    w, h, x, y = catalog.parse_geometry("40x30-2+1")
    box = fx.mosaic(spark, sf).groupBy("mosaic_id").agg(F.min("x").alias("a"), F.min("y").alias("b"), (F.max("x") + 1).alias("c"), (F.max("y") + 1).alias("d"))
    at = lambda f, c, n: f(F.col(c), F.lit(n)).cast("long")
    return box.select("mosaic_id", at(F.least, "a", x).alias("x0"), at(F.least, "b", y).alias("y0"), at(F.greatest, "c", x + w).alias("x1"), at(F.greatest, "d", y + h).alias("y1"))


@query("s20_pyramid_sink", f", g1 AS ({_reduce_sql('gray', 8)}) SELECT 0::INTEGER AS level, image_id, x, y, v FROM gray UNION ALL SELECT 1, image_id, x, y, v FROM g1", "gray")
def s20(spark, sf):
    levels = pyramid.stack_levels([x.select(*PLACE, "v") for x in pyramid.gaussian(fx.gray(spark, sf), ["image_id"], ["v"], 2, "alpha")])
    return materialize(levels.withColumn("level", F.col("level").cast("int")), "pyramid", partition_by="level").select("level", *PLACE, "v")


# Assembly and blending ------------------------------------------------------------

MOSAIC = ["mosaic_id"]
_VALID = ", valid AS (SELECT * FROM mosaic WHERE v >= 100)"


def _valid(spark, sf):
    return fx.mosaic(spark, sf).filter("v >= 100")


@query(
    "b01_greedy_assembly",
    _VALID
    + """, o AS (SELECT DISTINCT a.mosaic_id, a.ord AS a, b.ord AS b FROM valid a JOIN valid b USING (mosaic_id, x, y) WHERE a.ord < b.ord),
    m AS (SELECT mosaic_id, bool_or(ord = 0) AS h0, bool_or(ord = 1) AS h1, bool_or(ord = 2) AS h2, bool_or(ord = 3) AS h3 FROM valid GROUP BY mosaic_id),
    p AS (SELECT m.*, coalesce(bool_or(a = 0 AND b = 1), false) AS o01, coalesce(bool_or(a = 1 AND b = 2), false) AS o12, coalesce(bool_or(a = 2 AND b = 3), false) AS o23 FROM m LEFT JOIN o USING (mosaic_id) GROUP BY ALL),
    b0 AS (SELECT *, CASE WHEN o01 THEN 1 ELSE 0 END AS b1 FROM p), b1 AS (SELECT *, CASE WHEN o12 AND b1 = 0 THEN 1 ELSE 0 END AS b2 FROM b0),
    b2 AS (SELECT *, CASE WHEN o23 AND b2 = 0 THEN 1 ELSE 0 END AS b3 FROM b1)
    SELECT mosaic_id, 0::BIGINT AS ord, 0::BIGINT AS batch FROM b2 WHERE h0 UNION ALL SELECT mosaic_id, 1, b1 FROM b2 WHERE h1 UNION ALL SELECT mosaic_id, 2, b2 FROM b2 WHERE h2 UNION ALL SELECT mosaic_id, 3, b3 FROM b2 WHERE h3""",
    "mosaic",
)
def b01(spark, sf):
    return blend.assemble(_valid(spark, sf), MOSAIC, 4)


@query(
    "b02_redundant_images",
    _VALID + " SELECT mosaic_id, a.ord, bool_and(EXISTS (SELECT 1 FROM valid b WHERE b.mosaic_id = a.mosaic_id AND b.ord <> a.ord AND b.x = a.x AND b.y = a.y)) AS redundant FROM valid a GROUP BY mosaic_id, a.ord",
    "mosaic",
)
def b02(spark, sf):
    v = _valid(spark, sf)
    n = v.groupBy("mosaic_id", "x", "y").agg(F.count("*").alias("n"))
    return v.join(n, ["mosaic_id", "x", "y"]).groupBy("mosaic_id", "ord").agg(F.bool_and(F.col("n") > 1).alias("redundant"))


@query("b03_overlay", ", a AS (SELECT mosaic_id, x, y, v FROM mosaic WHERE ord = 0), b AS (SELECT mosaic_id, x, y, v FROM mosaic WHERE ord = 1) SELECT mosaic_id, x, y, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (mosaic_id, x, y)", "mosaic")
def b03(spark, sf):
    m = fx.mosaic(spark, sf)
    return px.overlay(m.filter("ord = 0").drop("ord"), m.filter("ord = 1").drop("ord"), ["mosaic_id", "x", "y"])


@query("b05_outside_roi", ", a AS (SELECT * FROM mosaic WHERE ord = 0), b AS (SELECT * FROM mosaic WHERE ord = 1) SELECT mosaic_id, x, y, CASE WHEN b.v >= 100 AND NOT (x BETWEEN 5 AND 6 AND y BETWEEN 2 AND 5) THEN b.v ELSE a.v END AS v FROM a LEFT JOIN b USING (mosaic_id, x, y)", "mosaic")
def b05(spark, sf):
    m = fx.mosaic(spark, sf)
    white = m.filter("ord = 1").drop("ord").withColumn("m", (F.col("v") >= 100) & ~(F.col("x").between(5, 6) & F.col("y").between(2, 5)))
    return px.overwrite_if(m.filter("ord = 0").drop("ord"), white, ["mosaic_id", "x", "y"], "m", ["v"])


@query("b06_alpha_union", "SELECT mosaic_id, x, y, bool_or(v >= 100) AS alpha FROM mosaic GROUP BY mosaic_id, x, y", "mosaic")
def b06(spark, sf):
    return fx.mosaic(spark, sf).groupBy("mosaic_id", "x", "y").agg(F.bool_or(F.col("v") >= 100).alias("alpha"))


def _step_sql() -> str:
    """White = image 1, black = image 0 of each mosaic on a 13 x 8 canvas: seam, two levels, collapse."""
    lift = "CASE WHEN m.v >= 255 THEN a.v WHEN m.v <= 0 THEN b.v ELSE m.v / 255::DOUBLE * a.v + (1 - m.v / 255::DOUBLE) * b.v END"
    away = lambda t: f"CASE WHEN {t} >= 0 THEN floor({t} + 0.5) ELSE ceil({t} - 0.5) END::BIGINT"
    parts = [
        "place AS (SELECT DISTINCT mosaic_id AS image_id, x.x, y.y FROM mosaic, range(13) x(x), range(8) y(y))",
        "twin AS (SELECT p.image_id, p.x, p.y, coalesce(a.v, 0) AS vb, coalesce(a.v >= 60, false) AS black, coalesce(b.v, 0) AS vw, coalesce(b.v >= 60, false) AS white FROM place p LEFT JOIN (SELECT * FROM mosaic WHERE ord = 0) a ON a.mosaic_id = p.image_id AND a.x = p.x AND a.y = p.y LEFT JOIN (SELECT * FROM mosaic WHERE ord = 1) b ON b.mosaic_id = p.image_id AND b.x = p.x AND b.y = p.y)",
        "kind AS (SELECT image_id, CASE WHEN NOT bool_or(white AND black) THEN 'none' WHEN bool_or(white AND NOT black) THEN 'partial' ELSE 'complete' END AS overlap FROM twin GROUP BY image_id)",
        "seam AS (SELECT twin.* FROM twin JOIN kind USING (image_id) WHERE overlap = 'partial')",
        "dist AS (SELECT p.image_id, p.x, p.y, min((p.x - f.x) ** 2 + (p.y - f.y) ** 2) FILTER (f.white AND NOT f.black) AS dw, min((p.x - f.x) ** 2 + (p.y - f.y) ** 2) FILTER (f.black AND NOT f.white) AS db FROM seam p JOIN seam f USING (image_id) GROUP BY ALL)",
        "k0 AS (SELECT image_id, x, y, CASE WHEN dw IS NOT NULL AND (db IS NULL OR dw < db) THEN 255 ELSE 0 END::BIGINT AS v FROM dist)",
        "w0 AS (SELECT image_id, x, y, vw AS v, white AS alpha FROM seam), c0 AS (SELECT image_id, x, y, vb AS v, black AS alpha FROM seam)",
    ]
    narrow = lambda s, a=True: _reduce_sql(s, 8, alpha=a).replace("range(4) d(i)", "range(7) d(i)").replace("0), 7) AND s.y", "0), 12) AND s.y")
    up = lambda s: _expand_sql(s, 8).replace("2 * s.x + tx.o BETWEEN 0 AND 7", "2 * s.x + tx.o BETWEEN 0 AND 12")
    parts += [f"k1 AS ({narrow('k0', False)}), w1 AS ({narrow('w0')}), c1 AS ({narrow('c0')})", f"we AS ({up('w1')}), ce AS ({up('c1')})"]
    parts += [
        "wl AS (SELECT image_id, x, y, a.v - b.v AS v FROM w0 a JOIN we b USING (image_id, x, y)), cl AS (SELECT image_id, x, y, a.v - b.v AS v FROM c0 a JOIN ce b USING (image_id, x, y))",
        f"t0 AS (SELECT image_id, x, y, {lift} AS t FROM wl a JOIN cl b USING (image_id, x, y) JOIN k0 m USING (image_id, x, y)), t1 AS (SELECT image_id, x, y, {lift} AS t FROM w1 a JOIN c1 b USING (image_id, x, y) JOIN k1 m USING (image_id, x, y))",
        f"r0 AS (SELECT image_id, x, y, {away('t')} AS v FROM t0), r1 AS (SELECT image_id, x, y, {away('t')} AS v FROM t1), rup AS ({up('r1')})",
        "done AS (SELECT image_id, x, y, least(greatest(r0.v + rup.v, 0), 255)::BIGINT AS vs FROM r0 JOIN rup USING (image_id, x, y))",
    ]
    return (
        ", "
        + ",\n".join(parts)
        + """ SELECT image_id AS mosaic_id, x, y, CASE WHEN NOT (black OR white) THEN 0 WHEN overlap = 'complete' THEN vb WHEN overlap = 'none' THEN CASE WHEN white THEN vw ELSE vb END ELSE vs END AS v, black OR white AS alpha
        FROM twin JOIN kind USING (image_id) LEFT JOIN done USING (image_id, x, y)"""
    )


@query("b04_blend_step", _step_sql(), "mosaic")
def b04(spark, sf):
    m = fx.mosaic(spark, sf).withColumn("alpha", F.col("v") >= 60)
    part = lambda i: blend.canvas(m.filter(F.col("ord") == i).drop("ord"), MOSAIC, 13, 8)
    return blend.join_image(part(0), part(1), MOSAIC, 2).drop("m")


def _alpha_mosaic(spark, sf):
    return fx.mosaic(spark, sf).withColumn("alpha", F.col("v") >= 60)


@query("blend_mosaic")
def blend_mosaic(spark, sf):
    return blend.blend(_alpha_mosaic(spark, sf), MOSAIC, 23, 8, 4, 2)


@query("blend_mosaic_graphcut")
def blend_mosaic_graphcut(spark, sf):
    """A graph cut whose fine masks go through annealing and shortest paths."""
    return blend.blend(_alpha_mosaic(spark, sf), MOSAIC, 23, 8, 4, 2, config=BlendConfig(coarse_factor=1, vectorize_distance=2))


@query("blend_mosaic_default")
def blend_mosaic_default(spark, sf):
    """All options as they come."""
    return blend.blend(_alpha_mosaic(spark, sf), MOSAIC, 23, 8, 4, config=BlendConfig())


def _color_mosaic(spark, sf):
    c = fx.rgb(spark, sf)
    return c.select(F.expr("image_id div 4").alias("mosaic_id"), (F.col("image_id") % 4).alias("ord"), (F.col("x") + 5 * (F.col("image_id") % 4)).alias("x"), "y", "r", "g", "b", (F.col("g") >= 60).alias("alpha"))


@query("blend_mosaic_color")
def blend_mosaic_color(spark, sf):
    return blend.blend(_color_mosaic(spark, sf), MOSAIC, 23, 8, 4, 2, channels=fuse.RGB, config=BlendConfig(seam="nearest", optimizers=(), pre_assemble=True))


@query("blend_mosaic_lab")
def blend_mosaic_lab(spark, sf):
    """Colour mosaics blended in the planes of CIELAB."""
    return blend.blend(_color_mosaic(spark, sf), MOSAIC, 23, 8, 4, 2, channels=fuse.RGB, config=BlendConfig(space="lab", seam="nearest", optimizers=()))


@query(
    "b07_masks_only",
    """, a AS (SELECT *, v >= 60 AS alpha FROM mosaic), steps AS (SELECT unnest([1, 2, 3])::BIGINT AS step),
    place AS (SELECT DISTINCT mosaic_id, step, x.x, y.y FROM mosaic, steps, range(23) x(x), range(8) y(y)),
    twin AS (SELECT p.mosaic_id, p.step, p.x, p.y, coalesce(bool_or(a.alpha AND a.ord < p.step), false) AS black, coalesce(bool_or(a.alpha AND a.ord = p.step), false) AS white
        FROM place p LEFT JOIN a ON a.mosaic_id = p.mosaic_id AND a.x = p.x AND a.y = p.y GROUP BY ALL),
    kind AS (SELECT mosaic_id, step, CASE WHEN NOT bool_or(white AND black) THEN 'none' WHEN bool_or(white AND NOT black) THEN 'partial' ELSE 'complete' END AS overlap FROM twin GROUP BY ALL),
    dist AS (SELECT p.mosaic_id, p.step, p.x, p.y, p.white, min((p.x - f.x) ** 2 + (p.y - f.y) ** 2) FILTER (f.white AND NOT f.black) AS dw,
        min((p.x - f.x) ** 2 + (p.y - f.y) ** 2) FILTER (f.black AND NOT f.white) AS db FROM twin p JOIN twin f USING (mosaic_id, step) GROUP BY ALL)
    SELECT mosaic_id, step, x, y, CASE overlap WHEN 'complete' THEN 0 WHEN 'none' THEN CASE WHEN white THEN 255 ELSE 0 END
        ELSE CASE WHEN dw IS NOT NULL AND (db IS NULL OR dw < db) THEN 255 ELSE 0 END END::BIGINT AS m FROM dist JOIN kind USING (mosaic_id, step)""",
    "mosaic",
)
def b07(spark, sf):
    return blend.blend(_alpha_mosaic(spark, sf), MOSAIC, 23, 8, 4, 2, masks_only=True)


_STACK = f""", w AS (SELECT *, 255 - abs(v - 128) AS w FROM bracket),
gray0 AS (SELECT scene_id * 3 + ord AS image_id, x, y, v, floor(255 * w / sum(w) OVER (PARTITION BY scene_id, x, y) + 0.5)::BIGINT AS m FROM w),
g1 AS ({_reduce_sql("gray0", 8, ("v", "m"), alpha=False)}), e0 AS ({_expand_sql("g1", 8)}),
p0 AS (SELECT image_id // 3 AS image_id, x, y, (a.v - b.v) * a.m / 255::DOUBLE AS t FROM gray0 a JOIN e0 b USING (image_id, x, y)),
p1 AS (SELECT image_id // 3 AS image_id, x, y, v * m / 255::DOUBLE AS t FROM g1),
b0 AS (SELECT image_id, x, y, sum(CASE WHEN t >= 0 THEN floor(t + 0.5) ELSE ceil(t - 0.5) END)::BIGINT AS v FROM p0 GROUP BY ALL),
b1 AS (SELECT image_id, x, y, sum(CASE WHEN t >= 0 THEN floor(t + 0.5) ELSE ceil(t - 0.5) END)::BIGINT AS v FROM p1 GROUP BY ALL),
up AS ({_expand_sql("b1", 8)})
SELECT image_id AS scene_id, x, y, least(greatest(b0.v + up.v, 0), 255)::BIGINT AS v FROM b0 JOIN up USING (image_id, x, y)"""


@query("m10_stack_blend", _STACK, "bracket")
def m10(spark, sf):
    from tessera.operators import stack

    s = fx.bracket(spark, sf).withColumn("w", 255 - F.abs(F.col("v") - 128))
    masked = stack.normalise(s, ["scene_id", "x", "y"]).withColumn("m", F.floor(F.col("m") + 0.5).cast("long"))
    return fuse.blend_stack(masked, ["scene_id"], 2)


@query("fuse_stack")
def fuse_stack(spark, sf):
    return fuse.fuse(fx.bracket(spark, sf), ["scene_id"], FuseConfig(contrast_weight=0.3, entropy_weight=0.1), side=16)


@query("fuse_exposure_stack", _STACK.replace("255 - abs(v - 128) AS w", _weights("v / 255")["gaussian"] + " AS w"), "bracket")
def fuse_exposure_stack(spark, sf):
    return fuse.fuse(fx.bracket(spark, sf), ["scene_id"], FuseConfig(), side=16)


_HI, _LO = "greatest(r, g, b)", "least(r, g, b)"
_SATURATION = f"(CASE WHEN {_HI} = {_LO} THEN 0 WHEN {_HI} + {_LO} <= 255 THEN ({_HI} - {_LO}) / ({_HI} + {_LO}) ELSE ({_HI} - {_LO}) / (510 - {_HI} - {_LO}) END::DOUBLE)"
_COLOR_SCORE = f"CASE WHEN alpha THEN 0.9::DOUBLE * CASE WHEN {_LO} >= 25.5 AND {_HI} <= 229.5 THEN {_weights('((r + g + b) / 3 / 255)')['gaussian']} ELSE 0 END + 0.2::DOUBLE * {_SATURATION} + 0.3::DOUBLE * coalesce(sd, 0) / 255 ELSE 0 END"


@query(
    "fuse_color_scores",
    f""", p AS MATERIALIZED (SELECT *, floor((r + g + b) / 3 + 0.5)::BIGINT AS v FROM color_bracket),
    moved AS (SELECT scene_id, ord, x + dx AS x, y + dy AS y, v FROM p, range(-2, 3) i(dx), range(-2, 3) j(dy) WHERE alpha),
    sd AS (SELECT p.scene_id, p.ord, p.x, p.y, coalesce(stddev_samp(moved.v), 0) AS sd FROM p JOIN moved USING (scene_id, ord, x, y)
        WHERE p.alpha AND p.x BETWEEN 2 AND 5 AND p.y BETWEEN 2 AND 5 GROUP BY ALL)
    SELECT p.scene_id, p.ord, p.x, p.y, {_R.format(_COLOR_SCORE)} AS w FROM p LEFT JOIN sd USING (scene_id, ord, x, y)""",
    "color_bracket",
)
def fuse_color_scores(spark, sf):
    config = FuseConfig(exposure_weight=0.9, saturation_weight=0.2, contrast_weight=0.3, exposure_lower=0.1, exposure_upper=0.9)
    out = fuse.score(fx.color_bracket(spark, sf), ["scene_id", "ord"], config, channels=fuse.RGB, alpha="alpha")
    return out.select("scene_id", "ord", "x", "y", r6(F.col("w")).alias("w"))


@query("fuse_color_stack")
def fuse_color_stack(spark, sf):
    config = FuseConfig(saturation_weight=0.2, contrast_weight=0.3, entropy_weight=0.1, projector="luminance", edge_scale=0.5, min_curvature=0.01, exposure_lower=0.05)
    return fuse.fuse(fx.color_bracket(spark, sf), ["scene_id"], config, side=16, channels=fuse.RGB, alpha="alpha")


@query(
    "b_gigapixel_bounds",
    """WITH p AS (SELECT DISTINCT l_orderkey % 4000 AS x, l_partkey % 3000 AS y FROM lineitem), b AS (SELECT *, y BETWEEN 1500 AND 2499 AS white, y >= 2000 AS black FROM p)
    SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) FILTER (white AND black) AS shared,
        CASE WHEN NOT bool_or(white AND black) THEN 'none' WHEN bool_or(white AND NOT black) THEN 'partial' ELSE 'complete' END AS overlap FROM b WHERE white OR black""",
)
def gigapixel(spark, sf):
    """Two opposing bands of a wide canvas, at the places that line items name: the box of both, and how they overlap."""
    places = fx.table(spark, sf, "lineitem").select((F.col("l_orderkey") % 4000).alias("x"), (F.col("l_partkey") % 3000).alias("y")).distinct()
    both = places.withColumns({"white": F.col("y").between(1500, 2499), "black": F.col("y") >= 2000}).withColumn("alpha", F.col("white") | F.col("black")).filter("alpha")
    # aggregates without keys: one row each, also where the bands hold nothing
    shared = both.agg(F.count_if(F.col("white") & F.col("black")).alias("shared"))
    return masks.bounding_box(both, []).crossJoin(shared).crossJoin(masks.overlap_class(both, []))
