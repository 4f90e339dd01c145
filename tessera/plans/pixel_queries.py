"""Queries of the pixel algebra, the scalar and colour functions, and the exposure weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import colour, exposure, planes, scalar
from tessera.operators import pixelwise as px
from tessera.plans.registry import query
from tessera.sources import fixtures as fx

KEYS = ["image_id"]
PLACE = ["image_id", "x", "y"]


@query("p01_transform", "SELECT image_id, x, y, 255 - v AS v FROM gray", "gray")
def p01(spark, sf):
    return px.transform(fx.gray(spark, sf), v=255 - F.col("v")).drop("alpha")


@query("p02_transform_if", "SELECT image_id, x, y, CASE WHEN alpha THEN 2 * v ELSE v END AS v FROM gray", "gray")
def p02(spark, sf):
    return px.transform_if(fx.gray(spark, sf), F.col("alpha"), v=F.col("v") * 2).drop("alpha")


_SHIFTED = ", other AS (SELECT image_id - 1 AS image_id, x, y, v, alpha FROM gray), third AS (SELECT image_id - 2 AS image_id, x, y, v FROM gray) "


def _next(spark, sf, k=1):
    return fx.gray(spark, sf).withColumn("image_id", F.col("image_id") - k)


@query("p03_combine_two", _SHIFTED + "SELECT image_id, x, y, abs(a.v - b.v) AS v FROM gray a JOIN other b USING (image_id, x, y)", "gray")
def p03(spark, sf):
    return px.combine(fx.gray(spark, sf), _next(spark, sf), PLACE).select(*PLACE, F.abs(F.col("v_a") - F.col("v_b")).alias("v"))


@query("p04_combine_two_if", _SHIFTED + "SELECT image_id, x, y, CASE WHEN a.alpha AND b.alpha THEN a.v + b.v ELSE 0 END AS v FROM gray a JOIN other b USING (image_id, x, y)", "gray")
def p04(spark, sf):
    both = px.combine(fx.gray(spark, sf), _next(spark, sf), PLACE)
    return both.select(*PLACE, F.when(F.col("alpha_a") & F.col("alpha_b"), F.col("v_a") + F.col("v_b")).otherwise(0).alias("v"))


@query("p05_combine_three", _SHIFTED + "SELECT image_id, x, y, greatest(a.v, b.v, c.v) AS v FROM gray a JOIN other b USING (image_id, x, y) JOIN third c USING (image_id, x, y)", "gray")
def p05(spark, sf):
    rows = px.combine_three(fx.gray(spark, sf), _next(spark, sf), _next(spark, sf, 2), PLACE)
    return rows.select(*PLACE, F.greatest("v_a", "v_b", "v_c").alias("v"))


@query("p06_copy", "SELECT image_id, x, y, v, alpha FROM gray", "gray")
def p06(spark, sf):
    return fx.gray(spark, sf)


@query("p07_copy_if", _SHIFTED + "SELECT image_id, x, y, CASE WHEN b.alpha THEN b.v ELSE a.v END AS v FROM gray a LEFT JOIN other b USING (image_id, x, y)", "gray")
def p07(spark, sf):
    return px.overwrite_if(fx.gray(spark, sf), _next(spark, sf), PLACE, "alpha", ["v"]).drop("alpha")


@query("p08_init_if", "SELECT image_id, x, y, CASE WHEN alpha THEN 255 ELSE 0 END::BIGINT AS m FROM gray", "gray")
def p08(spark, sf):
    return fx.gray(spark, sf).select(*PLACE, F.when(F.col("alpha"), 255).otherwise(0).cast("long").alias("m"))


@query("p09_crop", "SELECT image_id, x - 2 AS x, y - 1 AS y, v FROM gray WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 6", "gray")
def p09(spark, sf):
    return px.crop(fx.gray(spark, sf), 2, 1, 7, 6).select("image_id", (F.col("x") - 2).alias("x"), (F.col("y") - 1).alias("y"), "v")


@query("p10_stride", "SELECT image_id, x // 2 AS x, y // 3 AS y, v FROM gray WHERE x % 2 = 0 AND y % 3 = 0", "gray")
def p10(spark, sf):
    return px.stride(fx.gray(spark, sf), 2, 3).drop("alpha")


@query("p11_read_write_functors", "SELECT image_id, x, y, (v // 2) * 2 + 1 AS v FROM gray", "gray")
def p11(spark, sf):
    read, write = (lambda v: F.expr(f"{v} div 2")), (lambda c: c * 2 + 1)
    return fx.gray(spark, sf).select(*PLACE, write(read("v")).alias("v"))


@query("p12_channels", "SELECT image_id, x, y, g AS r, b AS g, r AS b FROM rgb", "rgb")
def p12(spark, sf):
    packed = px.merge_channels(fx.rgb(spark, sf))
    return px.split_channels(packed).select(*PLACE, F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"))


@query("p13_magnitude", "SELECT image_id, x, y, abs(v - 128) AS v FROM gray", "gray")
def p13(spark, sf):
    return fx.gray(spark, sf).select(*PLACE, F.abs(F.col("v") - 128).alias("v"))


@query("p14_xor", _SHIFTED + "SELECT image_id, x, y, xor(a.v, b.v) AS v FROM gray a JOIN other b USING (image_id, x, y)", "gray")
def p14(spark, sf):
    return px.combine(fx.gray(spark, sf), _next(spark, sf), PLACE).select(*PLACE, F.col("v_a").bitwiseXOR(F.col("v_b")).alias("v"))


@query("p15_clamp", "SELECT image_id, x, y, CASE WHEN r <= 60 THEN 0 WHEN r >= 200 THEN 255 ELSE r END AS r, CASE WHEN g <= 60 THEN 0 WHEN g >= 200 THEN 255 ELSE g END AS g, CASE WHEN b <= 60 THEN 0 WHEN b >= 200 THEN 255 ELSE b END AS b FROM rgb", "rgb")
def p15(spark, sf):
    return fx.rgb(spark, sf).select(*PLACE, *(scalar.clamp(F.col(c), 60, 0, 200, 255).alias(c) for c in "rgb"))


@query("p16_fill_in", "SELECT image_id, x, y, CASE WHEN r >= 120 THEN r * 1.5 ELSE g * 0.5 END::DOUBLE AS v FROM rgb", "rgb")
def p16(spark, sf):
    return fx.rgb(spark, sf).select(*PLACE, scalar.fill_in(F.col("r"), F.col("g"), 120, 1.5, 0.5).alias("v"))


@query("p17_saturating_subtract", "SELECT image_id, x, y, CASE WHEN r > g THEN r - g ELSE 0 END AS v FROM rgb", "rgb")
def p17(spark, sf):
    return fx.rgb(spark, sf).select(*PLACE, scalar.saturating_subtract(F.col("r"), F.col("g")).alias("v"))


@query("p18_mask_multiply", "SELECT image_id, x, y, floor(r * g / 255 + 0.5)::BIGINT AS v FROM rgb", "rgb")
def p18(spark, sf):
    return fx.rgb(spark, sf).select(*PLACE, scalar.mask_multiply(F.col("r"), F.col("g"), 255).alias("v"))


@query("p19_masked_lerp", ", m AS (SELECT *, (b - 100) / 60 AS k FROM rgb) SELECT image_id, x, y, floor(CASE WHEN k >= 1 THEN r WHEN k <= 0 THEN g ELSE k * r + (1 - k) * g END * 1000 + 0.5) / 1000 AS v FROM m", "rgb")
def p19(spark, sf):
    k = (F.col("b") - 100) / 60
    return fx.rgb(spark, sf).select(*PLACE, (F.floor(scalar.lerp_masked(k, F.col("r") * 1.0, F.col("g") * 1.0) * 1000 + 0.5) / 1000).alias("v"))


@query("p20_luminance_rescale", "SELECT image_id, x, y, r + g + b AS total, floor((r * 0.3 + g * 0.59 + b * 0.11) / 255 * 127 + 0.5)::BIGINT AS v FROM rgb", "rgb")
def p20(spark, sf):
    c = (F.col("r"), F.col("g"), F.col("b"))
    # the weights are hundredths, so their sum is exact in whole numbers and rounded once
    light = sum(int(100 * w + 0.5) * v for w, v in zip(colour.LUMA, c)) / 100
    return fx.rgb(spark, sf).select(*PLACE, (c[0] + c[1] + c[2]).alias("total"), scalar.half_up(light / 255 * 127).alias("v"))


@query("p21_scalars", "SELECT image_id, x, y, sign(v - 128)::BIGINT AS s, (v - 128) * (v - 128) AS q, floor(log10(v + 1))::BIGINT AS l, CASE WHEN v >= 128 THEN floor((v - 128) / 2 + 0.5) ELSE ceil((v - 128) / 2 - 0.5) END::BIGINT AS h, (v + 3) // 7 AS n FROM gray", "gray")
def p21(spark, sf):
    d = F.col("v") - 128
    return fx.gray(spark, sf).select(*PLACE, F.signum(d).cast("long").alias("s"), (d * d).alias("q"), F.floor(F.log10(F.col("v") + 1)).alias("l"), scalar.half_away(d / 2).alias("h"), F.expr("(v + 3) div 7").alias("n"))


@query("p22_option_amounts", "SELECT image_id, count(*) FILTER (v >= 64) AS absolute, count(*) FILTER (v >= 127.5) AS percent, count(*) FILTER (v >= 255 - 25.5) AS from_top FROM gray GROUP BY image_id", "gray")
def p22(spark, sf):
    at = {k: scalar.Amount.parse(t).of(255) for k, t in (("absolute", "64"), ("percent", "50%"), ("from_top", "-10%"))}
    return fx.gray(spark, sf).groupBy("image_id").agg(*(F.count_if(F.col("v") >= v).alias(k) for k, v in at.items()))


# Colour -----------------------------------------------------------------

_R = "floor(({}) * 1e6 + 0.5) / 1e6"


def r6(c):
    """Six decimals, the same way in both engines."""
    return F.floor(c * 1e6 + 0.5) / 1e6


_LIN = "CASE WHEN {0} / 255 <= 0.04045 THEN {0} / 255 / 12.92 ELSE pow(({0} / 255 + 0.055) / 1.055, 2.4) END"
_XYZ = f""", lin AS (SELECT image_id, x, y, r, g, b, {_LIN.format("r")} AS lr, {_LIN.format("g")} AS lg, {_LIN.format("b")} AS lb FROM rgb),
xyz AS (SELECT *, lr * 0.4360747 + lg * 0.3850649 + lb * 0.1430804 AS cx, lr * 0.2225045 + lg * 0.7168786 + lb * 0.0606169 AS cy, lr * 0.0139322 + lg * 0.0971045 + lb * 0.7141733 AS cz FROM lin)"""
_F = "CASE WHEN {0} > 216.0::DOUBLE / 24389 THEN cbrt({0}) ELSE (24389.0::DOUBLE / 27 * ({0}) + 16) / 116 END"
_LAB = _XYZ + f""", ff AS (SELECT *, {_F.format("(cx / 0.96422)")} AS fx, {_F.format("(cy / 1.0::DOUBLE)")} AS fy, {_F.format("(cz / 0.82521)")} AS fz FROM xyz),
lab AS (SELECT *, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM ff)"""
_LSTAR = "CASE WHEN {0} > 216.0::DOUBLE / 24389 THEN 116 * cbrt({0}) - 16 ELSE 24389.0::DOUBLE / 27 * ({0}) END"
def _rgb():
    return F.col("r"), F.col("g"), F.col("b")



@query(
    "c01_projectors",
    _XYZ
    + f""", y AS (SELECT *, r / 255 * 0.2225045 + g / 255 * 0.7168786 + b / 255 * 0.0606169 AS ly FROM xyz)
    SELECT image_id, x, y, {_R.format("(r + g + b) / 3")} AS average, {_R.format("(" + _LSTAR.format("ly") + ") / 100 * 255")} AS l_star,
    {_R.format("(" + _LSTAR.format("cy") + ") / 100 * 255")} AS pl_star, (least(r, g, b) + greatest(r, g, b)) / 2 AS lightness, greatest(r, g, b)::DOUBLE AS value,
    least(r, g, b)::DOUBLE AS anti_value, {_R.format("r * 0.3::DOUBLE + g * 0.59::DOUBLE + b * 0.11::DOUBLE")} AS luminance, {_R.format("(r * 1.0::DOUBLE + g * 2.0::DOUBLE + b * 5.0::DOUBLE) / 8.0::DOUBLE")} AS mixer FROM y""",
    "rgb",
)
def c01(spark, sf):
    names = ["average", "l-star", "pl-star", "lightness", "value", "anti-value", "luminance"]
    exact = {"lightness", "value", "anti-value"}
    columns = [(c if n in exact else r6(c)).alias(n.replace("-", "_")) for n in names for c in [colour.projector(n)(_rgb(), 255)]]
    return fx.rgb(spark, sf).select(*PLACE, *columns, r6(colour.projector("channel-mixer:1:2:5")(_rgb(), 255)).alias("mixer"))


@query(
    "c09_saturation",
    f"SELECT image_id, x, y, {_R.format('CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 WHEN greatest(r, g, b) + least(r, g, b) <= 255 THEN (greatest(r, g, b) - least(r, g, b)) / (greatest(r, g, b) + least(r, g, b)) ELSE (greatest(r, g, b) - least(r, g, b)) / (510 - greatest(r, g, b) - least(r, g, b)) END')} AS s FROM rgb",
    "rgb",
)
def c09(spark, sf):
    return fx.rgb(spark, sf).select(*PLACE, r6(colour.saturation(_rgb(), 255)).alias("s"))


_HUE = """, d AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
s AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN (g - b) / d WHEN hi = g THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END AS s FROM d),
hue AS (SELECT image_id, x, y, r, g, b, CASE WHEN d = 0 THEN 255 ELSE floor((CASE WHEN s < 0 THEN s + 6 ELSE s END) / 6 * 255 + 0.5) END::BIGINT AS h FROM s)"""


@query("c10_hue", _HUE + " SELECT image_id, x, y, h FROM hue", "rgb")
def c10(spark, sf):
    return fx.rgb(spark, sf).select(*PLACE, colour.hue(_rgb(), 255).alias("h"))


def _rgb_pair(spark, sf):
    a = fx.rgb(spark, sf)
    return px.combine(a, a.withColumn("image_id", F.col("image_id") - 1), PLACE)


def _ab():
    return tuple(F.col(f"{c}_a") for c in "rgb"), tuple(F.col(f"{c}_b") for c in "rgb")



@query(
    "c11_hue_luminance_difference",
    _HUE
    + f""" SELECT p.image_id, p.x, p.y, {_R.format('greatest(0.5 * CASE WHEN abs(p.h - q.h) > 127 THEN 255 - abs(p.h - q.h) ELSE abs(p.h - q.h) END::DOUBLE, 0.5 * abs(floor(p.r * 0.3::DOUBLE + p.g * 0.59::DOUBLE + p.b * 0.11::DOUBLE + 0.5) - floor(q.r * 0.3::DOUBLE + q.g * 0.59::DOUBLE + q.b * 0.11::DOUBLE + 0.5)))')} AS d
    FROM hue p JOIN hue q ON p.image_id = q.image_id - 1 AND p.x = q.x AND p.y = q.y""",
    "rgb",
)
def c11(spark, sf):
    return _rgb_pair(spark, sf).select(*PLACE, r6(colour.hue_luminance_difference(*_ab(), 255)).alias("d"))


@query(
    "c12_delta_e",
    _LAB
    + f" SELECT p.image_id, p.x, p.y, {_R.format('sqrt(((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.bb - q.bb) * (p.bb - q.bb)) / 3) / 128')} AS d FROM lab p JOIN lab q ON p.image_id = q.image_id - 1 AND p.x = q.x AND p.y = q.y",
    "rgb",
)
def c12(spark, sf):
    return _rgb_pair(spark, sf).select(*PLACE, r6(colour.delta_e(*_ab(), 255)).alias("d"))


@query("c13_gray_difference", _SHIFTED + "SELECT image_id, x, y, abs(a.v - b.v) AS d FROM gray a JOIN other b USING (image_id, x, y)", "gray")
def c13(spark, sf):
    return px.combine(fx.gray(spark, sf), _next(spark, sf), PLACE).select(*PLACE, F.abs(F.col("v_a") - F.col("v_b")).alias("d"))


_ENC = "CASE WHEN {0} >= 0 THEN floor({0} + 0.5) ELSE ceil({0} - 0.5) END::BIGINT"


@query(
    "c14_lab",
    _LAB
    + f" SELECT image_id, x, y, {_R.format('l')} AS l, {_R.format('a')} AS a, {_R.format('bb')} AS b, {_ENC.format('(2097152 * (200 + a) / 400)')} AS a_fixed, r AS r_back, g AS g_back, b AS b_back FROM lab",
    "rgb",
)
def c14(spark, sf):
    # the coordinates are columns of their own before the way back uses them, so nothing is computed twice
    rows = fx.rgb(spark, sf).select(*PLACE, *(c.alias(n) for c, n in zip(colour.to_lab(_rgb(), 255), ("l", "a", "b"))))
    lab = (F.col("l"), F.col("a"), F.col("b"))
    back = colour.from_lab(lab, 255)
    fixed = colour.encode_lab(lab, 23)
    return rows.select(*PLACE, *(r6(F.col(n)).alias(n) for n in ("l", "a", "b")), fixed[1].alias("a_fixed"), *(scalar.half_up(c).alias(f"{n}_back") for c, n in zip(back, "rgb")))


@query(
    "c15_luv",
    _XYZ
    + f""", s AS (SELECT *, cx + 15 * cy + 3 * cz AS t, {_LSTAR.format("cy")} AS l FROM xyz),
    uv AS (SELECT *, CASE WHEN t > 0 THEN 4 * cx / t ELSE 4 * 0.96422::DOUBLE / 18.43985 END AS u, CASE WHEN t > 0 THEN 9 * cy / t ELSE 9.0::DOUBLE / 18.43985 END AS v FROM s)
    SELECT image_id, x, y, {_R.format("l")} AS l, {_R.format("13 * l * (u - 4 * 0.96422::DOUBLE / 18.43985)")} AS u, {_R.format("13 * l * (v - 9.0::DOUBLE / 18.43985)")} AS v, r AS r_back, g AS g_back, b AS b_back FROM uv""",
    "rgb",
)
def c15(spark, sf):
    rows = fx.rgb(spark, sf).select(*PLACE, *(c.alias(n) for c, n in zip(colour.to_luv(_rgb(), 255), "luv")))
    back = colour.from_luv((F.col("l"), F.col("u"), F.col("v")), 255)
    return rows.select(*PLACE, *(r6(F.col(n)).alias(n) for n in "luv"), *(scalar.half_up(c).alias(f"{n}_back") for c, n in zip(back, "rgb")))


@query("c20_wrap_limit", "SELECT image_id, x, y, ((v * 3 - 100) % 360 + 360) % 360 AS w, least(greatest(v, 50), 200)::BIGINT AS l FROM gray", "gray")
def c20(spark, sf):
    return fx.gray(spark, sf).select(*PLACE, scalar.wrap(F.col("v") * 3 - 100, 0, 360).cast("long").alias("w"), scalar.limit(F.col("v"), 50, 200).cast("long").alias("l"))


@query("c21_fixed_point", "SELECT image_id, x, y, v * 128 AS encoded, (v * 128 + 64 + x) >> 7 AS half, (v * 100 + 64) >> 7 AS decoded FROM gray", "gray")
def c21(spark, sf):
    v = F.col("v")
    return fx.gray(spark, sf).select(*PLACE, scalar.to_fixed(v, 7).alias("encoded"), scalar.from_fixed(v * 128 + F.col("x"), 7).alias("half"), scalar.from_fixed(v * 100, 7).alias("decoded"))


def _md5_draw(n: int) -> str:
    return f"(('0x' || substr(md5('0,' || image_id || ',' || x || ',' || y), 1, 8))::BIGINT % {n})"


@query(
    "c22_dithered_fixed_point",
    f", q AS (SELECT *, v * 100 // 128 AS whole, v * 100 % 128 AS rest FROM gray) SELECT image_id, x, y, whole + CASE WHEN rest < 32 THEN 0 WHEN rest >= 96 THEN 1 WHEN {_md5_draw(64)} + 32 <= rest THEN 1 ELSE 0 END AS decoded FROM q",
    "gray",
)
def c22(spark, sf):
    q = F.col("v") * 100
    return fx.gray(spark, sf).select(*PLACE, scalar.from_fixed_dithered(q, 7, F.col("image_id"), F.col("x"), F.col("y")).alias("decoded"))


@query(
    "c24_dithered_real",
    f", q AS (SELECT *, v / 8 AS t FROM gray), f AS (SELECT *, floor(t) AS whole, t - floor(t) AS rest FROM q) SELECT image_id, x, y, (whole + CASE WHEN rest < 0.25 THEN 0 WHEN rest >= 0.75 THEN 1 WHEN 0.25 + ({_md5_draw(1 << 20)} + 0.5) / {2 << 20} <= rest THEN 1 ELSE 0 END)::BIGINT AS decoded FROM f",
    "gray",
)
def c24(spark, sf):
    return fx.gray(spark, sf).select(*PLACE, scalar.dither(F.col("v") / 8, F.col("image_id"), F.col("x"), F.col("y")).alias("decoded"))


@query("c23_log_map", f", d AS (SELECT image_id, x, y, (v - 100) / 50 AS t FROM gray), u AS (SELECT *, CASE WHEN t >= 0 THEN 1 + ln(1 + t) ELSE 1 / (1 - t) END AS u FROM d) SELECT image_id, x, y, {_R.format('u')} AS u, {_R.format('t')} AS back FROM u", "gray")
def c23(spark, sf):
    u = scalar.log_map((F.col("v") - 100) / 50)
    return fx.gray(spark, sf).select(*PLACE, r6(u).alias("u"), r6(F.round(scalar.log_unmap(u), 9)).alias("back"))


# Exposure weights --------------------------------------------------------

_Z = "((v / 255::DOUBLE - 0.5) / (0.2::DOUBLE * {0} / {1}))"
_FW = repr(exposure.GAUSS_FWHM)


def _weights(v: str) -> dict[str, str]:
    z = {n: f"(({v} - 0.5) / ({0.2 * exposure.GAUSS_FWHM / own!r}))" for n, (own, _) in exposure.BUILT_IN.items()}
    return {
        "gaussian": f"exp(-{z['gaussian']} * {z['gaussian']} / 2)",
        "lorentzian": f"1 / (1 + {z['lorentzian']} * {z['lorentzian']} / 2)",
        "halfsine": f"CASE WHEN abs({z['halfsine']}) <= pi() / 2 THEN cos({z['halfsine']}) ELSE 0 END",
        "fullsine": f"CASE WHEN abs({z['fullsine']}) <= pi() THEN 0.5 + cos({z['fullsine']}) / 2 ELSE 0 END",
        "bisquare": f"CASE WHEN abs({z['bisquare']}) <= 1 THEN 1 - pow({z['bisquare']}, 4) ELSE 0 END",
    }


@query("e01_exposure_weights", f"SELECT image_id, x, y, {', '.join(f'{_R.format(s)} AS {n}' for n, s in _weights('v / 255').items())} FROM gray", "gray")
def e01(spark, sf):
    return fx.gray(spark, sf).select(*PLACE, *(r6(exposure.weight(n, F.col("v") / 255)).alias(n) for n in exposure.BUILT_IN))


@query("e06_user_weight", f"SELECT image_id, x, y, {_R.format('greatest(0, 1 - abs(v / 255 - 0.5) / 0.2 / 3)')} AS w FROM gray", "gray")
def e06(spark, sf):
    if "triangle" not in exposure.names():
        exposure.register_weight("triangle", lambda z: (1 - z.abs() / 3).clip(lower=0))
    return fx.gray(spark, sf).select(*PLACE, r6(exposure.weight("triangle", F.col("v") / 255)).alias("w"))


@query("e07_tabulated_weight", f"SELECT image_id, x, y, {_R.format(_weights('v / 255')['gaussian'])} AS w FROM gray", "gray")
def e07(spark, sf):
    rows = exposure.lookup(fx.gray(spark, sf), F.col("v") / 255, exposure.tabulated(spark, "gaussian"))
    return rows.select(*PLACE, r6(F.col("w")).alias("w"))


_SAMPLES = ", ".join(f"({_R.format(s)}) AS {n}" for n, s in _weights("y").items())


@query(
    "e08_validate_weights",
    f", w AS (SELECT image_id, {_weights('v / 255')['bisquare']} AS w FROM gray), n AS (SELECT image_id, count(*) FILTER (w < 0) AS n_negative, count(*) FILTER (w > 1) AS n_over, count(*) FILTER (w = 0) AS n_zero, count(*) AS n FROM w GROUP BY image_id) SELECT *, n_negative = 0 AND n_over = 0 AND n_zero < n AS valid FROM n",
    "gray",
)
def e08(spark, sf):
    """Whether the weights of each image's values are in order."""
    return exposure.faults(fx.gray(spark, sf), ["image_id"], exposure.weight("bisquare", F.col("v") / 255, 0.5, 0.2))


@query("e09_dump_weights", f"SELECT DISTINCT v, {_R.format(_weights('v / 255')['lorentzian'])} AS w FROM gray", "gray")
def e09(spark, sf):
    """The weights of the values that occur."""
    return fx.gray(spark, sf).select("v").distinct().withColumn("w", r6(exposure.weight("lorentz", F.col("v") / 255, 0.5, 0.2)))


def _jch_sql() -> str:
    """CIECAM02 step by step, from its published formulas: D50, adapting field 4 cd/m2, background 20, average surround."""
    import math

    white = (96.422, 100.0, 82.521)
    cat = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))
    back = ((1.096124, -0.278869, 0.182745), (0.454369, 0.473533, 0.072098), (-0.009628, -0.005698, 1.015326))
    hpe = ((0.38971, 0.68898, -0.07868), (-0.22981, 1.18340, 0.04641), (0.0, 0.0, 1.0))
    # the inverse to the precision of a double, by one Newton step from the published figures
    times = lambda a, b: tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))
    for _ in range(4):
        ab = times(cat, back)
        back = times(back, tuple(tuple((2.0 if i == j else 0.0) - ab[i][j] for j in range(3)) for i in range(3)))
    k = 1 / 21
    fl = 0.2 * k**4 * 20 + 0.1 * (1 - k**4) ** 2 * 20 ** (1 / 3)
    n = 20 / white[1]
    nbb, z, d = 0.725 * (1 / n) ** 0.2, 1.48 + math.sqrt(n), 1 - math.exp(-46 / 92) / 3.6
    rw = [sum(c * w for c, w in zip(row, white)) for row in cat]
    gain = [d * white[1] / r + 1 - d for r in rw]
    to = times(hpe, back)
    squeeze = lambda x: math.copysign(400, x) * (fl * abs(x) / 100) ** 0.42 / ((fl * abs(x) / 100) ** 0.42 + 27.13) + 0.1
    cone = [squeeze(sum(to[i][j] * gain[j] * rw[j] for j in range(3))) for i in range(3)]
    aw = (2 * cone[0] + cone[1] + cone[2] / 20 - 0.305) * nbb
    f = lambda x: f"{x!r}::DOUBLE"
    sharp = ", ".join(f"{f(gain[i])} * 100 * ({f(cat[i][0])} * cx + {f(cat[i][1])} * cy + {f(cat[i][2])} * cz) AS s{i}" for i in range(3))
    cones = ", ".join(" + ".join(f"{f(to[i][j])} * s{j}" for j in range(3)) + f" AS p{i}" for i in range(3))
    power = lambda i: f"pow({f(fl)} * abs(p{i}) / 100, 0.42)"
    small = ", ".join(f"sign(p{i}) * 400 * {power(i)} / ({power(i)} + 27.13) + 0.1 AS q{i}" for i in range(3))
    chroma = f"pow(50000.0::DOUBLE / 13 * {f(nbb)} * (cos(radians(h) + 2) + 3.8) / 4 * sqrt(ca * ca + cb * cb) / (q0 + q1 + 21 * q2 / 20), 0.9) * sqrt(j / 100) * {f((1.64 - 0.29**n) ** 0.73)}"
    return f""", sharp AS (SELECT *, {sharp} FROM xyz), cones AS (SELECT *, {cones} FROM sharp), small AS (SELECT *, {small} FROM cones),
    opp AS (SELECT *, q0 - 12 * q1 / 11 + q2 / 11 AS ca, (q0 + q1 - 2 * q2) / 9 AS cb, 100 * pow(greatest((2 * q0 + q1 + q2 / 20 - 0.305) * {f(nbb)} / {f(aw)}, 0), {f(0.69 * z)}) AS j FROM small),
    jh AS (SELECT *, degrees(atan2(cb, ca)) AS h FROM opp), jch AS (SELECT *, {chroma} AS c FROM jh)
    SELECT image_id, x, y, round(j, 4) + 0.0 AS j, round(c * cos(radians(h)), 4) + 0.0 AS a, round(c * sin(radians(h)), 4) + 0.0 AS b, r AS r_back, g AS g_back, jch.b AS b_back FROM jch"""


@query("c16_ciecam02_round_trip", _XYZ + _jch_sql(), "rgb")
def c16(spark, sf):
    """Lightness and the chroma vector, and the channels that they give back."""
    from tessera.functions import appearance

    a = fx.rgb(spark, sf).select(*PLACE, appearance.jch(*(c / 255 for c in _rgb())).alias("a"))
    b = a.select("*", appearance.rgb(F.col("a.j"), F.col("a.c"), F.col("a.h")).alias("b"))
    hue = F.radians("a.h")
    seen = [F.round(v, 4) + 0.0 for v in (F.col("a.j"), F.col("a.c") * F.cos(hue), F.col("a.c") * F.sin(hue))]
    return b.select(*PLACE, *(v.alias(n) for v, n in zip(seen, "jab")), *(scalar.half_up(F.col(f"b.{c}") * 255).alias(f"{c}_back") for c in "rgb"))


@query("c17_gamut_repair")
def c17(spark, sf):
    from tessera.functions import appearance

    a = fx.rgb(spark, sf).select(*PLACE, appearance.jch(*(c / 255 for c in _rgb())).alias("a"))
    b = a.select(*PLACE, appearance.rgb(F.col("a.j"), F.col("a.c") * 1.5, F.col("a.h")).alias("b"))
    return b.select(*PLACE, *(r6(F.col(f"b.{c}")).alias(c) for c in "rgb"))


# M13: two images half and half in the planes of CIELAB and CIELUV, and back into the gamut


def _fit_sql(first: str, back: str) -> str:
    """Chroma shares t by halving; ``back`` gives linear channels lr, lg, lb of row columns and {t}."""
    channels = ["CASE WHEN {0} <= 0.0031308 THEN 12.92 * {0} ELSE 1.055 * pow({0}, 1 / 2.4) - 0.055 END".format(c) for c in ("lr", "lg", "lb")]
    outside = " OR ".join(f"greatest(-({c}), ({c}) - 1) > 0.001" for c in channels)
    sql, last = f", t0 AS (SELECT *, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM {first})", "t0"
    for i in range(1, 13):
        sql += f", m{i} AS (SELECT *, (lo + hi) / 2 AS t FROM {last}), {back.format(i=f'm{i}', o=f'l{i}')}, t{i} AS (SELECT * EXCLUDE (t, lr, lg, lb, lo, hi), CASE WHEN {outside} THEN lo ELSE t END AS lo, CASE WHEN {outside} THEN t ELSE hi END AS hi FROM l{i})"
        last = f"t{i}"
    sql += f", w AS (SELECT *, 1.0::DOUBLE AS t FROM {last}), {back.format(i='w', o='wl')}, s AS (SELECT * EXCLUDE (t, lr, lg, lb), CASE WHEN {outside} THEN lo ELSE 1.0::DOUBLE END AS t FROM wl), {back.format(i='s', o='sl')}"
    done = ", ".join(f"floor(least(greatest({c}, 0), 1) * 255 + 0.5)::BIGINT AS {n}" for n, c in zip("rgb", channels))
    return sql + f" SELECT image_id, x, y, {done} FROM sl"


def _mixed_sql(l: str, one: str, two: str, source: str) -> str:
    enc = lambda c: f"floor({c} + 0.5)::BIGINT"
    return f""", e AS (SELECT image_id, x, y, {enc(f'128 * {l} / 100')} AS e1, {enc(f'128 * (200 + {one}) / 400')} AS e2, {enc(f'128 * (200 + {two}) / 400')} AS e3 FROM {source}),
    mixed AS (SELECT p.image_id, p.x, p.y, (p.e1 + q.e1 + 1) // 2 * 100.0::DOUBLE / 128 AS cl, (p.e2 + q.e2 + 1) // 2 * 400.0::DOUBLE / 128 - 200 AS c1, (p.e3 + q.e3 + 1) // 2 * 400.0::DOUBLE / 128 - 200 AS c2
        FROM e p JOIN e q ON p.image_id = q.image_id - 1 AND p.x = q.x AND p.y = q.y)"""


_RGB_OF_XYZ = ", ".join(f"{m[0]!r}::DOUBLE * bx + {m[1]!r}::DOUBLE * by_ + {m[2]!r}::DOUBLE * bz AS {n}" for n, m in zip(("lr", "lg", "lb"), colour.FROM_XYZ))
_UNF = "CASE WHEN {0} * {0} * {0} > 216.0::DOUBLE / 24389 THEN {0} * {0} * {0} ELSE (116 * {0} - 16) / (24389.0::DOUBLE / 27) END"
_LAB_BACK = f"""{{i}}f AS (SELECT *, (cl + 16) / 116 AS fy, (cl + 16) / 116 + c1 * t / 500 AS fx, (cl + 16) / 116 - c2 * t / 200 AS fz FROM {{i}}),
    {{i}}x AS (SELECT * EXCLUDE (fx, fy, fz), {_UNF.format('fx')} * 0.96422::DOUBLE AS bx, {_UNF.format('fy')} * 1.0::DOUBLE AS by_, {_UNF.format('fz')} * 0.82521::DOUBLE AS bz FROM {{i}}f),
    {{o}} AS (SELECT * EXCLUDE (bx, by_, bz), {_RGB_OF_XYZ} FROM {{i}}x)"""
_LUV_BACK = f"""{{i}}f AS (SELECT *, CASE WHEN cl > 8 THEN pow((cl + 16) / 116, 3) ELSE cl / (24389.0::DOUBLE / 27) END AS by_,
        CASE WHEN cl > 0 THEN c1 * t / (13 * cl) ELSE 0 END + 4 * 0.96422::DOUBLE / 18.43985 AS u, CASE WHEN cl > 0 THEN c2 * t / (13 * cl) ELSE 0 END + 9.0::DOUBLE / 18.43985 AS v FROM {{i}}),
    {{i}}x AS (SELECT * EXCLUDE (u, v), CASE WHEN cl > 0 THEN by_ * 9 * u / (4 * v) ELSE 0 END AS bx, CASE WHEN cl > 0 THEN by_ * (12 - 3 * u - 20 * v) / (4 * v) ELSE 0 END AS bz FROM {{i}}f),
    {{o}} AS (SELECT * EXCLUDE (bx, by_, bz), {_RGB_OF_XYZ} FROM {{i}}x)"""


def _half_and_half(spark, sf, space):
    pair = _rgb_pair(spark, sf)
    a, b = (planes.into(c, space) for c in _ab())
    mixed = pair.select(*PLACE, *(F.call_function("div", p + q, F.lit(2)).alias(f"p{i}") for i, (p, q) in enumerate(zip(a, b))))
    return mixed.select(*PLACE, *(c.alias(n) for n, c in zip("rgb", planes.out((F.col("p0"), F.col("p1"), F.col("p2")), space))))


@query("m13_lab_planes", _LAB + _mixed_sql("l", "a", "bb", "lab") + _fit_sql("mixed", _LAB_BACK), "rgb")
def m13_lab(spark, sf):
    return _half_and_half(spark, sf, "lab")


_LUV = f""", st AS (SELECT *, cx + 15 * cy + 3 * cz AS t, {_LSTAR.format("cy")} AS l FROM xyz),
    suv AS (SELECT *, CASE WHEN t > 0 THEN 4 * cx / t ELSE 4 * 0.96422::DOUBLE / 18.43985 END AS u, CASE WHEN t > 0 THEN 9 * cy / t ELSE 9.0::DOUBLE / 18.43985 END AS v FROM st),
    luv AS (SELECT image_id, x, y, l, 13 * l * (u - 4 * 0.96422::DOUBLE / 18.43985) AS us, 13 * l * (v - 9.0::DOUBLE / 18.43985) AS vs FROM suv)"""


@query("m13_luv_planes", _XYZ + _LUV + _mixed_sql("l", "us", "vs", "luv") + _fit_sql("mixed", _LUV_BACK), "rgb")
def m13_luv(spark, sf):
    return _half_and_half(spark, sf, "luv")


@query("m13_identity_planes", "SELECT a.image_id, a.x, a.y, (a.r + b.r + 1) // 2 AS r, (a.g + b.g + 1) // 2 AS g, (a.b + b.b + 1) // 2 AS b FROM rgb a JOIN rgb b ON a.image_id = b.image_id - 1 AND a.x = b.x AND a.y = b.y", "rgb")
def m13_identity(spark, sf):
    return _half_and_half(spark, sf, "identity")


@query("m13_jch_planes")
def m13_jch(spark, sf):
    return _half_and_half(spark, sf, "jch")
