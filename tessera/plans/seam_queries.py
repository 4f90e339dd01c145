"""Queries of the seam kernels; sequential, so checked by tests against plain twins rather than by SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import cuts, lines, paths, regions, seams
from tessera.plans.raster_queries import KEYS, _binary
from tessera.plans.registry import query
from tessera.sources import fixtures as fx


@query("g04_vectorise")
def g04(spark, sf):
    def kernel(image: np.ndarray) -> list[tuple]:
        return [(c, o, m, x, y) for c, contour in enumerate(seams.vectorise(image)) for o, (m, x, y) in enumerate(contour)]

    return seams.per_image(_binary(spark, sf), KEYS, kernel, "contour_id long, ord long, movable boolean, x long, y long", "m")


@query("g06_movable_runs")
def g06(spark, sf):
    def kernel(image: np.ndarray) -> list[tuple]:
        return [(c, s, o, m, x, y) for c, contour in enumerate(seams.vectorise(image, 2)) for s, run in enumerate(seams.movable_runs(contour)) for o, (m, x, y) in enumerate(run)]

    return seams.per_image(_binary(spark, sf), KEYS, kernel, "contour_id long, segment_id long, ord long, movable boolean, x long, y long", "m")


def _bright(image: np.ndarray) -> np.ndarray:
    """The brighter half of an image as guide: its border differs from image to image."""
    return np.where(image >= np.median(image), 255, 0)


@query("g10_graph_cut")
def g10(spark, sf):
    def kernel(image: np.ndarray) -> list[tuple]:
        walls = cuts.cut(image, np.ones_like(image, bool), _bright(image), image)
        return [(c, o, x, y) for c, wall in enumerate(walls) for o, (x, y) in enumerate(wall)]

    return seams.per_image(fx.gray(spark, sf), KEYS, kernel, "leg long, ord long, x long, y long")


@query("g14_cut_labels")
def g14(spark, sf):
    def kernel(image: np.ndarray) -> list[tuple]:
        mask = cuts.cut_mask(image, np.ones_like(image, bool), _half_guide(image), image)
        return [(x, y, int(mask[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]

    return seams.per_image(fx.gray(spark, sf), KEYS, kernel, "x long, y long, m long")


@query("g15_anneal")
def g15(spark, sf):
    def kernel(images: list[np.ndarray]) -> list[list[tuple]]:
        found = [seams.vectorise(_bright(image), 2) for image in images]
        moved = iter(seams.anneal_all([(image, contour) for image, contours in zip(images, found) for contour in contours]))
        return [[(c, o, m, x, y) for c, _ in enumerate(contours) for o, (m, x, y) in enumerate(next(moved))] for contours in found]

    return seams.per_images(fx.gray(spark, sf), KEYS, kernel, "contour_id long, ord long, movable boolean, x long, y long")


@query("g21_cheapest_path")
def g21(spark, sf):
    def kernel(image: np.ndarray) -> list[tuple]:
        h, w = image.shape
        return [(o, x, y) for o, (x, y) in enumerate(seams.cheapest_path(image, (0, 0), (w - 1, h - 1)))]

    return seams.per_image(fx.gray(spark, sf), KEYS, kernel, "ord long, x long, y long")


@query(
    "g25_segments_cross",
    ", s AS (SELECT image_id, x, y, r % 20 AS ax, g % 20 AS ay, b % 20 AS bx, r % 7 AS by_, g % 9 AS cx, b % 11 AS cy, r % 13 AS dx, b % 17 AS dy FROM rgb) SELECT image_id, x, y, ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0 AS crosses FROM s",
    "rgb",
)
def g25(spark, sf):
    s = fx.rgb(spark, sf)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    p = {"a": (r % 20, g % 20), "b": (b % 20, r % 7), "c": (g % 9, b % 11), "d": (r % 13, b % 17)}
    side = lambda i, j, k: (p[j][0] - p[i][0]) * (p[k][1] - p[i][1]) - (p[j][1] - p[i][1]) * (p[k][0] - p[i][0])
    return s.select("image_id", "x", "y", ((side("a", "b", "c") * side("a", "b", "d") < 0) & (side("c", "d", "a") * side("c", "d", "b") < 0)).alias("crosses"))


def _half_guide(image: np.ndarray) -> np.ndarray:
    return np.where(np.arange(image.shape[1]) < image.shape[1] // 2, 255, 0) * np.ones((image.shape[0], 1), np.int64)


@query("g08_create_mask")
def g08(spark, sf):
    def kernel(images: list[np.ndarray]) -> list[list[tuple]]:
        masks = cuts.create_masks([(image, np.ones_like(image, bool), _half_guide(image), image) for image in images], 2, graph_cut=True)
        return [[(x, y, int(mask[y, x])) for y in range(mask.shape[0]) for x in range(mask.shape[1])] for mask in masks]

    return seams.per_images(fx.gray(spark, sf), KEYS, kernel, "x long, y long, m long")


@query("g09_vectorised_mask_round_trip", ", bin AS (SELECT image_id, x, y, CASE WHEN v >= 90 THEN 255 ELSE 0 END::BIGINT AS m FROM gray) SELECT image_id, x, y, m FROM bin", "gray")
def g09_round_trip(spark, sf):
    def kernel(image: np.ndarray) -> list[tuple]:
        mask = np.where(seams.fill([[(x, y) for _, x, y in c] for c in seams.vectorise(image, 1)], image.shape), 255, 0)
        return [(x, y, int(mask[y, x])) for y in range(image.shape[0]) for x in range(image.shape[1])]

    return seams.per_image(_binary(spark, sf), KEYS, kernel, "x long, y long, m long", "m")


@query("g20_refine")
def g20(spark, sf):
    def kernel(image: np.ndarray) -> list[tuple]:
        # corners on the far edges are no pixels
        contours = [[v for v in c if v[1] < image.shape[1] and v[2] < image.shape[0]] for c in seams.vectorise(_bright(image), 3)]
        return [(c, o, x, y) for c, contour in enumerate(contours) for o, (x, y) in enumerate(seams.refine(image, contour))]

    return seams.per_image(fx.gray(spark, sf), KEYS, kernel, "contour_id long, ord long, x long, y long")


# four lines an image, from and to places that its pixels name
_ENDS = """, p AS (SELECT image_id, y AS line, max(CASE WHEN x = 0 THEN v % 8 END) AS ax, max(CASE WHEN x = 1 THEN v % 8 END) AS ay, max(CASE WHEN x = 2 THEN v % 11 END) AS bx, max(CASE WHEN x = 3 THEN v % 11 END) AS by_
    FROM gray WHERE y < 4 GROUP BY image_id, y),
sides AS (SELECT *, greatest(abs(bx - ax), abs(by_ - ay)) AS n FROM p),
dots AS (SELECT image_id, line, unnest(range(n)) AS t, ax, ay, bx, by_, n FROM sides),
px AS (SELECT image_id, line, t, ax + sign(bx - ax)::BIGINT * (t * abs(bx - ax) // n) AS x, ay + sign(by_ - ay)::BIGINT * (t * abs(by_ - ay) // n) AS y FROM dots)"""


def _lines(spark, sf):
    end = lambda x, m: F.max(F.when(F.col("x") == x, F.col("v") % m))
    return fx.gray(spark, sf).filter("y < 4").groupBy("image_id", F.col("y").alias("line")).agg(end(0, 8).alias("ax"), end(1, 8).alias("ay"), end(2, 11).alias("bx"), end(3, 11).alias("by"))


@query(
    "g19_line_costs",
    _ENDS + """, under AS (SELECT image_id, line, sum(coalesce(v, 255)) AS s FROM px LEFT JOIN gray USING (image_id, x, y) GROUP BY ALL)
    SELECT image_id, line, (coalesce(s, 0) + 255 * greatest(8 - n, 0))::BIGINT AS cost FROM sides LEFT JOIN under USING (image_id, line)""",
    "gray",
)
def g19(spark, sf):
    return lines.costs(_lines(spark, sf), fx.gray(spark, sf), ["image_id", "line"], ["image_id"])


@query(
    "g24_seam_drawing",
    _ENDS.replace("% 11", "% 8").replace("p AS (", "p0 AS (", 1).replace(
        "sides AS (", "p AS (SELECT image_id, line, ax, ay, coalesce(lead(ax) OVER o, first(ax) OVER o) AS bx, coalesce(lead(ay) OVER o, first(ay) OVER o) AS by_ FROM p0 WINDOW o AS (PARTITION BY image_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),\nsides AS (", 1
    )
    + """, marks AS (SELECT image_id, x, y, 1 AS mark FROM px UNION ALL SELECT image_id, ax, ay, CASE WHEN line % 2 = 1 THEN 3 ELSE 2 END FROM p0)
    SELECT image_id, x, y, max(mark)::BIGINT AS mark FROM marks GROUP BY image_id, x, y""",
    "gray",
)
def g24(spark, sf):
    v = _lines(spark, sf).select("image_id", F.lit(0).alias("contour"), F.col("line").alias("ord"), (F.col("line") % 2 == 1).alias("movable"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    return lines.draw(v, ["image_id"], 8, 8)


# tiles smaller than the 8 x 8 images, so that regions and paths cross their borders
_SMALL = 4


@query(
    "g14_connected_regions",
    """, bin AS (SELECT image_id, x, y, CASE WHEN v >= 90 THEN 1 ELSE 0 END AS m FROM gray),
    reach(image_id, x, y, region) USING KEY (image_id, x, y) AS (
        SELECT image_id, x, y, y * 2147483648 + x FROM bin
        UNION
        SELECT b.image_id, b.x, b.y, min(p.region) FROM reach p JOIN bin a ON a.image_id = p.image_id AND a.x = p.x AND a.y = p.y
        JOIN bin b ON b.image_id = a.image_id AND b.m = a.m AND abs(b.x - a.x) + abs(b.y - a.y) = 1
        JOIN recurring.reach k ON k.image_id = b.image_id AND k.x = b.x AND k.y = b.y WHERE p.region < k.region GROUP BY b.image_id, b.x, b.y)
    SELECT image_id, x, y, region FROM reach""",
    "gray",
)
def g14_regions(spark, sf):
    return regions.connected(_binary(spark, sf), KEYS, "m", _SMALL)


_DISTANCES = """, steps AS (SELECT image_id, x, y, greatest(1, v) * CASE WHEN v = 255 THEN 65536 ELSE 1 END AS c FROM gray),
    dist(image_id, x, y, d) USING KEY (image_id, x, y) AS (
        SELECT DISTINCT image_id, image_id % 8, 0::BIGINT, 0::BIGINT FROM gray
        UNION
        SELECT s.image_id, s.x, s.y, min(p.d + CASE WHEN s.x <> p.x AND s.y <> p.y THEN s.c * 14 // 10 ELSE s.c END) AS d
        FROM dist p JOIN steps s ON s.image_id = p.image_id AND s.x BETWEEN p.x - 1 AND p.x + 1 AND s.y BETWEEN p.y - 1 AND p.y + 1
        LEFT JOIN recurring.dist k ON k.image_id = s.image_id AND k.x = s.x AND k.y = s.y
        WHERE k.d IS NULL OR p.d + CASE WHEN s.x <> p.x AND s.y <> p.y THEN s.c * 14 // 10 ELSE s.c END < k.d
        GROUP BY s.image_id, s.x, s.y)"""


@query("g21_path_distances", _DISTANCES + " SELECT image_id, x, y, d FROM dist", "gray")
def g21_distances(spark, sf):
    """From one place of the top row of each image to all others."""
    cost = fx.gray(spark, sf).withColumnRenamed("v", "cost")
    return paths.distances(cost, KEYS, ["cost"], cost.select("image_id", (F.col("image_id") % 8).alias("x"), F.lit(0).cast("long").alias("y")).distinct(), side=_SMALL)


@query("g21_tiled_paths", _DISTANCES + " SELECT image_id, d AS cost FROM dist WHERE x = 7 AND y = 7", "gray")
def g21_tiled(spark, sf):
    """What the paths cost, added up along their places, from the last place of each image to the top row."""
    cost = fx.gray(spark, sf).withColumnRenamed("v", "cost")
    ends = cost.select("image_id", F.lit(7).cast("long").alias("x"), F.lit(7).cast("long").alias("y"), (F.col("image_id") % 8).alias("x2"), F.lit(0).cast("long").alias("y2")).distinct()
    walk = paths.cheapest(cost, KEYS, ["cost"], ends, side=_SMALL).join(cost.select("image_id", "x", "y", "cost"), ["image_id", "x", "y"])
    order = W.partitionBy("image_id").orderBy("ord")
    straight = F.greatest(F.lit(1), F.col("cost")) * F.when(F.col("cost") == 255, 65_536).otherwise(1)
    slanted = (F.col("x") != F.lead("x").over(order)) & (F.col("y") != F.lead("y").over(order))
    entered = F.when(F.lead("x").over(order).isNull(), 0).when(slanted, F.call_function("div", straight * 14, F.lit(10))).otherwise(straight)
    return walk.select("image_id", entered.cast("long").alias("c")).groupBy("image_id").agg(F.sum("c").alias("cost"))
