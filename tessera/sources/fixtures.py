"""Rasters derived deterministically from the driver's tables, as pixel relations.

Each has a DataFrame builder and the equal SQL of :data:`SQL`, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray images: image_id, x, y, v in 0..255, alpha where v >= 100."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.5) * 255 + 0.5))).cast("long")
    return e.select("image_id", (F.col("i") % 8).cast("long").alias("x"), F.expr("cast(i div 8 as bigint)").alias("y"), v.alias("v")).withColumn("alpha", F.col("v") >= 100)


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images from id triples: image_id, x, y, r, g, b."""
    g = gray(spark, sf_dir)
    channel = lambda k: F.max(F.when(F.col("image_id") % 3 == k, F.col("v")))
    out = g.groupBy(F.expr("image_id div 3").alias("image"), "x", "y").agg(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))
    return out.filter("r is not null and g is not null and b is not null").withColumnRenamed("image", "image_id")


def bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure brackets: scene_id, ord 0..2, x, y, v with gains 1/2, 1 and 2."""
    gains = F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("ord"), F.lit(n).cast("long").alias("num")) for o, n in enumerate((1, 2, 4)))))
    g = gray(spark, sf_dir).select(F.col("image_id").alias("scene_id"), "x", "y", "v", gains.alias("k"))
    return g.select("scene_id", F.col("k.ord").alias("ord"), "x", "y", F.expr("least(255L, v * k.num div 2)").alias("v"))


def color_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure brackets in colour: scene_id, ord 0..2, x, y, r, g, b with gains 1/2, 1 and 2, alpha where the image's red is 40 or more."""
    gains = F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("ord"), F.lit(n).cast("long").alias("num")) for o, n in enumerate((1, 2, 4)))))
    c = rgb(spark, sf_dir).withColumn("k", gains)
    return c.select(F.col("image_id").alias("scene_id"), F.col("k.ord").alias("ord"), "x", "y", *(F.expr(f"least(255L, {n} * k.num div 2)").alias(n) for n in "rgb"), (F.col("r") >= 40).alias("alpha"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four images a mosaic, each five columns to the right of the last: mosaic_id, ord, x, y, v on a 23 x 8 canvas."""
    g = gray(spark, sf_dir)
    return g.select(F.expr("image_id div 4").alias("mosaic_id"), (F.col("image_id") % 4).alias("ord"), (F.col("x") + 5 * (F.col("image_id") % 4)).alias("x"), "y", "v")


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """12 x 10 counts of line items by month and quantity: x, y, v."""
    li = table(spark, sf_dir, "lineitem")
    x, y = (F.month("l_shipdate") - 1).cast("long"), F.expr("(cast(l_quantity as bigint) - 1) div 5")
    return li.groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("v"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a catalog of image layers: file, layer_no, w, h."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("file"), F.row_number().over(order).cast("long").alias("layer_no"), F.col("l_quantity").cast("long").alias("w"), (1 + F.col("l_partkey") % 16).alias("h"))


#: The same rasters in DuckDB SQL.
SQL = {
    "gray": """SELECT image_id, i % 8 AS x, i // 8 AS y, v, v >= 100 AS alpha FROM (
        SELECT vec_id AS image_id, (generate_subscripts(embedding, 1) - 1)::BIGINT AS i,
               least(255, greatest(0, floor((unnest(embedding)::DOUBLE + 0.5) * 255 + 0.5)))::BIGINT AS v FROM embeddings)""",
    "rgb": """SELECT image_id // 3 AS image_id, x, y, max(v) FILTER (image_id % 3 = 0) AS r, max(v) FILTER (image_id % 3 = 1) AS g,
        max(v) FILTER (image_id % 3 = 2) AS b FROM gray GROUP BY image_id // 3, x, y HAVING count(*) = 3""",
    "bracket": """SELECT image_id AS scene_id, ord::BIGINT AS ord, x, y, least(255, v * num // 2)::BIGINT AS v
        FROM gray, (VALUES (0, 1), (1, 2), (2, 4)) k(ord, num)""",
    "color_bracket": """SELECT image_id AS scene_id, ord::BIGINT AS ord, x, y, least(255, r * num // 2)::BIGINT AS r, least(255, g * num // 2)::BIGINT AS g,
        least(255, b * num // 2)::BIGINT AS b, r >= 40 AS alpha FROM rgb, (VALUES (0, 1), (1, 2), (2, 4)) k(ord, num)""",
    "mosaic": "SELECT image_id // 4 AS mosaic_id, image_id % 4 AS ord, x + 5 * (image_id % 4) AS x, y, v FROM gray",
    "heat": "SELECT (month(l_shipdate) - 1)::BIGINT AS x, (l_quantity::BIGINT - 1) // 5 AS y, count(*) AS v FROM lineitem GROUP BY 1, 2",
    "layers": """SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS layer_no,
        l_quantity::BIGINT AS w, 1 + l_partkey % 16 AS h FROM lineitem""",
}
_NEEDS = {"gray": [], "rgb": ["gray"], "bracket": ["gray"], "color_bracket": ["rgb"], "mosaic": ["gray"], "heat": [], "layers": []}


def with_rasters(body: str, *names: str) -> str:
    """``body`` after the named rasters (and what they need) as common table expressions; further ones may follow in ``body`` after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for m in _NEEDS[name]:
            add(m)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {ctes}{body if body.lstrip().startswith(',') else chr(10) + body}"
