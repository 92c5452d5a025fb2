"""Coverage of the plane by paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequora.operators.blocks import with_totals


def coverage(xy: DataFrame, radii: list[float]) -> DataFrame:
    """(rec, radius, share): share of the unit cells with a centre within each radius that a path reached, for all paths and radii (0 where none).

    Cells are distinct per recording before anything else; each gets the least radius that holds it, so one running sum over the radii
    serves all of them. The denominators come from a grid whose size the largest radius sets.
    """
    spark = xy.sparkSession
    rings = F.array(*[F.lit(float(r)) for r in radii])
    centre = F.sqrt((F.col("ix") + 0.5) ** 2 + (F.col("iy") + 0.5) ** 2)
    ring = F.array_min(F.filter(rings, lambda r: r >= F.col("r")))
    half = int(max(radii)) + 1
    grid = spark.range(-half, half).select(F.col("id").alias("ix")).join(F.broadcast(spark.range(-half, half).select(F.col("id").alias("iy")))).withColumn("r", centre)
    by = Window.orderBy("radius")
    filled = grid.withColumn("radius", ring).where("radius is not null").groupBy("radius").agg(F.count(F.lit(1)).alias("n"))
    rows = spark.range(1).select(F.explode(rings).alias("radius")).join(F.broadcast(filled), "radius", "left")
    cells = rows.select("radius", F.sum(F.coalesce("n", F.lit(0))).over(by).alias("cells"))
    seen = xy.select("rec", F.floor("x").alias("ix"), F.floor("y").alias("iy")).distinct().withColumn("r", centre).withColumn("radius", ring).where("radius is not null")
    per = seen.groupBy("rec", "radius").agg(F.count(F.lit(1)).alias("n"))
    every = xy.select("rec").distinct().select("rec", F.explode(rings).alias("radius"))
    upto = Window.partitionBy("rec").orderBy("radius")
    held = every.join(per, ["rec", "radius"], "left").select("rec", "radius", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("seen"))
    return held.join(F.broadcast(cells), "radius").select("rec", "radius", (F.col("seen") / F.col("cells")).alias("share"))


def re_origin(xy: DataFrame) -> DataFrame:
    """(rec, t, x, y): paths moved to start at the origin and turned by the direction of their first point."""
    first = lambda c: F.min_by(c, "t")
    held = with_totals(xy.select("rec", "t", "x", "y"), x0=first("x"), y0=first("y"))
    held = held.select("rec", "t", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"), F.atan2("y0", "x0").alias("psi"))
    c, s = F.cos("psi"), F.sin("psi")
    return held.select("rec", "t", (F.col("dx") * c + F.col("dy") * s).alias("x"), (F.col("dy") * c - F.col("dx") * s).alias("y"))
