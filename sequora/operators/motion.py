"""Angles, paths and correlations of ordered signals.

Lagged statistics join no table with itself: leads over one shared window give the later value, unpivoted over the lags. Windows stay inside
blocks of rows (``blocks``), whatever the length of a recording.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.operators.blocks import here, in_blocks, last_before, owned, running, so_far, with_totals


def unwrap(seq: DataFrame, phase: str) -> DataFrame:
    """Adds ``angle``: the phase without jumps of pi or more; missing values are skipped and stay missing."""
    d = F.col("d")
    w = d + pi - 2 * pi * F.floor((d + pi) / (2 * pi)) - pi  # pmod makes -pi of what is just below it, and that is a jump
    wrapped = F.when((w == -pi) & (d > 0), pi).otherwise(w)
    fix = F.when(d.isNull() | (F.abs(d) < pi), 0.0).otherwise(wrapped - d)
    held = last_before(in_blocks(seq), phase, "before").withColumn("d", F.col(phase) - F.col("before")).withColumn("fix", fix)
    return running(held, {"angle": F.col("fix")}, blocked=True).withColumn("angle", F.col(phase) + F.col("angle")).drop("d", "fix", "before", "_own", "_block")


def positions(seq: DataFrame, step: str, heading: str) -> DataFrame:
    """(rec, t, x, y): running sums of steps along absolute headings."""
    return running(seq, {name: F.col(step) * f(heading) for f, name in ((F.cos, "x"), (F.sin, "y"))}).select("rec", "t", "x", "y")


def steps(xy: DataFrame) -> DataFrame:
    """(rec, t, dist, heading): from each position to the next."""
    dx, dy = F.lead("x").over(here()) - F.col("x"), F.lead("y").over(here()) - F.col("y")
    return in_blocks(xy, ahead=1).select("rec", "t", "_own", dx.alias("dx"), dy.alias("dy")).where("_own and dx is not null").select("rec", "t", F.hypot("dx", "dy").alias("dist"), F.atan2("dy", "dx").alias("heading"))


def path(seq: DataFrame, turn: str, dist: str) -> DataFrame:
    """(rec, t, x, y): a path from turns and step lengths; step i goes along the heading before it."""
    psi = in_blocks(running(seq, {"psi": F.col(turn)}), behind=1)
    held = psi.withColumn("heading", F.coalesce(F.lag("psi").over(here()), F.lit(0.0))).withColumn("first", F.lag("t").over(here()).isNull()).where("_own")
    move = lambda f: F.when(F.col("first"), 0.0).otherwise(F.col(dist) * f("heading"))
    return running(held, {"x": move(F.cos), "y": move(F.sin)}, blocked=True).select("rec", "t", "x", "y")


def lagged(seq: DataFrame, columns: list[str], lags: list[int], breaks: str | None = None) -> DataFrame:
    """(rec, t, lag, columns, columns_later): each row with the row ``lag`` places behind it (before it, for a negative lag).

    Pairs that span a row where ``breaks`` holds (from behind the first of the two to the second) are left out.
    """
    held = in_blocks(seq, behind=max(0, *(-x for x in lags)), ahead=max(0, *lags))
    if breaks:
        held = held.withColumn("_breaks", F.sum(F.col(breaks).cast("int")).over(so_far()))
    carried = [*columns, "_breaks"] if breaks else list(columns)
    at = lambda c, lag: F.lead(c, lag).over(here()) if lag >= 0 else F.lag(c, -lag).over(here())
    later = F.array(*[F.struct(F.lit(lag).alias("lag"), *(at(c, lag).alias(f"{c}_later") for c in carried)) for lag in lags])
    rows = owned(held.select("rec", "t", "_own", "_block", *carried, later.alias("p"))).select("rec", "t", *carried, F.explode("p").alias("p")).select("rec", "t", *carried, "p.*")
    rows = rows.where(F.col(f"{columns[0]}_later").isNotNull())
    return rows.where("_breaks_later = _breaks").drop("_breaks", "_breaks_later") if breaks else rows


def autocorrelation(seq: DataFrame, value: str, lags: list[int], breaks: str | None = None) -> DataFrame:
    """(rec, lag, acf): mean product of centred pairs over the population variance; 1 at lag 0; no pair, no row."""
    held = with_totals(seq, _mean=F.avg(value), v=F.var_pop(value)).withColumn("c", F.col(value) - F.col("_mean"))
    found = lagged(held, ["c", "v"], [x for x in lags if x], breaks).groupBy("rec", "lag").agg((F.avg(F.col("c") * F.col("c_later")) / F.first("v")).alias("acf"))
    return found.unionByName(seq.groupBy("rec").agg(F.lit(0).alias("lag"), F.lit(1.0).alias("acf"))) if 0 in lags else found


def crosscorrelation(seq: DataFrame, x: str, y: str, lags: list[int], breaks: str | None = None) -> DataFrame:
    """(rec, lag, ccf): x now against y ``lag`` rows later (earlier, for a negative lag), centred, over the product of the deviations."""
    held = with_totals(seq, _mx=F.avg(x), _my=F.avg(y), s=F.stddev_pop(x) * F.stddev_pop(y)).withColumn("cx", F.col(x) - F.col("_mx")).withColumn("cy", F.col(y) - F.col("_my"))
    return lagged(held, ["cx", "cy", "s"], lags, breaks).groupBy("rec", "lag").agg((F.avg(F.col("cx") * F.col("cy_later")) / F.first("s")).alias("ccf"))


def dot_autocorrelation(seq: DataFrame, vector: str, lags: list[int], breaks: str | None = None) -> DataFrame:
    """(rec, lag, dot): mean inner product of vectors ``lag`` rows apart, not centred; at lag 0 the mean squared length."""
    dot = F.aggregate(F.zip_with(vector, f"{vector}_later", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return lagged(seq, [vector], lags, breaks).groupBy("rec", "lag").agg(F.avg(dot).alias("dot"))


def msd(xy: DataFrame, lags: list[int]) -> DataFrame:
    """(rec, lag, msd, n): mean squared displacement and the number of pairs; 0 at lag 0."""
    dx, dy = F.col("x_later") - F.col("x"), F.col("y_later") - F.col("y")
    return lagged(xy, ["x", "y"], lags).groupBy("rec", "lag").agg(F.avg(dx * dx + dy * dy).alias("msd"), F.count(F.lit(1)).alias("n"))
