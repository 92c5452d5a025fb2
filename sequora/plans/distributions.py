"""Histograms, densities, survival, divergences."""

from __future__ import annotations

from math import exp

from pyspark.sql import Window
from pyspark.sql import functions as F

from sequora.operators import blocks, distributions as ds, sequences as sq
from sequora.operators.sequences import r6
from sequora.plans.registry import EV, GAP, query
from sequora.plans.windows import RUNS
from sequora.sources import formats
from sequora.sources.bindings import event_sequence, group_of, table

HB = "floor((x - {lo}) / (({hi} - {lo}) / {n}::DOUBLE))"


def hist_sql(source: str, lo: str, hi: str, n: int) -> str:
    b = HB.format(lo=lo, hi=hi, n=n)
    w = f"(({hi} - {lo}) / {n}::DOUBLE)"
    return f"h AS (SELECT {b}::INT AS bin, count(*) AS n FROM ({source}) WHERE x > {lo} AND x < {hi} AND x > {lo} + {b} * {w} AND x < {lo} + ({b} + 1) * {w} GROUP BY ALL), bins AS (SELECT unnest(range(0, {n}))::INT AS bin)"


@query(f"WITH {hist_sql('SELECT l_quantity AS x FROM lineitem', '0.0::DOUBLE', '50.0::DOUBLE', 20)} SELECT bin, coalesce(n, 0) AS n FROM bins LEFT JOIN h USING (bin)")
def hist_open_bins(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(ds.open_bin(F.col("l_quantity"), 0.0, 50.0, 20).alias("bin")).where("bin is not null")
    return ds.filled(x.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), 20)


@query(f"WITH z AS (SELECT (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem) AS x FROM lineitem), {hist_sql('SELECT round(x, 8) AS x FROM z', '-3.0::DOUBLE', '3.0::DOUBLE', 24)} SELECT bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(n) OVER (), 6) AS share FROM bins LEFT JOIN h USING (bin)")
def hist_zscore(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    ends = F.broadcast(x.agg(F.avg("l_extendedprice").alias("mu"), F.stddev_pop("l_extendedprice").alias("sd")))
    z = x.join(ends).select(ds.open_bin(F.round((F.col("l_extendedprice") - F.col("mu")) / F.col("sd"), 8), -3.0, 3.0, 24).alias("bin")).where("bin is not null")
    out = ds.filled(z.groupBy("bin").agg(F.count(F.lit(1)).alias("n")), 24)
    return out.select("bin", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query(f"""WITH z AS (SELECT (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem) AS x FROM lineitem), {hist_sql('SELECT round(x, 8) AS x FROM z', '-3.0::DOUBLE', '3.0::DOUBLE', 24)}, top AS (SELECT max(n) / sum(n) AS a FROM h)
SELECT i::INT AS i, round(-3.125::DOUBLE + i * 6.25 / 239, 6) AS x, round(a * exp(-((-3.125::DOUBLE + i * 6.25 / 239) ** 2) / 2), 6) AS g FROM top, unnest(range(0, 240)) AS u(i)""")
def hist_gaussian(spark, sf_dir):
    """The Gaussian curve beside a histogram of standardised values: its height is the largest share of a bin, its mean 0, its deviation 1; ten places per bin."""
    top = hist_zscore(spark, sf_dir).agg((F.max("n") / F.sum("n")).alias("a"))
    lines = top.select("a", F.explode(F.sequence(F.lit(0), F.lit(239))).alias("i")).withColumn("x", -3.125 + F.col("i") * 6.25 / 239)
    return lines.select("i", r6(F.col("x")).alias("x"), r6(ds.gaussian(F.col("x"), F.col("a"), F.lit(0.0), F.lit(1.0))).alias("g"))


@query("WITH c AS (SELECT least(floor((l_quantity - 1) / (49 / 10.0::DOUBLE)), 9)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY ALL) SELECT bin, n, round(n / (sum(n) OVER () * 4.9::DOUBLE), 6) AS density FROM c")
def hist_density(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(ds.closed_bin(F.col("l_quantity"), 1.0, 50.0, 10).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return c.select("bin", "n", r6(F.col("n") / (F.sum("n").over(Window.partitionBy()) * 4.9)).alias("density"))


PIX = "SELECT trunc((l_extendedprice - 1000) * 39 / 99000::DOUBLE)::INT + 2 AS ix, trunc((l_quantity - 1) * 19 / 49::DOUBLE)::INT + 2 AS iy, l_discount AS z FROM lineitem"


def pixels(spark, sf_dir):
    ix = ds.place(F.col("l_extendedprice"), 1000.0, 100000.0, 40, 2)
    iy = ds.place(F.col("l_quantity"), 1.0, 50.0, 20, 2)
    return table(spark, sf_dir, "lineitem").select(ix.alias("ix"), iy.alias("iy"), F.col("l_discount").alias("z"))


@query(f"SELECT ix, iy, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM ({PIX}) GROUP BY ALL")
def density2d(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n")).select("ix", "iy", "n", r6(F.log10("n")).alias("log_n"))


@query(f"SELECT ix, iy, round(avg(z), 6) AS mean, round(sum(z), 4) AS total FROM ({PIX}) GROUP BY ALL")
def density2d_z(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("ix", "iy").agg(r6(F.avg("z")).alias("mean"), F.round(F.sum("z"), 4).alias("total"))


KERNEL = [round(exp(-(i * i) / 8), 12) for i in range(-8, 9)]
WEIGHTS = [w / sum(KERNEL) for w in KERNEL]
KSQL = "k AS (SELECT unnest(range(-8, 9)) AS d, unnest([" + ", ".join(f"{w!r}::DOUBLE" for w in WEIGHTS) + "]) AS w)"


SMOOTH = f"""{KSQL},
 a AS (SELECT CASE WHEN ix + d < 0 THEN -1 - (ix + d) WHEN ix + d > 43 THEN 87 - (ix + d) ELSE ix + d END AS ix, iy, sum(n * w) AS n FROM c, k GROUP BY ALL),
 b AS (SELECT ix, CASE WHEN iy + d < 0 THEN -1 - (iy + d) WHEN iy + d > 23 THEN 47 - (iy + d) ELSE iy + d END AS iy, sum(n * w) AS n FROM a, k GROUP BY ALL)"""


@query(f"WITH c AS (SELECT ix, iy, count(*) AS n FROM ({PIX}) GROUP BY ALL), {SMOOTH} SELECT ix::INT AS ix, iy::INT AS iy, round(n, 6) AS n FROM b")
def density2d_smooth(spark, sf_dir):
    c = pixels(spark, sf_dir).groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    return ds.smoothed(c, "n", WEIGHTS, (43, 23)).select("ix", "iy", r6(F.col("n")).alias("n"))


@query(f"WITH c AS (SELECT ix, iy, avg(z) AS n FROM ({PIX}) GROUP BY ALL), {SMOOTH} SELECT ix::INT AS ix, iy::INT AS iy, round(n, 6) AS mean FROM b")
def density2d_z_smooth(spark, sf_dir):
    """Means per pixel (0 where there is none), smoothed."""
    c = pixels(spark, sf_dir).groupBy("ix", "iy").agg(F.avg("z").alias("n"))
    return ds.smoothed(c, "n", WEIGHTS, (43, 23)).select("ix", "iy", r6(F.col("n")).alias("mean"))


@query(f"WITH {EV} SELECT rec, value, round((row_number() OVER (PARTITION BY rec ORDER BY value) - 1) / (count(*) OVER (PARTITION BY rec) - 1), 6) AS p FROM ev")
def ecdf(spark, sf_dir):
    return ds.ecdf(event_sequence(spark, sf_dir).select("rec", "value"), "value", ("rec",)).select("rec", "value", r6(F.col("p")).alias("p"))


@query(f"WITH {EV} SELECT rec, value, round(1 - (row_number() OVER (PARTITION BY rec ORDER BY value) - 1) / (count(*) OVER (PARTITION BY rec) - 1), 6) AS s FROM ev")
def survival(spark, sf_dir):
    return ds.ecdf(event_sequence(spark, sf_dir).select("rec", "value"), "value", ("rec",)).select("rec", "value", r6(1 - F.col("p")).alias("s"))


TIES = f"WITH {GAP}, {RUNS}, e AS (SELECT label, dur, (row_number() OVER (PARTITION BY label ORDER BY dur) - 1) / (count(*) OVER (PARTITION BY label) - 1) AS p FROM ru), s AS (SELECT label, dur, 1 - avg(p) AS s FROM e GROUP BY ALL)"


@query(f"{TIES} SELECT label, dur, round(s, 6) AS s FROM s")
def survival_ties(spark, sf_dir):
    return ds.survival(sq.runs(event_sequence(spark, sf_dir, gaps=True)), "dur", ("label",)).select("label", "dur", r6(F.col("s")).alias("s"))


@query(f"{TIES} SELECT label, round(regr_slope(ln(s), dur), 6) AS slope, round(regr_intercept(ln(s), dur), 6) AS intercept, round(-1 / regr_slope(ln(s), dur), 2) AS timescale FROM s WHERE s > 1e-12 GROUP BY label")
def survival_fit(spark, sf_dir):
    s = ds.survival(sq.runs(event_sequence(spark, sf_dir, gaps=True)), "dur", ("label",)).where("s > 1e-12")
    fit = s.groupBy("label").agg(F.regr_slope(F.ln("s"), "dur").alias("m"), F.regr_intercept(F.ln("s"), "dur").alias("b"))
    return fit.select("label", r6(F.col("m")).alias("slope"), r6(F.col("b")).alias("intercept"), F.round(-1 / F.col("m"), 2).alias("timescale"))


@query(f"""WITH {EV}, d AS (SELECT value AS x, lead(value, 2) OVER (PARTITION BY rec ORDER BY t) - value AS d, count(*) OVER (PARTITION BY rec) AS m FROM ev),
 b AS (SELECT floor((x + 1e-6) / (500.000002::DOUBLE / 20))::INT AS bin, d FROM d WHERE d IS NOT NULL AND m > 2),
 f AS (SELECT bin, avg(d) / 2 AS drift, var_pop(d) / 4 AS diffusion, count(*) AS n FROM b GROUP BY bin)
SELECT u.bin, round(coalesce(drift, 0), 6) + 0.0 AS drift, round(coalesce(diffusion, 0), 4) AS diffusion, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20))::INT AS bin) u LEFT JOIN f ON f.bin = u.bin""")
def km_drift_diffusion(spark, sf_dir):
    out = ds.drift_diffusion(event_sequence(spark, sf_dir), "value", 0.0, 500.0, 20, 2)
    return out.select("bin", r6(F.col("drift")).alias("drift"), F.round("diffusion", 4).alias("diffusion"), "n")


MASSES = f"{EV}, m AS (SELECT (rec % 7)::INT AS grp, floor(value / 50)::INT AS bin, count(*) AS n FROM ev GROUP BY ALL), pq AS (SELECT g.grp, b.bin, coalesce(m.n, 0) AS p, coalesce(z.n, 0) AS q FROM (SELECT unnest(range(1, 7))::INT AS grp) g, (SELECT unnest(range(0, 10))::INT AS bin) b LEFT JOIN m ON m.grp = g.grp AND m.bin = b.bin LEFT JOIN m z ON z.grp = 0 AND z.bin = b.bin), w AS (SELECT grp, p / sum(p) OVER (PARTITION BY grp) AS p, q / sum(q) OVER (PARTITION BY grp) AS q FROM pq)"
KLSQL = "CASE WHEN {a} > 0 AND {b} > 0 THEN {a} * log2({a} / {b}) ELSE 0 END"


def masses(spark, sf_dir):
    """(grp, bin, p, q): histogram of each group beside that of group 0."""
    m = event_sequence(spark, sf_dir).groupBy(group_of().alias("grp"), F.floor(F.col("value") / 50).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1, 7).select(F.col("id").cast("int").alias("grp")).join(F.broadcast(spark.range(10).select(F.col("id").cast("int").alias("bin"))))
    zero = m.where("grp = 0").select("bin", F.col("n").alias("q"))
    held = grid.join(m.withColumnRenamed("n", "p"), ["grp", "bin"], "left").join(F.broadcast(zero), "bin", "left")
    return held.select("grp", "bin", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))


@query(f"WITH {MASSES} SELECT grp, round(sum({KLSQL.format(a='p', b='q')}), 6) AS kl FROM w GROUP BY grp")
def kl_divergence(spark, sf_dir):
    return ds.kl(masses(spark, sf_dir), "p", "q", ("grp",)).select("grp", r6(F.col("kl")).alias("kl"))


@query(f"WITH {MASSES}, e AS (SELECT grp, p / sum(p) OVER (PARTITION BY grp) AS p, q / sum(q) OVER (PARTITION BY grp) AS q FROM pq WHERE bin % 2 = 0 OR grp < 4) SELECT grp, CASE WHEN bool_or(p = 0 OR q = 0) THEN 0 ELSE round(sum({KLSQL.format(a='p', b='q')}), 6) END AS kl FROM e GROUP BY grp")
def kl_divergence_compat(spark, sf_dir):
    """The divergence that is 0 as soon as any mass is; groups from 4 on have the even bins only."""
    return ds.kl(masses(spark, sf_dir).where("bin % 2 = 0 or grp < 4"), "p", "q", ("grp",), compat=True).select("grp", r6(F.col("kl")).alias("kl"))


@query(f"WITH {MASSES} SELECT grp, round(sum({KLSQL.format(a='p', b='((p + q) / 2)')}) / 2 + sum({KLSQL.format(a='q', b='((p + q) / 2)')}) / 2, 6) AS js FROM w GROUP BY grp")
def js_divergence(spark, sf_dir):
    whole = Window.partitionBy("grp")
    w = masses(spark, sf_dir).select("grp", (F.col("p") / F.sum("p").over(whole)).alias("p"), (F.col("q") / F.sum("q").over(whole)).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    a, b = ds.kl(w, "p", "m", ("grp",)), ds.kl(w, "q", "m", ("grp",)).withColumnRenamed("kl", "kq")
    return a.join(b, "grp").select("grp", r6((F.col("kl") + F.col("kq")) / 2).alias("js"))


@query(f"WITH {EV} SELECT (rec % 7)::INT AS grp, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM ev GROUP BY ALL")
def percentile_ci(spark, sf_dir):
    q = formats.quantiles(event_sequence(spark, sf_dir).withColumn("grp", group_of()), ["grp"], "value", [0.025, 0.975])
    return q.select("grp", r6(F.col("q0")).alias("low"), r6(F.col("q1")).alias("high"))


@query(f"WITH {EV}, s AS (SELECT rec, (rec % 7)::INT AS grp, avg(value) AS score FROM ev GROUP BY rec) SELECT grp, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.025), 6) AS low, round(quantile_cont(score, 0.975), 6) AS high FROM s GROUP BY grp")
def cv_score_summary(spark, sf_dir):
    s = event_sequence(spark, sf_dir).groupBy("rec").agg(F.avg("value").alias("score")).groupBy(group_of().alias("grp"))
    out = s.agg(F.avg("score").alias("m"), F.percentile("score", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return out.select("grp", r6(F.col("m")).alias("mean"), r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"))


@query(f"WITH {EV}, c AS (SELECT rec, label, k % 4 AS kind, count(*) AS n FROM ev GROUP BY ALL) SELECT rec, label, kind, round(n / sum(n) OVER (PARTITION BY rec, label), 6) AS share FROM c")
def type_proportions(spark, sf_dir):
    c = event_sequence(spark, sf_dir).groupBy("rec", "label", (F.col("k") % 4).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("rec", "label", "kind", r6(F.col("n") / F.sum("n").over(Window.partitionBy("rec", "label"))).alias("share"))


@query(f"WITH {EV} SELECT rec, round(sum(CASE WHEN label = 2 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM ev GROUP BY rec HAVING max(micros) - min(micros) > 20 * 86400000000")
def event_rate_min_duration(spark, sf_dir):
    c = event_sequence(spark, sf_dir).groupBy("rec").agg(F.count_if(F.col("label") == 2).alias("a"), F.count(F.lit(1)).alias("n"), (F.max("micros") - F.min("micros")).alias("d"))
    return c.where(F.col("d") > 20 * 86_400_000_000).select("rec", r6(F.col("a") / F.col("n")).alias("rate"))


XYB = "xy AS (SELECT rec, t, label, sum(k * cos(phase)) OVER (PARTITION BY rec ORDER BY t) AS x, sum(k * sin(phase)) OVER (PARTITION BY rec ORDER BY t) AS y FROM ev), bx AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM xy WINDOW w AS (PARTITION BY rec))"


def boxed(spark, sf_dir):
    xy = blocks.running(event_sequence(spark, sf_dir), {"x": F.col("k") * F.cos("phase"), "y": F.col("k") * F.sin("phase")})
    return blocks.with_totals(xy.select("rec", "t", "label", "phase", "x", "y"), x0=F.min("x"), x1=F.max("x"), y0=F.min("y"), y1=F.max("y"))


@query(f"WITH {EV}, {XYB} SELECT rec, round(avg(CASE WHEN least(x - x0, x1 - x, y - y0, y1 - y) <= 10 THEN 1 ELSE 0 END), 6) AS near FROM bx GROUP BY rec")
def bbox_fraction(spark, sf_dir):
    near = F.least(F.col("x") - F.col("x0"), F.col("x1") - F.col("x"), F.col("y") - F.col("y0"), F.col("y1") - F.col("y")) <= 10
    return boxed(spark, sf_dir).groupBy("rec").agg(r6(F.avg(near.cast("int"))).alias("near"))


#: Bins of the cosine to the nearest wall's normal, and the borders between towards, along and away.
WALL_BINS, THIRD = 99, 1 / 3
WALL = f"""{XYB}, h AS (SELECT b.rec, cos(phase) AS cx, sin(phase) AS cy, [x - x0, x1 - x, y - y0, y1 - y] AS d FROM bx b JOIN ev USING (rec, t)),
 o AS (SELECT rec, round(CASE list_position(d, list_min(d)) WHEN 1 THEN cx WHEN 2 THEN -cx WHEN 3 THEN cy ELSE -cy END, 9) AS dot FROM h),
 wb AS (SELECT rec, -1 + (least(floor((dot + 1) * {WALL_BINS} / 2), {WALL_BINS - 1}) + 0.5::DOUBLE) * 2 / {WALL_BINS} AS centre, count(*) AS n FROM o GROUP BY ALL),
 wc AS (SELECT rec, sum(CASE WHEN centre < -{THIRD} THEN n ELSE 0 END)::BIGINT AS towards, sum(CASE WHEN centre > {THIRD} THEN n ELSE 0 END)::BIGINT AS away, sum(CASE WHEN centre BETWEEN -{THIRD} AND {THIRD} THEN n ELSE 0 END)::BIGINT AS along FROM wb GROUP BY rec)"""


@query(f"WITH {EV}, {WALL} SELECT rec, towards, away, along FROM wc")
def wall_orientation(spark, sf_dir):
    """Per recording, how often it heads towards, away from and along the nearest wall, from a histogram of 99 bins of the cosine to its normal."""
    d = F.array(F.col("x") - F.col("x0"), F.col("x1") - F.col("x"), F.col("y") - F.col("y0"), F.col("y1") - F.col("y"))
    held = boxed(spark, sf_dir).select("rec", "phase", d.alias("d")).withColumn("wall", F.array_position("d", F.array_min("d")))
    dot = F.round(F.when(F.col("wall") == 1, F.cos("phase")).when(F.col("wall") == 2, -F.cos("phase")).when(F.col("wall") == 3, F.sin("phase")).otherwise(-F.sin("phase")), 9)
    centre = -1 + (F.least(F.floor((dot + 1) * WALL_BINS / 2), F.lit(WALL_BINS - 1)) + 0.5) * 2 / WALL_BINS
    counts = held.select("rec", centre.alias("c"))
    return counts.groupBy("rec").agg(F.count_if(F.col("c") < -THIRD).alias("towards"), F.count_if(F.col("c") > THIRD).alias("away"), F.count_if(F.col("c").between(-THIRD, THIRD)).alias("along"))


@query("""WITH g AS (SELECT a::INT AS cx, b::INT AS cy, s AS state FROM unnest(range(0, 6)) AS u(a), unnest(range(0, 6)) AS w(b), (SELECT DISTINCT l_returnflag AS s FROM lineitem)), b AS (SELECT floor(l_quantity / 10.001)::INT AS cx, floor(l_discount / 0.021)::INT AS cy, l_returnflag AS state, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT cx, cy, state, round(coalesce(n, 0) / nullif(sum(n) OVER (PARTITION BY cx, cy), 0), 6) AS share FROM g LEFT JOIN b USING (cx, cy, state)""")
def spatial_state_fraction(spark, sf_dir):
    """Shares of the states in each cell of a grid; null in cells that hold nothing."""
    rows = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 10.001).cast("int").alias("cx"), F.floor(F.col("l_discount") / 0.021).cast("int").alias("cy"), F.col("l_returnflag").alias("state"))
    n = rows.groupBy("cx", "cy", "state").agg(F.count(F.lit(1)).alias("n"))
    cells = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(a).alias("cx"), F.lit(b).alias("cy")) for b in range(6)]) for a in range(6)])))
    grid = rows.select("state").distinct().select("state", cells.alias("c")).select("c.*", "state")
    total = F.sum("n").over(Window.partitionBy("cx", "cy"))
    return grid.join(n, ["cx", "cy", "state"], "left").select("cx", "cy", "state", r6(F.coalesce("n", F.lit(0)) / F.nullif(total, F.lit(0))).alias("share"))
