"""Bootstrap statistics with portable draws."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sequora.operators import blocks, resampling as rs, sequences as sq
from sequora.operators.sequences import r6
from sequora.plans.registry import EV, GAP, query, split_sql
from sequora.plans.distributions import WALL, wall_orientation
from sequora.plans.windows import BINARY, RUNS, dwell_means
from sequora.sources import formats
from sequora.sources.bindings import N_STATES, event_sequence, group_of
from sequora.sources.storage import cut

REPS = 50
MEANS = "e AS (SELECT rec, avg(value) AS x, sum(value) AS s, count(*) AS c, (rec % 7)::INT AS grp FROM ev GROUP BY rec), ids AS (SELECT *, row_number() OVER (ORDER BY rec) - 1 AS i, count(*) OVER () AS m FROM e)"
DRAWS = split_sql(REPS)


def entities(spark, sf_dir):
    return event_sequence(spark, sf_dir).groupBy("rec").agg(F.avg("value").alias("x"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("c")).withColumn("grp", group_of())


def drawn(spark, sf_dir):
    """(rep, rec, x, s, c, grp, times): entities with their multiplicities."""
    e = entities(spark, sf_dir)
    return e.join(rs.multiplicities(e.select("rec"), ["rec"], REPS), "rec")


def summary(reps, point):
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    return reps.agg(q.alias("q")).join(F.broadcast(point)).select(r6(F.col("point")).alias("point"), r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"))


def boot_sql(each: str, point: str) -> str:
    return f"WITH RECURSIVE {EV}, {MEANS}, {DRAWS}, r AS (SELECT rep, {each} AS v FROM d JOIN ids USING (i) GROUP BY rep) SELECT round((SELECT {point} FROM e), 6) AS point, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r"



@query(boot_sql("avg(x)", "avg(x)"))
def boot_mean(spark, sf_dir):
    reps = drawn(spark, sf_dir).groupBy("rep").agg((F.sum(F.col("x") * F.col("times")) / F.sum("times")).alias("v"))
    return summary(reps, entities(spark, sf_dir).agg(F.avg("x").alias("point")))


@query(boot_sql("quantile_cont(x, 0.5)", "quantile_cont(x, 0.5)"))
def boot_median(spark, sf_dir):
    reps = drawn(spark, sf_dir).groupBy("rep").agg(F.percentile("x", F.lit(0.5), F.col("times")).alias("v"))
    return summary(reps, entities(spark, sf_dir).agg(F.percentile("x", F.lit(0.5)).alias("point")))


@query(boot_sql("max(x)", "max(x)"))
def boot_max(spark, sf_dir):
    reps = drawn(spark, sf_dir).groupBy("rep").agg(F.max("x").alias("v"))
    return summary(reps, entities(spark, sf_dir).agg(F.max("x").alias("point")))


@query(boot_sql("pow(10, avg(log10(x)))", "pow(10, avg(log10(x)))"))
def boot_geomean(spark, sf_dir):
    reps = drawn(spark, sf_dir).groupBy("rep").agg(F.pow(F.lit(10.0), F.sum(F.log10("x") * F.col("times")) / F.sum("times")).alias("v"))
    return summary(reps, entities(spark, sf_dir).agg(F.pow(F.lit(10.0), F.avg(F.log10("x"))).alias("point")))


@query(boot_sql("stddev_pop(x)", "stddev_pop(x)"))
def boot_std(spark, sf_dir):
    """Sums of differences from the mean of all and of their squares: no replicate's rows meet."""
    t, e = F.col("times"), cut(entities(spark, sf_dir), "entities")
    mean = e.agg(F.avg("x").alias("mean"))
    held = drawn(spark, sf_dir).join(F.broadcast(mean)).withColumn("c", F.col("x") - F.col("mean"))
    sums = held.groupBy("rep").agg(F.sum(t).alias("n"), F.sum(F.col("c") * t).alias("a"), F.sum(F.col("c") * F.col("c") * t).alias("b"))
    reps = sums.select(F.sqrt(F.greatest(F.col("b") / F.col("n") - F.pow(F.col("a") / F.col("n"), 2), F.lit(0.0))).alias("v"))
    return summary(reps, entities(spark, sf_dir).agg(F.stddev_pop("x").alias("point")))


@query(boot_sql("sum(s) / sum(c)", "sum(s) / sum(c)"))
def boot_cluster_mean(spark, sf_dir):
    t = F.col("times")
    reps = drawn(spark, sf_dir).groupBy("rep").agg((F.sum(F.col("s") * t) / F.sum(F.col("c") * t)).alias("v"))
    return summary(reps, entities(spark, sf_dir).agg((F.sum("s") / F.sum("c")).alias("point")))


RADII = (100.0, 250.0, 400.0)
REACHED = f"rd AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RADII)}]) AS radius), q AS (SELECT rec, label, radius, avg(CASE WHEN value <= radius THEN 1 ELSE 0 END) AS x FROM ev, rd GROUP BY ALL)"


@query(f"""WITH RECURSIVE {EV}, {MEANS}, {DRAWS}, {REACHED}, r AS (SELECT rep, label, radius, avg(q.x) AS m FROM d JOIN ids USING (i) JOIN q USING (rec) GROUP BY ALL), s AS (SELECT rep, label, radius, m / nullif(sum(m) OVER (PARTITION BY rep, radius), 0) AS share FROM r)
SELECT label, radius, round(quantile_cont(share, 0.025), 6) AS low, round(quantile_cont(share, 0.975), 6) AS high FROM s GROUP BY ALL""")
def boot_share(spark, sf_dir):
    """Share of each state in what all states reach, at each radius; one draw of recordings serves all states and radii of a replicate."""
    inside = F.explode(F.array(*[F.struct(F.lit(r).alias("radius"), (F.col("value") <= r).cast("int").alias("in")) for r in RADII])).alias("p")
    q = event_sequence(spark, sf_dir).select("rec", "label", inside).groupBy("rec", "label", "p.radius").agg(F.avg("p.in").alias("x"))
    drawn_q = q.join(rs.multiplicities(entities(spark, sf_dir).select("rec"), ["rec"], REPS), "rec")
    m = drawn_q.groupBy("rep", "label", "radius").agg((F.sum(F.col("x") * F.col("times")) / F.sum("times")).alias("m"))
    s = m.select("label", "radius", (F.col("m") / F.nullif(F.sum("m").over(Window.partitionBy("rep", "radius")), F.lit(0.0))).alias("share"))
    return s.groupBy("label", "radius").agg(F.percentile("share", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("label", "radius", r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"))


@query(f"""WITH RECURSIVE {EV}, {WALL}, ids AS (SELECT *, row_number() OVER (ORDER BY rec) - 1 AS i, count(*) OVER () AS m FROM wc), {DRAWS},
 r AS (SELECT rep, sum(towards) AS a, sum(away) AS b, sum(along) AS c FROM d JOIN ids USING (i) GROUP BY rep), s AS (SELECT u.kind, u.n / (a + b + c) AS v FROM r, unnest([{{'kind': 'towards', 'n': a}}, {{'kind': 'away', 'n': b}}, {{'kind': 'along', 'n': c}}]) AS t(u))
SELECT kind, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM s GROUP BY kind""")
def boot_wall_orientation(spark, sf_dir):
    """Shares of the headings towards, away from and along the nearest wall when recordings are drawn: their counts weigh by multiplicity."""
    c = wall_orientation(spark, sf_dir)
    kinds = ("towards", "away", "along")
    r = c.join(rs.multiplicities(c.select("rec"), ["rec"], REPS), "rec").groupBy("rep").agg(*[F.sum(F.col(k) * F.col("times")).alias(k) for k in kinds])
    total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
    s = r.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) / total).alias("v")) for k in kinds])).alias("s")).select("s.*")
    return s.groupBy("kind").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("kind", r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"))


@query(f"""WITH RECURSIVE {BINARY}, {RUNS}, w AS (SELECT rec, avg(CASE WHEN label = 0 THEN dur END) AS a, avg(CASE WHEN label = 1 THEN dur END) AS b FROM ru GROUP BY rec HAVING avg(CASE WHEN label = 0 THEN dur END) > 0 AND avg(CASE WHEN label = 1 THEN dur END) > 0),
 ids AS (SELECT *, row_number() OVER (ORDER BY rec) - 1 AS i, count(*) OVER () AS m FROM w), {DRAWS}, r AS (SELECT rep, 2 / (1 / avg(a) + 1 / avg(b)) AS v FROM d JOIN ids USING (i) GROUP BY rep)
SELECT round((SELECT 2 / (1 / avg(a) + 1 / avg(b)) FROM w), 6) AS point, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM r""")
def harmonic_timescale_boot(spark, sf_dir):
    """Harmonic mean of the two states' mean dwell times, when recordings are drawn with their dwell means."""
    m = cut(dwell_means(spark, sf_dir), "dwell-means")
    harmonic = lambda a, b: 2 / (1 / a + 1 / b)
    t = F.col("times")
    reps = m.join(rs.multiplicities(m.select("rec"), ["rec"], REPS), "rec").groupBy("rep").agg(harmonic(F.sum(F.col("a") * t) / F.sum(t), F.sum(F.col("b") * t) / F.sum(t)).alias("v"))
    return summary(reps, m.agg(harmonic(F.avg("a"), F.avg("b")).alias("point")))


SURVIVALS = f"""ids AS (SELECT rec, row_number() OVER (ORDER BY rec) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT rec FROM ru)), {DRAWS},
 x AS (SELECT rep, label, dur, (row_number() OVER (PARTITION BY rep, label ORDER BY dur) - 1) / (count(*) OVER (PARTITION BY rep, label) - 1) AS p FROM d JOIN ids USING (i) JOIN ru USING (rec)), s AS (SELECT rep, label, dur, 1 - avg(p) AS s FROM x GROUP BY ALL)"""


def drawn_survivals(spark, sf_dir):
    """(rep, label, dur, s): clusters are drawn, their runs weigh by multiplicity: counts per (rep, label, duration), never copied rows."""
    found = sq.runs(event_sequence(spark, sf_dir, gaps=True))
    per = found.groupBy("rec", "label", "dur").agg(F.count(F.lit(1)).alias("runs"))
    n = per.join(rs.multiplicities(found.select("rec").distinct(), ["rec"], REPS), "rec").groupBy("rep", "label", "dur").agg(F.sum(F.col("runs") * F.col("times")).alias("n"))
    by = Window.partitionBy("rep", "label")
    below = F.coalesce(F.sum("n").over(by.orderBy("dur").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.select("rep", "label", "dur", (1 - F.try_divide(below + (F.col("n") - 1) / 2, F.sum("n").over(by) - 1)).alias("s")).where("s > 1e-12")


@query(f"WITH RECURSIVE {GAP}, {RUNS}, {SURVIVALS} SELECT label, dur, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM s WHERE s > 1e-12 GROUP BY ALL")
def boot_survival(spark, sf_dir):
    s = drawn_survivals(spark, sf_dir)
    return s.groupBy("label", "dur").agg(F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("label", "dur", r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"))


@query(f"""WITH RECURSIVE {GAP}, {RUNS}, {SURVIVALS}, f AS (SELECT rep, label, regr_slope(ln(s), dur) AS m, regr_intercept(ln(s), dur) AS b FROM s WHERE s > 1e-12 GROUP BY ALL), t AS (SELECT *, round(-1 / m, 2) AS t FROM f WHERE m IS NOT NULL AND m <> 0)
SELECT label, round(quantile_cont(m, 0.025), 6) AS slope_low, round(quantile_cont(m, 0.975), 6) AS slope_high, round(quantile_cont(b, 0.025), 6) AS intercept_low, round(quantile_cont(b, 0.975), 6) AS intercept_high, round(quantile_cont(t, 0.025), 6) AS timescale_low, round(quantile_cont(t, 0.975), 6) AS timescale_high FROM t GROUP BY label""")
def boot_survival_fit(spark, sf_dir):
    """Intervals of the exponential fit to the survival curves of the draws."""
    fit = drawn_survivals(spark, sf_dir).groupBy("rep", "label").agg(F.regr_slope(F.ln("s"), "dur").alias("slope"), F.regr_intercept(F.ln("s"), "dur").alias("intercept")).where("slope is not null and slope != 0")
    fit = fit.withColumn("timescale", F.round(-1 / F.col("slope"), 2))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    q = fit.groupBy("label").agg(*[F.percentile(c, ends).alias(c) for c in ("slope", "intercept", "timescale")])
    return q.select("label", *(r6(F.col(c)[i]).alias(f"{c}_{end}") for c in ("slope", "intercept", "timescale") for i, end in enumerate(("low", "high"))))


EPSILON_REPS = 10
#: The Poisson distribution function of mean 1 at 0, 1, 2, 3 and 4.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)
TIMES = "CASE " + " ".join(f"WHEN u < {p} THEN {i}" for i, p in enumerate(POISSON)) + " ELSE 5 END"


@query(f"""WITH {EV}, pr AS (SELECT rec, t, label AS src, lead(label) OVER (PARTITION BY rec ORDER BY t) AS dst FROM ev), tr AS (SELECT * FROM pr WHERE dst IS NOT NULL),
 dr AS (SELECT rec, src, dst, rep::INT AS rep, {TIMES} AS times FROM (SELECT *, ('0x' || substr(md5(rep || ':' || rec || ':' || t), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM tr, unnest(range(0, {EPSILON_REPS})) AS w(rep))),
 a AS (SELECT rec, src, dst, count(*) AS n FROM tr GROUP BY ALL), p AS (SELECT rec, src, dst, n / sum(n) OVER (PARTITION BY rec, src) AS p FROM a),
 b AS (SELECT rec, rep, src, dst, sum(times) AS n FROM dr GROUP BY ALL HAVING sum(times) > 0), q AS (SELECT rec, rep, src, dst, n / sum(n) OVER (PARTITION BY rec, rep, src) AS q FROM b),
 j AS (SELECT p.rec, r.rep, p.src, p.dst, p.p, coalesce(q.q, 0) AS q FROM p, (SELECT unnest(range(0, {EPSILON_REPS}))::INT AS rep) r LEFT JOIN q ON q.rec = p.rec AND q.rep = r.rep AND q.src = p.src AND q.dst = p.dst),
 e AS (SELECT rec, rep, sum(abs(p - q)) / 5 AS d FROM j GROUP BY ALL) SELECT rec, round(avg(d), 6) AS epsilon, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM e GROUP BY rec""")
def epsilon_by_recording(spark, sf_dir):
    """Resolution of each recording: the mean row distance of its transition matrix from those of surrogates, which count each of its transitions a Poisson number of times.

    Weights are hashes of (replicate, recording, place), so replicates are one explode before the partial sums; no draw table, no copied rows.
    """
    seq = event_sequence(spark, sf_dir)
    tr = sq.later(seq, "label", 1, "dst").select("rec", "t", F.col("label").alias("src"), "dst").where("dst is not null")
    rep = F.explode(F.sequence(F.lit(0), F.lit(EPSILON_REPS - 1))).alias("rep")
    u = rs.uniform(F.col("rep"), F.col("rec"), F.col("t"))
    drawn_n = tr.select("rec", "t", "src", "dst", rep).withColumn("u", u).groupBy("rec", "rep", "src", "dst").agg(F.sum(rs.poisson(F.col("u"), POISSON)).alias("n"), F.count(F.lit(1)).alias("own"))
    share = lambda c: F.col(c) / F.nullif(F.sum(c).over(Window.partitionBy("rec", "rep", "src")), F.lit(0))
    d = drawn_n.select("rec", "rep", F.abs(share("own") - F.coalesce(share("n"), F.lit(0.0))).alias("d")).groupBy("rec", "rep").agg((F.sum("d") / N_STATES).alias("d"))
    return d.groupBy("rec").agg(r6(F.avg("d")).alias("epsilon"), F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("rec", "epsilon", r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"))


@query(f"""WITH {EV}, s AS (SELECT label, rec, t, floor(('0x' || substr(md5(rec || ':' || t), 1, 8))::BIGINT / 4294967296.0::DOUBLE * count(*) OVER (PARTITION BY rec))::BIGINT AS i FROM ev),
 r AS (SELECT s.rec, s.t, e.label FROM s JOIN ev e ON e.rec = s.rec AND e.t = s.i), p AS (SELECT label AS src, lead(label) OVER (PARTITION BY rec ORDER BY t) AS dst FROM r) SELECT src, dst, count(*) AS n FROM p WHERE dst IS NOT NULL GROUP BY ALL""")
def shuffle_surrogate_counts(spark, sf_dir):
    seq = event_sequence(spark, sf_dir).select("rec", "t", "label")
    draw = blocks.with_totals(seq.select("rec", "t"), n=F.count(F.lit(1))).select("rec", "t", F.floor(rs.uniform(F.col("rec"), F.col("t")) * F.col("n")).cast("long").alias("i"))
    mixed = draw.join(seq.select("rec", F.col("t").alias("i"), "label"), ["rec", "i"]).select("rec", "t", "label")
    return sq.transition_counts(mixed)


@query(f"""WITH {EV}, h AS (SELECT rec, label, row_number() OVER (PARTITION BY rec % 7 ORDER BY md5(rec::VARCHAR)) AS r, (rec % 7)::INT AS grp FROM (SELECT rec, any_value(label) AS label FROM ev GROUP BY rec)), c AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM h)
SELECT rec, grp, r <= floor(0.8 * n) AS train FROM c""")
def stratified_split(spark, sf_dir):
    """A recording's place among its group's hashes decides; places come from ranges of (group, hash)."""
    e = event_sequence(spark, sf_dir).select("rec").distinct().withColumn("grp", group_of()).withColumn("h", F.md5(F.col("rec").cast("string").cast("binary")))
    return formats.placed(e, ["grp"], ["h", "rec"], "at", "n").select("rec", "grp", (F.col("at") < F.floor(0.8 * F.col("n"))).alias("train"))
