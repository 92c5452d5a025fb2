"""Segments, runs, delay vectors, correlations and paths."""

from __future__ import annotations

from math import pi

from pyspark.sql import Window
from pyspark.sql import functions as F

from sequora.operators import blocks, motion, sequences as sq
from sequora.operators.sequences import r6
from sequora.plans.registry import EV, GAP, query
from sequora.sources import formats
from sequora.sources.bindings import event_sequence, group_of, table

SEG = "sg AS (SELECT *, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY t) AS seg FROM ev)"
RUNS = """ch AS (SELECT *, CASE WHEN t = 0 OR label IS DISTINCT FROM lag(label) OVER (PARTITION BY rec ORDER BY t) THEN 1 ELSE 0 END AS c FROM ev),
 rn AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY t) AS run FROM ch),
 ru AS (SELECT rec, label, run::BIGINT AS run, min(t) AS t0, max(t) + 1 AS tf, count(*) AS dur FROM rn WHERE label IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {GAP}, {SEG} SELECT rec, seg::BIGINT AS seg, min(t) AS t0, max(t) + 1 AS tf FROM sg WHERE label IS NOT NULL GROUP BY ALL")
def segments(spark, sf_dir):
    return sq.segments(event_sequence(spark, sf_dir, gaps=True))


@query(f"WITH {GAP}, {SEG} SELECT rec, seg::BIGINT AS seg, min(t) AS t0, max(t) + 1 AS tf FROM sg WHERE label IS NOT NULL GROUP BY ALL HAVING max(t) + 1 - min(t) > 5")
def segments_min_size(spark, sf_dir):
    return sq.segments(event_sequence(spark, sf_dir, gaps=True), min_size=5)


@query(f"WITH {GAP}, {RUNS} SELECT rec, label, run, t0, tf, dur FROM ru")
def dwell_runs(spark, sf_dir):
    return sq.runs(event_sequence(spark, sf_dir, gaps=True))


@query(f"WITH {GAP}, {RUNS} SELECT (rec % 7)::INT AS grp, label, count(*) AS runs, round(avg(dur), 6) AS mean, max(dur) AS longest FROM ru GROUP BY ALL")
def dwell_stats_by_group(spark, sf_dir):
    found = sq.runs(event_sequence(spark, sf_dir, gaps=True))
    return found.groupBy(group_of().alias("grp"), "label").agg(F.count(F.lit(1)).alias("runs"), r6(F.avg("dur")).alias("mean"), F.max("dur").alias("longest"))


@query(f"WITH {GAP}, {RUNS.replace('count(*) AS dur', '(max(micros) - min(micros)) / 1e6::DOUBLE AS seconds')} SELECT rec, label, run, round(seconds, 6) AS seconds FROM ru WHERE seconds > 0")
def dwell_seconds(spark, sf_dir):
    held = sq.with_runs(event_sequence(spark, sf_dir, gaps=True)).groupBy("rec", "label", "run").agg(((F.max("micros") - F.min("micros")) / 1e6).alias("seconds"))
    return held.where("seconds > 0").select("rec", "label", "run", r6(F.col("seconds")).alias("seconds"))


@query(f"WITH {GAP}, {RUNS}, g AS (SELECT rec, s::INT AS label FROM (SELECT DISTINCT rec FROM ev), unnest(range(0, 5)) AS u(s)) SELECT g.rec, g.label, round(coalesce(avg(dur), 0), 6) AS mean, count(dur) AS runs FROM g LEFT JOIN ru USING (rec, label) GROUP BY ALL")
def dwell_zero_fill(spark, sf_dir):
    seq = event_sequence(spark, sf_dir, gaps=True)
    states = F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("label")))
    found = sq.runs(seq).groupBy("rec", "label").agg(F.avg("dur").alias("mean"), F.count("dur").alias("runs"))
    grid = seq.select("rec").distinct().join(states)
    return grid.join(found, ["rec", "label"], "left").select("rec", "label", r6(F.coalesce("mean", F.lit(0.0))).alias("mean"), F.coalesce("runs", F.lit(0).cast("long")).alias("runs"))


@query(f"WITH {EV}, {RUNS} SELECT rec, run, label, array_to_string(list(t ORDER BY t), ',') AS places FROM rn GROUP BY ALL HAVING count(*) > 1")
def run_length_split(spark, sf_dir):
    held = sq.with_runs(event_sequence(spark, sf_dir)).groupBy("rec", "run", "label").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return held.where("size(ts) > 1").select("rec", "run", "label", F.concat_ws(",", F.col("ts").cast("array<string>")).alias("places"))


@query(f"""WITH {EV}, {RUNS}, d AS (SELECT rec, label, run, CASE WHEN value - lag(value) OVER (PARTITION BY rec, run ORDER BY t) >= 0 THEN 1 WHEN value - lag(value) OVER (PARTITION BY rec, run ORDER BY t) < 0 THEN 0 END AS up FROM rn),
 r AS (SELECT rec, label, run, avg(up) AS ratio FROM d WHERE up IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT label, count(*) AS runs, round(avg(ratio), 6) AS ratio FROM r GROUP BY label""")
def left_turn_ratio(spark, sf_dir):
    runs = sq.with_runs(event_sequence(spark, sf_dir)).withColumn("here", F.struct("run", "value"))
    held = sq.later(runs, "here", -1, "before")
    step = F.when(F.col("before.run") == F.col("run"), F.col("value") - F.col("before.value"))
    turns = held.select("rec", "label", "run", (step >= 0).cast("int").alias("up")).where("up is not null").groupBy("rec", "label", "run").agg(F.avg("up").alias("ratio"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return turns.groupBy("label").agg(F.count(F.lit(1)).alias("runs"), r6(F.avg("ratio")).alias("ratio"))


BINARY = EV.replace("ev AS", "raw AS", 1) + ", ev AS (SELECT * REPLACE (CASE WHEN value - 245 > 0 THEN 1 ELSE 0 END AS label) FROM raw)"


@query(f"WITH {BINARY}, {RUNS}, m AS (SELECT rec, avg(CASE WHEN label = 0 THEN dur END) AS a, avg(CASE WHEN label = 1 THEN dur END) AS b FROM ru GROUP BY rec) SELECT rec, round(2 / (1 / a + 1 / b), 6) AS timescale FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def harmonic_timescale(spark, sf_dir):
    m = dwell_means(spark, sf_dir)
    return m.select("rec", r6(2 / (1 / F.col("a") + 1 / F.col("b"))).alias("timescale"))


def dwell_means(spark, sf_dir):
    """(rec, a, b): mean dwell times below and above the middle of the signal, of recordings that have both."""
    signs = event_sequence(spark, sf_dir).withColumn("label", F.when(F.col("value").isNotNull(), (F.col("value") - 245 > 0).cast("int")))
    mean = lambda s: F.avg(F.when(F.col("label") == s, F.col("dur")))
    return sq.runs(signs).groupBy("rec").agg(mean(0).alias("a"), mean(1).alias("b")).where("a is not null and b is not null")


@query(f"WITH {GAP}, {RUNS} SELECT rec, label, run, dur FROM ru ORDER BY dur DESC, rec, run LIMIT 20")
def runs_longest(spark, sf_dir):
    return sq.runs(event_sequence(spark, sf_dir, gaps=True)).orderBy(F.desc("dur"), "rec", "run").limit(20).select("rec", "label", "run", "dur")


DELAY = """sg AS (SELECT rec, t, value, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY rec) AS n FROM ev),
 dv AS (SELECT rec, t + 2 AS centre, [value, lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w, lead(value, 4) OVER w] AS vec, pos, n FROM sg WINDOW w AS (PARTITION BY rec ORDER BY t))"""


@query(f"WITH {EV}, {DELAY} SELECT rec, centre, vec FROM dv WHERE pos <= n - 6")
def delay_embed_k4(spark, sf_dir):
    return sq.trajectory(event_sequence(spark, sf_dir), "value", 4)


@query(f"WITH {EV}, {DELAY.replace('[value, lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w, lead(value, 4) OVER w]', '[value, k::DOUBLE, lead(value, 1) OVER w, lead(k, 1) OVER w, lead(value, 2) OVER w, lead(k, 2) OVER w]').replace('t + 2', 't + 1').replace('rec, t, value,', 'rec, t, value, k,')} SELECT rec, centre, vec FROM dv WHERE pos <= n - 4")
def delay_embed_vectors(spark, sf_dir):
    """Delay vectors of a row's whole vector, time by time."""
    rows = event_sequence(spark, sf_dir).select("rec", "t", F.array("value", F.col("k").cast("double")).alias("x"))
    return sq.trajectory(rows, "x", 2)


@query(f"""WITH {GAP}, g AS (SELECT rec, t, CASE WHEN label IS NOT NULL THEN value END AS x, row_number() OVER (PARTITION BY rec ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY rec) AS n FROM ev),
 dv AS (SELECT rec, t + 2 AS centre, [lead(x, 4) OVER w, lead(x, 3) OVER w, lead(x, 2) OVER w, lead(x, 1) OVER w, x] AS vec, pos, n FROM g WINDOW w AS (PARTITION BY rec ORDER BY t)) SELECT rec, centre, vec FROM dv WHERE pos <= n - 6""")
def delay_embed_reversed(spark, sf_dir):
    """Latest first, across gaps."""
    rows = event_sequence(spark, sf_dir, gaps=True).select("rec", "t", F.when(F.col("label").isNotNull(), F.col("value")).alias("x"))
    return sq.trajectory_across_gaps(rows, "x", 4)


@query(f"WITH {EV}, m AS (SELECT rec, t + 2 AS t, avg(value) OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS mean, t AS s, count(*) OVER (PARTITION BY rec) AS n FROM ev) SELECT rec, t, round(mean, 6) AS mean FROM m WHERE s < n - 5")
def moving_mean_k5(spark, sf_dir):
    by = blocks.here()
    m = blocks.in_blocks(event_sequence(spark, sf_dir), ahead=5).select("rec", "_own", (F.col("t") + 2).alias("t"), F.avg("value").over(by.rowsBetween(0, 4)).alias("mean"), F.lead("t", 5).over(by).alias("beyond"))
    return m.where("_own and beyond is not null").select("rec", "t", r6(F.col("mean")).alias("mean"))


@query(f"WITH {EV} SELECT label, round(avg(value), 6) AS mean FROM ev GROUP BY label")
def label_mean(spark, sf_dir):
    return event_sequence(spark, sf_dir).groupBy("label").agg(r6(F.avg("value")).alias("mean"))


@query(f"WITH {EV} SELECT label, round(quantile_cont(value, 0.5), 6) AS median FROM ev GROUP BY label")
def label_median(spark, sf_dir):
    return formats.quantiles(event_sequence(spark, sf_dir), ["label"], "value", [0.5]).select("label", r6(F.col("q0")).alias("median"))


@query(f"WITH {EV}, d AS (SELECT rec, t, degrees(abs(lead(phase) OVER (PARTITION BY rec ORDER BY t) - phase)) AS change FROM ev) SELECT rec, t, round(change, 6) AS change FROM d WHERE change IS NOT NULL")
def heading_change(spark, sf_dir):
    change = F.degrees(F.abs(F.col("next") - F.col("phase")))
    return sq.later(event_sequence(spark, sf_dir), "phase", 1, "next").select("rec", "t", change.alias("change")).where("change is not null").select("rec", "t", r6(F.col("change")).alias("change"))


@query(f"WITH {EV}, d AS (SELECT rec, t, (micros - lag(micros) OVER (PARTITION BY rec ORDER BY t)) / 1e6::DOUBLE AS gap FROM ev) SELECT rec, t, round(gap, 6) AS gap FROM d WHERE gap IS NOT NULL")
def inter_event_interval(spark, sf_dir):
    gap = (F.col("micros") - F.col("before")) / 1e6
    return sq.later(event_sequence(spark, sf_dir), "micros", -1, "before").select("rec", "t", gap.alias("gap")).where("gap is not null").select("rec", "t", r6(F.col("gap")).alias("gap"))


@query(f"WITH {GAP} SELECT rec, arg_min(label, t) FILTER (label IS NOT NULL) AS first_label, arg_max(label, t) FILTER (label IS NOT NULL) AS last_label FROM ev GROUP BY rec")
def first_last_nonnull(spark, sf_dir):
    held = event_sequence(spark, sf_dir, gaps=True).where("label is not null").groupBy("rec").agg(F.min_by("label", "t").alias("first_label"), F.max_by("label", "t").alias("last_label"))
    return held


UNWRAP = """ph AS (SELECT rec, t, CASE WHEN label IS NOT NULL THEN phase END AS phase FROM ev),
 hd AS (SELECT *, lag(phase IGNORE NULLS) OVER (PARTITION BY rec ORDER BY t) AS before FROM ph),
 df AS (SELECT *, phase - before AS d FROM hd),
 wr AS (SELECT *, d + pi() - 2 * pi() * floor((d + pi()) / (2 * pi())) - pi() AS w FROM df),
 cr AS (SELECT *, CASE WHEN d IS NULL OR abs(d) < pi() THEN 0.0 ELSE (CASE WHEN w = -pi() AND d > 0 THEN pi() ELSE w END) - d END AS c FROM wr)"""


@query(f"WITH {GAP}, {UNWRAP} SELECT rec, t, round(phase + sum(c) OVER (PARTITION BY rec ORDER BY t), 6) + 0.0 AS angle FROM cr")
def phase_unwrap(spark, sf_dir):
    seq = event_sequence(spark, sf_dir, gaps=True).withColumn("phase", F.when(F.col("label").isNotNull(), F.col("phase")))
    return motion.unwrap(seq, "phase").select("rec", "t", r6(F.col("angle")).alias("angle"))


XY = "xy AS (SELECT rec, t, sum(k * cos(phase)) OVER (PARTITION BY rec ORDER BY t) AS x, sum(k * sin(phase)) OVER (PARTITION BY rec ORDER BY t) AS y FROM ev)"


@query(f"""WITH {EV}, {XY}, st AS (SELECT rec, t, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM xy WINDOW w AS (PARTITION BY rec ORDER BY t))
SELECT rec, t, round(sqrt(dx * dx + dy * dy), 6) AS dist FROM st WHERE dx IS NOT NULL""")
def step_geometry(spark, sf_dir):
    return motion.steps(motion.positions(event_sequence(spark, sf_dir), "k", "phase")).select("rec", "t", r6(F.col("dist")).alias("dist"))


@query(f"""WITH {EV}, h AS (SELECT rec, t, k, phase / 10 AS dpsi, sum(phase / 10) OVER (PARTITION BY rec ORDER BY t) AS psi FROM ev), g AS (SELECT *, coalesce(lag(psi) OVER (PARTITION BY rec ORDER BY t), 0) AS heading FROM h)
SELECT rec, t, round(sum(CASE WHEN t = 0 THEN 0 ELSE k * cos(heading) END) OVER w, 6) + 0.0 AS x, round(sum(CASE WHEN t = 0 THEN 0 ELSE k * sin(heading) END) OVER w, 6) + 0.0 AS y FROM g WINDOW w AS (PARTITION BY rec ORDER BY t)""")
def rec_trajectory(spark, sf_dir):
    seq = event_sequence(spark, sf_dir).withColumn("dpsi", F.col("phase") / 10)
    return motion.path(seq, "dpsi", "k").select("rec", "t", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


LAGS = "lags AS (SELECT unnest([1, 2, 3, 5, 8]) AS lag)"


@query(f"""WITH {EV}, {LAGS}, m AS (SELECT rec, avg(value) AS mu, var_pop(value) AS v FROM ev GROUP BY rec),
 pr AS (SELECT a.rec, lag, avg((a.value - mu) * (b.value - mu)) AS c, any_value(v) AS v FROM ev a, lags, ev b JOIN m ON m.rec = b.rec WHERE a.rec = b.rec AND b.t = a.t + lag GROUP BY ALL)
SELECT rec, lag, round(c / v, 6) + 0.0 AS acf FROM pr UNION ALL SELECT rec, 0, 1.0 FROM m""")
def acf(spark, sf_dir):
    return motion.autocorrelation(event_sequence(spark, sf_dir), "value", [0, 1, 2, 3, 5, 8]).select("rec", "lag", r6(F.col("acf")).alias("acf"))


BREAKS = "br AS (SELECT *, sum((label = 1)::INT) OVER (PARTITION BY rec ORDER BY t) AS breaks FROM ev)"


def broken(spark, sf_dir):
    """Sequences that an error breaks."""
    return event_sequence(spark, sf_dir).withColumn("broken", F.col("label") == 1)


@query(f"""WITH {EV}, {BREAKS}, {LAGS}, m AS (SELECT rec, avg(value) AS mu, var_pop(value) AS v FROM ev GROUP BY rec)
SELECT a.rec, lag, round(avg((a.value - mu) * (b.value - mu)) / any_value(v), 6) + 0.0 AS acf FROM br a, lags, br b JOIN m ON m.rec = b.rec WHERE a.rec = b.rec AND b.t = a.t + lag AND a.breaks = b.breaks GROUP BY a.rec, lag""")
def acf_exclude(spark, sf_dir):
    """Autocorrelation over pairs without a break between them."""
    return motion.autocorrelation(broken(spark, sf_dir), "value", [1, 2, 3, 5, 8], "broken").select("rec", "lag", r6(F.col("acf")).alias("acf"))


@query(f"""WITH {EV}, {LAGS}, m AS (SELECT avg(value) AS mu, var_pop(value) AS v, count(value) AS n FROM ev)
SELECT lag, round(avg((a.value - mu) * (b.value - mu)), 4) AS product, count(*) AS n FROM ev a, lags, ev b, m WHERE a.rec = b.rec AND b.t = a.t + lag GROUP BY ALL UNION ALL SELECT 0, round(v, 4), n FROM m""")
def acf_pooled(spark, sf_dir):
    """Products over all recordings around the mean of all; at lag 0 the variance of all."""
    seq = event_sequence(spark, sf_dir)
    whole = seq.agg(F.avg("value").alias("mu"), F.var_pop("value").alias("v"), F.count("value").alias("n"))
    held = motion.lagged(seq, ["value"], [1, 2, 3, 5, 8]).join(F.broadcast(whole.select("mu")))
    found = held.groupBy("lag").agg(F.round(F.avg((F.col("value") - F.col("mu")) * (F.col("value_later") - F.col("mu"))), 4).alias("product"), F.count(F.lit(1)).alias("n"))
    return found.unionByName(whole.select(F.lit(0).alias("lag"), F.round("v", 4).alias("product"), "n"))


CCF = """m AS (SELECT rec, avg(value) AS mu, avg(k) AS mk, stddev_pop(value) * stddev_pop(k) AS s FROM ev GROUP BY rec), lags AS (SELECT unnest([-5, -2, -1, 0, 1, 2, 5]) AS lag)"""


@query(f"""WITH {EV}, {CCF} SELECT a.rec, lag, round(avg((a.value - mu) * (b.k - mk)) / any_value(s), 6) + 0.0 AS ccf FROM ev a, lags, ev b JOIN m ON m.rec = b.rec WHERE a.rec = b.rec AND b.t = a.t + lag GROUP BY a.rec, lag""")
def ccf(spark, sf_dir):
    return motion.crosscorrelation(event_sequence(spark, sf_dir), "value", "k", [-5, -2, -1, 0, 1, 2, 5]).select("rec", "lag", r6(F.col("ccf")).alias("ccf"))


@query(f"""WITH {EV}, {BREAKS}, {CCF} SELECT a.rec, lag, round(avg((a.value - mu) * (b.k - mk)) / any_value(s), 6) + 0.0 AS ccf FROM br a, lags, br b JOIN m ON m.rec = b.rec WHERE a.rec = b.rec AND b.t = a.t + lag AND a.breaks = b.breaks GROUP BY a.rec, lag""")
def ccf_exclude(spark, sf_dir):
    return motion.crosscorrelation(broken(spark, sf_dir), "value", "k", [-5, -2, -1, 0, 1, 2, 5], "broken").select("rec", "lag", r6(F.col("ccf")).alias("ccf"))


#: Vectors of a recording of vectors.
RUN_OF_VECTORS = 50


@query(f"""WITH e AS (SELECT vec_id // {RUN_OF_VECTORS} AS rec, vec_id % {RUN_OF_VECTORS} AS t, label, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT *, sum((label = 0)::INT) OVER (PARTITION BY rec ORDER BY t) AS breaks, row_number() OVER (PARTITION BY rec ORDER BY t) AS i FROM e), lags AS (SELECT unnest([0, 1, 2, 3]) AS lag)
SELECT a.rec, lag, round(avg(list_dot_product(a.v, b.v)), 4) + 0.0 AS dot FROM b a, lags, b WHERE a.rec = b.rec AND b.i = a.i + lag AND a.breaks = b.breaks GROUP BY ALL""")
def dot_acf(spark, sf_dir):
    """Recordings are runs of neighbouring vectors, broken where one has label 0."""
    e = table(spark, sf_dir, "embeddings").select(F.expr(f"vec_id div {RUN_OF_VECTORS}").alias("rec"), (F.col("vec_id") % RUN_OF_VECTORS).alias("t"), (F.col("label") == 0).alias("broken"), F.col("embedding").cast("array<double>").alias("v"))
    return motion.dot_autocorrelation(e, "v", [0, 1, 2, 3], "broken").select("rec", "lag", (F.round("dot", 4) + 0.0).alias("dot"))


MSD = f"""{EV}, {XY}, lags AS (SELECT unnest([0, 1, 2, 4, 8, 16]) AS lag), m AS (SELECT a.rec, lag, avg((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS msd, count(*) AS n FROM xy a, lags, xy b WHERE a.rec = b.rec AND b.t = a.t + lag GROUP BY ALL)"""


@query(f"WITH {MSD} SELECT rec, lag, round(msd, 4) AS msd, n FROM m")
def msd(spark, sf_dir):
    xy = motion.positions(event_sequence(spark, sf_dir), "k", "phase")
    return motion.msd(xy, [0, 1, 2, 4, 8, 16]).select("rec", "lag", F.round("msd", 4).alias("msd"), "n")


@query(f"WITH {MSD}, p AS (SELECT lag, avg(msd) AS msd FROM m WHERE lag > 0 GROUP BY lag), s AS (SELECT lag, (ln(msd) - lag(ln(msd)) OVER (ORDER BY lag)) / (ln(lag) - lag(ln(lag)) OVER (ORDER BY lag)) AS slope FROM p) SELECT lag, round(slope, 6) AS slope FROM s WHERE slope IS NOT NULL")
def msd_slope(spark, sf_dir):
    xy = motion.positions(event_sequence(spark, sf_dir), "k", "phase")
    p = motion.msd(xy, [1, 2, 4, 8, 16]).groupBy("lag").agg(F.avg("msd").alias("msd"))
    by = Window.orderBy("lag")
    slope = (F.ln("msd") - F.lag(F.ln("msd")).over(by)) / (F.ln("lag") - F.lag(F.ln("lag")).over(by))
    return p.select("lag", slope.alias("slope")).where("slope is not null").select("lag", r6(F.col("slope")).alias("slope"))


@query(f"WITH {GAP} SELECT label, count(*) AS n FROM ev GROUP BY label")
def visit_counts(spark, sf_dir):
    return event_sequence(spark, sf_dir, gaps=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GAP} SELECT DISTINCT rec, label FROM ev WHERE label IS NOT NULL")
def distinct_states(spark, sf_dir):
    return event_sequence(spark, sf_dir, gaps=True).where("label is not null").select("rec", "label").distinct()


@query(f"WITH {EV} SELECT rec, t, CASE WHEN t > 0 AND t < count(*) OVER (PARTITION BY rec) - 1 THEN label END AS label FROM ev")
def boundary_null(spark, sf_dir):
    return sq.drop_ends(event_sequence(spark, sf_dir)).select("rec", "t", "label")


@query(f"WITH {EV} SELECT rec, t, CASE WHEN t < count(*) OVER (PARTITION BY rec) - 2 THEN label END AS label FROM ev")
def last_two_null(spark, sf_dir):
    return sq.drop_ends(event_sequence(spark, sf_dir), first=0, last=2).select("rec", "t", "label")


@query(f"WITH {EV} SELECT rec, t, label FROM ev WHERE t % 3 = 0")
def stride_decimate(spark, sf_dir):
    return event_sequence(spark, sf_dir).where("t % 3 = 0").select("rec", "t", "label")


@query(f"""WITH {EV}, c AS (SELECT rec, min(t) FILTER (micros > s + 15 * 86400000000) AS cut FROM (SELECT *, min(micros) OVER (PARTITION BY rec) AS s FROM ev) GROUP BY rec)
SELECT rec, t, CASE WHEN cut IS NULL OR t < cut THEN label END AS label FROM ev JOIN c USING (rec)""")
def time_cutoff(spark, sf_dir):
    seq = blocks.with_totals(event_sequence(spark, sf_dir), start=F.min("micros"))
    cut = F.min(F.when(F.col("micros") > F.col("start") + 15 * 86_400_000_000, F.col("t")))
    return blocks.with_totals(seq, cut=cut).select("rec", "t", F.when(F.col("cut").isNull() | (F.col("t") < F.col("cut")), F.col("label")).alias("label"))


#: Symbols that a window of a recording needs, and windows of a recording.
LEAST_SYMBOLS, N_WINDOWS = 8, 4


@query(f"""WITH {EV}, m AS (SELECT rec, (rec % 7)::INT AS grp, label, (micros - min(micros) OVER (PARTITION BY rec)) / 6e7::DOUBLE AS minute FROM ev),
 x AS (SELECT grp, avg(longest) AS tmax FROM (SELECT grp, rec, max(minute) AS longest FROM m GROUP BY ALL) GROUP BY grp), wi AS (SELECT *, w * tmax / {N_WINDOWS} AS t0, floor(ceil(tmax) / {N_WINDOWS}) AS wide FROM x, unnest(range(0, {N_WINDOWS})) AS u(w)),
 c AS (SELECT wi.grp, wi.w, m.rec, m.label, count(*) AS n FROM m JOIN wi ON wi.grp = m.grp AND minute > t0 AND minute <= t0 + wide GROUP BY wi.grp, wi.w, m.rec, m.label), ct AS (SELECT *, sum(n) OVER (PARTITION BY grp, w, rec) AS total FROM c),
 sh AS (SELECT grp, w, label, sum(n / total) AS s FROM ct WHERE total >= {LEAST_SYMBOLS} GROUP BY grp, w, label), k AS (SELECT grp, w, count(DISTINCT rec) AS kept FROM ct WHERE total >= {LEAST_SYMBOLS} GROUP BY grp, w)
SELECT sh.grp, sh.w::INT AS w, label, kept, round(s / kept, 6) AS share FROM sh JOIN k ON k.grp = sh.grp AND k.w = sh.w WHERE kept >= 2""")
def occupancy_windows(spark, sf_dir):
    """Mean share of each symbol in four equal windows of the mean length of a group's recordings.

    A recording without enough symbols in a window doesn't count there, and a window in which fewer than two recordings count is left out.
    """
    seq = event_sequence(spark, sf_dir).withColumn("grp", group_of())
    minute = (F.col("micros") - F.col("start")) / 6e7
    m = blocks.with_totals(seq, start=F.min("micros")).select("rec", "grp", "label", minute.alias("minute"))
    x = m.groupBy("grp", "rec").agg(F.max("minute").alias("longest")).groupBy("grp").agg(F.avg("longest").alias("tmax"))
    held = m.join(F.broadcast(x), "grp").select("*", F.explode(F.sequence(F.lit(0), F.lit(N_WINDOWS - 1))).alias("w"))
    t0, wide = F.col("w") * F.col("tmax") / N_WINDOWS, F.floor(F.ceil("tmax") / N_WINDOWS)
    n = held.where((F.col("minute") > t0) & (F.col("minute") <= t0 + wide)).groupBy("grp", "w", "rec", "label").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy("grp", "w", "rec"))).where(F.col("total") >= LEAST_SYMBOLS)
    kept = n.groupBy("grp", "w").agg(F.count_distinct("rec").alias("kept")).where("kept >= 2")
    s = n.groupBy("grp", "w", "label").agg(F.sum(F.col("n") / F.col("total")).alias("s"))
    return s.join(kept, ["grp", "w"]).select("grp", "w", "label", "kept", r6(F.col("s") / F.col("kept")).alias("share"))
