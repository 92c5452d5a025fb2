"""Spectra, partitions, simulation, clustering, embeddings and classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sequora.config import SweepParameters
from sequora.operators import kernels as kn, learning as ml, markov, pairs, partition, resampling as rs, sequences as sq
from sequora.operators.sequences import r6
from sequora.plans.registry import EV, query
from sequora.plans.transitions import HEIGHT, P1, chunk_bootstrap_counts, chunked_counts, recording_rows, steady
from sequora.sources.bindings import N_STATES, event_sequence, group_of, table
from sequora.sources.storage import cut


def fine_sequence(spark, sf_dir):
    """States of the spectral queries: event type by the last two bits of k."""
    return event_sequence(spark, sf_dir).withColumn("label", F.col("label") * 4 + F.col("k") % 4)


@query()
def implied_timescales(spark, sf_dir):
    counts = sq.transition_counts(fine_sequence(spark, sf_dir), 1).withColumn("lag", F.lit(1))
    return kn.implied_timescales(counts, 10).select("lag", "mode", r6(F.col("timescale")).alias("timescale"))


@query()
def timescales_by_delay(spark, sf_dir):
    """All delays in one pass over the events; one small task per delay."""
    pairs = sq.lag_pairs(fine_sequence(spark, sf_dir), [1, 2, 3, 5, 8])
    counts = pairs.groupBy("lag", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return kn.implied_timescales(counts, 5).select("lag", "mode", r6(F.col("timescale")).alias("timescale"))


@query()
def bootstrap_timescales(spark, sf_dir):
    counts = chunk_bootstrap_counts(spark, sf_dir).withColumn("lag", F.lit(1))
    return quantiles(kn.implied_timescales(counts, 3, keys=("rep", "lag")), ["mode"])


def quantiles(t, by):
    t = t.where("timescale is not null")
    q = t.groupBy(*by).agg(F.percentile("timescale", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select(*by, *(r6(F.col("q")[i]).alias(c) for i, c in enumerate(("low", "median", "high"))))


DELAYS, CHUNK = [1, 2, 4], 16


def lagged_chunk_counts(spark, sf_dir):
    """(rec, chunk, lag, src, dst, n): counts inside pieces of recordings for several delays, from one sort."""
    held = sq.chunked(event_sequence(spark, sf_dir), CHUNK)
    by = Window.partitionBy("rec", "chunk").orderBy("t")
    later = F.array(*[F.struct(F.lit(d).alias("lag"), F.lead("label", d).over(by).alias("dst")) for d in DELAYS])
    pairs = held.select("rec", "chunk", F.col("label").alias("src"), later.alias("p")).select("rec", "chunk", "src", F.explode("p").alias("p"))
    return pairs.where("p.dst is not null").groupBy("rec", "chunk", F.col("p.lag").alias("lag"), "src", F.col("p.dst").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


@query()
def pooled_timescales(spark, sf_dir):
    """Timescales of the counts inside all pieces, per delay."""
    counts = lagged_chunk_counts(spark, sf_dir).groupBy("lag", "src", "dst").agg(F.sum("n").alias("n"))
    return kn.implied_timescales(counts, 2).select("lag", "mode", r6(F.col("timescale")).alias("timescale"))


@query()
def trajectory_timescales(spark, sf_dir):
    """Timescales of explicit trajectories: the segments between gaps, never joined to each other."""
    pairs = sq.lag_pairs(event_sequence(spark, sf_dir, gaps=True), DELAYS, gap_aware=True)
    counts = pairs.groupBy("lag", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return kn.implied_timescales(counts, 2).select("lag", "mode", r6(F.col("timescale")).alias("timescale"))


@query()
def timescales_with_intervals(spark, sf_dir):
    """Timescales per delay with intervals of a bootstrap of pieces; one draw of pieces serves all delays of a replicate."""
    counts = cut(lagged_chunk_counts(spark, sf_dir), "chunk-counts")
    pieces = counts.select("rec", "chunk").distinct()
    drawn = counts.join(rs.multiplicities(pieces, ["rec", "chunk"], 20), ["rec", "chunk"]).groupBy("rep", "lag", "src", "dst").agg(F.sum(F.col("times") * F.col("n")).alias("n"))
    ends = quantiles(kn.implied_timescales(drawn, 2, keys=("rep", "lag")), ["lag", "mode"])
    whole = counts.groupBy("lag", "src", "dst").agg(F.sum("n").alias("n"))
    return kn.implied_timescales(whole, 2).select("lag", "mode", r6(F.col("timescale")).alias("timescale")).join(ends, ["lag", "mode"], "left")


@query()
def subtraj_timescales(spark, sf_dir):
    counts = chunked_counts(spark, sf_dir).groupBy("rec", "src", "dst").agg(F.sum("n").alias("n")).withColumn("lag", F.lit(1))
    return kn.implied_timescales(counts, 2, keys=("rec", "lag")).select("rec", "mode", r6(F.col("timescale")).alias("timescale"))


def fine_lag_counts(spark, sf_dir, lags):
    pairs = sq.lag_pairs(fine_sequence(spark, sf_dir), lags)
    return pairs.groupBy("lag", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query()
def spectrum_topk(spark, sf_dir):
    """Leading eigenvalues and eigenfunctions of the reversible operator of each delay, one small task a delay."""

    def kernel(key, states, p):
        pi, values, phi = kn.spectrum(p, 4)
        return pd.DataFrame([(key["lag"], int(s), m, float(values[m]), float(pi[i]), float(phi[i, m])) for i, s in enumerate(states) for m in range(len(values))], columns=["lag", "state", "mode", "value", "pi", "phi"])

    out = kn.per_matrix(fine_lag_counts(spark, sf_dir, [1, 2]), ["lag"], "lag int, state int, mode int, value double, pi double, phi double", kernel)
    return out.select("lag", "state", "mode", *(r6(F.col(c)).alias(c) for c in ("value", "pi", "phi")))


@query()
def recentred_modes(spark, sf_dir):
    """Eigenfunctions spread over [-1, 0] and [0, 1] around their most coherent threshold, scaled by the root of half their decay rate's inverse."""
    kernel = lambda key, states, p: kn.recentred(states, p, 3, 0.0).assign(lag=key["lag"])[["lag", "state", "mode", "pi", "z"]]
    out = kn.per_matrix(fine_lag_counts(spark, sf_dir, [1, 2]), ["lag"], "lag int, state int, mode int, pi double, z double", kernel)
    return out.select("lag", "state", "mode", r6(F.col("pi")).alias("pi"), r6(F.col("z")).alias("z"))


@query()
def coherent_split(spark, sf_dir):
    """The two most coherent sets along the slowest eigenfunction: all thresholds from running sums, the best peak labels the states."""
    p = cut(markov.row_normalised(sq.transition_counts(fine_sequence(spark, sf_dir), 1)), "p")
    modes = spectrum_topk(spark, sf_dir).where("lag = 1 and mode = 1")
    phi = cut(modes.select("state", "phi"), "phi")
    return markov.optimal_split(p, markov.stationary(p), phi, HEIGHT)


@query()
def recursive_partition(spark, sf_dir):
    """The heaviest part is split along the slowest mode of its own transitions, counted anew between its rows, until there are five."""
    return partition.recursive_partition(fine_sequence(spark, sf_dir).select("rec", "t", "label"), 1, 5, HEIGHT)


@query()
def coarse_grain_kmeans(spark, sf_dir):
    """States clustered by ceil(log2 q) recentred modes, weighted by the stationary measure, best of several starts; the labels then go back to the events by a broadcast join."""
    q, n_modes = 4, 2
    wide = recentred_modes(spark, sf_dir).where(f"lag = 1 and mode <= {n_modes}").groupBy("state").agg(F.first("pi").alias("pi"), F.array_sort(F.collect_list(F.struct("mode", "z"))).alias("m"))
    points = ml.vectors(wide.withColumn("v", F.transform("m", lambda x: x["z"])), "v")
    found = ml.kmeans(cut(points.select("state", "pi", "features"), "modes"), q, 123, "pi", restarts=5).select(F.col("state").alias("label"), "cluster")
    n = fine_sequence(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(found), "label").groupBy("cluster").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("states"))


@query()
def posterior_matrices(spark, sf_dir):
    """Samples of the transition matrix: gamma draws over the counts, normalised by row; a sample is one small task with a hashed seed."""
    counts = sq.transition_counts(event_sequence(spark, sf_dir), 1)
    reps = counts.select("src", "dst", "n", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("rep"))
    p = markov.row_normalised(kn.posterior_counts(reps), ("rep",))
    return p.groupBy("src", "dst").agg(r6(F.avg("p")).alias("mean"), r6(F.stddev_pop("p")).alias("sd"))


@query()
def asymptote_fit(spark, sf_dir):
    """Where the timescales of a mode level off over the delays, and at what height."""
    pairs = sq.lag_pairs(fine_sequence(spark, sf_dir), list(range(1, 13)))
    t = kn.implied_timescales(pairs.groupBy("lag", "src", "dst").agg(F.count(F.lit(1)).alias("n")), 3).where("timescale is not null")
    return kn.plateaus(t, ["mode"], "lag", "timescale").select("mode", "place", r6(F.col("level")).alias("level"))


CHAIN = f"""WITH RECURSIVE {EV}, {P1}, cdf AS (SELECT src, dst, sum(p) OVER (PARTITION BY src ORDER BY dst) AS hi, sum(p) OVER (PARTITION BY src ORDER BY dst) - p AS lo, row_number() OVER (PARTITION BY src ORDER BY dst DESC) AS back FROM p),
 st AS (SELECT rec AS sim, label AS state FROM ev WHERE t = 0), ch AS (SELECT sim, 0 AS step, state FROM st UNION ALL
  SELECT sim, step + 1, dst FROM ch JOIN cdf ON src = state WHERE step < 20 AND ('0x' || substr(md5(sim || ':' || (step + 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= lo - 1e-15 AND (('0x' || substr(md5(sim || ':' || (step + 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < hi OR back = 1))"""


def simulated(spark, sf_dir, steps=20):
    p = markov.row_normalised(sq.transition_counts(event_sequence(spark, sf_dir)))
    starts = event_sequence(spark, sf_dir).where("t = 0").select(F.col("rec").alias("sim"), F.col("label").alias("state"))
    return kn.chains(p, starts, steps)


@query(f"{CHAIN} SELECT sim, step::INT AS step, state FROM ch")
def markov_chains(spark, sf_dir):
    """A chain for each user from the user's first state: the chains are spread over tasks, the matrix of states goes with them."""
    return simulated(spark, sf_dir)


POOL = "po AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY rec, t) - 1 AS i, count(*) OVER (PARTITION BY label) AS n, k, phase FROM ev)"


@query(f"{CHAIN}, {POOL}, dr AS (SELECT sim, step, state, floor(('0x' || substr(md5('k:' || sim || ':' || step), 1, 8))::BIGINT / 4294967296.0::DOUBLE * n)::BIGINT AS i FROM ch JOIN (SELECT DISTINCT label, n FROM po) q ON q.label = state) SELECT sim, step::INT AS step, k, round(phase, 6) AS phase FROM dr JOIN po ON po.label = state AND po.i = dr.i")
def kinematic_sample(spark, sf_dir):
    """Each simulated state takes a random historical row of that state: a join on (state, place), never a scan per draw."""
    order = Window.partitionBy("label").orderBy("rec", "t")
    pool = event_sequence(spark, sf_dir).select("label", (F.row_number().over(order) - 1).cast("long").alias("i"), "k", "phase")
    n = pool.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    drawn = simulated(spark, sf_dir).join(F.broadcast(n.withColumnRenamed("label", "state")), "state")
    drawn = drawn.select("sim", "step", F.col("state").alias("label"), F.floor(rs.uniform(F.lit("k"), F.col("sim"), F.col("step")) * F.col("n")).cast("long").alias("i"))
    return drawn.join(pool, ["label", "i"]).select("sim", "step", "k", r6(F.col("phase")).alias("phase"))


@query()
def sim_paths(spark, sf_dir):
    """Simulated paths: sampled kinematics, integrated by running sums."""
    from sequora.operators.motion import path

    s = kinematic_sample(spark, sf_dir).select(F.col("sim").alias("rec"), F.col("step").alias("t"), (F.col("phase") / 10).alias("turn"), "k")
    return path(s, "turn", "k").select("rec", "t", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query()
def reflective_trajectory(spark, sf_dir):
    """Paths in a square with mirroring walls: each step depends on the last, so one task walks one recording."""
    seq = event_sequence(spark, sf_dir).select("rec", "t", (F.col("phase") / 10).alias("turn"), (F.col("k") / 20.0).alias("dist"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        return kn.reflect(rows, 10.0).assign(rec=rows.rec.iloc[0])[["rec", "t", "x", "y"]]

    out = seq.groupBy("rec").applyInPandas(walk, "rec long, t long, x double, y double")
    return out.select("rec", "t", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


#: Coordinates of the embeddings table.
DIMS = 64


def unit_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


CENTRES = [[0.1 if j % 3 == i else 0.0 for j in range(DIMS)] for i in range(3)]
VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
MEANS = "[" + ", ".join(f"avg(v[{j + 1}])" for j in range(DIMS)) + "]"
GAP2 = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda q: (v[q] - c[q]) ** 2))"


def lloyd_sql(rounds: int) -> str:
    out = [VECTORS, "c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {c}::DOUBLE[])" for i, c in enumerate(CENTRES)) + ") AS t(i, c))"]
    for r in range(rounds):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(i, (round({GAP2}, 9), i)) AS i FROM v, c{r} GROUP BY vec_id)")
        out.append(f"m{r} AS (SELECT i, {MEANS} AS c FROM a{r} GROUP BY i), c{r + 1} AS (SELECT c{r}.i, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (i))")
    return "WITH " + ", ".join(out)


def rounded_gap(a, b):
    return F.round(ml.squared_distance(a, b), 9)


@query(f"{lloyd_sql(3)} SELECT vec_id, arg_min(i, (round({GAP2}, 9), i))::INT AS cluster FROM v, c3 GROUP BY vec_id")
def lloyd_k_iterations(spark, sf_dir):
    points = unit_vectors(spark, sf_dir)
    centres = ml.lloyd(points, [list(c) for c in CENTRES], 3, rounded_gap)
    return ml.nearest(points, list(enumerate(centres)), rounded_gap).select("vec_id", "cluster")


def medoid_sql(rounds: int) -> str:
    reach = "round(list_max(list_transform(range(1, {n}), lambda q: abs(v.v[q] - c.c[q]))), 9)".format(n=DIMS + 1)
    out = [VECTORS, "c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, v AS c FROM (SELECT * FROM v ORDER BY vec_id LIMIT 3))"]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT v.vec_id, any_value(v.v) AS v, arg_min(c.i, ({reach}, c.i)) AS i, min({reach}) AS d FROM v, c{r} c GROUP BY v.vec_id)")
        out.append(f"k{r} AS (SELECT x.i, x.vec_id, any_value(x.v) AS c, round(sum({reach.replace('c.c', 'x.v')}), 6) AS cost FROM a{r} x JOIN a{r} v ON v.i = x.i GROUP BY x.i, x.vec_id)")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.i, coalesce(b.vec_id, c{r}.vec_id) AS vec_id, coalesce(b.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT i, arg_min(vec_id, (cost, vec_id)) AS vec_id, arg_min(c, (cost, vec_id)) AS c FROM k{r} GROUP BY i) b USING (i))")
    return "WITH " + ", ".join(out)


#: Rounds after which the medoids of any of the given tables have come to rest; more change nothing.
MEDOID_ROUNDS = 10


@query(f"{medoid_sql(MEDOID_ROUNDS)}, o AS (SELECT c.i::INT AS cluster, c.vec_id AS medoid, count(*) AS n, round(max(d), 6) AS reach FROM a{MEDOID_ROUNDS} JOIN c{MEDOID_ROUNDS} c USING (i) GROUP BY ALL) SELECT *, round(avg(reach) OVER (), 4) AS mean_reach FROM o")
def kmedoids_chebyshev(spark, sf_dir):
    """Medoids by the largest coordinate gap until they rest: each is the member whose gaps to all members of its cluster sum to least."""
    return ml.kmedoids(unit_vectors(spark, sf_dir), "vec_id", 3, MEDOID_ROUNDS, 0.0).select("cluster", "medoid", "n", r6(F.col("reach")).alias("reach"), F.round("mean_reach", 4).alias("mean_reach"))


@query()
def kmeans_labels(spark, sf_dir):
    rows = ml.vectors(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "features")
    return ml.kmeans(rows, 10, 1).select("vec_id", "cluster")


@query(f"WITH {VECTORS} SELECT (a - 1)::INT AS i, (b - 1)::INT AS j, round(covar_pop(v[a], v[b]), 6) + 0.0 AS cov FROM v, unnest(range(1, {DIMS + 1})) AS x(a), unnest(range(1, {DIMS + 1})) AS y(b) GROUP BY a, b")
def covariance(spark, sf_dir):
    rows = ml.vectors(table(spark, sf_dir, "embeddings"), "embedding").select("features")
    return ml.covariance(rows).select("i", "j", r6(F.col("cov")).alias("cov"))


@query()
def pca_embed(spark, sf_dir):
    """Projections on the principal axes, as many as 0.99 of the variance asks for."""
    rows = ml.vectors(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "features")
    mean, axes, _ = ml.principal(rows, "variance")
    z = ml.projected(rows, mean, axes)
    return z.select("vec_id", F.transform("z", lambda x: F.round(x, 5) + 0.0).alias("z"), F.size("z").alias("dims"))


@query()
def pca_embed_participation(spark, sf_dir):
    """Delay vectors on twice as many axes as their variances' participation ratio."""
    held = sq.trajectory(event_sequence(spark, sf_dir), "value", 4)
    rows = ml.vectors(held, "vec").select("rec", "centre", "features")
    mean, axes, _ = ml.principal(rows, "participation")
    z = ml.projected(rows, mean, axes)
    return z.select("rec", "centre", F.transform("z", lambda x: F.round(x, 3) + 0.0).alias("z"), F.size("z").alias("dims"))


@query()
def whiten(spark, sf_dir):
    rows = ml.vectors(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "features")
    mean, axes, variance = ml.principal(rows, 3)
    return ml.projected(rows, mean, axes, np.sqrt(variance)).select("vec_id", F.transform("z", lambda x: F.round(x, 4) + 0.0).alias("z"))


@query()
def svd_embed(spark, sf_dir):
    """Delay vectors on their leading singular vectors (rows not centred), each of length 1 over all rows."""
    held = sq.trajectory(event_sequence(spark, sf_dir), "value", 4)
    rows = ml.vectors(held, "vec").select("rec", "centre", "features")
    _, axes, square = ml.principal(rows, 2, floor=0.0, centred=False)
    z = ml.projected(rows, np.zeros(len(axes)), axes, np.sqrt(square * max(1, rows.count())))
    return z.select("rec", "centre", F.transform("z", lambda x: F.round(x, 7) + 0.0).alias("z"))


@query()
def svd_modes(spark, sf_dir):
    """The modes themselves: singular values and right singular vectors of the delay vectors, whitened axes beside them."""
    held = sq.trajectory(event_sequence(spark, sf_dir), "value", 4)
    rows = ml.vectors(held, "vec").select("features")
    _, axes, square = ml.principal(rows, 3, floor=0.0, centred=False)
    size = np.sqrt(square * max(1, rows.count()))
    _, white, variance = ml.principal(rows, 3)
    cells = [(m, i, float(size[m]), float(axes[i, m]), float(white[i, m] / np.sqrt(variance[m]))) for m in range(3) for i in range(len(axes))]
    out = spark.createDataFrame(cells, "mode int, entry int, singular double, axis double, whitened double")
    return out.select("mode", "entry", F.round("singular", 3).alias("singular"), F.round("axis", 5).alias("axis"), F.round("whitened", 7).alias("whitened"))


#: Two orthogonal axes of length 1.
AXES = [[0.125] * DIMS, [0.125 if j % 2 == 0 else -0.125 for j in range(DIMS)]]


@query(f"WITH {VECTORS}, m AS (SELECT {MEANS} AS m FROM v), z AS (SELECT vec_id, list_dot_product(v, {AXES[0]}::DOUBLE[]) - list_dot_product(m, {AXES[0]}::DOUBLE[]) AS a, list_dot_product(v, {AXES[1]}::DOUBLE[]) - list_dot_product(m, {AXES[1]}::DOUBLE[]) AS b, m FROM v, m) SELECT vec_id, " + ", ".join(f"round({AXES[0][8 * i + 7]} * a + {AXES[1][8 * i + 7]} * b + m[{8 * i + 8}], 6) + 0.0 AS x{i}" for i in range(8)) + " FROM z")
def back_projection(spark, sf_dir):
    """Loadings on two axes, back in the vectors' space around their mean; of the 8 x 8 grid that a vector is, the last column."""
    v = unit_vectors(spark, sf_dir)
    mean = ml.mean_vector(v.select("v"), DIMS)
    dot = lambda axis: F.aggregate(F.zip_with("v", F.array(*map(F.lit, axis)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    z = v.select("vec_id", *((dot(a) - float(np.dot(mean, a))).alias(n) for a, n in zip(AXES, "ab")))
    return z.select("vec_id", *(r6(AXES[0][j] * F.col("a") + AXES[1][j] * F.col("b") + float(mean[j])).alias(f"x{j // 8}") for j in range(7, DIMS, 8)))


SEEDS = (1, 2, 3)
CENT = f"""WITH {VECTORS}, sd AS (SELECT unnest([{', '.join(map(str, SEEDS))}])::INT AS seed), h AS (SELECT seed, vec_id, label, v, ('0x' || substr(md5(seed || ':' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2 AS held FROM v, sd),
 m AS (SELECT seed, label AS i, {MEANS} AS c FROM h WHERE NOT held GROUP BY seed, label), g AS (SELECT h.seed, vec_id, label, arg_min(i, (round({GAP2}, 9), i)) AS guess FROM h JOIN m USING (seed) WHERE held GROUP BY ALL)"""


def centroid_guesses(spark, sf_dir):
    """(seed, vec_id, label, guess) of held-out vectors, by the nearest class mean, for several hashed splits; the class means come back to the driver."""
    v, out = unit_vectors(spark, sf_dir), None
    for seed in SEEDS:
        held = rs.uniform(F.lit(seed), F.col("vec_id")) < 0.2
        means = v.where(~held).groupBy("label").agg(*[F.avg(F.col("v")[j]).alias(f"m{j}") for j in range(DIMS)]).collect()
        found = ml.nearest(v.where(held), sorted((r.label, [r[f"m{j}"] for j in range(DIMS)]) for r in means), rounded_gap)
        found = found.select(F.lit(seed).alias("seed"), "vec_id", "label", F.col("cluster").alias("guess"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"{CENT}, n AS (SELECT seed, label, count(*) AS n FROM g GROUP BY ALL) SELECT g.seed, round(sum(CASE WHEN g.label = guess THEN 1.0::DOUBLE / n ELSE 0 END) / count(DISTINCT g.label), 6) AS accuracy FROM g JOIN n USING (seed, label) GROUP BY g.seed")
def weighted_accuracy(spark, sf_dir):
    """Accuracy with each label weighted by 1 / (number of labels x its rows), for each split."""
    guesses = centroid_guesses(spark, sf_dir).withColumnRenamed("guess", "predicted")
    return ml.weighted_accuracy(guesses, "label", ("seed",)).select("seed", r6(F.col("accuracy")).alias("accuracy"))


@query(f"""{CENT}, c AS (SELECT seed, label, guess, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT seed, label, guess, n / sum(n) OVER (PARTITION BY seed, label) AS share FROM c)
SELECT label, guess, round(sum(share) / {len(SEEDS)}, 6) AS share FROM s GROUP BY ALL""")
def confusion_norm(spark, sf_dir):
    """Confusion matrices with rows of sum 1, averaged over the splits."""
    c = centroid_guesses(spark, sf_dir).groupBy("seed", "label", "guess").agg(F.count(F.lit(1)).alias("n"))
    share = c.select("label", "guess", (F.col("n") / F.sum("n").over(Window.partitionBy("seed", "label"))).alias("share"))
    return share.groupBy("label", "guess").agg(r6(F.sum("share") / len(SEEDS)).alias("share"))


@query()
def logreg_cv(spark, sf_dir):
    """Logistic regression with balanced classes; C out of ten by cross-validation over five hashed folds, then the rows of each label that the held-out fifth gets right."""
    rows = ml.vectors(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "label", "features", (F.col("vec_id") % 5 != 0).alias("train"))
    c, out = ml.grid_searched_logistic(rows, "label", "vec_id")
    right = (F.col("label") == F.col("predicted")).cast("int")
    held = out.where("not train")
    return held.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("right")).select(F.lit(c).alias("c"), "label", "n", "right")


@query()
def logreg_accuracy(spark, sf_dir):
    """Weighted accuracy of the classifier on the rows it learned from and on the others."""
    rows = ml.vectors(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "label", "features", (F.col("vec_id") % 5 != 0).alias("train"))
    return ml.weighted_accuracy(ml.balanced_logistic(rows, "label"), "label", ("train",)).select("train", r6(F.col("accuracy")).alias("accuracy"))


FCM = [100.0, 250.0, 400.0]


def fcm_sql(rounds: int, where: str = "true") -> str:
    out = [f"{EV}, y AS (SELECT rec, avg(value) AS x FROM ev GROUP BY rec), x AS (SELECT * FROM y WHERE {where}), f0 AS (SELECT {FCM[0]}::DOUBLE AS c0, {FCM[1]}::DOUBLE AS c1, {FCM[2]}::DOUBLE AS c2)"]
    for r in range(rounds):
        out.append(f"w{r} AS (SELECT x, 1 / ((x - c0) ** 2 + 1e-12) AS i0, 1 / ((x - c1) ** 2 + 1e-12) AS i1, 1 / ((x - c2) ** 2 + 1e-12) AS i2 FROM x, f{r}), f{r + 1} AS MATERIALIZED (SELECT " + ", ".join(f"sum((i{j} / (i0 + i1 + i2)) ** 2 * x) / sum((i{j} / (i0 + i1 + i2)) ** 2) AS c{j}" for j in range(3)) + f" FROM w{r})")
    return "WITH " + ", ".join(out)


@query(f"{fcm_sql(5)} SELECT round(c0, 4) AS c0, round(c1, 4) AS c1, round(c2, 4) AS c2 FROM f5")
def fcm_k_iterations(spark, sf_dir):
    points = cut(event_sequence(spark, sf_dir).groupBy("rec").agg(F.avg("value").alias("x")), "points")
    centres = ml.fuzzy_cmeans(points, FCM, 5)
    return points.limit(1).select(*(F.round(F.lit(c), 4).alias(f"c{i}") for i, c in enumerate(centres)))


MEMBER = "1 / ((x - c{j}) ** 2 + 1e-12) / (1 / ((x - c0) ** 2 + 1e-12) + 1 / ((x - c1) ** 2 + 1e-12) + 1 / ((x - c2) ** 2 + 1e-12))"


@query(f"{fcm_sql(5, 'rec % 2 = 0')}, u AS (SELECT rec, " + ", ".join(f"{MEMBER.format(j=j)} AS u{j}" for j in range(3)) + " FROM y, f5), e AS (SELECT rec, label, count(*) / sum(count(*)) OVER (PARTITION BY rec) AS q FROM ev GROUP BY rec, label) SELECT u.rec, e.label, " + ", ".join(f"round(u{j} * q, 6) AS r{j}" for j in range(3)) + " FROM u JOIN e USING (rec)")
def fcm_responsibilities(spark, sf_dir):
    """Memberships in clusters that even recordings formed, predicted for all of them, times the share of each symbol: responsibilities of a second level."""
    seq = event_sequence(spark, sf_dir)
    points = cut(seq.groupBy("rec").agg(F.avg("value").alias("x")), "points")
    member = ml.memberships(points, ml.fuzzy_cmeans(points.where("rec % 2 = 0"), FCM, 5))
    n = seq.groupBy("rec", "label").agg(F.count(F.lit(1)).alias("n"))
    share = n.select("rec", "label", (F.col("n") / F.sum("n").over(Window.partitionBy("rec"))).alias("q"))
    return member.join(share, "rec").select("rec", "label", *(r6(F.col("u")[j] * F.col("q")).alias(f"r{j}") for j in range(3)))


#: Landmarks of a group; its other recordings are placed among them.
LANDMARKS = 48


def group_distances(spark, sf_dir):
    """(grp, rec, mark, d) of all recordings from the landmarks of their group, and of the landmarks among themselves."""
    rows = recording_rows(spark, sf_dir).withColumn("grp", group_of())
    marks = cut(pairs.landmarks(rows, "grp", LANDMARKS), "landmarks")
    cells = cut(pairs.to_landmarks(rows, marks, "grp", N_STATES), "landmark-distances")
    return cells, cut(cells.join(F.broadcast(marks.select("grp", "rec")), ["grp", "rec"], "left_semi"), "among")


def coordinates(embedded, names):
    return embedded.select("grp", "rec", *(F.round(F.col("z")[i], 5).alias(n) for i, n in enumerate(names)))


def embedded_landmarks(spark, sf_dir, dims):
    """(cells, distances among landmarks, embedded landmarks)"""
    cells, among = group_distances(spark, sf_dir)
    return cells, among, cut(pairs.embed(among, "grp", dims), "embedded")


@query()
def cse_embed(spark, sf_dir):
    """Constant-shift embedding of all recordings of each group: landmarks by their own distances, the others placed among them."""
    cells, among, embedded = embedded_landmarks(spark, sf_dir, 3)
    others = cells.join(F.broadcast(embedded.select("grp", "rec")), ["grp", "rec"], "left_anti")
    return coordinates(embedded.unionByName(pairs.project(others, among, embedded, "grp", 3)), "xyz")


@query()
def cse_project(spark, sf_dir):
    """All recordings of a group placed among its embedded landmarks."""
    return coordinates(pairs.project(*embedded_landmarks(spark, sf_dir, 2), "grp", 2), "xy")


def splits(spark, sf_dir):
    """(grp, level, rec, hard, shares) of all recordings of all groups."""
    cells, among = group_distances(spark, sf_dir)
    return cut(pairs.extended_splits(cells, among, cut(pairs.split_tree(among, "grp", 4), "tree"), "grp"), "splits")


@query()
def hfss_groups(spark, sf_dir):
    """Fuzzy spectral splits of all recordings of each group, level by level: hard parts and responsibilities. A group of fewer than three has level 0 only."""
    out = splits(spark, sf_dir).select("grp", "level", "rec", "hard", F.posexplode("shares").alias("part", "share"))
    return out.select("grp", "level", "rec", "part", (F.col("hard") == F.col("part")).alias("own"), r6(F.col("share")).alias("share"))


@query()
def posterior_by_condition(spark, sf_dir):
    """Mean responsibility of each part in each condition (group) at the last level it reached, with intervals of a bootstrap of its recordings."""
    held = splits(spark, sf_dir)
    reached = F.broadcast(held.groupBy("grp").agg(F.max("level").alias("level")))  # a row a group
    last = cut(held.join(reached, ["grp", "level"]).select("grp", "rec", F.posexplode("shares").alias("part", "share")), "responsibilities")
    times = rs.multiplicities_by(last.select("grp", "rec").distinct(), "grp", "rec", 50)
    m = last.join(times, ["grp", "rec"]).groupBy("grp", "part", "rep").agg((F.sum(F.col("share") * F.col("times")) / F.sum("times")).alias("v"))
    q = m.groupBy("grp", "part").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = last.groupBy("grp", "part").agg(F.avg("share").alias("mean"))
    return point.join(q, ["grp", "part"]).select("grp", "part", r6(F.col("mean")).alias("mean"), r6(F.col("q")[0]).alias("low"), r6(F.col("q")[1]).alias("high"))


SWEEP = f"""WITH {EV}, g AS (SELECT rec, t, b AS bins, floor(value / (500.0::DOUBLE / b))::INT AS label FROM ev, unnest([3, 5, 8]) AS u(b)),
 c AS (SELECT x.bins, l AS lag, x.label AS src, y.label AS dst, count(*) AS n FROM g x, unnest([1, 3]) AS u(l), g y WHERE x.rec = y.rec AND x.bins = y.bins AND y.t = x.t + l GROUP BY ALL),
 p AS (SELECT *, n / sum(n) OVER (PARTITION BY bins, lag, src) AS p FROM c), {steady('bins, lag')}
SELECT p.bins, p.lag, round(-sum(pi * p * ln(p)), 6) AS h FROM p JOIN pi ON pi.bins = p.bins AND pi.lag = p.lag AND src = state GROUP BY ALL"""


@query(SWEEP)
def entropy_sweep(spark, sf_dir):
    """Entropy rate for each number of bins of the signal and each delay: the grid is a column, so one pass serves all cells."""
    seq = event_sequence(spark, sf_dir).select("rec", "t", "value")
    cells = F.array(*[F.struct(F.lit(n).alias("bins"), F.floor(F.col("value") / (500.0 / n)).cast("int").alias("label")) for n in (3, 5, 8)])
    wide = seq.select("rec", "t", F.explode(cells).alias("c")).select("rec", "t", "c.*")
    by = Window.partitionBy("bins", "rec").orderBy("t")
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("label", k).over(by).alias("dst")) for k in (1, 3)])
    pairs = wide.select("bins", F.col("label").alias("src"), lags.alias("l")).select("bins", "src", F.explode("l").alias("l")).select("bins", "l.lag", "src", "l.dst").where("dst is not null")
    p = cut(markov.row_normalised(pairs.groupBy("bins", "lag", "src", "dst").agg(F.count(F.lit(1)).alias("n")), ("bins", "lag")), "p")
    keys = ("bins", "lag")
    return markov.entropy_rate(p, markov.stationary(p, keys), keys).select("bins", "lag", r6(F.col("h")).alias("h"))


@query()
def entropy_sweep_cells(spark, sf_dir):
    """Entropy rate for each seed, delay and number of clusters: sampled runs of each group, delay vectors of rows of two signals, mini-batch k-means, transitions.

    The grid is a column; a cell's rows are the groups' runs, a size that parameters set, so each cell is one task.
    """
    sweep = SweepParameters(seeds=(0, 1), delays=(1, 2), clusters=(3, 5), rows=100)
    both = F.array(F.col("value") / 490, F.col("k") / 100)
    seq = event_sequence(spark, sf_dir).select("rec", "t", both.alias("value")).withColumn("grp", group_of())
    return partition.entropy_sweep(seq, "grp", sweep).select("seed", "delay", "clusters", r6(F.col("h")).alias("h"))
