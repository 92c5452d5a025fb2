"""Counts, operators and partitions of symbol sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sequora.operators import markov, pairs, sequences as sq
from sequora.operators.sequences import r6
from sequora.plans.registry import EV, GAP, query, split_sql
from sequora.sources.storage import cut
from sequora.sources.bindings import N_STATES, event_sequence, group_of

EVERY = 20
PAIRS = "pr AS (SELECT rec, label AS src, lead(label, {lag}) OVER (PARTITION BY rec ORDER BY t) AS dst FROM ev)"
SEG = "sg AS (SELECT *, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY t) AS seg FROM ev)"
P1 = PAIRS.format(lag=1) + """, c AS (SELECT src, dst, count(*) AS n FROM pr WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL),
 p AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM c)"""


def steady(keys: str = "", p: str = "p", out: str = "pi", squarings: int = 12) -> str:
    """SQL of the stationary measure: the matrix squared again and again (4,096 steps), then the mean of its rows."""
    by = f"{keys}, " if keys else ""
    same = "".join(f"a.{k.strip()} = b.{k.strip()} AND " for k in keys.split(",") if k.strip())
    a_by = "".join(f"a.{k.strip()}, " for k in keys.split(",") if k.strip())
    steps = [f"{out}0 AS MATERIALIZED (SELECT {by}src, dst, p::DOUBLE AS p FROM {p})"]
    steps += [f"{out}{i + 1} AS MATERIALIZED (SELECT {a_by}a.src, b.dst, sum(a.p * b.p) AS p FROM {out}{i} a JOIN {out}{i} b ON {same}a.dst = b.src GROUP BY {a_by}a.src, b.dst)" for i in range(squarings)]
    whole = f"(PARTITION BY {keys})" if keys else "()"
    return ", ".join(steps) + f", {out} AS (SELECT {by}dst AS state, sum(p) / sum(sum(p)) OVER {whole} AS pi FROM {out}{squarings} GROUP BY {by}dst)"


@query(f"WITH {EV}, {PAIRS.format(lag=3)} SELECT src, dst, count(*) AS n FROM pr WHERE dst IS NOT NULL GROUP BY ALL")
def transition_counts_lag3(spark, sf_dir):
    return sq.transition_counts(event_sequence(spark, sf_dir), 3)


@query(f"""WITH {GAP}, {SEG}, pr AS (SELECT label AS src, seg, lead(label, 3) OVER w AS dst, lead(seg, 3) OVER w AS seg2 FROM sg WINDOW w AS (PARTITION BY rec ORDER BY t))
SELECT src, dst, count(*) AS n FROM pr WHERE src IS NOT NULL AND dst IS NOT NULL AND seg = seg2 GROUP BY ALL""")
def transition_counts_gap_aware(spark, sf_dir):
    return sq.transition_counts(event_sequence(spark, sf_dir, gaps=True), 3, gap_aware=True)


@query(f"WITH {GAP}, {PAIRS.format(lag=3)} SELECT src, dst, count(*) AS n FROM pr WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL")
def transition_counts_ungapped(spark, sf_dir):
    return sq.transition_counts(event_sequence(spark, sf_dir, gaps=True), 3)


@query(f"""WITH {EV}, l AS (SELECT unnest(range(1, 20)) AS lag) SELECT lag::INT AS lag, a.label AS src, b.label AS dst, count(*) AS n
FROM ev a, l, ev b WHERE a.rec = b.rec AND b.t = a.t + lag GROUP BY ALL""")
def transition_counts_multi_lag(spark, sf_dir):
    pairs = sq.lag_pairs(event_sequence(spark, sf_dir), list(range(1, 20)))
    return pairs.groupBy("lag", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, {P1} SELECT src, dst, round(p, 6) AS p FROM p")
def transition_matrix(spark, sf_dir):
    return markov.row_normalised(sq.transition_counts(event_sequence(spark, sf_dir))).select("src", "dst", r6(F.col("p")).alias("p"))


GROUPED = """pr AS (SELECT (rec % 7)::INT AS grp, label AS src, lead(label, 1) OVER (PARTITION BY rec ORDER BY t) AS dst FROM ev),
 c AS (SELECT grp, src, dst, count(*) AS n FROM pr WHERE dst IS NOT NULL GROUP BY ALL), p AS (SELECT grp, src, dst, n / sum(n) OVER (PARTITION BY grp, src) AS p FROM c)"""


def group_matrices(spark, sf_dir):
    seq = event_sequence(spark, sf_dir).withColumn("grp", group_of())
    return markov.row_normalised(sq.transition_counts(seq, keys=("grp",)), ("grp",))


@query(f"WITH {EV}, {GROUPED}, g AS (SELECT unnest(range(0, 7))::INT AS grp), s AS (SELECT unnest(range(0, 5))::INT AS s) SELECT g.grp, a.s AS src, b.s AS dst, round(coalesce(p, 0), 6) AS p FROM g, s a, s b LEFT JOIN p ON p.grp = g.grp AND p.src = a.s AND p.dst = b.s")
def transition_matrix_by_group(spark, sf_dir):
    n = F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("s")))
    grid = spark.range(7).select(F.col("id").cast("int").alias("grp")).join(n.withColumnRenamed("s", "src")).join(n.withColumnRenamed("s", "dst"))
    return grid.join(group_matrices(spark, sf_dir), ["grp", "src", "dst"], "left").select("grp", "src", "dst", r6(F.coalesce("p", F.lit(0.0))).alias("p"))


@query(f"WITH {EV}, {GROUPED}, m AS (SELECT src, dst, sum(p) / 7 AS p FROM p GROUP BY ALL) SELECT src, dst, round(p / sum(p) OVER (PARTITION BY src), 6) AS p FROM m")
def ensemble_matrix(spark, sf_dir):
    mean = group_matrices(spark, sf_dir).groupBy("src", "dst").agg((F.sum("p") / 7).alias("n"))
    return markov.row_normalised(mean).select("src", "dst", r6(F.col("p")).alias("p"))


def operator(spark, sf_dir, lag=1):
    p = cut(markov.row_normalised(sq.transition_counts(event_sequence(spark, sf_dir), lag)), "p")  # read once, used often
    return p, markov.stationary(p)


@query(f"WITH {EV}, {P1}, {steady()} SELECT state, round(pi, 6) AS pi FROM pi")
def stationary_power_k(spark, sf_dir):
    return operator(spark, sf_dir)[1].select("state", r6(F.col("pi")).alias("pi"))


@query(f"""WITH {EV}, {P1}, {steady()} SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, round((coalesce(a.p, 0) + y.pi * coalesce(b.p, 0) / x.pi) / 2, 6) AS r
FROM p a FULL JOIN p b ON a.src = b.dst AND a.dst = b.src JOIN pi x ON x.state = coalesce(a.src, b.dst) JOIN pi y ON y.state = coalesce(a.dst, b.src)""")
def reversible_matrix(spark, sf_dir):
    return markov.reversible(*operator(spark, sf_dir)).select("src", "dst", r6(F.col("r")).alias("r"))


@query(f"""WITH {EV}, two AS (SELECT rec, t, CASE WHEN label IN (2, 3) THEN 1 ELSE 0 END AS label FROM ev), pr AS (SELECT label AS src, lead(label) OVER (PARTITION BY rec ORDER BY t) AS dst FROM two),
 q AS (SELECT sum(CASE WHEN src = 0 AND dst = 1 THEN 1 ELSE 0 END) / sum(CASE WHEN src = 0 THEN 1 ELSE 0 END) AS p01, sum(CASE WHEN src = 1 AND dst = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN src = 1 THEN 1 ELSE 0 END) AS p10 FROM pr WHERE dst IS NOT NULL)
SELECT round(p01, 6) AS p01, round(p10, 6) AS p10, round(p10 / (p01 + p10), 6) AS pi0, round(1 - p01 - p10, 6) AS lambda2, CASE WHEN abs(1 - p01 - p10) > 1e-12 THEN round(-1 / ln(abs(1 - p01 - p10)), 6) END AS timescale FROM q""")
def two_state_timescale(spark, sf_dir):
    two = event_sequence(spark, sf_dir).withColumn("label", F.col("label").isin(2, 3).cast("int"))
    n = lambda s, d: F.sum(F.when((F.col("src") == s) & (F.col("dst") == d), F.col("n")).otherwise(0))
    row = lambda s: F.sum(F.when(F.col("src") == s, F.col("n")).otherwise(0))
    q = sq.transition_counts(two).agg((n(0, 1) / row(0)).alias("p01"), (n(1, 0) / row(1)).alias("p10"))
    lam = 1 - F.col("p01") - F.col("p10")
    return q.select(r6(F.col("p01")).alias("p01"), r6(F.col("p10")).alias("p10"), r6(F.col("p10") / (F.col("p01") + F.col("p10"))).alias("pi0"), r6(lam).alias("lambda2"), F.when(F.abs(lam) > 1e-12, r6(-1 / F.ln(F.abs(lam)))).alias("timescale"))


@query(f"WITH {EV}, {P1}, {steady()} SELECT round(-sum(pi * p * ln(p)), 6) AS h FROM p JOIN pi ON src = state")
def entropy_rate(spark, sf_dir):
    return markov.entropy_rate(*operator(spark, sf_dir)).select(r6(F.col("h")).alias("h"))


BOTH = "z AS (SELECT a.src, pi * a.p AS f, a.p, b.p AS q FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src JOIN pi ON a.src = state)"


@query(f"WITH {EV}, {P1}, {steady()}, {BOTH} SELECT round(-sum(f * ln(p)), 6) AS h, round(-sum(f * ln(q)), 6) AS h_r, round(sum(f * ln(p)) - sum(f * ln(q)), 6) + 0.0 AS production FROM z")
def entropy_production(spark, sf_dir):
    return markov.entropy_production(*operator(spark, sf_dir)).select(*(r6(F.col(c)).alias(c) for c in ("h", "h_r", "production")))


@query(f"WITH {EV}, {P1}, {steady()}, {BOTH} SELECT src, round(-sum(f * ln(p)), 6) AS h, round(-sum(f * ln(q)), 6) AS h_r, round(sum(f * ln(p)) - sum(f * ln(q)), 6) + 0.0 AS production FROM z GROUP BY src")
def entropy_production_per_state(spark, sf_dir):
    return markov.entropy_production(*operator(spark, sf_dir), per_state=True).select("src", *(r6(F.col(c)).alias(c) for c in ("h", "h_r", "production")))


LAGGED = """lg AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS lag), c AS (SELECT lag, a.label AS src, b.label AS dst, count(*) AS n FROM ev a, lg, ev b WHERE a.rec = b.rec AND b.t = a.t + lag GROUP BY ALL),
 p AS (SELECT lag, src, dst, n / sum(n) OVER (PARTITION BY lag, src) AS p FROM c)"""


@query(f"""WITH {EV}, {LAGGED}, {steady('lag')}, h AS (SELECT p.lag, -sum(pi * p * ln(p)) AS h FROM p JOIN pi ON pi.lag = p.lag AND src = state GROUP BY p.lag)
SELECT lag, round(h, 6) AS h, round(lag(h) OVER (ORDER BY lag) - h, 6) + 0.0 AS growth FROM h""")
def entropy_rate_vs_delay(spark, sf_dir):
    pairs = sq.lag_pairs(event_sequence(spark, sf_dir), [1, 2, 3, 4, 5, 6])
    p = cut(markov.row_normalised(pairs.groupBy("lag", "src", "dst").agg(F.count(F.lit(1)).alias("n")), ("lag",)), "p")
    h = markov.entropy_rate(p, markov.stationary(p, ("lag",)), ("lag",))
    return h.select("lag", r6(F.col("h")).alias("h"), r6(F.lag("h").over(Window.orderBy("lag")) - F.col("h")).alias("growth"))


CHUNKS = "ck AS (SELECT *, floor(t / 20)::BIGINT AS chunk FROM (SELECT *, count(*) OVER (PARTITION BY rec) AS len FROM ev) WHERE t < ceil((len - 20) / 20) * 20)"


@query(f"WITH {EV}, {CHUNKS}, pr AS (SELECT rec, chunk, label AS src, lead(label) OVER (PARTITION BY rec, chunk ORDER BY t) AS dst FROM ck) SELECT rec, chunk, src, dst, count(*) AS n FROM pr WHERE dst IS NOT NULL GROUP BY ALL")
def chunked_counts(spark, sf_dir):
    held = sq.chunked(event_sequence(spark, sf_dir), 20)
    dst = F.lead("label").over(Window.partitionBy("rec", "chunk").orderBy("t"))
    return held.select("rec", "chunk", F.col("label").alias("src"), dst.alias("dst")).where("dst is not null").groupBy("rec", "chunk", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {EV}, {CHUNKS}, pr AS (SELECT rec, chunk, label AS src, lead(label) OVER (PARTITION BY rec, chunk ORDER BY t) AS dst FROM ck),
 c AS (SELECT rec, chunk, src, dst, count(*) AS n FROM pr WHERE dst IS NOT NULL GROUP BY ALL), ids AS (SELECT rec, chunk, row_number() OVER (ORDER BY rec, chunk) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT rec, chunk FROM c)),
 {split_sql(20)},
 w AS (SELECT rep, i, count(*) AS times FROM d GROUP BY ALL)
SELECT rep::INT AS rep, src, dst, sum(times * n)::BIGINT AS n FROM w JOIN ids USING (i) JOIN c USING (rec, chunk) GROUP BY ALL""")
def chunk_bootstrap_counts(spark, sf_dir):
    from sequora.operators.resampling import multiplicities

    counts = chunked_counts(spark, sf_dir)
    pieces = counts.select("rec", "chunk").distinct()
    times = multiplicities(pieces, ["rec", "chunk"], 20)
    return counts.join(times, ["rec", "chunk"]).groupBy("rep", "src", "dst").agg(F.sum(F.col("times") * F.col("n")).alias("n"))


#: Events of a kind at a place of the day's rhythm are a state.
FINE = "fs AS (SELECT rec, t, label * 20 + k % 20 AS label FROM ev)"
FINE_COUNTS = "fc AS (SELECT src, dst, count(*) AS n FROM (SELECT label AS src, lead(label) OVER (PARTITION BY rec ORDER BY t) AS dst FROM fs) WHERE dst IS NOT NULL GROUP BY ALL)"
EDGES = f"{FINE}, {FINE_COUNTS}, ed AS MATERIALIZED (SELECT src, dst FROM fc)"
CONNECTED = """tc AS (SELECT src, dst FROM ed UNION SELECT tc.src, ed.dst FROM tc JOIN ed ON tc.dst = ed.src),
 st AS (SELECT src AS state FROM ed UNION SELECT dst FROM ed),
 mu AS (SELECT a.src AS state, min(a.dst) AS low FROM tc a JOIN tc b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
 grp AS (SELECT st.state, least(st.state, coalesce(low, st.state)) AS grp FROM st LEFT JOIN mu USING (state)),
 best AS (SELECT grp FROM grp GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 1),
 lc AS (SELECT state, row_number() OVER (ORDER BY state) - 1 AS place FROM grp WHERE grp = (SELECT grp FROM best))"""


def fine_states(spark, sf_dir):
    return event_sequence(spark, sf_dir).select("rec", "t", (F.col("label") * 20 + F.col("k") % 20).alias("label"))


def fine_counts(spark, sf_dir):
    """Transitions between the fine states over the whole sequences."""
    return cut(sq.transition_counts(fine_states(spark, sf_dir)), "counts")


@query(f"WITH RECURSIVE {EV}, {EDGES}, {CONNECTED} SELECT state FROM lc")
def connected_states(spark, sf_dir):
    return markov.largest_connected(fine_counts(spark, sf_dir)).select("state")


@query(f"WITH RECURSIVE {EV}, {EDGES}, {CONNECTED} SELECT rec, t, place AS label FROM fs LEFT JOIN lc ON state = label")
def connected_relabel(spark, sf_dir):
    """Every row of the sequences with its symbol's place in the largest connected set; other symbols are missing."""
    held = cut(markov.largest_connected(fine_counts(spark, sf_dir)), "connected")
    return markov.connected_labels(fine_states(spark, sf_dir), held).select("rec", "t", F.col("label").cast("long").alias("label"))


@query(f"WITH RECURSIVE {EV}, {EDGES}, {CONNECTED}, q AS (SELECT src, dst, n FROM fc WHERE src IN (SELECT state FROM lc) AND dst IN (SELECT state FROM lc)) SELECT src, dst, round(n / sum(n) OVER (PARTITION BY src), 6) AS p FROM q")
def transition_pipeline(spark, sf_dir):
    """Count, keep the largest connected set, normalise."""
    counts = fine_counts(spark, sf_dir)
    states = cut(markov.largest_connected(counts).select("state"), "states")
    a, b = (states.withColumnRenamed("state", x) for x in ("src", "dst"))
    return markov.row_normalised(counts.join(a, "src", "left_semi").join(b, "dst", "left_semi")).select("src", "dst", r6(F.col("p")).alias("p"))


@query(f"WITH {EV}, {P1} SELECT src, dst, round(p, 6) AS p FROM p WHERE p >= 0.2")
def matrix_threshold(spark, sf_dir):
    return transition_matrix(spark, sf_dir).where("p >= 0.2")


@query(f"""WITH {EV}, {P1}, o AS (SELECT state, row_number() OVER (ORDER BY state % 2, state) - 1 AS place FROM (SELECT DISTINCT src AS state FROM p))
SELECT a.place AS row_place, b.place AS col_place, round(p, 6) AS p FROM p JOIN o a ON src = a.state JOIN o b ON dst = b.state""")
def matrix_block_order(spark, sf_dir):
    p = transition_matrix(spark, sf_dir)
    place = p.select(F.col("src").alias("state")).distinct().select("state", (F.row_number().over(Window.orderBy(F.col("state") % 2, "state")) - 1).cast("long").alias("place"))
    a = F.broadcast(place.select(F.col("state").alias("src"), F.col("place").alias("row_place")))
    b = F.broadcast(place.select(F.col("state").alias("dst"), F.col("place").alias("col_place")))
    return p.join(a, "src").join(b, "dst").select("row_place", "col_place", "p")


PHI = "f AS (SELECT label AS state, avg(value) AS phi FROM ev GROUP BY label), rk AS (SELECT state, phi, row_number() OVER (ORDER BY phi, state) AS rk, count(*) OVER () AS n FROM f)"


COHERENT = f"""{EV}, {P1}, {steady()}, {PHI},
 rr AS (SELECT rk.state, phi, rk, n, pi FROM rk JOIN pi USING (state)),
 co AS (SELECT x.phi AS c, x.rk, (SELECT sum(a.pi * p) FROM p JOIN rr a ON a.state = src JOIN rr b ON b.state = dst WHERE a.rk <= x.rk AND b.rk <= x.rk) / (SELECT sum(pi) FROM rr WHERE rk <= x.rk) AS low,
   (SELECT sum(a.pi * p) FROM p JOIN rr a ON a.state = src JOIN rr b ON b.state = dst WHERE a.rk > x.rk AND b.rk > x.rk) / (SELECT sum(pi) FROM rr WHERE rk > x.rk) AS high FROM rr x WHERE x.rk > 1 AND x.rk < x.n)"""


@query(f"WITH {COHERENT} SELECT round(c, 6) AS c, round(least(low, high), 6) AS rho FROM co")
def coherent_scan(spark, sf_dir):
    phi = event_sequence(spark, sf_dir).groupBy(F.col("label").alias("state")).agg(F.avg("value").alias("phi"))
    return markov.coherence(*operator(spark, sf_dir), phi).select(r6(F.col("c")).alias("c"), r6(F.col("rho")).alias("rho"))


#: Least coherence of a peak. The default of ``markov.peaks`` is 0.5; event types follow each other almost independently, so theirs are lower.
HEIGHT = 0.1


@query(f"""WITH {COHERENT}, q AS (SELECT round(c, 6) AS c, round(least(low, high), 6) AS rho FROM co), e AS (SELECT c, rho, lag(rho) OVER (ORDER BY c) AS b, lead(rho) OVER (ORDER BY c) AS a FROM q)
SELECT c, rho FROM e WHERE rho > b AND rho > a AND rho >= {HEIGHT} ORDER BY rho DESC, c LIMIT 1""")
def coherent_peak(spark, sf_dir):
    return markov.peaks(cut(coherent_scan(spark, sf_dir), "scan"), HEIGHT).orderBy(F.desc("rho"), "c").limit(1)


@query(f"""WITH {COHERENT}, m AS (SELECT rk - 2 AS m FROM co ORDER BY round(least(low, high), 9) DESC, c LIMIT 1)
SELECT state, round(CASE WHEN rk <= m THEN coalesce(-1 + (rk - 1) / nullif(m - 1, 0), -1) ELSE coalesce((rk - m - 1) / nullif(n - m - 1, 0), 0) END, 6) + 0.0 AS place FROM rk, m""")
def rank_remap(spark, sf_dir):
    """States in the order of phi, spread over [-1, 0] before the most coherent threshold and over [0, 1] from there on."""
    phi = cut(event_sequence(spark, sf_dir).groupBy(F.col("label").alias("state")).agg(F.avg("value").alias("phi")), "phi")
    curve = markov.coherence(*operator(spark, sf_dir), phi)
    best = curve.orderBy(F.desc(F.round("rho", 9)), "c").limit(1).select("c")
    whole = Window.partitionBy()
    ranks = phi.select("state", "phi", F.row_number().over(Window.orderBy("phi", "state")).alias("rk"), F.count(F.lit(1)).over(whole).alias("n"))
    held = ranks.join(F.broadcast(best)).withColumn("m", F.max(F.when(F.col("phi") == F.col("c"), F.col("rk"))).over(whole) - 2)
    rk, n, m = F.col("rk"), F.col("n"), F.col("m")
    low = F.when(m > 1, -1 + (rk - 1) / (m - 1)).otherwise(-1.0)
    high = F.when(n > m + 1, (rk - m - 1) / (n - m - 1)).otherwise(0.0)
    return held.select("state", r6(F.when(rk <= m, low).otherwise(high)).alias("place"))


@query(f"WITH {EV}, {P1}, {steady()} SELECT CASE WHEN state IN (2, 3) THEN 1 ELSE 0 END AS meta, round(sum(pi), 6) AS measure FROM pi GROUP BY ALL")
def metastate_measure(spark, sf_dir):
    return operator(spark, sf_dir)[1].groupBy(F.col("state").isin(2, 3).cast("int").alias("meta")).agg(r6(F.sum("pi")).alias("measure"))


@query(f"""WITH {EV}, {P1}, {steady()}, m AS (SELECT label AS state, avg(value) AS v FROM ev GROUP BY label)
SELECT CASE WHEN state IN (2, 3) THEN 1 ELSE 0 END AS meta, round(sum(pi * v) / sum(pi), 6) AS mean FROM pi JOIN m USING (state) GROUP BY ALL""")
def metastate_weighted_avg(spark, sf_dir):
    mean = event_sequence(spark, sf_dir).groupBy(F.col("label").alias("state")).agg(F.avg("value").alias("v"))
    return operator(spark, sf_dir)[1].join(F.broadcast(mean), "state").groupBy(F.col("state").isin(2, 3).cast("int").alias("meta")).agg(r6(F.sum(F.col("pi") * F.col("v")) / F.sum("pi")).alias("mean"))


USERS = "u AS (SELECT rec, src, dst, count(*)::DOUBLE AS n FROM (SELECT rec, label AS src, lead(label) OVER (PARTITION BY rec ORDER BY t) AS dst FROM ev) WHERE dst IS NOT NULL GROUP BY ALL), p AS (SELECT rec, src, dst, n / sum(n) OVER (PARTITION BY rec, src) AS p FROM u)"
GRID = f"g AS MATERIALIZED (SELECT r.rec, i.i AS src, j.j AS dst, coalesce(p, 0) AS p FROM (SELECT DISTINCT rec FROM p) r, unnest(range(0, {N_STATES})) AS i(i), unnest(range(0, {N_STATES})) AS j(j) LEFT JOIN p ON p.rec = r.rec AND p.src = i.i AND p.dst = j.j)"
#: All recordings are compared with all recordings.
L1ALL = f"{GRID}, d AS MATERIALIZED (SELECT x.rec AS a, y.rec AS b, sum(abs(x.p - y.p)) / {N_STATES} AS d FROM g x JOIN g y ON x.src = y.src AND x.dst = y.dst GROUP BY ALL)"
#: Recordings with an id divisible by 20 are compared with all recordings.
L1J = f"{GRID}, d AS MATERIALIZED (SELECT x.rec AS a, y.rec AS b, sum(abs(x.p - y.p)) / {N_STATES} AS d FROM g x JOIN g y ON x.src = y.src AND x.dst = y.dst WHERE x.rec % {EVERY} = 0 GROUP BY ALL)"


def recording_rows(spark, sf_dir):
    """(rec, row): the transition matrix of each recording as one array, row by row; cells without a transition are 0."""
    seq = event_sequence(spark, sf_dir)
    p = markov.row_normalised(sq.transition_counts(seq, keys=("rec",)), ("rec",))
    return cut(markov.as_rows(p, N_STATES, ("rec",)), "recordings")


@query(f"WITH {EV}, {USERS}, {GRID} SELECT rec, src::INT AS src, dst::INT AS dst, round(p, 6) AS p FROM g")
def recording_matrices(spark, sf_dir):
    """The matrix of each recording in the whole state space, cells without a transition with 0."""
    return markov.from_rows(recording_rows(spark, sf_dir), N_STATES, ("rec",)).select("rec", "src", "dst", r6(F.col("p")).alias("p"))


def compared(spark, sf_dir):
    """(a, b, d): mean row distances of the stated recordings from all."""
    return pairs.distances(recording_rows(spark, sf_dir), N_STATES, EVERY)


@query(f"WITH {EV}, {USERS}, {L1J} SELECT a, b, round(d, 6) AS d FROM d WHERE a <> b AND (b % {EVERY} <> 0 OR a < b)")
def pairwise_l1(spark, sf_dir):
    """Each pair once, without the diagonal."""
    return compared(spark, sf_dir).where(f"a != b and (b % {EVERY} != 0 or a < b)").select("a", "b", pairs.rounded(F.col("d")).alias("d"))


@query(f"WITH {EV}, {USERS}, {L1ALL} SELECT a, round(min(d) / max(d), 6) AS ratio FROM d WHERE a <> b GROUP BY a")
def nn_ratio(spark, sf_dir):
    """Of every recording, the distance of the nearest other one over that of the farthest."""

    def ends(d, a, b):
        same = a["rec"][:, None] == b["rec"][None, :]
        return np.where(same, np.inf, d).min(axis=1), np.where(same, -np.inf, d).max(axis=1)

    held = pairs.over_all(recording_rows(spark, sf_dir), N_STATES, ends, {"least": "min", "most": "max"})
    return held.where("most >= 0").select("a", r6(F.try_divide("least", "most")).alias("ratio"))  # alone, a recording has no other


@query(f"WITH {EV}, {USERS}, {L1J} SELECT a, b, round(d, 6) AS d FROM d WHERE b % 2 = 1")
def cross_set_l1(spark, sf_dir):
    """Between two sets: the stated recordings, which are even, and the odd ones."""
    return compared(spark, sf_dir).where("b % 2 = 1").select("a", "b", pairs.rounded(F.col("d")).alias("d"))


@query(f"WITH {EV}, {USERS}, {L1ALL} SELECT a, b, round(-0.5::DOUBLE * (d - avg(d) OVER (PARTITION BY a) - avg(d) OVER (PARTITION BY b) + avg(d) OVER ()), 6) + 0.0 AS c FROM d")
def double_centering(spark, sf_dir):
    """All distances less the means of their row and column, plus that of all; the means come from sums over the cells' values, so each distance is made once."""
    rows = recording_rows(spark, sf_dir)
    mean = cut(pairs.distance_sums(rows, N_STATES).select("rec", (F.col("to_all") / F.col("n_all")).alias("mean")), "sums")
    ma = mean.select(F.col("rec").alias("a"), F.col("mean").alias("ma"))
    ma = ma.join(F.broadcast(ma.agg(F.avg("ma").alias("m"))))  # all a have equally many pairs
    mb = mean.select(F.col("rec").alias("b"), F.col("mean").alias("mb"))
    held = pairs.distances(rows, N_STATES, 1, ma, mb)
    return held.select("a", "b", pairs.rounded(-0.5 * (F.col("d") - F.col("ma") - F.col("mb") + F.col("m"))).alias("c"))


@query(f"WITH {EV}, {USERS}, {L1ALL}, x AS (SELECT a, avg(d) AS eps FROM d WHERE a <> b GROUP BY a), y AS (SELECT b, avg(d) AS eps FROM d WHERE a <> b GROUP BY b), k AS (SELECT d.a, d.b, exp(-d / sqrt(x.eps * y.eps)) AS k FROM d JOIN x USING (a) JOIN y USING (b)) SELECT a, b, round(k / sum(k) OVER (PARTITION BY a), 6) AS k FROM k")
def diffusion_kernel(spark, sf_dir):
    """Widths come from sums over the cells' values; a's sums of the kernel are made where its distances are, then the kernel meets them where the distances are made again."""
    rows = recording_rows(spark, sf_dir)
    sums = pairs.distance_sums(rows, N_STATES).where("n_all > 1")  # alone, a recording has no others
    eps = cut(sums.select("rec", (F.col("to_all") / (F.col("n_all") - 1)).alias("eps")), "widths")

    def kernel(d, a, b):
        return (np.exp(-d / np.sqrt(a["eps"][:, None] * b["eps"][None, :])).sum(axis=1),)

    total = cut(pairs.over_all(rows.join(eps, "rec"), N_STATES, kernel, {"total": "sum"}), "totals")
    ea = eps.select(F.col("rec").alias("a"), F.col("eps").alias("ea")).join(total, "a")
    held = pairs.distances(rows, N_STATES, 1, ea, eps.select(F.col("rec").alias("b"), F.col("eps").alias("eb")))
    k = F.exp(-F.col("d") / F.sqrt(F.col("ea") * F.col("eb")))
    return held.select("a", "b", pairs.rounded(k / F.col("total")).alias("k"))
