"""Hand fixtures, closed forms and properties of sequences and transition algebra."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sequora.operators import distributions as ds, kernels as kn, markov, motion, sequences as sq

N = None


def seq_of(spark, recs):
    rows = [(r, t, x) for r, labels in recs.items() for t, x in enumerate(labels)]
    return spark.createDataFrame(rows, "rec long, t long, label int")


@pytest.fixture(scope="module")
def f1(spark):
    return seq_of(spark, {1: [0, 0, 1, N, 1, 1, 0, 0, 0], 2: [1, 0, N, N, 1], 3: [N, N]})


def test_segments(f1):
    got = sorted((r.rec, r.t0, r.tf) for r in sq.segments(f1).collect())
    assert got == [(1, 0, 3), (1, 4, 9), (2, 0, 2), (2, 4, 5)]
    assert sorted((r.rec, r.t0) for r in sq.segments(f1, min_size=3).collect()) == [(1, 4)]


@pytest.mark.parametrize("lag, aware, want", [(1, True, {(0, 0): 3, (0, 1): 1, (1, 0): 2, (1, 1): 1}), (2, True, {(0, 0): 1, (0, 1): 1, (1, 0): 2}), (2, False, {(0, 0): 1, (0, 1): 1, (1, 0): 2, (1, 1): 1})])
def test_counts(f1, lag, aware, want):
    assert {(r.src, r.dst): r.n for r in sq.transition_counts(f1, lag, aware).collect()} == want
    pairs = sq.lag_pairs(f1, [lag], aware).groupBy("src", "dst").count().collect()
    assert {(r.src, r.dst): r["count"] for r in pairs} == want


def test_runs(f1):
    got = {}
    for r in sq.runs(f1).collect():
        got.setdefault((r.rec, r.label), []).append(r.dur)
    assert {k: sorted(v) for k, v in got.items()} == {(1, 0): [2, 3], (1, 1): [1, 2], (2, 0): [1], (2, 1): [1, 1]}


def test_two_states_closed_form(f1):
    p = markov.row_normalised(sq.transition_counts(f1, 1, True))
    cells = {(r.src, r.dst): r.p for r in p.collect()}
    assert cells == pytest.approx({(0, 0): 3 / 4, (0, 1): 1 / 4, (1, 0): 2 / 3, (1, 1): 1 / 3})
    pi = markov.stationary(p)
    assert {r.state: r.pi for r in pi.collect()} == pytest.approx({0: 8 / 11, 1: 3 / 11})
    assert markov.entropy_rate(p, pi).first().h == pytest.approx(0.582566, abs=1e-6)
    assert markov.entropy_production(p, pi).first().production == pytest.approx(0, abs=1e-9)
    r = {(x.src, x.dst): x.r for x in markov.reversible(p, pi).collect()}
    assert r == pytest.approx(cells)


def test_timescale_closed_form(spark, f1):
    import numpy as np

    assert kn.timescales(np.array([[3 / 4, 1 / 4], [2 / 3, 1 / 3]]), 1.0, 1)[0] == pytest.approx(0.402430, abs=1e-6)


def test_delay_vectors(spark):
    rows = spark.createDataFrame([(1, t, float(t + 1)) for t in range(6)], "rec long, t long, value double")
    got = sorted((r.centre, tuple(r.vec)) for r in sq.trajectory(rows, "value", 2).collect())
    assert got == [(1, (1, 2, 3)), (2, (2, 3, 4)), (3, (3, 4, 5))]


@pytest.mark.parametrize("n, left", [(10, 9), (9, 6)])
def test_chunks_drop_the_last(spark, n, left):
    assert sq.chunked(seq_of(spark, {1: [0] * n}), 3).count() == left


def test_survival_and_ecdf(spark):
    x = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (4.0,)], "x double")
    assert sorted(r.p for r in ds.ecdf(x, "x").collect()) == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert {r.x: r.s for r in ds.survival(x, "x").collect()} == pytest.approx({1.0: 5 / 6, 2.0: 1 / 3, 4.0: 0.0})
    assert ds.survival(x.limit(1), "x").first().s is None


def test_unwrap(spark):
    rows = spark.createDataFrame([(1, t, v) for t, v in enumerate([0.0, 2.0, -2.0, None, 2.5])], "rec long, t long, phase double")
    got = [r.angle for r in motion.unwrap(rows, "phase").orderBy("t").collect()]
    assert got[3] is None and [got[i] for i in (0, 1, 2, 4)] == pytest.approx([0, 2, -2 + 2 * math.pi, 2.5])


def test_unwrap_just_below_minus_pi(spark):
    a, b = (v * (math.pi / 245) - math.pi for v in (245.22, 0.22))
    assert b - a < -math.pi  # by one unit in the last place: a jump
    rows = spark.createDataFrame([(1, 0, a), (1, 1, b)], "rec long, t long, phase double")
    assert [r.angle for r in motion.unwrap(rows, "phase").orderBy("t").collect()] == pytest.approx([a, b + 2 * math.pi])


def test_drift_counts_values_on_an_edge(spark):
    rows = spark.createDataFrame([(1, t, v) for t, v in enumerate([250.0, 10.0, 260.0, 500.0, 500.1, 30.0, 30.0])], "rec long, t long, value double")
    got = {r.bin: (r.drift, r.n) for r in ds.drift_diffusion(rows, "value", 0.0, 500.0, 20, 2).where("n > 0").collect()}
    assert got == {10: (pytest.approx(62.525), 2), 0: (pytest.approx(245.0), 1), 19: (pytest.approx(-235.0), 1)}  # 500.1 is outside


def test_path(spark):
    rows = spark.createDataFrame([(1, 0, math.pi / 2, 9.0), (1, 1, -math.pi / 2, 1.0), (1, 2, 0.0, 2.0)], "rec long, t long, turn double, dist double")
    got = [(r.x, r.y) for r in motion.path(rows, "turn", "dist").orderBy("t").collect()]
    assert [c for xy in got for c in xy] == pytest.approx([0, 0, 0, 1, 2, 1], abs=1e-12)


def test_msd_of_a_straight_walk(spark):
    xy = spark.createDataFrame([(1, t, float(t), 0.0) for t in range(10)], "rec long, t long, x double, y double")
    assert {r.lag: (r.msd, r.n) for r in motion.msd(xy, [1, 3, 9, 10]).collect()} == {1: (1.0, 9), 3: (9.0, 7), 9: (81.0, 1)}


def test_js(spark):
    pq = spark.createDataFrame([(0.5, 1.0, 0.75), (0.5, 0.0, 0.25)], "p double, q double, m double")
    js = (ds.kl(pq, "p", "m").first().kl + ds.kl(pq, "q", "m").first().kl) / 2
    assert js == pytest.approx(0.311278, abs=1e-6)


def test_open_bins_and_pixels(spark):
    from pyspark.sql import functions as F

    x = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x double")
    assert x.select(ds.open_bin(F.col("x"), 0.0, 2.0, 2).alias("b")).where("b is not null").count() == 0
    y = spark.createDataFrame([(-0.4,), (0.4,), (1.6,)], "x double")
    assert [r.b for r in y.select(ds.place(F.col("x"), 0.0, 1.0, 2, 3).alias("b")).collect()] == [3, 3, 4]


def test_connected(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 2)], "src int, dst int")
    assert {(r.state, r.place) for r in markov.largest_connected(edges).collect()} == {(0, 0), (1, 1)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(1, 3), st.lists(st.one_of(st.none(), st.integers(0, 2)), min_size=1, max_size=12), min_size=1, max_size=3), st.integers(1, 3))
def test_properties(spark, recs, lag):
    seq = seq_of(spark, recs).cache()
    seg = sq.segments(seq).collect()
    counts = sq.transition_counts(seq, lag, True)
    assert sum(r.n for r in counts.collect()) == sum(max(0, r.tf - r.t0 - lag) for r in seg)
    assert sum(r.dur for r in sq.runs(seq).collect()) == sum(x is not None for labels in recs.values() for x in labels)
    rows = {}
    for r in markov.row_normalised(counts).collect():
        rows[r.src] = rows.get(r.src, 0) + r.p
    assert all(v == pytest.approx(1) for v in rows.values())
