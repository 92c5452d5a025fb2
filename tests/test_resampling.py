"""Draws by binomial splitting: sums, the same numbers everywhere, and the distribution."""

import numpy as np
import pytest

from sequora.operators import resampling as rs


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_draws_sum_up_and_parts_agree(n):
    whole = rs.split_draws(np.arange(n), n, 20)
    assert (whole.sum(axis=0) == n).all() and (whole >= 0).all()
    some = np.unique(np.random.default_rng(n).integers(0, n, 5))
    assert np.array_equal(rs.split_draws(some, n, 20), whole[some])


def test_draws_are_multinomial():
    times = rs.split_draws(np.arange(37), 37, 4000)
    assert times.mean() == 1 and np.abs(times.mean(axis=1) - 1).max() < 0.08
    assert np.abs(times.var(axis=1) - (1 - 1 / 37)).max() < 0.12
    # the counts of two places go against each other by 1/n
    assert abs(np.mean([np.cov(times[i], times[i + 1])[0, 1] for i in range(36)]) + 1 / 37) < 0.01
    assert np.mean(times == 0) == pytest.approx((1 - 1 / 37) ** 37, abs=0.01)


def test_long_nodes_use_the_middle_of_the_distribution():
    low, f = rs._distribution(1_000_000, 1, 2)
    assert 0 < low < 500_000 and f[0] < 1e-12 and f[-1] == pytest.approx(1, abs=1e-9)
    times = rs.split_draws(np.array([0, 999_999]), 1_000_000, 50)
    assert times.shape == (2, 50) and times.mean() == pytest.approx(1, abs=0.35)


def test_multiplicities_of_a_table(spark):
    entities = spark.range(500).selectExpr("id * 7 % 500 as a", "cast(id as string) as b").repartition(5)
    got = rs.multiplicities(entities, ["a", "b"], 6).toPandas()
    assert (got.groupby("rep").times.sum() == 500).all() and set(got.rep) == set(range(6)) and (got.times > 0).all()
    assert not got.duplicated(["a", "rep"]).any()


def test_multiplicities_inside_groups(spark):
    entities = spark.createDataFrame([(i % 3, i) for i in range(200)], "grp int, rec long").repartition(4)
    got = rs.multiplicities_by(entities, "grp", "rec", 8).toPandas()
    assert (got.groupby(["grp", "rep"]).times.sum() == np.repeat([67, 67, 66], 8)).all() and (got.rec % 3 == got.grp).all()
    assert not got.duplicated(["rec", "rep"]).any()
