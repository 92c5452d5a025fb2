"""Queries that SQL can't express, against numpy on the same rows, and properties of their kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sequora.config import SweepParameters
from sequora.operators import kernels as kn, learning as ml, markov, motion, pairs, partition, sequences as sq
from sequora.plans import catalogue
from sequora.plans.kernels import DELAYS, LANDMARKS
from sequora.sources.bindings import EVENT_LABELS, event_sequence

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def get(name):
        if name not in held:
            held[name] = catalogue.QUERIES[name](spark, SF).toPandas()
        return held[name]

    return get


@pytest.fixture(scope="module")
def events():
    """(rec, t, label, k, value) by pandas alone."""
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    k = e.props.map(lambda s: int(__import__("json").loads(s)["k"]))
    out = pd.DataFrame({"rec": e.user_id, "label": e.event_type.map(EVENT_LABELS), "k": k, "value": e.value})
    out["t"] = out.groupby("rec").cumcount()
    return out.reset_index(drop=True)


def counted(labels_of, lag, n):
    c = np.zeros((n, n))
    for x in labels_of:
        for a, b in zip(x, x[lag:]):
            c[a, b] += 1
    return c


def reversible(c):
    """(states, pi, R) on the largest set that reaches itself, pi by many steps of a lazy chain."""
    n = len(c)
    reach = np.linalg.matrix_power((c > 0) + np.eye(n), n) > 0
    both = reach & reach.T
    states = np.flatnonzero(both[np.argmax(both.sum(axis=1))])
    p = c[np.ix_(states, states)]
    p = p / p.sum(axis=1, keepdims=True)
    pi = np.linalg.matrix_power((p + np.eye(len(p))) / 2, 1 << 14)[0]
    return states, pi, (p + (pi[None, :] * p.T) / pi[:, None]) / 2


def decay(r, lag, k):
    values = np.sort(np.linalg.eigvals(r).real)[::-1][1 : k + 1]
    return [-lag / np.log(v) if 1e-12 < v < 1 - 1e-12 else None for v in values] + [None] * (k - len(values))


def same(got, want, tolerance=2e-5):
    for m, w in enumerate(want, 1):
        g = got[got["mode"] == m].timescale.iloc[0]
        assert (pd.isna(g) and w is None) or g == pytest.approx(w, rel=tolerance, abs=1e-5)


def fine(events):
    return [(g.label * 4 + g.k % 4).tolist() for _, g in events.groupby("rec")]


def test_spectra(run, events):
    got = run("spectrum_topk")
    for lag in (1, 2):
        states, pi, r = reversible(counted(fine(events), lag, 20))
        for mode, part in got[got.lag == lag].groupby("mode"):
            part = part.sort_values("state")
            assert part.state.tolist() == states.tolist() and np.allclose(part.pi, pi, atol=1e-5)
            assert np.allclose(r @ part.phi.to_numpy(), part.value.iloc[0] * part.phi.to_numpy(), atol=1e-4)
        values = got[got.lag == lag].drop_duplicates("mode").sort_values("mode").value
        assert np.allclose(values, np.sort(np.linalg.eigvals(r).real)[::-1][: len(values)], atol=1e-5)


def test_timescales(run, events):
    for name, lags, k in (("implied_timescales", [1], 10), ("timescales_by_delay", [1, 2, 3, 5, 8], 5)):
        for lag in lags:
            same(run(name)[run(name).lag == lag], decay(reversible(counted(fine(events), lag, 20))[2], lag, k))


def test_timescales_of_pieces_and_trajectories(run, events):
    pieces, segments = [], []
    for _, g in events.groupby("rec"):
        x = g.label.tolist()
        pieces += [x[i : i + 16] for i in range(0, int(np.ceil((len(x) - 16) / 16)) * 16, 16)]
        part = []
        for s in [*x, 1]:  # errors are gaps
            if s == 1:
                segments, part = segments + [part], []
            else:
                part.append(s)
    for lag in DELAYS:
        want = decay(reversible(counted(pieces, lag, 5))[2], lag, 2)
        same(run("pooled_timescales").query("lag == @lag"), want)
        same(run("timescales_with_intervals").query("lag == @lag"), want)
        same(run("trajectory_timescales").query("lag == @lag"), decay(reversible(counted(segments, lag, 5))[2], lag, 2))
    held = run("timescales_with_intervals").dropna()
    assert len(held) and (held.low <= held["median"]).all() and (held["median"] <= held.high).all()


def test_bootstrap_of_timescales(run):
    q = run("bootstrap_timescales")
    assert len(q) and (q.low <= q["median"]).all() and (q["median"] <= q.high).all() and (q.low > 0).all()


def test_timescales_per_recording(run, events):
    got = run("subtraj_timescales")
    rec = got.rec.iloc[0]
    x = events[events.rec == rec].label.tolist()
    pieces = [x[i : i + 20] for i in range(0, int(np.ceil((len(x) - 20) / 20)) * 20, 20)]
    same(got[got.rec == rec], decay(reversible(counted(pieces, 1, 5))[2], 1, 2))


def test_posterior(run, events):
    got = run("posterior_matrices").set_index(["src", "dst"])
    c = counted([g.label.tolist() for _, g in events.groupby("rec")], 1, 5)
    p = c / c.sum(axis=1, keepdims=True)
    assert len(got) == (c > 0).sum() and np.allclose(got["mean"].groupby("src").sum(), 1, atol=1e-4)
    assert all(abs(row["mean"] - p[i]) < 4 * row.sd + 1e-3 for i, row in got.iterrows())


def test_stationary_of_slow_and_periodic_chains(spark):
    cells = [("slow", 0, 0, 1 - 1e-6), ("slow", 0, 1, 1e-6), ("slow", 1, 1, 1 - 3e-6), ("slow", 1, 0, 3e-6), ("turn", 0, 1, 1.0), ("turn", 1, 2, 1.0), ("turn", 2, 0, 1.0), ("sink", 0, 0, 0.5), ("sink", 0, 1, 0.5), ("sink", 1, 1, 1.0)]
    p = spark.createDataFrame(cells, "name string, src int, dst int, p double")
    pi = {(r["name"], r.state): r.pi for r in markov.stationary(p, ("name",)).collect()}
    assert pi == pytest.approx({("slow", 0): 0.75, ("slow", 1): 0.25, **{("turn", i): 1 / 3 for i in range(3)}, ("sink", 0): 0, ("sink", 1): 1}, abs=1e-8)


def test_connected_sets(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (5, 0), (9, 8), (8, 7), (7, 9), (7, 6)]
    got = {r.state: r.grp for r in markov.strongly_connected(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 7: 7, 8: 7, 9: 7, 6: 6}
    assert {(r.state, r.place) for r in markov.largest_connected(spark.createDataFrame(edges, "src int, dst int")).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_peaks_and_plateaus(spark):
    curve = spark.createDataFrame(list(enumerate([0.1, 0.6, 0.2, 0.7, 0.7, 0.7, 0.3, 0.4, 0.4, 0.9])), "c int, rho double")
    assert {(r.c, r.rho) for r in markov.peaks(curve, 0.5).collect()} == {(1, 0.6), (4, 0.7)}
    assert markov.peaks(curve, 0.95).count() == 0
    assert kn.plateau(np.array([1.0, 2, 3, 4, 5, 5, 5, 5]))[1] == pytest.approx(5)


def two_blocks(n=400):
    """A walk that stays in states 0 to 2 for a while, then in 3 to 5, and so on."""
    rng = np.random.default_rng(3)
    block, out = 0, []
    for _ in range(n):
        block = 1 - block if rng.random() < 0.05 else block
        out.append(block * 3 + int(rng.integers(3)))
    return out


def test_coherent_sets_of_two_blocks(spark):
    seq = spark.createDataFrame([(1, t, x) for t, x in enumerate(two_blocks())], "rec long, t long, label int")
    got = partition.recursive_partition(seq, 1, 2).where("level = 1").collect()
    parts = {r.state: r.part for r in got}
    # the threshold's own state goes with the upper side, so one state may leave its block
    wrong = min(sum(parts[s] != (s > 2) for s in parts), sum(parts[s] != (s < 3) for s in parts))
    assert len(parts) == 6 and wrong <= 1
    p = markov.row_normalised(sq.transition_counts(seq)).cache()
    c = counted([two_blocks()], 1, 6)
    _, _, phi = kn.spectrum(c / c.sum(axis=1, keepdims=True), 2)
    phi = spark.createDataFrame([(i, float(v)) for i, v in enumerate(phi[:, 1])], "state int, phi double")
    side = {r.state: r.part for r in markov.optimal_split(p, markov.stationary(p), phi).collect()}
    assert len(side) == 6 and sorted((sum(side[s] for s in (0, 1, 2)), sum(side[s] for s in (3, 4, 5)))) == [0, 2]
    modes = kn.recentred(np.arange(6), c / c.sum(axis=1, keepdims=True), 1, 0.5)
    assert modes.z.abs().max() == pytest.approx(modes.z.max()) and (modes.z < 0).any()


def walks(seed, blocks, n=700):
    """Recordings that stay among four states for a while, then among four others."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(3):
        block, seq = int(rng.integers(blocks)), []
        for _ in range(n):
            block = int(rng.integers(blocks)) if rng.random() < 0.04 else block
            seq.append(None if rng.random() < 0.01 else block * 4 + int(rng.integers(4)))
        out.append(seq)
    return out


def test_recursive_partition_against_a_plain_one(spark):
    """Each level by the same small steps on counts made anew from the whole sequences, with the measure of the whole matrix."""
    recs, lag, height = walks(5, 4), 2, 0.3
    seq = spark.createDataFrame([(r, t, x) for r, s in enumerate(recs) for t, x in enumerate(s)], "rec long, t long, label int")
    got = partition.recursive_partition(seq, lag, 4, height).toPandas()
    whole = np.zeros((16, 16))
    for s in recs:
        for a, b in zip(s, s[lag:]):
            if a is not None and b is not None:
                whole[a, b] += 1
    pi = kn.stationary(whole / whole.sum(axis=1, keepdims=True))
    part = {i: 0 for i in range(16)}
    for level in range(1, 4):
        splits = {}
        for g in sorted({p for p in part.values() if p is not None}):
            n = np.zeros((16, 16))
            for s in recs:
                for t in range(len(s) - lag):
                    if all(x is not None and part[x] == g for x in s[t : t + lag + 1]):
                        n[s[t], s[t + lag]] += 1
            cells = pd.DataFrame([(i, j, n[i, j]) for i, j in zip(*np.nonzero(n))], columns=["src", "dst", "n"])
            if not len(cells):
                continue
            states, p = kn.dense(cells)
            if len(states) < 4:
                continue
            own, _, phi = kn.spectrum(p, 2)
            at, rho = kn.best_threshold(p, own, phi[:, 1])
            side = phi[:, 1] < at
            if rho >= height and side.any() and not side.all():
                splits[g] = dict(zip(states.tolist(), side.astype(int).tolist()))
        if not splits:
            break
        g = max(splits, key=lambda x: (round(sum(pi[i] for i in part if part[i] == x), 12), -x))
        part = {i: None if p is None or (p == g and i not in splits[g]) else level - 1 + splits[g][i] if p == g else p - (p > g) for i, p in part.items()}
        held = got[got.level == level].set_index("state").part
        assert {i: None if np.isnan(held[i]) else int(held[i]) for i in part} == part
    assert got.level.max() == 3


@pytest.mark.parametrize("lag", [1, 2])
def test_recursive_partition_reads_its_sequence_once(spark, lag):
    recs = walks(5, 4)
    seq = spark.createDataFrame([(r, t, x) for r, s in enumerate(recs) for t, x in enumerate(s)], "rec long, t long, label int")
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    partition.recursive_partition(seq.mapInPandas(counting, "rec long, t long, label int"), lag, 4, 0.3).collect()
    assert read.value == sum(map(len, recs))


def test_neighbours_inside_parts_are_those_of_the_rows(spark):
    """Parts, states in none, missing symbols and numbers: the counts of neighbours give what the rows give."""
    rows = [(r, t, x) for r, s in enumerate(walks(6, 4)) for t, x in enumerate(s) if t % 97]
    seq = spark.createDataFrame(rows, "rec long, t long, label int")
    parts = spark.createDataFrame([(s, None if s in (3, 9) else s // 6) for s in range(16)], "state int, part int")
    got, want = (sorted(map(tuple, x.collect())) for x in (partition.neighbours_within(partition.neighbours(seq), parts).groupBy("part", "src", "dst").agg(F.sum("n")), partition.counts_within(seq, parts, 1)))
    assert got == want and {x[0] for x in got} == {0, 1, 2}


def test_bootstrap_timescales_against_numpy(run, events):
    """Pieces of 20 rows, drawn by the same splitting, their counts summed; quantiles of the decay times."""
    from sequora.operators.resampling import split_draws

    pieces = {}
    for rec, e in events.groupby("rec"):
        x = e.sort_values("t").label.to_numpy()
        for c in range(int(np.ceil((len(x) - 20) / 20))):
            pieces[rec, c] = counted([x[20 * c : 20 * c + 20]], 1, 5)
    names = sorted(pieces)
    times = split_draws(np.arange(len(names)), len(names), 20)
    found = []
    for r in range(20):
        _, _, R = reversible(sum(times[i, r] * pieces[n] for i, n in enumerate(names)))
        v = np.sort(np.linalg.eigvals(R).real)[::-1][1:4]
        found.append([-1 / np.log(x) if x > 1e-12 else np.nan for x in v] + [np.nan] * (3 - len(v)))
    got = run("bootstrap_timescales").set_index("mode")
    for mode in got.index:
        want = np.nanpercentile([f[mode - 1] for f in found], [2.5, 50, 97.5])
        assert got.loc[mode, ["low", "median", "high"]].to_numpy(float) == pytest.approx(want, rel=1e-4)


def test_partition_queries(run):
    levels = run("recursive_partition")
    assert (levels.groupby("level").state.nunique() == levels.state.nunique()).all()
    sizes = levels.groupby("level").part.nunique()
    assert all(n == level + 1 for level, n in sizes.items())
    assert set(run("coherent_split").part) <= {0, 1}
    z = run("recentred_modes").dropna()
    assert len(z) and (z.groupby(["lag", "mode"]).z.max() > 0).all() and (z.groupby(["lag", "mode"]).z.min() <= 0).all()
    coarse = run("coarse_grain_kmeans")
    assert 2 <= len(coarse) <= 4 and coarse.states.sum() == z[(z.lag == 1) & (z["mode"] == 1)].state.nunique()
    fit = run("asymptote_fit")
    assert set(fit["mode"]) <= {1, 2, 3} and (fit.level > 0).all()


def unit():
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    return e, np.vstack(e.embedding.to_numpy()).astype(float)


def test_principal_axes(run, events):
    e, x = unit()
    centred = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(x))
    values, axes = values[::-1], axes[:, ::-1]
    got = run("pca_embed").sort_values("vec_id")
    assert (got.dims == int(np.argmax(np.cumsum(values) / values.sum() > 0.99))).all()
    z = np.vstack(got.z.to_numpy())
    assert np.allclose(np.abs(z), np.abs(centred @ axes[:, : z.shape[1]]), atol=1e-4)
    white = np.vstack(run("whiten").sort_values("vec_id").z.to_numpy())
    assert np.allclose(np.abs(white), np.abs(centred @ axes[:, :3] / np.sqrt(values[:3] + 1e-5)), atol=1e-3)
    delay = [g.value.to_numpy()[i : i + 5] for _, g in events.groupby("rec") for i in range(len(g) - 5)]
    u, s, v = np.linalg.svd(np.array(delay), full_matrices=False)
    got = run("svd_embed").sort_values(["rec", "centre"])
    assert np.allclose(np.abs(np.vstack(got.z.to_numpy())), np.abs(u[:, :2]), atol=1e-5)
    modes = run("svd_modes")
    assert np.allclose(modes.drop_duplicates("mode").sort_values("mode").singular, s[:3], rtol=1e-4)
    assert np.allclose(np.abs(modes[modes["mode"] == 0].sort_values("entry").axis), np.abs(v[0]), atol=1e-4)
    d = np.cov(np.array(delay).T, bias=True)
    w = np.linalg.eigvalsh(d)
    assert (run("pca_embed_participation").dims == min(5, 2 * int(np.ceil(w.sum() ** 2 / (w**2).sum())))).all()


def test_kmeans_assigns_to_the_nearest_mean(run):
    e, x = unit()
    label = run("kmeans_labels").sort_values("vec_id").cluster.to_numpy()
    means = np.array([x[label == i].mean(axis=0) for i in range(label.max() + 1)])
    near = ((x[:, None, :] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert label.max() == 9 and (near == label).mean() > 0.95


def test_classifier(run, spark):
    got = run("logreg_cv")
    e, _ = unit()
    assert got.n.sum() == (e.vec_id % 5 == 0).sum() and got.c.nunique() == 1 and (got.right <= got.n).all()
    rng = np.random.default_rng(1)
    rows = [(i, i % 3 if i % 9 else 0, [float(v) for v in rng.normal(0, 0.3, 2) + [i % 3, (i % 3 == 1) * 2]], i % 5 != 0) for i in range(180)]
    held = ml.vectors(spark.createDataFrame(rows, "id long, label int, x array<double>, train boolean"), "x")
    both = run("logreg_accuracy").set_index("train").accuracy
    assert 0 <= both[False] <= 1 and both[True] > both[False]
    c, out = ml.grid_searched_logistic(held, "label", "id", grid=(1e-6, 1.0), folds=2)
    right = out.where("not train").selectExpr("avg(cast(label = predicted as int)) as a").first().a
    assert c in (1e-6, 1.0) and right > 0.75


def test_stacked_models_choose_as_separate_fits(spark):
    """Every fold and C against Newton's method on its own rows."""
    rng = np.random.default_rng(8)
    n, k, folds, grid = 240, 3, 3, (0.05, 0.5, 5.0)
    y = rng.integers(0, k, n) * (rng.random(n) < 0.8)
    x = np.round(rng.normal(size=(n, 3)) + np.eye(3)[y] * 1.2, 6)
    fold = rng.integers(0, folds, n)
    rows = ml.vectors(spark.createDataFrame([(x[i].tolist(), int(y[i]), int(fold[i])) for i in range(n)], "x array<double>, label int, fold int").repartition(3), "x")
    model = ml.Stacked(rows, "label", "fold", folds, grid)
    w = model.fit(rounds=400, tolerance=1e-7)
    scores = model.scores(w)
    xs = np.c_[x, np.ones(n)]
    for (f, c), got in zip(model.models, w):
        mine = fold != f
        a, b = xs[mine], y[mine]
        weight = (len(b) / (k * np.bincount(b, minlength=k)))[b]
        want, ridge = np.zeros((4, k)), 1 / (c * len(b))
        for _ in range(50):
            z = a @ want
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            g = a.T @ ((q - np.eye(k)[b]) * weight[:, None]) / len(b) + ridge * np.r_[np.ones(3), 0][:, None] * want
            h = np.einsum("ni,nj,nk,nkl->ikjl", a, a * weight[:, None], np.ones_like(q), np.einsum("nk,kl->nkl", q, np.eye(k)) - q[:, :, None] * q[:, None, :]) / len(b)
            h = h.reshape(4 * k, 4 * k) + np.kron(np.diag(np.r_[np.ones(3), 0]) * ridge, np.eye(k)) + 1e-9 * np.eye(4 * k)
            want -= np.linalg.solve(h, g.ravel()).reshape(4, k)
        centred = lambda v: v - v.mean(axis=1, keepdims=True)
        assert np.abs(centred(got) - centred(want)).max() < 1e-3
        assert scores[f, c] == pytest.approx(((xs[~mine] @ want).argmax(axis=1) == y[~mine]).mean(), abs=1e-9)


def test_medoids_of_two_thousand_vectors(spark):
    rng = np.random.default_rng(2)
    n, k = 2000, 4
    x = np.round(rng.normal(size=(n, 2)) + rng.integers(0, 2, (n, 2)) * 6, 4)
    points = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, v array<double>").repartition(4)
    got = {r.cluster: r for r in ml.kmedoids(points, "id", k, 20, 0.0).collect()}
    medoids = list(range(k))
    for _ in range(20):
        d = np.round(np.abs(x[:, None, :] - x[medoids][None, :, :]).max(axis=2), 9)
        label = d.argmin(axis=1)
        new = []
        for c in range(k):
            inside = np.flatnonzero(label == c)
            cost = np.round(np.round(np.abs(x[inside][:, None, :] - x[inside][None, :, :]).max(axis=2), 9).sum(axis=1), 6)
            new.append(int(inside[cost.argmin()]))
        if new == medoids:
            break
        medoids = new
    assert [got[c].medoid for c in range(k)] == medoids
    assert [got[c].n for c in range(k)] == np.bincount(label, minlength=k).tolist()
    assert got[0].mean_reach == pytest.approx(np.mean([d[label == c, c].max() for c in range(k)]))
    held = spark.createDataFrame([(int(label[i]), i, x[i].tolist()) for i in range(n)], "cluster int, id long, v array<double>").cache()
    best, looked = ml.medoids_of(held, "id", ml.chebyshev)
    assert [best[c][1] for c in range(k)] == medoids and looked < sum(np.bincount(label) ** 2) / 2  # of all pairs inside clusters


def test_medoids_without_a_centre_take_few_jobs_and_exact_sums(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(600, 64)) / 8, 6)
    x[300:310] = x[0]  # equal vectors: the smallest id
    x[310:320, :] = 0.0
    rows = [(i % 2, 1000 - i, x[i].tolist()) for i in range(600)]
    held = spark.createDataFrame(rows, "cluster int, id long, v array<double>").repartition(24).cache()
    held.count()
    want, whole = {}, {}
    for c in (0, 1):
        cost = np.round(np.round(np.abs(x[c::2, None] - x[None, c::2]).max(axis=2), 9).sum(axis=1), 6)
        whole[c] = cost
        want[c] = min((float(s), 1000 - i) for s, i in zip(cost, range(c, 600, 2)))
    monkeypatch.setattr(ml, "MOST_TRIED", 256)
    monkeypatch.setattr(ml, "MOST_EXACT", 2, raising=False)
    spark.sparkContext.setJobGroup("medoids", "")
    best, _ = ml.medoids_of(held, "id", ml.chebyshev)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("medoids"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert best == want and jobs < 70  # tasks run side by side: not a job for each of the 24 parts
    low, step = x.min(axis=0), (x.max(axis=0) - x.min(axis=0)).max() / ml.STEPS
    rough = ml._rough_sums(held, {0: x[0::2], 1: x[1::2]}, low, step)
    assert all(np.abs(rough[c] - whole[c]).max() <= 300 * (step + 1e-9) + 1e-6 for c in (0, 1))


def test_embedding_keeps_shifted_distances():
    rng = np.random.default_rng(5)
    d = rng.random((9, 9)) + 1
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    z = pairs.shifted_embedding(d, 9)
    gap = ((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2)
    off = ~np.eye(9, dtype=bool)
    assert np.ptp((gap - d)[off]) < 1e-9


def test_embeddings_of_recordings(run):
    inside, placed = run("cse_embed"), run("cse_project")
    assert inside.rec.is_unique and placed.rec.is_unique
    both = inside.merge(placed, on=["grp", "rec"], suffixes=("", "_p"))
    assert len(both) == len(inside)
    for _, g in both.groupby("grp"):  # a landmark's place among the landmarks is its own, but for the shift
        if 5 < len(g) <= LANDMARKS:
            assert np.corrcoef(g.x, g.x_p)[0, 1] > 0.99


def test_fuzzy_splits():
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 0.05, 12), rng.normal(5, 0.05, 12), rng.normal(9, 0.05, 12)]
    d = np.abs(x[:, None] - x[None, :])
    levels = pairs.fuzzy_splits(d, np.full(len(x), 1.0), 3)
    hard, resp = levels[-1]
    assert len(levels) == 2 and [len({*hard[i : i + 12]}) for i in (0, 12, 24)] == [1, 1, 1] and len({*hard}) == 3
    assert all(np.allclose(r.sum(axis=1), 1) for _, r in levels) and (resp.argmax(axis=1) == hard).mean() > 0.9
    centres, u = pairs.fuzzy_halves(np.array([0.0, 0.1, 0.9, 1.0]))
    assert centres == pytest.approx([0.05, 0.95], abs=0.02) and np.allclose(u.sum(axis=1), 1)


@pytest.mark.parametrize("most", [48, 7])
def test_splits_reach_all_recordings(spark, most):
    """With landmarks for all, the whole matrix's splits; with fewer, those of the landmarks, extended by the plain formula."""
    rng = np.random.default_rng(3)
    rows = [(int(100 * g + i), g, [float(v) for v in rng.random(4) + (i % 3) * (g + 1)]) for g, n in enumerate((24, 30, 2, 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "rec long, grp int, row array<double>").repartition(3)
    marks = pairs.landmarks(table, "grp", most).cache()
    cells = pairs.to_landmarks(table, marks, "grp", 2).cache()
    among = cells.join(marks.select("grp", "rec"), ["grp", "rec"], "left_semi").cache()
    got = pairs.extended_splits(cells, among, pairs.split_tree(among, "grp", 4).cache(), "grp").toPandas()
    assert len(got[got.level == 0]) == len(rows)
    for g in range(4):
        mine = sorted((r[0], np.array(r[2])) for r in rows if r[1] == g)
        ids, x = [r[0] for r in mine], np.array([r[1] for r in mine])
        marked = sorted(r.rec for r in marks.where(f"grp = {g}").collect())
        at = [ids.index(m) for m in marked]
        d = np.abs(x[:, None] - x[None, :]).sum(axis=2) / 2
        near = d[np.ix_(at, at)]
        eps = np.maximum(near.sum(axis=1) / max(1, len(at) - 1), 1e-12)
        tree = pairs.Splits(near, eps, 4)
        part = got[got.grp == g]
        assert part.level.max() == len(tree.levels) == (3 if g < 2 else 0)
        levels = pairs.fuzzy_splits(near, eps, 4)
        for level, (hard, resp) in enumerate(levels, 1):
            held = part[part.level == level].set_index("rec")
            assert list(held.hard.loc[marked]) == list(hard)
            assert np.allclose(np.stack(held.shares.loc[marked]), resp, atol=1e-6)
            assert len(held) == len(ids) and np.allclose(np.stack(held.shares).sum(axis=1), 1)
        if levels:  # the first level of all recordings
            wide = np.array([d[i, at].sum() / (len(at) - (i in at)) for i in range(len(ids))])
            k = np.exp(-d[:, at] / np.sqrt(wide[:, None] * eps[None, :]))
            _, v, value = tree.nodes[0]
            u = pairs.membership(k @ v / value / k.sum(axis=1), tree.levels[0][2])
            assert np.allclose(np.stack(part[part.level == 1].set_index("rec").shares.loc[ids]), u, atol=1e-6)


def test_groups_and_posteriors(run):
    h = run("hfss_groups")
    assert np.allclose(h.groupby(["grp", "level", "rec"]).share.sum(), 1, atol=1e-4) and (h.groupby(["grp", "level", "rec"]).own.sum() == 1).all()
    p = run("posterior_by_condition")
    assert np.allclose(p.groupby("grp")["mean"].sum(), 1, atol=1e-4) and (p.low <= p.high).all()
    last = h[h.level == h.groupby("grp")["level"].transform("max")]
    assert np.allclose(last.groupby(["grp", "part"]).share.mean().to_numpy(), p.sort_values(["grp", "part"])["mean"], atol=1e-5)


def test_entropy_sweep(run, spark, events):
    """Cells against a plain computation on the same sampled rows."""
    from sequora.operators.resampling import window_sample
    from sequora.sources.bindings import group_of

    got = run("entropy_sweep_cells")
    assert len(got) == 8 and set(got.seed) == {0, 1}
    both = F.array(F.col("value") / 490, F.col("k") / 100)
    seq = event_sequence(spark, SF).select("rec", "t", both.alias("value")).withColumn("grp", group_of())
    rows = window_sample(seq, "grp", 100, 1).toPandas().sort_values(["grp", "place"])
    segments, part = [], []
    for v in [*rows.value, None]:
        if v is None:
            segments, part = segments + [part], []
        else:
            part.append(list(v))
    windows = [[s[i] + s[i + 1] for i in range(len(s) - 2)] for s in segments]
    x = np.array([w for s in windows for w in s])
    label = iter(plain_minibatch(x, 3, 10, 1))
    p = counted([[next(label) for _ in s] for s in windows], 1, 3)
    p = p / p.sum(axis=1, keepdims=True)
    pi = np.linalg.matrix_power(p, 500)[0]
    want = -sum(pi[i] * p[i, j] * np.log(p[i, j]) for i in range(3) for j in range(3) if p[i, j])
    assert got.query("seed == 1 and delay == 2 and clusters == 3").h.iloc[0] == pytest.approx(want, abs=1e-5)


def plain_minibatch(x, k, rounds, seed):
    """One row after the other inside a batch, whose labels are those before it."""
    order = sorted(range(len(x)), key=lambda i: tuple(x[i]))
    centres = [x[order[int((j + 0.5) * len(x) / k)]].copy() for j in range(k)]
    given, rng = [0] * k, np.random.default_rng(seed)
    nearest = lambda v: min(range(k), key=lambda j: ((v - centres[j]) ** 2).sum())
    for _ in range(rounds):
        turn = rng.permutation(len(x))
        for lo in range(0, len(x), 5 * k):
            batch = [(x[i], nearest(x[i])) for i in turn[lo : lo + 5 * k]]
            for v, j in batch:
                given[j] += 1
                centres[j] += (v - centres[j]) / given[j]
    return [nearest(v) for v in x]


def test_lloyd_from_a_fixed_start():
    x = np.r_[np.zeros((5, 2)), np.ones((5, 2)), np.full((5, 2), 4.0)]
    assert len({*partition.clustered(x, 3, 5)[:5]}) == 1 and len({*partition.clustered(x, 3, 5)}) == 3


def test_sweep_parameters():
    got = SweepParameters.from_args("--seeds 3 4 --rows 50 --least-rows 10".split())
    assert got == SweepParameters(seeds=(3, 4), rows=50, least_rows=10)


def test_paths_of_simulations(run, events):
    first = run("sim_paths").sort_values(["rec", "t"]).groupby("rec").first()
    assert len(first) == events.rec.nunique() and (first[["x", "y"]] == 0).all().all()
    inside = run("reflective_trajectory")
    assert len(inside) == len(events) and inside[["x", "y"]].abs().max().max() <= 10


def test_double_centring_and_distances_use_every_recording(run, events):
    d = run("double_centering")
    assert set(d.b) == set(events.rec) and set(d.a) == set(events.rec) and len(d) == events.rec.nunique() ** 2
    whole = d.pivot(index="a", columns="b", values="c").to_numpy()
    assert np.allclose(whole, whole.T) and np.abs(whole.sum(axis=0)).max() < 1e-4


def test_diffusion_kernel_of_every_recording(run, events):
    k = run("diffusion_kernel")
    whole = k.pivot(index="a", columns="b", values="k")
    assert set(whole.index) == set(events.rec) == set(whole.columns) and len(k) == events.rec.nunique() ** 2
    assert np.allclose(whole.sum(axis=1), 1, atol=1e-4)


def test_distances_in_blocks_and_their_sums(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sequora.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 2)
    monkeypatch.setattr(pairs, "ROWS", 7)
    x = np.random.default_rng(0).integers(0, 4, (50, 4)) / 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rec long, row array<double>")
    want = np.abs(x[::10, None] - x[None]).sum(axis=2) / 2
    at = spark.createDataFrame([(0, 7.0), (20, 8.0)], "a long, w double")
    some = pairs.distances(rows, 2, 10, at)
    assert {(r.a, r.b): (r.d, r.w) for r in some.collect()} == {(a, b): (pytest.approx(want[a // 10, b]), 7.0 + a / 20) for a in (0, 20) for b in range(50)}
    assert "Exchange RoundRobinPartitioning(8)" in some._jdf.queryExecution().toString()
    sums = pairs.distance_sums(rows, 2, 10).orderBy("rec").toPandas()
    assert np.allclose(sums.to_asked, want.sum(axis=0)) and np.allclose(sums.to_all[sums.asked], want.sum(axis=1)) and set(sums.n_all) == {50} and set(sums.n_asked) == {5}
    v = spark.createDataFrame([(0.1234565,), (-0.1234565,), (1.0000004999,), (-0.0000001,), (float("nan"),), (2.5,)], "x double")
    assert v.where(~pairs.rounded(F.col("x")).eqNullSafe(F.round("x", 6) + F.lit(0.0))).count() == 0


def test_nearest_of_every_recording_in_tiles(spark, run, events, monkeypatch):
    from sequora.operators import pairs

    assert set(run("nn_ratio").a) == set(events.rec)
    monkeypatch.setattr(pairs, "MINE", 4)
    monkeypatch.setattr(pairs, "MET", 6)
    monkeypatch.setattr(pairs, "HELD", 2)
    x = np.random.default_rng(1).integers(0, 5, (50, 4)) / 4
    rows = spark.createDataFrame([(3 * i, v.tolist(), float(i)) for i, v in enumerate(x)], "rec long, row array<double>, w double")
    want = np.abs(x[:, None] - x[None]).sum(axis=2) / 2

    def make(d, a, b):
        assert d.shape == (len(a["rec"]), len(b["rec"]))
        return np.where(a["rec"][:, None] == b["rec"], np.inf, d).min(axis=1), d.max(axis=1), (d * a["w"][:, None] * b["w"]).sum(axis=1)

    got = pairs.over_all(rows, 2, make, {"near": "min", "far": "max", "sums": "sum"}).orderBy("a").toPandas()
    assert got.a.tolist() == [3 * i for i in range(50)]
    w = np.arange(50.0)
    assert np.allclose(got.near, (want + np.diag(np.full(50, np.inf))).min(axis=1)) and np.allclose(got.far, want.max(axis=1)) and np.allclose(got.sums, w * (want @ w))


def test_lags_with_breaks(spark):
    seq = spark.createDataFrame([(1, t, float(v), b) for t, (v, b) in enumerate([(1, False), (2, False), (4, True), (8, False), (16, False)])], "rec long, t long, x double, b boolean")
    rows = motion.lagged(seq, ["x"], [1, -1], "b").collect()
    assert sorted((r.lag, r.t) for r in rows) == [(-1, 1), (-1, 3), (-1, 4), (1, 0), (1, 2), (1, 3)]


def test_numbering_by_ranges(spark):
    from sequora.operators.resampling import ranked

    got = ranked(spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as x", "id"), ["x"]).collect()
    assert all(r.i == r.x for r in got) and len(got) == 5000


def test_medoids(spark):
    x = [(i, [float(i % 3 * 10) + i / 1000, 0.0]) for i in range(60)]
    got = ml.kmedoids(spark.createDataFrame(x, "vec_id long, v array<double>"), "vec_id", 3, 2).collect()
    assert sorted(r.n for r in got) == [20, 20, 20] and all(r.reach < 0.06 for r in got)
