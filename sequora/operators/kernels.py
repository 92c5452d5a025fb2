"""Dense linear algebra and sequential recursions: one small numpy task per key.

Each group is a state matrix (at most a few thousand states squared) or one recording's path; the group's size is bounded by the number of states
or by the length of a recording, never by the number of recordings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(states, row-stochastic matrix) on the largest strongly connected set of the counted cells."""
    states = np.union1d(cells.src, cells.dst)
    n = np.zeros((len(states), len(states)))
    np.add.at(n, (np.searchsorted(states, cells.src), np.searchsorted(states, cells.dst)), cells.n)
    reach = (n > 0) | np.eye(len(states), dtype=bool)
    while True:
        more = (reach.astype(np.int32) @ reach.astype(np.int32)) > 0
        if (more == reach).all():
            break
        reach = more
    mutual = reach & reach.T
    best = mutual[np.argmax(mutual.sum(axis=1))]
    n = n[np.ix_(best, best)]
    total = n.sum(axis=1, keepdims=True)
    return states[best], np.divide(n, total, out=np.zeros_like(n), where=total > 0)


def stationary(p: np.ndarray) -> np.ndarray:
    """The distribution with pi P = pi: one equation gives way to the sum; by least squares where that has no single solution."""
    a = p.T - np.eye(len(p))
    try:
        a[-1] = 1.0
        pi = np.linalg.solve(a, np.r_[np.zeros(len(p) - 1), 1.0])
        if not np.isfinite(pi).all() or (pi < -1e-9).any():
            raise np.linalg.LinAlgError
    except np.linalg.LinAlgError:
        a = np.vstack([p.T - np.eye(len(p)), np.ones(len(p))])
        pi = np.linalg.lstsq(a, np.r_[np.zeros(len(p)), 1.0], rcond=None)[0]
    return np.maximum(pi, 0) / np.maximum(pi, 0).sum()


def spectrum(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pi, eigenvalues descending, right eigenvectors) of the reversible part of P.

    D^1/2 R D^-1/2 is symmetric, so values are real; each vector's largest entry is positive, which fixes its sign.
    """
    pi = np.maximum(stationary(p), 1e-300)
    r = (p + (pi[None, :] * p.T) / pi[:, None]) / 2
    s = np.sqrt(pi)[:, None] * r / np.sqrt(pi)[None, :]
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    order = np.argsort(-values)[:k]
    phi = vectors[:, order] / np.sqrt(pi)[:, None]
    phi *= np.sign(phi[np.abs(phi).argmax(axis=0), np.arange(phi.shape[1])])
    return pi, values[order], phi


def timescales(p: np.ndarray, lag: float, k: int) -> np.ndarray:
    """Implied timescales of modes 1..k; NaN where a value is 1 or not above 0."""
    values = spectrum(p, k + 1)[1][1:] if len(p) > 1 else np.zeros(0)
    good = (np.abs(values - 1) > 1e-12) & (values > 1e-12)
    out = np.full(k, np.nan)
    out[: len(values)][good] = -lag / np.log(values[good])
    return out


def per_matrix(counts: DataFrame, keys: list[str], schema: str, kernel: Callable[[dict, np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """Apply a kernel (keys, states, matrix) to each keyed count matrix."""

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        states, p = dense(cells)
        return kernel({k: cells[k].iloc[0] for k in keys}, states, p)

    return counts.groupBy(*keys).applyInPandas(run, schema)


def implied_timescales(counts: DataFrame, k: int, lag: str = "lag", keys: tuple[str, ...] = ("lag",)) -> DataFrame:
    """(keys, mode, timescale) of each count matrix (keys, src, dst, n); the lag is one of the keys."""
    kinds = dict(counts.dtypes)

    def kernel(key: dict, states: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        t = timescales(p, float(key[lag]), k)
        return pd.DataFrame({**{x: [v] * k for x, v in key.items()}, "mode": np.arange(1, k + 1), "timescale": t})

    schema = ", ".join(f"{x} {kinds[x]}" for x in keys) + ", mode int, timescale double"
    return per_matrix(counts, list(keys), schema, kernel).withColumn("timescale", F.when(~F.isnan("timescale"), F.col("timescale")))


def best_threshold(p: np.ndarray, pi: np.ndarray, phi: np.ndarray) -> tuple[float, float]:
    """(threshold, coherence) of the best two-way split of phi, by running sums over ranks."""
    order = np.lexsort((np.arange(len(phi)), phi))
    rank = np.argsort(order)
    flow = pi[:, None] * p
    hi, lo = np.maximum(rank[:, None], rank[None, :]), np.minimum(rank[:, None], rank[None, :])
    low = np.cumsum(np.bincount(hi.ravel(), flow.ravel(), len(phi)))
    high = np.cumsum(np.bincount(lo.ravel(), flow.ravel(), len(phi))[::-1])[::-1]
    mass = np.cumsum(pi[order])
    rho = np.minimum(low[1:-1] / mass[1:-1], high[2:] / np.maximum(1 - mass[1:-1], 1e-300)) if len(phi) > 2 else np.zeros(0)
    if not len(rho):
        return float(np.median(phi)), 0.0
    at = int(np.argmax(rho))
    return float(phi[order][at + 1]), float(rho[at])


def recentred(states: np.ndarray, p: np.ndarray, n_modes: int, height: float) -> pd.DataFrame:
    """(state, mode, pi, z): eigenfunctions by rank, from -1 to 0 before the most coherent threshold and from 0 to 1 from there on.

    Scaled by the root of half the inverse decay rate. A mode without a threshold of some height, or without a decay rate, is null.
    """
    pi, values, phi = spectrum(p, n_modes + 1)
    rows = []
    for m in range(1, phi.shape[1]):
        order = np.lexsort((np.arange(len(states)), phi[:, m]))
        at, rho = best_threshold(p, pi, phi[:, m])
        low = int(np.argmax(phi[order, m] == at)) - 1
        z = np.full(len(states), np.nan)
        if rho >= height and low >= 0 and 1e-12 < values[m] < 1 - 1e-12:
            spread = np.r_[np.linspace(-1, 0, low), np.linspace(0, 1, len(states) - low)]
            z[order] = np.sqrt(-1 / np.log(values[m]) / 2) * spread
        rows.append(pd.DataFrame({"state": states, "mode": m, "pi": pi, "z": z}))
    return pd.concat(rows) if rows else pd.DataFrame({"state": states[:0], "mode": [], "pi": [], "z": []})


def posterior_counts(reps: DataFrame) -> DataFrame:
    """(rep, src, dst, n): a gamma draw for each count of each replicate, from one generator a replicate."""

    def draw(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["src", "dst"])
        rng = np.random.default_rng(int(hashed_uniform("gamma", int(cells.rep.iloc[0])) * 2**32))
        return cells.assign(n=rng.gamma(cells.n.to_numpy(float)))[["rep", "src", "dst", "n"]]

    return reps.groupBy("rep").applyInPandas(draw, "rep int, src int, dst int, n double")


def plateau(x: np.ndarray, tolerance: float = 1e-5) -> tuple[int | None, float]:
    """(place, level): where a curve first crosses the level to which its mean from there on has risen.

    The level begins at the 80th percentile; it becomes the slope of the running sums from the last crossing on (the mean of what
    follows), as long as that still rises by more than the tolerance. A level that the curve never crosses ends the search.
    """

    def crossing(level: float) -> int | None:
        at = np.flatnonzero(np.diff(np.sign(x - level)))
        return int(at[0]) if len(at) else None

    level = float(np.percentile(x, 80))
    place, sums = crossing(level), np.cumsum(x)
    while place is not None and len(x) - place > 1:
        risen = float(np.polyfit(np.arange(place, len(x)), sums[place:], 1)[0])
        step, level = risen - level, risen
        found = crossing(level)
        place = place if found is None else found
        if found is None or step <= tolerance:
            break
    return place, level


def plateaus(curves: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, place, level) of each curve; curves have a row per delay."""
    kinds = dict(curves.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        place, level = plateau(rows.sort_values(x)[y].to_numpy())
        return pd.DataFrame({**{k: [rows[k].iloc[0]] for k in keys}, "place": pd.array([place], "Int32"), "level": [level]})

    return curves.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", place int, level double")


def hashed_uniform(*key) -> float:
    """The same number in [0, 1) as ``resampling.uniform``."""
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:8], 16) / 4294967296.0


def chains(p: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(sim, step, state): Markov chains; ``p`` (src, dst, p) is a state matrix and travels with the tasks, ``starts`` (sim, state) is spread over them."""
    cells = p.orderBy("src", "dst").toPandas()
    rows = {int(s): (g.dst.to_numpy(), np.cumsum(g.p.to_numpy())) for s, g in cells.groupby("src")}

    def run(batches):
        for batch in batches:
            out = []
            for sim, state in zip(batch.sim, batch.state):
                out.append((sim, 0, state))
                for step in range(1, steps + 1):
                    if state not in rows:
                        break
                    dst, cdf = rows[state]
                    state = int(dst[min(len(dst) - 1, int(np.searchsorted(cdf, hashed_uniform(sim, step), "right")))])
                    out.append((sim, step, state))
            yield pd.DataFrame(out, columns=["sim", "step", "state"])

    return starts.mapInPandas(run, "sim long, step int, state int")


def reflect(path: pd.DataFrame, half: float) -> pd.DataFrame:
    """A path kept inside a square: a step over a wall is mirrored, and the heading turns with it."""
    x = y = psi = 0.0
    out = []
    for t, turn, dist in zip(path.t, path.turn, path.dist):
        nx, ny = x + dist * np.cos(psi), y + dist * np.sin(psi)
        for _ in range(8):
            if abs(nx) <= half and abs(ny) <= half:
                break
            if abs(nx) > half:
                nx, psi = np.sign(nx) * 2 * half - nx, np.pi - psi
            if abs(ny) > half:
                ny, psi = np.sign(ny) * 2 * half - ny, -psi
        x, y = float(np.clip(nx, -half, half)), float(np.clip(ny, -half, half))
        psi += turn
        out.append((t, x, y))
    return pd.DataFrame(out, columns=["t", "x", "y"])
