"""Recursive coherent partitions of state spaces, and entropy sweeps over grids of embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.config import SweepParameters
from sequora.operators import kernels as kn, markov, sequences as sq
from sequora.operators.blocks import here, in_blocks, so_far
from sequora.operators.resampling import window_sample
from sequora.sources.storage import cut


def neighbours(seq: DataFrame) -> DataFrame:
    """(src, dst, near, n): how often a row of state ``src`` has ``dst`` in the row after it (null where that is missing); near: whether that row has the next number, too."""
    later = F.lead(F.struct("t", "label")).over(here())
    rows = in_blocks(seq.select("rec", "t", "label"), ahead=1).withColumn("later", later).where("_own and label is not null")
    return rows.groupBy(F.col("label").alias("src"), F.col("later.label").alias("dst"), F.coalesce(F.col("later.t") == F.col("t") + 1, F.lit(False)).alias("near")).agg(F.count(F.lit(1)).alias("n"))


def neighbours_within(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, src, dst, n): of the pairs of neighbours, those inside a part. Nothing lies between two neighbours, so their states say whether the part is left."""
    held = parts.where("part is not null")
    src, dst = (held.select(F.col("state").alias(x), F.col("part").alias(y)) for x, y in (("src", "part"), ("dst", "to_part")))
    return pairs.where("near").join(F.broadcast(src), "src").join(F.broadcast(dst), "dst").where("part = to_part").select("part", "src", "dst", "n")  # a row a state


def counts_within(seq: DataFrame, parts: DataFrame, lag: int) -> DataFrame:
    """(part, src, dst, n): transitions between the rows of each part.

    Only rows of the given parts are looked at: of two rows ``lag`` apart in place and in number, all between are there, too; a change of part is a gap.
    """
    held = seq.select("rec", "t", "label").join(F.broadcast(parts.where("part is not null").withColumnRenamed("state", "label")), "label")  # a row a state
    by = here()
    moved = (~F.col("part").eqNullSafe(F.lag("part").over(by))).cast("int")
    runs = in_blocks(held, ahead=lag).withColumn("moved", moved).withColumn("stay", F.sum("moved").over(so_far()))
    later = F.lead(F.struct("t", "label", "stay"), lag).over(by)
    pairs = runs.select("_own", "part", "t", F.col("label").alias("src"), "stay", later.alias("later")).where(F.col("_own") & (F.col("later.t") == F.col("t") + lag) & (F.col("later.stay") == F.col("stay"))).select("part", "src", F.col("later.label").alias("dst"))
    return pairs.groupBy("part", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def split_parts(counts: DataFrame, height: float) -> DataFrame:
    """(part, state, side): each part's best coherent split along the slowest mode of its own transitions (part, src, dst, n).

    A part is one small task. States outside the part's largest connected set, and all states of a part without a threshold of some height, have no row.
    """

    def kernel(key: dict, states: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"part": [], "state": [], "side": []}, dtype="int32")
        if len(states) < 4:
            return out
        pi, _, phi = kn.spectrum(p, 2)
        at, rho = kn.best_threshold(p, pi, phi[:, 1])
        side = (phi[:, 1] < at).astype(int)
        if rho < height or side.all() or not side.any():
            return out
        return pd.DataFrame({"part": key["part"], "state": states, "side": side}).astype("int32")

    return kn.per_matrix(counts, ["part"], "part int, state int, side int", kernel)


def subdivided(parts: DataFrame, split: DataFrame, part: int) -> DataFrame:
    """(state, part): one part replaced by the two sides of its split, which get the last numbers; numbers stay dense, states left behind by the split are missing."""
    last = parts.agg(F.max("part").alias("last"))
    sides = split.where(F.col("part") == part).select("state", "side")
    held = parts.join(F.broadcast(sides), "state", "left").join(F.broadcast(last))
    return held.select("state", F.when(F.col("part") == part, F.col("last") + F.col("side")).otherwise(F.col("part") - (F.col("part") > part).cast("int")).alias("part"))


def recursive_partition(seq: DataFrame, lag: int, n_final: int, height: float = 0.5) -> DataFrame:
    """(level, state, part): the part with the largest measure is split again and again, until there are ``n_final`` or none can be split.

    The measure is the stationary one of the whole matrix. Splits of parts are kept from level to level: only the two new parts are counted anew. A heaviest
    part that has no split gives way to the next one. The sequence is read once: with a lag of 1 the counts of neighbours serve all levels, else its rows are stored and
    those of new parts looked at again.
    """
    if lag == 1:
        pairs = cut(neighbours(seq), "neighbours")
        counts = pairs.where("dst is not null").groupBy("src", "dst").agg(F.sum("n").alias("n"))
        labels, within = pairs.select(F.col("src").alias("label")), lambda parts: neighbours_within(pairs, parts)
    else:
        rows = cut(seq.select("rec", "t", "label"), "rows")
        counts = sq.transition_counts(rows, lag)
        labels, within = rows.where("label is not null").select("label"), lambda parts: counts_within(rows, parts, lag)
    pi = cut(markov.stationary(markov.row_normalised(counts)), "measure")
    parts = cut(labels.select(F.col("label").cast("int").alias("state")).distinct().select("state", F.lit(0).alias("part")), "parts")
    splits = cut(split_parts(within(parts), height), "splits")
    out = parts.select(F.lit(0).alias("level"), "state", "part")
    for level in range(1, n_final):
        able = splits.select("part").distinct()
        heavy = parts.join(pi, "state").groupBy("part").agg(F.sum("pi").alias("w")).join(able, "part").orderBy(F.desc(F.round("w", 12)), "part").first()
        if heavy is None:
            break
        parts = cut(subdivided(parts, splits, heavy.part), "parts")
        new = split_parts(within(parts.where(F.col("part") >= level - 1)), height)
        old = splits.where(F.col("part") != heavy.part).withColumn("part", F.col("part") - (F.col("part") > heavy.part).cast("int"))
        splits = cut(old.unionByName(new), "splits")
        out = out.unionByName(parts.select(F.lit(level).alias("level"), "state", "part"))
    return out


def clustered(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """Labels by mini-batch k-means: ``rounds`` passes over seeded batches of 5 k rows, from a fixed start (evenly spaced rows in the order of their entries).

    A batch moves each centre to the mean of all rows it was given so far; the labels are those of the last centres.
    """
    order = np.lexsort(x.T[::-1])
    centres = x[order[((np.arange(k) + 0.5) * len(x) / k).astype(int)]].astype(float)
    given, rng, size = np.zeros(k), np.random.default_rng(seed), 5 * k
    nearest = lambda rows: ((rows[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(rounds):
        turn = rng.permutation(len(x))
        for lo in range(0, len(x), size):
            batch = x[turn[lo : lo + size]]
            label = nearest(batch)
            n = np.bincount(label, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, label, batch)
            given += n
            met = n > 0
            centres[met] += (sums[met] - n[met, None] * centres[met]) / given[met, None]
    return np.concatenate([nearest(x[lo : lo + 4096]) for lo in range(0, len(x), 4096)])


def cell_entropy(values: np.ndarray, delay: int, k: int, rounds: int, least_rows: int, seed: int = 0) -> float:
    """Entropy rate of one cell: delay vectors of rows of vectors with gaps (a row with a missing entry is one), clustered, transitions between neighbours; NaN below some number of rows."""
    values = values.reshape(len(values), -1)
    there = ~np.isnan(values).any(axis=1)
    if there.sum() <= least_rows:
        return np.nan
    whole = np.convolve(there, np.ones(delay + 1, int), "valid") == delay + 1  # the last window of a segment is left out
    at = np.flatnonzero(whole)
    if len(at) < k:
        return np.nan
    x = values[at[:, None] + np.arange(delay)].reshape(len(at), -1)
    label = clustered(x, k, rounds, seed)
    near = np.flatnonzero(np.diff(at) == 1)
    if not len(near):
        return np.nan
    cells = pd.DataFrame({"src": label[near], "dst": label[near + 1]}).value_counts().rename("n").reset_index()
    _, p = kn.dense(cells)
    pi = kn.stationary(p)
    return float(-(pi[:, None] * np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0)).sum())


def entropy_sweep(seq: DataFrame, key: str, sweep: SweepParameters, value: str = "value") -> DataFrame:
    """(seed, delay, clusters, h): each seed samples a run of rows of each group; its cells share the sample. ``value`` is a number or an array of numbers per row."""
    grid = F.array(*[F.struct(F.lit(d).alias("delay"), F.lit(k).alias("clusters")) for d in sweep.delays for k in sweep.clusters])
    vector = F.col(value) if seq.schema[value].dataType.typeName() == "array" else F.array(value)
    seq = seq.withColumn("_v", vector.cast("array<double>"))
    samples = None
    for seed in sweep.seeds:
        part = window_sample(seq, key, sweep.rows, seed).select(F.lit(seed).alias("seed"), key, "place", F.col("_v").alias("value"))
        samples = part if samples is None else samples.unionByName(part)
    cells = samples.select("*", F.explode(grid).alias("g")).select("seed", "g.delay", "g.clusters", key, "place", "value")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = [None if v is None else np.array([np.nan if x is None else x for x in v], float) for v in rows.sort_values([key, "place"]).value]
        width = max((len(v) for v in held if v is not None), default=1)
        values = np.array([np.full(width, np.nan) if v is None or len(v) != width else v for v in held])
        seed, delay, k = (int(rows[c].iloc[0]) for c in ("seed", "delay", "clusters"))
        return pd.DataFrame({"seed": [seed], "delay": [delay], "clusters": [k], "h": [cell_entropy(values, delay, k, sweep.rounds, sweep.least_rows, seed)]})

    out = cells.groupBy("seed", "delay", "clusters").applyInPandas(run, "seed int, delay int, clusters int, h double")
    return out.withColumn("h", F.when(~F.isnan("h"), F.col("h")))
