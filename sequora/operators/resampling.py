"""Resampling with portable draws: what decides them are hashes, the same in any engine.

A replicate of a linear statistic needs how often each entity was drawn, never its rows again, and not the draws either: a table of multiplicities
joins per-entity sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from math import lgamma, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.sources.formats import numbered, placed
from sequora.sources.storage import cut


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    said = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def poisson(u: Column, steps: tuple[float, ...]) -> Column:
    """How often a row counts in a replicate: the number of steps of the distribution function that a uniform number is not below."""
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, p: n + F.when(u >= p, 1).otherwise(0))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``i``: the place of each row in the order of its keys, numbered range by range, never in one task."""
    return numbered(rows, keys, "i")


#: Draws of a node up to which its distribution function is summed from 0; beyond, only where it isn't 0 or 1 to all digits.
SHORT = 4096


@lru_cache(maxsize=4096)
def _distribution(n: int, left: int, size: int) -> tuple[int, np.ndarray]:
    """(first k, distribution function from there on) of how many of n draws fall into ``left`` of ``size`` places."""
    p = left / size
    wide = 0 if n <= SHORT else int(40 * sqrt(n * p * (1 - p))) + 50
    low, high = (0, n) if not wide else (max(0, int(n * p) - wide), min(n, int(n * p) + wide))
    logs = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p) for k in range(low, high + 1)]
    return low, np.cumsum(np.exp(logs))


def _hashes(reps: int, level: int, at: int, salt: str) -> np.ndarray:
    """``uniform`` of (replicate, level, node and what else tells draws apart), for all replicates."""
    return np.array([int(md5(f"{r}:{level}:{at}{salt}".encode()).hexdigest()[:8], 16) for r in range(reps)]) / 4294967296.0


def split_draws(wanted: np.ndarray, n: int, reps: int, salt: str = "") -> np.ndarray:
    """(places, replicates): how often n draws with replacement out of n places fall on each of the wanted (sorted) places.

    The draws are split over halves of the places again and again: how many of a node's draws fall into its left half is binomial, from a hash of
    (replicate, level, node). Any task gets the same numbers for a place, and looks only at the nodes above its own places.
    """
    out = np.zeros((len(wanted), reps), np.int64)
    depth = max(0, n - 1).bit_length()
    stack = [(0, 0, 0, len(wanted), np.full(reps, n, np.int64))] if len(wanted) and n else []
    while stack:
        level, at, lo, hi, count = stack.pop()
        if level == depth:
            out[lo:hi] = count
            continue
        half = 1 << (depth - level - 1)
        first = at * 2 * half
        size = min(2 * half, n - first)
        left = min(half, size)
        split = count.copy()
        if left < size:
            u = _hashes(reps, level, at, salt)
            for r in np.flatnonzero(count):
                low, f = _distribution(int(count[r]), left, size)
                split[r] = min(int(count[r]), low + int(np.searchsorted(f, u[r], "right")))
        middle = lo + int(np.searchsorted(wanted[lo:hi], first + half))
        for child, a, b, c in ((2 * at, lo, middle, split), (2 * at + 1, middle, hi, count - split)):
            if a < b and c.any():
                stack.append((level + 1, child, a, b, c))
    return out


def multiplicities(entities: DataFrame, keys: list[str], reps: int) -> DataFrame:
    """(keys, rep, times): how often each replicate drew each entity, computed where the entity is: there are no rows of draws, and none is moved."""
    held = cut(ranked(entities.select(*keys), keys), "placed")
    n = held.count()
    kinds = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.asarray(batch.column(len(keys)))
            order = np.argsort(places, kind="stable")
            times = split_draws(places[order], n, reps)
            at, rep = np.nonzero(times)
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(pa.array(order[at])) for j in range(len(keys))], pa.array(rep.astype(np.int32)), pa.array(times[at, rep])], names=[*keys, "rep", "times"])

    return held.select(*keys, "i").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "rep int", "times long"]))


def multiplicities_by(entities: DataFrame, key: str, name: str, reps: int) -> DataFrame:
    """(key, name, rep, times): draws inside each group (groups are few, their entities may be many), of as many entities as it has."""
    held = placed(entities.select(key, name), [key], [name], "i", "n")
    kinds = dict(held.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = np.asarray(batch.column(0))
            for group in np.unique(who):
                mine = np.flatnonzero(who == group)
                places, n = np.asarray(batch.column(2))[mine], int(batch.column(3)[mine[0]].as_py())
                order = np.argsort(places, kind="stable")
                times = split_draws(places[order], n, reps, f":{group}")
                at, rep = np.nonzero(times)
                rows = pa.array(mine[order[at]])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(rep.astype(np.int32)), pa.array(times[at, rep])], names=[key, name, "rep", "times"])

    return held.select(key, name, "i", "n").mapInArrow(run, f"{key} {kinds[key]}, {name} {kinds[name]}, rep int, times long")


def window_sample(seq: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """(key, place, t, label and what else the rows have): ``size`` consecutive rows of each group, its recordings end to end, from a hashed start; two missing rows on each side.

    A recording's offset in its group comes from running sums over recordings; rows only learn it by a join on the recording.
    """
    length = seq.groupBy(key, "rec").agg(F.count(F.lit(1)).alias("length"))
    order = Window.partitionBy(key).orderBy("rec")
    offset = length.select("rec", key, "length", (F.sum("length").over(order) - F.col("length")).alias("offset"), F.sum("length").over(Window.partitionBy(key)).alias("n"))
    start = F.floor(uniform(F.lit(seed), F.col(key)) * (F.col("n") - size)).cast("long")
    hit = offset.withColumn("start", start).where((F.col("offset") + F.col("length") > F.col("start")) & (F.col("offset") < F.col("start") + size))
    rows = seq.join(hit.select("rec", key, "offset", "start"), ["rec", key]).withColumn("pos", F.col("offset") + F.col("t"))
    rows = rows.where((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + size)).withColumn("place", F.col("pos") - F.col("start") + 2).drop("pos", "start", "offset")
    pads = length.select(key).distinct().select(key, F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, size + 2, size + 3)])).alias("place"))
    return rows.unionByName(pads, allowMissingColumns=True)
