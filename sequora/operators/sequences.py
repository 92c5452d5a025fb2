"""Ordered sequences with gaps: segments, runs, lag pairs, chunks.

All operators take the recording key ``rec``, the place ``t`` of a row in its recording (from 0) and a symbol that is null where it is missing. They
work block by block (``blocks``), so a recording may be longer than a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.operators.blocks import here, in_blocks, owned, running, so_far


def with_segments(seq: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``seg``: number of missing rows so far. Rows between two gaps share it."""
    return running(seq, {"seg": F.col(label).isNull().cast("int")})


def gaps_inside(label: str) -> Column:
    """Number of missing rows so far inside a block and its halo: equal where no gap lies between two rows."""
    return F.sum(F.col(label).isNull().cast("int")).over(so_far())


def segments(seq: DataFrame, label: str = "label", min_size: int = 0) -> DataFrame:
    """(rec, seg, t0, tf): maximal runs without a gap, half open; only those longer than ``min_size``."""
    found = with_segments(seq, label).where(F.col(label).isNotNull()).groupBy("rec", "seg").agg(F.min("t").alias("t0"), (F.max("t") + 1).alias("tf"))
    return found.where(F.col("tf") - F.col("t0") > min_size) if min_size else found


def with_runs(seq: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``run``: number of changes of the symbol so far; a gap ends a run. Rows without a symbol go."""
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(here())) | F.lag("t").over(here()).isNull()
    held = in_blocks(seq, behind=1).withColumn("changed", changed.cast("int")).where("_own")
    return running(held, {"run": F.col("changed")}, blocked=True).drop("changed", "_own", "_block").where(F.col(label).isNotNull())


def runs(seq: DataFrame, label: str = "label") -> DataFrame:
    """(rec, label, run, t0, tf, dur): runs of one symbol; the first and last of a recording are included."""
    return with_runs(seq, label).groupBy("rec", label, "run").agg(F.min("t").alias("t0"), (F.max("t") + 1).alias("tf"), F.count(F.lit(1)).alias("dur"))


def lag_pairs(seq: DataFrame, lags: list[int], gap_aware: bool = False) -> DataFrame:
    """(rec, lag, src, dst): pairs of symbols ``lag`` rows apart, both there; gap-aware pairs do not cross a gap.

    One sort serves all lags: leads over the same window, unpivoted.
    """
    held, by = in_blocks(seq, ahead=max(lags)), here()
    if gap_aware:
        held = held.withColumn("seg", gaps_inside("label"))
    cols = [F.lead("label", lag).over(by).alias(f"d{lag}") for lag in lags]
    if gap_aware:
        cols += [F.lead("seg", lag).over(by).alias(f"s{lag}") for lag in lags]
    wide = held.select("rec", "t", "_own", F.col("label").alias("src"), *(["seg"] if gap_aware else []), *cols).where("_own")
    same = lambda lag: (F.col(f"s{lag}") == F.col("seg")) if gap_aware else F.lit(True)
    pairs = F.array(*[F.struct(F.lit(lag).alias("lag"), F.when(same(lag), F.col(f"d{lag}")).alias("dst")) for lag in lags])
    long = wide.where("src is not null").select("rec", "t", "src", F.explode(pairs).alias("p"))
    return long.select("rec", "t", "p.lag", "src", "p.dst").where("dst is not null")


def transition_counts(seq: DataFrame, lag: int = 1, gap_aware: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, dst, n): lagged transition counts, summed over recordings."""
    held = in_blocks(seq, ahead=lag)
    dst = F.lead("label", lag).over(here())
    if gap_aware:
        held = held.withColumn("seg", gaps_inside("label"))
        dst = F.when(F.lead("seg", lag).over(here()) == F.col("seg"), dst)
    pairs = held.select("_own", *keys, F.col("label").alias("src"), dst.alias("dst")).where("_own and src is not null and dst is not null")
    return pairs.groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def chunked(seq: DataFrame, size: int) -> DataFrame:
    """Adds ``chunk``: pieces of a fixed length that do not overlap. The last piece of a recording always goes."""
    chunk = F.floor(F.col("t") / size)
    last = F.max("t").over(Window.partitionBy("rec", "_block"))
    return owned(in_blocks(seq, ahead=size).withColumn("last", last).withColumn("chunk", chunk).where((F.col("chunk") + 1) * size <= F.col("last")).drop("last"))


def trajectory(seq: DataFrame, value: str, k: int, reverse: bool = False) -> DataFrame:
    """(rec, centre, vec): delay vectors of k + 1 values inside each segment; the last possible window of a segment is left out.

    Where the value is an array (a vector per row), the vectors of a window stand end to end.
    """
    held = in_blocks(seq, ahead=k + 1).withColumn("seg", gaps_inside(value))
    vec = F.array(*[F.lead(value, i).over(here()) for i in (range(k, -1, -1) if reverse else range(k + 1))])
    if seq.schema[value].dataType.typeName() == "array":
        vec = F.flatten(vec)
    whole = F.col(value).isNotNull() & (F.lead("seg", k + 1).over(here()) == F.col("seg"))
    return held.select("rec", "t", "_own", vec.alias("vec"), whole.alias("whole")).where("_own and whole").select("rec", (F.col("t") + k // 2).alias("centre"), "vec")


def trajectory_across_gaps(seq: DataFrame, value: str, k: int) -> DataFrame:
    """(rec, centre, vec): delay vectors of k + 1 values, the latest first, whatever is missing between them (missing values stay null).

    As in ``trajectory``, the last possible window of a recording is left out.
    """
    vec = F.array(*[F.lead(value, i).over(here()) for i in range(k, -1, -1)])
    rows = in_blocks(seq, ahead=k + 1).select("rec", "t", "_own", vec.alias("vec"), F.lead("t", k + 1).over(here()).alias("beyond")).where("_own and beyond is not null")
    return rows.select("rec", (F.col("t") + k // 2).alias("centre"), "vec")


def drop_ends(seq: DataFrame, label: str = "label", first: int = 1, last: int = 1) -> DataFrame:
    """The first and the last symbols of each recording become missing."""
    inner = F.col("t") >= first
    if last:
        inner = inner & F.lead("t", last).over(here()).isNotNull()
    return owned(in_blocks(seq, ahead=last).withColumn(label, F.when(inner, F.col(label))))


def later(seq: DataFrame, column: str, lag: int, name: str) -> DataFrame:
    """Adds the value ``lag`` rows on (back, where negative), null beyond the ends."""
    at = F.lead(column, lag) if lag > 0 else F.lag(column, -lag)
    return owned(in_blocks(seq, behind=max(0, -lag), ahead=max(0, lag)).withColumn(name, at.over(here())))


def r6(column: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)
