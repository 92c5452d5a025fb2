"""Windows over long recordings: blocks of rows with a halo, and what is carried from block to block.

``t`` counts the rows of a recording from 0. A block is ``BLOCK`` of them, so no task gets a whole long recording. A window that looks back or ahead gets
copies of the neighbouring blocks' nearest rows (its halo), which are dropped afterwards; running sums and last values are taken inside blocks, and a
table with a row for each block carries them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 17
KEYS = ["rec", "_block"]


def here():
    """A block's rows in order, with its halo."""
    return Window.partitionBy(*KEYS).orderBy("t")


def so_far():
    return here().rowsBetween(Window.unboundedPreceding, 0)


def in_blocks(seq: DataFrame, behind: int = 0, ahead: int = 0) -> DataFrame:
    """Adds ``_block`` and ``_own``; rows that a neighbouring block looks back or ahead to stand there, too, not as its own."""
    size = max(BLOCK, behind, ahead)
    own, place = F.floor(F.col("t") / size), F.col("t") % size
    if not behind and not ahead:
        return seq.withColumn("_block", own).withColumn("_own", F.lit(True))
    copies = [own]
    if ahead:
        copies.append(F.when((place < ahead) & (own > 0), own - 1))
    if behind:
        copies.append(F.when(place >= size - behind, own + 1))
    near = place < ahead if not behind else (place >= size - behind) if not ahead else (place < ahead) | (place >= size - behind)
    blocks = F.when(near, F.filter(F.array(*copies), lambda b: b.isNotNull())).otherwise(F.array(own))
    return seq.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)


def owned(held: DataFrame) -> DataFrame:
    return held.where("_own").drop("_own", "_block")


def _carried(held: DataFrame, per: dict[str, Column], over: dict[str, Column]) -> DataFrame:
    """Joins what earlier blocks give: ``per`` sums a block up, ``over`` sums earlier blocks up; names come with ``_before``."""
    blocks = held.groupBy(*KEYS).agg(*[c.alias(n) for n, c in per.items()])
    before = Window.partitionBy("rec").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    table = blocks.select(*KEYS, *[c.over(before).alias(f"{n}_before") for n, c in over.items()]).where("_block > 0")
    return held.join(table, KEYS, "left")


def running(seq: DataFrame, sums: dict[str, Column], blocked: bool = False) -> DataFrame:
    """Adds running sums over a recording; null until the first value. ``blocked``: the rows have blocks already, all their own."""
    held = (seq if blocked else in_blocks(seq)).select("*", *[c.alias(f"_{n}") for n, c in sums.items()])
    names = list(sums)
    held = _carried(held, {n: F.sum(f"_{n}") for n in names}, {n: F.sum(n) for n in names}).withColumns({n: F.sum(f"_{n}").over(so_far()) for n in names})
    total = lambda n: F.when(F.col(n).isNull(), F.col(f"{n}_before")).otherwise(F.col(n) + F.coalesce(f"{n}_before", F.lit(0)))
    return held.withColumns({n: total(n) for n in names}).drop(*[f"_{n}" for n in names], *[f"{n}_before" for n in names], *([] if blocked else ["_own", "_block"]))


def last_before(held: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the last value that is there before a row; the rows have blocks already, all their own."""
    out = _carried(held, {name: F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("t")))}, {name: F.last(name, ignorenulls=True)})
    local = F.last(column, ignorenulls=True).over(here().rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, F.coalesce(local, F.col(f"{name}_before"))).drop(f"{name}_before")


def with_totals(seq: DataFrame, **totals: Column) -> DataFrame:
    """Adds aggregates over the whole recording: partial sums and a join, so that a recording's rows need not meet."""
    return seq.join(seq.groupBy("rec").agg(*[c.alias(n) for n, c in totals.items()]), "rec")
