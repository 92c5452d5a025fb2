"""Sparse transition algebra on edge lists (src, dst, n) and (src, dst, p).

A matrix is a table of its non-zero cells; products are joins on the shared index followed by a sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequora.operators import kernels
from sequora.sources.storage import cut


def row_normalised(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, src, dst, p): cells over the sum of their row."""
    row = Window.partitionBy(*keys, "src")
    return counts.select(*keys, "src", "dst", (F.col("n") / F.sum("n").over(row)).alias("p"))


def as_rows(p: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, row): matrices over the states 0 to n - 1 as one array of n x n cells, 0 where there is none."""
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("src") * n + F.col("dst")).alias("at"), "p")))
    held = p.groupBy(*keys).agg(cells.alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda at: F.coalesce(F.try_element_at("m", at), F.lit(0.0))).alias("row"))


def from_rows(rows: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, src, dst, p): all cells of such arrays."""
    return rows.select(*keys, F.posexplode("row").alias("at", "p")).select(*keys, F.floor(F.col("at") / n).cast("int").alias("src"), (F.col("at") % n).cast("int").alias("dst"), "p")


def stationary(p: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, state, pi): the distribution with pi P = pi, solved for each matrix in one task (its size is that of the state graph).

    A solution, not a number of steps: slow and periodic chains have theirs too. Of a graph with several closed sets, that of least norm.
    """
    kinds = dict(p.dtypes)

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        states = np.union1d(cells.src, cells.dst)
        dense = np.zeros((len(states), len(states)))
        dense[np.searchsorted(states, cells.src), np.searchsorted(states, cells.dst)] = cells.p
        return pd.DataFrame({**{k: cells[k].iloc[0] for k in keys}, "state": states, "pi": kernels.stationary(dense)})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"state {kinds['src']}", "pi double"])
    return p.groupBy(*keys).applyInPandas(solve, schema)


def reversible(p: DataFrame, pi: DataFrame) -> DataFrame:
    """(src, dst, r): the mean of P and its time reversal, a full outer join of P with its transpose."""
    source = pi.select(F.col("state").alias("src"), F.col("pi").alias("pi_src"))
    target = pi.select(F.col("state").alias("dst"), F.col("pi").alias("pi_dst"))
    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
    both = p.join(back, ["src", "dst"], "full_outer").join(source, "src").join(target, "dst")
    return both.select("src", "dst", ((F.coalesce("p", F.lit(0.0)) + F.col("pi_dst") * F.coalesce("q", F.lit(0.0)) / F.col("pi_src")) / 2).alias("r"))


def entropy_rate(p: DataFrame, pi: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, h): - sum of pi p ln p, in nats."""
    held = p.join(pi.withColumnRenamed("state", "src"), [*keys, "src"])
    return held.groupBy(*keys).agg((-F.sum(F.col("pi") * F.col("p") * F.ln("p"))).alias("h"))


def entropy_production(p: DataFrame, pi: DataFrame, per_state: bool = False) -> DataFrame:
    """h, the rate h_r of the reversed chain and their difference, over pairs that occur in both directions."""
    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
    held = p.join(back, ["src", "dst"]).join(pi.withColumnRenamed("state", "src"), "src")
    flow = F.col("pi") * F.col("p")
    h, h_r = -F.sum(flow * F.ln("p")), -F.sum(flow * F.ln("q"))
    return held.groupBy(*(["src"] if per_state else [])).agg(h.alias("h"), h_r.alias("h_r"), (h_r - h).alias("production"))


def _spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(state, root): marks (state, root) pushed along the edges, the least of each state, until none changes."""
    size, total = None, None
    while True:
        pushed = edges.join(marks.withColumnRenamed("state", "src"), "src").select(F.col("dst").alias("state"), "root")
        marks = cut(marks.unionByName(pushed).groupBy("state").agg(F.min("root").alias("root")), "marks")
        now = marks.agg(F.count(F.lit(1)), F.sum(F.col("root").cast("double"))).first()
        if (size, total) == tuple(now):
            return marks
        size, total = now


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(state, grp): the strongly connected set of each state, named by its smallest state.

    Each round colours a state by the smallest one that reaches it; what reaches its colour's root inside the colour is that root's
    set. Found sets leave the graph. A round's tables are one row per state and per edge, never one per connected pair.
    """
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    states = edges.select(F.col("src").alias("state")).unionByName(edges.select(F.col("dst").alias("state"))).distinct()
    left, found = cut(states, "states"), None
    while left.limit(1).count():
        colours = _spread(edges, left.select("state", F.col("state").alias("root")))
        src, dst = (colours.toDF(x, f"c_{x}") for x in ("src", "dst"))
        inside = cut(edges.join(src, "src").join(dst, "dst").where("c_src = c_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inside")
        sets = _spread(inside, colours.where("state = root")).withColumnRenamed("root", "grp")
        found = sets if found is None else found.unionByName(sets)
        left = cut(left.join(sets, "state", "left_anti"), "states")
        gone = sets.select("state")
        edges = cut(edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"), "edges")
    return found if found is not None else left.select("state", F.col("state").alias("grp"))


def largest_connected(edges: DataFrame) -> DataFrame:
    """(state, place): the largest strongly connected set (ties: that with the smallest state), places in order of states."""
    group = strongly_connected(edges)
    sizes = group.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    best = sizes.agg(F.max_by("grp", F.struct("size", -F.col("grp"))).alias("grp"))
    return group.join(best, "grp").select("state", (F.row_number().over(Window.orderBy("state")) - 1).alias("place"))


def connected_labels(seq: DataFrame, connected: DataFrame, label: str = "label") -> DataFrame:
    """The sequence with each symbol replaced by its place among the connected states (state, place); others are missing."""
    held = connected.select(F.col("state").alias(label), "place")
    return seq.join(F.broadcast(held), label, "left").drop(label).withColumnRenamed("place", label)


def coherence(p: DataFrame, pi: DataFrame, phi: DataFrame) -> DataFrame:
    """(c, rho): for each threshold c of phi, the lesser coherence of {phi <= c} and the rest; all thresholds in one pass.

    An edge enters the low set at the larger rank of its ends, so running sums by rank give every set's inner flow.
    """
    rank = Window.orderBy("phi", "state")
    ranked = phi.join(pi, "state").select("state", "phi", "pi", F.row_number().over(rank).alias("rk"))
    a = ranked.select(F.col("state").alias("src"), F.col("rk").alias("ra"), F.col("pi").alias("pa"))
    b = ranked.select(F.col("state").alias("dst"), F.col("rk").alias("rb"))
    flows = p.join(a, "src").join(b, "dst").select((F.col("pa") * F.col("p")).alias("f"), "ra", "rb")
    low = flows.groupBy(F.greatest("ra", "rb").alias("rk")).agg(F.sum("f").alias("inner_low"))
    high = flows.groupBy(F.least("ra", "rb").alias("rk")).agg(F.sum("f").alias("inner_high"))
    held = ranked.join(low, "rk", "left").join(high, "rk", "left")
    upto = Window.orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("rk").rowsBetween(1, Window.unboundedFollowing)
    sums = held.select("rk", "phi", F.sum(F.coalesce("inner_low", F.lit(0.0))).over(upto).alias("il"), F.sum("pi").over(upto).alias("ml"), F.sum(F.coalesce("inner_high", F.lit(0.0))).over(after).alias("ih"), F.sum("pi").over(after).alias("mh"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return sums.where((F.col("rk") > 1) & (F.col("rk") < F.col("n"))).select(F.col("phi").alias("c"), F.least(F.col("il") / F.col("ml"), F.col("ih") / F.col("mh")).alias("rho"))


def peaks(curve: DataFrame, height: float = 0.5) -> DataFrame:
    """(c, rho): local maxima of a curve (c, rho) of at least a height. A plateau that falls on both sides counts once, at its middle (the left one of two)."""
    by = Window.orderBy("c")
    runs = curve.select("c", "rho", F.sum(F.coalesce((F.col("rho") != F.lag("rho").over(by)).cast("int"), F.lit(0))).over(by).alias("run"))
    flat = runs.groupBy("run", "rho").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    order = Window.orderBy("run")
    beside = flat.select("rho", "cs", F.lag("rho").over(order).alias("b"), F.lead("rho").over(order).alias("a"))
    return beside.where((F.col("rho") > F.col("b")) & (F.col("rho") > F.col("a")) & (F.col("rho") >= height)).select(F.expr("cs[cast((size(cs) - 1) / 2 as int)]").alias("c"), "rho")


def optimal_split(p: DataFrame, pi: DataFrame, phi: DataFrame, height: float = 0.5) -> DataFrame:
    """(state, part): 1 below the most coherent threshold of phi, else 0; no row where no threshold is a peak of that height."""
    best = peaks(coherence(p, pi, phi), height).orderBy(F.desc("rho"), "c").limit(1).select("c")
    return phi.join(F.broadcast(best)).select("state", (F.col("phi") < F.col("c")).cast("int").alias("part"))
