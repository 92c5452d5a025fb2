"""Distances between recordings: all, or a stated set, against all, in blocks; embeddings and splits of all recordings, from bounded sets of landmarks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.operators import kernels as kn
from sequora.sources.storage import cut

#: Recordings that one broadcast holds; a larger stated set is compared block by block.
BLOCK = 4096


#: Recordings that one task compares with a block, and cells of a row up to which each is a column.
ROWS, UNROLLED = 2048, 100


def distance(a: str, b: str, n: int):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / n


def _cells(rows: DataFrame, name: str, n: int) -> DataFrame:
    """(name, name0, name1, ...): rows with a column for each cell; long rows stay one array."""
    held = [F.coalesce(F.col("row")[i], F.lit(0.0)).alias(f"_{name}{i}") for i in range(n * n)] if n * n <= UNROLLED else [F.col("row").alias(f"_{name}")]
    return rows.select(F.col("rec").alias(name), *held)


def distances(rows: DataFrame, n: int, every: int = 1, of_a: DataFrame | None = None, of_b: DataFrame | None = None) -> DataFrame:
    """(a, b, d): sums of the differences of the rows of two matrices, over n; for a, all recordings or those whose id is divisible by ``every``, for b, all.

    ``of_a`` and ``of_b`` are tables with a row for an id; their columns come along, ids that they do not have go. So a statistic of the distances meets each
    distance anew, and the pairs are neither stored nor shuffled. Rows are dealt out by number: a small table must not end in one task.
    """
    asked = _cells(rows.where(F.col("rec") % every == 0), "a", n)
    others = _cells(rows, "b", n)
    blocks, tasks = max(1, -(-asked.count() // BLOCK)), max(1, -(-rows.count() // ROWS))
    asked = asked if of_a is None else asked.join(of_a, "a")
    others = (others if of_b is None else others.join(of_b, "b")).repartition(tasks)
    if n * n <= UNROLLED:
        gaps = [F.abs(F.col(f"_a{i}") - F.col(f"_b{i}")) for i in range(n * n)]
        d = sum(gaps[1:], gaps[0]) / n
    else:
        d = distance("_a", "_b", n)
    kept = [c for c in [*asked.columns, *others.columns] if not c.startswith("_")]
    out = None
    for i in range(blocks):
        block = F.broadcast(asked.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == i))
        part = others.join(block, F.col("b").isNotNull()).select(*kept, d.alias("d"))
        out = part if out is None else out.unionByName(part)
    return out


#: Recordings of a row's tile, of the tiles that it meets, and tiles that one broadcast holds.
MINE, MET, HELD = 512, 4096, 64
#: How statistics from several tiles become one: in a task, and over tasks.
MERGED = {"min": (np.minimum, F.min), "max": (np.maximum, F.max), "sum": (np.add, F.sum)}


def _tiles(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """((tile, row, other columns), number of tiles): about ``size`` recordings in a row, each column as one array."""
    count = max(1, -(-rows.count() // size))
    each = lambda c: F.transform("held", lambda r: r[c])
    held = rows.groupBy(F.pmod(F.xxhash64("rec"), F.lit(count)).alias(f"{name}_tile")).agg(F.collect_list(F.struct(*rows.columns)).alias("held"))
    return held.select(f"{name}_tile", F.flatten(each("row")).alias(f"{name}_row"), *[each(c).alias(f"{name}_{c}") for c in rows.columns if c != "row"]), count


def over_all(rows: DataFrame, n: int, make, merged: dict[str, str]) -> DataFrame:
    """(a, statistics): of each recording, statistics of its distances from all recordings; neither pairs nor distances leave the task that makes them.

    Recordings stand in tiles; a task's tiles meet those of a broadcast. ``make`` gets distances (a line for each of some recordings, a column for each of a tile) and the columns of
    ``rows`` for both, and gives an array for each of ``merged``, which names how those of several tiles become one.
    """
    mine, tasks = _tiles(rows, MINE, "a")
    met, count = _tiles(rows, MET, "b")
    mine, met = mine.repartition(tasks), cut(met, "tiles")
    kept = [c for c in rows.columns if c != "row"]
    merge = [MERGED[how][0] for how in merged.values()]

    def statistics(x: np.ndarray, y: np.ndarray, a: dict, b: dict, lines: int = 16) -> list[np.ndarray]:
        out = []
        for lo in range(0, len(x), lines):
            some = x[lo : lo + lines]
            d, gap = np.zeros((len(some), y.shape[1])), np.empty((len(some), y.shape[1]))
            for j, cell in enumerate(y):
                np.subtract(some[:, j, None], cell[None, :], out=gap)
                d += np.abs(gap, out=gap)
            out.append(make(d / n, {c: v[lo : lo + lines] for c, v in a.items()}, b))
        return [np.concatenate(held) for held in zip(*out)]

    def run(batches):
        tile, ids, total = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(t, pa.float64()) for t in total]], names=["a", *merged])
        for batch in batches:
            for i, at in enumerate(batch.column("a_tile").to_pylist()):
                a, b = ({c: np.asarray(batch.column(f"{side}_{c}")[i].values) for c in kept} for side in "ab")
                x, y = (np.asarray(batch.column(f"{side}_row")[i].values, float).reshape(-1, n * n) for side in "ab")
                got = statistics(x, np.ascontiguousarray(y.T), a, b)
                if at != tile:
                    if tile is not None:
                        yield done()
                    tile, ids, total = at, a["rec"], got
                else:
                    total = [f(t, g) for f, t, g in zip(merge, total, got)]
        if tile is not None:
            yield done()

    groups = max(1, -(-count // HELD))
    schema = ", ".join(["a long", *[f"{c} double" for c in merged]])
    parts = [mine.crossJoin(F.broadcast(met.where(F.col("b_tile") % groups == i))).mapInArrow(run, schema) for i in range(groups)]
    return reduce(DataFrame.unionByName, parts).groupBy("a").agg(*[MERGED[how][1](c).alias(c) for c, how in merged.items()])


def distance_sums(rows: DataFrame, n: int, every: int = 1) -> DataFrame:
    """(rec, to_all, to_asked, asked, n_all, n_asked): of each recording, the sums of its distances from all and from the stated ones (all, unless ``every`` is given); no pair is looked at.

    In one cell, the gaps of a value from all values sum to what counts and running sums over the cell's different values give; a distance is the sum over the cells.
    """
    long = rows.select("rec", (F.col("rec") % every == 0).alias("asked"), F.posexplode("row").alias("cell", "x"))
    values = long.groupBy("cell", "x").agg(F.count(F.lit(1)).alias("all"), F.count_if("asked").alias("some"))
    upto, whole = Window.partitionBy("cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("cell")

    def gaps(count: str) -> Column:
        c, x = F.col(count), F.col("x")
        below, total, of_below, of_all = F.sum(c).over(upto), F.sum(c).over(whole), F.sum(c * x).over(upto), F.sum(c * x).over(whole)
        return x * (2 * below - total) - 2 * of_below + of_all

    table = values.select("cell", "x", gaps("all").alias("to_all"), gaps("some").alias("to_asked"), F.sum("all").over(whole).alias("n_all"), F.sum("some").over(whole).alias("n_asked"))
    positive = lambda c: F.greatest(F.sum(c) / n, F.lit(0.0)).alias(c)
    return long.join(table, ["cell", "x"]).groupBy("rec").agg(positive("to_all"), positive("to_asked"), F.first("asked").alias("asked"), F.first("n_all").alias("n_all"), F.first("n_asked").alias("n_asked"))


def rounded(x: Column) -> Column:
    """``r6`` of numbers below 1e9, without decimals but near a tie: for columns of many pairs."""
    at = x * 1e6
    off = F.abs(at - F.floor(at) - 0.5)
    return F.when(off.between(1e-3, 0.5), F.floor(at + 0.5) / F.lit(1e6)).otherwise(F.round(x, 6)) + F.lit(0.0)


def landmarks(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The recordings of each group with the least hashes, a bounded number of them."""
    order = Window.partitionBy(key).orderBy(F.xxhash64("rec"), "rec")
    return rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")


def to_landmarks(rows: DataFrame, marks: DataFrame, key: str, n: int) -> DataFrame:
    """(key, rec, mark, d): distances of all recordings from the landmarks of their group (as many rows as landmarks at most each)."""
    held = F.broadcast(marks.select(key, F.col("rec").alias("mark"), F.col("row").alias("rm")))
    return rows.join(held, key).select(key, "rec", "mark", distance("row", "rm", n).alias("d"))


def shifted_embedding(d: np.ndarray, dims: int) -> np.ndarray:
    """Coordinates of a constant-shift embedding: the centred distances less their least eigenvalue; the largest entry of each axis is positive."""
    q = np.eye(len(d)) - 1 / len(d)
    values, vectors = np.linalg.eigh(-0.5 * q @ d @ q)
    values = values - values.min()
    order = np.argsort(-values)[:dims]
    z = vectors[:, order] * np.sqrt(values[order])
    z *= np.where(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])] < 0, -1.0, 1.0)
    return np.pad(z, ((0, 0), (0, dims - z.shape[1])))


def square(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of cells (rec, mark, d)."""
    return np.unique(cells.mark), cells.pivot(index="rec", columns="mark", values="d").to_numpy()


def embed(cells: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, rec, z): constant-shift embedding of the landmarks of each group, one small task a group."""
    kind = dict(cells.dtypes)[key]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, d = square(part)
        return pd.DataFrame({key: part[key].iloc[0], "rec": ids, "z": list(shifted_embedding(d, dims))})

    return cells.groupBy(key).applyInPandas(run, f"{key} {kind}, rec long, z array<double>")


def project(cells: DataFrame, among: DataFrame, embedded: DataFrame, key: str, dims: int) -> DataFrame:
    """(key, rec, z): recordings placed among the embedded landmarks by their distances from them (``among``: the landmarks' own).

    The centred distances times the landmarks' coordinates, over the squared length of each axis: a join with the landmarks and one sum.
    """
    own = among.groupBy(key, "mark").agg(F.avg("d").alias("column"))
    size = F.array(*[F.sum(F.pow(F.col("z")[i], 2)).alias(f"s{i}") for i in range(dims)])
    whole = embedded.groupBy(key).agg(size.alias("size")).join(among.groupBy(key).agg(F.avg("d").alias("whole")), key)
    basis = F.broadcast(embedded.withColumnRenamed("rec", "mark").join(own, [key, "mark"]).join(whole, key))
    mean = F.avg("d").over(Window.partitionBy(key, "rec"))
    c = cells.withColumn("mean", mean).join(basis, [key, "mark"]).withColumn("c", -0.5 * (F.col("d") - F.col("mean") - F.col("column") + F.col("whole")))
    placed = [F.sum(F.col("c") * F.col("z")[i] / F.greatest(F.col("size")[i], F.lit(1e-12))).alias(f"z{i}") for i in range(dims)]
    return c.groupBy(key, "rec").agg(*placed).select(key, "rec", F.array(*[f"z{i}" for i in range(dims)]).alias("z"))


def fuzzy_halves(x: np.ndarray, rounds: int = 300, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(centres, memberships) of two fuzzy clusters (exponent 2) of a vector, from its ends."""
    centres = np.array([x.min(), x.max()])
    for _ in range(rounds):
        u = membership(x, centres)
        new = (u**2 * x[:, None]).sum(axis=0) / (u**2).sum(axis=0)
        done = np.abs(new - centres).max() < tolerance
        centres = new
        if done:
            break
    return centres, membership(x, centres)


def membership(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    near = 1 / ((x[:, None] - centres[None, :]) ** 2 + 1e-18)
    return near / near.sum(axis=1, keepdims=True)


def slowest(d: np.ndarray, eps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(P, stationary measure, slowest vector of length 1, its eigenvalue) of the diffusion kernel of a set."""
    k = np.exp(-d / np.sqrt(eps[:, None] * eps[None, :]))
    p = k / k.sum(axis=1, keepdims=True)
    pi, values, phi = kn.spectrum(p, 2)
    v = phi[:, 1] if phi.shape[1] > 1 else np.zeros(len(d))
    return p, pi, v / max(np.linalg.norm(v), 1e-300), float(values[1]) if len(values) > 1 else 0.0


class Splits:
    """Fuzzy spectral splits of a set of landmarks: a tree of parts, and which of them each level splits.

    ``nodes``: of each part, its landmarks, and where it has more than two, their slowest vector and its eigenvalue. ``levels``: the parts before
    the level, in order, the place of the one that is split, and the centres of its halves. The part whose halves keep most of their measure (the lesser
    of both) is split next; what belongs to it in part keeps that share: other parts' members are judged by their own slowest vectors,
    and responsibilities multiply. ``column_weights`` weighs the cells of that measure by where they lead instead of where they come from.
    """

    def __init__(self, d: np.ndarray, eps: np.ndarray, n_parts: int, column_weights: bool = False):
        self.nodes: list[tuple[np.ndarray, np.ndarray | None, float]] = []
        self.levels: list[tuple[list[int], int, np.ndarray]] = []
        kept: list[float] = []

        def grow(inside: np.ndarray) -> int:
            held = -1.0
            vector, value = None, 0.0
            if len(inside) > 2:
                p, pi, vector, value = slowest(d[np.ix_(inside, inside)], eps[inside])
                half = fuzzy_halves(vector)[1].argmax(axis=1)
                weights = np.broadcast_to(pi[None, :] if column_weights else pi[:, None], p.shape)
                held = min(float((weights * p)[np.ix_(half == s, half == s)].sum() / pi[half == s].sum()) if (half == s).any() else 0.0 for s in (0, 1))
            self.nodes.append((inside, vector, value))
            kept.append(held)
            return len(self.nodes) - 1

        parts = [grow(np.arange(len(d)))]
        for _ in range(1, n_parts):
            g = max(range(len(parts)), key=lambda i: (kept[parts[i]], -i))
            inside, vector, _ = self.nodes[parts[g]]
            if vector is None:
                break
            centres, own = fuzzy_halves(vector)
            self.levels.append((list(parts), g, centres))
            halves = own.argmax(axis=1)
            parts = parts[:g] + parts[g + 1 :] + [grow(inside[halves == s]) for s in (0, 1)]


def fuzzy_splits(d: np.ndarray, eps: np.ndarray, n_parts: int, column_weights: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hard parts, responsibilities) of the landmarks themselves, level by level."""
    tree = Splits(d, eps, n_parts, column_weights)
    hard, resp, out = np.zeros(len(d), int), np.ones((len(d), 1)), []
    for parts, g, centres in tree.levels:
        u = np.full((len(d), 2), 0.5)
        for node in parts:
            inside, vector, _ = tree.nodes[node]
            if vector is not None:
                u[inside] = membership(vector, centres)
        new = hard - (hard > g)
        mine = hard == g
        new[mine] = len(parts) - 1 + u[mine].argmax(axis=1)
        hard, resp = new, np.hstack([np.delete(resp, g, axis=1), u * resp[:, [g]]])
        out.append((hard.copy(), resp.copy()))
    return out


SPLITS = "level int, place int, parts array<int>, centres array<double>, node int, mark long, v double"


def split_tree(among: DataFrame, key: str, n_parts: int) -> DataFrame:
    """(key, level, place, parts, centres, node, mark, v): a row for each level of each group's tree, and one for each landmark of each part (its slowest vector over the eigenvalue)."""
    kind = dict(among.dtypes)[key]

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        ids, d = square(cells)
        tree = Splits(d, np.maximum(d.sum(axis=1) / max(1, len(d) - 1), 1e-12), n_parts)
        who = cells[key].iloc[0]
        rows = [(who, level, g, parts, centres, None, None, None) for level, (parts, g, centres) in enumerate(tree.levels, 1)]
        for node, (inside, vector, value) in enumerate(tree.nodes):
            if vector is not None:
                rows += [(who, None, None, None, None, node, int(ids[i]), float(x / value) if abs(value) > 1e-12 else 0.0) for i, x in zip(inside, vector)]
        return pd.DataFrame(rows, columns=[key, "level", "place", "parts", "centres", "node", "mark", "v"]).astype({"level": "Int32", "place": "Int32", "node": "Int32", "mark": "Int64"})

    return among.groupBy(key).applyInPandas(run, f"{key} {kind}, {SPLITS}")


def extended_splits(cells: DataFrame, among: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """(key, level, rec, hard, shares): hard part and responsibilities of all recordings, level by level; at level 0 there is one part.

    Nystroem: a recording's entry of a part's slowest vector is the mean of the landmarks' entries, weighted by its row of the diffusion kernel, over the
    eigenvalue. For a landmark inside the part that is its own entry. All parts get theirs in one join with the tree and one sum; a level is then an
    expression over them and its row of the tree.
    """
    own = F.max((F.col("rec") == F.col("mark")).cast("int"))
    width = F.greatest(F.sum("d") / F.greatest(F.count(F.lit(1)) - own, F.lit(1)), F.lit(1e-12))
    eps = F.broadcast(among.groupBy(key, "rec").agg(width.alias("eps_mark")).withColumnRenamed("rec", "mark"))  # a row a landmark
    vectors = F.broadcast(tree.where("mark is not null").select(key, "node", "mark", "v"))
    mine = Window.partitionBy(key, "rec")
    wide = F.greatest(F.sum("d").over(mine) / F.greatest(F.count(F.lit(1)).over(mine) - F.max((F.col("rec") == F.col("mark")).cast("int")).over(mine), F.lit(1)), F.lit(1e-12))
    kernel = cells.withColumn("eps", wide).join(eps, [key, "mark"]).select(key, "rec", "mark", F.exp(-F.col("d") / F.sqrt(F.col("eps") * F.col("eps_mark"))).alias("k"))
    placed = kernel.join(vectors, [key, "mark"]).groupBy(key, "rec", "node").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("x"))
    by_node = placed.groupBy(key, "rec").agg(F.map_from_entries(F.collect_list(F.struct("node", "x"))).alias("xs"))
    state = cells.select(key, "rec").distinct().join(by_node, [key, "rec"], "left").select(key, "rec", "xs", F.lit(0).alias("hard"), F.array(F.lit(1.0)).alias("shares"))
    levels = cut(tree.where("level is not null").select(key, "level", "place", "parts", "centres"), "levels")
    state = cut(state, "placed")
    out = state.select(key, F.lit(0).alias("level"), "rec", "hard", "shares")
    for level in range(1, (levels.agg(F.max("level")).first()[0] or 0) + 1):
        held = state.join(F.broadcast(levels.where(F.col("level") == level).drop("level")), key)  # a row a group
        x = F.try_element_at("xs", F.element_at("parts", F.col("hard") + 1))
        near = lambda i: 1 / (F.pow(F.col("x") - F.col("centres")[i], 2) + 1e-18)
        held = held.withColumn("x", x).withColumn("u", F.when(F.col("x").isNull(), 0.5).otherwise(near(0) / (near(0) + near(1))))
        g, others, share = F.col("place"), F.size("parts") - 1, F.element_at("shares", F.col("place") + 1)
        rest = F.filter("shares", lambda _, i: i != F.col("place"))
        hard = F.when(F.col("hard") == g, others + F.when(F.col("u") >= 0.5, 0).otherwise(1)).otherwise(F.col("hard") - (F.col("hard") > g).cast("int"))
        state = cut(held.select(key, "rec", "xs", hard.alias("hard"), F.concat(rest, F.array(F.col("u") * share, (1 - F.col("u")) * share)).alias("shares")), "level")
        out = out.unionByName(state.select(key, F.lit(level).alias("level"), "rec", "hard", "shares"))
    return out
