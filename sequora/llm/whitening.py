"""Embedding whitening from exact integer cross-products, counted by bit slices.

Each entry c becomes the integer x = floor(64 * c) + 1,000,000. A first pass finds each dimension's least and greatest x, sum and
row count. A second pass shifts every dimension by its least value and cuts what is left into bit planes; a plane of 64 rows is one
word, so that the product of two dimensions is the sum, over pairs of planes, of popcounts of AND-ed words times a power of
two. Tasks give away these counts as integers (in limbs that can't overflow), the sums become Python integers, and the covariance is
centred before the only division: (n * sum(x_i x_j) - S_i S_j) / n^2. ``eigh`` runs on the driver on a matrix of dimensions x
dimensions; neither it nor what is broadcast grows with the rows.

Rows whose vector is null or holds null or non-finite entries go, and so do vectors that are shorter or longer than most (of lengths that
are equally common, the longest counts). Entries beyond 2**62 / 64 count as that. Null and repeated ids are values like others: a row gives its rows. A direction
without variance (eigenvalue below the rounding of the largest one) has null in ``whitened`` and stays out of ``identity_error``. ``deviation`` is null where it
passes 64 bits. An empty table, or one without a usable vector, gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.llm.store import small_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows that one block slices at once, in words of 64 rows.
BLOCK_ROWS = 64 * 128
#: Entries beyond it count as it, so that every x is a long.
FAR = 2.0**62
LOW = (1 << 32) - 1


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows used, x as longs): the rows of ``dims`` finite entries."""
    values = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(-1), np.int64)
    flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan), np.float64)
    at = np.flatnonzero(sizes == dims)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    c = flat[starts[at][:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims))
    fine = np.isfinite(c).all(axis=1)
    return at[fine], np.clip(np.floor(c[fine] * SCALE), -FAR, FAR).astype(np.int64) + OFFSET


def _usable(vector: str):
    v = F.col(vector).cast("array<double>")
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def dimensions(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, 0 if there is none."""
    sizes = rows.where(_usable(vector)).groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else 0


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        _, x = integers(batch.column(0), dims)
        held.append(x)
        n += len(x)
        while n >= BLOCK_ROWS:
            x = np.concatenate(held)
            yield x[:BLOCK_ROWS]
            held, n = [x[BLOCK_ROWS:]], n - BLOCK_ROWS
    if n:
        yield np.concatenate(held)


def ranges(rows: DataFrame, dims: int) -> tuple[int, list[int], list[int], list[int]]:
    """(n, least, greatest, sums) of the x of each dimension: exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min), [0] * dims
        for x in _blocks(batches, dims):
            n += len(x)
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
            up, down = (x >> 32).sum(axis=0), (x & LOW).sum(axis=0)
            total = [t + (int(u) << 32) + int(d) for t, u, d in zip(total, up, down)]
        if n:
            yield pa.RecordBatch.from_pylist([{"d": i, "n": n, "low": int(low[i]), "high": int(high[i]), "total": str(total[i])} for i in range(dims)], pa.schema([("d", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("total", pa.string())]))

    found = rows.mapInArrow(run, "d int, n long, low long, high long, total string")
    sums = found.groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("d").collect()  # one row per dimension
    return (sums[0].n if sums else 0), [r.low for r in sums], [r.high for r in sums], [int(r.total) for r in sums]


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """(dims, bits, words): bit b of dimension d, 64 rows a word; ``y`` is unsigned and shorter than ``bits`` bits."""
    rows, dims = y.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        plane = np.zeros((dims, words * 64), bool)
        plane[:, :rows] = ((y >> np.uint64(b)) & np.uint64(1)).T
        out[:, b] = np.packbits(plane, axis=1, bitorder="little")
    return out.view(np.uint64)


def limbs(n: int, bits: int) -> tuple[int, int]:
    """(exponents a limb holds, number of limbs): the counts of a limb's exponents, weighted inside it, stay below 2**62."""
    width = max(1, 61 - max(1, n).bit_length() - bits.bit_length())
    return width, -(-max(1, 2 * bits - 1) // width)


def scatter(y: np.ndarray, bits: int, width: int, count: int) -> np.ndarray:
    """(limbs, dims, dims): for i <= j, the popcounts of plane pairs; exponent b + c goes to limb (b + c) // width with weight 2**((b + c) % width)."""
    p = planes(y, bits)
    dims = len(p)
    out = np.zeros((count, dims, dims), np.int64)
    for i in range(dims):
        for b in range(bits):
            hits = np.bitwise_count(p[i:] & p[i, b]).sum(axis=2, dtype=np.int64)  # dims from i on x bits
            for c in range(bits):
                k, s = divmod(b + c, width)
                out[k, i, i:] += hits[:, c] << s
    return out


def cross_products(rows: DataFrame, dims: int, n: int, low: list[int], high: list[int]) -> list[list[int]]:
    """Sums of y_i * y_j over all rows (y: x less the dimension's least value), as Python integers."""
    bits = max(1, max(h - l for h, l in zip(high, low)).bit_length())
    width, count = limbs(n, bits)
    base = np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, dims):
            part = scatter((x - base).astype(np.uint64), bits, width, count)
            total = part if total is None else total + part
        if total is not None:
            for i in range(dims):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[:, i, i:].tobytes()], pa.binary())], names=["i", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(counts, np.int64)
                sums[i] = sums[i] + row if i in sums else row
        for i, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], names=["i", "counts"])

    kind = "i int, counts binary"
    # a row of dims numbers for each dimension and task, added up where they meet
    parts = rows.mapInArrow(run, kind).repartition(min(dims, 64), "i").mapInArrow(add, kind)
    out = [[0] * dims for _ in range(dims)]
    for r in parts.collect():  # dims rows
        for k, limb in enumerate(np.frombuffer(r.counts, np.int64).reshape(count, dims - r.i)):
            for j, value in enumerate(limb.tolist(), r.i):
                out[r.i][j] += value << (k * width)
    for i in range(dims):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def model(rows: DataFrame, dims: int, components: int) -> dict | None:
    """n, sums S, components (columns, by falling eigenvalue), their eigenvalues and shares; from one vector column."""
    n, low, high, sums = ranges(rows, dims)
    if not n:
        return None
    products = cross_products(rows, dims, n, low, high)
    shifted = [s - n * l for s, l in zip(sums, low)]
    # n^2 * V in integers; a true division of integers rounds once
    v = np.array([[(n * products[i][j] - shifted[i] * shifted[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    trace = sum(n * products[i][i] - shifted[i] ** 2 for i in range(dims)) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    e = values[order]
    usable = e > max(values.max(), 0.0) * dims * np.finfo(float).eps
    spread = max(max(h * n - s, s - l * n) for h, l, s in zip(high, low, sums))
    return {"n": n, "sums": sums, "e": e, "usable": usable, "basis": vectors[:, order], "explained": e / trace if trace else np.zeros(len(e)), "spread": spread, "dims": dims}


def centred(x: np.ndarray, m: dict) -> np.ndarray:
    """n * x - S: longs where all of them fit, else Python integers."""
    if m["spread"] < 2**62 and max(abs(s) for s in m["sums"]) < 2**62:
        return x * np.int64(m["n"]) - np.array(m["sums"], np.int64)
    return x.astype(object) * m["n"] - np.array(m["sums"], object)


def project(x: np.ndarray, m: dict) -> np.ndarray:
    """Whitened rows; directions without variance are nan."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(m["usable"], 1 / np.sqrt(np.where(m["usable"], m["e"], 1.0)), np.nan)
    return ((centred(x, m) / m["n"]).astype(float) @ m["basis"]) * scale


def deviations(x: np.ndarray, m: dict) -> list[int | None]:
    """Sums of squares of n * x - S, exact; null beyond 64 bits."""
    c = centred(x, m)
    if m["dims"] * int(m["spread"]) ** 2 >= 2**63:
        c = c.astype(object)
    return [int(v) if v < 2**63 else None for v in (c * c).sum(axis=1).tolist()]


def identity_error(rows: DataFrame, m: dict) -> float:
    """Largest entry of the whitened rows' covariance less the identity; tasks centre their rows before multiplying, the driver merges one matrix a task."""
    k = len(m["e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, m["dims"]):
            n, mean, square = merge((n, mean, square), moments(project(x, m)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([square.tobytes()], pa.binary())], names=["n", "mean", "square"])

    total = (0, np.zeros(k), np.zeros((k, k)))
    for r in rows.mapInArrow(run, "n long, mean binary, square binary").toLocalIterator():
        total = merge(total, (r.n, np.frombuffer(r.mean), np.frombuffer(r.square).reshape(k, k)))
    use = m["usable"]
    off = total[2][np.ix_(use, use)] / total[0] - np.eye(int(use.sum()))
    return float(np.abs(off).max()) if off.size else 0.0


def moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def merge(a: tuple, b: tuple) -> tuple:
    """Moments of two disjoint sets of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component."""
    vectors = small_batches(rows).select(F.col(f"`{vector}`").alias("v"))
    kind = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dims = dimensions(vectors, "v")
    m = model(vectors, dims, components) if dims else None
    if m is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, m)
    shared = rows.sparkSession.sparkContext.broadcast(m)  # dims x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m["e"])
        for batch in batches:
            at, x = integers(batch.column(1), m["dims"])
            for lo in range(0, len(at), 1024):
                some = x[lo : lo + 1024]
                w = project(some, m).ravel()
                size = len(some)
                ids = batch.column(0).take(pa.array(np.repeat(at[lo : lo + 1024], k)))
                far = pa.array(deviations(some, m), pa.int64()).take(pa.array(np.repeat(np.arange(size), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m["n"])), far, pa.array(w, from_pandas=True), pa.array(np.tile(m["explained"], size)), pa.array(np.full(size * k, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select(F.col(f"`{id_col}`"), F.col(f"`{vector}`")).mapInArrow(run, schema)
