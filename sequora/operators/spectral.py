"""Stationary measures and spectra of large state spaces, on edge lists: products are joins and sums, only small matrices reach the driver.

``kernels`` solves one dense matrix in one task, which is right for some thousand states. Here a matrix is a table (src, dst, p) and a vector a table
(state, value); nothing of the size states x states exists anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.operators import markov
from sequora.operators.resampling import uniform
from sequora.sources.storage import cut

def symmetric(p: DataFrame, pi: DataFrame) -> DataFrame:
    """(src, dst, p): the reversible part of P between the roots of the measure; a symmetric matrix with the same eigenvalues."""
    r = markov.reversible(p, pi)
    a, b = (pi.toDF(x, f"pi_{x}") for x in ("src", "dst"))
    return r.join(a, "src").join(b, "dst").select("src", "dst", (F.col("r") * F.sqrt(F.col("pi_src") / F.col("pi_dst"))).alias("p"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), width)


def _gram(rows: DataFrame, columns: list[str], widths: list[int]) -> np.ndarray:
    """Inner products of all vectors of some array columns; a small matrix from each task."""
    size = sum(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            m = np.hstack([_matrix(batch.column(i), w) for i, w in enumerate(widths)])
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = rows.select(*columns).mapInArrow(run, "g binary").toLocalIterator()
    return sum((np.frombuffer(r.g).reshape(size, size) for r in parts), np.zeros((size, size)))


def _mapped(rows: DataFrame, columns: list[str], widths: list[int], out: dict[str, np.ndarray]) -> DataFrame:
    """(state, out...): each output column is the rows' vectors times a small matrix."""
    kind = dict(rows.dtypes)["state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.hstack([_matrix(batch.column(i + 1), w) for i, w in enumerate(widths)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(m @ x), pa.list_(pa.float64())) for x in out.values()]], names=["state", *out])

    return rows.select("state", *columns).mapInArrow(run, f"state {kind}, " + ", ".join(f"{n} array<double>" for n in out))


def _product(edges: DataFrame, rows: DataFrame, first: int, width: int) -> DataFrame:
    """(state, w): the matrix times the vectors from place ``first`` on, in one join and one sum."""
    held = edges.join(rows.select(F.col("state").alias("dst"), F.slice("q", first + 1, width).alias("x")), "dst")
    return held.groupBy(F.col("src").alias("state")).agg(F.array(*[F.sum(F.col("p") * F.col("x")[j]) for j in range(width)]).alias("w"))


def _orthonormal(rows: DataFrame, m: int, b: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((state, q) with the new directions of ``w`` behind the m of ``q``, C, R): w = q C + new R. Twice over, as one pass leaves a rest; directions that are not new go."""
    along, factor = np.zeros((m, b)), np.eye(b)
    for last in (False, True):
        g = _gram(rows, ["q", "w"] if m else ["w"], [m, b] if m else [b])
        c, rest = g[:m, m:], g[m:, m:] - g[:m, m:].T @ g[:m, m:]
        values, vectors = np.linalg.eigh((rest + rest.T) / 2)
        good = values > (1e-24 if last else 1e-14 * max(1e-10, float(np.diag(g[m:, m:]).max())))
        step = vectors[:, good] / np.sqrt(values[good])
        along, factor = along + c @ factor, (vectors[:, good] * np.sqrt(values[good])).T @ factor
        b = len(step.T)
        if not b:
            return rows.select("state", "q"), along, factor
        keep, fresh = np.vstack([np.eye(m), np.zeros((len(step), m))]), np.vstack([-c @ step, step])
        out = {"q": np.hstack([keep, fresh])} if last else {"q": keep, "w": fresh}
        rows = cut(_mapped(rows, ["q", "w"] if m else ["w"], [m, len(step)] if m else [len(step)], out), "basis")
    return rows, along, factor


def _krylov(edges: DataFrame, b: int, pick, tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray, DataFrame, int]:
    """(values, coefficients, (state, q), size of the basis q): wanted pairs of the matrix (src, dst, p) in a block Krylov space.

    A round multiplies the newest directions, makes them orthogonal to all others and solves the small projected problem with ``pick``. It ends when the
    residual of each wanted vector is below the tolerance, when no direction is new, or when the basis would pass ``most`` vectors.
    """
    edges = cut(edges, "edges")
    states = edges.select(F.col("src").alias("state")).unionByName(edges.select(F.col("dst").alias("state"))).distinct()
    start = [F.lit(1.0), *[uniform(F.lit(j), F.col("state")) - 0.5 for j in range(1, b)]]
    rows, _, factor = _orthonormal(cut(states.select("state", F.array().cast("array<double>").alias("q"), F.array(*start).alias("w")), "start"), 0, b)
    before, m = 0, len(factor)
    h = np.zeros((m, 0))
    while True:
        w = _product(edges, rows, before, m - before)
        grown = cut(rows.join(w, "state", "left").select("state", "q", F.coalesce("w", F.array_repeat(F.lit(0.0), m - before)).alias("w")), "product")
        rows, along, factor = _orthonormal(grown, m, m - before)
        r = len(factor)
        h = np.vstack([np.hstack([h, along]), np.hstack([np.zeros((r, before)), factor])])
        values, y = pick(h[:m])
        residual = np.linalg.norm(factor @ y[before:], axis=0).max() if r else 0.0
        if residual <= tolerance or not r or m + r > most:
            return values, y, rows, m
        before, m = m, m + r


def _combined(rows: DataFrame, m: int, y: np.ndarray) -> DataFrame:
    return cut(_mapped(rows.select("state", F.slice("q", 1, m).alias("q")), ["q"], [m], {"v": y}), "vectors")


def stationary(p: DataFrame, tolerance: float = 1e-13, width: int = 4, most: int = 240) -> DataFrame:
    """(state, pi) of one irreducible matrix (src, dst, p): the left vector whose eigenvalue is nearest 1, to a residual, however slow or periodic the chain."""

    def pick(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, vectors = np.linalg.eig(h)
        at = np.abs(values - 1).argmin()
        y = vectors[:, at].real
        return values[[at]].real, (y / max(np.linalg.norm(y), 1e-300))[:, None]

    _, y, rows, m = _krylov(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p"), width, pick, tolerance, most)
    v = _combined(rows, m, y).select("state", F.col("v")[0].alias("v"))
    total = v.agg(F.sum("v").alias("total"))
    return v.join(F.broadcast(total)).select("state", (F.col("v") / F.col("total")).alias("pi"))


def spectrum(edges: DataFrame, k: int, tolerance: float = 1e-9, width: int | None = None, most: int = 240) -> tuple[np.ndarray, DataFrame]:
    """(k largest eigenvalues, falling; (state, v) with their unit vectors) of a symmetric matrix."""

    def pick(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, vectors = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)[:k]
        return values[order], vectors[:, order]

    values, y, rows, m = _krylov(edges, width or k + 2, pick, tolerance, most)
    return values, _combined(rows, m, y)


def reversible_spectrum(p: DataFrame, k: int, tolerance: float = 1e-9) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """((state, pi), eigenvalues, (state, phi)): of the reversible part of one irreducible matrix; right eigenvectors, each with a positive largest entry."""
    pi = cut(stationary(p), "pi")
    values, vectors = spectrum(symmetric(p, pi), k, tolerance)
    held = vectors.join(pi, "state").select("state", "pi", F.transform("v", lambda x: x / F.sqrt("pi")).alias("phi"))
    ends = held.agg(*[F.max_by(F.col("phi")[j], F.struct(F.abs(F.col("phi")[j]), -F.col("state"))).alias(f"e{j}") for j in range(len(values))]).first()
    signs = F.array(*[F.lit(-1.0 if e < 0 else 1.0) for e in ends])
    return pi, values, held.select("state", F.zip_with("phi", signs, lambda a, s: a * s).alias("phi"))


def timescales(counts: DataFrame, lag: float, k: int, tolerance: float = 1e-9) -> np.ndarray:
    """Implied timescales of modes 1 to k of counted transitions (src, dst, n) on their largest strongly connected set; NaN where an eigenvalue is 1 or not above 0."""
    states = cut(markov.largest_connected(counts).select("state"), "states")
    inside = counts.join(states.toDF("src"), "src", "left_semi").join(states.toDF("dst"), "dst", "left_semi")
    _, values, _ = reversible_spectrum(cut(markov.row_normalised(inside), "p"), k + 1, tolerance)
    out = np.full(k, np.nan)
    good = (np.abs(values[1:] - 1) > 1e-12) & (values[1:] > 1e-12)
    out[: len(values) - 1][good] = -lag / np.log(values[1:][good])
    return out
