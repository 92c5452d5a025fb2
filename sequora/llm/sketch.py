"""How often hashes occur, in a table of fixed size: counts of hash positions over the whole corpus.

The table orders hashes from rare to frequent. Two hashes may share a count; an order by (count, hash) is the same
for everyone all the same, which is all that prefix filters need. The table has one byte for each ``BYTES_PER_PLACE`` bytes of
text, up to ``MOST`` (32 MB): the bound of what is gathered and broadcast. With more text, more hashes share a place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST = 1 << 25
BYTES_PER_PLACE = 12
CHUNK = 1 << 18
#: Hashes that a task holds before it gives their counts away.
HELD = 1 << 20


def size_for(text_bytes: int) -> int:
    return int(min(MOST, max(CHUNK, text_bytes // BYTES_PER_PLACE)))


def _chunks(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Counts of the held places, per chunk: low bytes compressed, what exceeds them apart."""
    places, counts = np.unique(np.concatenate(held), return_counts=True)
    held.clear()
    chunk = places // CHUNK
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    for lo, hi in zip(first, np.r_[first[1:], len(places)]):
        inner, n = (places[lo:hi] % CHUNK).astype(np.int32), counts[lo:hi]
        low = np.zeros(CHUNK, np.uint8)
        low[inner] = np.minimum(n, 255)
        over = n > 255
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(chunk[lo])], pa.int32()), pa.array([pa.compress(low.tobytes(), codec="zstd", asbytes=True)], pa.binary()), pa.array([inner[over].tobytes()], pa.binary()), pa.array([(n[over] - 255).astype(np.int64).tobytes()], pa.binary())],
            names=["chunk", "low", "at", "more"],
        )


def _count(batches: Iterator[pa.RecordBatch], hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        for h in hashes(batch):
            held.append((h % np.uint64(size)).astype(np.uint32))
            n += len(h)
            if n > HELD:
                yield from _chunks(held)
                n = 0
    if n:
        yield from _chunks(held)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, low, at, more in zip(*(batch.column(k).to_pylist() for k in range(4))):
            total = sums.setdefault(c, np.zeros(CHUNK, np.int64))
            total += np.frombuffer(pa.decompress(low, CHUNK, codec="zstd", asbytes=True), np.uint8)
            total[np.frombuffer(at, np.int32)] += np.frombuffer(more, np.int64)
    for c, total in sums.items():
        rank = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([rank.tobytes()], pa.binary())], names=["chunk", "rank"])


def ranks(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int):
    """Broadcast table: for each place, a rank that grows with how often ``hashes`` gives it for ``rows``."""
    parts = rows.mapInArrow(lambda it: _count(it, hashes, size), "chunk int, low binary, at binary, more binary")
    chunks = -(-size // CHUNK)
    table = np.zeros(chunks * CHUNK, np.uint8)
    for row in parts.repartition(min(64, chunks), "chunk").mapInArrow(_add, "chunk int, rank binary").toLocalIterator():
        table[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.rank, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(table[:size])


def rare_first(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The (sorted) hashes in the order of (rank, hash)."""
    return hashes[np.argsort(table[(hashes % np.uint64(len(table))).astype(np.int64)], kind="stable")]
