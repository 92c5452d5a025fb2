"""Two-pass Bloom filtering with one hash: which hash positions were hit twice, and who hit them.

Pass one gives away the positions that its rows hit, ``HELD`` at a time (two bytes each), and merges them by chunk into
a "twice" bitmap; the merge has a task for each ``MERGE_BITS`` bits. Pass two probes that bitmap. A row whose position was hit once is certainly unique; a hit twice
may be a false alarm, which later exact steps settle. The bitmap has at most ``MAX_BITS`` bits (64 MB), the
proven bound of what the driver gathers and broadcasts: with more rows than that serves, more rows pass as
"maybe", none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a chunk: positions inside it take two bytes.
CHUNK_BITS = 1 << 16
MAX_BITS = 1 << 29
BITS_PER_ROW = 16
#: Positions that a task holds before it gives them away.
HELD = 1 << 20
#: Bits that one merging task holds: 64 chunks of two flags a position, 8 MB.
MERGE_BITS = 64 * CHUNK_BITS
#: Bits of a bitmap that the driver takes at once: 8 MB.
SMALL_BITS = 1 << 26


def bits_for(rows: int) -> int:
    """A power of two: 16 bits a row, between one chunk and ``MAX_BITS``."""
    return min(MAX_BITS, max(CHUNK_BITS, 1 << (max(1, rows * BITS_PER_ROW) - 1).bit_length()))


def _by_chunk(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk that the held positions touch: positions hit, and positions hit more than once."""
    places = np.concatenate(held)
    held.clear()
    places.sort()
    new = np.ones(len(places), bool)
    new[1:] = places[1:] != places[:-1]
    at = np.flatnonzero(new)
    again = np.diff(np.r_[at, len(places)]) > 1
    places = places[at]
    chunk = places // CHUNK_BITS
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    inner = (places % CHUNK_BITS).astype(np.uint16)
    rows = [(int(chunk[lo]), inner[lo:hi].tobytes(), inner[lo:hi][again[lo:hi]].tobytes()) for lo, hi in zip(first, np.r_[first[1:], len(places)])]
    for i in range(0, len(rows), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 1024]), (pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "once", "twice"])


def _positions(hashes: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    n = 0
    for h in hashes:
        held.append((h.astype(np.int64) & (bits - 1)).astype(np.uint32))
        n += len(h)
        if n >= HELD:
            yield from _by_chunk(held)
            n = 0
    if n:
        yield from _by_chunk(held)


def _column(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (np.asarray(b.column(0)) for b in batches if b.num_rows)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, a bitmap of the positions hit twice by all partitions together."""
    seen: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for chunk, once, twice in zip(*(batch.column(k).to_pylist() for k in range(3))):
            one, two = seen.setdefault(chunk, [np.zeros(CHUNK_BITS, bool), np.zeros(CHUNK_BITS, bool)])
            places = np.frombuffer(once, np.uint16)
            two[np.frombuffer(twice, np.uint16)] = True
            two[places[one[places]]] = True
            one[places] = True
    for chunk, (_, two) in seen.items():
        if two.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(two, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])


def _gather(spark: SparkSession, chunks: DataFrame, bits: int):
    whole = np.zeros(bits // 8, np.uint8)
    step = CHUNK_BITS // 8
    # a small bitmap comes in one job, a large one partition by partition
    for row in chunks.collect() if bits <= SMALL_BITS else chunks.toLocalIterator():
        whole[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(whole)


def _parts(hashes: DataFrame, bits: int, of) -> DataFrame:
    return hashes.mapInArrow(lambda it: _positions(of(it), bits), "chunk int, once binary, twice binary")


def _merged(parts: DataFrame, bits: int):
    merged = parts.repartition(max(1, bits // MERGE_BITS), "chunk").mapInArrow(_merge, "chunk int, bits binary")
    return _gather(parts.sparkSession, merged, bits)


def repeated(hashes: DataFrame, bits: int, of=_column):
    """Broadcast bitmap of the positions that at least two hashes hit; ``of`` gives a partition's hashes (by default, the one column)."""
    return _merged(_parts(hashes, bits, of), bits)


def present(hashes: DataFrame, bits: int, of=_column):
    """Broadcast bitmap of the positions that any hash hits."""
    return _merged(_parts(hashes, bits, of).select("chunk", "once", F.col("once").alias("twice")), bits)


def lookup(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether its position is set."""
    at = hashes.astype(np.int64) & (len(bitmap) * 8 - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def probe(broadcast, hashed: Column) -> Column:
    """The same as a column; only the hashes travel to Python."""

    @F.arrow_udf("boolean")
    def hit(h: pa.Array) -> pa.Array:
        return pa.array(lookup(broadcast.value, np.asarray(h)))

    return hit(hashed)
