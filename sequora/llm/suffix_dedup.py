"""Repeated passages by the common-prefix interval tree of an enhanced suffix array, spread over tasks by anchors.

A repeat is a string of ``LEAST`` bytes or more that occurs more than once; matches never cross documents. To bring all
occurrences of a repeat together without shuffling every suffix, texts are sampled at anchors: the ``K``-byte strings
whose hash is the least of a window (minimizers). Any two equal strings of ``LEAST`` bytes have the same anchor at
the same place, so nothing is lost. Anchors that only one text has are left out by two-pass Bloom filtering; what the filter lets
through all the same is shuffled once, by anchor, and not written. Occurrences are no table: each step that needs them reads the texts again.

Occurrences of an anchor are told apart by their context, the bytes that a repeat through the anchor can reach:

* Equal contexts are one class. All members but those of its first document repeat that document's bytes whole. Those of
  its first document are one row for each text, which lists their places: what is found on the row holds at each of them.
  Contexts count as equal when two 64-bit hashes are, of the anchor and of the context with its place.
* The contexts of the classes of one anchor go to one task, in blocks. There the suffixes of the contexts that share
  ``LEAST`` bytes with another document are sorted with the lengths of their common prefixes. A stack scan gives the
  intervals of this suffix array; intervals whose occurrences all have the same byte before them are passed over, as a longer
  repeat to the left says the same (left-extension diversity).
* For ``repeated_spans``, an anchor with more than ``HOT_CLASSES`` classes is split: its strings of ``LEAST`` bytes are
  grouped by hash over all tasks, exactly, instead of in one block. The result is the same.

``repeated_spans`` gives what to remove so that of each repeat only the document with the smallest id keeps it; ``maximal_repeats``
gives the groups, with all occurrences and in their whole length. Equal texts are collapsed first: only the one with the smallest id takes part.

Null texts count as empty; texts below ``LEAST`` bytes are never touched. Columns other than id and text are not read. A null doc_id is smaller than any other. Rows with
equal ids and different texts are different occurrences, neither of which comes before the other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.llm import bitmap
from sequora.llm.arrow_text import offsets_and_bytes, slices
from sequora.llm.shingles import mixed, powers
from sequora.llm.store import cut

LEAST, K = 50, 24
SIDE = LEAST - K
WIDE = LEAST + SIDE
HOT_CLASSES = 50_000
#: Contexts that one block of a task holds, but for a larger single anchor.
BLOCK_ROWS = 20_000
#: Occurrences that a task makes into parts of classes before it gives them away.
HELD = 1 << 19
_CODE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
_NONE = -(2**63)


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def _between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the strings [lo, hi)."""
    return mixed((sums[hi] - sums[lo]) * powers(len(sums))[1][lo] + (hi - lo).astype(np.uint64))


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each window of a width."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, hash of the context) of the anchors of a slice; places count from the start of the slice."""
    empty = np.zeros(0, np.int64)
    if len(data) < LEAST:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = _sums(data)
    down = powers(len(sums))[1]
    h = mixed((sums[K:] - sums[:-K]) * down[: len(data) - K + 1])
    width = LEAST - K + 1
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least = _slide(h, width, np.minimum)
    # windows that cross from one text into the next choose nothing
    least[owner[: len(least)] != owner[LEAST - 1 : LEAST - 1 + len(least)]] = 0
    pad = np.zeros(width - 1, np.uint64)
    chosen = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
    place = np.flatnonzero((h == chosen) & (chosen > 0))
    text = owner[place]
    lo = np.maximum(place - SIDE, offsets[text])
    hi = np.minimum(place + LEAST, offsets[text + 1])
    context = mixed(_between(sums, lo, hi) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, place, h[place], context


_TEXTS = ["doc", "tag", "text", "h", "sure"]


def _alone(batches: Iterator[pa.RecordBatch], copies: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows (doc, tag, text, h, sure) that take part: those that no other text may equal, and those that are sure to."""
    for batch in batches:
        keep = np.asarray(batch.column(4)) | ~bitmap.lookup(copies, np.asarray(batch.column(3)))
        batch = batch.filter(pa.array(keep))
        if batch.num_rows:
            yield batch


def _distinct_anchors(copies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in _alone(batches, copies.value):
            for _, _, offsets, data in slices(batch.column(2)):
                text, _, h, _ = anchors(offsets, data)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                yield h[new].view(np.int64)

    return run


def _shared(batches: Iterator[pa.RecordBatch], copies: np.ndarray, among: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each slice, the anchors that a bitmap has: (doc and tag of each text, text, place, anchor, context, offsets, bytes)."""
    for batch in _alone(batches, copies):
        doc, tag = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for first, end, offsets, data in slices(batch.column(2)):
            text, place, h, context = anchors(offsets, data)
            keep = np.flatnonzero(bitmap.lookup(among, h.view(np.int64)))
            yield doc[first:end], tag[first:end], text[keep], place[keep], h[keep].view(np.int64), context[keep].view(np.int64), offsets, data


_PAIR = "anchor long, context long, first long, last long"


def _pairs(anchor: np.ndarray, context: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of one (anchor, context) made one; sorted."""
    order = np.lexsort((context, anchor))
    anchor, context = anchor[order], context[order]
    at = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])])
    return anchor[at], context[at], np.minimum.reduceat(first[order], at), np.maximum.reduceat(last[order], at)


def _partial_classes(copies, twice):
    """Classes of ``HELD`` occurrences at a time, each with its least and its greatest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            cols = _pairs(*(np.concatenate(c) for c in zip(*held)))
            for i in range(0, len(cols[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in cols], names=["anchor", "context", "first", "last"])

        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for doc, _, text, _, a, c, _, _ in _shared(batches, copies.value, twice.value):
            if len(a):
                held.append((a, c, doc[text], doc[text]))
                n += len(a)
            if n >= HELD:
                yield from given()
                held, n = [], 0
        if n:
            yield from given()

    return run


_CLASS = "anchor long, context long, first long, more boolean, several boolean, nth int"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes from their parts, sorted by (anchor, context): those that two documents have, and those of anchors with several.

    ``nth`` counts the classes of an anchor. The last class of a batch waits for the next one, so a task never holds an anchor whole.
    """
    held: list[np.ndarray] | None = None
    n = 0  # classes of the waiting one's anchor before it

    def settled(cols: list[np.ndarray], rows: int) -> tuple[pa.RecordBatch, int]:
        anchor, context, first, last = cols
        at = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        nth = np.arange(len(anchor)) - np.repeat(at, np.diff(np.r_[at, len(anchor)]))
        nth[: at[1] if len(at) > 1 else len(anchor)] += n
        several, more = (nth > 0) | np.r_[anchor[1:] == anchor[:-1], False], first < last
        linked = np.minimum.reduceat(first, at) < np.maximum.reduceat(last, at)
        # an anchor that is not whole here may have another document elsewhere
        linked[-1], linked[0] = True, linked[0] or n > 0 or len(at) == 1
        several &= np.repeat(linked, np.diff(np.r_[at, len(anchor)]))
        keep = np.flatnonzero((several | more)[:rows])
        kept = [anchor[keep], context[keep], first[keep], more[keep], several[keep], nth[keep].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in kept], names=[x.split()[0] for x in _CLASS.split(", ")]), int(nth[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(4)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        cols = list(_pairs(*cols))
        found, n = settled(cols, len(cols[0]) - 1)
        if found.num_rows:
            yield found
        held = [c[-1:] for c in cols]
    if held is not None:
        yield settled(held, 1)[0]


_OCCURRENCE = "anchor long, context long, doc long, tag int, start int, size int"


def _occurrences(copies, among, wanted=None):
    """Where the anchors that a bitmap has occur, as the spans of their contexts; of the classes ``wanted``, where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, tag, text, place, a, c, offsets, _ in _shared(batches, copies.value, among.value):
            if wanted is not None:
                keep = np.flatnonzero(bitmap.lookup(wanted.value, _class_key(a, c)))
                text, place, a, c = text[keep], place[keep], a[keep], c[keep]
            own = place - offsets[text]
            start, end = np.maximum(own - SIDE, 0), np.minimum(place + LEAST, offsets[text + 1]) - offsets[text]
            cols = [a, c, doc[text], tag[text], start.astype(np.int32), (end - start).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=[x.split()[0] for x in _OCCURRENCE.split(", ")])

    return run


_CONTEXT = "anchor long, doc long, tag int, place int, before int, bytes binary, again array<int>"


def _class_key(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(mixed(anchor.view(np.uint64)) ^ context.view(np.uint64)).view(np.int64)


def _asked_key(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mixed(_class_key(anchor, context).view(np.uint64) + doc.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _keys(key, columns: int):
    """The keys of a partition's rows, of their first columns."""
    return lambda batches: (key(*(np.asarray(batch.column(i)) for i in range(columns))) for batch in batches if batch.num_rows)


def _contexts(copies, among, asked):
    """The bytes of the contexts that are asked for (a false alarm is one more true occurrence).

    Equal contexts of one text are one row: ``again`` holds how far behind the first the others are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, tag, text, place, a, c, offsets, data in _shared(batches, copies.value, among.value):
            keep = np.flatnonzero(bitmap.lookup(asked.value, _asked_key(a, c, doc[text])))
            keep = keep[np.lexsort((place[keep], c[keep], a[keep], text[keep]))]
            text, place, a, c = text[keep], place[keep], a[keep], c[keep]
            new = np.ones(len(keep), bool)
            new[1:] = (text[1:] != text[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            at, behind = np.flatnonzero(new), np.flatnonzero(~new)
            shift = place[behind] - place[at[np.cumsum(new)[behind] - 1]]
            again = pa.ListArray.from_arrays(pa.array(np.searchsorted(behind, np.r_[at, len(keep)]).astype(np.int32)), pa.array(shift.astype(np.int32)))
            text, place, a = text[new], place[new], a[new]
            own = place - offsets[text]
            lo, hi = np.maximum(place - SIDE, offsets[text]), np.minimum(place + LEAST, offsets[text + 1])
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(doc[text]), pa.array(tag[text]), pa.array(own.astype(np.int32)), pa.array((place - lo).astype(np.int32)), pa.array([raw[i:j] for i, j in zip(lo, hi)], pa.binary()), again],
                names=["anchor", "doc", "tag", "place", "before", "bytes", "again"],
            )

    return run


class Block:
    """Contexts of whole anchors: the suffix array of those suffixes that share ``LEAST`` bytes with another text."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        col = lambda name: table.column(name).combine_chunks()
        self.anchor, self.doc, self.tag = (np.asarray(col(x)) for x in ("anchor", "doc", "tag"))
        self.start = np.asarray(col("place")).astype(np.int64) - np.asarray(col("before"))  # of the context in its text
        again = col("again")
        self.listed, self.shifts = np.asarray(again.offsets).astype(np.int64), np.asarray(again.values).astype(np.int64)
        offsets, data = offsets_and_bytes(col("bytes"))
        self.size = np.diff(offsets)
        m = len(self.size)
        self.bytes = np.zeros((m, WIDE), np.uint8)
        self.bytes[np.repeat(np.arange(m), self.size), np.arange(len(data)) - np.repeat(offsets[:-1], self.size)] = data

    def places(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into row, shift): each of the rows at its own place, and at those of its equals in the same text."""
        n = self.listed[row + 1] - self.listed[row]
        more = np.repeat(np.arange(len(row)), n)
        nth = np.arange(len(more)) - np.repeat(np.cumsum(n) - n, n)
        return np.r_[np.arange(len(row)), more], np.r_[np.zeros(len(row), np.int64), self.shifts[self.listed[row[more]] + nth]]

    def roots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, offset, group) of suffixes: groups share their first ``LEAST`` bytes, have two texts, and differ to their left."""
        m = len(self.size)
        up, down = powers(WIDE + 1)
        sums = np.zeros((m, WIDE + 1), np.uint64)
        np.cumsum(_CODE[self.bytes] * up[:WIDE], axis=1, out=sums[:, 1:])
        n = WIDE - LEAST + 1
        h = mixed((sums[:, LEAST:] - sums[:, :n]) * down[:n] + self.anchor.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
        fits = np.arange(n)[None, :] + LEAST <= self.size[:, None]
        row, at = np.nonzero(fits)
        h = h[row, at]
        order = np.argsort(h, kind="stable")
        row, at, h = row[order], at[order], h[order]
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1 if len(h) else np.zeros(0, np.int64)
        if not len(h):
            return row, at, group
        edges = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        doc = self.doc[row]
        left = np.where(at > 0, self.bytes[row, np.maximum(at - 1, 0)].astype(np.int64), -1)
        several = np.minimum.reduceat(doc, edges) != np.maximum.reduceat(doc, edges)
        diverse = (np.minimum.reduceat(left, edges) != np.maximum.reduceat(left, edges)) | (np.minimum.reduceat(left, edges) < 0)
        keep = (several & diverse)[group]
        return row[keep], at[keep], group[keep]

    def intervals(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, rows, offsets) of the maximal repeat groups: the intervals of the suffix array, by a stack scan."""
        row, at, group = self.roots()
        if not len(row):
            return
        # what stands behind the shared bytes: at most SIDE bytes, compared as big-endian words
        n = SIDE + 8 - SIDE % 8
        tail = np.zeros((len(row), n), np.uint8)
        rest = (self.size[row] - at - LEAST).astype(np.int64)
        for j in range(SIDE):
            has = rest > j
            tail[has, j] = self.bytes[row[has], at[has] + LEAST + j]
        words = tail.view(">u8").astype(np.uint64)
        order = np.lexsort([rest, *(words[:, j] for j in range(words.shape[1] - 1, -1, -1)), group])
        row, at, group, tail, rest = row[order], at[order], group[order], tail[order], rest[order]
        differ = tail[1:] != tail[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        lcp = np.zeros(len(row) + 1, np.int64)  # with the suffix before; 0 between groups and at the ends
        lcp[1:-1] = np.where(group[1:] == group[:-1], LEAST + np.minimum(common, np.minimum(rest[1:], rest[:-1])), 0)
        stack: list[tuple[int, int]] = []  # (length, first suffix) of the open intervals
        for i, length in enumerate(lcp.tolist()):
            first = i - 1
            while stack and stack[-1][0] > length:
                depth, first = stack.pop()
                yield depth, row[first:i], at[first:i]
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, first))

    def spans(self) -> pa.RecordBatch:
        """(doc, tag, start, end): bytes of a repeat group in texts other than those of its smallest document.

        All repeats of a context hold its middle, so those of one row are one span.
        """
        least, most = np.full(len(self.size), WIDE), np.zeros(len(self.size), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for length, row, at in self.intervals():
            doc = self.doc[row]
            later = doc > doc.min()
            if later.any():
                found.append((row[later], at[later], at[later] + length))
        if found:
            row, lo, hi = (np.concatenate(c) for c in zip(*found))
            np.minimum.at(least, row, lo)
            np.maximum.at(most, row, hi)
        hit = np.flatnonzero(most)
        which, shift = self.places(hit)
        row = hit[which]
        start = self.start[row] + shift
        cols = [self.doc[row], self.tag[row].astype(np.int32), (start + least[row]).astype(np.int32), (start + most[row]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "tag", "start", "end"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of whole anchors from rows sorted by anchor."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = np.asarray(batch.column(0))
        if held and count >= BLOCK_ROWS:
            last = held[-1].column(0)[-1].as_py()
            cutoff = int(np.searchsorted(anchor, last, "right"))
            held.append(batch.slice(0, cutoff))
            batch, anchor = batch.slice(cutoff), anchor[cutoff:]
            if not batch.num_rows:
                continue
            yield Block(held)
            held, count = [], 0
        # inside a long batch, end blocks where an anchor ends
        while len(anchor) > BLOCK_ROWS:
            cutoff = int(np.searchsorted(anchor, anchor[BLOCK_ROWS - 1], "right"))
            if cutoff == len(anchor):
                break
            held.append(batch.slice(0, cutoff))
            yield Block(held)
            held, count = [], 0
            batch, anchor = batch.slice(cutoff), anchor[cutoff:]
        held.append(batch)
        count += batch.num_rows
    if held:
        yield Block(held)


def _block_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        yield block.spans()


_SUFFIX = "key binary, doc long, tag int, start int"


def _block_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where strings of ``LEAST`` bytes begin that two texts have and that differ to their left: the suffixes that a repeat may begin with."""
    for block in _blocks(batches):
        row, at, _ = block.roots()
        for i in range(0, len(row), 20_000):
            r, o = row[i : i + 20_000], at[i : i + 20_000]
            key = pa.array([hashlib.blake2b(block.bytes[x, y : y + LEAST].tobytes(), digest_size=16).digest() for x, y in zip(r, o)], pa.binary())
            which, shift = block.places(r)
            start = (block.start[r] + o)[which] + shift
            yield pa.RecordBatch.from_arrays([key.take(pa.array(which)), pa.array(block.doc[r][which]), pa.array(block.tag[r][which]), pa.array(start.astype(np.int32))], names=[x.split()[0] for x in _SUFFIX.split(", ")])


_LONGER = "key binary, left int, more binary, doc long, tag int, start int"


def _with_bytes(length: int):
    """(doc, tag, text, suffixes): each suffix with the byte before it and with the ``length`` bytes behind its first ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, text, suffixes in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = text.encode()
                rows = [(s["key"], data[s["start"] - 1] if s["start"] else -1, data[s["start"] + length : s["start"] + 2 * length], doc, tag, s["start"]) for s in suffixes]
                for i in range(0, len(rows), 1 + (1 << 20) // length):
                    part = zip(*rows[i : i + 1 + (1 << 20) // length])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32()))], names=[x.split()[0] for x in _LONGER.split(", ")])

    return run


def _common(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differ.argmax()) if differ.any() else n


_GROUP = "length int, doc long, tag int, start int, occurrences array<struct<doc:bigint,start:bigint>>, key binary, again array<struct<doc:bigint,tag:int,start:int>>"


def _scan_intervals(length: int):
    """Stack scan of suffixes sorted by (key, more): the intervals that end inside ``more``, and those open at its end (``key``, ``again``)."""

    def keyed(rows: list[tuple]) -> Iterator[dict]:
        # lcp with the suffix before; -1 at both ends closes the interval of the key itself
        lcp = [-1, *(_common(a[2], b[2]) for a, b in zip(rows, rows[1:])), -1]
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate(lcp):
            first = i - 1
            while stack and stack[-1][0] > depth:
                common, first = stack.pop()
                held = rows[first:i]
                left = {r[1] for r in held}
                if len(held) < 2 or len({r[3] for r in held}) < 2 or (len(left) == 1 and -1 not in left):
                    continue  # one text only, or a longer repeat to the left says the same
                if common == length:
                    yield {"key": hashlib.blake2b(held[0][0] + held[0][2], digest_size=16).digest(), "again": [{"doc": r[3], "tag": r[4], "start": r[5]} for r in held]}
                else:
                    where = sorted((r[3], r[5]) for r in held)
                    yield {"length": length + common, "doc": held[0][3], "tag": held[0][4], "start": held[0][5], "occurrences": [{"doc": d, "start": s} for d, s in where]}
            if depth >= 0 and (not stack or stack[-1][0] < depth):
                stack.append((depth, first))

    kind = pa.schema([("length", pa.int32()), ("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("occurrences", pa.list_(pa.struct([("doc", pa.int64()), ("start", pa.int64())]))), ("key", pa.binary()), ("again", pa.list_(pa.struct([("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, same in itertools.groupby(rows, key=lambda r: r[0]):
            found = list(keyed(list(same)))
            if found:
                yield pa.RecordBatch.from_pylist(found, kind)

    return run


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All strings of ``LEAST`` bytes of the contexts: two hashes, and where."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = Block([batch])
        for first in range(WIDE - LEAST + 1):
            row = np.flatnonzero(block.size >= first + LEAST)
            part = [hashlib.blake2b(block.bytes[r, first : first + LEAST].tobytes(), digest_size=16).digest() for r in row]
            which, shift = block.places(row)
            row = row[which]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).take(pa.array(which)), pa.array(block.doc[row]), pa.array(block.tag[row]), pa.array((block.start[row] + shift + first).astype(np.int32))], names=["h", "doc", "tag", "start"])


class Repeats:
    """The steps that spans and groups share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.coalesce(F.col(text_col), F.lit(""))
        doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))
        rows = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), text.alias("text"), F.xxhash64(text).alias("h"))
        self.copies = bitmap.repeated(rows.select("h"), bitmap.bits_for(rows.count()))
        sha = F.sha2("text", 256)
        self.rows = cut(rows.select("id", "doc", sha.alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), bitmap.probe(self.copies, F.col("h")).alias("maybe")), "rows")
        total = self.rows.agg(F.sum("n_bytes")).first()[0] or 0
        again = rows.where(bitmap.probe(self.copies, F.col("h"))).groupBy(sha.alias("sha")).agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
        again = cut(again.select("doc", F.hash("text").alias("tag"), "text", F.lit(0).cast("long").alias("h"), F.lit(True).alias("sure")), "copies")
        alone = rows.select("doc", F.hash("text").alias("tag"), "text", "h", F.lit(False).alias("sure"))
        self.texts = alone.unionByName(again).where(F.octet_length("text") >= LEAST).select(*_TEXTS)
        self.twice = bitmap.repeated(self.texts, bitmap.bits_for(total // 16), of=_distinct_anchors(self.copies))
        parts = self.texts.mapInArrow(_partial_classes(self.copies, self.twice), _PAIR).repartition("anchor").sortWithinPartitions("anchor", "context")
        self.classes = cut(parts.mapInArrow(_classes, _CLASS), "classes")

    def _held(self, need: DataFrame, count: int) -> DataFrame:
        """The contexts of (anchor, context, doc)."""
        asked = bitmap.present(need, bitmap.bits_for(count), of=_keys(_asked_key, 3))
        # the anchors asked for are fewer than those that two texts may have: fewer false alarms
        few = bitmap.present(need.select("anchor"), bitmap.bits_for(count))
        return self.texts.mapInArrow(_contexts(self.copies, few, asked), _CONTEXT)

    def every_context(self) -> DataFrame:
        """Contexts of all members of all classes, of anchors that two documents have."""
        shared = self.classes.groupBy("anchor").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.max("more").alias("more")).where("low < high or more").select("anchor")
        found = self.texts.mapInArrow(_occurrences(self.copies, self.twice), _OCCURRENCE)
        need = cut(found.join(shared.hint("merge"), "anchor").select("anchor", "context", "doc").distinct(), "asked")
        return self._held(need, need.count())

    def contexts(self) -> tuple[DataFrame, DataFrame]:
        """Contexts of the first document of each class, of anchors with several classes: those for blocks, and those of hot anchors."""
        several = self.classes.where("several").select("anchor", "context", F.col("first").alias("doc"))
        held = self._held(several, several.count())
        hot = self.classes.where(F.col("nth") == HOT_CLASSES).select("anchor")
        if not hot.limit(1).count():
            return held, held.limit(0)
        held = cut(held, "contexts")
        return held.join(hot, "anchor", "left_anti"), held.join(hot, "anchor", "left_semi")

    def spans(self) -> DataFrame:
        """(doc, tag, start, end): bytes to remove, overlapping."""
        first = self.classes.where("more").select("anchor", "context", "first")
        wanted = bitmap.present(first, bitmap.bits_for(first.count()), of=_keys(_class_key, 2))
        few = bitmap.present(first.select("anchor"), bitmap.bits_for(first.count()))
        found = self.texts.mapInArrow(_occurrences(self.copies, few, wanted), _OCCURRENCE)
        whole = found.join(first.hint("merge"), ["anchor", "context"]).where("doc > first").select("doc", "tag", "start", (F.col("start") + F.col("size")).alias("end"))
        cool, hot = self.contexts()
        sorted_ = cool.repartition("anchor").sortWithinPartitions("anchor")
        spans = whole.unionByName(sorted_.mapInArrow(_block_spans, "doc long, tag int, start int, end int"))
        windows = hot.mapInArrow(_window_hashes, "h binary, doc long, tag int, start int")
        least = windows.groupBy("h").agg(F.min("doc").alias("least")).repartition(F.col("least"))
        return spans.unionByName(windows.join(least.hint("merge"), "h").where("doc > least").select("doc", "tag", "start", (F.col("start") + LEAST).alias("end")))


def _merged(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """(doc, tag, starts, ends): of each text, its spans (sorted by start) with those that overlap or touch made one."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    shift = (np.cumsum(new) - 1) << 33
    s, e = start + shift, np.maximum.accumulate(end + shift)
    first = np.ones(len(s), bool)
    first[1:] = new[1:] | (s[1:] > e[:-1])
    at = np.flatnonzero(first)
    last = np.r_[at[1:], len(s)] - 1
    places = pa.array(np.r_[np.flatnonzero(new[at]), len(at)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(places, pa.array(x)) for x in (start[at], e[last] - shift[last])]
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(tag[new]), *lists], names=["doc", "tag", "starts", "ends"])


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged spans per text, from rows sorted by (doc, tag, start); the last text of a batch waits for the next."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(4)]
        cols[2], cols[3] = cols[2].astype(np.int64), cols[3].astype(np.int64)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        done = int(other[-1]) + 1 if len(other) else 0
        if done:
            yield _merged(*(c[:done] for c in cols))
        held = [c[done:] for c in cols]
    if held is not None:
        yield _merged(*held)


def _packed(copies, hit):
    """(doc, tag, n, packed): the compressed bytes of the texts (doc, tag, text, h, sure, key) that take part and whose key is hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in _alone(batches, copies.value):
            batch = batch.filter(pa.array(bitmap.lookup(hit.value, np.asarray(batch.column(5)))))
            offsets, data = offsets_and_bytes(batch.column(2))
            raw = data.tobytes()
            packed = [codec.compress(raw[i:j], asbytes=True) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.array(packed, pa.binary())], names=["doc", "tag", "n", "packed"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text (doc, n, packed, starts, ends), the digests before and after its spans are removed."""
    codec = pa.Codec("zstd")
    for batch in batches:
        before, after = [], []
        for n, packed, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            data = codec.decompress(packed, n, asbytes=True)
            kept = b"".join(data[e:s] for e, s in zip([0, *ends], [*starts, len(data)]))
            before.append(hashlib.sha256(data).hexdigest())
            after.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.string()), batch.column(3), batch.column(4), pa.array(after, pa.string())], names=["doc", "sha", "starts", "ends", "kept_sha"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, spans (start, end) to remove, kept_sha256 of the bytes that stay."""
    job = Repeats(docs, id_col, text_col)
    merged = job.spans().repartition("doc", "tag").sortWithinPartitions("doc", "tag", "start")
    spans = cut(merged.mapInArrow(_merge_spans, "doc long, tag int, starts array<long>, ends array<long>"), "spans")
    hit = bitmap.present(spans.select(F.xxhash64("doc")), bitmap.bits_for(spans.count()))
    touched = job.texts.withColumn("key", F.xxhash64("doc")).mapInArrow(_packed(job.copies, hit), "doc long, tag int, n long, packed binary")
    touched = touched.join(spans.hint("merge"), ["doc", "tag"]).select("doc", "n", "packed", "starts", "ends")
    done = cut(touched.mapInArrow(_apply, "doc long, sha string, starts array<long>, ends array<long>, kept_sha string"), "applied")
    spanned = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    done = done.select("doc", "sha", spanned.alias("spans"), "kept_sha")

    # of equal texts, those behind the first go whole
    first = job.rows.where("maybe").groupBy("sha").agg(F.min("doc").alias("first")).repartition(F.col("first"))
    copies = job.rows.where("maybe").join(first.hint("merge"), "sha")
    rows = job.rows.where("not maybe").withColumn("first", F.col("doc")).unionByName(copies.select(*job.rows.columns, "first"))
    lost = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= LEAST)
    gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    whole = rows.where(lost).select("id", "n_bytes", gone.alias("spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    others = rows.where(~lost).join(done.hint("merge"), ["doc", "sha"], "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    others = others.select("id", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
    return whole.unionByName(others).withColumnRenamed("id", id_col)


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat, length, occurrences): all maximal repeat groups of ``LEAST`` bytes or more, of any length, with every occurrence.

    A group is a string that two different texts have at least, that not all its occurrences have the same byte before, nor the same
    byte behind (the ends of a text are unlike any byte).

    The suffixes that begin with a string of ``LEAST`` bytes that texts share (and that differ to their left) are sorted by the bytes behind
    it; each round doubles the bytes read: a stack scan gives the intervals that end inside them, those still open go on. So
    bytes travel only for suffixes of repeats at least half as long. A group's list of occurrences is one row and has to fit in one.
    """
    job = Repeats(docs, id_col, text_col)
    sorted_ = job.every_context().repartition("anchor").sortWithinPartitions("anchor")
    open_ = cut(sorted_.mapInArrow(_block_seeds, _SUFFIX).dropDuplicates(["doc", "tag", "start"]), "suffixes")
    texts = job.texts.where(F.col("sure") | ~bitmap.probe(job.copies, F.col("h"))).select("doc", "tag", "text")
    length, found = LEAST, None
    while found is None or open_.limit(1).count():
        asked = open_.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "start")).alias("suffixes"))
        longer = texts.join(asked.hint("merge"), ["doc", "tag"]).select("doc", "tag", "text", "suffixes").mapInArrow(_with_bytes(length), _LONGER)
        scanned = cut(longer.repartition("key").sortWithinPartitions("key", "more").mapInArrow(_scan_intervals(length), _GROUP), "intervals")
        closed = scanned.where("length is not null").select("length", "doc", "tag", "start", "occurrences")
        found = closed if found is None else found.unionByName(closed)
        open_ = cut(scanned.where("length is null").select("key", F.explode("again").alias("s")).select("key", "s.doc", "s.tag", "s.start"), "suffixes")
        length *= 2
    # the strings themselves, from one occurrence each
    held = found.join(texts.hint("merge"), ["doc", "tag"])
    return held.select(F.encode("text", "UTF-8").alias("bytes"), "start", "length", "occurrences").select(F.expr("substring(bytes, start + 1, length)").alias("repeat"), "length", "occurrences")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
