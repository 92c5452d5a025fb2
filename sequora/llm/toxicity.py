"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Texts become symbols: letters without case, a few classes of accented letters, and a gap for all else. Signs inside
a word are left out and single letters with gaps between them are run together, so "i-d-i-o-t" and "i d i o t" are
"idiot". A fragment is one word with the gap before and behind it. The kernel of two fragments counts the
subsequences of ``ORDER`` symbols that they share, at most one symbol skipped between two of them; each skip costs a factor
``DECAY``. It is divided by the root of both fragments' kernels with themselves, so a fragment has kernel 1 with itself.

Training takes a bounded sample of labelled texts (``TRAIN_ROWS``, a documented parameter). Their distinct sentences inherit the label; a
fragment's sentences are counted on the cluster. Fragments that occur in clearly more sentences of toxic texts than of others
(a test of chance, so the machine starts from a word list that it learned) are the positive examples, fragments of clean
texts the negative ones. The driver gets at most ``POOL`` fragments of each kind, the commonest, of at most ``LONGEST`` symbols; longer ones
don't teach but are scored like others. Landmarks are drawn from both; kernel values with the landmarks, whitened by the landmark matrix
(Nystroem), feed a linear support vector machine. As kernel values are inner products, the trained machine is one
weight per subsequence: a table of 2**20 numbers (4 MB, whatever the corpus), broadcast to all tasks. So each
fragment of each text gets its exact decision value by summing table entries, once for each distinct fragment of a slice. A text's
score is the logistic of its largest decision value, fitted on the training texts, which are scored where they are.

Null and empty texts have the score of a text without fragments, near 0. Ids may repeat or be null (a null id is not held out
and teaches nothing; of rows that share an id one teaches); equal texts have equal scores. Without labels of both kinds every score
is 0. An empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.llm.arrow_text import slices
from sequora.llm.shingles import mixed, powers
from sequora.llm.store import cut, small_batches

ORDER, DECAY = 4, 0.6
TRAIN_ROWS = 4000
LANDMARKS = 384
EXAMPLES = 6000
ROUNDS = 5
#: Fragments of each kind that reach the driver, and symbols of the longest that teaches: some MB at most.
POOL, LONGEST = 100_000, 64
#: Symbols between which the kernel may skip one: offsets of the three later symbols, and the weight.
_PATTERNS = [((o1 := 1 + g[0]), (o2 := o1 + 1 + g[1]), o2 + 1 + g[2], DECAY ** sum(g)) for g in product((0, 1), repeat=ORDER - 1)]
_GAP, _SIGN, _DROP = 0, 32, 33
_CODE = np.random.default_rng(6).integers(1, 2**63, 64, dtype=np.uint64)


def _symbols() -> np.ndarray:
    table = np.full(256, _SIGN, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = _GAP
    for b in range(26):
        table[65 + b] = table[97 + b] = b + 1
    for digit, letter in zip(b"013457", b"oieast"):  # fixed values: digits that stand for letters
        table[digit] = letter - 96
    for b in range(0x80, 0xC0):  # the second byte of an accented letter, without case
        table[b] = 27 + (b | 0x20) % 5
    table[0xC0:] = _DROP
    return table


_SYMBOL = _symbols()


def symbols(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, symbols) with one gap before and behind each text."""
    n = len(offsets) - 1
    held = np.zeros(len(data) + 2 * n, np.uint8)
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1
    held[at] = _SYMBOL[data]
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    keep = held != _DROP
    held, owner = held[keep], owner[keep]
    letter = (held > 0) & (held < 32)
    inside = np.zeros(len(held), bool)
    inside[1:-1] = (held[1:-1] == _SIGN) & letter[:-2] & letter[2:]
    held, owner = held[~inside], owner[~inside]
    held[held == _SIGN] = _GAP
    # runs of gaps are one gap; then gaps between single letters go
    double = np.zeros(len(held), bool)
    double[1:] = (held[1:] == 0) & (held[:-1] == 0) & (owner[1:] == owner[:-1])
    held, owner = held[~double], owner[~double]
    lone = np.zeros(len(held), bool)
    lone[2:-2] = (held[2:-2] == 0) & (held[:-4] == 0) & (held[4:] == 0) & (held[1:-3] > 0) & (held[3:-1] > 0)
    held, owner = held[~lone], owner[~lone]
    return np.searchsorted(owner, np.arange(n + 1)), held


#: Distinct fragments whose values a task remembers; when it knows more, it starts anew.
REMEMBERED = 1 << 19


class Known:
    """Values of the fragments that a task has met: sorted hashes and values, and what came since they were last sorted. A corpus repeats its words."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def _settled(self) -> None:
        if self.waiting > max(4096, len(self.hashes) // 4):
            kept = len(self.hashes) + self.waiting <= REMEMBERED
            h, v = (np.concatenate(x) for x in zip(*([(self.hashes, self.values)] if kept else []), *self.fresh))
            self.hashes, at = np.unique(h, return_index=True)
            self.values, self.fresh, self.waiting = v[at], [], 0

    def of(self, held: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The value of each fragment [first, last]; only fragments that are new are joined by their gaps and scored."""
        sums = np.zeros(len(held) + 1, np.uint64)
        up, down = powers(len(held) + 1)
        np.cumsum(_CODE[held] * up[: len(held)], out=sums[1:])
        h = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        h, one, which = np.unique(h, return_index=True, return_inverse=True)
        values = np.zeros(len(h), np.float32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            met = self.hashes[at] == h
            values[met] = self.values[at[met]]
        else:
            met = np.zeros(len(h), bool)
        one = one[~met]
        if len(one):
            size = last[one] - first[one]  # with the gap before, without the one behind
            at = np.repeat(first[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            values[~met] = _values(self.table, np.append(held[at], np.uint8(_GAP)))
            self.fresh.append((h[~met], values[~met]))
            self.waiting += len(one)
            self._settled()
        return values[which]


def _values(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Of fragments joined by their gaps, the inner product with the table over the norm."""
    gaps = np.flatnonzero(s == _GAP)
    owner = np.repeat(np.arange(len(gaps) - 1), np.diff(gaps))
    n = len(gaps) - 1
    ends, s = gaps[1:][owner], s.astype(np.int64)
    keys, weights = [], []
    place = np.arange(len(owner))
    for o1, o2, o3, w in _PATTERNS:
        at = place[: max(0, len(s) - o3)]
        at = at[at + o3 <= ends[at]]
        keys.append(owner[at] << 20 | ((s[at] << 5 | s[at + o1]) << 5 | s[at + o2]) << 5 | s[at + o3])
        weights.append(np.full(len(at), w))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    if not len(keys):
        return np.zeros(n, np.float32)
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    weights, keys = np.add.reduceat(weights, new), keys[new]
    fragment = keys >> 20
    total = np.bincount(fragment, weights * table[keys & 0xFFFFF], n)
    return (total / np.sqrt(np.maximum(np.bincount(fragment, weights * weights, n), 1e-12))).astype(np.float32)


def decisions(known: Known, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, value) of each fragment: its inner product with the table, over its norm."""
    gaps = np.flatnonzero(held == _GAP)
    first, last = gaps[:-1], gaps[1:]
    real = last - first > 1
    first, last = first[real], last[real]
    if not len(first):
        return first, np.zeros(0, np.float32)
    return first, known.of(held, first, last)


def features(fragment: bytes) -> Counter:
    """Weighted subsequences of one fragment (symbols with its two gaps), of norm 1."""
    out: Counter = Counter()
    for o1, o2, o3, w in _PATTERNS:
        for i in range(len(fragment) - o3):
            out[((fragment[i] << 5 | fragment[i + o1]) << 5 | fragment[i + o2]) << 5 | fragment[i + o3]] += w
    norm = np.sqrt(sum(v * v for v in out.values()) or 1.0)
    return Counter({k: v / norm for k, v in out.items()})


def kernel(rows: list[Counter], landmarks: list[Counter]) -> np.ndarray:
    """Kernel values of rows and landmarks."""
    index = {k: i for i, k in enumerate(sorted(set().union(*landmarks)))}
    held = np.zeros((len(index), len(landmarks)))
    for j, f in enumerate(landmarks):
        for k, v in f.items():
            held[index[k], j] = v
    out = np.zeros((len(rows), len(landmarks)))
    for i, f in enumerate(rows):
        shared = [(index[k], v) for k, v in f.items() if k in index]
        if shared:
            at, v = zip(*shared)
            out[i] = np.array(v) @ held[list(at)]
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weighted squared hinge loss and a ridge: Newton steps over the examples inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    punish = np.full(x.shape[1], ridge)
    punish[-1] = ridge * 1e-2

    def loss(v: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() + (punish * v * v).sum())

    now = loss(w)
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa = x[active] * weight[active, None]
        step = np.linalg.solve(xa.T @ x[active] + np.diag(punish), xa.T @ y[active]) - w
        scale = 1.0
        while scale > 1e-4 and loss(w + scale * step) > now:
            scale /= 2
        new = loss(w + scale * step)
        if new > now * (1 - 1e-7):
            break
        w, now = w + scale * step, new
    return w[:-1], float(w[-1])


def _fragments(texts: list[str]) -> list[set[bytes]]:
    """Of each text, its distinct fragments."""
    out = []
    for _, _, offsets, data in slices(pa.array(texts, pa.string())):
        at, held = symbols(offsets, data)
        for lo, hi in zip(at[:-1], at[1:]):
            out.append({b"\0" + w + b"\0" for w in held[lo:hi].tobytes().split(b"\0") if w})
    return out


def _sigmoid_fit(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic of the decision value: slope and offset, by Newton steps with a small ridge that never raise the loss."""
    x = np.c_[f, np.ones(len(f))]
    ridge = np.array([1e-2, 1e-4])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (x @ v)).sum() + (ridge * v * v).sum() / 2)

    v = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * v)
        scale = 1.0
        while scale > 1e-6 and loss(v + scale * step) > loss(v):
            scale /= 2
        if loss(v) - loss(v + scale * step) < 1e-9:
            break
        v = v + scale * step
    return float(v[0]), float(v[1])


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fragment, sentence, label) of texts (doc_id, text, label): a sentence is a hash of its words, so that copies teach once."""
    for batch in batches:
        for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            said = list({part.strip() for part in re.split(r"[.!?\n]+", text)} - {""})
            for i in range(0, len(said), 500):
                rows = [(w, hash_of(s), label) for s, found in zip(said[i : i + 500], _fragments(said[i : i + 500])) for w in found if len(w) <= LONGEST + 2]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int32()))], names=["fragment", "sentence", "label"])


def hash_of(sentence: str) -> int:
    return int.from_bytes(hashlib.blake2b(sentence.encode(), digest_size=8).digest(), "little", signed=True)


def vocabulary(sample: DataFrame) -> tuple[Counter, Counter, list[int]]:
    """Sentences that hold each fragment, of toxic and of clean texts; and how many sentences there are."""
    taught = cut(sample.mapInArrow(_taught, "fragment binary, sentence long, label int"), "taught")
    n = {r.label: r.n for r in taught.groupBy("label").agg(F.countDistinct("sentence").alias("n")).collect()}
    each = taught.distinct().groupBy("fragment").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    toxic, clean = Counter(), Counter()
    for kind in ("toxic", "clean"):
        for r in each.where(F.col(kind) > 0).orderBy(F.desc(kind), "fragment").limit(POOL).toLocalIterator():
            toxic[bytes(r.fragment)], clean[bytes(r.fragment)] = r.toxic, r.clean
    return +toxic, +clean, [n.get(1, 0), n.get(0, 0)]


def train(toxic: Counter, clean: Counter, n: list[int], seed: int = 7) -> dict | None:
    """The machine: table and bias; nothing where no fragment tells toxic texts from others."""
    rng = np.random.default_rng(seed)
    # positive: so many of its sentences are toxic that chance gives it less than once in 10,000 words
    share = n[0] / max(1, sum(n))
    odds = {w: k * np.log(1 / share) - sum(np.log((k + i) / i) for i in range(1, clean[w] + 1)) for w, k in toxic.items() if k >= 3 and clean[w] < k}
    positive = sorted((w for w, z in odds.items() if z > np.log(1e4)), key=lambda w: (-odds[w], w))[: EXAMPLES // 3]
    if not positive or not clean:
        return None
    # negative: the commonest clean fragments and a draw of others, then, round by round, those that the machine
    # takes for toxic; a text's score is the largest of hundreds of fragments, so the hard ones matter
    pool = sorted(set(clean) - set(positive))
    said = np.frombuffer(b"\0" + b"\0".join(w[1:-1] for w in pool) + b"\0", np.uint8)
    common = sorted(pool, key=lambda w: (-clean[w], w))[: EXAMPLES // 6]
    negative = list(dict.fromkeys(common + [pool[i] for i in rng.permutation(len(pool))[: EXAMPLES // 6]]))
    # each with two copies that have a letter put in, in the middle and elsewhere: they count half as much
    shown = positive + [x for w in positive for x in inserted(w, rng)]
    known = {w: features(w) for w in shown}
    seen = np.array([toxic[w] for w in positive], float)
    seen = np.r_[seen, np.repeat(seen / 4, 2)]
    hard: list[bytes] = []
    for _ in range(ROUNDS):
        known.update((w, features(w)) for w in negative if w not in known)
        names = shown + negative
        rows = [known[w] for w in names]
        target = np.r_[np.ones(len(shown)), -np.ones(len(negative))]
        weight = np.r_[0.5 * seen / seen.sum(), np.full(len(negative), 0.5 / len(negative))]
        rest = [w for w in negative if w not in set(hard)]
        marks = [known[w] for w in (positive[: LANDMARKS // 2] + hard[: LANDMARKS // 3] + rest)[:LANDMARKS]]
        w, bias = linear_svm(nystroem(rows, marks, whiten := whitening(marks)), target, weight)
        table = np.zeros(1 << 20, np.float32)
        for b, f in zip(whiten @ w, marks):
            for k, v in f.items():
                table[k] += b * v
        value = decisions(Known(table), said)[1] + bias
        worst = np.argsort(-value, kind="stable")[: EXAMPLES // 3]
        hard = [pool[i] for i in worst if value[i] > -0.9]
        negative = list(dict.fromkeys(negative + hard))[-EXAMPLES:]
    return {"table": table, "bias": bias}


def inserted(fragment: bytes, rng: np.random.Generator) -> list[bytes]:
    """Two copies of a fragment with one letter more."""
    middle, elsewhere = len(fragment) // 2, int(rng.integers(2, max(3, len(fragment) - 1)))
    return [fragment[:i] + bytes([int(rng.integers(1, 27))]) + fragment[i:] for i in (middle, elsewhere)]


def whitening(marks: list[Counter]) -> np.ndarray:
    """The landmark matrix to the power -1/2, on its sound part."""
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    sound = values > 1e-6 * values.max()
    return vectors[:, sound] / np.sqrt(values[sound])


def nystroem(rows: list[Counter], marks: list[Counter], whiten: np.ndarray) -> np.ndarray:
    """Features whose inner products approach the kernel; between landmarks they give it."""
    return kernel(rows, marks) @ whiten


def fit(docs: DataFrame, labels: DataFrame):
    """Broadcast model, trained on a bounded sample of the labelled rows that are not held out."""
    context = docs.sparkSession.sparkContext
    sample = cut(training_texts(docs, labels, "toxic", TRAIN_ROWS), "sample")
    flat = {"table": np.zeros(1 << 20, np.float32), "bias": 0.0, "slope": 0.0, "offset": -30.0}
    machine = train(*vocabulary(sample))
    if machine is None:
        return context.broadcast(flat)
    held = context.broadcast(machine)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(held.value["table"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best_values(held.value, known, batch.column(1)), pa.float64())], names=["doc_id", "label", "value"])

    rows = sorted((r.doc_id, r.label, r.value) for r in sample.mapInArrow(values, "doc_id string, label int, value double").collect())
    slope, offset = _sigmoid_fit(np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float))
    return context.broadcast(machine | {"slope": slope, "offset": offset})


#: Decision value of a text without fragments.
NOTHING = -3.0


def best_values(model: dict, known: Known, column: pa.Array) -> list[float]:
    """The largest decision value of each text."""
    out: list[float] = []
    for _, _, offsets, data in slices(column):
        at, held = symbols(offsets, data)
        first, value = decisions(known, held)
        best = np.full(len(at) - 1, NOTHING)
        if len(first):
            owner = np.searchsorted(at, first, "right") - 1
            np.maximum.at(best, owner, value + model["bias"])
        out += best.tolist()
    return out


def probability(model: dict, values: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["slope"] * np.array(values, float) + model["offset"], -30, 30)))


def held_out(id_col: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_texts(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of a bounded sample of the labelled rows that may teach: the least by a hash, half of each label at most.

    Only ids are compared for it; the texts of the sample come by a join with at most ``rows`` ids. Of rows that share an id one
    teaches; of differing labels of an id the larger holds.
    """
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    halves = [known.where(F.col("label") == k).orderBy(*order).limit(rows // 2) for k in (0, 1)]
    ids = F.broadcast(halves[0].unionByName(halves[1]))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("best"))
    return one.select(F.col("doc_id").cast("string").alias("doc_id"), "best.text", "best.label")


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.value["table"])
        for batch in batches:
            p = probability(model.value, best_values(model.value, known, batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(small_batches(docs), labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_score(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
