"""Phrase collocation mining over a prefix-free parse.

A text is a sequence of words; pairs of neighbouring words whose hash is a multiple of ``EVERY`` are triggers. Each trigger starts a chunk
that runs to the next one and ``LONGEST - 1`` words beyond it, so chunks overlap and the same passage falls into the same chunks wherever it
stands. Equal chunks become one row of a dictionary with the number of times they occur. A chunk owns the n-grams that start before its
successor does; those of the overlap belong to the successor: each occurrence is counted once, weighted by its chunk's frequency.

Counting goes level by level over the dictionary, as a phrase that is frequent has frequent parts only: words, then pairs of frequent
words and triples of frequent pairs, by 64-bit hashes that are summed over the cluster; then, by their own words, what may be frequent, with quadruples of frequent triples. What is
frequent goes from one level to the next as a bitmap of bounded size (``bitmap.MAX_BITS``): where it says yes too often, more
phrases are counted that turn out to be rare, none is lost. Tasks add equal phrases up before the shuffle (two that share a 64-bit hash, with a chance of
2**-64, would count as one there); the counts that decide are sums over equal words.

Null and empty texts have no words. A null language is ``und``. Ids are not read: repeated rows count as often as they stand there. Texts may be of any
length: a text without triggers is one chunk. Equal scores are ordered by count, then by the phrase's bytes. An empty table
gives an empty result. Columns other than ``text`` and ``lang`` are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequora.llm import bitmap
from sequora.llm.arrow_text import offsets_and_bytes, slices
from sequora.llm.shingles import _CODE, _MIX, mixed, powers
from sequora.llm.store import cut, small_batches

LONGEST, LEAST, TOP = 4, 30, 2000
#: One pair of words in so many starts a chunk.
EVERY = 16
#: n-grams that a task holds before it adds them up and gives them away.
HELD = 1 << 21
#: Tasks that rank a language's phrases before the last one gets their firsts.
SALTS = 64

#: What a byte is: 0 a word's, 1 white space, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
#: Bytes as a chunk holds them: lower case, one sign for each kind of gap.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[0x09] = 0x20
_PLAIN[_KIND == 2] = 0x0A


class Words:
    """The words of some rows: first and last byte, row, piece (a number that grows) and hash."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        n = len(data)
        kind = _KIND[data]
        inside = kind == 0
        start = np.zeros(n + 1, bool)
        start[offsets] = True
        cuts = np.cumsum((kind == 2) | start[:n])
        first = np.flatnonzero(inside & (start[:n] | ~np.r_[False, inside[:-1]]))
        last = np.flatnonzero(inside & (start[1:] | ~np.r_[inside[1:], False])) + 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * up[:n], out=sums[1:])
        self.first, self.last = first, last
        self.hash = mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * _MIX[8])
        self.piece = cuts[first] if len(first) else first
        self.at = np.searchsorted(first, offsets)

    def __len__(self) -> int:
        return len(self.first)


def chunks(offsets: np.ndarray, data: np.ndarray, every: int = EVERY) -> Iterator[tuple[int, int, int, int]]:
    """(row, first byte, end byte, words owned) of each chunk; a row without words has none."""
    w = Words(offsets, data)
    starts = np.zeros(len(w), bool)
    if len(w) > 1:
        starts[:-1] = mixed(w.hash[:-1] * _MIX[0] + w.hash[1:] * _MIX[1]) % np.uint64(every) == 0
    begin, end = w.at[:-1], w.at[1:]
    ends = end[end > begin]
    starts[ends - 1] = False  # the last word of a row has no neighbour
    starts[begin[end > begin]] = True
    at = np.flatnonzero(starts)
    row = np.searchsorted(end, at, "right")
    stop = np.r_[at[1:], len(w)]
    stop = np.minimum(stop, end[row])
    beyond = np.minimum(stop + LONGEST - 1, end[row])
    yield from zip(row.tolist(), w.first[at].tolist(), w.last[beyond - 1].tolist(), (stop - at).tolist())


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", every: int = EVERY) -> DataFrame:
    """(lang, owned, chunk, n): distinct chunks of each language and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for lo, _, offsets, data in slices(batch.column(1)):
                plain = _PLAIN[data]
                held = plain.tobytes()
                rows, owned, parts = [], [], []
                for row, a, b, n in chunks(offsets, plain, every):
                    rows.append(lo + row)
                    owned.append(n)
                    parts.append(held[a:b])
                if rows:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(owned, pa.int32()), pa.array(parts, pa.binary())], names=["lang", "owned", "chunk"])

    rows = small_batches(docs).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, owned int, chunk binary").groupBy("lang", "owned", "chunk").agg(F.count(F.lit(1)).alias("n"))


class Grams:
    """The n-grams that the chunks of some dictionary rows own: hashes with their language, where they are, and their weights."""

    def __init__(self, langs: pa.Array, owned: np.ndarray, weights: np.ndarray, offsets: np.ndarray, data: np.ndarray):
        self.words, self.data = Words(offsets, data), data
        codes = pa.array(langs).dictionary_encode()
        places, letters = offsets_and_bytes(codes.dictionary)
        self.names = codes.dictionary
        self.lang = np.asarray(codes.indices)
        salt = np.array([int(mixed((_CODE[letters[a:b]] * powers(b - a + 1)[0][: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * _MIX[13])[0]) for a, b in zip(places[:-1], places[1:])], np.uint64)
        w = self.words
        self.row = np.repeat(np.arange(len(owned)), np.diff(w.at))
        self.salt = salt[self.lang[self.row]] if len(w) else np.zeros(0, np.uint64)
        self.owned = np.arange(len(w)) - w.at[:-1][self.row] < owned[self.row]
        self.weight = weights[self.row]

    def places(self, k: int) -> np.ndarray:
        """Where an n-gram of ``k`` words starts that stays inside a piece and is owned."""
        w, n = self.words, len(self.words)
        if n < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.owned[: n - k + 1] & (w.piece[: n - k + 1] == w.piece[k - 1 :]))

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        total = self.salt[at] + _MIX[9:10] * np.uint64(k)
        for i in range(k):
            total += self.words.hash[at + i] * _MIX[3 + i]
        return mixed(total)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    """Slices of dictionary batches (lang, owned, chunk, n)."""
    for batch in batches:
        owned, weights = np.asarray(batch.column(1)), np.asarray(batch.column(3))
        for lo, hi, offsets, data in slices(batch.column(2)):
            yield Grams(batch.column(0).slice(lo, hi - lo), owned[lo:hi], weights[lo:hi], offsets, data)


def _summed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, weights) with equal hashes added up, ``HELD`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        h, w = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, w = h[order], w[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[at], np.add.reduceat(w, at)

    for h, w in parts:
        if len(h):
            held.append((h, w))
            n += len(h)
        if n >= HELD:
            yield added()
            held, n = [], 0
    if n:
        yield added()


class Texts:
    """n-grams of a task with their words, added up by hash: language, words joined by a space, number of words, weight."""

    def __init__(self):
        self.slices: list[tuple[bytes, list]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, g: Grams, picked: Iterator[tuple[np.ndarray, int]]) -> None:
        w, here = g.words, len(self.slices)
        self.slices.append((g.data.tobytes(), g.names.to_pylist()))
        for at, k in picked:
            first, last = (w.first[at], w.last[at + k - 1]) if k else (np.zeros(len(at), np.int64),) * 2
            self.parts.append((g.hashes(at, k), g.weight[at], g.lang[g.row[at]], np.full(len(at), here), first, last, np.full(len(at), k)))
            self.size += len(at)

    def given(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = [np.concatenate(x) for x in zip(*self.parts)]
            order = np.argsort(columns[0], kind="stable")
            h, n = columns[0][order], columns[1][order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sums = np.add.reduceat(n, at)
            lang, source, first, last, k = (c[order[at]] for c in columns[2:])
            for lo in range(0, len(at), 1 << 14):
                some = slice(lo, lo + (1 << 14))
                texts = [self.slices[i][0][a:b] for i, a, b in zip(source[some].tolist(), first[some].tolist(), last[some].tolist())]
                names = [self.slices[i][1][j] for i, j in zip(source[some].tolist(), lang[some].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([re.sub(b" +", b" ", x) if b"  " in x else x for x in texts], pa.binary()).cast(pa.string()), pa.array(k[some], pa.int32()), pa.array(sums[some])],
                    names=["lang", "phrase", "k", "n"],
                )
        self.__init__()


TEXTS = "lang string, phrase string, k int, n long"
def _texts(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """The phrases that ``wanted`` picks: (places, number of words) of each slice."""
    held = Texts()
    for g in _grams(batches):
        held.add(g, wanted(g))
        if held.size >= HELD // 2:
            yield from held.given()
    yield from held.given()


def _frequent(parse: DataFrame, picked, least: int, name: str):
    """Bitmap of the n-grams that occur ``least`` times or more, by hash; ``picked`` gives those of a slice: (places, number of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, w in _summed((g.hashes(at, k), g.weight[at]) for g in _grams(batches) for at, k in picked(g)):
            for lo in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[lo : lo + (1 << 16)].view(np.int64)), pa.array(w[lo : lo + (1 << 16)])], names=["h", "n"])

    found = cut(parse.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), name)
    return bitmap.present(found, bitmap.bits_for(found.count()))


def _in(bits, g: Grams, at: np.ndarray, k: int) -> np.ndarray:
    """For each word of a slice, whether an n-gram that starts at ``at`` is in the bitmap."""
    out = np.zeros(len(g.words) + LONGEST, bool)
    out[at] = bitmap.lookup(bits.value, g.hashes(at, k).view(np.int64))
    return out


def counts(parse: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, k, n): phrases of 1 to ``LONGEST`` words that occur ``least`` times or more; and for each language a row with k = 0 that counts all words."""
    word_bits = _frequent(parse, lambda g: [(g.places(1), 1)], least, "words")

    def pairs(g: Grams) -> list[tuple[np.ndarray, int]]:
        good, at = _in(word_bits, g, np.arange(len(g.words)), 1), g.places(2)
        return [(at[good[at] & good[at + 1]], 2)]

    pair_bits = _frequent(parse, pairs, least, "pairs")

    def both(bits, g: Grams, k: int) -> np.ndarray:
        """Where an n-gram of ``k`` words starts, both of whose longest parts are frequent. Parts that the next chunk owns count, too."""
        n = len(g.words)
        inside = np.flatnonzero(g.words.piece[: max(0, n - k + 2)] == g.words.piece[k - 2 :]) if n > k - 2 else np.zeros(0, np.int64)
        good, at = _in(bits, g, inside, k - 1), g.places(k)
        return at[good[at] & good[at + 1]]

    triple_bits = _frequent(parse, lambda g: [(both(pair_bits, g, 3), 3)], least, "triples")

    def wanted(g: Grams) -> Iterator[tuple[np.ndarray, int]]:
        yield g.places(1), 0
        for k, bits in ((1, word_bits), (2, pair_bits), (3, triple_bits)):
            at = g.places(k)
            yield at[_in(bits, g, at, k)[at]], k
        yield both(triple_bits, g, 4), 4

    texts = parse.mapInArrow(lambda it: _texts(it, wanted), TEXTS)
    return cut(texts.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("k") > 0, least).otherwise(0)), "phrases")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score) of each phrase of two words or more: the lowest-scoring cut, ties to the shortest first part."""
    parts = found.where("k >= 2").withColumn("w", F.split("phrase", " "))
    cut_at = lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", F.lit(1), i), " ").alias("head"), F.array_join(F.slice("w", i + 1, F.col("k") - i), " ").alias("tail"))
    cuts = parts.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), cut_at)).alias("c")).select("lang", "phrase", "k", "a", "c.*")
    counted = found.where("k between 1 and 3")
    both = cuts.join(counted.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(counted.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    # decimals of 38 digits: 2,000,000 * a and l + r may pass 64 bits
    score = F.expr("cast((cast(2000000 as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    return both.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "at", "l", "r")).alias("m")).select("lang", "phrase", "k", "a", "m.l", "m.r", "m.score")


def covered(found: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, phrase): phrases that some longer one holds, which occurs at least ``percent`` % as often."""
    longer = found.where("k >= 3").withColumn("w", F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))))
    inner = longer.select("lang", "n", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return found.where("k >= 2").join(inner, ["lang", "phrase"]).where(wide("longer") * 100 >= wide("n") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", every: int = EVERY) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, count and bytes."""
    parse = cut(dictionary(docs, text, lang, every), "parse")
    found = counts(parse, least)
    kept = scored(found).join(covered(found), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = F.broadcast(found.where("k = 0").select("lang", F.col("n").alias("n")))  # a row for each language
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, {LONGEST + 1})) AS u(k), unnest(range(1, len(w) - k + 2)) AS v(i)),
 f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
 totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY ALL),
 c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k >= 2 AND n >= {LEAST}),
 cuts AS (SELECT c.lang, c.k, c.phrase, c.a, i, x.n AS l, y.n AS r, ((2000000::HUGEINT * c.a) // (x.n::HUGEINT + y.n))::BIGINT AS score
          FROM c, unnest(range(1, c.k)) AS u(i) JOIN f x ON x.lang = c.lang AND x.k = i AND x.phrase = array_to_string(c.w[1:i], ' ')
          JOIN f y ON y.lang = c.lang AND y.k = c.k - i AND y.phrase = array_to_string(c.w[i + 1:], ' ')),
 best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
 inner_of AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(2, c.k)) AS u(s), unnest(range(1, c.k - s + 2)) AS v(i) GROUP BY ALL),
 kept AS (SELECT b.* FROM best b LEFT JOIN inner_of o USING (lang, phrase) WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, t.n, score FROM ranked JOIN totals t USING (lang) WHERE rank <= {TOP}
"""
