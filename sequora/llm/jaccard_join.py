"""N-gram Jaccard join of documents with themselves: a grouped prefix join, exact.

A document is the set of its distinct word shingles. Two documents link when
``100 * intersection >= percent * union``. Shingles are put in one order for all documents, rare ones first
(``sketch``). Documents that link share a shingle among their first ``n - ceil(t n) + 1``, the prefix.

1. Documents with equal sets are one class; classes with equal prefix and size are one group.
2. Groups that share a prefix shingle are candidates, if their sizes and the places of the shared shingle allow enough
   overlap. Prefix shingles that no other group has are left out first (Bloom filtering in two passes).
3. Candidates are expanded to classes. Counts of the shingles by hash range bound the overlap of two sets from above; pairs
   that this bound allows are verified on their whole sets.

Not all pairs of a large cluster are needed, as the result is its connected classes. So candidates come in two
rounds: first every group of a shingle's list meets the list's first group only (as many pairs as list entries), and
the links found join classes into components; then all candidate pairs that lie in different components are
verified. Pairs inside a component are spared, none across components is: no cap, no sample, the components are exact.

Long plans are cut in parts: after each of its shuffles Spark plans and logs what is left of a plan anew, so what the driver needs
grows with the square of a plan's length. A round without candidates ends there.

Null texts count as empty; documents without words are in no link and their own component. Component ids are the
smallest id in a component (a null id is smaller than any other). Rows with equal ids stay apart unless their sets link.
Empty tables give empty results. A text of any length is one set, whole. Columns other than id and text are not read, and
``drop_near_duplicates`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequora.llm import bitmap, shingles, sketch
from sequora.llm.components import components
from sequora.llm.exact_dedup import _named
from sequora.llm.store import cut

def prefix_length(n, percent: int):
    """First shingles of a set of n of which a linked set shares one: n - ceil(percent n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def histogram(hashes: np.ndarray) -> bytes:
    """Counts of a sorted set by hash range: a power of two of ranges, one for about eight members."""
    ranges = 1 << max(4, int(len(hashes) // 8).bit_length())
    top = np.uint64(64 - (ranges.bit_length() - 1))
    return np.bincount((hashes >> top).astype(np.int64), minlength=ranges).astype(np.uint16).tobytes()


def overlap_bound(one: bytes, other: bytes) -> int:
    """No two sets with these histograms share more members."""
    a, b = np.frombuffer(one, np.uint16).astype(np.int64), np.frombuffer(other, np.uint16).astype(np.int64)
    if len(a) > len(b):
        a, b = b, a
    return int(np.minimum(a, b.reshape(len(a), -1).sum(axis=1)).sum())


def _may_link(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, one, other = (batch.column(k).to_pylist() for k in range(2, 6))
            keep = [overlap_bound(x, y) * (100 + percent) >= percent * (i + j) for i, j, x, y in zip(n, m, one, other)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _prefixes(table, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prefix_hash, set_hash, prefix, counts = [], [], [], [], []
            for found in shingles.sets_of(batch.column(1), width):
                first = sketch.rare_first(table.value, found)[: prefix_length(len(found), percent) if len(found) else 0]
                n.append(len(found))
                set_hash.append(shingles.set_hash(found))
                prefix_hash.append(shingles.set_hash(np.sort(first)))
                prefix.append(first.view(np.int64))
                counts.append(histogram(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prefix_hash, pa.int64()), pa.array(set_hash, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(counts, pa.binary())], names=["row", "n", "prefix_hash", "set_hash", "prefix", "counts"])

    return run


def _entries(twice):
    """(token, gid, n, place) of the prefix shingles that may have company."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets).astype(np.int64))
            tokens = np.asarray(lists.flatten())
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = bitmap.lookup(twice.value, tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[keep]), pa.array(np.repeat(np.asarray(batch.column(0)), sizes)[keep]), pa.array(np.repeat(np.asarray(batch.column(1)), sizes)[keep]), pa.array(place[keep])],
                names=["token", "gid", "n", "place"],
            )

    return run


def _wanted_sets(wanted, width: int):
    """(set_hash, n, members) of the texts whose set may be asked for; once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sizes, members = [], [], []
            for found in shingles.sets_of(batch.column(0), width):
                key = shingles.set_hash(found)
                if len(found) and key not in seen and bitmap.lookup(wanted.value, np.array([key]))[0]:
                    seen.add(key)
                    keys.append(key)
                    sizes.append(len(found))
                    members.append(found.view(np.int64))
            if keys:
                for i in range(0, len(keys), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 500], pa.int64()), pa.array(sizes[i : i + 500], pa.int64()), pa.array(members[i : i + 500], pa.list_(pa.int64()))], names=["set_hash", "n", "members"])

    return run


def _can_link(percent: int, n: Column, m: Column, i: Column, j: Column) -> Column:
    """Sizes fit, and from the shared shingle on (places i and j) enough are left for the overlap needed."""
    need = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return (F.least(n, m) * 100 >= percent * F.greatest(n, m)) & (F.least(n - i, m - j) >= need)


def _pairs(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) once, the smaller first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Join:
    def __init__(self, docs: DataFrame, text: Column, width: int, percent: int):
        self.texts, self.width, self.percent = docs.select(F.coalesce(text, F.lit("")).alias("text")), width, percent

    def verified(self, pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """The links among ``pairs`` (a, b) of classes: first by the bound of their histograms, then by their whole sets."""
        one, other = (self.counts.select(F.col("row").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}")) for x in "ab")
        both = pairs.join(one.hint("merge"), "a").join(other.hint("merge"), "b").select("a", "b", "n_a", "n_b", "c_a", "c_b")
        pairs = cut(both.mapInArrow(_may_link(self.percent), "a long, b long"), f"pairs-{name}")
        if pairs.isEmpty():
            return pairs
        nodes = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        keys = cut(classes.join(nodes, "cid").select("cid", "n", "set_hash"), f"keys-{name}")
        wanted = bitmap.present(keys.select("set_hash"), bitmap.bits_for(keys.count()))
        found = self.texts.mapInArrow(_wanted_sets(wanted, self.width), "set_hash long, n long, members array<long>")
        sets = cut(found.join(keys, ["set_hash", "n"]).select("cid", "n", "members").dropDuplicates(["cid"]), f"sets-{name}")
        left = sets.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("m_a"))
        right = sets.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("m_b"))
        both = F.size(F.array_intersect("m_a", "m_b"))
        return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(both * 100 >= self.percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (one row of each component), and text_hash."""
    job = _Join(docs, F.col(text_col), width, percent)
    size = sketch.size_for(job.texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    table = sketch.ranks(job.texts, lambda batch: shingles.sets_of(batch.column(0), width), size)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")).alias("key"), text.alias("text"))
    sets = cut(keyed.mapInArrow(_prefixes(table, width, percent), f"row struct<row:long,id:{kind},text_hash:long>, n long, prefix_hash long, set_hash long, prefix array<long>, counts binary").select("row.*", "n", "prefix_hash", "set_hash", "prefix", "counts"), "sets")
    job.counts = sets.select("row", "n", "counts")

    full = sets.where("n > 0")
    classes = cut(full.groupBy("n", "set_hash", "prefix_hash").agg(F.min("row").alias("cid"), F.min(F.struct("id", "row")).alias("first")), "classes")
    groups = classes.groupBy("n", "prefix_hash").agg(F.min("cid").alias("gid"))
    members = cut(classes.join(groups, ["n", "prefix_hash"]).select("gid", "cid"), "members")

    firsts = cut(full.join(groups.select(F.col("gid").alias("row")), "row", "left_semi").select(F.col("row").alias("gid"), "n", "prefix"), "prefixes")
    tokens = firsts.select(F.explode("prefix").alias("token"))
    bits = bitmap.bits_for(int(firsts.agg(F.sum(F.size("prefix"))).first()[0] or 0))
    twice = bitmap.repeated(tokens, bits)
    entries = cut(firsts.mapInArrow(_entries(twice), "token long, gid long, n long, place long"), "entries")

    # round one: each list's groups meet its first group, the one with the fewest rarer shingles
    heads = entries.groupBy("token").agg(F.min(F.struct("place", "gid", "n")).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").select("token", "head.*")
    heads = heads.toDF("token", "h_place", "h_gid", "h_n").repartition(F.col("h_gid"))
    star = entries.join(heads.hint("merge"), "token").where((F.col("gid") != F.col("h_gid")) & _can_link(percent, F.col("n"), F.col("h_n"), F.col("place"), F.col("h_place")))
    star = cut(star.select(F.least("gid", "h_gid").alias("g"), F.greatest("gid", "h_gid").alias("h")).distinct(), "star")
    # a group's first class stands for it: it meets all classes of the other group, and those of its own
    other = members.select(F.col("gid").alias("h"), F.col("cid").alias("b"))
    mine = members.select(F.col("gid").alias("g"), F.col("cid").alias("a"))
    met = star.join(other.hint("merge"), "h").select(F.col("g").alias("a"), "b").unionByName(star.join(mine.hint("merge"), "g").select("a", F.col("h").alias("b")))
    met = met.unionByName(members.where("gid != cid").select(F.col("gid").alias("a"), F.col("cid").alias("b")))
    met = cut(_pairs(met), "met")
    links = cut(job.verified(met, classes, "star"), "links")

    # round two: candidate pairs across components
    labels = components(links)
    labelled = cut(members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("gid", "cid", F.coalesce("label", "cid").alias("label")), "labelled")
    pure = labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    known = cut(entries.join(pure, "gid"), "known")
    mixed = known.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l != h").select("token").repartition(F.col("token") + 1)
    lists = cut(known.join(mixed.hint("merge"), "token"), "lists")
    x, y = lists.alias("x"), lists.alias("y")
    apart = (F.col("x.gid") < F.col("y.gid")) & ((F.col("x.low") != F.col("x.high")) | (F.col("x.low") != F.col("y.low")) | (F.col("x.low") != F.col("y.high")))
    across = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & apart & _can_link(percent, F.col("x.n"), F.col("y.n"), F.col("x.place"), F.col("y.place"))).select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).distinct()
    within = labelled.join(pure.where("low != high").select("gid"), "gid").select(F.col("gid").alias("g"), F.col("gid").alias("h")).distinct()
    a = labelled.select(F.col("gid").alias("g"), F.col("cid").alias("a"), F.col("label").alias("la"))
    b = labelled.select(F.col("gid").alias("h"), F.col("cid").alias("b"), F.col("label").alias("lb"))
    near = cut(across.unionByName(within), "near")
    if not near.isEmpty():
        rest = near.join(a.hint("merge"), "g").join(b.hint("merge"), "h").where("la != lb and (g != h or a < b)")
        rest = cut(_pairs(rest).join(met, ["a", "b"], "left_anti"), "rest")
        more = rest if rest.isEmpty() else cut(job.verified(rest, classes, "rest"), "links")
        if not more.isEmpty():  # a label stands for the links found before
            labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    # of each class its component; the first document of a component names it
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("n", "set_hash", F.coalesce("label", "cid").alias("label"), "first")
    least = named.groupBy("label").agg(F.min("first").alias("least")).repartition(F.col("least.row"))
    named = named.repartition("set_hash").join(least.hint("merge"), "label").select("n", "set_hash", "least").repartition(F.col("n"), F.col("set_hash"))
    out = sets.select("row", "id", "text_hash", "n", "set_hash").join(cut(named, "named").hint("merge"), ["n", "set_hash"], "left")
    own = F.col("least").isNull()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(own, F.col("id")).otherwise(F.col("least.id")).alias("component_id"), (own | (F.col("row") == F.col("least.row"))).alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The input with one document of each component, that with the smallest id; documents without words stay."""
    said, hashed, maybe = _named(docs, "said", "text_hash", "maybe")
    at = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = jaccard_components(docs, id_col, text_col, width, percent).select(at.alias(said), F.col("text_hash").alias(hashed), "kept")
    lost = cut(rows.groupBy(said, hashed).agg(F.bool_or("kept").alias("one"), F.bool_and("kept").alias("all")).where("not all").drop("all"), "lost")
    # rows whose id no lost row has pass straight through; only the others meet the lost rows
    hit = bitmap.present(lost.select(F.xxhash64(said)), bitmap.bits_for(lost.count()))
    marked = docs.withColumn(maybe, bitmap.probe(hit, F.xxhash64(at)))
    asked = marked.where(F.col(maybe)).withColumn(said, at).withColumn(hashed, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = marked.where(~F.col(maybe)).unionByName(asked.join(lost, [said, hashed], "left_anti").drop(said, hashed))
    if not lost.where("one").isEmpty():  # rows repeated with id and text, of which one stays
        again = asked.join(lost.where("one"), [said, hashed], "left_semi").dropDuplicates([said, hashed])
        out = out.unionByName(again.drop(said, hashed))
    return out.drop(maybe)
