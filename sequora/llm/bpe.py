"""Byte-level BPE: encode whole texts in overlapping chunks, decode by concatenating raw bytes.

Every text is cut into chunks of ``CHUNK_CHARS`` that overlap. Each chunk is pre-tokenised by itself, from its own start.
Neighbouring chunks are stitched at the first boundary inside their overlap that both have and that no look-ahead
can shape: the end of a run of letters before a sign, digit or space. Such a boundary is one of the whole text, wherever a
reading began, so stitching resumes by itself behind an overlap that has none (one piece as long as the overlap): there the
two chunks stay one stretch. Then each stretch between two stitches is encoded by itself; the ids of a text are those of its
stretches in order. A text of one chunk is one stretch.

Texts longer than a segment (``SEGMENT_CHARS``) are cut and stitched twice by the same rule: segments are dealt out to tasks, so that
one text can keep many of them busy, and each task cuts its stretches into chunks. Shorter texts never shuffle.

Null texts count as empty: no ids, and the digest of nothing. Repeated and null ids and repeated rows stay apart. An empty table
gives an empty result; columns other than id and text are not read, whatever their names. Texts have no length limit but that
of a row: a text's ids come back in one row. The path of the vocabulary file is a parameter; each Python worker loads it once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sequora.llm.store import cut, small_batches

CHUNK_CHARS = 4_096
SEGMENT_CHARS = 32_768
OVERLAP_CHARS = 512


@functools.lru_cache(maxsize=2)
def encoding(path: str | None):
    """The tiktoken encoding of a rank file (by default, that of the 50k byte-level vocabulary)."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _patterns():
    """(pre-tokens, ends of letter runs before what is surely no letter)."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN), regex.compile(r"(?<=\p{L})(?=[\s\p{P}\p{S}\p{N}\p{M}])")


def boundaries(text: str) -> set[int]:
    """Where pre-tokens end, when read from the start of ``text``."""
    return {m.end() for m in _patterns()[0].finditer(text)}


def sure(text: str, found: set[int], lo: int, hi: int) -> list[int]:
    """Those of the boundaries inside [lo, hi) that stay so whatever stands around.

    A run of letters ends there in every reading of the text, and no look-ahead of the stretch before it reaches past it
    (a white-space run at the end of a stretch would be read in another way than in the whole text).
    """
    return [b for m in _patterns()[1].finditer(text, lo, hi) if (b := m.start()) in found]


def stretches(text: str) -> list[str]:
    """The text cut where its overlapping chunks resynchronise."""
    if len(text) <= CHUNK_CHARS + OVERLAP_CHARS:
        return [text]  # one chunk: nothing to stitch
    cuts, tail = [0], set()
    for at in range(0, max(1, len(text) - OVERLAP_CHARS), CHUNK_CHARS):
        chunk = text[at : at + CHUNK_CHARS + OVERLAP_CHARS]
        found = boundaries(chunk)
        if at:
            met = next((b + at for b in sure(chunk, found, 0, OVERLAP_CHARS) if b + at in tail), None)
            cuts += [met] if met is not None else []
        tail = {b + at for b in sure(chunk, found, CHUNK_CHARS, len(chunk))}
    return [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)])]


def encode(text: str, path: str | None = None) -> list[int]:
    enc = encoding(path)
    return [i for part in stretches(text) for i in enc.encode_ordinary(part)]


def decode(ids: list[int], path: str | None = None) -> bytes:
    return encoding(path).decode_bytes(ids)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment, the sure boundaries in the overlap with the one before and with the one behind."""
    for batch in batches:
        heads, tails = [], []
        for text, at in zip(*(batch.column(k).to_pylist() for k in (3, 2))):
            found = boundaries(text)
            heads.append([b + at for b in sure(text, found, 0, OVERLAP_CHARS)])
            tails.append([b + at for b in sure(text, found, SEGMENT_CHARS, len(text))])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])


def _segments(rows: DataFrame) -> DataFrame:
    """(row, k, at, text, last): the overlapping segments of each text; offsets count code points."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - OVERLAP_CHARS) / SEGMENT_CHARS)).cast("int")
    many = rows.select("row", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), n.alias("n"))
    return many.select("row", "k", (F.col("k").cast("long") * SEGMENT_CHARS).alias("at"), F.substring("text", F.col("k") * SEGMENT_CHARS + 1, F.lit(SEGMENT_CHARS + OVERLAP_CHARS)).alias("text"), (F.col("k") == F.col("n") - 1).alias("last"))


def stitched(rows: DataFrame) -> DataFrame:
    """(row, at, text): stretches of the texts of ``rows`` (row, text), cut where pre-tokens end in the whole text."""
    segments = _segments(rows).repartition("row", "k")
    edged = segments.mapInArrow(_edges, "row long, k int, at long, text string, last boolean, head array<long>, tail array<long>")
    by = Window.partitionBy("row").orderBy("k")
    met = F.array_min(F.array_intersect(F.lag("tail").over(by), F.col("head")))
    # a segment without a common boundary joins the one before it
    cuts = edged.withColumn("cut", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(met))
    cuts = cuts.withColumn("piece", F.count("cut").over(by)).withColumn("until", F.lead("cut").over(by))
    part = F.struct("k", "at", "cut", "until", "text")
    return cuts.groupBy("row", "piece").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "row",
        F.col("parts")[0]["cut"].alias("at"),
        F.aggregate(
            "parts",
            F.lit(""),
            # drop what stands before the cut, end each segment where its follower begins
            lambda a, p: F.concat(a, F.when(p["k"] == F.col("parts")[0]["k"], F.substring(p["text"], F.lit(1) + (p["cut"] - p["at"]).cast("int"), F.lit(SEGMENT_CHARS + OVERLAP_CHARS))).otherwise(F.substring(p["text"], F.lit(OVERLAP_CHARS + 1), F.lit(SEGMENT_CHARS)))),
        ).alias("text"),
        F.element_at("parts", -1)["until"].alias("until"),
    ).select("row", "at", F.when(F.col("until").isNull(), F.col("text")).otherwise(F.expr("substring(text, 1, cast(until - at as int))")).alias("text"))


def _encode_rows(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for i in range(0, len(texts), 200):
                ids = [encode(t, path) for t in texts[i : i + 200]]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 200) for c in batch.columns[:-1]), pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "ids"])

    return run


def _split(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) of texts of one segment, and of longer ones."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.length("text") > SEGMENT_CHARS + OVERLAP_CHARS
    return rows.where(~long), rows.where(long)


def _encode_long(long: DataFrame, path: str | None) -> DataFrame:
    """(id, ids) of texts of several segments, which are dealt out to tasks."""
    # the place of a text numbers its row, so that equal ids stay apart; written out, so that it is the same in both uses
    numbered = cut(long.withColumn("row", F.monotonically_increasing_id()), "long-texts")
    parts = stitched(numbered.select("row", "text")).repartition("row", "at").mapInArrow(_encode_rows(path), "row long, at long, ids array<int>")
    whole = parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"])).alias("ids"))
    return numbered.select("id", "row").join(whole, "row").select("id", "ids")


def encode_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: id and ``ids``, the token ids of the whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    short, long = _split(docs, id_col, text_col)
    found = short.mapInArrow(_encode_rows(path), f"id {kind}, ids array<int>").unionByName(_encode_long(long, path))
    return found.withColumnRenamed("id", id_col)


def _said(ids: list[int], words: list[str], enc) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids, digest of the bytes they decode to."""
    return len(ids), hashlib.sha256(" ".join([words[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_rows(path: str | None, encoded: bool):
    """(id, text) or, where ``encoded``, (id, ids): the id and the digests of the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        words = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in batches:
            rows = [_said((row.as_py() or []) if encoded else encode(row.as_py(), path), words, enc) for row in batch.column(1)]
            cols = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string())))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digest(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the bytes they decode to."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select(F.col("doc_id").alias("id"), "ids").mapInArrow(_digest_rows(path, True), f"id {kind}, {_DIGEST}").withColumnRenamed("id", "doc_id")


def digest_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``digest(encode_table(docs))``, but the ids of texts of one segment never leave the worker that found them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    short, long = _split(docs, "doc_id", "text")
    return short.mapInArrow(_digest_rows(path, False), f"id {kind}, {_DIGEST}").unionByName(_encode_long(long, path).mapInArrow(_digest_rows(path, True), f"id {kind}, {_DIGEST}")).withColumnRenamed("id", "doc_id")


def decode_table(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per input row: id and ``bytes``, the concatenated bytes of its ids."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.decode_bytes(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "bytes"])

    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)
