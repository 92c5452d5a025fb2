"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its byte trigrams (hashed to ``TERMS`` places) and a few terms of form that count repeated words and
repeated word sequences. Term weights are ``log(1 + count)`` times an inverse document frequency, rows have length 1, and the
leading ``DIMS`` right singular vectors of the training rows span the latent space. All of a training sample's latent
vectors are broadcast (``TRAIN_ROWS`` rows of ``DIMS`` floats at most, 3 MB: the bound does not grow with the corpus).
Every text meets all of them: exact cosines, block by block, no index. The ``NEIGHBOURS`` nearest vote for their label,
weighted by a power of the cosine.

Training takes a bounded sample of labelled rows (a documented parameter), never rows that are held out. Tasks turn the
sample into term counts, so the driver gets ``TERMS + FORM`` numbers a row however long its text is; of rows that share an
id one teaches. Null and empty texts are a zero vector; their score is the share of label 1 in the sample. Without labels every
score is 0.5. Ids may repeat or be null (a null id is not held out and teaches nothing); equal texts have equal scores; neighbours
at equal distance are interchangeable, as any of them carries the same weight. An empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.llm import shingles
from sequora.llm.arrow_text import slices
from sequora.llm.exact_dedup import _named
from sequora.llm.store import small_batches
from sequora.llm.toxicity import held_out, training_texts

TERMS, DIMS = 2048, 96
TRAIN_ROWS = 8000
NEIGHBOURS, POWER = 25, 4
#: Terms of form stand behind the trigrams: repeated words, sequences of two and of four words, and where a text is short.
FORM = 3
#: What a term of form weighs against a trigram that occurs as often.
FORM_WEIGHT = 6.0
BLOCK = 512


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows: counts of trigram terms, then the shares of repetition as pseudo-counts."""
    for _, _, offsets, data in slices(column):
        n = len(offsets) - 1
        out = np.zeros((n, TERMS + FORM), np.float32)
        if len(data) >= 3:
            d = data.astype(np.uint32)
            code = (d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA77) + d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
            owner = np.repeat(np.arange(n), np.diff(offsets))
            same = owner[2:] == owner[:-2]
            flat = owner[:-2][same] * TERMS + code[same]
            out[:, :TERMS] = np.bincount(flat, minlength=n * TERMS).reshape(n, TERMS)
        at, words = shingles.word_hashes(offsets, data)
        pairs = words[:-1] * np.uint64(3) + words[1:] if len(words) > 1 else words[:0]
        fours = pairs[:-2] * np.uint64(5) + pairs[2:] if len(pairs) > 2 else words[:0]
        for i, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
            for j, (seq, width) in enumerate(((words, 1), (pairs, 2), (fours, 4))):
                m = hi - lo - width + 1
                if m > 0:
                    out[i, TERMS + j] = 1 - len(np.unique(seq[lo : lo + m])) / m
        yield out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0)."""
    x = np.log1p(counts) * idf
    x[:, TERMS:] = counts[:, TERMS:] * FORM_WEIGHT
    base = np.linalg.norm(x[:, :TERMS], axis=1, keepdims=True)
    x[:, :TERMS] /= np.maximum(base, 1e-9)
    x[:, TERMS:] /= FORM_WEIGHT
    x[:, TERMS:] *= (base > 0) * 1.0
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def train(counts: np.ndarray, labels: list[int]) -> dict:
    """The model: inverse document frequencies, projection, latent vectors of the sample (rows of counts), and its labels."""
    if not len(counts):
        return {"idf": np.ones(TERMS + FORM, np.float32), "basis": None, "vectors": None, "labels": None, "prior": 0.5}
    idf = np.log((1 + len(counts)) / (1 + np.count_nonzero(counts, axis=0))).astype(np.float32) + np.float32(0.1)
    blocks = [slice(i, i + BLOCK) for i in range(0, len(counts), BLOCK)]
    gram = np.zeros((counts.shape[1],) * 2, np.float32)
    for part in blocks:
        x = weigh(unpacked(counts[part]), idf)
        gram += x.T @ x
    values, vectors = np.linalg.eigh(gram)
    basis = vectors[:, np.argsort(-values)[:DIMS]].astype(np.float32)
    latent = np.vstack([weigh(unpacked(counts[part]), idf) @ basis for part in blocks])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    y = np.array(labels, np.float32)
    return {"idf": idf, "basis": basis, "vectors": latent.astype(np.float32), "labels": y, "prior": float(y.mean())}


def vote(model: dict, counts: np.ndarray) -> np.ndarray:
    """Scores of a block of rows."""
    if model["vectors"] is None:
        return np.full(len(counts), 0.5)
    x = weigh(counts, model["idf"]) @ model["basis"]
    size = np.linalg.norm(x, axis=1)
    x /= np.maximum(size[:, None], 1e-9)
    k = min(NEIGHBOURS, max(1, len(model["labels"]) // 8))
    out = np.empty(len(x))
    for i in range(0, len(x), BLOCK):
        cosine = x[i : i + BLOCK] @ model["vectors"].T
        near = np.argpartition(cosine, -k, axis=1)[:, -k:] if k < cosine.shape[1] else np.tile(np.arange(k), (len(cosine), 1))
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** POWER
        out[i : i + BLOCK] = (weight * model["labels"][near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(np.where(size > 1e-6, out, model["prior"]), 0, 1)


def fit(docs: DataFrame, labels: DataFrame):
    """Broadcast model, trained on a bounded sample of the labelled rows that are not held out."""
    sample = training_texts(small_batches(docs), labels, "quality", TRAIN_ROWS)
    counts, ids, known = np.empty((TRAIN_ROWS, TERMS + FORM), np.uint16), [], []
    for r in sample.mapInArrow(_counted, "doc_id string, label int, counts binary").repartition(4, "doc_id").sortWithinPartitions("doc_id").toLocalIterator():
        counts[len(ids)] = np.frombuffer(r.counts, np.uint16)
        ids.append(r.doc_id)
        known.append(r.label)
    model = train(counts[: len(ids)], known)
    del counts
    return docs.sparkSession.sparkContext.broadcast(model)


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes each (larger ones are 65,535), shares of repetition in steps of 1 / 65,535."""
    out = np.minimum(counts, 65_535)
    out[:, TERMS:] = np.rint(counts[:, TERMS:] * 65_535)
    return out.astype(np.uint16)


def unpacked(counts: np.ndarray) -> np.ndarray:
    """Rows as ``term_counts`` gives them."""
    if counts.dtype != np.uint16:
        return counts
    out = counts.astype(np.float32)
    out[:, TERMS:] /= 65_535
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, label) with the term counts of the text in its place."""
    for batch in batches:
        if batch.num_rows:
            counts = [row.tobytes() for block in term_counts(batch.column(1)) for row in packed(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.binary())], names=["doc_id", "label", "counts"])


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.concatenate([vote(model.value, block) for block in term_counts(batch.column(1))]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_score(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The input without the documents that the classifier rejects; its columns. Only texts travel to Python, only flags come back."""
    model = fit(docs, labels)
    good = _named(docs, "good")[0]

    @F.arrow_udf("boolean")
    def judged(texts: pa.Array) -> pa.Array:
        blocks = [vote(model.value, block) >= threshold for block in term_counts(texts)]
        return pa.array(np.concatenate(blocks) if blocks else np.zeros(0, bool))

    return docs.withColumn(good, judged(F.coalesce("text", F.lit("")))).where(F.col(good)).drop(good)
