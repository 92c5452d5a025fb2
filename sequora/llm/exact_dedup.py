"""Exact deduplication by two-pass Bloom filtering.

Pass one finds the hash positions that more than one text hits; pass two splits the rows: those with a position
of their own pass straight through, only the others shuffle. Of equal texts, the row with the largest id stays;
of rows that also share that id (or have none), one stays.

Null texts count as empty and equal the empty text. A null id is smaller than any other; ids may be of any type that sorts. Texts
may be of any length: rows are compared by digests. An empty table gives an empty result. Columns of any name may come along: working columns have names that the input lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.llm import bitmap
from sequora.llm.store import cut


def _named(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores until no column has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _maybe_repeated(docs: DataFrame, text: str):
    """Column that is false only for rows whose text no other row has."""
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    bits = bitmap.bits_for(docs.count())
    return bitmap.probe(bitmap.repeated(docs.select(hashed.alias("h")), bits), hashed)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), F.monotonically_increasing_id().alias("row"), _maybe_repeated(docs, text_col).alias("maybe")), "exact")
    alone = rows.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = rows.where("maybe")
    # one row per text after partial aggregation; dealt anew so that the join below can split a hot text
    groups = again.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")).repartition(F.col("best.row"))
    joined = again.join(groups.hint("merge"), "sha").select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha")
    return alone.unionByName(joined).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the copies: its columns, one row for each text."""
    maybe, sha, best = _named(docs, "maybe", "sha", "best")
    marked = docs.withColumn(maybe, _maybe_repeated(docs, text_col))
    alone = marked.where(~F.col(maybe)).drop(maybe)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = marked.where(F.col(maybe)).groupBy(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(sha)).agg(F.max_by(row, F.struct(F.col(id_col))).alias(best))
    return alone.unionByName(again.select(f"{best}.*"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
