"""The queries of this subpackage that ``__spark_entry__.py`` registers, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sequora.llm import bpe, chat, decontaminate, exact_dedup, jaccard_join, licenses, phrases, pii, quality, suffix_dedup, toxicity, warc, whitening
from sequora.llm.store import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(read_table(spark, sf_dir, "documents")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digest(chat.format_conversations(said))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations laid out anew as records of several layouts, then brought back by their fingerprints."""
    turns = chat.canonical_turns(chat.relaid(read_table(spark, sf_dir, "conversations")))
    return chat.digest(chat.formatted(turns, template=chat.IM), template=chat.IM).select("conv_id", "n_turns", "turns_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_exact_dedup, op3_jaccard_join, op4_decontaminate, op5_quality, op6_toxicity, op7_bpe, op8_suffix_dedup, op9_warc, op10_licenses, op11_chat, chat_layouts, op12_whitening, op13_phrases)}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op9_warc": warc.ORACLE, "op11_chat": chat.ORACLE, "chat_layouts": chat.LAYOUTS_ORACLE, "op13_phrases": phrases.ORACLE}
