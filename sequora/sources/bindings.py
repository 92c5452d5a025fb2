"""How the given tables become recordings: ordered, gappy sequences of symbols and signals.

Every view is one projection over one scan (columns are pruned at the source) and, where places are numbered, one window
over the recording key and the day, so that no task gets a whole long recording.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Symbols of the event types.
EVENT_LABELS = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
N_STATES = len(EVENT_LABELS)
#: Groups (conditions) of recordings.
N_GROUPS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(column, values: dict):
    """Symbol of a text value; others are null."""
    out = F.lit(None).cast("int")
    for text, symbol in values.items():
        out = F.when(column == text, F.lit(symbol)).otherwise(out)
    return out


def event_sequence(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """(rec, t, label, value, k, phase, micros): events of a user in order of time; with ``gaps``, errors are missing. Rows without a user or a time are in no recording."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    label = code(F.col("event_type"), EVENT_LABELS)
    if gaps:
        label = F.when(label != EVENT_LABELS["error"], label)
    # places are numbered inside days; a table with a row for each recording and day says how many come before
    order, days = Window.partitionBy("user_id", "day").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")).select("user_id", "day", F.coalesce(F.sum("n").over(days), F.lit(0)).alias("before"))
    return e.withColumn("place", F.row_number().over(order) - 1).join(before, ["user_id", "day"]).select(
        F.col("user_id").alias("rec"),
        (F.col("place") + F.col("before")).cast("long").alias("t"),
        label.alias("label"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("value") * (pi / 245) - pi).alias("phase"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    )


def group_of(column="rec"):
    return (F.col(column) % N_GROUPS).cast("int")
