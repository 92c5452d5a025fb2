"""Readers and writers of recordings and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequora.sources.storage import cut, fresh_path


def write(df: DataFrame, path: str, kind: str, partition_by: list[str] | None = None, options: dict | None = None) -> None:
    """Write a table; a partition column makes a folder per value, which later reads can prune."""
    writer = df.write.format(kind).options(**(options or {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark, path: str, kind: str, schema, options: dict | None = None) -> DataFrame:
    """Read a table or all shards under a path with a known schema: no pass over the data to guess it."""
    return spark.read.format(kind).options(**(options or {})).schema(schema).load(path)


def round_trip(df: DataFrame, kind: str, partition_by: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """What comes back of a table that was written to the shared folder."""
    path = fresh_path(df.sparkSession, kind)
    write(df, path, kind, partition_by, options)
    return read(df.sparkSession, path, kind, df.schema, options).select(*df.columns)


def matrix_cells(rows: DataFrame, key: str, row: str) -> DataFrame:
    """(key, j, v): cells of a matrix that is stored as one array per row."""
    return rows.select(key, F.posexplode(row).alias("j", "v"))


def matrix_from_arrays(spark, cells) -> DataFrame:
    """(i, j, v): cells of a two-dimensional array of the driver, non-zero ones only; for matrices of a fixed, small size."""
    return spark.createDataFrame([(i, j, float(v)) for i, line in enumerate(cells) for j, v in enumerate(line) if v], "i int, j int, v double")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in an order, from 0: ranges of the order are counted, their offsets are summed, rows are numbered inside them.

    Only one row per range meets in one task.
    """
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()), "ranged")
    first = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = held.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_seq") - F.col("_first") + F.col("_before"))
    return out.drop("_part", "_seq", "_first", "_before")


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str, size: str) -> DataFrame:
    """Adds the place of each row inside its key (from 0) and the key's number of rows; keys are few (a row each is broadcast), their rows many."""
    held = numbered(rows, [*keys, *order], "_i")
    per = cut(held.groupBy(*keys).agg(F.min("_i").alias("_from"), F.count(F.lit(1)).alias(size)).withColumnsRenamed({k: f"_{k}" for k in keys}), "keys")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return held.join(F.broadcast(per), same).withColumn(name, F.col("_i") - F.col("_from")).drop("_i", "_from", *[f"_{k}" for k in keys])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles with linear interpolation; missing values are skipped. Rows are ranked range by range, and only a quantile's two neighbours are looked at."""
    held = placed(rows.where(F.col(value).isNotNull()).select(*keys, value), keys, [value], "_at", "_n")

    def quantile(share: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(share))
        weight = F.greatest(1 - F.abs(F.col("_at") - place), F.lit(0.0))
        return F.sum(F.when(weight > 0, F.col(value) * weight))

    near = [F.abs(F.col("_at") - (F.col("_n") - 1) * F.lit(float(x))) < 1 for x in shares]
    wanted = near[0]
    for x in near[1:]:
        wanted = wanted | x
    return held.where(wanted).groupBy(*keys).agg(*[quantile(x).alias(f"q{i}") for i, x in enumerate(shares)])
