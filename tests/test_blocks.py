"""Windows over blocks: the same rows with blocks of a few rows, and one recording over many tasks."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from run_compare import TABLES, canonical
from sequora.operators import blocks, motion, sequences as sq
from sequora.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries whose windows look along a recording.
ALONG = (
    "segments dwell_runs dwell_seconds run_length_split left_turn_ratio delay_embed_k4 delay_embed_vectors delay_embed_reversed moving_mean_k5 heading_change inter_event_interval phase_unwrap step_geometry rec_trajectory "
    "acf acf_exclude acf_pooled ccf ccf_exclude msd boundary_null last_two_null unpad_last_null transition_counts_lag3 transition_counts_gap_aware transition_counts_multi_lag chunked_counts km_drift_diffusion hunt_coverage bbox_fraction"
).split()


@pytest.mark.parametrize("name", ALONG)
def test_small_blocks(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "BLOCK", 7)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.ORACLE_SQL[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in found.description], found.fetchall())


def test_one_long_recording(spark, monkeypatch):
    """A million rows of one recording, with gaps, against numpy; no task gets more than a block and its halo."""
    monkeypatch.setattr(blocks, "BLOCK", 1 << 16)
    n = 1_000_000
    seq = spark.range(n).select(F.lit(1).alias("rec"), F.col("id").alias("t"), F.when(F.col("id") % 1009 != 5, F.pmod(F.hash("id"), F.lit(5)).cast("int")).alias("label"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0 - 5).alias("value"))
    rows = seq.orderBy("t").toPandas()
    label, value = rows.label.to_numpy(), rows.value.to_numpy()
    gap = np.isnan(label)
    seg = np.cumsum(gap)

    sizes = blocks.in_blocks(seq, ahead=3).repartition(16, *blocks.KEYS).groupBy(F.spark_partition_id().alias("p"), "_block").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(sizes) == 16 and max(r.n for r in sizes) <= (1 << 16) + 3

    counts = {(r.src, r.dst): r.n for r in sq.transition_counts(seq, 3, gap_aware=True).collect()}
    ok = ~gap[:-3] & ~gap[3:] & (seg[:-3] == seg[3:])
    want = np.bincount((label[:-3][ok] * 5 + label[3:][ok]).astype(int), minlength=25)
    assert all(counts[i // 5, i % 5] == want[i] for i in range(25))

    changed = np.r_[True, (label[1:] != label[:-1]) & ~(gap[1:] & gap[:-1])]
    found = sq.runs(seq).agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("last"), F.max("dur").alias("longest")).first()
    run = np.cumsum(changed)
    lengths = np.bincount(run[~gap])
    assert (found.n, found.last, found.longest) == ((lengths > 0).sum(), run[~gap].max(), lengths.max())

    a = motion.unwrap(seq.withColumn("phase", F.col("value") * 0.6), "phase").agg(F.sum("angle").alias("s")).first().s
    assert a == pytest.approx(np.unwrap(value * 0.6).sum(), rel=1e-9)

    c = {r.lag: r.acf for r in motion.autocorrelation(seq, "value", [1, 40]).collect()}
    x = value - value.mean()
    assert all(c[k] == pytest.approx((x[:-k] * x[k:]).mean() / x.var(), abs=1e-9) for k in (1, 40))
    assert sq.trajectory(seq, "label", 4).count() == sum(max(0, m - 5) for m in np.diff(np.r_[-1, np.flatnonzero(gap), n]) - 1)
