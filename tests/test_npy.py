"""Array files: round trips of matrices and masks, ranges of lines, columns."""

import numpy as np
import pytest

from sequora.sources import npy


@pytest.fixture(scope="module")
def reader(spark):
    npy.register(spark)
    return lambda path, **options: spark.read.format("npy").options(**options).load(str(path))


def lines(df):
    return [list(r.row) for r in df.orderBy("i").collect()]


def test_reads_what_numpy_wrote(reader, tmp_path):
    x = np.random.default_rng(1).normal(size=(1001, 4))
    x[5, 2] = np.nan
    np.save(tmp_path / "x.npy", x)
    df = reader(tmp_path / "x.npy", lines=100)
    assert df.rdd.getNumPartitions() == 11
    assert lines(df) == [[None if np.isnan(v) else v for v in row] for row in x.tolist()]
    assert lines(reader(tmp_path / "x.npy", columns="3,0")) == x[:, [3, 0]].tolist()
    for kind in ("?", "<i4", ">f4", "<u2"):
        y = (x[:50, :2] > 0).astype(kind)
        np.save(tmp_path / "y.npy", y)
        assert lines(reader(tmp_path / "y.npy")) == y.astype(float).tolist()
    np.save(tmp_path / "y.npy", np.arange(7))
    assert lines(reader(tmp_path / "y.npy", lines=3)) == [[float(i)] for i in range(7)]
    np.save(tmp_path / "y.npy", np.asfortranarray(x))
    with pytest.raises(Exception, match="columns come first"):
        lines(reader(tmp_path / "y.npy"))


@pytest.mark.parametrize("kind", ["<f8", "?"])
def test_round_trip(spark, reader, tmp_path, kind):
    x = np.random.default_rng(2).normal(size=(300, 3)) if kind == "<f8" else np.random.default_rng(2).integers(0, 2, (300, 3)).astype(float)
    table = spark.createDataFrame([(i, row) for i, row in enumerate(x.tolist())], "i long, row array<double>").repartitionByRange(4, "i")
    for _ in range(2):
        table.write.format("npy").option("kind", kind).mode("overwrite").save(str(tmp_path / "out"))
    assert lines(reader(tmp_path / "out", lines=64)) == x.tolist()
    files = sorted((tmp_path / "out").glob("*.npy"))
    assert np.array_equal(np.concatenate([np.load(f) for f in files]), x.astype(kind)) and not list((tmp_path / "out").glob("_*"))
