"""The .npy data source: ranged reads, classes, and shards written by executors."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywright.sources import readers, sinks


def long_form(matrix, first=0):
    return {(i + first, c): None if np.isnan(v) else float(v) for i, row in enumerate(matrix) for c, v in enumerate(row)}


def read(df):
    rows = df.collect()
    got = {(r.row_id, r.class_id): r.score for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["float32", "float64", "int16"])
def test_ranges_and_classes(spark, tmp_path, order, kind):
    m = np.asarray(np.random.default_rng(1).normal(0, 50, (9000, 3)).astype(kind), order=order)
    path = f"file://{tmp_path}/m.npy"
    np.save(tmp_path / "m.npy", m)
    want = long_form(m.astype(float))
    assert read(readers.matrix(spark, path, 2)) == want
    assert read(readers.matrix(spark, path, 5, classes=[2, 0, 2, 99])) == {k: v for k, v in want.items() if k[1] != 1}


def test_only_the_bytes_of_a_class_are_read(tmp_path, monkeypatch):
    m = np.asfortranarray(np.random.default_rng(1).normal(size=(1000, 50)))
    np.save(tmp_path / "m.npy", m)
    taken = []

    class Counted(io.FileIO):
        def read_at(self, size, offset):
            taken.append(size)
            self.seek(offset)
            return self.read(size)

    class Files:
        open_input_file = staticmethod(lambda path: Counted(path))

    monkeypatch.setattr(readers, "store", lambda path: (Files, path))
    path = str(tmp_path / "m.npy")
    batches = list(readers.MatrixReader({"path": path, "classes": "7"}).read(readers.RowRange(path, 0, 0, 1000)))
    assert sum(taken) == 8000 and np.array_equal(np.concatenate([b.column("score").to_numpy() for b in batches]), m[:, 7])


def test_files_that_are_no_matrix(spark, tmp_path):
    np.save(tmp_path / "flat.npy", np.zeros(5))
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    assert readers.matrix(spark, str(tmp_path / "none.npy")).count() == 0
    with pytest.raises(Exception, match="matrix of numbers"):
        readers.matrix(spark, str(tmp_path / "flat.npy")).count()
    whole = (tmp_path / "cut.npy")
    np.save(whole, np.ones((100, 4)))
    os.truncate(whole, 1000)
    with pytest.raises(Exception, match="ends before its last row"):
        readers.matrix(spark, str(whole)).count()


def test_shards_come_back_and_are_replaced(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    m = np.random.default_rng(2).normal(size=(1050, 4))
    m[5, 1] = np.nan
    rows = [(i, c, v) for (i, c), v in long_form(m).items() if (i, c) != (17, 2)]  # a missing cell is NaN
    df = spark.createDataFrame(rows, "row_id int, class_id int, score double").withColumn("extra", F.lit(1))
    sinks.write_npy(df, folder, 4, 100)
    m[17, 2] = np.nan
    names = sorted(os.listdir(tmp_path / "shards"))
    assert names == [f"row_{100 * k:012d}.npy" for k in range(11)]
    assert np.array_equal(np.concatenate([np.load(tmp_path / "shards" / n) for n in names]), m, equal_nan=True)
    for got in (readers.matrices(spark, folder), readers.matrix(spark, folder)):
        assert read(got) == long_form(m)
    sinks.write_npy(df.filter("row_id < 50"), folder, 4, 100)
    assert os.listdir(tmp_path / "shards") == ["row_000000000000.npy"]
    sinks.write_npy(df.limit(0), folder, 4, 100)
    assert os.listdir(tmp_path / "shards") == [] and readers.matrix(spark, folder).count() == 0


def test_a_failed_task_leaves_no_shard_and_the_old_ones(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    df = spark.range(400).select(F.col("id").alias("row_id"), F.lit(0).alias("class_id"), F.lit(1.0).alias("score"))
    sinks.write_npy(df, folder, 1, 100)
    bad = df.withColumn("class_id", F.when(F.col("row_id") == 399, 5).otherwise(0)).withColumn("score", F.lit(2.0))
    with pytest.raises(Exception, match="out of bounds"):
        sinks.write_npy(bad, folder, 1, 100)
    assert len(os.listdir(tmp_path / "shards")) == 4
    assert readers.matrix(spark, folder).agg(F.sum("score")).first()[0] == 400
