import glob
import os

import pytest
from pyspark.sql import functions as F

from glyphmill.operators.reuse import reused


def written(folder):
    return len(glob.glob(f"{folder}/reuse-stage-*"))


def test_second_run_reads_and_changes_recompute(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "shared")
    spark.range(10).write.parquet(source)

    def stage(**more):
        df = spark.read.parquet(source).select((F.col("id") * 2).alias("x"))
        return sorted(r.x for r in reused(df, "stage", folder=folder, **more).collect())

    assert stage() == list(range(0, 20, 2)) and written(folder) == 1
    assert stage() == list(range(0, 20, 2)) and written(folder) == 1
    stage(parameters={"k": 1})
    assert written(folder) == 2
    spark.range(10, 12).write.mode("append").parquet(source)
    assert stage() == list(range(0, 24, 2)) and written(folder) == 3
    other = spark.read.parquet(source).select((F.col("id") * 3).alias("x"))
    assert max(r.x for r in reused(other, "stage", folder=folder).collect()) == 33 and written(folder) == 4


def test_broken_writes_are_never_read(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "shared")
    spark.range(10).write.parquet(source)
    broken = spark.read.parquet(source).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("x"))
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            reused(broken, "stage", folder=folder)
    assert not os.path.exists(f"{folder}/reuse-manifest")
    whole = spark.read.parquet(source).select(F.col("id").alias("x"))
    first = reused(whole, "stage", folder=folder)
    for path in glob.glob(f"{folder}/reuse-stage-*"):
        os.rename(path, f"{tmp_path}/{os.path.basename(path)}")  # the data are gone, the entry is there
    assert reused(whole, "stage", folder=folder).count() == 10 and first is not None
