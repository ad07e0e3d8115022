import os
import time

import pytest
from pyspark.sql import functions as F

from seqloom.session import SHUFFLE_CLEANUP, checkpointed, forget, without_shuffle_files, write_shared


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {n for n in names if n.startswith("shuffle_")}


def left_behind(spark, before):
    """New shuffle files; Spark removes them in the background."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_forget_removes_the_files(spark):
    kept, gone = checkpointed(spark.range(10)), checkpointed(spark.range(20))
    place = lambda df: df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    paths = place(kept), place(gone)
    assert all(map(os.path.isdir, paths))
    assert gone.count() == 20
    forget(gone)
    assert [os.path.isdir(p) for p in paths] == [True, False] and kept.count() == 10


def grouped(spark):
    return spark.range(1_000).groupBy((F.col("id") % 10).alias("k")).count().groupBy("count").agg(F.sum("k").alias("sum"))


def test_kept_results_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = grouped(spark)
    kept, path = checkpointed(df), write_shared(df)
    assert left_behind(spark, before) == set()
    rows = [(100, 45)]
    assert [tuple(r) for f in (kept, kept, df, df, spark.read.parquet(path)) for r in f.collect()] == rows * 5


def test_the_setting_for_shuffle_files_is_put_back(spark):
    for value in (None, "false", "true"):
        if value is not None:
            spark.conf.set(SHUFFLE_CLEANUP, value)
        try:
            with pytest.raises(ZeroDivisionError), without_shuffle_files(spark):
                assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
                1 / 0
            assert spark.conf.get(SHUFFLE_CLEANUP, None) == value
        finally:
            spark.conf.unset(SHUFFLE_CLEANUP)
