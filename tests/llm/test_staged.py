import gc
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.llm.common import _CLEANUP, Scratch, bitmap, in_bitmap, staged


def shuffle_files(spark):
    managers = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in managers for f in Path(d).rglob("shuffle_*.data")}


def freed(spark, before):
    """Whether no new shuffle file is left; they are deleted in the background."""
    end = time.time() + 10
    while left := shuffle_files(spark) - before:
        if time.time() > end:
            return False
        time.sleep(0.2)
    return not left


@pytest.mark.parametrize("how", ["staged", "scratch", "bitmap"])
def test_no_shuffle_outlives_its_table(spark, how):
    gc.disable()  # else the driver may happen to free them
    try:
        before, setting = shuffle_files(spark), spark.conf.get(_CLEANUP, None)
        rows = spark.range(5000).withColumn("k", F.col("id") % 70).repartition(3, "id").groupBy("k").count()
        if how == "bitmap":
            known = bitmap(rows.select("k"))
            assert in_bitmap(np.arange(70), known).all()
        else:
            out = staged(rows, "x") if how == "staged" else Scratch(spark).staged(rows, "x")
        assert freed(spark, before) and spark.conf.get(_CLEANUP, None) == setting
        if how != "bitmap":
            assert sorted(r["k"] for r in out.collect()) == list(range(70))
    finally:
        gc.enable()


def test_tables_read_in_two_later_queries(spark):
    out = staged(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "x")
    again = staged(out.join(out.withColumnRenamed("count", "n"), "k"), "x")
    assert again.count() == 7 and again.where("count <> n").count() == 0
