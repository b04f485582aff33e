"""Windows of a stream with late and out-of-order rows against those of the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from faultsift.operators import segment
from faultsift.streaming import windows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_equal_to_batch(spark, rocks, tmp_path):
    rng = random.Random(4)
    rows = [(k, m, rng.choice([0.0, 1.0, 3.5, 5.0, 8.0, 9.0])) for k in "ab" for m in range(120) if rng.random() < 0.6]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 5))  # out of order, but within the delay
    rows += [(k, 500, 0.0) for k in "ab"] + [("c", 501, 0.0)]
    for i in range(6):
        part = rows[i * len(rows) // 6 : (i + 1) * len(rows) // 6]
        spark.createDataFrame(part, "k string, m long, energy double").withColumn("ts", F.timestamp_seconds(F.col("m") * 60)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = "k string, m long, energy double, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = windows.hysteresis(stream, ["k"], "ts", "energy").writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("found").collect())
    table = spark.createDataFrame([r for r in rows if r[1] < 400], "k string, step long, energy double")
    want = sorted(tuple(r) for r in segment.hysteresis(table, ["k"], "step", "energy").select("k", "start", "end", "peak").collect())
    assert got == want and len(want) > 10
