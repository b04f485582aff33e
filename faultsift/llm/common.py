"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows per Arrow batch for whole texts: with texts of 100 KB a batch stays near 25 MB.
TEXT_BATCH_ROWS = 256

#: The temporary folders of local sessions.
_LOCAL: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words of a bitmap that reach the driver as one row.
_CHUNK = 1 << 13
#: Only GNU's C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _LOCAL[app]


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here delete their shuffle files as they end, which otherwise stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _written(df: DataFrame, path: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives executors."""
    return _written(df, new_dir(df.sparkSession, name))


class Scratch:
    """Tables in the shared folder that an operator needs no longer than it runs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_dir(self.spark, name))
        return _written(df, self.paths[-1])

    def clear(self) -> None:
        """Delete the tables; no DataFrame that reads them may be used afterwards."""
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size where it would hold too many whole texts."""
    if int(spark.conf.get(_BATCH, "10000")) > rows:
        spark.conf.set(_BATCH, str(rows))


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task keeps it otherwise, beside the workers that run."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a task's worker gives back what it has freed."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return ran


def with_arrow(
    df: DataFrame,
    columns: list[str],
    fields: list[T.StructField],
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """df's columns (or those in keep) and the fields that compute makes of each batch.

    A field replaces a column of the same name.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    schema = T.StructType(kept + fields)
    kept_names = [f.name for f in kept]
    used = list(dict.fromkeys(kept_names + columns))
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept_names] + made, names=kept_names + [f.name for f in fields]
            )

    return df.select(*used).mapInArrow(lean(run), schema)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_skewed(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, share: float = 1e-4) -> DataFrame:
    """rows inner-joined with table (key unique, weight: how many rows a key has).

    Keys with that share of all rows meet their rows in a broadcast table of 1 / share rows at most; so no task gets all rows of one.
    """
    is_hot = F.col(weight) >= max(2, int(share * total))
    hot, cold = F.broadcast(table.where(is_hot).drop(weight)), table.where(~is_hot).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def text_of(name: str = "text"):
    """The column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def bit_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The place of each 64-bit key in a bitmap of so many bits (a power of two)."""
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)


def bitmap(keys: DataFrame, bits: int = 1 << 26, of: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """A bitmap of the hashes of one long column without nulls, or of the integers that of makes of each batch; its size does not depend on their number."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bit_of(of(batch) if of else batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "mask"])

    def chunk(group: pa.Table) -> pa.Table:
        part = np.zeros(_CHUNK, np.int64)
        part[group.column("word").to_numpy() % _CHUNK] = group.column("mask").to_numpy()
        return pa.table({"at": pa.array([group.column("word")[0].as_py() // _CHUNK], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})

    got = keys.mapInArrow(lean(words), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(max(_CHUNK, bits >> 6), np.int64)
    with shuffles_freed(keys.sparkSession):
        rows = got.groupBy(F.shiftright("word", _CHUNK.bit_length() - 1)).applyInArrow(chunk, "at long, part binary").collect()
    for at, part in rows:
        out[at * _CHUNK : (at + 1) * _CHUNK] = np.frombuffer(part, np.int64)
    return out[: bits >> 6]


def in_bitmap(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys a bitmap may hold; a false hit is possible, a false miss is not."""
    at = bit_of(keys, len(table) << 6)
    return (table[at >> 6] >> (at & 63)) & 1 == 1
