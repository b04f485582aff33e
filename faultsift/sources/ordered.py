"""Text, CSV and JSON lines files with each row's true line number, however their files are split.

Spark gives every row the file and the block it was read from, and numbers rows in the order of a task; rows of one block
stand together. So a line's number is its place in its block after the lines of the blocks before it, which one
aggregation counts. Files of any size and of any store that Spark reads are split as always, and nothing passes through
one task. A row of a CSV file is one line: quoted fields hold no line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def lines(spark: SparkSession, path: str | list[str], suffix: str = "*") -> DataFrame:
    """(file, line, text): all lines of the files under path with that suffix pattern, numbered from 1; a file without lines has none."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(path)
    block = F.col("_metadata.file_block_start")
    rows = read.select(_same_path(F.col("_metadata.file_path")).alias("file"), block.alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    blocks = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.select("file", "_block", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(starts, ["file", "_block"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "text")


def _fields(text: Column, n: int) -> Column:
    """The n first fields of a line of CSV; missing ones are null."""
    names = [f"_{i}" for i in range(n)]
    row = F.from_csv(text, ", ".join(f"{c} string" for c in names))
    return F.array(*(row[c] for c in names))


def _has(column: str) -> Column:
    return F.coalesce(F.array_contains("names", column), F.lit(False))


def _headed(spark: SparkSession, path: str | list[str], suffix: str) -> tuple[DataFrame, DataFrame, int]:
    """The lines of CSV files, the names in their first lines (file, names), and the most names of a file."""
    rows = lines(spark, path, suffix)
    first = rows.where("line = 1").withColumn("text", F.regexp_replace("text", "^﻿", ""))
    most = first.agg(F.max(F.size(F.split("text", ",")))).first()[0] or 1
    names = first.select("file", F.transform(_fields(F.col("text"), most), lambda c: F.trim(c)).alias("names"))
    return rows, names, most


def csv_rows(spark: SparkSession, path: str | list[str], columns: list[str], required: list[str] | None = None, suffix: str = "*.csv") -> DataFrame:
    """(file, line, columns): rows of CSV files, their columns as text by the names in each file's own first line.

    Columns may stand in any order; one that a file lacks is null. A file that lacks a required one (by default all) is
    left out whole, which csv_audit counts. Empty lines are no rows.
    """
    rows, names, most = _headed(spark, path, suffix)
    whole = names
    for c in columns if required is None else required:
        whole = whole.where(_has(c))
    held = rows.where((F.col("line") > 1) & (F.trim("text") != "")).join(whole, "file").withColumn("_v", _fields(F.col("text"), most))
    value = lambda c: F.when(_has(c), F.get("_v", (F.array_position("names", c) - 1).cast("int")))
    return held.select("file", "line", *(value(c).alias(c) for c in columns))


def csv_audit(spark: SparkSession, path: str | list[str], required: list[str], suffix: str = "*.csv") -> DataFrame:
    """(files, empty, headerless, rows, lost_rows): files without a line, those that lack a required column, rows, and rows of the latter."""
    rows, names, _ = _headed(spark, path, suffix)
    # the driver lists the files of every read; those without a line are in that list alone
    files = len(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).text(path).inputFiles())
    bad = F.lit(False)
    for c in required:
        bad = bad | ~_has(c)
    counts = rows.where((F.col("line") > 1) & (F.trim("text") != "")).groupBy("file").agg(F.count("*").alias("n"))
    of = names.select("file", bad.alias("bad")).join(counts, "file", "left")
    n = F.coalesce("n", F.lit(0))
    return of.agg(
        F.lit(files).cast("long").alias("files"), (F.lit(files) - F.count("*")).alias("empty"), F.count_if("bad").alias("headerless"),
        F.coalesce(F.sum(F.when(~F.col("bad"), n)), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("bad"), n)), F.lit(0)).alias("lost_rows"),
    )


def json_rows(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, suffix: str = "*") -> DataFrame:
    """(file, line, bad_line, columns of schema): the records of JSON lines files; blank lines are skipped.

    A malformed line is an error that names the first five by file and line, or (not strict) a row of nulls with its text
    in bad_line.
    """
    kind = f"{schema}, bad_line string"
    parsed = F.from_json("text", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"})
    rows = lines(spark, path, suffix).where(F.trim("text") != "").select("file", "line", parsed.alias("_r"))
    if strict:
        bad = rows.where("_r.bad_line is not null").orderBy("file", "line").select("file", "line").limit(5).collect()
        if bad:
            raise ValueError("malformed lines: " + ", ".join(f"{r['file']}:{r['line']}" for r in bad))
    return rows.select("file", "line", "_r.*")
