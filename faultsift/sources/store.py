"""Stores and sinks: cells as partitioned Parquet with a manifest, predictions as validated JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.operators.cells import summary
from faultsift.operators.evaluate import PREDICTION, prediction_flags

FORMAT = 1


def write_cells(table: DataFrame, path: str) -> None:
    """Write cells (modality, minute, entity, feature, value); a folder that exists is an error. The manifest comes last."""
    table.repartition("modality", "entity").write.mode("errorifexists").partitionBy("modality").parquet(f"{path}/cells")
    manifest = summary(table.sparkSession.read.parquet(f"{path}/cells")).withColumn("format", F.lit(FORMAT))
    manifest.write.mode("errorifexists").json(f"{path}/manifest")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    formats = {r[0] for r in spark.read.json(f"{path}/manifest").select("format").distinct().collect()}
    if formats != {FORMAT}:
        raise ValueError(f"unknown store format {sorted(formats)} in {path}")
    return spark.read.parquet(f"{path}/cells").select("modality", "minute", "entity", "feature", "value")


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """The records of a JSON lines file; blank lines are skipped, malformed ones an error or (not strict) rows of nulls in bad_line."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    kind = schema if strict else f"{schema}, bad_line string"
    return lines.select(F.from_json("value", kind, mode).alias("r")).select("r.*")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Write predictions as JSON lines, only if all are valid and no id repeats; Spark's committer makes the folder appear whole."""
    flagged = prediction_flags(predictions)
    bad = flagged.where(F.size("errors") > 0).select("prediction_id", "errors").limit(5).collect()
    if bad:
        raise ValueError(f"invalid predictions: {bad}")
    if predictions.groupBy("prediction_id").count().where("count > 1").limit(1).count():
        raise ValueError("prediction ids repeat")
    predictions.select(F.to_json(F.struct(*(c.split(" ")[0] for c in ("prediction_id", "start_time", "end_time", "root_cause_top5", "fault_category")))).alias("value")).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    """Write df as one JSON array of its rows to the file path, which appears whole or not at all.

    For reports of bounded size; the rows are written beside the file and moved there at the end.
    """
    spark = df.sparkSession
    part = f"{path}.{uuid.uuid4().hex}.part"
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).coalesce(1).write.text(part)
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(part)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    made = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    fs.delete(hadoop.Path(path), False)
    if not fs.rename(made, hadoop.Path(path)):
        raise OSError(f"could not move the report to {path}")
    fs.delete(at, True)


def read_config(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A public configuration, fault_taxonomy or network_elements, as a table; other names are an error."""
    if name not in ("fault_taxonomy", "network_elements"):
        raise ValueError(f"unknown public config: {name}")
    text = spark.read.text(f"{path}/{name}.json", wholetext=True)
    if name == "fault_taxonomy":
        kind = "struct<fault_categories:array<struct<fault_name:string,major_category:string,sub_category:string>>>"
        rows = text.select(F.posexplode(F.from_json("value", kind)["fault_categories"]).alias("ord", "c"))
        return rows.select(F.col("c.fault_name").alias("fault_name"), F.col("c.major_category").alias("major"), F.col("c.sub_category").alias("sub"), "ord")
    both = text.select(F.from_json("value", "struct<cities:array<string>,device_roles:array<string>>").alias("c"))
    rows = both.select(F.posexplode("c.cities").alias("i", "city"), F.col("c.device_roles").alias("roles")).select("i", "city", F.posexplode("roles").alias("j", "role"), F.size("roles").alias("n"))
    return rows.select(F.concat_ws("-", "city", "role").alias("node_id"), "city", "role", (F.col("i") * F.col("n") + F.col("j")).alias("node_idx"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with validity flags; a line that is no JSON is an invalid prediction."""
    return prediction_flags(read_json_lines(spark, path, PREDICTION, strict=False).drop("bad_line"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of all files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
