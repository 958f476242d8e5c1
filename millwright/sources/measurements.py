"""Measurement documents (JSON files with a format tag and an array of stamps) as tables, and their sinks."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.scalar import finite_positive

# fixed values of the document format
FORMAT = "stamp-perforation-results"
PATTERN = "data_*_perf.json"
SCHEMA = """format string, version int, source string, dpi double, stamps array<struct<stamp int,
  summary struct<source string, stamp int, width_px double, height_px double, width_mm double, height_mm double,
    horizontal_perforation_per_20mm string, vertical_perforation_per_20mm string>,
  measurement struct<status string>>>"""
SUMMARY = "file source stamp status width_mm height_mm horizontal vertical".split()


@dataclass(frozen=True)
class Measurements:
    """What was read: complete rows, rows without a gauge pair, and documents that can't be used."""

    rows: DataFrame
    incomplete: DataFrame
    errors: DataFrame


def find_inputs(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """``path`` of each document under ``paths``; of paths that differ by case only one, in that order."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", recursive).load(paths)
    return found.groupBy(F.lower("path").alias("_key")).agg(F.min("path").alias("path")).orderBy("_key").select("path")


def read_measurements(spark: SparkSession, paths: list[str], recursive: bool = False) -> Measurements:
    """Documents are read whole, one row each; a bad one becomes a row of ``errors`` with its reason.

    A stamp without summary or without two finite, positive gauges goes to ``incomplete``. An empty
    array of stamps gives no rows.
    """
    text = spark.read.option("pathGlobFilter", PATTERN).option("recursiveFileLookup", recursive).text(paths, wholetext=True)
    docs = text.select(F.col("_metadata.file_path").alias("file"), "value").withColumn("doc", F.from_json("value", SCHEMA))
    reason = (
        F.when(F.get_json_object("value", "$").isNull(), "not valid JSON")
        .when(~F.col("doc.format").eqNullSafe(FORMAT), "unexpected format")
        .when(F.col("doc.stamps").isNull(), "stamps is not a list")
    )
    docs = docs.withColumn("reason", reason)
    each = docs.where("reason is null").select("file", "doc.source", "doc.dpi", F.explode("doc.stamps").alias("s"))
    flat = each.select(
        "file",
        "source",
        "dpi",
        "s.stamp",
        F.col("s.measurement.status").alias("status"),
        "s.summary.width_mm",
        "s.summary.height_mm",
        F.col("s.summary.horizontal_perforation_per_20mm").alias("h_text"),
        F.col("s.summary.vertical_perforation_per_20mm").alias("v_text"),
        F.col("s.summary").isNull().alias("_bare"),
    ).select("*", finite_positive("h_text").alias("horizontal"), finite_positive("v_text").alias("vertical"))
    whole = F.col("horizontal").isNotNull() & F.col("vertical").isNotNull()
    left = flat.where(~whole).select("file", "source", "stamp", F.when(F.col("_bare"), "missing summary").otherwise("incomplete gauge pair").alias("reason"))
    return Measurements(flat.where(whole).drop("_bare", "h_text", "v_text"), left, docs.where("reason is not null").select("file", "reason"))


def write_summary(rows: DataFrame, path: str) -> None:
    """Complete gauge pairs as CSV with a header."""
    rows.select(*SUMMARY).write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; numbers that aren't finite become null."""
    clean = [F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    df.select(*clean).write.mode("overwrite").json(path)
