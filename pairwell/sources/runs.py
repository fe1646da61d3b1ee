"""Reading and writing run rows: JSON lines with provenance, strict or collecting, and resumable sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.canonical import canonical_json
from pairwell.sources.lines import read_lines, split_lines


def parsed(lines: DataFrame, schema: T.StructType | str, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good rows and bad lines of a column of JSON lines; lines of white space are neither. Other columns stay.

    A line that is not one JSON object of the schema, with nothing behind it, is bad.
    """
    good, bad = split_lines(lines, schema, line)
    return good, bad.drop("problem", "message").withColumnRenamed("line_text", "line")


def read_runs(spark: SparkSession, paths: list[str], schema: T.StructType | str, strict: bool = True, recursive: bool = False) -> DataFrame:
    """Rows of JSON-lines files with source_file. strict raises an error that names the first bad line's path and number, else bad lines are left out."""
    return read_lines(spark, paths, schema, strict, recursive).drop("line")


def file_inventory(spark: SparkSession, paths: list[str], key: str, pattern: str = "*.jsonl") -> DataFrame:
    """Rows, distinct keys and total length of the lines of every file under the paths."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(paths)
    rows = lines.select(F.col("_metadata.file_path").alias("source_file"), F.get_json_object("value", f"$.{key}").alias("key"), F.octet_length("value").alias("bytes"))
    return rows.groupBy("source_file").agg(F.count("*").alias("rows"), F.countDistinct("key").alias("distinct_keys"), F.sum("bytes").alias("bytes"))


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SHA-256 of every file."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("sha256"))


def json_line(columns: list[str], sort_keys: bool = False) -> Column:
    """A row as one compact JSON line, nulls kept."""
    return F.to_json(F.struct(*(sorted(columns) if sort_keys else columns)), {"ignoreNullFields": "false"})


def write_runs(rows: DataFrame, path: str, sort_keys: bool = False, mode: str = "errorifexists") -> None:
    """Writes JSON lines, by default refusing to overwrite; files appear only when the job commits."""
    rows.select(json_line(rows.columns, sort_keys).alias("value")).write.mode(mode).text(path)


def signature(config: DataFrame, columns: list[str], length: int = 12) -> DataFrame:
    """config with run_signature: leading digits of the digest of the columns as canonical JSON, keys sorted at all depths, beyond ASCII escaped."""
    return config.withColumn("run_signature", F.left(F.sha2(canonical_json(json_line(columns)), 256), F.lit(length)))
