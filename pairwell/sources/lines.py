"""Strict JSON lines: each line with its file and number, what is wrong with it, and rows or errors of whole scans.

Spark reads files in splits that know where they begin but not how many lines lie before. Lines are numbered
within their split as it is read; the counts of a file's splits, added up, give where each split's lines begin.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What can be wrong with a line.
INVALID, NOT_OBJECT, OTHER_SCHEMA = "invalid_json", "not_object", "other_schema"
CORRUPT = "_corrupt_record"
_PROBLEM = T.StructType([T.StructField("blank", T.BooleanType()), T.StructField("problem", T.StringType()), T.StructField("message", T.StringType())])


def text_lines(spark: SparkSession, paths: list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """value, source_file and block (where its split begins) of every line of the files."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))


def numbered(lines: DataFrame) -> DataFrame:
    """lines (as of text_lines) with line, its number in the file from 1, in place of block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pa.compute.dictionary_encode(batch.column("source_file"))
            codes, blocks = names.indices.to_numpy(), batch.column("block").to_numpy()
            new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])
            first = (names.dictionary[int(codes[0])].as_py(), int(blocks[0]))
            at = np.arange(batch.num_rows)
            begun = np.maximum.accumulate(np.where(new, at, 0))
            nth = at - begun + np.where(begun == 0, seen if first == split else 0, 0)
            split, seen = (names.dictionary[int(codes[-1])].as_py(), int(blocks[-1])), int(nth[-1]) + 1
            yield batch.append_column("nth", pa.array(nth, pa.int64()))

    sums = lines.groupBy("source_file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source_file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    each = lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("nth", T.LongType())]))
    # a row a split, whatever the splits hold
    both = each.join(F.broadcast(starts), (F.col("source_file") == F.col("f")) & (F.col("block") == F.col("b")))
    return both.select("source_file", (F.col("start") + F.col("nth") + 1).alias("line"), *[c for c in lines.columns if c not in ("source_file", "block")])


@F.arrow_udf(_PROBLEM)
def _problems(lines: pa.Array) -> pa.Array:
    out = []
    for line in lines.to_pylist():
        if line is None or not line.strip():
            out.append({"blank": True})
            continue
        try:
            value = json.loads(line)
            out.append({"blank": False} if isinstance(value, dict) else {"blank": False, "problem": NOT_OBJECT, "message": "expected a JSON object"})
        except (ValueError, RecursionError) as e:
            out.append({"blank": False, "problem": INVALID, "message": f"invalid JSON: {e}"})
    return pa.array(out, pa.struct([("blank", pa.bool_()), ("problem", pa.string()), ("message", pa.string())]))


def problem(line: Column | str) -> Column:
    """blank, problem (null for one JSON object) and message of a line. White space of any kind is blank; what follows an object is an error."""
    return _problems(line)


def split_lines(lines: DataFrame, schema: T.StructType | str, line: str = "value", objects: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows (the schema's columns) and bad lines (line, problem, message) of a column of JSON lines; blank lines are neither.

    Other columns stay. A line is bad if it is no JSON, no object (unless objects is false: then it is left out), or
    holds values of other types than the schema's.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rest = [c for c in lines.columns if c != line]
    seen = lines.withColumn("__p", problem(line)).filter(~F.col("__p.blank"))
    rows = seen.withColumn("__row", F.from_json(F.when(F.col("__p.problem").isNull(), F.col(line)), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "allowSingleQuotes": "false"}))
    kind = F.coalesce(F.col("__p.problem"), F.when(F.col(f"__row.{CORRUPT}").isNotNull(), OTHER_SCHEMA))
    rows = rows.withColumn("__kind", kind)
    good = rows.filter("__kind is null").select(*rest, *[F.col(f"__row.{f.name}") for f in schema.fields])
    bad = rows.filter(F.col("__kind").isNotNull() if objects else F.col("__kind").isin(INVALID, OTHER_SCHEMA))
    return good, bad.select(*rest, F.col(line).alias("line_text"), F.col("__kind").alias("problem"), F.coalesce("__p.message", F.lit("values of other types")).alias("message"))


def first_error(bad: DataFrame) -> Exception | None:
    """The first bad line (source_file, line, problem, message) as an error that names path:line: TypeError for what is no object, else ValueError."""
    found = bad.orderBy("source_file", "line").limit(1).collect()
    if not found:
        return None
    r = found[0]
    return (TypeError if r.problem == NOT_OBJECT else ValueError)(f"{r.source_file}:{r.line}: {r.message}")


def read_lines(spark: SparkSession, paths: list[str], schema: T.StructType | str, strict: bool = True, recursive: bool = False, objects: bool = True) -> DataFrame:
    """source_file, line and the schema's columns of JSON-lines files. strict raises the first bad line's error; else bad lines are left out."""
    good, bad = collected_lines(spark, paths, schema, recursive, objects)
    error = first_error(bad) if strict else None
    if error:
        raise error
    return good


def collected_lines(spark: SparkSession, paths: list[str], schema: T.StructType | str, recursive: bool = False, objects: bool = True) -> tuple[DataFrame, DataFrame]:
    """As split_lines(), of files: good rows and bad lines, each with source_file and line."""
    return split_lines(numbered(text_lines(spark, paths, recursive, "*.jsonl" if recursive else None)), schema, objects=objects)


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, text, problem and message of files that hold one JSON document each; a document that is no object is a problem."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    p = problem("text")
    return whole.withColumn("__p", p).select("source_file", "text", F.when(F.col("__p.blank"), INVALID).otherwise(F.col("__p.problem")).alias("problem"), F.when(F.col("__p.blank"), "invalid JSON: no document").otherwise(F.col("__p.message")).alias("message"))


def load_document(spark: SparkSession, path: str) -> dict:
    """The object of one small JSON file; an error names the file."""
    r = documents(spark, [path]).first()
    if r is None:
        raise FileNotFoundError(path)
    if r.problem:
        raise (TypeError if r.problem == NOT_OBJECT else ValueError)(f"{path}: {r.message}")
    return json.loads(r.text)


def write_or_verify(spark: SparkSession, path: str, manifest: dict, immutable: tuple[str, ...]) -> bool:
    """Writes a manifest if there is none (true); else raises if one of the immutable keys differs, and writes nothing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        there = load_document(spark, path)
        differ = [k for k in immutable if there.get(k) != manifest.get(k)]
        if differ:
            raise ValueError(f"{path} manifest mismatch: {differ}")
        return False
    spark.createDataFrame([(json.dumps(manifest, indent=2),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return True
