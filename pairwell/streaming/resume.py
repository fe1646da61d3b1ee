"""Resumable scoring of run rows as a stream.

Files of rows arrive in any order of time; each signature and item is handled once, also across restarts
and however old its rows are: every batch leaves out the keys that the output table holds already. The
checkpoint keeps which files are done, the output table which keys. A batch that was appended, wholly or
in part, before the checkpoint knew of it appends only what is missing when it runs again. The table is
partitioned by a hash of the signature, and a batch reads the keys of its own signatures' partitions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

KEYS = ["run_signature", "item_id"]
#: The table's partition column and how many values it has at most. Both stay as they are for the life of a table.
PART, PARTS = "signature_part", 256


def _part() -> Column:
    return F.pmod(F.xxhash64("run_signature"), F.lit(PARTS)).cast("int")


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the new files of a folder of JSON-lines files, repeated keys included, whatever the age of row or file."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", "100").option("maxFileAge", "36500d").json(path)
    return rows.withColumn("timestamp", F.to_timestamp("timestamp"))


def first_of_keys(rows: DataFrame) -> DataFrame:
    """The row of the earliest timestamp of each signature and item; rows without a timestamp come last."""
    order = F.struct(F.col("timestamp").isNull(), "timestamp", F.to_json(F.struct("*")))
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in KEYS]).agg(F.min_by(F.struct("*"), order).alias("__row")).select("__row.*")


def not_in(rows: DataFrame, out: str) -> DataFrame:
    """The rows whose signature and item the Parquet table out does not hold; all where there is no table yet.

    Of the table only the partitions of the signatures in rows are read, and of these the key columns. rows are computed twice.
    """
    keys = T.StructType([*(rows.schema[k] for k in KEYS), T.StructField(PART, T.IntegerType())])
    here = [r.p for r in rows.select(_part().alias("p")).distinct().collect()]  # at most PARTS numbers
    try:
        done = rows.sparkSession.read.schema(keys).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    done = done.filter(F.col(PART).isin(here)).select(*[F.col(k).alias(f"__{k}") for k in KEYS])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS]
    return rows.join(done, same, "left_anti")


def append_scored(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Scores what has arrived and is not in out, appends it as Parquet and ends; run it again to resume.

    Of equal signatures and items the first to arrive stays, within a batch the earliest. score must keep both columns.
    """

    def batch(part: DataFrame, number: int) -> None:
        first = first_of_keys(part).persist()
        try:
            scored = score(not_in(first, out))
            lost = [k for k in KEYS if k not in scored.columns]
            if lost:
                raise ValueError(f"score drops {lost}, by which a resumed run knows what is done")
            scored.withColumns({"batch": F.lit(number), PART: _part()}).write.mode("append").partitionBy(PART).parquet(out)
        finally:
            first.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_progress(rows: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Completed rows, errors and cap hits by condition and window of the rows' timestamps; meant for the table that append_scored writes."""
    return rows.groupBy(F.window("timestamp", width), "condition").agg(F.count("*").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"))
