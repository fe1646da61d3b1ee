"""Small tables with awkward rows, and brute-force readings of texts."""

import random
import re
import zlib

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
_UP = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(_UP)


def words(text):
    return ALNUM.findall(lower(text))


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def odd_rows():
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, ties."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (None, None, None, None, None),
        (None, "no id here at all, said they", "en", None, 1),
        (1, "", "en", "a", 0),
        (1, "", "en", "a", 0),
        (2, None, "de", "b", None),
        (3, " \n\t \n", None, "b", 4),
        (4, "One two Three four five six.", "en", "a", 9),
        (4, "One two Three four five six.", "en", "a", 9),
        (5, "one TWO three four five six", "en", None, 9),
        (6, "Ünïcode çà et là 中文 \U0001f600 ß", "fr", "c", 5),
        (7, long, "en", "c", len(long)),
        (8, "x", None, "é", 1),
        (9, "12 34 !!", "", "", 1),
    ]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, names):
    """df with further columns of these names, which an operator must not trip over."""
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"t{rng.randrange(vocabulary)}" for _ in range(n)]


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
