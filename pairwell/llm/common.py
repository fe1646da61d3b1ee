"""Helpers that the training-data operators share: folders, keys and byte-level word arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer document is a pass of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This session's own folder below spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session, whose tasks run on the driver's machine, makes a folder; any other raises.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pairwell-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def clear(spark: SparkSession) -> None:
    """Deletes what cut() and written() left in the shared folder. Call it when no result that reads from there is still needed."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.delete(path, True)
        files.mkdirs(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: later plans start from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut(), as compressed Parquet: for wide rows."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_fold(col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def text_key(col: str = "text") -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(F.col(col).cast("binary")))


#: Bits of a table of keys, which is broadcast: 4 MB whatever the number of keys.
KEY_BITS = 1 << 25


def bits_of(keys: DataFrame) -> DataFrame:
    """bucket and bitmap: KEY_BITS bits, of which each key (the binary column tkey) sets one."""
    place = F.pmod(F.xxhash64("tkey"), F.lit(KEY_BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap"))


def key_bits(keys: DataFrame) -> DataFrame:
    """bits_of(), computed once."""
    return cut(bits_of(keys))


def with_bit(rows: DataFrame, bits: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a boolean column: false only if the key is none of those of key_bits(). More keys than bits make it true more often."""
    place = F.pmod(F.xxhash64(key), F.lit(KEY_BITS)) + 1
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    both = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("bucket"), "left")
    return both.select(*rows.columns, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that have one of the names, in any case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Returns freed memory to the system: what Arrow keeps and, where the C library can, what it keeps of small objects."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, with give_back() after each batch and at the end: a worker outlives its task."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            out = None
            give_back()
        give_back()

    return outer


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes, one document at least."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if i > at and held + len(t) > limit:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


class ByteClass:
    """A class of bytes that form words. Every byte of a character beyond ASCII belongs to it."""

    def __init__(self, ascii_members: bytes):
        self.member = np.zeros(256, bool)
        self.member[np.frombuffer(ascii_members, np.uint8)] = True
        self.member[128:] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32


#: Letters and digits of ASCII, and all beyond it: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
ALNUM = ByteClass(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: [^\x20\x09-\x0D]+
SOLID = ByteClass(bytes(sorted(set(range(128)) - {32, 9, 10, 11, 12, 13})))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some documents as flat arrays.

    data: the lower-cased bytes of all words, one after another; start, size: where each word lies in it;
    first: of each document the number of its first word, and the number of all words at the end;
    hash: a 64-bit hash of each word.
    """

    def __init__(self, texts: list[bytes], kind: ByteClass):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = kind.member[raw]
        turn = np.diff(inside.view(np.int8), prepend=np.int8(0))
        opens, closes = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.size = closes - opens
        self.start = np.cumsum(self.size) - self.size
        self.data = kind.lower[raw[inside]]
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first = np.searchsorted(opens, begins)
        if len(self.size):
            offset = np.arange(len(self.data)) - np.repeat(self.start, self.size)
            weight = powers(int(self.size.max()))[offset]
            self.hash = mix(np.add.reduceat((self.data.astype(np.uint64) + np.uint64(1)) * weight, self.start) + self.size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self, which: np.ndarray) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a : a + n] for a, n in zip(self.start[which].tolist(), self.size[which].tolist(), strict=True)]


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
