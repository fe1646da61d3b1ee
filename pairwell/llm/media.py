"""Media columns: texts carried as WAV, read back by the wave module and fingerprinted by spectral peaks.

A payload is stored as unsigned 8-bit mono samples, so its bytes come back as they were. The features come
from the samples read back: a short-time Fourier transform, the strongest spectral peaks of each frame, and
pairs of peaks of nearby frames as time-coded numbers (frame << 32 | bin << 20 | bin << 10 | frames apart).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairwell.llm.common import byte_texts, without

UNIT = 576
HOP = UNIT // 2
RATE = 8000
PEAKS = 2
REACH = 2
#: Frames that one transform takes, which bounds its memory.
FRAMES = 4096
#: Stored bytes that one outgoing batch holds, one row at least.
BATCH_BYTES = 8 << 20
_WINDOW = np.hanning(UNIT + 1)[:-1]


def payload(text: bytes) -> bytes:
    """The bytes of a text, filled with bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def stored(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """Of each frame the bins of its strongest local maxima, -1 where there are fewer."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    out = np.full((len(frames), PEAKS), -1, np.int64)
    for a in range(0, len(frames), FRAMES):
        spectrum = np.fft.rfft((frames[a : a + FRAMES].astype(np.float64) - 128) * _WINDOW, axis=1)
        power = np.round(spectrum.real**2 + spectrum.imag**2, 3)
        inner = power[:, 1:-1]
        score = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        rows = np.arange(len(score))
        for k in range(PEAKS):
            best = score.argmax(1)
            out[a : a + len(score), k] = np.where(score[rows, best] > 0, best + 1, -1)
            score[rows, best] = 0
    return out


def fingerprint(data: bytes) -> np.ndarray:
    """Time-coded peak pairs, within a frame and with the next REACH ones, in order of frame, distance and strength."""
    top = peaks(np.frombuffer(data, np.uint8))
    n = len(top)
    codes = np.full((n, REACH + 1, PEAKS, PEAKS), -1, np.int64)
    time = np.arange(n, dtype=np.int64) << 32
    for d in range(min(REACH, n - 1) + 1):
        one, two = top[: n - d, :, None], top[d:, None, :]
        codes[: n - d, d] = np.where((one >= 0) & (two >= 0), time[: n - d, None, None] | one << 20 | two << 10 | d, -1)
    codes[:, 0] = np.where(np.triu(np.ones((PEAKS, PEAKS), bool), 1), codes[:, 0], -1)  # each pair of a frame once
    return codes[codes >= 0]


def with_media(docs: DataFrame) -> DataFrame:
    """docs with n_bytes (of the text) and media, the WAV of its payload, in place of text.

    A null text counts as empty; an empty text is one unit of filler. Input columns of these names give way.
    """
    docs = without(docs, ["media", "n_bytes"])
    fields = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for a, b in by_size([len(t) for t in texts]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array([stored(payload(t)) for t in texts[a:b]], pa.binary())],
                    names=[*names, "n_bytes", "media"],
                )

    return docs.mapInArrow(run, schema)


def by_size(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > BATCH_BYTES:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


FEATURES = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("fingerprints", T.ArrayType(T.LongType())),
        T.StructField("fingerprint_sha256", T.StringType()),
    ]
)


def features(media: DataFrame) -> DataFrame:
    """media with, in place of the media column, what the stored bytes give: payload_bytes, payload_sha256,
    tail_crc32 (of the last 32 bytes), media_bytes, media_sha256, fingerprints (array of long) and
    fingerprint_sha256 (of those as 8-byte little-endian numbers).

    Null media gives nulls; anything that the wave module cannot read raises. Equal media give equal values.
    """
    media = without(media, FEATURES.names)
    fields = [f for f in media.schema.fields if f.name != "media"]
    schema = T.StructType([*fields, *FEATURES.fields])
    names = [f.name for f in fields]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def of(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(kinds)
        back = read_back(data)
        codes = fingerprint(back)
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), codes, hashlib.sha256(codes.astype("<i8").tobytes()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [of(x.as_py()) for x in batch.column("media")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds))], names=[*names, *FEATURES.names])

    return media.mapInArrow(run, schema)
