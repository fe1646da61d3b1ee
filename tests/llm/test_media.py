import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.llm import media, queries
from tests.llm import helpers


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 9, b"\xff" * 576, b"x" * 577, b"y" * 576])
def test_round_trip(data):
    p = media.payload(data)
    assert len(p) % media.UNIT == 0 and p and p.startswith(data) and set(p[len(data) :]) <= {255} and len(p) - len(data) <= media.UNIT
    stored = media.stored(p)
    assert media.read_back(stored) == p and stored[:4] == b"RIFF" and len(stored) == 44 + len(p)


def test_fingerprints_find_the_tones():
    n = media.UNIT * 6
    t = np.arange(n)
    tone = lambda b, a: a * np.sin(2 * np.pi * b * t / media.UNIT)
    samples = np.round(128 + tone(40, 60) + tone(100, 30)).astype(np.uint8)
    top = media.peaks(samples)
    assert (top == [40, 100]).all()
    codes = media.fingerprint(samples.tobytes())
    assert {(c >> 20 & 1023, c >> 10 & 1023) for c in codes.tolist()} == {(40, 40), (40, 100), (100, 40), (100, 100)}
    assert (np.diff(codes >> 32) >= 0).all() and set((codes & 1023).tolist()) == {0, 1, 2}
    assert len(media.fingerprint(b"\xff" * media.UNIT)) == 0


def test_long_texts_take_bounded_passes(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, media.UNIT * 40, dtype=np.uint8)
    whole = media.peaks(data)
    monkeypatch.setattr(media, "FRAMES", 7)
    assert (media.peaks(data) == whole).all()


def test_operator_on_odd_rows(spark):
    docs = helpers.clashing(helpers.odd_docs(spark), ["media", "n_bytes", "tail_crc32", "fingerprints"])
    got = media.features(media.with_media(docs)).collect()
    texts = sorted(((r[1] or "").encode() for r in helpers.odd_rows()), key=len)
    assert sorted(r.n_bytes for r in got) == [len(t) for t in texts]
    assert sorted(r.payload_sha256 for r in got) == sorted(hashlib.sha256(media.payload(t)).hexdigest() for t in texts)
    assert media.features(media.with_media(helpers.empty_docs(spark))).count() == 0
    null = media.features(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()
    assert null.media_bytes is None and null.fingerprints is None


def test_query(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op4_media_columns(spark, sf_dir)
    for r in rows.collect():
        p = media.payload(texts[r.doc_id])
        stored = media.stored(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(p[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert rows.groupBy("payload_sha256").agg(F.countDistinct("feature").alias("n")).filter("n > 1").count() == 0
