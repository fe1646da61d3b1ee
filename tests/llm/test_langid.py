import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.llm import langid, queries
from tests.llm import helpers

SYLLABLES = {"aa": ["ka", "ro", "mi", "tel"], "bb": ["zu", "wen", "pro", "ix"], "cc": ["éo", "ñan", "quo", "lus"]}


def sentence(lang, seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def training(n=120):
    return [(i, sentence(lang, i, 40), lang, "s", 1) for i, lang in enumerate(sorted(SYLLABLES) * n)]


@pytest.fixture(scope="module")
def model(spark):
    return langid.learned(spark.createDataFrame(training(), helpers.SCHEMA), F.lit(True))


def normal(text):
    lower, _ = langid.letters()
    out = []
    for ch in (text or "") + " ":
        c = chr(lower[ord(ch)])
        if c != " " or (out and out[-1] != " "):
            out.append(c)
    return "".join(out)


class Brute:
    """Interpolated Kneser-Ney with dictionaries, from the same sample."""

    def __init__(self, texts):
        k = langid.ORDER
        grams = Counter()
        for t in texts:
            padded = "\1" * (k - 1) + " " + normal(t)
            if normal(t):
                grams.update(padded[i - k + 1 : i + 1] for i in range(k, len(padded)))
        self.level = {k: grams}
        for n in range(k - 1, 0, -1):
            self.level[n] = Counter(g[1:] for g in self.level[n + 1])
        self.cut, self.total, self.types = {}, {}, {}
        for n, c in self.level.items():
            once, twice = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
            self.cut[n] = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
            self.total[n], self.types[n] = Counter(), Counter()
            for g, x in c.items():
                self.total[n][g[:-1]] += x
                self.types[n][g[:-1]] += 1

    def p(self, g, alphabet):
        n = len(g)
        lower = 1 / (alphabet + 1) if n == 1 else self.p(g[1:], alphabet)
        total = self.total[n][g[:-1]]
        if not total:
            return lower
        return max(self.level[n][g] - self.cut[n], 0) / total + self.cut[n] * self.types[n][g[:-1]] / total * lower


def test_costs_equal_a_plain_model(spark):
    rows = training(20)
    docs = spark.createDataFrame(rows, helpers.SCHEMA)
    model = langid.learned(docs, F.lit(True), sample_docs=10_000)
    part = docs.filter(F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(1 << 30)) / float(1 << 30) >= langid.CALIBRATION)
    fit = {}
    for r in part.collect():
        fit.setdefault(r.lang, []).append(r.text)
    alphabet = len({c for texts in fit.values() for t in texts for c in normal(t)})
    plain = [Brute(fit[lang]) for lang in model.langs]
    texts = [sentence("aa", 900, 9), "Ka ro, MI! zu-wen 77 éo", "xyz ж", "k", *[t for t in ("  ka\n\nro  ",)]]
    bits, sizes, _ = model.costs(texts)
    for i, t in enumerate(texts):
        padded = "\1" * (langid.ORDER - 1) + " " + normal(t)
        want = [sum(-math.log2(m.p(padded[j - langid.ORDER + 1 : j + 1], alphabet)) for j in range(langid.ORDER, len(padded))) for m in plain]
        assert sizes[i] == len(normal(t))
        np.testing.assert_allclose(bits[i], want, rtol=2e-4)


def test_held_out_accuracy_and_rejection(spark, model):
    rows = [(i, sentence(lang, 10_000 + i, 12), lang, "s", 1) for i, lang in enumerate(sorted(SYLLABLES) * 60)]
    got = langid.identify(spark.createDataFrame(rows, helpers.SCHEMA), model).collect()
    assert all(r.lang_pred == r.lang and not r.rejected and 0.9 < r.score <= 1 for r in got)
    noise = [(i, "".join(random.Random(i).choice("bcdfghjklmnpqrstvwxyz") for _ in range(400)), None, None, None) for i in range(20)]
    frame = spark.createDataFrame(noise, helpers.SCHEMA)
    assert all(r.rejected for r in langid.identify(frame, model).collect())
    assert langid.accepted(spark.createDataFrame(rows + noise, helpers.SCHEMA), model).count() == len(rows)


def test_odd_rows(spark, model):
    docs = helpers.clashing(helpers.odd_docs(spark), ["score", "Lang_Pred", "rejected"])
    got = langid.identify(docs, model).collect()
    assert len(got) == len(helpers.odd_rows())
    for r in got:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == langid.UNKNOWN) == (not has) and 0 <= r.score <= 1 and (has or r.rejected and r.score == 0)
    assert langid.identify(helpers.empty_docs(spark), model).count() == 0


def test_nothing_to_learn_from(spark):
    for docs in (helpers.empty_docs(spark), helpers.odd_docs(spark).withColumn("lang", F.lit(None).cast("string")), helpers.odd_docs(spark).withColumn("text", F.lit(""))):
        model = langid.learned(docs, F.lit(True))
        assert {r.lang_pred for r in langid.identify(helpers.odd_docs(spark), model).collect()} == {langid.UNKNOWN}


def test_one_language_and_tiny_samples(spark):
    docs = spark.createDataFrame([(i, "abc abd", "en", "s", 1) for i in range(30)], helpers.SCHEMA)
    got = langid.identify(docs, langid.learned(docs, F.lit(True))).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("en", 1.0)}


def test_query_learns_only_from_its_fold(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs) and all(got[d.doc_id].held_out == (helpers.fold(d.doc_id) == 0) for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)


def test_repeated_ids_and_rows_neither_thin_out_nor_swell_the_sample(spark):
    one_id = [(i, sentence(lang, n, 12), lang, "s", 1) for i, lang in enumerate(sorted(SYLLABLES)[:2]) for n in range(300)]
    copies = [(50 + n % 3, sentence("cc", n % 3, 40), "cc", "s", 1) for n in range(600)]
    docs = spark.createDataFrame(one_id + copies, helpers.SCHEMA)
    have = {r.lang: (r.n, r.held) for r in langid.sampled(docs, 100).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("held").alias("held")).collect()}
    assert set(have) == set(SYLLABLES) and have["cc"][0] == 3
    for lang in ("aa", "bb"):
        assert 60 < have[lang][0] < 140 and 0 < have[lang][1] < 0.5 * have[lang][0]
    model = langid.learned(docs, F.lit(True), sample_docs=100)
    new = spark.createDataFrame([(i, sentence(lang, 20_000 + i, 12), lang, "s", 1) for i, lang in enumerate(sorted(SYLLABLES) * 5)], helpers.SCHEMA)
    assert all(r.lang_pred == r.lang for r in langid.identify(new, model).collect())


def test_a_rare_language_is_learned_though_all_its_rows_are_drawn_to_calibrate(spark):
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    held = spark.range(5_000, 5_100).filter(part < langid.CALIBRATION).first().id
    common = [r for r in training(40) if r[2] != "cc"]
    docs = spark.createDataFrame([*common, (held, sentence("cc", 1, 60), "cc", "s", 1), (4_999, "12 !", "dd", "s", 1)], helpers.SCHEMA)
    model = langid.learned(docs, F.lit(True))
    assert model.langs == ["aa", "bb", "cc"]
    new = spark.createDataFrame([(i, sentence("cc", 30_000 + i, 20), "cc", "s", 1) for i in range(5)], helpers.SCHEMA)
    assert {r.lang_pred for r in langid.identify(new, model).collect()} == {"cc"}


def test_without_a_language_texts_with_letters_stay(spark):
    docs = helpers.odd_docs(spark)
    letters = sum(any(c.isalpha() for c in r[1] or "") for r in helpers.odd_rows())
    for unlabelled in (docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("doc_id", F.lit(None).cast("long"))):
        model = langid.learned(unlabelled, langid.default_learn())
        assert model.langs == [] and langid.accepted(unlabelled, model).count() == letters > 0


def test_only_cross_entropy_rejects(spark):
    texts = [sentence("aa", i, 40) for i in range(60)]
    docs = spark.createDataFrame([(2 * i + k, t, lang, "s", 1) for i, t in enumerate(texts) for k, lang in enumerate(("aa", "also aa"))], helpers.SCHEMA)
    model = langid.learned(docs, F.lit(True))
    assert not hasattr(model, "least")  # a bound of the score that no score can fall below
    got = langid.identify(docs.filter("lang = 'aa'"), model).collect()
    assert all(not r.rejected for r in got) and min(r.score for r in got) < 0.9
