import corpus_pipeline
from pairwell.llm.common import written
from tests.llm import helpers
from tests.llm.test_mixing_and_sharding import targets
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_ngram_join import brute as classes


def check_mix(had, got):
    """Each source's words come near its target, no document above 3 times; targets by plain rounds."""
    words = {r.doc_id: len(helpers.SOLID.findall(r.text or "")) for r in had}
    source = {r.doc_id: r.source for r in had}
    sizes, taken, times = {}, {}, {}
    for i, n in words.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    for r in got:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + words[r.doc_id]
    assert times and max(times.values()) <= 3
    for s, n in targets(sizes).items():
        assert abs(taken.get(s, 0) - n) <= max(words[i] for i in words if source[i] == s)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "sharding"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, sf_dir))
        ids = [r.doc_id for r in after.collect()]
        had = [(r.doc_id, r.text) for r in before.collect()]
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "language_id":
            assert len(ids) >= 0.98 * len(had)
        elif name == "near_duplicates":
            assert sorted(ids) == sorted({c for _, c, _ in classes(had)})
        elif name == "decontamination":
            assert sorted(ids) == sorted(r[0] for r in contaminated(had, items) if not r[5])
        elif name == "source_mix":
            check_mix(before.collect(), after.collect())
        else:
            nth = {(r.file_name, r.row_index): r.doc_id for r in before.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()}
            order = [nth[k] for k in sorted(nth)]
            slots = {}
            for r in after.collect():
                slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
            assert all([s for s, _ in sorted(x)] == list(range(len(x))) for x in slots.values())
            for held in slots.values():  # each shard holds a subsequence of the training order
                rest = iter(order)
                assert all(i in rest for _, i in sorted(held))
            assert sorted(ids) == sorted(i for i, _ in had) and after.columns == [*docs.columns, "shard", "slot"]
        before = after


def test_every_stage_takes_odd_and_empty_documents(spark, sf_dir):
    for docs in (helpers.clashing(helpers.odd_docs(spark), ["shard", "class_id", "size"]), helpers.empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, sf_dir)
            assert after.count() <= 3 * docs.count()
            assert set(docs.columns) <= set(after.columns), name


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
