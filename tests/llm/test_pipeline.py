import re
from collections import Counter

import corpus_pipeline
from stratalog.llm import op01_packing, op02_language_id, op03_decontamination, op04_pii, op06_jaccard_join
from stratalog.llm.common import Scratch


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            left = docs.count()
            assert 0.8 * n < left <= n
            n = left
    assert docs.select("doc_id").distinct().count() == n


def test_empty(spark, empty, sf_dir):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_stages_take_odd_rows(spark, docs, rows, sf_dir):
    """Nulls, empty and long texts, ties and clashing names through every stage, each against what its operator says of its input."""
    scratch, own = Scratch(spark, "test-stages"), docs
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(own)
        own = scratch.save(stage(spark, own, sf_dir), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert own.dtypes == docs.dtypes, name
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    first, second, third, fourth, fifth = map(texts, seen)
    model = op02_language_id.train(seen[0])
    assert second == Counter({(d, t): n for (d, t), n in first.items() if op02_language_id.keeps(model, t)})
    assert all(t and re.search(r"[^\W\d_]", t) for _, t in second)
    groups = op06_jaccard_join.classify(seen[1]).collect()
    # ids that several rows share name several groups, so groups are counted by who stays
    assert sum(third.values()) == len({(r.doc_id, r.h) for r in groups if r.keeper}) + sum(not r.n_shingles for r in groups) and set(third) <= set(second)
    assert {r.component_id for r in groups if r.n_shingles} == {r.doc_id for r in groups if r.keeper}
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = op03_decontamination.decontaminate(seen[2], bench).collect()
    assert sum(fourth.values()) == sum(not r.contaminated for r in marked) and set(fourth) <= set(third)
    found = op04_pii.report(seen[3]).collect()
    assert sorted(map(str, (d for d, _ in fifth.elements()))) == sorted(map(str, (d for d, _ in fourth.elements())))
    assert len(fourth - fifth) <= sum(r.n_spans > 0 for r in found)
    pieces = own.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(d for d, _ in fifth.elements())
    assert sum(r.length for r in pieces) == sum(r.length for r in op01_packing.token_pieces(seen[4], 4096).collect())


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "test-run")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    got = corpus_pipeline.run(spark, sf_dir)
    assert key(got) == key(docs) and got.count() > 100
    places = sorted((r.sequence_id, r.offset, r.length) for r in got.collect())
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:]))
