"""The pipeline's stages against plain versions, each on its own input."""

from collections import Counter

import corpus_pipeline
from twinscan.llm import quality, toxicity
from twinscan.llm.common import materialize, table

from .helpers import ODD, no_docs, odd_docs
from .test_groups import brute


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, small), name)
        assert kept.columns == names
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in kept.collect()}
        assert 0 < len(after) < len(before)
        assert all(before[k] == r for k, r in after.items())
        labels = {r.doc_id: r for r in table(spark, small, "labels").collect()}
        if name == "quality":
            good = [k for k in before if k in labels and labels[k].quality == 1]
            assert sum(k in after for k in good) > 0.95 * len(good)
        if name == "near_duplicates":
            classes = brute([(r.doc_id, r.text) for r in before.values()])
            assert set(after) == {c for _, c, _ in classes}
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    load = Counter()
    for r in packed:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 4096


def test_decisions_follow_the_scores(spark, tiny):
    docs = table(spark, tiny, "documents")
    net = toxicity.learn(docs, table(spark, tiny, "labels"))
    fine = {r.doc_id for r in toxicity.score(docs, net).collect() if r.score < corpus_pipeline.TOXIC}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, tiny).collect()} == fine
    model = quality.learn(docs, table(spark, tiny, "labels"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= corpus_pipeline.GOOD}
    assert {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, tiny).collect()} == good


def test_stages_on_odd_rows(spark, tiny):
    """Nulls, blank, long and repeated texts, and columns named like those that stages might add."""
    odd = odd_docs(spark).withColumnsRenamed({"score": "_score", "rank": "_id"})
    odd = odd.selectExpr("*", "1 as _toxic", "2 as _good", "'x' as _row", "3 as _hash", "4 as `_BUCKET`")
    extra = odd.columns
    before = Counter(map(tuple, odd.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, tiny)
        assert kept.columns == extra, name
        after = Counter(map(tuple, kept.collect()))
        assert after <= before
        if name == "near_duplicates":
            assert sorted(r[0] for r in after) == [1, 2, 6, 7, 8, 9]
        else:  # repeated rows share their fate
            assert all(n == before[r] for r, n in after.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, tiny).collect()
    assert sum(r.piece == 0 for r in packed) == len(ODD)


def test_stages_on_empty_tables(spark, tiny):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, no_docs(spark), tiny)
        assert got.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == no_docs(spark).columns


def test_blank_texts_are_not_toxic(spark, tiny):
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, odd_docs(spark), tiny).collect()}
    assert {2, 3, 4} <= kept
