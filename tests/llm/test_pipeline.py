import corpus_pipeline as C
import numpy as np
from kinfold.llm import classifier, packing, rules

from test_dedup_packing import plain_classes

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    at = docs
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, at, SF).persist()
        assert after.columns == docs.columns
        ids = [r.doc_id for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if stage is C.quality_classifier:
            model = classifier.train(at, spark.read.parquet(f"{SF}/labels.parquet"))
            plain = lambda t: sum(model.weights.get(f, 0.0) for f in sorted(classifier.features(t or "")))
            assert set(ids) == {r.doc_id for r in at.collect() if 1 - model.at_most(np.array([plain(r.text)]))[0, 1] >= 0.5}
        if stage is C.quality_rules:
            assert set(ids) == {r.doc_id for r in rules.ledger(at).filter(rules.passes(rules.FULL)).collect()}
        if stage is C.near_duplicates:
            rows = at.select("doc_id", "text").collect()
            assert set(ids) == {min(rows[i].doc_id for i in own) for own in plain_classes([r.text for r in rows])}
        before, at = set(ids), after
    assert {r.doc_id for r in C.STAGES[-1][1](spark, at, SF).collect()} == before
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_keep_odd_rows_and_clashing_columns(spark, clashing):
    """Null and empty texts and ids, rows that repeat and columns with the operators' own names."""
    good = " ".join(f"word{i} then" for i in range(60))
    docs = clashing([(None, None), (1, ""), (2, good), (2, good), (None, good + " tail"), (3, "a b")])
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r.shard == "mine" and r.v == "mine" for r in rows)
        if stage is C.near_duplicates:
            assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3"]  # the null text is a copy of the empty one
    assert C.STAGES[-1][1](spark, docs, SF).count() == 6
