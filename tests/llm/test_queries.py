"""Every registered query of the subpackage runs and equals its SQL where it has one; the pipeline's stages."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as registry
import corpus_pipeline
from check_oracle import compare, connect
from lexiloom.llm.queries import ORACLE, QUERIES
from lexiloom.llm.toxicity import score
from lexiloom.sources.tables import table

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_query(spark, name):
    ok, note = compare(spark, connect(SMALL), SMALL, name)
    assert ok, note


def test_all_are_registered():
    assert set(QUERIES) <= set(registry.queries()) and set(ORACLE) <= set(registry.oracle_sql())


def test_stages_take_and_return_documents(spark):
    docs = table(spark, SMALL, "documents")
    kept = docs
    toxic = {r.doc_id for r in score(docs, table(spark, SMALL, "labels")).where("predicted = 1").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, kept, SMALL), "test")
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in kept.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        seen.append((name, len(before - after)))
        if name == "toxicity":
            assert before - after == toxic
        if name == "pii":
            assert before == after
        kept = out
    assert [name for name, _ in seen] == ["toxicity", "exact_dedup", "near_dedup", "pii"]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in kept.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, last))
