"""The pipeline over the awkward table: stages chain, columns stay, decisions take effect."""

import corpus_pipeline
import pytest
from ecospark.llm.queries import ORACLES, QUERIES


def test_queries_are_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES if k.startswith("op")} == set(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


def test_stages(spark, docs, pieces, words_file):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language_id", "line_dedup", "near_dedup", "packing"]
    now, ids = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, ""))
        assert now.columns == docs.columns, name
        ids.append({r.doc_id for r in now.select("doc_id").collect()})
    assert ids[0] >= ids[1] >= ids[3] and ids[1] == ids[2]
    assert not {74, 75, 76, 77, 78, 83} & ids[0]
    # the copies of text 8 lose every line to the first one; without words they are copies of nothing
    assert {r.doc_id for r in now.filter("text = ''").collect()} >= {70, 71, 72, 73} & ids[0]
    assert len({r.text for r in now.collect() if r.text}) == now.filter("text <> ''").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids[3]


def test_empty_documents(spark, none, pieces, words_file):
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, ""))
    assert now.count() == 0


@pytest.mark.parametrize("name", ["doc_id", "text"])
def test_missing_columns_read_as_null(spark, docs, pieces, name):
    from ecospark.llm import tokencount

    assert tokencount.count_tokens(docs.drop(name), pieces).count() == docs.count()
