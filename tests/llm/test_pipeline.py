import corpus_pipeline
from tests.conftest import SF0001

from tabwise.llm import lines, mixing, near, packing, toxicity
from tabwise.llm.common import table, written


def test_stages_take_effect(spark):
    docs = table(spark, SF0001, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "source_mix", "packing"]
    model = toxicity.train(docs, table(spark, SF0001, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    step = written(corpus_pipeline.without_toxic(spark, docs, SF0001))
    assert step.columns == docs.columns
    assert {r["doc_id"] for r in step.collect()} == {r["doc_id"] for r in docs.collect()} - toxic

    want = {r["doc_id"]: r["text"] for r in lines.dedup_lines(step).collect()}
    step = written(corpus_pipeline.without_recurring_lines(spark, step, SF0001))
    assert {r["doc_id"]: r["text"] for r in step.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in step.collect()) and step.dtypes == docs.dtypes

    first = {r["class_id"] for r in near.near_duplicates(step).collect()}
    step = written(corpus_pipeline.without_near_duplicates(spark, step, SF0001))
    assert sorted(r["doc_id"] for r in step.collect()) == sorted(first)

    place = {r["doc_id"]: r["mix_position"] for r in mixing.mix(step).collect()}
    mixed = corpus_pipeline.in_mix_order(spark, step, SF0001)
    assert [r["doc_id"] for r in mixed.collect()] == sorted(place, key=place.get)
    step = written(mixed)

    key = lambda r: (r["doc_id"], r["piece"])
    last = sorted(corpus_pipeline.packed(spark, step, SF0001).collect(), key=key)
    assert sorted(packing.pack(step).collect(), key=key) == last
    assert sorted(corpus_pipeline.run(spark, SF0001).collect(), key=key) == last


def test_empty_documents(spark):
    docs = table(spark, SF0001, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF0001))
        assert docs.count() == 0


def test_nulls_pass(spark):
    docs = table(spark, SF0001, "documents").limit(5).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (None, "some text", None, None, None)], table(spark, SF0001, "documents").schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF0001))
    assert docs.filter("doc_id is null").count() == 2
