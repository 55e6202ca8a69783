"""What a worker process holds at the same time, and between stages."""

import pyarrow as pa

import corpus_pipeline
from cloudtally.llm import arrow, toxicity


def test_a_worker_keeps_one_thing_and_lets_go_of_it():
    made = []
    make = lambda name: lambda: made.append(name) or name
    arrow.free()
    assert [arrow.own(k, make(k)) for k in ("a", "a", "b", "a")] == ["a", "a", "b", "a"] and made == ["a", "b", "a"]
    arrow.free()
    assert arrow.own("a", make("a")) == "a" and made == ["a", "b", "a", "a"]
    arrow.free()


def test_a_large_batch_is_cut_to_the_words_that_matter_in_parts():
    n = toxicity.PART_BYTES // 10
    texts = ["bad word " * n, None, "goodness " * n, "bad"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts, "toxic": pa.array([1, 0, 0, 1], pa.int32())})
    parts = list(toxicity.matter(iter([batch]), {"bad", "good*"}))
    assert len(parts) > 1
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == [(1, "bad", 1), (2, "", 0), (3, "goodness", 0), (4, "bad", 1)]


def test_stages_send_texts_in_batches_of_bounded_bytes(spark):
    text = "word " * 20_000
    docs = spark.createDataFrame([(i, text) for i in range(200)], "doc_id long, text string").coalesce(1)
    size = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        stage = corpus_pipeline._in_small_batches(lambda spark, docs, sf_dir: docs.select("text").mapInArrow(size, "n long"))
        sizes = [r.n for r in stage(spark, docs, "").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
    assert len(sizes) > 1 and max(sizes) <= corpus_pipeline.BATCH_BYTES + 2 * len(text)
