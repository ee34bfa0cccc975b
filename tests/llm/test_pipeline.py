
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm.common import WordCodec, materialize

from .cases import ROWS, documents, empty, stored
from .test_linededup import brute


def test_stages_on_cases(spark, tmp_path):
    """Each stage keeps the columns of documents, and the last packs exactly what the one before it kept."""
    rows = [*ROWS, *((100 + i, "A fine sentence about ordinary things number %d, as good as any other of its kind." % i) for i in range(30)), *((200 + i, "!!! ### BUY %d !!! ###" % i) for i in range(30))]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int")
    path = stored(documents(spark, rows), tmp_path / "t", labels=labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, materialize(stage(spark, docs, path), f"t{k}")
        assert docs.columns == columns, name
        if name == "line dedup":
            kept = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect()) == [(i, t) for i, _, _, t in brute(kept)]
        if name == "quality classifier":
            ids = {r["doc_id"] for r in docs.collect()}
            assert len([i for i in ids if i and i >= 200]) <= 1 and set(range(100, 130)) <= ids
        if name == "SimHash near-dedup":
            assert len([r for r in docs.collect() if r["doc_id"] == 6]) <= 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    import public_tokenizers

    codec = WordCodec(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(codec.encode(r["text"])) // 2 + 1 for r in docs.collect())
    assert pieces.agg(F.sum("length")).first()[0] == total
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


@pytest.mark.parametrize("n", range(4))
def test_stages_on_an_empty_table(spark, tmp_path, n):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = stored(empty(spark), tmp_path / "t", labels=labels)
    out = corpus_pipeline.STAGES[n][1](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert out.count() == 0
