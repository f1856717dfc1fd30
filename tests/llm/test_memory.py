"""What Python workers are sent at once and what they keep."""

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

import corpus_pipeline
from tarn.llm import bpe, jaccard, toxicity
from tarn.llm.common import BATCH_BYTES, kept, small_batches
from tarn.llm.queries import ranks_path, split_pattern

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def bound(spark):
    """The session's own bound, set again afterwards."""
    before = spark.conf.get(NAME)
    spark.conf.set(NAME, "64m")
    yield spark.conf
    spark.conf.set(NAME, before)


def test_pipeline_sends_small_batches(spark, tmp_path, bound):
    docs = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat(concat(id, ' '), 1500) as text", "'en' as lang", "'a' as source", "1L as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    for name, stage in corpus_pipeline.STAGES:
        bound.set(NAME, "64m")
        stage(spark, docs, str(tmp_path))
        if name != "mixing":  # which runs no Python
            seen = docs.mapInArrow(sizes, "bytes long, rows long").collect()
            assert sum(r["rows"] for r in seen) == 4000 and sum(r["bytes"] for r in seen) > 5 * BATCH_BYTES
            assert max(r["bytes"] for r in seen) < 1.5 * BATCH_BYTES, name


def test_a_smaller_bound_stays(spark, bound):
    for own, then in (("1m", 1 << 20), ("64m", BATCH_BYTES)):
        bound.set(NAME, own)
        small_batches(spark)
        assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(bound.get(NAME)) == then


def test_batches_change_no_class(spark, bound):
    """Buckets, packs and blocks that come in many batches give the rows that those in one batch give."""
    docs = spark.range(300).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 400), i -> if(i % 200 = id % 5, id, pmod(hash(i, id div 10), 5000)))) as text")
    classes = lambda: sorted(map(tuple, jaccard.join_classes(docs).collect()))
    whole = classes()
    assert len({r[2] for r in whole}) < 300
    bound.set(NAME, "2k")
    assert classes() == whole


def test_other_operators_forget_the_codec(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two", 1)], "doc_id long, text string, toxic int")
    held = bpe.shared(docs, ranks_path(), split_pattern())
    got = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, *a: got.append(run) or self)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *a: got.append(run) or self)
    monkeypatch.setattr(jaccard.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    toxicity.score(docs, toxicity.Model({}, 0.0))
    toxicity.distinct_words(docs)
    jaccard.dealt(docs, 3, 0)
    assert len(got) == 3
    for run in got:
        coder = bpe.codec(held)
        coder.encode("one two")
        assert bpe.codec(held) is coder and coder.memo
        assert not list(run(iter([])))
        assert "codec" not in kept()
