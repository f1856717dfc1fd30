"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from tarn.llm import ann, bpe, chat, jaccard, licenses, lm, minhash, mixing, secrets, toxicity
from tarn.llm.common import crc_mod
from tarn.llm.queries import ranks_path, split_pattern

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASH = "score labels spans n_words ids size taken digest words toxic fingerprint own range key detections base cleaned toxicity decodes times row known word c".split()
LONG = "alpha beta gamma delta " * 30_000
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one", "en", "b", 3),
    (4, "one", "en", "b", 3),
    (5, "the idiot said one two three", None, "b", 28),
    (None, "no id here at all", "en", None, 17),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG + "x", "en", "a", len(LONG) + 1),
    (8, "\U0001f600 İK mit ß \x00\x1f end", "de", "c", 20),
    (8, "another text with the same id", "de", "c", 29),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.selectExpr("*", *(f"'x' as {c}" for c in CLASH))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def run_all(spark, docs):
    """Each operator on documents -> its number of rows."""
    model = toxicity.Model({"idiot": 5.0}, -2.0)
    return {
        "toxicity": toxicity.score(docs, model).count(),
        "licenses": licenses.scan(docs).count(),
        "minhash": minhash.edit_check(docs).count(),
        "lm": lm.score(docs, crc_mod(F.col("doc_id"), 7) != 2).count(),
        "secrets": secrets.scan(docs, redacted="cleaned").count(),
        "jaccard": jaccard.join_classes(docs).count(),
        "bpe": bpe.encode_texts(docs, ranks_path(), split_pattern(), check="decodes").where("decodes").count(),
        "digests": bpe.digests(docs, ranks_path(), split_pattern()).count(),
        "mixing": mixing.mix(docs).count(),
    }


def test_every_row_comes_back(spark, docs):
    assert set(run_all(spark, docs).values()) == {len(ROWS)}


def test_empty_tables(spark, empty):
    assert set(run_all(spark, empty).values()) == {0}


def test_clashing_columns(spark, clashing):
    assert set(run_all(spark, clashing).values()) == {len(ROWS)}
    assert licenses.scan(clashing).schema["score"].dataType == T.DoubleType()
    assert toxicity.score(clashing, toxicity.Model({}, 0.0)).schema["score"].dataType == T.DoubleType()


def test_toxicity_defined_cases(spark, docs, empty):
    for rows in ([], [(5, None)], [(5, 1)], [(None, 1), (5, 1), (5, 0), (4, 0), (99, 1)]):
        model = toxicity.train(docs, labels(spark, rows), crc_mod(F.col("doc_id"), 5) != 99)
        scores = [r.score for r in toxicity.score(docs, model).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert toxicity.train(empty, labels(spark, [(1, 1)]), crc_mod(F.col("doc_id"), 5) != 99).weights == {}


def test_licenses_defined_cases(docs):
    found = {(r.doc_id, r.text): r for r in licenses.scan(docs).collect()}
    for key in ((1, None), (2, ""), (3, " \t\n")):
        r = found[key]
        assert (r.n_words, r.n_base, r.first_word, r.labels, r.score) == (0, 0, None, "", 0.0)
    assert found[(6, LONG)].n_words == 120_000 and found[(4, "one")].n_words == 1


def test_minhash_defined_cases(docs):
    rows = minhash.edit_check(docs).collect()
    blank = [r for r in rows if r.n_chars in (0, 3) and r.fingerprint == ""]
    assert len(blank) == 3  # null, empty and white space
    assert len({r.fingerprint for r in rows if r.doc_id == 4}) == 1
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


def test_jaccard_defined_cases(docs):
    found = {}
    for r in jaccard.join_classes(docs, k=3, num=90, den=100).collect():
        found.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.n_links))
    assert found[1] == [(0, 1, 0)] and found[2] == [(0, 2, 0)]
    assert found[4] == [(1, 4, 1), (1, 4, 1)]  # repeated rows are copies
    assert found[6][0][0] == 4 and found[None][0][1] is None
    assert len(found[8]) == 2


def test_mixing_defined_cases(docs):
    rows = mixing.mix(docs).collect()
    assert all(r.taken <= 2 * r.size for r in rows)
    assert {r.taken for r in rows if r.size == 0} == {0}
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    assert {s: sum(x.size for x in v) == v[0].source_size for s, v in by_source.items()} == dict.fromkeys(("a", "b", "c", None), True)


def test_lm_defined_cases(docs):
    rows = {(r.doc_id, r.n_tokens): r for r in lm.score(docs, crc_mod(F.col("doc_id"), 7) != 99).collect()}
    assert rows[(1, 1)].n_known == 1 and rows[(1, 1)].score < 0
    nothing = lm.score(docs, crc_mod(F.col("doc_id"), 7) == 99).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in nothing)


def test_ann_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (1, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    out = ann.search(ann.index(v), v.where("vec_id in (0, 3, 9)"))
    assert sorted(map(tuple, out.collect())) == [(0, 1, 1, 0.0), (0, 2, 8, 1.0)]
    none = v.where("vec_id > 100")
    assert ann.search(ann.index(none), none).count() == 0
    assert ann.search(ann.index(v), none).count() == 0


def test_chat_defined_cases(spark):
    records = ["{}", "not json", None, '{"messages":[]}', '{"messages":[{"role":null,"content":null}]}', '{"prompt":"a","completion":"b","formatted":1}', '{"prompt":"a","completion":"b"}']
    out = chat.format_chat(spark.createDataFrame([(r, 1) for r in records], "record string, formatted int")).collect()
    assert [r.layout for r in out] == [None, None, None, None, "messages", None, "prompt_completion"]
    assert [r.formatted for r in out][:4] == ["", "", "", ""] and out[4].formatted == "<|im_start|>\n<|im_end|>\n"
    assert chat.format_chat(spark.createDataFrame([], "record string")).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, docs, empty, clashing, name):
    labels(spark, [(5, 1), (1, 0), (2, 0), (3, 0), (4, 0), (6, 0), (None, 1)]).selectExpr("*", "0 as quality").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    for some in (docs, empty, clashing):
        some.write.mode("overwrite").parquet(str(tmp_path / "docs"))
        out = stage(spark, spark.read.parquet(str(tmp_path / "docs")), str(tmp_path))
        n = out.count()
        assert n == 0 if some is empty else n > 3
        if name != "bpe":
            assert out.columns == list(corpus_pipeline.COLUMNS)
