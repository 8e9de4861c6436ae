from zlib import crc32

from pyspark.sql import functions as F

from panelforge.llm import language_id
from tests.llm import edge


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.where(~fold))
    found = language_id.identify(docs.where(fold), model).where("n_chars > 100").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_edge_cases(spark):
    docs = edge.clash(edge.docs(spark), "score", "margin")
    model = language_id.learn(edge.docs(spark))
    found = language_id.identify(docs, model)
    assert len(found.columns) == len(set(found.columns))
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == 12
    for k in (4, 5, 6, 8):
        assert (rows[k].lang_pred, rows[k].score, rows[k].accepted) == ("und", 0.0, False)
    assert rows[1].lang_pred == "en" and rows[10].lang_pred == "de"


def test_few_languages_and_empty_tables(spark):
    docs = edge.docs(spark)
    none = language_id.learn(docs.limit(0))
    assert none == {}
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    one = language_id.learn(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.identify(docs, one).collect()} == {"und", "en"}
    assert language_id.identify(docs.limit(0), one).count() == 0


def test_fold(spark):
    ids = [(k,) for k in range(50)] + [(None,)]
    rows = spark.createDataFrame(ids, "i long").select("i", language_id.held_out(F.col("i")))
    for i, held in rows.collect():
        assert held == (i is not None and crc32(str(i).encode()) % 5 == 0)
