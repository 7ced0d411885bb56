import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import langid


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 30])
def test_codewords_differ(n):
    code = langid.codewords(n)
    gaps = (code[:, None] != code[None]).sum(2)
    assert gaps[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2 if n < 7 else 4)
    assert all(0 < c.sum() < n for c in code.T)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert np.mean(right) > 0.97


def test_edges(spark):
    rows = [(i, "the thing and that other thing", "en", 0) for i in range(40)] + [(i, "über schöne straßen und häuser", "de", 0) for i in range(40, 80)]
    rows += [(100, None, "en", 0), (101, "", "de", 0), (102, "12 34 !!", "en", 0), (103, "the thing", None, 0), (103, "the thing", None, 0), (None, "und häuser", "de", 0), (104, "the " * 60_000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    got = langid.predict(docs, model)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [(by[i].lang_pred, by[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[103].lang_pred == "en" and by[104].lang_pred == "en" and by[None].lang_pred == "de"
    want = {r.doc_id: r.h for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("h")).collect()}
    assert all(by[i].held_out == bool(want[i]) for i in by)
    none = langid.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    one = langid.fit(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(docs, one).collect()} == {"en", "und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_other_columns_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.filter(~langid.held_out("doc_id")))
    a = langid.predict(docs, model).collect()
    b = langid.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model).collect()
    assert a == b
