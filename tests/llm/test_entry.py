"""The registered queries and the pipeline over the test tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import check
import corpus_pipeline
from duebook.llm import queries
from tests.llm.conftest import frame, sentence

MIDDLE = "/root/testdata/sf0.01"


def test_all_are_registered():
    assert {*queries.queries(), "pipeline"} <= set(contract.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    got = queries.queries()[name](spark, MIDDLE).toPandas()
    want = check.database(MIDDLE).execute(queries.oracle_sql()[name]).df()
    assert check.compare(got, want) == ""


def test_pipeline(spark):
    """Each stage against what its operator says about its input; documents keep their columns."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").cache()
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, MIDDLE).cache()
        assert rows.columns == docs.columns and rows.join(docs, docs.columns, "left_anti").count() == 0
        left.append(rows.count())
        docs = rows
    assert left == sorted(left, reverse=True) and left[0] < 1000 and left[-1] > 600
    good = labels.where("quality = 1").join(docs, "doc_id", "left_anti").count()
    assert docs.join(labels.where("quality = 0"), "doc_id").count() <= 2
    assert good < labels.count() / 4  # copies and leaks only
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    items = [r.text for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    assert not any(i in t for i in items for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, MIDDLE).toPandas()
    assert set(packed["doc_id"]) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()


def test_stages_decide_row_by_row(spark, tmp_path):
    """Null ids, wholly repeated rows, and two texts under one id."""
    rng = random.Random(4)
    item, near = sentence(rng, 40), sentence(rng, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, rows):
        got = stage(spark, frame(spark, rows), str(tmp_path))
        assert got.columns == frame(spark, rows).columns
        return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)

    copies = [(3, "B"), (5, "B"), (5, "unique"), (7, "same"), (7, "same"), (None, "void"), (None, "void"), (2, "void")]
    assert left(corpus_pipeline.keep_one_copy, copies) == sorted(
        [(3, "B"), (5, "unique"), (7, "same"), (None, "void")], key=str)
    nears = [(9, near), (4, near + " end"), (4, "another text"), (6, item), (6, item), (None, f"{item} x"), (8, None), (8, "")]
    assert left(corpus_pipeline.keep_one_near_copy, nears) == sorted(
        [(4, near + " end"), (4, "another text"), (None, f"{item} x"), (8, None), (8, "")], key=str)
    dirty = [(1, f"x {item} y"), (1, "clean"), (None, item), (None, "clean"), (2, item), (2, item)]
    assert left(corpus_pipeline.keep_clean, dirty) == sorted([(1, "clean"), (None, "clean")], key=str)


def test_rejected_rows_go_whatever_their_id(spark, monkeypatch, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "fit_quality", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline, "score_quality", lambda rows, _, id_col="doc_id": rows.select(
        id_col, F.when(F.col("text") == "bad", 0).otherwise(1).alias("predicted")))
    rows = [(1, "bad"), (1, "good"), (None, "bad"), (None, "good")]
    got = corpus_pipeline.keep_good(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(1, "good"), (None, "good")]
