"""The corpus pipeline: from documents to packed sequences, each stage by one operator.

A stage decides row by row. It writes its rows with a key of their own first, runs its operator on
the key and takes the decisions back by it, so null and repeated ids are rows like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.llm.common import held_out, new_folder, stored, table, written
from duebook.llm.decontamination import contaminated
from duebook.llm.exact_dedup import exact_dedup
from duebook.llm.ngram_join import jaccard_join
from duebook.llm.packing import pack_documents
from duebook.llm.quality import fit_quality, score_quality
from duebook.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: The key of a row within a stage.
ROW = "_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, written so that a row has the same key wherever it is read."""
    rows = docs.withColumn(ROW, F.monotonically_increasing_id())
    return written(rows, new_folder(docs.sparkSession, "keyed"), compression="zstd")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    return rows.join(dropped, ROW, "left_anti").drop(ROW)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It is fitted on labelled documents of
    the stage's input, the held-out ones aside."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    rows = _keyed(docs)
    return _without(rows, score_quality(rows, model, id_col=ROW).where("predicted = 0").select(ROW))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: of the longest that with the smallest id; a null id
    sorts before all others."""
    rows = _keyed(docs)
    decided = exact_dedup(rows.select(F.struct("doc_id", ROW).alias("id"), "text"), "id")
    return _without(rows, decided.where("not kept").select(f"id.{ROW}"))


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group that links join; a null id sorts before
    all others."""
    rows = _keyed(docs)
    found = jaccard_join(rows, id_col=ROW).select(ROW, "component_id")
    linked = stored(found.where(f"component_id <> {ROW}"), "linked")
    # A group is named by its least key; its least id may be another row's.
    ends = linked.unionByName(linked.select(F.col("component_id").alias(ROW), "component_id").distinct())
    members = ends.join(rows.select(ROW, "doc_id"), ROW)
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", ROW))[ROW].alias("first"))
    dropped = ends.join(first, "component_id").where(f"{ROW} <> first").select(ROW)
    return _without(rows, dropped)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = _keyed(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return _without(rows, found.select(ROW).distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of tokens."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("exact_dedup", keep_one_copy),
    ("ngram_join", keep_one_near_copy),
    ("decontamination", keep_clean),
    ("packing", pack),
]

#: The classifier's scores and the token ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
