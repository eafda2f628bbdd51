"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned by the normalised text at sampled splitters and sorted, so equal
texts lie side by side, and each row is compared in full with its neighbours. What leaves the
sort is narrow: ids, lengths and a digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm.common import SALTS, salted, stored

#: Characters that normalising deletes: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
#: Characters of the text in a splitter. Splitters are sampled on the driver, so they must stay
#: short however long the texts are; ties are settled by a hash and by the full text.
SPLITTER_CHARS = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting BLANKS. The row with the most code points in
    the original text stays, then the one with the smallest id. A null text counts as empty,
    and empty texts are one group like any other. Rows with the same id count one by one; of
    those, all share the fate of the id, since the id is what is kept. A null id sorts before
    all others. An empty table gives no rows. Other columns of the input are not read.

    A group of copies is cut into `salts` parts by id, so no task gets a whole hot group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.char_length(text).alias("_chars"),
        F.translate(text, BLANKS, "").alias("_norm"),
    ).select(
        "_id", "_chars", "_norm", F.substring("_norm", 1, SPLITTER_CHARS).alias("_head"),
        F.xxhash64("_norm").alias("_hash"), salted("_id", salts).alias("_salt"),
    )
    place = ["_head", "_hash", "_salt"]
    # A window group ends where neighbouring rows of the sort differ in their full text. It needs
    # rows of equal (head, hash, salt, text) together: the range partitioning is enough for that,
    # so the text is exchanged once.
    run = Window.partitionBy(*place, "_norm").orderBy(F.desc("_chars"), "_id").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_rows = rows.repartitionByRange(*place).select(
        "_id", "_chars", "_salt", F.sha2("_norm", 256).alias("_sha"),
        F.first("_id").over(run).alias("_best"), F.first("_chars").over(run).alias("_best_chars"),
        F.count(F.lit(1)).over(run).alias("_copies"),
        F.row_number().over(run.rowsBetween(Window.unboundedPreceding, 0)).alias("_place"),
    )
    narrow = stored(sorted_rows, "exact_dedup")
    # The parts of a hot group, one row each, meet by the digest of their text.
    heads = narrow.where("_place = 1")
    groups = heads.groupBy("_sha").agg(
        F.min(F.struct(F.negative("_best_chars").alias("c"), F.col("_best").alias("b")))["b"].alias("_keep"),
        F.sum("_copies").alias("_size"), F.collect_set("_salt").alias("_salts"),
    ).withColumn("_salt", F.explode("_salts")).drop("_salts")
    return narrow.join(groups, ["_sha", "_salt"]).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
