"""A bounded sample of labelled texts to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int,
                    learn_from: Column, id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[DataFrame, float]:
    """At most per_class texts of each label, with columns id, text and label, and the share of
    label 1 among all labelled rows that may be learnt from.

    Which ones is settled by a hash of the id, alike at every size. Labels other than 0 and 1,
    and null ids, are left out; where an id has several labels, the largest holds. The ids are
    as many as the bound says, so joining them to the texts moves no text.
    """
    known = (labels.where(learn_from & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    order = F.xxhash64("id"), F.col("id")
    chosen = (known.where("label = 0").orderBy(*order).limit(per_class)
              .unionByName(known.where("label = 1").orderBy(*order).limit(per_class)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return texts.join(F.broadcast(chosen), "id"), share
