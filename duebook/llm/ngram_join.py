"""Jaccard join of documents by word n-grams, as a blocked sparse matrix product.

The matrix has a row per distinct shingle set and a column per shingle. Columns are ordered from
rare to frequent, and of each row only the first columns are multiplied: two rows of similarity t
share one of the first n - ceil(t n) + 1. Blocks are the columns' entries within a range of row
sizes. A pair is dropped as soon as the bound that its sizes give can't be reached: first by the
places of the column in both rows, then by the accumulated overlap count of their first columns.
What is left is verified on whole sets.

Copies are one row from the start. A column with many rows would still give the square of their
number, so a few rounds first multiply each block with one of its rows only; the links found join
rows to components, and the full product then leaves out pairs within one. No link between
components is lost by that, and links within one change no answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm.common import Scratch, joined_evenly, salted, stored
from duebook.llm.components import components
from duebook.llm.words import hashes_of, shingles_of, words_of

SHINGLE = 5
#: Linked if PER_CENT_UNION * |intersection| >= this * |union|.
PER_CENT = 80
#: Cells of the counts that order the columns. A cell counts all shingles that hash to it, in all
#: documents; the order need only be the same everywhere, so sharing cells costs no link.
CELL_BITS, SLICES, TASK_GROUPS = 20, 64, 64
#: Rows of a column, by its cell, above which its entries are dealt by row as well.
HOT_COLUMN = 20_000
STAR_ROUNDS = 2
#: First columns, in all, after which the rows made so far leave the worker.
HELD_COLUMNS = 250_000


def _sets(text: str | None, size: int) -> np.ndarray:
    shingles = shingles_of(hashes_of(words_of(text)), size)
    shingles.sort()
    return shingles[np.append(True, shingles[1:] != shingles[:-1])[: len(shingles)]]


def column_counts(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Documents per cell, over all of them; of fixed size. Tasks' counts are added in two levels,
    so no task holds those of all others."""
    width = (1 << CELL_BITS) // SLICES

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                cells = (_sets(text, size) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)
                np.add.at(counts, cells, 1)
        task = TaskContext.get().partitionId() % TASK_GROUPS
        yield pd.DataFrame({"slice": range(SLICES), "task": task,
                            "counts": [c.astype("<i8").tobytes() for c in counts.reshape(SLICES, width)]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for counts in group["counts"]:
            total += np.frombuffer(counts, "<i8")
        return group.head(1).assign(counts=[total.tobytes()])

    schema = "slice long, task long, counts binary"
    rows = (docs.select(F.col(text_col).alias("text")).mapInPandas(counted, schema)
            .groupBy("slice", "task").applyInPandas(added, schema)
            .groupBy("slice").applyInPandas(added, schema)).toPandas()
    total = np.zeros((SLICES, width), dtype=np.int64)
    for place, counts in zip(rows["slice"], rows["counts"]):
        total[place] = np.frombuffer(counts, "<i8")
    return total.ravel()


def needed_columns(n: int, per_cent: int) -> int:
    """Of a set of n, how many first columns any set that is similar enough shares one of."""
    return n + (-per_cent * n // 100) + 1


def first_columns(shingles: np.ndarray, counts: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set that have to be multiplied and their cells' counts, rare ones first."""
    weight = counts[(shingles & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)]
    columns = shingles.view(np.int64)
    order = np.lexsort((columns, weight))[: needed_columns(len(shingles), per_cent)]
    return columns[order], weight[order]


def linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    """Whether two sets, sorted, are as similar as asked."""
    if 100 * min(len(a), len(b)) < per_cent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= per_cent * (len(a) + len(b) - both)


class _Join:
    """The steps of one join. A node is a distinct shingle set, named by 64 bits of its digest: of a
    million sets, two share a name with a chance of 3e-8."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, per_cent: int):
        self.docs, self.size, self.per_cent = docs, size, per_cent
        self.scratch = Scratch(docs.sparkSession)
        ident = F.col(id_col).cast("long")
        self.rows = docs.select(F.coalesce(ident, F.lit(0)).alias("id"), ident.isNull().alias("missing"),
                                F.col(text_col).alias("text"))

    def sets(self, counts) -> DataFrame:
        """One row per document: id, n (size of its set), node, its last first column, and for the
        first row of a node in a batch its first columns, with the part that a hot one is dealt to."""
        size, per_cent = self.size, self.per_cent

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                seen, low, held = set(), 0, 0
                n, nodes, last, firsts, parts = [], [], [], [], []
                for row, (missing, text) in enumerate(zip(batch["missing"], batch["text"]), 1):
                    shingles = _sets(text, size)
                    n.append(len(shingles))
                    nodes.append(_node(shingles))
                    columns, weight = first_columns(shingles, counts.value, per_cent)
                    last.append((weight[-1], columns[-1]) if len(columns) else (0, 0))
                    known = missing or not len(columns) or nodes[-1] in seen  # copies are one row
                    seen.update(() if known else nodes[-1:])
                    firsts.append(None if known else columns)
                    # A column that may be hot is dealt by node too; -1 marks the others.
                    hot = not known and (weight > HOT_COLUMN).any()
                    parts.append(np.where(weight > HOT_COLUMN, nodes[-1] % (weight // HOT_COLUMN + 1), -1) if hot else None)
                    held += 0 if known else len(columns)
                    if held > HELD_COLUMNS or row == len(batch):
                        weights, lasts = zip(*last)
                        yield pd.DataFrame({
                            "id": batch["id"].iloc[low:row], "missing": batch["missing"].iloc[low:row],
                            "n": np.array(n, dtype=np.int64), "node": np.array(nodes, dtype=np.int64),
                            "last_count": np.array(weights, dtype=np.int64),
                            "last_column": np.array(lasts, dtype=np.int64), "columns": firsts, "parts": parts})
                        low, held = row, 0
                        n, nodes, last, firsts, parts = [], [], [], [], []

        return self.scratch.stored(self.rows.mapInPandas(
            made, "id long, missing boolean, n long, node long, last_count long, last_column long, "
            "columns array<long>, parts array<long>",
        ).withColumn("salt", salted("id")), "shingle_sets")

    def nodes(self, sets: DataFrame) -> DataFrame:
        """node, n, last_count, last_column, first_id: one row per distinct set. Copies are summed
        where they are read, and a hot group meets as one row per task."""
        return self.scratch.stored(sets.where("not missing and n > 0").groupBy("node", "n", "last_count", "last_column").agg(
            F.min("id").alias("first_id")), "shingle_nodes")

    def entries(self, sets: DataFrame) -> DataFrame:
        """h, node, n, place: entries of the matrix in columns that more than one node has; place
        is the number of the node's columns before."""
        every = sets.where("columns is not null").select(
            "node", F.col("n").cast("int").alias("n"), "parts", F.posexplode("columns").alias("place", "h"),
        ).select("h", F.coalesce(F.get("parts", "place"), F.lit(-1)).alias("part"), "node", "n", "place")
        # One exchange serves both the copies of other batches and the count.
        column = Window.partitionBy("h", "part")
        dealt = every.repartition("h", "part").dropDuplicates(["h", "part", "node"])
        return self.scratch.stored(dealt.withColumn("rows", F.count(F.lit(1)).over(column))
                      .where("rows > 1 or part >= 0").select("h", "node", "n", "place"), "shingle_entries")

    def plausible(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs a, b with an overlap count of first columns that the sizes allow to be enough.

        A shared shingle is a first column of both, or comes after the last first column of the
        node whose first columns end earlier; of those there are all but the first columns.
        """
        p = self.per_cent
        left = nodes.select(F.col("node").alias("a"), F.col("n").alias("an"),
                            F.struct("last_count", "last_column").alias("al"))
        right = nodes.select(F.col("node").alias("b"), F.col("n").alias("bn"),
                             F.struct("last_count", "last_column").alias("bl"))
        rest = F.ceil(F.when(F.col("al") <= F.col("bl"), F.col("an")).otherwise(F.col("bn")) * p / 100) - 1
        return pairs.join(left, "a").join(right, "b").where(
            (F.col("overlap") + rest) * (100 + p) >= (F.col("an") + F.col("bn")) * p).select("a", "b")

    def overlaps(self, pairs: DataFrame, columns: DataFrame) -> DataFrame:
        """a, b, overlap: the first columns that both have."""
        left = columns.select(F.col("node").alias("a"), F.col("columns").alias("ac"))
        right = columns.select(F.col("node").alias("b"), F.col("columns").alias("bc"))
        return pairs.join(left, "a").join(right, "b").select(
            "a", "b", F.size(F.array_intersect("ac", "bc")).cast("long").alias("overlap"))

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """a, b, linked for pairs a, b: whole sets compared, by the texts of the nodes' first ids."""
        size, per_cent = self.size, self.per_cent

        def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            set_of = lru_cache(maxsize=256)(lambda text: _sets(text, size))
            for batch in batches:
                yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": np.array([
                    linked(set_of(x), set_of(y), per_cent) for x, y in zip(batch["x"], batch["y"])], dtype=bool)})

        pairs = self.scratch.stored(pairs, "shingle_pairs")
        wanted = pairs.select(F.col("a").alias("node")).unionByName(
            pairs.select(F.col("b").alias("node"))).distinct()
        names = nodes.join(wanted, "node").select("node", F.col("first_id").alias("id"), "n")
        # An id with several texts gives several; the one of the node is known by its set's name.
        texts = self.scratch.stored(self.rows.where(~F.col("missing")).join(names, "id").select("node", "text"), "shingle_texts")
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
        rows = pairs.join(left, "a").join(right, "b")
        answers = self.scratch.stored(rows.mapInPandas(compared, "a long, b long, linked boolean")
                                      .groupBy("a", "b").agg(F.max("linked").alias("linked")), "shingle_links")
        self.scratch.drop(pairs, texts)
        return answers

    def sizes_allow(self, n: str, place: str, other_n: str, other_place: str) -> Column:
        """Whether two nodes that meet in a column can be similar enough with this one as the first
        that they share. The shingles before it are then lost to either, and the rest must do; a
        similar pair passes at least in the first column it shares."""
        p = self.per_cent
        rest = F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place))
        return rest * (100 + p) >= (F.col(n) + F.col(other_n)) * p

    def block_pairs(self, entries: DataFrame, step: int) -> DataFrame:
        """Each block's rows with one of its rows, the same one wherever it can be: first the one
        that has the column earliest. It has the fewest shingles of its own, so of an original
        and its changed copies it is the original, or nearest to it. Later any one."""
        block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / self.per_cent)))
        rows = entries.withColumn("block", block)
        order = F.col("place").cast("long") if step == 0 else F.xxhash64(F.col("node"), F.lit(step))
        first = rows.groupBy("h", "block").agg(F.min(F.struct(
            order.alias("o"), F.xxhash64("node").alias("tie"), F.col("node"), F.col("n"), F.col("place"),
            F.col("component"))).alias("p"))
        pairs = rows.join(first, ["h", "block"]).where(
            (F.col("component") != F.col("p.component")) & self.sizes_allow("n", "place", "p.n", "p.place"))
        return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()

    def full_pairs(self, entries: DataFrame) -> DataFrame:
        """The pairs of all columns, without those within a component.

        Each pair between components has a node outside the column's largest component, so only
        those are multiplied with the whole column.
        """
        by_component = entries.groupBy("h", "component").agg(F.count(F.lit(1)).alias("c"))
        largest = by_component.groupBy("h").agg(F.max(F.struct("c", "component"))["component"].alias("major"))
        marked = entries.join(largest, "h")
        minor = marked.where("component <> major").select(
            "h", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xp"),
            F.col("component").alias("xc"))
        every = marked.select(
            "h", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("place").alias("yp"),
            F.col("component").alias("yc"), (F.col("component") == F.col("major")).alias("main"))
        pairs = minor.join(every, "h").where(
            (F.col("xc") != F.col("yc")) & (F.col("main") | (F.col("x") < F.col("y")))
            & self.sizes_allow("xn", "xp", "yn", "yp"))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 per_cent: int = PER_CENT, rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id that links reach).

    Words are runs of [^\\x20\\x09-\\x0D] after lower-casing A-Z. Documents link when
    100 * |intersection| >= per_cent * |union| of their sets of `size`-word shingles; with fewer
    words the whole sequence is the one shingle. Null and empty texts have no shingle and no link;
    so has a null id, whose component is null. Rows with the same id are one document as to links:
    a link of one is a link of all. An empty table gives no rows. Other columns are not read.
    """
    join = _Join(docs, id_col, text_col, size, per_cent)
    counts = docs.sparkSession.sparkContext.broadcast(column_counts(docs, text_col, size))  # 2**CELL_BITS longs
    sets = join.sets(counts)
    nodes = join.nodes(sets)
    entries = join.entries(sets)
    columns = join.scratch.stored(entries.groupBy("node").agg(F.collect_list("h").alias("columns")), "shingle_columns")
    named = sets.where("not missing and n > 0")
    # Rows of one id are linked to begin with.
    same = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    links = named.join(same.select("id", "a"), "id").select("a", F.col("node").alias("b"))
    checked = None
    current = entries.withColumn("component", F.col("node"))
    for step in range(rounds + 1):
        pairs = join.block_pairs(current, step) if step < rounds else join.full_pairs(current)
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        now = join.verified(join.plausible(join.overlaps(pairs, columns), nodes), nodes)
        checked = now if checked is None else checked.unionByName(now)
        found = components(checked.where("linked").select("a", "b").unionByName(links), join.scratch)
        if step < rounds:
            labelled = entries.join(found, "node", "left").select(
                "h", "node", "n", "place", F.coalesce("component", "node").alias("component"))
            open_columns = labelled.groupBy("h").agg(
                F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
            old, current = current, join.scratch.stored(
                labelled.join(open_columns, "h", "left_semi"), "shingle_entries")
            join.scratch.drop(old)
    labelled = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named_by = labelled.join(least, "component").select("node", "component_id")
    answer = joined_evenly(sets, named_by, "node", "salt")
    result = stored(answer.select(
        F.when(~F.col("missing"), F.col("id")).alias(id_col), F.col("n").alias("n_shingles"),
        F.when(~F.col("missing"), F.coalesce("component_id", "id")).alias("component_id")), "components")
    join.scratch.drop()
    return result
