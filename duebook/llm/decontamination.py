"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

For each benchmark item of m words, a document's windows of m words are compared with it. A
window's weighted shingles (weight: how often each occurs in it) give a 64-bit SimHash. Items are
ordered by every block of their fingerprint; a look-up goes to all values near the window's in each
block, so it finds each item within the radius for certain, and the weighted Jaccard similarity of
the shingles decides.

A window that shares no shingle with an item has similarity 0, so only windows that hold at least
one of its shingles are fingerprinted; that leaves out no match.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import stored
from duebook.llm.words import hashes_of, mixed, shingles_of, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: Blocks of 8 bits. A fingerprint within RADIUS differs in at most RADIUS // BLOCKS bits of some
#: block. Two windows of similarity 0.8 differ in about 10 of 64 bits, in few-word items in more.
BLOCKS, RADIUS = 8, 28
#: Characters and items of the benchmark that are indexed and broadcast at a time. An index takes at most
#: ITEM_BYTES an item and CHAR_BYTES a character (a shingle, in the worst case, every two).
BLOCK_CHARS, BLOCK_ITEMS = 8_000_000, 100_000
ITEM_BYTES, CHAR_BYTES = 256, 16
#: Pairs of a window and an item that are looked at in one go.
LOOKED_AT = 1_000_000

_BITS = np.arange(64, dtype=np.uint64)
_NEAR = np.array([v for v in range(256) if v.bit_count() <= RADIUS // BLOCKS])


def signs_of(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 signs per shingle."""
    return (((mixed(shingles ^ np.uint64(0x5BD1E995))[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2) - 1


def _block_values(prints: np.ndarray) -> np.ndarray:
    """A row per block of its values in the fingerprints."""
    shifts = np.arange(BLOCKS, dtype=np.uint64)[:, None] * np.uint64(8)
    return ((prints[None, :] >> shifts) & np.uint64(255)).astype(np.int64)


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums."""
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


class ItemIndex:
    """The items of one block of a benchmark, in flat arrays."""

    def __init__(self, items: Iterable[tuple[int, str | None]]):
        self.idents, sizes, prints, bags, weights = [], [], [], [], []
        for ident, text in items:
            words = hashes_of(words_of(text))
            shingles = shingles_of(words, SHINGLE)
            if not len(shingles):
                continue
            self.idents.append(ident)
            sizes.append(len(words))
            bag, weight = np.unique(shingles, return_counts=True)
            prints.append(packed((signs_of(bag) * weight[:, None]).sum(axis=0)[None, :])[0])
            bags.append(bag)
            weights.append(weight.astype(np.int32))
        self.sizes = np.array(sizes, dtype=np.int64)
        self.prints = np.array(prints, dtype=np.uint64)
        self.edges = np.cumsum([0, *map(len, bags)])
        self.bags = np.concatenate([np.zeros(0, np.uint64), *bags])
        self.weights = np.concatenate([np.zeros(0, np.int32), *weights])
        self.units = sorted({min(SHINGLE, size) for size in sizes})
        # The items that have a shingle, by shingle.
        order = np.argsort(self.bags, kind="stable")
        self.shingles, first = np.unique(self.bags[order], return_index=True)
        self.owner_edges = np.append(first, len(order))
        self.owners = np.repeat(np.arange(len(sizes), dtype=np.int32), np.diff(self.edges))[order]
        # Items of a size: in the order of each block's value, and where each value begins.
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size = np.argsort(self.sizes, kind="stable").astype(np.int32)
        for members in np.split(by_size, np.flatnonzero(np.diff(self.sizes[by_size])) + 1) if sizes else []:
            values = _block_values(self.prints[members])
            places = np.argsort(values, axis=1, kind="stable")
            counts = np.array([np.bincount(v, minlength=256) for v in values])
            firsts = np.concatenate([np.zeros((BLOCKS, 1), np.int64), counts.cumsum(axis=1)], axis=1)
            self.blocks[int(self.sizes[members[0]])] = members[places], firsts.astype(np.int32)

    def nbytes(self) -> int:
        """Bytes of the arrays and the ids, about."""
        flat = (self.sizes, self.prints, self.edges, self.bags, self.weights, self.shingles, self.owner_edges, self.owners)
        return (sum(x.nbytes for x in flat) + sum(o.nbytes + f.nbytes for o, f in self.blocks.values())
                + 40 * len(self.idents))

    def near(self, size: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place of a fingerprint, item of this size within RADIUS of it), in order."""
        orders, firsts = self.blocks[size]
        step = max(1, LOOKED_AT // orders.shape[1])
        for low in range(0, len(prints), step):
            some = prints[low: low + step]
            found = []
            for block, values in enumerate(_block_values(some)):
                near = values[:, None] ^ _NEAR
                begin = firsts[block, near].ravel()
                counts = firsts[block, near + 1].ravel() - begin
                ends = np.cumsum(counts)
                item = orders[block, np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1])]
                place = np.repeat(np.arange(len(some)), counts.reshape(near.shape).sum(axis=1))
                close = np.bitwise_count(self.prints[item] ^ some[place]) <= RADIUS
                found.append(place[close].astype(np.int64) << 32 | item[close])
            for pair in np.unique(np.concatenate(found)).tolist():
                yield low + (pair >> 32), pair & 0xFFFFFFFF

    def similarity(self, bag: Counter, item: int) -> float:
        """Weighted Jaccard of a bag of shingles and an item's."""
        low, high = self.edges[item], self.edges[item + 1]
        weights = self.weights[low:high]
        both = sum(min(bag[s], w) for s, w in zip(self.bags[low:high].tolist(), weights.tolist()))
        return both / (sum(bag.values()) + int(weights.sum()) - both)

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window of each item that a text holds."""
        words = hashes_of(words_of(text))
        best: dict[int, tuple[float, int, int]] = {}
        for unit in self.units:
            self._match(words, unit, best)
        return [(self.idents[i], first, size, score) for i, (score, first, size) in sorted(best.items())]

    def _match(self, words: np.ndarray, unit: int, best: dict[int, tuple[float, int, int]]) -> None:
        """Better windows of the items whose shingles have `unit` words, put into `best`."""
        shingles = shingles_of(words, unit)
        if not len(shingles):
            return
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        hits = np.flatnonzero(self.shingles[at] == shingles)
        if not len(hits):
            return
        # Starts of windows by size, each with a shingle of an item of that size.
        starts: dict[int, set[int]] = defaultdict(set)
        for hit in hits.tolist():
            owners = self.owners[self.owner_edges[at[hit]]: self.owner_edges[at[hit] + 1]]
            for size in set(self.sizes[owners].tolist()):
                inside = size - unit
                last = max(0, len(words) - size)
                starts[size].update(range(max(0, min(hit - inside, last)), min(hit, last) + 1))
        for size, firsts in starts.items():
            width = len(shingles_of(words[:size], unit))  # shingles in a window
            order = sorted(firsts)
            # Running sums over each stretch of starts that lie close together.
            for stretch in np.split(np.array(order), np.flatnonzero(np.diff(order) > width) + 1):
                low, high = int(stretch[0]), int(stretch[-1]) + width
                sums = np.concatenate([np.zeros((1, 64), np.int32), signs_of(shingles[low:high]).cumsum(axis=0)])
                prints = packed(sums[stretch - low + width] - sums[stretch - low])
                bag, bag_of = Counter(), -1
                for place, item in self.near(size, prints):
                    first = int(stretch[place])
                    if first != bag_of:
                        bag, bag_of = Counter(shingles[first: first + width].tolist()), first
                    score = self.similarity(bag, item)
                    if score >= SIMILARITY and score > best.get(item, (0.0,))[0]:
                        best[item] = (score, first, min(size, len(words)))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text",
                 block_chars: int = BLOCK_CHARS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and item it holds: id, item_id, first_word, n_words, similarity.

    The window is the most similar one, the first of equals. A document shorter than the item is
    one window. Words are runs of [^\\x20\\x09-\\x0D] after lower-casing A-Z, shingles five words,
    the whole item where it has fewer. Null and empty texts, documents' or items', match nothing;
    an empty benchmark or an empty table gives no rows. Rows with the same or a null id are looked at
    one by one, items too. Other columns are not read.

    Documents are read where they lie, nothing is shuffled. The benchmark is the query set: it goes
    out in blocks of about block_chars characters and block_items items at most (or one item), one pass
    over the documents each. Of several blocks, each is read, broadcast and its rows stored before the
    next, so driver and workers hold one.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    chars, count = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-chars // block_chars), -(-count // block_items))
    ident = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(ident, F.lit(0)).alias("id"), ident.isNull().alias("missing"),
                       F.col(text_col).alias("text"))
    schema = ("id long, missing boolean, item_id long, first_word long, n_words long, similarity double")
    results = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(ItemIndex((r["id"], r["text"]) for r in part.collect()))

        def found(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(ident, missing, *match)
                       for ident, missing, text in zip(batch["id"], batch["missing"], batch["text"])
                       for match in index.value.matches(text)]
                frame = pd.DataFrame(out, columns=["id", "missing", "item_id", "first_word", "n_words", "similarity"])
                yield frame.astype({"id": "int64", "missing": bool, "item_id": "Int64", "first_word": "int64",
                                    "n_words": "int64", "similarity": "float64"})

        matches = rows.mapInPandas(found, schema)
        if blocks > 1:
            matches = stored(matches, "contaminated")
            index.unpersist()
        results = matches if results is None else results.unionByName(matches)
    return results.select(F.when(~F.col("missing"), F.col("id")).alias(id_col), "item_id", "first_word",
                          "n_words", "similarity")
