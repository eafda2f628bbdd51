"""Language-model scores by a probabilistic suffix tree over words.

Symbols are words and one end per text. A state of the tree is a context of up to `depth`
preceding words; a text's next word is predicted by the longest suffix of its past that is a
state. A context seen LEAST_COUNT times becomes a state if its next-word counts diverge enough
from what its longest proper suffix predicts to pay for what storing them costs; the suffixes of
a state are states too. Counts are absolute, so the tree grows with the corpus.

Smoothing is by absolute discounting: p(w|s) = max(n(s,w) - D, 0) / n(s) + left(s) * p(w|suffix of s),
down to the root, whose p(w) = (c + 0.5) / (N + 0.5 (V + 1)), c, N and V counted over all training
texts. Every state's distribution sums to 1 over the vocabulary and one unknown word.

The tree is a stored table of word runs (grams), named by 64-bit hashes. A gram (c, w) is a
next-word count of context c, its suffix is (suffix of c, w), and it is itself a context one level
deeper. What predicts a word is its longest gram whose context is a state, and the lefts of the
longer states before it. Suffixes of such grams and states are such too, so a log score is a sum
over all of a text's grams: log10 of p(w|c) / (left(c) p(w|suffix of c)) of each stored gram,
log10 left(c) of each state, and the root's log10 p of each word. So texts are scored by a join of
their grams to the table; the frequent grams, bounded by a share, are looked up where a text is
read.

Grams on their way to be counted or looked up are packed: a row holds those of many texts whose
names lie in one range, as arrays. There are as many ranges as the tokens ask for, so what a task
merges at a time is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import Scratch, new_folder, written
from duebook.llm.words import mixed

DEPTH = 3
#: Least share of all training tokens of a word or gram that tasks know without a join.
WORD_SHARE = 5e-7
#: Least share of a context, and of a next-word count within a context; by default LEAST_COUNT
#: and the divergence test alone decide.
CONTEXT_SHARE, ENTRY_SHARE = 0.0, 0.0
#: Least count of any of them.
LEAST_COUNT = 2
DISCOUNT = 0.75
#: Nats of divergence that a stored next-word count has to bring, in halves of the log of N.
COST = 1.0
#: Tokens that a task counts, and grams that it asks for, before it passes them on.
CHUNK_TOKENS, ASKED_GRAMS = 2_000_000, 500_000
#: Bytes of text that a task cuts into words, and scores, at a time; a word is never cut.
READ_BYTES = 1 << 20
#: Training tokens for each range of names, when grams are counted and when they are looked up. Names are
#: hashes, so a range has its share of them; a gram is in it once for each chunk.
COUNTED_TOKENS, SOUGHT_TOKENS = 2_000_000, 4_000_000
#: Rows of the table that a task deals at a time.
DEALT_ROWS = 500_000
#: Ranges that leave a task in one batch.
BATCH_RANGES = 16
#: Binary log of the bits in a filter. Grams that it lets pass are joined to the table, which
#: decides, so a filter that fills up costs time and changes nothing.
FILTER_BITS = 27

#: Binary log of the parts in which a filter is put together.
FILTER_PARTS = 8
#: What a text's frequent words and grams add up to, as it travels.
SUMMARY = np.dtype([("row", "<i8"), ("id", "<i8"), ("missing", "?"), ("size", "<i8"), ("n", "<i8"), ("base", "<f8"), ("score", "<f8")])

#: The end of a text; no word is likely to hash to it.
END = np.uint64(0xE17D0F7E87C0FFEE)


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(values: np.ndarray, bits: int) -> np.ndarray:
    return (values << np.uint64(bits)) | (values >> np.uint64(64 - bits))


def _xxhash64(values: np.ndarray, seeds: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's xxhash64 of a long."""
    out = (seeds + _P5 + np.uint64(8)) ^ (_turned(values * _P2, 31) * _P1)
    out = _turned(out, 27) * _P1 + _P4
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    return out ^ (out >> np.uint64(32))


def grams_of(shorter: np.ndarray) -> np.ndarray:
    """The names of runs one word longer than those named, which end at consecutive tokens: Spark's
    xxhash64 of the context's and the suffix's names. A single word's name is its hash."""
    return _xxhash64(shorter[1:], _xxhash64(shorter[:-1], np.uint64(42)))


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: A number for each byte, the same for A-Z and a-z.
_BYTES = _xxhash64(np.arange(256, dtype=np.uint64), np.uint64(42))
_BYTES[ord("A"): ord("Z") + 1] = _BYTES[ord("a"): ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> list[np.ndarray]:
    """The first powers of _BASE and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < size:
        _POWERS[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(max(size, READ_BYTES) - 1, x)))
                      for x in (_BASE, _INVERSE)]
    return _POWERS


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in pieces of text, which lie between bounds, and each piece's number of
    words. A word is a polynomial of its bytes' numbers, so a running sum over all bytes gives it."""
    up, down = _powers(len(data))
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]  # words end with their piece
    begins[edge], ends[edge - 1] = inside[edge], inside[edge - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    values = _BYTES[data]
    values *= up[: len(data)]
    sums = np.cumsum(values)
    words = (sums[ends] - sums[begins] + values[begins]) * down[begins]
    return mixed(words), np.diff(np.searchsorted(begins, bounds))


def _pieces(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """bounds, and more of them before white space so that pieces have READ_BYTES, if words do not forbid."""
    more = []
    for text in np.flatnonzero(np.diff(bounds) > READ_BYTES):
        low, high = int(bounds[text]), int(bounds[text + 1])
        while high - low > READ_BYTES:
            spaces = np.flatnonzero(_SPACE[data[low + 1: low + READ_BYTES]])
            after = low + READ_BYTES
            low = low + 1 + int(spaces[-1]) if len(spaces) else high
            while low == high and after < high:  # a long word
                spaces = np.flatnonzero(_SPACE[data[after: after + READ_BYTES]])
                if len(spaces):
                    low = after + int(spaces[0])
                after += READ_BYTES
            if low < high:
                more.append(low)
    return np.sort(np.concatenate([bounds, np.array(more, dtype=np.int64)])) if more else bounds


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and where each begins and the last ends."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, "<i8")[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


def tokens_of(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of texts one after the other, each closed by END, and their numbers."""
    if isinstance(texts, list):
        texts = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.large_binary())
    data, bounds = _bytes_of(texts)
    cut = _pieces(data, bounds)
    found, numbers, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while low < len(cut) - 1:
        high = max(low + 1, int(np.searchsorted(cut, cut[low] + READ_BYTES, "right")) - 1)
        words, counts = _words(data[cut[low]: cut[high]], cut[low: high + 1] - cut[low])
        found.append(words)
        numbers.append(counts)
        low = high
    words = np.concatenate(found)
    before = np.append(0, np.cumsum(np.concatenate(numbers)))  # words before each piece
    counts = np.diff(before[np.searchsorted(cut, bounds)])
    out = np.full(len(words) + len(counts), END)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return out, counts + 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have READ_BYTES, or one."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(batch):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + READ_BYTES, "right")))
            yield batch.slice(low, high - low)
            low = high


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of many texts at a time, and the texts' numbers of tokens."""
    held, sizes, count = [], [], 0
    for batch in _slices(batches):
        tokens, size = tokens_of(batch["text"])
        held.append(tokens)
        sizes.append(size)
        count += len(tokens)
        if count >= CHUNK_TOKENS:
            yield np.concatenate(held), np.concatenate(sizes)
            held, sizes, count = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(sizes)


def _order(names: np.ndarray) -> np.ndarray:
    """np.argsort(names). Sorting values is much faster, so the lowest bits, which seldom decide, give
    way to the names' places."""
    low = np.uint64((1 << len(names).bit_length()) - 1)
    keys = (names & ~low) | np.arange(len(names), dtype=np.uint64)
    keys.sort()
    order = (keys & low).astype(np.int64)
    ordered = names[order]
    return np.argsort(names) if (ordered[1:] < ordered[:-1]).any() else order


class _Names:
    """Sorted names by their leading bits: as they are hashes, few share these."""

    def __init__(self, names: np.ndarray):
        bits = max(1, len(names).bit_length())
        self.names = np.append(names, ~np.uint64(0))
        self.shift = np.uint64(64 - bits)
        leading = (names >> self.shift).astype(np.int64)
        self.first = np.append(0, np.cumsum(np.bincount(leading, minlength=1 << bits))).astype(np.int32 if bits < 31 else np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places, -1 where missing."""
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        found = self.names[at]
        open_ = np.flatnonzero(found < wanted)
        while len(open_):
            at[open_] += 1
            found[open_] = self.names[at[open_]]
            open_ = open_[found[open_] < wanted[open_]]
        return np.where((found == wanted) & (at < len(self.names) - 1), at, -1)


def _edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def _ranges_of(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _by_range(names: np.ndarray, ranges: int) -> np.ndarray:
    """The order of the names' ranges, which leaves a range's names as they were."""
    whose = _ranges_of(names, ranges)
    return np.argsort(whose.astype(np.uint16) if ranges <= 1 << 16 else whose, kind="stable")


def _dealt(names: np.ndarray, ranges: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns of rows in order of their names, or of these names' ranges, packed by ranges."""
    whose = _ranges_of(names, ranges)
    first = _edges(whose)
    ends = np.append(first[1:], len(names))
    for low in range(0, len(first), BATCH_RANGES):
        part = slice(low, low + BATCH_RANGES)
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(first[part], ends[part])], pa.binary())
                  for x in columns.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(whose[first[part]].astype(np.int32)), *packed], ["part", *columns])


def _held(arrays: Iterator[np.ndarray], rows: int) -> Iterator[np.ndarray]:
    """The arrays, as many at a time as have so many rows."""
    held, count = [], 0
    for array in arrays:
        held.append(array)
        count += len(array)
        if count >= rows:
            yield np.concatenate(held)
            held, count = [], 0
    if count:
        yield np.concatenate(held)


def _ranges(tokens: int, each: int) -> int:
    return max(1, -(-tokens // each))


def _unpacked(packed: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed[column].to_pylist()), dtype)


def count_words(texts: DataFrame) -> DataFrame:
    """word (hash), count: over all texts, ends included."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, _ in _chunks(batches):
            words, counts = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": words.view(np.int64), "count": counts})

    return texts.mapInArrow(counted, "word long, count long").groupBy("word").agg(
        F.sum("count").alias("count"))


def _passing(filter_: np.ndarray, names: np.ndarray) -> np.ndarray:
    bit = names >> np.uint64(64 - FILTER_BITS)
    return (filter_[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _filter(names: DataFrame) -> np.ndarray:
    """The bits of the names in `g`: at most 2^FILTER_BITS, whatever the size of the table. Each task
    sends no more than the words of a part that it has set."""
    parts, words = 1 << FILTER_PARTS, 1 << (FILTER_BITS - 6)

    def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names in _held((b["g"].to_numpy() for b in batches), DEALT_ROWS):
            bit = names.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            bit.sort()
            at = bit >> np.uint64(6)
            edges = _edges(at)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), edges)
            at = at[edges]
            yield from _dealt(at << np.uint64(64 - FILTER_BITS + 6), parts, at=at.astype("<u4"), bits=bits)

    def one_part(packed: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part = np.zeros(words // parts, np.uint64), 0
        for batch in packed:
            part = batch["part"][0].as_py()
            for at, bits in zip(batch["at"], batch["bits"]):
                out[np.frombuffer(at.as_py(), "<u4") - part * len(out)] |= np.frombuffer(bits.as_py(), "<u8")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "bits"])

    rows = names.select("g").mapInArrow(in_parts, "part int, at binary, bits binary").groupBy("part").applyInArrow(
        one_part, "part int, bits binary").toArrow()
    out = np.zeros((parts, words // parts), dtype=np.uint64)
    for part, bits in zip(rows["part"].to_pylist(), rows["bits"].to_pylist()):
        out[part] = np.frombuffer(bits, "<u8")
    return out.ravel()


def _count_grams(texts: DataFrame, level: int, least: int, shorter: Broadcast, ranges: int) -> DataFrame:
    """c, s, n: contexts and suffixes of the runs of level + 1 words seen `least` times. Neither
    of the two is seen less often, so `shorter`, the filter of the level before, spares most of
    the others the shuffle."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, sizes in _chunks(batches):
            within = _places(sizes)[level:] >= level
            part = tokens
            for _ in range(level - 1):
                part = grams_of(part)
            passed = _passing(shorter.value, part)
            use = np.flatnonzero(within & passed[:-1] & passed[1:])
            names = grams_of(part)[use]
            order = _order(names)  # equal names are the same gram, whichever comes first
            names = names[order]
            edges = _edges(names)
            first = use[order[edges]]
            yield from _dealt(names[edges], ranges, c=part[first], s=part[first + 1],
                              n=np.diff(np.append(edges, len(names))).astype("<u4"))

    def merged(packed: pa.Table) -> pa.Table:
        c, s = _unpacked(packed, "c", "<u8"), _unpacked(packed, "s", "<u8")
        names = _xxhash64(s, _xxhash64(c, np.uint64(42)))
        order = _order(names)
        edges = _edges(names[order])
        n = np.add.reduceat(_unpacked(packed, "n", "<u4").astype(np.int64)[order], edges)
        first = order[edges[n >= least]]
        return pa.table({"c": c[first].view(np.int64), "s": s[first].view(np.int64), "n": n[n >= least]})

    return texts.mapInArrow(counted, "part int, c binary, s binary, n binary").groupBy("part").applyInArrow(
        merged, "c long, s long, n long")


@dataclass
class SuffixTree:
    """The table of words and grams, and the part of it that tasks know without a join."""

    table: DataFrame  # g, count (of a word, else 0), delta, seen
    total: int
    vocabulary: int
    names: np.ndarray  # sorted
    counts: np.ndarray
    deltas: np.ndarray
    filter: np.ndarray  # of grams that have a delta

    def root_scores(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))


def learn(texts: DataFrame, vocabulary: DataFrame, depth: int = DEPTH, word_share: float = WORD_SHARE,
          context_share: float = CONTEXT_SHARE, entry_share: float = ENTRY_SHARE) -> SuffixTree:
    """The tree of texts whose words are counted in `vocabulary`."""
    sums = vocabulary.agg(F.sum("count"), F.count(F.lit(1))).first()
    total, size = int(sums[0] or 0), int(sums[1])
    least = lambda share: max(LEAST_COUNT, int(np.ceil(share * total)))
    ranges = _ranges(total, COUNTED_TOKENS)
    # The level before: of each gram its count and suffix, and its probability.
    before = vocabulary.select(F.col("word").alias("g"), F.col("count").alias("n"), F.lit(None).cast("long").alias("s"))
    likely = vocabulary.select(F.col("word").alias("s"), (
        (F.col("count") + 0.5) / F.lit(total + 0.5 * (size + 1))).alias("beneath"))
    levels, contexts, scratch = [], [], Scratch(texts.sparkSession)

    # Frequent contexts and suffixes are in many grams: AQE splits these joins, whose results are
    # written or combined by another key.
    for level in range(1, depth + 1):
        filter_ = texts.sparkSession.sparkContext.broadcast(_filter(before.where(F.col("n") >= least(entry_share))))
        counted = _count_grams(texts, level, least(entry_share), filter_, ranges)
        grams = scratch.stored(counted.join(likely, "s").select("c", "s", "n", "beneath"), f"level-{level}")
        filter_.destroy()  # it lies on the disk of each executor
        sums = grams.groupBy("c").agg(
            F.count(F.lit(1)).alias("entries"), F.sum("n").alias("taken"), F.sum("beneath").alias("mass"),
            F.sum(F.col("n") * (F.log(F.col("n").cast("double")) - F.log("beneath"))).alias("gain"))
        # Divergence of the counts from the suffix's prediction, the words without entries as one.
        rest = F.col("size") - F.col("taken")
        rest_beneath = F.least(F.greatest(1 - F.col("mass"), F.lit(1e-12)), F.lit(1.0))
        gain = F.col("gain") - F.col("taken") * F.log(F.col("size").cast("double")) + F.when(
            rest > 0, rest * F.log(rest / F.col("size") / rest_beneath)).otherwise(0.0)
        sized = before.where(F.col("n") >= least(context_share)).select(
            F.col("g").alias("c"), F.col("n").alias("size"), F.col("s").alias("suffix"))
        context = scratch.stored(sums.join(sized, "c").select(
            "c", "size", "suffix",
            F.greatest(1 - (F.col("taken") - DISCOUNT * F.col("entries")) / F.col("size"),
                       F.lit(1e-12)).alias("left"),
            (gain >= COST * 0.5 * float(np.log(max(2, total))) * (F.col("entries") + 1)).alias("keep")),
            f"contexts-{level}")
        before = grams.withColumn("g", F.xxhash64("c", "s"))
        p = (F.col("n") - DISCOUNT) / F.col("size") + F.col("left") * F.col("beneath")
        likely = before.join(context.select("c", "size", "left"), "c").select(F.col("g").alias("s"), p.alias("beneath"))
        levels.append(grams)
        contexts.append(context)

    # States, from the deepest up: what passes the test, and the suffixes of states. A level's grams and
    # the states that are one word longer than their contexts have the same names.
    longer, path = None, new_folder(texts.sparkSession, "suffix-tree")
    columns = "g", "count", "delta", "seen", "stated"
    none = F.lit(0).cast("long").alias("count")

    def with_states(rows: DataFrame) -> DataFrame:
        """Rows of the table, and those of the states `longer`."""
        if longer is None:
            return rows
        both = rows.unionByName(longer.select(
            F.col("c").alias("g"), none, F.log10("left").alias("delta"), F.col("size").alias("seen"),
            F.lit(True).alias("stated")))
        return both.groupBy("g").agg(F.sum("count").alias("count"), F.sum("delta").alias("delta"),
                                     F.max("seen").alias("seen"), F.max("stated").alias("stated"))

    for level, grams, context in reversed(list(zip(range(1, depth + 1), levels, contexts))):
        kept = context
        if longer is not None:
            under = longer.select(F.col("suffix").alias("c")).distinct().withColumn("under", F.lit(True))
            kept = context.join(under, "c", "left").withColumn("keep", F.col("keep") | F.col("under").isNotNull())
        states = scratch.stored(kept.where("keep").drop("keep", "under"), "states")
        scratch.drop(context)
        held = grams.join(states.select("c", "size", "left"), "c").select(
            F.xxhash64("c", "s").alias("g"), none, F.log10(p / F.col("beneath") / F.col("left")).alias("delta"),
            F.col("n").alias("seen"), F.lit(True).alias("stated"))
        written(with_states(held).select(*columns), f"{path}/words={level + 1}")
        scratch.drop(grams, *([longer] if longer is not None else []))
        longer = states
    words = vocabulary.select(F.col("word").alias("g"), "count", F.lit(0.0).alias("delta"),
                              F.col("count").alias("seen"), F.lit(False).alias("stated"))
    written(with_states(words).select(*columns), f"{path}/words=1")
    table = texts.sparkSession.read.schema(
        "g long, count long, delta double, seen long, stated boolean, words int").parquet(path)
    scratch.drop()
    # At most 1 / word_share of each length.
    often = table.where(F.col("seen") >= least(word_share)).select("g", "count", "delta").toArrow()
    names = often["g"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    return SuffixTree(table, total, size, names[order], often["count"].to_numpy()[order],
                      often["delta"].to_numpy()[order],
                      _filter(table.where("stated").where(F.col("seen") < least(word_share))))


def _counted_by_text(text: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different names and how often it has them."""
    order = np.lexsort((names, text))
    text, names = text[order], names[order]
    first = np.append(True, (np.diff(text) != 0) | (names[1:] != names[:-1]))[: len(text)]
    counts = np.diff(np.append(np.flatnonzero(first), len(text)))
    return text[first], names[first].view(np.int64), counts


def score_texts(docs: DataFrame, learn_from: Column, depth: int = DEPTH, word_share: float = WORD_SHARE,
                context_share: float = CONTEXT_SHARE, entry_share: float = ENTRY_SHARE,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where `learn_from` holds. Null and empty texts are an end alone. Rows
    with the same or a null id are scored one by one. Without training texts, all words are
    unknown. Other columns are not read. base_score is the root's alone, score the tree's, both
    log10 of the whole text's probability.

    Frequent words and grams are scored where the text is read. Of the others, each text sends its
    counts to the table by a join; none among them can have more than a WORD_SHARE of the tokens.
    """
    texts = docs.where(F.coalesce(learn_from, F.lit(True))).select(F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.stored(count_words(texts), "vocabulary")
    tree = learn(texts, vocabulary, depth, word_share, context_share, entry_share)
    scratch.drop()  # its counts are in the tree's table
    shared = docs.sparkSession.sparkContext.broadcast(
        (tree.names, tree.root_scores(tree.counts), tree.deltas, tree.filter))

    ranges = _ranges(tree.total, SOUGHT_TOKENS)
    own = SUMMARY

    def score_part(batch: pa.RecordBatch, often: _Names) -> tuple[np.ndarray, ...]:
        """The texts' summaries, and of their other words and grams the text's row, whether it is a
        word, the name and how often the text has it."""
        _, roots, deltas, filter_ = shared.value
        tokens, sizes = tokens_of(batch["text"])
        starts = np.cumsum(sizes) - sizes
        at = often.find(tokens)
        known = at >= 0
        base = np.zeros(len(tokens))
        base[known] = roots[at[known]]
        score = base.copy()
        score[known] += deltas[at[known]]
        text, place = np.repeat(np.arange(len(sizes)), sizes), _places(sizes)
        sent = [(text[~known], tokens[~known])]
        named = tokens
        last = np.arange(len(tokens))  # where grams end that may be in the table: their suffixes are, too
        for level in range(1, depth + 1):
            named = grams_of(named)
            last = last[place[last] >= level]
            grams = named[last - level]
            found = often.find(grams)
            hit = found >= 0
            score[last[hit]] += deltas[found[hit]]
            use = ~hit & _passing(filter_, grams)
            sent.append((text[last[use]], grams[use]))
            last = last[hit | use]
        summaries = np.zeros(len(sizes), own)
        for name in ("row", "id", "missing"):
            summaries[name] = batch[name].to_numpy(zero_copy_only=False)
        summaries["size"] = sizes
        summaries["n"] = np.add.reduceat(known.astype(np.int64), starts)
        summaries["base"], summaries["score"] = np.add.reduceat(base, starts), np.add.reduceat(score, starts)
        if sum(len(x) for x, _ in sent) > ASKED_GRAMS:  # long texts, which may repeat what they ask for
            sent = [_counted_by_text(*x) for x in sent]
        else:
            sent = [(*x, np.ones(len(x[0]), np.int64)) for x in sent]
        whose, grams, counts = (np.concatenate(x) for x in zip(*sent))
        return (summaries, summaries["row"][whose], np.arange(len(whose)) < len(sent[0][0]),
                grams.view(np.uint64), counts)

    def asked(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        summaries, rows, words, names, counts = (np.concatenate(x) for x in zip(*held))
        first = int(summaries["row"][0])
        order = _by_range(names, ranges)
        # A task's row numbers follow each other.
        for batch in _dealt(names[order], ranges, row=(rows - first)[order].astype("<u4"), name=names[order],
                            n=counts[order].astype("<u4"), word=words[order]):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([first] * len(batch)), pa.nulls(len(batch), pa.binary())],
                [*batch.schema.names, "first", "own"])
        empty = pa.array([b""], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([first % ranges], pa.int32()), empty, empty, empty, empty, pa.array([first]),
             pa.array([summaries.tobytes()], pa.binary())],
            ["part", "row", "name", "n", "word", "first", "own"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, done, waiting, texts = _Names(shared.value[0]), [], 0, 0
        for batch in _slices(batches):
            done.append(score_part(batch, often))
            waiting += len(done[-1][1])
            texts += len(batch)
            if waiting > ASKED_GRAMS or texts > ASKED_GRAMS:
                yield from asked(done)
                done, waiting, texts = [], 0, 0
        if done:
            yield from asked(done)

    def packed_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.dtype([("name", "<u8"), ("count", "<i8"), ("delta", "<f8")])

        def rows_of(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(len(batch), row)
            out["name"] = batch["g"].to_numpy().view(np.uint64)
            out["count"], out["delta"] = batch["count"].to_numpy(), batch["delta"].to_numpy()
            return out

        for rows in _held(map(rows_of, batches), DEALT_ROWS):
            rows = rows[_by_range(rows["name"], ranges)]
            yield from _dealt(rows["name"], ranges, name=rows["name"], count=rows["count"], delta=rows["delta"])

    divisor = float(tree.total + 0.5 * (tree.vocabulary + 1))
    answer = np.dtype([("row", "<u4"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])

    def looked_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        """For each batch of texts, packed, what its texts' names of one range add up to."""
        names = _unpacked(known, "name", "<u8")
        order = _order(names)
        table = _Names(names[order])
        in_table = np.append(_unpacked(known, "count", "<i8")[order], 0)
        deltas = np.append(_unpacked(known, "delta", "<f8")[order], 0.0)  # the last is that of missing names
        sums = []
        for piece in asked.to_batches(max_chunksize=1):
            one = pa.Table.from_batches([piece])
            row, n = _unpacked(one, "row", "<u4"), _unpacked(one, "n", "<u4").astype(np.int64)
            if not len(row):
                sums.append(b"")
                continue
            by_row = _order(row.astype(np.uint64))
            row, n = row[by_row], n[by_row]
            word, at = _unpacked(one, "word", "?")[by_row], table.find(_unpacked(one, "name", "<u8")[by_row])
            count, delta = in_table[at], deltas[at]
            base = np.zeros(len(at))
            base[word] = n[word] * np.log10((count[word] + 0.5) / divisor)
            edges = _edges(row)
            out = np.zeros(len(edges), answer)
            out["row"] = row[edges]
            for name, x in (("known", n * (word & (count > 0))), ("base", base), ("score", base + n * delta)):
                out[name] = np.add.reduceat(x, edges)
            sums.append(out.tobytes())
        return pa.table([asked["first"], asked["own"], pa.array(sums, pa.binary())], names=["first", "own", "sums"])

    def summed(packed: pa.Table) -> pa.Table:
        """The texts that were read together: their summaries, and what all ranges have added."""
        s = np.frombuffer(b"".join(x for x in packed["own"].to_pylist() if x is not None), own)
        added = _unpacked(packed, "sums", answer)
        total = lambda name: np.bincount(added["row"], added[name], len(s))
        return pa.table({
            "id": pa.array(s["id"], mask=s["missing"]), "n_tokens": s["size"],
            "n_known": s["n"] + total("known").astype(np.int64),
            "base_score": s["base"] + total("base"), "score": s["score"] + total("score")})

    # The texts are read once, so a row's number is the same wherever it is used.
    ident = F.col(id_col).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(ident, F.lit(0)).alias("id"),
                       ident.isNull().alias("missing"), F.col(text_col).alias("text"))
    sought = rows.mapInArrow(
        read, "part int, row binary, name binary, n binary, word binary, first long, own binary")
    known = tree.table.select("g", "count", "delta").mapInArrow(
        packed_table, "part int, name binary, count binary, delta binary")
    found = sought.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(
        looked_up, "first long, own binary, sums binary")
    scores = found.groupBy("first").applyInArrow(
        summed, "id long, n_tokens long, n_known long, base_score double, score double")
    return scores.select(F.col("id").alias(id_col), "n_tokens", "n_known",
                         F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
