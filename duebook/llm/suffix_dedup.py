"""Removal of repeated byte strings by longest-previous-factor arrays.

A string of `width` bytes is removed where it also starts elsewhere. All strings of the corpus are
dealt out so that equal ones meet, and each share gets a suffix array of its own:

1. Every window of `width` bytes is named by the smallest hash of the GRAM-byte strings in it. Equal
   windows have equal names; neighbouring windows mostly share theirs and make one segment.
2. Segments whose name occurs once have no repeats and go no further; they are nearly all of them.
3. The bytes of the others are dealt by name into blocks of bounded size, equal segments as one.
   A block's suffix array, by prefix doubling up to `width` bytes, puts windows in suffix order.
   The longest previous factor of a window is the longer of its common prefixes with the nearest
   windows before and after it in that order that start earlier in the block (the previous and
   the next smaller position). Where it reaches `width` the window has an earlier match, and its
   source a later one.
4. A name with very many different segments, or bytes, would outgrow a block; its windows are dealt
   by their own digests and counted instead, which gives the same matches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import joined_evenly, salted, stored
from duebook.llm.words import mixed

WIDTH = 200
GRAM = 64
#: Bytes of a text that are hashed at a time, and bytes up to which short texts are hashed together.
CHUNK, TOGETHER = 1 << 20, 1 << 15
#: Bytes of segments in a block on average (their places fit three to a word), and different
#: segments that one name may bring to it. It may bring as many bytes as a block has.
BLOCK_BYTES, BLOCK_SEGMENTS = 1_000_000, 4_000
#: Bytes of segments that a task cuts out before it passes them on.
CUT_BYTES = 4_000_000
#: Bytes that suffixes are ranked by at first.
STEP = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, and a random number per byte."""

    def __init__(self) -> None:
        self.up = np.full(CHUNK + WIDTH * 8, _ODD)
        self.up[0] = 1
        self.up = np.cumprod(self.up)
        self.down = np.full(len(self.up), np.uint64(pow(int(_ODD), -1, 1 << 64)))
        self.down[0] = 1
        self.down = np.cumprod(self.down)
        self.bytes = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


_POWERS: list[_Powers] = []


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    if not _POWERS or len(_POWERS[0].up) <= len(data):
        _POWERS[:] = [_Powers()]
    p = _POWERS[0]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(p.bytes[data] * p.up[: len(data)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * p.down[: len(data) - size + 1])


def segments(text: bytes, width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """name, first and last window start of each segment, and whether its gram is in it twice.

    Windows are in exactly one segment. With its naming gram only once, a segment cannot hold the
    same window twice. Periodic stretches are one segment, however long.
    """
    data = np.frombuffer(text, np.uint8)
    mask = np.uint64((1 << 21) - 1)  # more places than a chunk has
    span = width - gram + 1
    for low in range(0, len(data) - width + 1, CHUNK):
        grams = _gram_hashes(data[low: low + CHUNK + width - 1], gram)
        # The smallest hash and its first place, over spans that double up to the window's.
        least, reach = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64), 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        rest = span - reach
        place = (np.minimum(least[: len(least) - rest], least[rest:]) & mask).astype(np.int64)
        name = grams[place]
        other = np.append(True, name[1:] != name[:-1])
        first = np.flatnonzero(other)
        last = np.append(first[1:], len(name)) - 1
        moved = np.append(False, place[1:] != place[:-1]) & ~other
        yield name[first].view(np.int64), first + low, last + low, np.logical_or.reduceat(moved, first)


def together(raws: list[bytes], width: int = WIDTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of several texts: which text, then as `segments`. Texts are hashed as one; windows
    across a border are left out, and no segment crosses one."""
    sizes = np.array([len(raw) for raw in raws])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for name, first, last, own in segments(b"".join(raws), width, gram):
        # A segment that crosses borders is cut into its parts: one per text that it has windows of.
        low, high = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")
        count = high - low + 1
        at = np.repeat(np.arange(len(first)), count)
        text = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        first = np.maximum(first[at], starts[text]) - starts[text]
        last = np.minimum(last[at], ends[text] - width) - starts[text]
        use = first <= last
        yield text[use], name[at][use], first[use], last[use], own[at][use]


def _dense(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of keys below 2**bits, and their order, equal ones by place."""
    n = len(key)
    place = max(1, (n - 1).bit_length())
    if bits + place <= 64:
        word = (key << np.uint64(place)) | np.arange(n, dtype=np.uint64)
        word.sort()
        order = (word & np.uint64((1 << place) - 1)).astype(np.int64)
        word >>= np.uint64(place)
    else:
        order = np.argsort(key, kind="stable")
        word = key[order]
    rank = np.zeros(n, dtype=np.uint64)
    rank[order[1:]] = np.cumsum(word[1:] != word[:-1], dtype=np.uint64)
    return rank, order


def prefix_ranks(data: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """Dense ranks of all places by their first STEP bytes, and by twice as many as long as that
    is within the width."""
    step = min(STEP, width)
    padded = np.concatenate([data, np.zeros(step, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data), dtype=np.uint64)
    for i in range(step):
        word = (word << np.uint64(8)) | padded[i: i + len(data)]
    bits = max(1, len(data).bit_length())
    levels = [(step, _dense(word, 8 * step)[0])]
    while step * 2 <= width:
        rank = levels[-1][1]
        after = np.concatenate([rank[step:], np.zeros(step, np.uint64)])[: len(rank)]
        step *= 2
        levels.append((step, _dense((rank << np.uint64(bits)) | after, 2 * bits)[0]))
    return levels


def _sorted(levels: list[tuple[int, np.ndarray]], width: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step, rank = levels[-1]
    bits = max(1, len(rank).bit_length())
    return _dense((rank[starts] << np.uint64(bits)) | rank[starts + (width - step)], 2 * bits)


def suffix_ranks(data: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """Dense ranks of the suffixes at `starts` by their first `width` bytes, all of them within data."""
    return _sorted(prefix_ranks(data, width), width, starts)[0].astype(np.int64)


def _common(data: np.ndarray, levels: list[tuple[int, np.ndarray]], width: int, a: np.ndarray,
            b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, up to the width."""
    out = np.zeros(len(a), dtype=np.int64)
    if not len(a):
        return out
    for step, rank in reversed(levels):
        fits = out + step <= width
        reach = np.where(fits, out, 0)
        out += step * (fits & (rank[a + reach] == rank[b + reach]))
    for _ in range(min(STEP, width) - 1):
        fits = out < width
        reach = np.where(fits, out, 0)
        more = fits & (data[a + reach] == data[b + reach])
        if not more.any():
            break
        # A suffix that differs here differs at the same byte the next time.
        out += more
    return out


def _smaller_before(places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where before each element the nearest smaller one is (-1: nowhere), and the least `common`
    on the way; common[i] is between i - 1 and i. Candidates that are too large hand on their own,
    so the ways double."""
    at, least = np.arange(len(places)) - 1, common.copy()
    open_ = np.flatnonzero(places[at] > places)
    open_ = open_[at[open_] >= 0]
    while len(open_):
        via = at[open_]
        least[open_] = np.minimum(least[open_], least[via])
        at[open_] = at[via]
        open_ = open_[at[open_] >= 0]
        open_ = open_[places[at[open_]] > places[open_]]
    least[at < 0] = 0
    return at, least


def longest_previous_factors(data: np.ndarray, width: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffix at each of the rising `starts` the longest prefix, up to the width, that one
    before it has too, and which one that is (-1: none has a byte in common)."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = prefix_ranks(data, width)
    order = _sorted(levels, width, starts)[1]
    common = np.zeros(n + 1, dtype=np.int64)
    common[1:n] = _common(data, levels, width, starts[order[:-1]], starts[order[1:]])
    before, length = _smaller_before(order, common[:n])
    after, length_after = _smaller_before(order[::-1], common[:0:-1])
    after, length_after = n - 1 - after[::-1], length_after[::-1]
    which = np.where(length >= length_after, before, after)
    length = np.maximum(length, length_after)
    lengths, sources = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    lengths[order] = length
    has = length > 0
    sources[order[has]] = order[which[has]]
    return lengths, sources


def _runs(marks: np.ndarray) -> list[int]:
    """Firsts and lasts of runs of true, one after the other."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).ravel().tolist()


def _spans(runs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Runs of window starts as maximal spans of bytes."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + width)
        else:
            out.append([first, last + width])
    return [(a, b) for a, b in out]


class _Dedup:
    """The steps of one removal. A text is known by the first 128 bits of its SHA-256."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, gram: int):
        self.width, self.gram = width, gram
        ident = F.col(id_col).cast("long")
        self.rows = docs.select(F.coalesce(ident, F.lit(0)).alias("id"), ident.isNull().alias("missing"),
                                F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def names(self) -> DataFrame:
        """One narrow row per document."""
        return stored(self.rows.select(
            "id", "missing", _text_key().alias("key"), F.octet_length("text").cast("long").alias("n_bytes"),
            F.sha2("text", 256).alias("sha")).withColumn("salt", salted("id")), "repeat_names")

    def texts(self, names: DataFrame) -> DataFrame:
        """key, copies, missing, id (the first of the copies). Sums are made where rows are read, so
        a hot text meets as one row per task."""
        return stored(names.where(F.col("n_bytes") >= self.width).groupBy("key").agg(
            F.min(F.struct("missing", "id")).alias("first"), F.count(F.lit(1)).alias("copies"),
        ).select("key", "copies", "first.missing", "first.id"), "repeat_texts")

    def seeds(self) -> DataFrame:
        """name, key, first, last: the segments whose names occur more than once."""
        width, gram = self.width, self.gram

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                seen, parts, size = set(), [], 0
                for raws, keys in _gathered(batch["text"], seen, width):
                    for text, name, first, last, own in together(raws, width, gram):
                        parts.append((name, _objects(keys)[text], first, last, own))
                        size += len(name)
                        if size > 200_000:
                            yield _columns(parts, "name", "key", "first", "last", "own")
                            parts, size = [], 0
                if parts:
                    yield _columns(parts, "name", "key", "first", "last", "own")

        # Written, so that texts are hashed once for both sides of the join.
        every = stored(self.rows.where(F.octet_length("text") >= width).select("text").mapInPandas(
            made, "name long, key binary, first long, last long, own boolean"), "repeat_names_of_segments")
        place = F.xxhash64("key", "first")
        again = every.groupBy("name").agg(F.min(place).alias("lo"), F.max(place).alias("hi"),
                                          F.max("own").alias("own")).where("own or lo <> hi").select("name")
        return stored(every.join(again, "name").select("name", "key", "first", "last")
                      .dropDuplicates(["name", "key", "first"]), "repeat_seeds")

    def marked(self, texts: DataFrame, seeds: DataFrame) -> DataFrame:
        """key, copies, missing, id, text, and names, firsts and lasts of such segments: the texts that
        have any. A text has as many as it is long."""
        parts = seeds.groupBy("key").agg(F.collect_list(F.struct("name", "first", "last")).alias("parts"))
        chosen = texts.join(parts, "key").select(
            "key", "copies", "missing", "id", F.col("parts.name").alias("names"),
            F.col("parts.first").alias("firsts"), F.col("parts.last").alias("lasts"))
        return stored(self.rows.join(chosen, ["missing", "id"]).where(_text_key() == F.col("key")),
                      "repeat_marked")

    def cut(self, marked: DataFrame) -> DataFrame:
        """name, digest, bytes, key, missing, id, first, copies: a row per segment."""
        width = self.width

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                parts, size = [], 0
                for row in batch.itertuples():
                    raw = row.text.encode()
                    for low in range(0, len(row.names), 2_000):
                        firsts, lasts = row.firsts[low: low + 2_000], row.lasts[low: low + 2_000]
                        pieces = [raw[a: b + width] for a, b in zip(firsts.tolist(), lasts.tolist())]
                        n = len(pieces)
                        parts.append((row.names[low: low + 2_000], firsts,
                                      _objects([xxhash.xxh3_128_digest(b) for b in pieces]), _objects(pieces),
                                      _objects([row.key] * n), np.full(n, row.missing), np.full(n, row.id),
                                      np.full(n, row.copies)))
                        size += sum(map(len, pieces))
                        if size > CUT_BYTES:
                            yield _columns(parts, *_SEGMENT)
                            parts, size = [], 0
                if parts:
                    yield _columns(parts, *_SEGMENT)

        return stored(marked.mapInPandas(made, "name long, first long, digest binary, bytes binary, key binary, "
                                               "missing boolean, id long, copies long"), "repeat_segments")

    def solved(self, distinct: DataFrame, block_bytes: int, block_segments: int) -> DataFrame:
        """name, digest, repeated, firsts: of each distinct segment, the runs of its windows that
        occur elsewhere, and of those the runs that occur nowhere earlier."""
        sizes = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum(F.octet_length("bytes")).alias("size"))
        hot = sizes.where((F.col("n") > block_segments) | (F.col("size") > block_bytes)).select("name")
        total = distinct.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        blocks = max(1, -(-total // block_bytes))
        return self.blocks(distinct.join(hot, "name", "left_anti"), blocks).unionByName(
            self.windows(distinct.join(hot, "name", "left_semi")))

    def blocks(self, distinct: DataFrame, blocks: int) -> DataFrame:
        width = self.width

        def solve(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["missing", "id", "first", "digest"], kind="stable", ignore_index=True)
            raw = group["bytes"].tolist()
            sizes = np.array([len(b) for b in raw])
            data = np.frombuffer(b"".join(raw), np.uint8)
            counts = sizes - width + 1
            at = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(raw)), counts)
            starts = (np.cumsum(sizes) - sizes)[owner] + np.arange(counts.sum()) - at[owner]
            # Segments are in order of their first occurrence, so places in the block are too.
            lengths, sources = longest_previous_factors(data, width, starts)
            earlier, later = lengths >= width, np.zeros(len(starts), dtype=bool)
            later[sources[earlier]] = True
            elsewhere = earlier | later | (group["copies"].to_numpy() > 1)[owner]
            return pd.DataFrame({
                "name": group["name"], "digest": group["digest"],
                "repeated": [_runs(elsewhere[a: a + n]) for a, n in zip(at, counts)],
                "firsts": [_runs(~earlier[a: a + n]) for a, n in zip(at, counts)]})

        return (distinct.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)))
                .groupBy("block").applyInPandas(solve, _SOLVED))

    def windows(self, distinct: DataFrame) -> DataFrame:
        """The same by digests of windows, for names that have very many segments."""
        width = self.width

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples():
                    n = len(row.bytes) - width + 1
                    for low in range(0, n, 10_000):
                        starts = range(low, min(n, low + 10_000))
                        yield pd.DataFrame({
                            "window": [xxhash.xxh3_128_digest(row.bytes[s: s + width]) for s in starts],
                            "name": row.name, "digest": [row.digest] * len(starts), "start": list(starts),
                            "missing": row.missing, "id": row.id, "first": row.first, "copies": row.copies})

        def gathered(group: pd.DataFrame) -> pd.DataFrame:
            marks = np.zeros(int(group["start"].max()) + 1, dtype=bool)
            firsts = marks.copy()
            marks[group["start"]] = True
            firsts[group["start"][group["is_first"]]] = True
            return group.head(1)[["name", "digest"]].assign(repeated=[_runs(marks)], firsts=[_runs(firsts)])

        every = distinct.select("name", "digest", "bytes", "missing", "id", "first", "copies").mapInPandas(
            made, "window binary, name long, digest binary, start int, missing boolean, id long, "
                  "first long, copies long")
        place = F.struct("missing", "id", "first", "start")
        again = every.groupBy("window").agg(
            F.sum("copies").alias("n"), F.min(place).alias("lo")).where("n > 1").select("window", "lo")
        return every.join(again, "window").select(
            "name", "digest", "start", (place == F.col("lo")).alias("is_first"),
        ).groupBy("name", "digest").applyInPandas(gathered, _SOLVED)

    def removed(self, marked: DataFrame, cut: DataFrame, solved: DataFrame, keep_first: bool) -> DataFrame:
        """key, n_removed, spans, kept_sha of the texts that lose bytes."""
        width = self.width

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for row in batch.itertuples():
                    raw, runs = row.text.encode(), []
                    for part in row.runs:
                        marks = list(zip(part["repeated"][::2], part["repeated"][1::2]))
                        if keep_first and part["is_first"]:
                            marks = _without(marks, list(zip(part["firsts"][::2], part["firsts"][1::2])))
                        runs += [(part["first"] + a, part["first"] + b) for a, b in marks]
                    spans = _spans(runs, width)
                    kept = b"".join(raw[a:b] for a, b in zip(
                        [0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]))
                    out.append((row.key, len(raw) - len(kept), [{"start": a, "end": b} for a, b in spans],
                                hashlib.sha256(kept).hexdigest()))
                yield pd.DataFrame(out, columns=["key", "n_removed", "spans", "kept_sha"])

        lowest = cut.groupBy("name", "digest").agg(F.min(F.struct("missing", "id", "first")).alias("lo"))
        answers = solved.join(lowest, ["name", "digest"]).where(F.size("repeated") > 0)
        runs = cut.select("name", "digest", "key", "missing", "id", "first").join(
            answers, ["name", "digest"]).select("key", F.struct(
                "first", "repeated", "firsts", (F.struct("missing", "id", "first") == F.col("lo")).alias("is_first"),
            ).alias("run")).groupBy("key").agg(F.collect_list("run").alias("runs"))
        return marked.select("key", "text").join(runs, "key").mapInPandas(
            made, f"key binary, n_removed long, spans {_SPANS}, kept_sha string").dropDuplicates(["key"])


_SOLVED = "name long, digest binary, repeated array<int>, firsts array<int>"
_SPANS = "array<struct<start: long, end: long>>"


_SEGMENT = ("name", "first", "digest", "bytes", "key", "missing", "id", "copies")


def _text_key() -> Column:
    """The first 128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def _gathered(texts: Iterable[str], seen: set[bytes], width: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Texts not seen before and their keys, short ones together up to TOGETHER bytes."""
    raws, keys, size = [], [], 0
    for text in texts:
        raw = text.encode()
        key = hashlib.sha256(raw).digest()[:16]  # as _text_key
        if len(raw) < width or key in seen:
            continue
        seen.add(key)
        if raws and size + len(raw) > TOGETHER:
            yield raws, keys
            raws, keys, size = [], [], 0
        raws.append(raw)
        keys.append(key)
        size += len(raw)
    if raws:
        yield raws, keys


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def _columns(parts: list[tuple[np.ndarray, ...]], *names: str) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*parts)))))


def _without(runs: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs less those of others, firsts and lasts included."""
    out = []
    for a, b in runs:
        for c, d in others:
            if d < a or c > b:
                continue
            if c > a:
                out.append((a, c - 1))
            a = d + 1
        if a <= b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   gram: int = GRAM, keep_first: bool = False, block_bytes: int = BLOCK_BYTES,
                   block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of
    each maximal removed run, in bytes).

    Each byte covered by a string of `width` bytes that also starts elsewhere, in any text, is
    removed; overlaps count, and strings are judged on the input. With `keep_first`, of equal
    strings the one in the text with the smallest id, and there the earliest, doesn't count. Null
    texts are empty; texts shorter than `width` keep all. Rows with the same or a null id are judged
    one by one; of rows equal in id and text, `keep_first` keeps all. An empty table gives no rows.
    Other columns are not read.
    """
    work = _Dedup(docs, id_col, text_col, width, gram)
    names = work.names()
    texts = work.texts(names)
    seeds = work.seeds()
    marked = work.marked(texts, seeds)
    cut = work.cut(marked)
    distinct = stored(cut.groupBy("name", "digest").agg(
        F.first("bytes").alias("bytes"), F.min(F.struct("missing", "id", "first")).alias("lo"),
        F.sum("copies").alias("copies"),
    ).select("name", "digest", "bytes", "copies", "lo.missing", "lo.id", "lo.first"), "repeat_distinct")
    solved = stored(work.solved(distinct, block_bytes, block_segments), "repeat_solved")
    removed = work.removed(marked, cut, solved, keep_first)

    answers = texts.join(removed, "key", "left").select(
        "key", "copies", F.struct("missing", "id").alias("first"), "n_removed", "spans", "kept_sha")
    rows = joined_evenly(names, answers, "key", "salt")
    copy = F.coalesce(F.col("copies") > 1, F.lit(False))
    if keep_first:
        copy &= F.struct("missing", "id") != F.col("first")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast(_SPANS)
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", none))
    return rows.select(
        F.when(~F.col("missing"), F.col("id")).alias(id_col), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.size(spans).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        spans.alias("spans"))
