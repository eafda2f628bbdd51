"""Spelling variants: words that differ by one code point, found through variable-length grams.

A word with END after it is cut into one gram per code point: from that place on, two code points,
and one more as long as what was read so far is in the dictionary and the gram is shorter than
LONGEST_GRAM. The dictionary holds the grams that are frequent among the words; the rest of the gram
tree is pruned, so rare short grams stay short and frequent ones grow.

Whether a gram ends is settled by the code points it holds, so one edit affects exactly the grams that
hold the edited place. All others are found in the other word too: those before the edit with the
same text before them, those after it with the same text after them. A gram's list is therefore kept per
what stands before it, or after it. For each place where a word may be edited, what the
bound leaves unaffected is known from the word alone, and it is the same for both words of a pair; of
those lists the one with the longest context is taken on either side. Merging the lists taken gives
every pair with one edit; Levenshtein distance 1 verifies.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A run whose hash this divides loses one code point.
TYPO = 199
#: How many times as frequent as a word its form must be.
FORM_TIMES = 5

END = "$"
SHORTEST_GRAM = 2
#: A word of LEAST_LENGTH has a gram that an edit at its end leaves whole.
LONGEST_GRAM = 4
#: Grams that are more than this share of all of one length are in the dictionary: of each length at
#: most 1 / GRAM_SHARE, whatever the number of words.
GRAM_SHARE = 1 / 800

#: Counts held by a task before it hands them on.
HELD_WORDS = 100_000

# Latin-1 bytes: letters, A-Z lower-cased; everything else, code points beyond included, parts runs.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _words_of(prefix: bytes, text: str) -> Iterator[tuple[bytes, int]]:
    """Words of one text, as Latin-1, with their counts; a word may come twice. `prefix` is what
    stands before a run where it is hashed."""
    runs = Counter(w for w in text.encode("latin-1", "replace").translate(_RUNS).split() if len(w) >= LEAST_LENGTH)
    start = zlib.crc32(prefix)
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % TYPO == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def handed_on():
        words = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())],
                                          schema=_COUNTS)

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if text:
                for word, n in _words_of(f"{key.as_py() or ''}:".encode(), text):
                    held[word] += n
            if len(held) >= HELD_WORDS:
                yield handed_on()
                held.clear()
    if held:
        yield handed_on()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH code points that occur LEAST_COUNT times, over all
    texts. Tasks add up their words before the shuffle."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count_words, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def frequent_grams(words: DataFrame) -> frozenset[str]:
    """The dictionary: at most (LONGEST_GRAM - SHORTEST_GRAM) / GRAM_SHARE grams."""
    text = F.concat("word", F.lit(END))
    places = F.sequence(F.lit(1), F.char_length("word"))
    grams = [
        words.select(F.explode(F.transform(places, lambda p: F.substr(text, p, F.lit(size)))).alias("gram"))
        .where(F.char_length("gram") == size)
        for size in range(SHORTEST_GRAM, LONGEST_GRAM)
    ]
    if not grams:
        return frozenset()
    counted = grams[0]
    for more in grams[1:]:
        counted = counted.unionAll(more)
    counted = counted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted, "grams").withColumn("size", F.char_length("gram"))
    total = counted.groupBy("size").agg(F.sum("n").alias("total"))  # one row per length
    often = counted.join(F.broadcast(total), "size").where(F.col("n") > F.col("total") * GRAM_SHARE)
    return frozenset(r.gram for r in often.select("gram").collect())


def grams_of(word: str, dictionary: frozenset[str]) -> list[tuple[int, int]]:
    """Start and end of the gram at each code point of the word, in word + END."""
    text, found = word + END, []
    for start in range(len(word)):
        end = start + SHORTEST_GRAM
        while end < len(text) and end - start < LONGEST_GRAM and text[start:end] in dictionary:
            end += 1
        found.append((start, end))
    return found


def lists_of(word: str, dictionary: frozenset[str]) -> tuple[set[str], set[str]]:
    """The lists a word is looked up in: where it loses or changes a code point, and where it gains
    one. A list's name is the text up to the end of a gram after "<", or from its start on after ">"."""
    grams, text, length = grams_of(word, dictionary), word + END, len(word)
    before = [0] * (length + 1)  # where the last gram ends that lies before a place
    for _, end in grams:
        if end <= length:
            before[end] = end
    for place in range(1, length + 1):
        before[place] = before[place] or before[place - 1]

    def longest(ends_by: int, starts_at: int) -> str:
        """Of the grams that end by the one place or start at the other or later."""
        head, tail = before[ends_by], length + 1 - starts_at if starts_at < length else 0
        return "<" + text[:head] if head >= tail else ">" + text[starts_at:]

    return ({longest(at, at + 1) for at in range(length)}, {longest(at, at) for at in range(length + 1)})


_LISTS = pa.schema([("list", pa.string()), ("length", pa.int32()), ("gains", pa.bool_()),
                    ("word", pa.string()), ("n", pa.int64())])


def _lister(dictionary: frozenset[str]):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                columns: list[list] = [[], [], [], [], []]
                part = batch.slice(at, 2000)
                for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for gains, names in enumerate(lists_of(word, dictionary)):
                        for name in names:
                            for column, value in zip(columns, (name, len(word) + gains, gains == 1, word, n)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTS)], schema=_LISTS)

    return listed


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: each pair of words with exactly one edit between them, once. `words` has the
    columns word and n, each word once, of at least LEAST_LENGTH code points."""
    dictionary = frequent_grams(words)
    lists = stored(words.select("word", "n").mapInArrow(
        _lister(dictionary), "list string, length int, gains boolean, word string, n long"), "gram_lists")
    # The longer word of a pair loses the code point that the shorter one gains; words of one length
    # change one. `length` is that of the longer word.
    longer = lists.where("not gains").select("list", "length", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = lists.select("list", "length", "gains", F.col("word").alias("b"), F.col("n").alias("n_b"))
    once = F.col("gains") | (F.col("a") < F.col("b"))
    found = longer.join(other, ["list", "length"]).where(once & (F.levenshtein("a", "b", 1) == 1))
    return found.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


def _with_roots(words: DataFrame) -> DataFrame:
    """words (word, form, ...) with root. A form is at least FORM_TIMES as frequent as its word, so
    chains are short; each round doubles what is followed, until every root is without a form."""
    known = words.where("form is not null")
    steps = stored(known.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_step = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(steps.join(next_step, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return words.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Runs of letters (A-Z, a-z and U+00C0 to U+00FF) of every whole text, A-Z lower-cased; where TYPO
    divides the crc32 of `<id>:<run>`, the run loses the code point at crc32 modulo its length. A word's
    form is the most frequent word with one edit between them (ties: the smallest in code-point order), if
    it is at least FORM_TIMES as frequent; its root is where following forms ends.

    A null or empty text has no words; a null id is hashed as an empty one; rows count one by one, repeated
    ones too. Letters beyond U+00FF part runs. An empty table gives no rows. Other columns are not
    read. No text is shuffled, only counts per task; the lists, one row per word and place, are
    joined by list and length, which Spark splits where a list is long. Only the dictionary is sent to
    the tasks; its size is bounded by GRAM_SHARE.
    """
    words = stored(word_counts(docs, id_col, text_col), "words")
    pairs = stored(near_pairs(words), "near_words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct(F.negative("n").alias("n"), F.col("other").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn(
        "far", F.coalesce(F.negative("best.n") >= FORM_TIMES * F.col("n"), F.lit(False)))
    rows = stored(rows.select(
        "word", F.when(F.col("far"), F.col("best.form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("far"), F.negative("best.n")).alias("form_n")), "forms")
    return _with_roots(rows).select("word", "form", "root", "n", "n_near", "form_n")
