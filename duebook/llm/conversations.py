"""Repair of conversations: the cheapest edits that make the roles of a conversation alternate.

Each row is reduced to one byte, its signature: the initial of its role as far as the grammar tells it
apart, and what its fault does to the price of an edit. The distinct sequences of signatures, over all
conversations, are sorted from their ends, so sequences with a common suffix lie side by side and the
suffixes make an automaton (a suffix-shared DAWG): a node is a suffix. Walking the sorted sequences,
a task keeps the nodes of the last sequence only, and works out each node's cost to go and best next
edit once per grammar state, for all conversations that end alike. Edits are then read off along a
sequence's nodes.

The states of the grammar `(s?(ua)+)?` are START, after s (SYSTEM), after u (USER) and after a (BOTH).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import stored

USER, ASSISTANT = "user", "assistant"
#: Prices of edits, and what is added for a truncated row that stays.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
DAMAGE = 20
#: Hex digits of a sequence in a splitter.
SPLITTER = 64
#: What counts as blank.
BLANKS = r"[\x20\x09-\x0D]"

# The grammar: the one role that may come next, by state; START also takes a system row.
START, SYSTEM, AFTER_USER, BOTH = range(4)
_NEXT = (b"u", b"u", b"a", b"u")
_THEN = (AFTER_USER, AFTER_USER, BOTH, AFTER_USER)
_LEGAL = {"su", "ua", "au"}
_INITIALS = "sua"
_NEVER = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text and copies after damage; nulls in the last two are one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank),
                      F.coalesce(F.col("turn").cast("string"), blank))
    kind, text = F.crc32(key) % DAMAGE, F.coalesce("text", blank)
    return rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, USER).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))


# -- the automaton ---------------------------------------------------------------------------------

def signature(role: str, fault: str) -> int:
    """One byte: the initial (0 for any other) and the fault."""
    initial = _INITIALS.find(role[:1]) + 1 if role else 0
    return 48 + initial * 3 + ("", "truncated", "gone").index("gone" if fault in ("blank", "duplicate") else fault)


def _cost_to_go(byte: int, then: tuple) -> tuple:
    """For each state the least cost of a suffix that begins with this row, the first edit and the
    state and node after it; `then` is the same for the suffix without it. Edits that cost the same
    differ in their letter, so the letter alone settles ties."""
    initial, fault = divmod(byte - 48, 3)
    spared = TRUNCATED if fault == 1 else 0
    best = []
    for state in range(4):
        choices = [(DELETE + then[state][0], "D", state)]
        if fault != 2:
            target, after = _NEXT[state], _THEN[state]
            choices.append((RENAME + spared + then[after][0], "R", after))
            kept = "_sua"[initial].encode()
            if kept == target:
                choices.append((spared + then[after][0], "K", after))
            elif state == START and kept == b"s":
                choices.append((spared + then[SYSTEM][0], "K", SYSTEM))
        best.append(min(choices))
    return _inserted(best)


def _inserted(best: list[tuple]) -> tuple:
    """The same with rows put in before: from any state one role can be put in, and two of them
    lead from AFTER_USER and BOTH back to where they began, so one look ahead is enough there."""
    user = min(best[AFTER_USER], (INSERT + best[BOTH][0], "I", BOTH))
    both = min(best[BOTH], (INSERT + best[AFTER_USER][0], "I", AFTER_USER))
    first = (min(best[s], (INSERT + user[0], "I", AFTER_USER)) for s in (START, SYSTEM))
    return (*first, user, both)


def _end() -> tuple:
    """The node without a row: START and BOTH may end a conversation."""
    return _inserted([(0, "", START), (_NEVER, "", SYSTEM), (_NEVER, "", AFTER_USER), (0, "", BOTH)])


class SuffixAutomaton:
    """The nodes of the suffixes of the last sequence. Sequences added in the order of their
    reversals share nodes as far as they end alike, and a node left is never met again."""

    def __init__(self):
        self.nodes, self.last = [_end()], b""

    def cheapest(self, sequence: bytes) -> tuple[int, str]:
        """The least cost, and the edits' letters in order."""
        ending = sequence[::-1]
        shared = 0
        if ending.startswith(self.last):
            shared = len(self.last)
        else:
            while shared < min(len(ending), len(self.last)) and ending[shared] == self.last[shared]:
                shared += 1
        del self.nodes[shared + 1:]
        for byte in ending[shared:]:
            self.nodes.append(_cost_to_go(byte, self.nodes[-1]))
        self.last = ending
        letters, state = [], START
        for node in reversed(self.nodes):
            while True:
                _, letter, state = node[state]
                letters.append(letter)
                if letter != "I":
                    break
        return self.nodes[-1][START][0], "".join(letters)


def _audit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    for batch in batches:
        sequences = batch.column(0).to_pylist()
        found = [automaton.cheapest(s) for s in sequences]
        yield pa.RecordBatch.from_pydict({
            "signatures": pa.array(sequences, pa.binary()), "cost": pa.array([c for c, _ in found], pa.int64()),
            "audit": pa.array([a for _, a in found], pa.string())})


def audits(sequences: DataFrame) -> DataFrame:
    """signatures, cost and audit of each distinct sequence of a binary column `signatures`."""
    distinct = sequences.select("signatures").distinct().withColumn("_ending", F.reverse(F.hex("signatures")))
    # Reversed hex digits sort like reversed bytes as far as sharing goes: equal endings lie together.
    # Splitters are sampled on the driver, so they are short however long a sequence is.
    ordered = distinct.repartitionByRange(F.substring("_ending", 1, SPLITTER)).sortWithinPartitions("_ending")
    return ordered.select("signatures").mapInArrow(_audit, "signatures binary, cost long, audit string")


# -- rows of a conversation, in order -----------------------------------------------------------------

#: Rows turned into Python values at a time.
_SLICE = 500


def _rows(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            yield from zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns))


def _blank(column: Column) -> Column:
    return ~F.regexp_like(column, F.lit(r"[^\x20\x09-\x0D]"))


class _Summary:
    """What is known of a conversation while its rows go by: one byte a row and a few numbers."""

    def __init__(self):
        self.bytes, self.low, self.high, self.turns, self.turn = bytearray(), None, None, 0, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None

    def add(self, turn, role, blank, cut, repeats, copies):
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        for copy in range(copies):
            fault = "blank" if blank else "duplicate" if repeats or copy else "truncated" if cut else ""
            self.bytes.append(signature(role, fault))
            self.blank += fault == "blank"
            self.duplicate += fault == "duplicate"
            self.truncated += fault == "truncated"
            if self.initial is not None and self.initial + role[:1] not in _LEGAL:
                self.illegal += 1
            self.initial = role[:1]

    def values(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, bytes(self.bytes)


def _summarise(id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), *((n, pa.int64()) for n in (
        "gaps", "blank", "duplicate", "truncated", "illegal")), ("signatures", pa.binary())])

    def run(batches):
        done, current, summary = [], None, None
        fields = ["rank", "conv_id", "turn", "role", "blank", "cut", "repeats", "copies"]
        for rank, conv, *row in _rows(batches, fields):
            if rank == 0:  # every conversation begins with a row of its own
                if summary:
                    done.append((current, *summary.values()))
                    if len(done) >= _SLICE:
                        yield _batch(done, schema)
                        done = []
                current, summary = conv, _Summary()
            else:
                summary.add(*row)
        if summary:
            done.append((current, *summary.values()))
        if done:
            yield _batch(done, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class _Hash:
    """The SHA-256 of a repaired conversation, fed row by row. The roles of what is left follow from
    their number: they alternate, and an odd number begins with a system row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.digest = audit, 0, hashlib.sha256()
        left = len(audit) - audit.count("D")
        self.place, self.count = (0 if left % 2 else 1), 0

    def put(self, role: str | None, text: str):
        wanted = (USER, ASSISTANT)[(self.place + 1) % 2]
        line = f"{wanted if role is None else role}:{text}"
        self.digest.update((("\n" if self.count else "") + line).encode())
        self.place, self.count = self.place + 1, self.count + 1

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(None, "")
            self.at += 1

    def row(self, role: str, text: str):
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else None, text)

    def value(self) -> str:
        self.inserted()
        return self.digest.hexdigest()


def _hashed(id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), ("repaired_sha256", pa.string())])

    def run(batches):
        done, current, digest = [], None, None
        for rank, conv, role, text, copies in _rows(batches, ["rank", "conv_id", "role", "text", "copies"]):
            if rank == 0:
                if digest:
                    done.append((current, digest.value()))
                    if len(done) >= _SLICE:
                        yield _batch(done, schema)
                        done = []
                current, digest = conv, _Hash(text)  # the row before a conversation's own has its audit
            else:
                for _ in range(copies):
                    digest.row(role, text)
        if digest:
            done.append((current, digest.value()))
        if done:
            yield _batch(done, schema)

    return run


def _in_order(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a conversation after its head, in order, none of them in another task."""
    return heads.unionByName(rows, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "rank", F.col("turn").asc_nulls_first(), "role", "text")


def repair(conversations: DataFrame, after: DataFrame) -> DataFrame:
    """One row per conversation of `conversations` (column conv_id), with the faults of the rows
    `after` (conv_id, turn, role, text, copies; no nulls in the last three) and the cheapest repair.

    A conversation's rows stand by turn, nulls first, then by role and text, each with its copies. Rows
    are streamed in that order and never held: of a conversation a task keeps one byte a row, the
    length of its audit.
    """
    keys = ["conv_id", "turn", "role", "text"]
    # Equal rows of a turn become one with their number before anything is shuffled.
    rows = stored(after.groupBy(*keys).agg(F.sum("copies").alias("copies")).withColumns({
        "rank": F.lit(1), "print": F.sha2("text", 256)}), "conversation_rows")
    # Where role and text come in several turns, the first of them counts.
    first = rows.groupBy(F.col("conv_id").alias("_id"), F.col("role").alias("_role"), F.col("print").alias("_print")).agg(
        F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    same = F.expr("conv_id <=> _id AND role = _role AND print = _print")
    stripped = F.regexp_replace("text", f"{BLANKS}+$", "")
    marked = rows.join(first, same, "left").select(
        "rank", "conv_id", "turn", "role", "text", "copies",
        (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("repeats"),
        _blank(F.col("text")).alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("cut"))
    heads = conversations.select("conv_id").distinct().withColumn("rank", F.lit(0))
    id_type = conversations.schema["conv_id"].dataType
    kind = id_type.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    summaries = stored(_in_order(heads, marked).mapInArrow(
        _summarise(arrow), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, signatures binary"), "conversations")
    repaired = stored(summaries.join(stored(audits(summaries), "audits"), "signatures"), "audited")
    heads = repaired.select("conv_id", F.lit(0).alias("rank"), F.col("audit").alias("text"))
    digests = _in_order(heads, rows.select("rank", *keys, "copies")).mapInArrow(
        _hashed(arrow), f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "_id")
    return repaired.join(digests, F.col("conv_id").eqNullSafe(F.col("_id"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The conversations, damaged by the hash of `conv_id:turn`, and repaired.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each
    conv_id of the input, null included. A null role or text is one space; null turns come first and
    count for no gap. Rows of one turn stand by role and text (code-point order), repeated ones side by
    side. A conversation without rows after damage has zeros, an empty audit and the hash of an
    empty string. An empty table gives no rows. Other columns are not read.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    return repair(rows, damaged(rows))
