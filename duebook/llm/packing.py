"""Packing documents into sequences by multiway differencing (Karmarkar and Karp).

A document's ids are cut into full windows and a tail, the tail into a few near-equal pieces.
Full windows are sequences as they are. Tails are dealt into groups of a bounded number of
documents, and each group is split into near-equal windows by differencing; while the fullest
exceeds the capacity, the group gets one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.llm.tokens import encoder

CAPACITY = 1024
#: A tail is cut into pieces of at most this many ids. Shorter ones balance better and scatter
#: a document more; at 256, padding is about 0.6 % on the test tables, at 1024 about 2 %.
PIECE = 256
#: Documents whose tails are packed together, on average.
GROUP_DOCS = 512
#: Characters of text that a task encodes together, and texts that it passes on together.
ENCODED_CHARS, PASSED_TEXTS = 1_000_000, 500


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item, and the windows' loads, near-equal.

    Each item starts as a partial partition of its own. The two with the largest imbalance are
    merged, the largest window of one with the smallest of the other, until one is left.
    """
    n = len(sizes)
    # (minus imbalance, age, loads in falling order, the node in each window); absent windows
    # are empty. A node is an item or a joint of two nodes.
    heap = [(-int(s), i, np.array([s], dtype=np.int64), np.array([i], dtype=np.int64))
            for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    age = joints = n
    left, right = [], []
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        if len(a) + len(b) <= windows:
            loads, nodes = np.concatenate([a, b]), np.concatenate([a_nodes, b_nodes])
        else:
            loads, nodes = np.zeros(windows, dtype=np.int64), np.full(windows, -1, dtype=np.int64)
            loads[: len(a)], nodes[: len(a)] = a, a_nodes
            place = windows - 1 - np.arange(len(b))  # the largest of b meets the smallest of a
            joint = place < len(a)
            new = joints + np.arange(int(joint.sum()))
            joints += len(new)
            left.append(nodes[place[joint]])
            right.append(b_nodes[joint])
            loads[place] += b
            nodes[place[joint]], nodes[place[~joint]] = new, b_nodes[~joint]
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        least = int(loads[-1]) if len(loads) == windows else 0
        heapq.heappush(heap, (least - int(loads[0]), age, loads, nodes))
        age += 1
    loads, nodes = heap[0][2:]
    own = np.empty(joints, dtype=np.int64)
    own[nodes] = np.arange(len(nodes))
    if left:
        for j, (x, y) in reversed(list(enumerate(zip(np.concatenate(left), np.concatenate(right))))):
            own[x] = own[y] = own[n + j]
    return own[:n], loads


def pack_pieces(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; no window exceeds the capacity, which no piece does."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    windows = -(-int(sizes.sum()) // capacity)
    while True:
        own, loads = differencing(sizes, windows)
        if int(loads[0]) <= capacity:
            return own
        windows += 1


def cuts(tokens: int, capacity: int, piece: int) -> np.ndarray:
    """Starts of a document's pieces and its end: full windows, then a tail in near-equal parts."""
    full = tokens // capacity * capacity
    tail = tokens - full
    parts = -(-tail // piece)
    ends = full + (np.arange(1, parts + 1) * tail) // max(parts, 1)
    return np.concatenate([np.arange(0, full + 1, capacity), ends]).astype(np.int64)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, cut: str = "space",
                   capacity: int = CAPACITY, piece: int = PIECE, group_docs: int = GROUP_DOCS,
                   id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of a document and the end id after them lies in exactly one piece; within a
    sequence, pieces follow each other without a gap. `with_ids` adds the ids of the piece.
    Null texts are empty and have the end id alone; so has every document at least one piece.
    Rows with the same id, or a null one, are packed one by one. An empty table gives no rows.
    Other columns are not read.

    Only the pieces are shuffled, not the texts. A group is as large as its documents' tails,
    whatever the size of the table.
    """
    groups = max(1, -(-docs.count() // group_docs))
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cut).encode
        for batch in (b.slice(i, PASSED_TEXTS) for b in batches for i in range(0, len(b), PASSED_TEXTS)):
            starts, lengths, crcs, rows, sizes, ids = [], [], [], [], [], []
            for i, done in enumerate(encode(batch["text"].to_pylist(), ENCODED_CHARS)):
                raw = done + end
                at = cuts(len(raw) // 4, capacity, piece)
                starts.append(at[:-1])
                lengths.append(np.diff(at))
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    crcs.append(zlib.crc32(raw[4 * a: 4 * b]))
                    if with_ids:
                        ids.append(np.frombuffer(raw[4 * a: 4 * b], "<u4").astype(np.int64))
                rows.append(np.full(len(at) - 1, i))
                sizes.append(np.full(len(at) - 1, len(raw) // 4))
            if rows:
                row = pa.array(np.concatenate(rows))
                out = {
                    "doc_id": batch["id"].take(row), "missing": batch["missing"].take(row),
                    "pack": batch["pack"].take(row), "start": np.concatenate(starts),
                    "length": np.concatenate(lengths), "ids_crc32": pa.array(crcs, pa.int64()),
                    "doc_tokens": np.concatenate(sizes),
                }
                yield pa.RecordBatch.from_pydict(out | ({"ids": ids} if with_ids else {}))

    def placed(group: pa.Table) -> pa.Table:
        # In one order whatever the shuffle's, so that a task that runs again packs alike.
        group = group.take(pa.array(np.lexsort([group[x].to_numpy() for x in (
            "ids_crc32", "doc_tokens", "start", "doc_id", "missing")])))
        lengths = group["length"].to_numpy()
        full = lengths == capacity
        window = np.empty(len(lengths), dtype=np.int64)
        window[full] = np.arange(int(full.sum()))
        window[~full] = int(full.sum()) + pack_pieces(lengths[~full], capacity)
        by_window = np.argsort(window, kind="stable")
        ends = np.cumsum(lengths[by_window])
        first = np.append(True, np.diff(window[by_window]) != 0)
        begins = ends - lengths[by_window]
        offset = np.empty_like(window)
        offset[by_window] = begins - begins[first][np.cumsum(first) - 1]
        window += np.int64(group["pack"][0].as_py()) << 32
        return (group.drop_columns("pack").append_column("sequence_id", pa.array(window))
                .append_column("offset", pa.array(offset)))

    ident = F.col(id_col).cast("long")
    rows = docs.select(
        F.coalesce(ident, F.lit(0)).alias("id"), ident.isNull().alias("missing"),
        F.pmod(F.xxhash64(ident, F.crc32(F.coalesce(F.col(text_col), F.lit("")))), F.lit(groups)).alias("pack"),
        F.col(text_col).alias("text"),
    )
    columns = "doc_id long, missing boolean, {}start long, length long, ids_crc32 long, doc_tokens long"
    more = ", ids array<long>" if with_ids else ""
    packed = (rows.mapInArrow(pieces, columns.format("pack long, ") + more)
              .groupBy("pack").applyInArrow(
                  placed, columns.format("") + more + ", sequence_id long, offset long"))
    return packed.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
        *(["ids"] if with_ids else []))
