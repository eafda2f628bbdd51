"""Token ids in binary files of patched frame-of-reference blocks.

A file is a run of segments, each closed by a line feed. A segment (all little-endian):

    magic b"PFOR" | u32 documents | u32 tokens | u32 blocks | u32 bytes of the body
    u8 has-id per document | i64 id per document | u32 tokens per document
    u32 start of each block in the body
    body: per block  u32 minimum | u8 width | u16 exceptions | packed offsets of `width` bits
                     | u8 position per exception | u32 offset per exception

A block holds BLOCK ids (the last one fewer). Offsets from the minimum are packed at the width
that WIDTH_PERCENTILE of them need; the rest are exceptions. A document's ids lie within one
segment. Files are written by Spark's text writer, whose commit makes a retried or doubled task
harmless on any file system, and whose line end is the closing line feed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duebook.llm.tokens import encoder

MAGIC = b"PFOR"
BLOCK = 256
WIDTH_PERCENTILE = 90
#: Tokens after which a segment is closed, and segments in a file: a reader holds one file.
SEGMENT_TOKENS = 500_000
FILE_SEGMENTS = 16
#: Blocks unpacked together; their arrays stay in the cache.
UNPACKED = 256

_HEAD = struct.Struct("<4sIIII")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks in the body, and the body."""
    parts, starts, at = [], [], 0
    whole = len(ids) // BLOCK * BLOCK
    for blocks in (ids[:whole].reshape(-1, BLOCK), ids[whole:].reshape(1, -1)):
        if not blocks.size:
            continue
        low = blocks.min(axis=1)
        offsets = (blocks - low[:, None]).astype(np.uint32)
        n = blocks.shape[1]
        place = min(n - 1, (n * WIDTH_PERCENTILE + 99) // 100 - 1)
        width = _bits(np.partition(offsets, place, axis=1)[:, place])
        over = offsets >> width[:, None].astype(np.uint32) != 0
        kept = np.where(over, 0, offsets).astype("<u4")
        packed: list[bytes] = [b""] * len(blocks)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            bits = np.unpackbits(kept[rows].view(np.uint8).reshape(len(rows), n, 4), axis=2, count=w, bitorder="little")
            flat = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            size, lines = flat.shape[1], flat.tobytes()
            for i, row in enumerate(rows.tolist()):
                packed[row] = lines[i * size: (i + 1) * size]
        row, where = np.nonzero(over)
        places, values = where.astype(np.uint8).tobytes(), offsets[row, where].astype("<u4").tobytes()
        ends = np.cumsum(over.sum(axis=1))
        first = 0
        for b, (least, bits, last) in enumerate(zip(low.tolist(), width.tolist(), ends.tolist())):
            part = (struct.pack("<IBH", least, bits, last - first) + packed[b]
                    + places[first:last] + values[4 * first: 4 * last])
            starts.append(at)
            parts.append(part)
            at += len(part)
            first = last
    return np.array(starts, dtype="<u4"), b"".join(parts)


def unpack_blocks(body: bytes, starts: np.ndarray, tokens: int) -> np.ndarray:
    """All ids of a body; blocks of the same width are unpacked together."""
    raw = np.frombuffer(body, np.uint8)
    starts = starts.astype(np.int64)
    out = np.empty(tokens, dtype=np.uint32)
    whole = tokens // BLOCK
    heads = raw[starts[:, None] + np.arange(7)]
    low = heads[:, :4].copy().view("<u4")[:, 0]
    width, over = heads[:, 4].astype(np.int64), heads[:, 5:7].copy().view("<u2")[:, 0]
    lengths = np.full(len(starts), BLOCK, dtype=np.int64)
    lengths[whole:] = tokens - whole * BLOCK
    for n, w in {(int(n), int(w)) for n, w in zip(lengths, width)}:
        # Each value lies within four bytes, wide ones within eight, from the byte of its first bit.
        bits = np.arange(n) * w
        size, word = (n * w + 7) // 8, 4 if w <= 25 else 8
        kind, take = np.dtype(f"<u{word}"), (bits >> 3)
        shift, mask = (bits & 7).astype(kind), kind.type((1 << w) - 1)
        same = np.flatnonzero((lengths == n) & (width == w))
        for rows in np.split(same, np.arange(UNPACKED, len(same), UNPACKED)):
            lines = np.zeros((len(rows), size + word), dtype=np.uint8)
            lines[:, :size] = raw[starts[rows][:, None] + 7 + np.arange(size)]
            words = np.ndarray((len(rows), size + 1), kind, lines, strides=(size + word, 1))
            offsets = (words[:, take] >> shift) & mask
            out[(rows[:, None] * BLOCK + np.arange(n)).ravel()] = (offsets + low[rows][:, None]).ravel()
    for b in np.flatnonzero(over).tolist():
        n, k = int(lengths[b]), int(over[b])
        at = int(starts[b]) + 7 + (n * int(width[b]) + 7) // 8
        out[b * BLOCK + raw[at: at + k].astype(np.int64)] = (
            np.frombuffer(body, "<u4", k, at + k) + low[b])
    return out


def write_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    lengths = np.array([len(x) // 4 for x in ids], dtype="<u4")
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts, body = pack_blocks(flat)
    present = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    return (_HEAD.pack(MAGIC, len(ids), len(flat), len(starts), len(body)) + present.tobytes()
            + names.tobytes() + lengths.tobytes() + starts.tobytes() + body)


def read_segments(content: bytes) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """The ids of documents and of their tokens, segment by segment."""
    at = 0
    while at < len(content):
        magic, docs, tokens, blocks, size = _HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += _HEAD.size
        present = np.frombuffer(content, np.uint8, docs, at)
        at += docs
        names = np.frombuffer(content, "<i8", docs, at)
        at += 8 * docs
        lengths = np.frombuffer(content, "<u4", docs, at)
        at += 4 * docs
        starts = np.frombuffer(content, "<u4", blocks, at)
        at += 4 * blocks
        flat = unpack_blocks(content[at: at + size], starts, tokens)
        at += size + 1  # the closing line feed
        ends = np.cumsum(lengths.astype(np.int64))
        yield ([int(d) if p else None for d, p in zip(names, present)],
               np.split(flat, ends[:-1]) if docs else [])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, cut: str = "word",
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts and write their ids, an end id after each, in ascending order of id.

    A null text is empty and has the end id alone; null ids come first; rows with the same id
    follow each other. An empty table makes an empty folder. Other columns are not read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, cut).encode
        names, ids, size = [], [], 0
        for batch in batches:
            for name, missing, done in zip(batch["id"], batch["missing"], encode(batch["text"])):
                ids.append(done + end)
                names.append(None if missing else int(name))
                size += len(ids[-1]) // 4
                if size >= SEGMENT_TOKENS:
                    yield pd.DataFrame({"segment": [write_segment(names, ids)]})
                    names, ids, size = [], [], 0
        if ids:
            yield pd.DataFrame({"segment": [write_segment(names, ids)]})

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.col(id_col).isNull().alias("missing"), F.col(text_col).alias("text"),
    )
    order = [F.col("missing").desc(), F.col("id")]
    # Dealt before encoding: the sampling for the ranges then reads rows, it does not encode them.
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (dealt.mapInPandas(segments, "segment binary")
        .select(F.col("segment").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", FILE_SEGMENTS).option("lineSep", "\n").text(path))


def _segment_tokens(content: bytes) -> int:
    """Tokens in a file, from the heads of its segments alone."""
    at = tokens = 0
    while at < len(content):
        _, docs, n, blocks, size = _HEAD.unpack_from(content, at)
        at += _HEAD.size + 13 * docs + 4 * blocks + size + 1
        tokens += n
    return tokens


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers), and with `with_ids` the ids."""
    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "n": [_segment_tokens(c) for c in batch["content"]]})

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                before = 0
                for names, ids in read_segments(content):
                    lengths = np.array([len(x) for x in ids], dtype=np.int64)
                    out = {
                        "path": file, "doc_id": pd.array(names, dtype="Int64"),
                        "before": before + np.cumsum(lengths) - lengths, "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                    }
                    if with_ids:
                        out["ids"] = [x.astype(np.int64) for x in ids]
                    yield pd.DataFrame(out)
                    before += int(lengths.sum())

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select("path", "content"))
    schema = "path string, doc_id long, before long, n_tokens long, ids_crc32 long"
    rows = files.mapInPandas(documents, schema + (", ids array<long>" if with_ids else ""))
    # One row per file: the running total over the files sees no document. Files of one task are
    # told apart by the counter before the ending.
    place = Window.orderBy(
        F.regexp_extract("path", r"part-(\d+)-", 1).cast("long"),
        F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).cast("long"),
    ).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.mapInPandas(sizes, "path string, n long").select(
        "path", F.coalesce(F.sum("n").over(place), F.lit(0)).alias("first"))
    return rows.join(starts, "path").withColumn("start", F.col("first") + F.col("before")).select(
        "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
