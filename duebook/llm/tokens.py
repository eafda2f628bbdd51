"""Token ids of texts, by files of the tokenizers library.

Encoding a text in one go spends most of its time on words met before. Both vocabularies here
never join bytes across certain boundaries, so a text is cut there, each distinct piece is
encoded by the library once, and the ids of the pieces are joined. Cutting, finding distinct pieces
and joining are done by Arrow and numpy over many texts at a time; only pieces that are new to the
worker become Python strings. The strings of added tokens, such as <|endoftext|>, are one id each, as
in the library; a text is split at them first.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from duebook.llm.caches import remembered

#: Bytes of the parts of words, and their ids, that a worker remembers. Those met first are kept, which
#: the frequent ones are among; others are encoded each time, so memory is bounded.
PART_BYTES = 8 << 20
#: Parts given to the library at a time, and those that make one string of it.
BATCH_PARTS, JOINED_PARTS = 8192, 64
#: Characters of text encoded together.
CHUNK_CHARS = 4_000_000

#: Where a text may be cut without changing its ids.
#: "word": the vocabulary drops white space and never joins across it.
#: "space": a blank before a visible character opens a new piece and belongs to it.
CUTS = {"word": re.compile(r"[\x20\x09-\x0D]+"), "space": re.compile(r"(?= \S)")}
# A blank that is last or before other white space; texts that have one are cut by CUTS, others at
# every blank.
_ODD_BLANK = (r" ([\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
              r"\x{205f}\x{3000}]|\z)")

# Both pre-tokenizers end a piece between one of these letters or digits and one of these marks (all
# of ASCII but the apostrophe), either way round: none of the marks starts a contraction, and none of
# the letters gains a combining mark when the text is normalised. A single line end is a piece too. Parts that are left
# together cost time only.
_LETTER, _MARK, _VISIBLE = "[0-9A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]", "[!-~À-ÖØ-öø-ÿ]"
_PARTS = [(f"({_LETTER})({_MARK})", "\\1{0}\\2"), (f"({_MARK})({_LETTER})", "\\1{0}\\2"),
          (f"({_VISIBLE})\n({_VISIBLE})", "\\1{0}\n{0}\\2")]

#: Vocabularies of lower case: A-Z may be lowered first, so that fewer parts are distinct.
LOWER = {"word": True, "space": False}


def _joined(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of the given codes one after the other, and the edges between them. An item is
    `sizes[code]` values of `flat`."""
    counts = sizes[codes]
    ends = np.cumsum(counts)
    first = np.cumsum(sizes) - sizes
    places = np.repeat(first[codes] - (ends - counts), counts) + np.arange(int(counts.sum()))
    return flat[places], np.append(0, ends)


class _Known:
    """Parts and their ids in flat arrays, up to PART_BYTES."""

    def __init__(self) -> None:
        self.parts = pa.array([], pa.string())
        self.flat, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self.bytes = 0

    def keep(self, parts: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The first of these, as far as there is room."""
        taken = self.bytes + np.cumsum(pc.binary_length(parts).to_numpy() + 4 * sizes + 12)
        n = int(np.searchsorted(taken, PART_BYTES, side="right"))
        if n:
            self.bytes = int(taken[n - 1])
            self.parts = pa.concat_arrays([self.parts, parts[:n]])
            self.flat = np.concatenate([self.flat, flat[: int(sizes[:n].sum())]])
            self.sizes = np.concatenate([self.sizes, sizes[:n]])


class TextEncoder:
    """encode(texts): the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core already
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = self._tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: an added token that takes in more than its own string")
        self._added = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self._at_added = re.compile("({})".format("|".join(  # the longest, as the library does
            re.escape(c) for c in sorted(self._added, key=len, reverse=True))))
        # An added token that no other overlaps; between two parts it keeps them apart.
        heads = {c[0] for c in self._added}
        self._border = next((t.content for t in added.values()
                             if not any(h in c[1:] for h in heads for c in self._added)), None)
        self._cut, self._lower, self._blank = CUTS[cut], LOWER[cut], cut == "space"
        self._known = _Known()

    def encode(self, texts: Iterable[str | None], at_a_time: int | None = None) -> Iterator[bytes]:
        held, chars, most = [], 0, at_a_time or CHUNK_CHARS
        for text in texts:
            held.append(text or "")
            chars += len(text or "")
            if chars > most:
                yield from self._encoded(held)
                held, chars = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """What lies between added tokens is encoded like a text of its own."""
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self._added)]
        if not marked:
            return self._between(texts)
        split = [self._at_added.split(texts[i]) for i in marked]
        whole = list(texts)
        for i in marked:
            whole[i] = ""
        done = self._between(whole + [t for some in split for t in some[::2]])
        at = len(texts)
        for i, some in zip(marked, split):
            ids = [self._added.get(t, b"") for t in some]
            ids[::2] = done[at: at + len(ids[::2])]
            at += len(ids[::2])
            done[i] = b"".join(ids)
        return done[: len(texts)]

    def _between(self, texts: list[str]) -> list[bytes]:
        """Texts are cut and their distinct words found; each word's ids are copied to its places."""
        if not texts:
            return []
        rows = pa.array(texts, pa.string())
        if self._blank:
            odd = np.flatnonzero(pc.match_substring_regex(rows, _ODD_BLANK).to_numpy(zero_copy_only=False))
            pieces = pc.split_pattern(rows, " ")
        else:
            odd = ()
            pieces = pc.ascii_split_whitespace(pc.ascii_lower(rows) if self._lower else rows)
        coded = pieces.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        starts = pieces.offsets.to_numpy()
        if self._blank:  # all but a text's first piece have the blank before them
            opening = words.take(pa.array(codes[starts[:-1]]))
            codes = codes.copy()
            codes[starts[:-1]] = len(words) + np.arange(len(texts))
            words = pa.concat_arrays([pc.binary_join_element_wise("", words, " "), opening])
        out, edges = _joined(*self._ids(words), codes)
        edges = edges[starts]
        done = [out[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
        for i in odd:  # more blanks than one between words
            done[i] = self._ids(pa.array(self._cut.split(texts[i]), pa.string()))[0].tobytes()
        return done

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and each word's number of ids."""
        edge = "\x00"  # a string that no word has
        while pc.any(pc.match_substring(words, edge)).as_py():
            edge += "\x01"
        for pattern, cut in _PARTS:
            words = pc.replace_substring_regex(words, pattern, cut.format(edge))
        parts = pc.split_pattern(words, edge)
        coded = parts.flatten().dictionary_encode()
        flat, edges = _joined(*self._ids_of_parts(coded.dictionary), coded.indices.to_numpy())
        return flat, np.diff(edges[parts.offsets.to_numpy()])

    def _by_library(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As of words, by the tokenizers library. Many parts go to it as one string, since each result
        costs as much as a short part."""
        border, some = self._border, parts.to_pylist()
        whole = border is None or pc.any(pc.match_substring(parts, border)).as_py()
        if not whole:
            some = [border.join((*some[i: i + JOINED_PARTS], "")) for i in range(0, len(some), JOINED_PARTS)]
        done = [d.ids for d in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        sizes = np.fromiter(map(len, done), np.int64, len(done))
        flat = np.fromiter(chain.from_iterable(done), "<u4", int(sizes.sum()))
        if whole:
            return flat, sizes
        ends = flat == np.frombuffer(self._added[border], "<u4")[0]
        return flat[~ends], np.diff(np.append(-1, np.flatnonzero(ends))) - 1

    def _ids_of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As of words, for distinct parts."""
        known = self._known
        at = pc.fill_null(pc.index_in(parts, value_set=known.parts), -1).to_numpy().copy()
        fresh = np.flatnonzero(at < 0)
        new = parts.take(pa.array(fresh))
        flats, sizes = [known.flat], [known.sizes]
        for low in range(0, len(new), BATCH_PARTS):
            ids, counts = self._by_library(new[low: low + BATCH_PARTS])
            flats.append(ids)
            sizes.append(counts)
        at[fresh] = len(known.sizes) + np.arange(len(fresh))
        flat, size = np.concatenate(flats), np.concatenate(sizes)
        if len(fresh):
            known.keep(new, flat[len(known.flat):], size[len(known.sizes):])
        out, edges = _joined(flat, size, at)
        return out, np.diff(edges)


def encoder(path: str, cut: str) -> TextEncoder:
    """One per worker process and file."""
    return remembered(("encoder", path, cut), lambda: TextEncoder(path, cut))
