"""Exact, cached encoding with a file of the ``tokenizers`` library.

Texts are cut, in numpy over their UTF-8 bytes, where the pre-tokenizers used
here always cut: before white space that follows a visible character, after a
lone white space that is not a blank, and between a letter and the ASCII
punctuation after it. Characters whose kind the bytes don't tell at once are
never cut at. A text therefore encodes as the concatenation of its chunks'
encodings, and chunks repeat: those of a batch are counted out by Arrow's
dictionary encoding, each worker keeps the ids of those that it has met, and
only new ones go through the tokenizer, all of a batch in one call.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

#: Kinds of bytes, as bits of a table.
BLANK, OTHER_SPACE, LETTER, MARK, SOLID, LATIN, WIDE = (1 << k for k in range(7))
SPACE = BLANK | OTHER_SPACE
#: Bytes of text whose cuts are found at once, and chunks that are looked up at once.
SEGMENT, CHUNKS = 1 << 21, 1 << 19


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[0x20] = BLANK
    kinds[0x09:0x0E] = OTHER_SPACE
    kinds[0x21:0x7F] = SOLID
    for c in range(0x21, 0x7F):
        if chr(c).isalpha():
            kinds[c] |= LETTER
        elif not chr(c).isdigit() and chr(c) not in "_|":  # a special token may hold a | after a letter
            kinds[c] |= MARK
    kinds[0xC3:0xE0] = WIDE  # these lead two bytes that are no white space
    kinds[[*range(0xC3, 0xCA), 0xD0, 0xD1]] |= LATIN  # and these a letter, but for NO_LETTERS
    return kinds


KINDS = _kinds()
#: The signs for multiplication and division; I with a dot, whose lower case ends in a combining mark; the Cyrillic thousands sign and marks.
NO_LETTERS = np.array([0xC397, 0xC3B7, 0xC4B0, *range(0xD282, 0xD28A)], dtype=np.uint16)


def find_cuts(data: np.ndarray, drop_space: bool) -> np.ndarray:
    """Positions in the bytes ``data`` of one or more whole texts, not counting their own starts, where a chunk may start.

    With ``drop_space`` white space always parts chunks, and cuts are only those after it and those before punctuation.
    """
    out = [np.empty(0, dtype=np.int64)]
    for lo in range(0, len(data), SEGMENT):
        at = max(lo - 2, 0)  # what a byte is may show two bytes before it
        part = data[at : lo + SEGMENT]
        kind = KINDS[part]
        space = (kind & SPACE) != 0
        second = np.zeros(len(part), dtype=bool)  # of two bytes that are a letter, in lower case too
        second[1:] = ((kind[:-1] & LATIN) != 0) & ~np.isin(part[:-1].astype(np.uint16) << 8 | part[1:], NO_LETTERS)
        cut = np.zeros(len(part), dtype=bool)
        cut[1:] = (((kind[:-1] & LETTER) != 0) | second[:-1]) & ((kind[1:] & MARK) != 0)
        if drop_space:
            cut[1:] |= space[:-1] & ~space[1:]
        else:
            solid = (kind & SOLID) != 0  # the last byte of a visible character
            solid[1:] |= (kind[:-1] & WIDE) != 0
            cut[1:] |= solid[:-1] & space[1:]
            cut[2:] |= solid[:-2] & ((kind[1:-1] & OTHER_SPACE) != 0) & ((kind[2:] & (SOLID | WIDE)) != 0)
        out.append(np.flatnonzero(cut[lo - at :]) + lo)
    return np.concatenate(out)


def marked(size: int, *positions: np.ndarray) -> np.ndarray:
    """The positions, from 0 to ``size``, in order and each once."""
    seen = np.zeros(size + 1, dtype=bool)
    for p in positions:
        seen[p] = True
    return np.flatnonzero(seen)


class CachedEncoder:
    """Texts to little-endian unsigned 32-bit ids; at most ``limit`` chunks are remembered."""

    def __init__(self, path: str, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A tokenizer that lower-cases and drops white space sees the same in all spellings of a chunk.
        self.folds = "Lowercase" in str(self.tokenizer.normalizer) and "behavior=Removed" in str(self.tokenizer.pre_tokenizer)
        # Between separators a chunk encodes alike: white space parts words, and the mark's id is in no chunk that is joined.
        self.between = " | " if self.folds else "\n"
        sure = self.folds or str(self.tokenizer.pre_tokenizer) == "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)" and self.tokenizer.normalizer is None
        mark = self.tokenizer.encode(f"a{self.between}b", add_special_tokens=False).ids
        self.mark = mark[1] if sure and len(mark) == 3 else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.limit = limit

    def _joins(self, chunk: str) -> bool:
        """Whether ``chunk`` encodes alike between separators."""
        if self.folds:
            return "|" not in chunk
        word = chunk.split()
        return len(word) == 1 and (len(word[0]) == len(chunk) or chunk[0] == " " and len(word[0]) == len(chunk) - 1)

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of ``chunks``: as one text with separators, whose id parts them, where that is sure, and as a list elsewhere."""
        texts = [c.decode() for c in chunks]
        joins = [self.mark is not None and self._joins(t) for t in texts]
        together = [t for t, j in zip(texts, joins) if j]
        if together:
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(together)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(together) - 1:
                raw = ids.tobytes()
                first = iter([raw[4 * a : 4 * b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)])])
                if len(together) == len(texts):
                    return list(first)
                rest = iter(self._learn_list([t for t, j in zip(texts, joins) if not j]))
                return [next(first if j else rest) for j in joins]
        return self._learn_list(texts)

    def _learn_list(self, chunks: list[str]) -> list[bytes]:
        e = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(e.ids, dtype="<u4").tobytes()
        at = (4 * np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(chunks) + 1))).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        data = text.encode()
        if not self.folds or "<|" in text:  # a special token is told by its case
            return data
        low = data.lower()  # A-Z only
        # Composition comes before lower case: where the order may matter the text is left as it is.
        return low if text.isascii() or is_normalized("NFC", text) and is_normalized("NFC", low.decode()) else data

    def _lookup(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct ``chunks``. Those met since the last change of generations outlive the next one."""
        found = list(map(self.known.get, chunks))
        missed = [k for k, x in enumerate(found) if x is None]
        if missed:
            for k in missed:
                found[k] = self.older.get(chunks[k])
            new = [k for k in missed if found[k] is None]
            if new:
                for k, ids in zip(new, self._learn([chunks[k] for k in new])):
                    found[k] = ids
            keep = [k for k in missed if len(chunks[k]) <= 64]
            self.known.update(zip([chunks[k] for k in keep], [found[k] for k in keep]))
            if len(self.known) > self.limit // 2:
                self.older, self.known = self.known, {}
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of ``text`` (null: none) as bytes."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text; what none has met before is learned in one call."""
        own = [self._bytes(t) for t in texts]
        ends = np.cumsum([0, *map(len, own)])
        data = np.frombuffer(b"".join(own), dtype=np.uint8)
        cuts = marked(len(data), find_cuts(data, self.folds), ends)
        if self.folds:
            keep = (KINDS[data] & SPACE) == 0
            before = np.concatenate(([0], np.cumsum(keep)))  # bytes kept
            data, cuts, ends = data[keep], marked(before[-1], before[cuts]), before[ends]
        values, out, counts = pa.py_buffer(data), [], [np.zeros(1, dtype=np.int64)]
        for lo in range(0, len(cuts) - 1, CHUNKS):
            bounds = cuts[lo : lo + CHUNKS + 1]
            coded = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), values]).dictionary_encode()
            _, offsets, distinct = coded.dictionary.buffers()
            at, distinct = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1].tolist(), distinct.to_pybytes()
            ids = self._lookup([distinct[a:b] for a, b in zip(at, at[1:])])
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            which = coded.indices.to_numpy()
            n = size[which]
            shift = (np.cumsum(size) - size)[which] - (np.cumsum(n) - n)
            out.append(np.frombuffer(b"".join(ids), dtype="<u4")[np.repeat(shift, n) + np.arange(n.sum())].tobytes())
            counts.append(n)
        at = (4 * np.cumsum(np.concatenate(counts)))[np.searchsorted(cuts, ends)].tolist()
        found = b"".join(out)
        return [found[a:b] for a, b in zip(at, at[1:])]

    def encode_column(self, *columns: pa.Array, chars: int = 1_000_000) -> Iterator[tuple]:
        """Rows of ``columns``, the last replaced by its ids; texts are taken together up to ``chars``."""
        rows, size = [], 0
        for row in zip(*columns):
            row = [x.as_py() for x in row]
            rows.append(row)
            size += len(row[-1] or "")
            if size >= chars:
                yield from ((*r[:-1], ids) for r, ids in zip(rows, self.encode_many([r[-1] for r in rows])))
                rows, size = [], 0
        yield from ((*r[:-1], ids) for r, ids in zip(rows, self.encode_many([r[-1] for r in rows])))


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """This worker's encoder for ``path``; its memory lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]
