"""Token ids of text columns, by the tokenizers library and a byte-level BPE file.

Byte-level BPE never joins a word with the white space after it. So a text is cut before
each run of white space, every distinct piece is encoded by the library once, and the ids
of a text are gathered from its pieces. The table of pieces lives in the Python worker and
is emptied at a fixed number of entries. Texts with other white space than ASCII's, where
those cuts are not safe, are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from corvida.llm import words

MOST_PIECES = 2_000_000
_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
_PIECE_BYTES = 3_000_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes pieces of an Arrow text column; keeps what it has encoded. If ``plain``, the strings of special tokens are plain text."""

    def __init__(self, path: str, most: int = MOST_PIECES, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = plain
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self._empty()

    def _empty(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and the n + 1 offsets of the rows in them."""
        odd = np.zeros(len(offsets) - 1, bool)
        for m in _ODD_SPACE.finditer(data):
            odd[np.searchsorted(offsets, m.start(), "right") - 1] = True
        start, end, first = words.spans(data, offsets)
        begin = np.concatenate([[0], end])[: len(end)]
        full = np.flatnonzero(first[1:] > first[:-1])
        begin[first[full]] = offsets[full]
        # white space at the end of a row, or all of it, is a piece of its own
        last = offsets[:-1].copy()
        last[full] = end[first[full + 1] - 1]
        tail = np.flatnonzero(offsets[1:] > last)
        row = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(first)), tail])
        key = np.concatenate([self._keys(data, begin, start, end), self._keys(data, last[tail], offsets[tail + 1], offsets[tail + 1])])
        begin, end = np.concatenate([begin, last[tail]]), np.concatenate([end, offsets[tail + 1]])
        if len(tail):
            order = np.argsort(begin, kind="stable")
            row, key, begin, end = row[order], key[order], begin[order], end[order]
        if odd.any():
            keep = ~odd[row]
            row, key, begin, end = row[keep], key[keep], begin[keep], end[keep]
        distinct = words.distinct(key)
        which = np.searchsorted(distinct, key)
        seen = np.zeros(len(distinct), np.int64)
        seen[which] = np.arange(len(key))
        where = self._learn(distinct, seen, data, begin, end)
        size = self.size[where][which]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[where][which] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]
        count = np.bincount(row, size, len(offsets) - 1).astype(np.int64)
        if odd.any():
            return self._with_whole(ids, count, np.flatnonzero(odd), data, offsets)
        return ids, np.concatenate([[0], np.cumsum(count)])

    def _keys(self, data: np.ndarray, begin: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each piece: the white space [begin, start) and the word [start, end)."""
        out = np.zeros(len(begin), np.uint64)
        word = np.flatnonzero(end > start)
        if len(word):
            out[word] = words.hashed(data, start[word], end[word])
        gap = start - begin
        one, more = np.flatnonzero(gap == 1), np.flatnonzero(gap > 1)
        out[one] += data[begin[one]].astype(np.uint64) + np.uint64(1)
        if len(more):
            out[more] += words.mix(words.hashed(data, begin[more], start[more]))
        return words.mix(out)

    def _learn(self, distinct: np.ndarray, seen: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the pieces are in the table; those it has not yet are encoded first."""
        where = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == distinct[inside]
        if known.all():
            return where
        if len(self.keys) + (~known).sum() > self.most and len(self.keys):
            self._empty()
            return self._learn(distinct, seen, data, begin, end)
        new = np.flatnonzero(~known)
        raw = [data[b:e].tobytes() for b, e in zip(begin[seen[new]].tolist(), end[seen[new]].tolist(), strict=True)]
        lead = words.SPACES[data[begin[seen[new]]]] & ~words.SPACES[data[end[seen[new]] - 1]]
        ids: list[np.ndarray | None] = [None] * len(raw)
        joint, alone = np.flatnonzero(lead), np.flatnonzero(~lead).tolist()
        for part in np.array_split(joint, max(1, len(joint) // 20_000)):
            if not self._joined([raw[i] for i in part.tolist()], part.tolist(), ids):
                alone += part.tolist()
        if alone:
            got = self.tokenizer.encode_batch_fast([raw[i].decode("utf-8", "replace") for i in alone], add_special_tokens=False)
            for i, e in zip(alone, got, strict=True):
                ids[i] = np.array(e.ids, np.uint32)
        size = np.array([len(x) for x in ids], np.int64)
        total = int(size.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), total), np.uint32)])
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        at = self.used + np.cumsum(size) - size
        self.used += total
        self.keys = np.insert(self.keys, where[new], distinct[new])
        self.at = np.insert(self.at, where[new], at)
        self.size = np.insert(self.size, where[new], size)
        return np.searchsorted(self.keys, distinct)

    def _joined(self, raw: list[bytes], where: list[int], ids: list) -> bool:
        """Encodes pieces that begin with white space as one text, cut again by the bytes of its ids."""
        if not raw:
            return True
        try:
            got = np.array(self.tokenizer.encode_batch_fast([b"".join(raw).decode()], add_special_tokens=False)[0].ids, np.uint32)
        except UnicodeDecodeError:
            return False
        ends = np.cumsum([len(x) for x in raw])
        cuts = np.searchsorted(np.cumsum(self.width[got]), ends) + 1
        for i, x in zip(where, np.split(got, cuts[:-1]), strict=True):
            ids[i] = x
        return True

    def _with_whole(self, ids: np.ndarray, count: np.ndarray, odd: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts rows that must be encoded whole in their places."""
        parts, stop = [], np.concatenate([[0], np.cumsum(count)])
        at = 0
        for row in odd.tolist():
            text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
            got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            parts += [ids[at : stop[row]], got]
            at, count[row] = stop[row], len(got)
        parts.append(ids[at:])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(count)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder for a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches, path: str, text: str = "text"):
    """Yields (rows, ids, offsets of the rows in ids) over Arrow batches."""
    own = encoder(path)
    for batch in batches:
        for rows, data, offsets in words.pieces(batch, text, _PIECE_BYTES):
            yield rows, *own.encode(data, offsets)
