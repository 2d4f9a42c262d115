"""Whole-text encoding by the tokenizers library, with a bounded memo of pieces.

Both vocabularies used here split a text before merging, and no merge crosses a split. Encoding
the pieces one by one therefore gives the ids of the whole text, and pieces that recur are
encoded once per worker: a batch's words are found as arrays, looked up in a table by all their bytes, and their
ids gathered at once. Unknown pieces are encoded together, parted by a separator whose id
no piece can produce. Where pieces can't be told apart safely (white space runs, control
characters, the beginning of an added token's string), the whole text goes to the library as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from lumenfold.llm.words import FIRST, mix

MEMO_LIMIT = 500_000  # pieces a worker keeps, of about 60 bytes each
KEY_BYTES = 23  # a longer piece isn't kept
BATCH_BYTES = 1 << 20  # of texts that are encoded at once
BLOCK = 256  # unknown pieces that the library gets as one text
MARKS = ".,;:!?"
HARD = 1 << 62  # set in no piece's key

#: White space besides the space and the line's end, ASCII and other.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOUCHING = re.compile(r"\s\s|^\s|\s$")
#: Control characters on whose splitting the library and this module might differ, and the separator's own.
NO_SPLIT = "\x1c\x1d\x1e\x1f\x01"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def touching(t: str) -> bool:
    """White space touches other white space or an end. Searches for single characters are far quicker than one pattern."""
    if "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n":
        return True
    odd = any(c in t for c in OTHER_SPACE) or (not t.isascii() and any(c in t for c in WIDE_SPACE))
    return odd and bool(TOUCHING.search(t))


def no_split(t: str) -> bool:
    return any(c in t for c in NO_SPLIT)


def by_bytes(sizes: list[int], most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Runs of rows (from, to) of about ``most`` bytes."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            out.append((start, i + 1))
            start, total = i + 1, 0
    return [*out, (start, len(sizes))] if start < len(sizes) else out


def sliced(batch: pa.RecordBatch, name: str, most: int = BATCH_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of about ``most`` bytes of a column: of a batch, only so much is Python strings at a time."""
    column = batch.column(name)
    for at, to in by_bytes(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist(), most):
        yield at, column.slice(at, to - at).to_pylist()


class Memo:
    """Ids of pieces: an open-addressing table over three 64-bit words of key, and one array that holds all ids.

    Entry 0 has no ids and no key. Entries past ``n`` serve one batch and are then forgotten.
    """

    def __init__(self, dtype: np.dtype):
        self.n, self.end = 1, 0
        self.keys = np.zeros((3, 1024), np.uint64)
        self.keys[2, 0] = HARD
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.table, self.bits = np.zeros(4096, dtype), np.zeros(4096, np.int32), 12

    def _room(self, entries: int, ids: int) -> None:
        if entries > len(self.start):
            more = max(entries, 2 * len(self.start))
            wider = np.zeros((3, more), np.uint64)
            wider[:, : self.keys.shape[1]] = self.keys
            self.keys, self.start, self.size = wider, np.resize(self.start, more), np.resize(self.size, more)
        if ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(ids, 2 * len(self.ids)) - len(self.ids), self.ids.dtype)])

    @staticmethod
    def hash(keys: np.ndarray) -> np.ndarray:
        return mix(keys[0] * np.uint64(0xC2B2AE3D27D4EB4F) ^ mix(keys[1] + keys[2] * np.uint64(0x9E3779B97F4A7C15)))

    def find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key, 0 where there is none."""
        slot, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        entry = self.table[slot]
        left = np.flatnonzero(entry)
        while len(left):
            same = (self.keys[0, entry[left]] == keys[0, left]) & (self.keys[1, entry[left]] == keys[1, left]) & (self.keys[2, entry[left]] == keys[2, left])
            left = left[~same]
            slot[left] = (slot[left] + 1) & mask
            entry[left] = self.table[slot[left]]
            left = left[entry[left] != 0]
        return entry

    def _place(self, entries: np.ndarray, h: np.ndarray) -> None:
        slot, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(entries):
            free = self.table[slot] == 0
            self.table[slot[free]] = entries[free]
            left = self.table[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) & mask

    def put(self, ids: np.ndarray, sizes: np.ndarray, at: int, end: int) -> tuple[int, int]:
        """Writes entries from number ``at`` and their ids from place ``end``; returns where the next would go."""
        self._room(at + len(sizes), end + len(ids))
        self.ids[end : end + len(ids)] = ids
        self.start[at : at + len(sizes)] = end + np.cumsum(sizes) - sizes
        self.size[at : at + len(sizes)] = sizes
        return at + len(sizes), end + len(ids)

    def keep(self, keys: np.ndarray, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds different keys that aren't known; returns their entries."""
        first = self.n
        self.n, self.end = self.put(ids, sizes, self.n, self.end)
        self.keys[:, first : self.n] = keys
        if 2 * self.n > 1 << self.bits:
            self.bits = (4 * self.n).bit_length()
            self.table = np.zeros(1 << self.bits, np.int32)
            self._place(np.arange(1, self.n, dtype=np.int32), self.hash(self.keys[:, 1 : self.n]))
        else:
            self._place(np.arange(first, self.n, dtype=np.int32), h)
        return np.arange(first, self.n)


class PieceEncoder:
    """ids of texts (little-endian, ``width`` bytes an id), as the library gives them for whole texts without special tokens."""

    def __init__(self, path: str, kind: str, width: int = 4, limit: int = MEMO_LIMIT):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if (most := self.tok.get_vocab_size(with_added_tokens=True)) > 1 << 8 * width:
            raise ValueError(f"a vocabulary of {most} ids doesn't fit {width} bytes an id")
        self.kind, self.limit, self.dtype = kind, limit, np.dtype(f"<u{width}")
        self.memo = Memo(self.dtype)
        #: The library takes added tokens out of a text before it splits: texts that may hold one go to it whole.
        self.added = tuple(sorted({a.content[:2] for a in self.tok.get_added_tokens_decoder().values() if a.content}))
        gap = np.zeros(256, bool)
        if kind == "byte":
            # A space starts a new piece unless other white space touches it; a line's end is a piece of its own.
            gap[[0, 0x0A, 0x20]] = True
            self.unsafe, self.lead, self.sep = touching, " ", "\t"
        else:
            gap[[0, 0x20, *range(0x09, 0x0E)]] = True  # white space is dropped
            self.unsafe, self.lead, self.sep = no_split, "", " \x01 "
        self.gap = gap
        self.sep_id = self.tok.encode(self.sep, add_special_tokens=False).ids[0]
        # Marks and the line's end have the entries from 1.
        fixed = [np.array(x, self.dtype) for x in self._library([*MARKS, "\n"])]
        self.memo.n, self.memo.end = self.memo.put(np.concatenate(fixed), np.array([len(x) for x in fixed]), 1, 0)
        self.memo.keys[2, 1 : self.memo.n] = HARD
        self.mark = np.zeros(256, np.int64)
        self.mark[[ord(m) for m in MARKS]] = np.arange(1, len(MARKS) + 1)
        self.line = len(MARKS) + 1

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of pieces one after another, and how many each has."""
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), BLOCK):
            block = pieces[at : at + BLOCK]
            ids = np.array(self._library([self.sep.join(block)])[0], self.dtype)
            cuts = np.flatnonzero(ids == self.sep_id)
            if len(cuts) == len(block) - 1:
                flat.append(np.delete(ids, cuts))
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:  # a piece holds the separator's id
                each = self._library(block)
                flat.append(np.array([i for x in each for i in x], self.dtype))
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn_led(self, words: list[str], led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_learn`, for words some of which stand behind a space that is part of their piece. Pieces with and without one come apart, so that separators stay by themselves."""
        if not self.lead or led.all():
            return self._learn([self.lead + w for w in words])
        flat, sizes, order = [], [], []
        for on in (True, False):
            who = np.flatnonzero(led == on)
            ids, n = self._learn([(self.lead if on else "") + words[i] for i in who])
            flat.append(ids)
            sizes.append(n)
            order.append(who)
        flat, sizes, order = (np.concatenate(x) for x in (flat, sizes, order))
        back = np.argsort(order)
        return flat[_ranges((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def _entries(self, joined: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray, led: np.ndarray) -> np.ndarray:
        """The memo's entry of each word; words that are new are learned."""
        memo, size = self.memo, end - start
        load = np.ndarray((len(joined) - 8,), "<u8", joined, strides=(1,))
        part = lambda i, most: load[start + 8 * i] & FIRST[np.clip(size - 8 * i, 0, most)]
        keys = np.stack([part(0, 8), part(1, 8), part(2, 7) | led.astype(np.uint64) << np.uint64(63)])
        h = memo.hash(keys)
        entry = memo.find(keys, h).astype(np.int64)
        entry[size > KEY_BYTES] = 0
        miss = np.flatnonzero(entry == 0)
        if not len(miss):
            return entry
        short = miss[size[miss] <= KEY_BYTES]
        _, first, of = np.unique(h[short], return_index=True, return_inverse=True)
        head = short[first]
        clash = (keys[:, short] != keys[:, head[of]]).any(axis=0)  # the same hash, yet another word
        ids, n = self._learn_led([joined[s:e].decode() for s, e in zip(start[head].tolist(), end[head].tolist(), strict=True)], led[head])
        room = max(0, self.limit - memo.n)
        kept, cut = np.arange(len(head)) < room, int(n[:room].sum())
        got = np.zeros(len(head), np.int64)
        got[kept] = memo.keep(keys[:, head[kept]], h[head[kept]], ids[:cut], n[:room])
        # What has no room, clashes or is long serves this batch only.
        at, place = memo.put(ids[cut:], n[room:], memo.n, memo.end)
        got[~kept] = np.arange(memo.n, at)
        entry[short] = got[of]
        rest = np.concatenate([short[clash], miss[size[miss] > KEY_BYTES]])
        if len(rest):
            words = [(bool(x), joined[s:e]) for s, e, x in zip(start[rest].tolist(), end[rest].tolist(), led[rest].tolist(), strict=True)]
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            memo.put(*self._learn_led([w.decode() for _, w in number], np.array([x for x, _ in number])), at, place)
            entry[rest] = [at + number[w] for w in words]
        return entry

    def _words(self, texts: list[bytes], last: int | None) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\0" + b"\0".join(texts) + bytes(33)
        buf = np.frombuffer(joined, np.uint8)
        step = np.diff(self.gap[buf[:-31]].view(np.int8))
        start, end = np.flatnonzero(step == -1) + 1, np.flatnonzero(step == 1) + 1
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(start, at)
        lead = buf[start - 1]
        # Letters and a mark behind them never merge: the mark is a piece of its own.
        odd = np.concatenate([[0], np.cumsum(~_LETTER[buf], dtype=np.int64)])
        mark = self.mark[buf[end - 1]]
        mark[(end - start < 2) | (odd[end - 1] != odd[start])] = 0
        byte = self.kind == "byte"
        word = self._entries(joined, buf, start, end - (mark > 0), lead == 0x20 if byte else np.zeros(len(start), bool))
        line = np.where(lead == 0x0A, self.line, 0) if byte else np.zeros(len(start), np.int64)
        entry = np.stack([line, word, mark], axis=1).ravel()
        size = self.memo.size[entry].astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(size)])[first * 3]
        flat = self.memo.ids[_ranges(self.memo.start[entry], size)]
        if last is not None:
            flat = np.insert(flat, cut[1:], last)
            cut = cut + np.arange(len(cut))
        return flat, cut

    def flat(self, texts: list[str | None], last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another (each followed by ``last``, if given), and where each text starts, and the end. A null is an empty text."""
        whole = [i for i, t in enumerate(texts) if t and (self.unsafe(t) or "\0" in t or any(a in t for a in self.added))]
        of = dict(zip(whole, self._library([texts[i] for i in whole]), strict=True))
        flat, cut = self._words([b"" if i in of else (t or "").encode() for i, t in enumerate(texts)], last)
        if not of:
            return flat, cut
        parts, sizes, at = [], np.diff(cut), 0
        for i in whole:
            parts += [flat[at : cut[i]], np.array(of[i], self.dtype)]
            sizes[i] += len(of[i])
            at = cut[i]
        return np.concatenate([*parts, flat[at:]]), np.concatenate([[0], np.cumsum(sizes)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., of each range."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, kind: str, width: int = 4) -> PieceEncoder:
    """One encoder a worker process, kept between tasks."""
    if (key := (path, kind, width)) not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, kind, width)
    return _ENCODERS[key]


def forget() -> None:
    """Frees the memos of a worker that goes on to other work; workers are reused between stages."""
    _ENCODERS.clear()
