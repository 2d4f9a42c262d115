"""Words of many texts at once, as numpy arrays: where they lie and a 64-bit hash of each."""

from __future__ import annotations

import numpy as np

#: Bytes between words: ASCII white space (0x09-0x0D and 0x20).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words where punctuation counts as a gap: every ASCII byte but letters and digits.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: The first n bytes of a little-endian 8-byte load.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
LONG = 256  # longer words are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers under which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of the texts in one batch. ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, texts: list[bytes], gaps: np.ndarray = SPACE):
        joined = b"\n".join(texts) + b"\n" + bytes(8)
        self.buf = np.frombuffer(joined, np.uint8)
        gap = np.ones(len(joined) - 6, np.int8)
        gap[1:-1] = gaps[self.buf[:-8]]
        step = np.diff(gap)
        self.start, self.end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])  # where texts start
        self.first = np.searchsorted(self.start, self.at)
        self.length = self.end - self.start
        self.load = np.ndarray((len(joined) - 8,), "<u8", joined, strides=(1,))

    def prefix(self, n: int) -> np.ndarray:
        """The first n (at most 8) bytes of each word as an integer."""
        return self.load[self.start] & FIRST[np.minimum(self.length, n)]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word's bytes and length; hashes of two seeds are as two independent functions."""
        h = mix(mix(self.prefix(8) ^ np.uint64(seed * 0xA0761D6478BD642F & 2**64 - 1)) + self.length.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        left, at = np.flatnonzero((self.length > 8) & (self.length <= LONG)), 8
        while len(left):
            chunk = self.load[self.start[left] + at] & FIRST[np.minimum(self.length[left] - at, 8)]
            h[left] = mix(h[left] * np.uint64(3) + chunk)
            at += 8
            left = left[self.length[left] > at]
        if len(long := np.flatnonzero(self.length > LONG)):
            import xxhash

            raw = self.buf.tobytes()
            h[long] = [xxhash.xxh3_64_intdigest(raw[self.start[i] : self.end[i]], seed=seed) for i in long]
        return h


def per_text(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
