"""Elias-Fano coded monotone sequences in one flat buffer, which may be a memory map; all queries are vectorised."""

from __future__ import annotations

import numpy as np

_BLOCK = 4  #: 64-bit words for each entry of the rank directory
_HEAD = 8


_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_PAIRS, _FOURS, _BYTES = (np.uint64(0x0101010101010101 * k) for k in (0x55, 0x33, 0x0F))
#: Place of the k-th set bit of each byte, at 256 * k + byte.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8) for b in range(256)], np.int64)


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word: running sums of the bytes' ones, all compared with k at once, then a table."""
    k = k.astype(np.uint64)
    sums = word - (word >> np.uint64(1) & _PAIRS)
    sums = (sums & _FOURS) + (sums >> np.uint64(2) & _FOURS)
    sums = (sums + (sums >> np.uint64(4)) & _BYTES) * _ONES
    passed = ((k * _ONES | _TOPS) - sums & _TOPS) >> np.uint64(7)
    place = (passed * _ONES >> np.uint64(56)) << np.uint64(3)
    rest = k - (sums << np.uint64(8) >> place & np.uint64(0xFF))
    return place.astype(np.int64) + _IN_BYTE[(word >> place & np.uint64(0xFF)) | rest << np.uint64(8)]


class EliasFano:
    """``n`` values, never falling, below ``universe``. Low bits are packed, high parts are unary with a rank directory."""

    def __init__(self, buffer: np.ndarray):
        """``buffer``: uint64 words as made by :meth:`encode`."""
        self.n, self.bits, n_low, n_high, n_blocks, self.words, self.top = (int(x) for x in buffer[1:_HEAD])
        at = _HEAD
        low = buffer[at : at + n_low]
        self.low = np.ndarray((max(n_low * 8 - 7, 0),), "<u8", low.view(np.uint8), strides=(1,)) if n_low else None
        self.high = buffer[at + n_low : at + n_low + n_high]
        self.runs = np.ndarray((max(n_high * 8 - 7, 0),), "<u8", self.high.view(np.uint8), strides=(1,))
        at += n_low + n_high
        self.ones = buffer[at : at + n_blocks]
        self.zeros = np.arange(n_blocks, dtype=np.uint64) * np.uint64(64 * _BLOCK) - self.ones

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> np.ndarray:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2 if bits else 0, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift + np.uint64(bits)) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = int(universe) >> bits
        size = -(-(n + top + 2) // (64 * _BLOCK)) * _BLOCK
        high = np.zeros(size, np.uint64)
        at = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        np.bitwise_or.at(high, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        counts = np.bitwise_count(high).reshape(-1, _BLOCK).sum(1, dtype=np.uint64)
        ones = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts)[:-1].astype(np.uint64)])
        words = _HEAD + len(low) + len(high) + len(ones)
        head = np.array([words, n, bits, len(low), len(high), len(ones), words, top], np.uint64)
        return np.concatenate([head, low, high, ones])

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        directory = self.ones if ones else self.zeros
        block = np.searchsorted(directory, k.astype(np.uint64), "right") - 1
        k = k - directory[block].astype(np.int64)
        word = block * _BLOCK
        for _ in range(_BLOCK - 1):
            bits = self.high[word]
            count = np.bitwise_count(bits).astype(np.int64)
            count = count if ones else 64 - count
            on = k >= count
            if not on.any():
                break
            k = k - count * on
            word = word + on
        bits = self.high[word]
        return word * 64 + select_in_word(bits if ones else ~bits, k)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.int64)
        bit = at * self.bits
        return ((self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, True) - at) << self.bits) | self._low(at)

    def _bucket(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the elements with a high part: one select, then the run of ones behind it."""
        bit = np.where(part > 0, self._select(np.maximum(part - 1, 0), False) + 1, 0)
        first = bit - part
        at = np.minimum(bit >> 3, len(self.runs) - 1)
        run = self.runs[at] >> (bit - (at << 3)).astype(np.uint64)
        # trailing ones: below the lowest zero
        ones = np.bitwise_count((~run & (run + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        last = first + ones
        far = np.flatnonzero((ones >= 56) | (bit - (at << 3) > 7))  # the run may go on
        if len(far):
            last[far] = self._select(part[far], False) - part[far]
        return first, last

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first element of the value's bucket that isn't smaller, end of the bucket)."""
        part = np.minimum(values >> self.bits, self.top)
        first, last = self._bucket(part)
        end = last.copy()
        if self.bits:
            low = values & ((1 << self.bits) - 1)
            live = np.flatnonzero(first < last)
            while len(live):
                mid = (first[live] + last[live]) >> 1
                less = self._low(mid) < low[live]
                first[live] = np.where(less, mid + 1, first[live])
                last[live] = np.where(less, last[live], mid)
                live = live[first[live] < last[live]]
        return first, end

    def find(self, values: np.ndarray) -> np.ndarray:
        """Successor search: the place of the first element that isn't smaller."""
        first, _ = self._search(values)
        return np.where(values >> self.bits > self.top, self.n, first)

    def index(self, values: np.ndarray) -> np.ndarray:
        """The place of the first element equal to each value, or -1: the successor, if it is in the bucket and its low bits agree."""
        first, end = self._search(values)
        ok = (first < end) & (values >> self.bits <= self.top)
        if self.bits:
            at = np.flatnonzero(ok)
            ok[at] = self._low(first[at]) == values[at] & ((1 << self.bits) - 1)
        return np.where(ok, first, -1)
