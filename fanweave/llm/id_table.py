"""Ids of many short byte strings at once.

Texts fall into short strings (words) that recur. ``IdTable`` finds the strings of a whole batch by
hash in an open-addressing table of numpy arrays and gathers their ids; only strings it has not seen
are handed, once, to the slow encoder. The hash, the length and the first eight bytes only point at a
string; its further bytes are compared, eight at a time, with those that the table keeps. Strings that
share all three with another one are encoded each time they come. The table is bounded: when it is
full it starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HEAD_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class IdTable:
    def __init__(self, solve: Callable[[list[bytes]], list[np.ndarray]], bits: int = 20):
        self.solve, self.bits = solve, bits
        self.up = self.down = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.slot = np.full(n, -1, np.int32)             # number of the string, or free
        most = n // 2
        self.hash = np.zeros(most, np.uint64)
        self.head = np.zeros(most, np.uint64)
        self.size = np.zeros(most, np.int32)
        self.count = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(most + 1, np.int64)           # ids of string k: at[k] to at[k + 1]
        self.pool = np.zeros((1 << 16) + 8, np.uint8)    # bytes of the strings of over eight
        self.begin = np.zeros(most, np.int64)            # where a string's own begin
        self.used = 0

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            both = []
            for base in (_BASE, _BASE_INVERSE):
                p = np.full(n + n // 4, base, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            self.up, self.down = both

    def _find(self, h: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of every string, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int32)
        mask = np.int64((1 << self.bits) - 1)
        place = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            k = self.slot[place]
            same = (self.hash[k] == h[todo]) & (k >= 0)
            same &= (self.head[k] == head[todo]) & (self.size[k] == size[todo])
            out[todo[same]] = k[same]
            on = (k >= 0) & ~same
            todo, place = todo[on], (place[on] + 1) & mask
        return out

    def _differ(self, number: np.ndarray, raw: np.ndarray, start: np.ndarray,
                size: np.ndarray) -> np.ndarray:
        """Which strings are not, byte for byte, those that the table has under their numbers."""
        todo = np.flatnonzero((size > 8) & (number >= 0))
        wrong = []
        for done in range(8, 264, 8):
            if not len(todo):
                break
            mine = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))[start[todo] + done]
            kept = np.ndarray((len(self.pool) - 7,), "<u8", self.pool, strides=(1,))[
                self.begin[number[todo]] + done]
            unlike = ((mine ^ kept) & _HEAD_MASKS[np.minimum(size[todo] - done, 8)]) != 0
            wrong.append(todo[unlike])
            todo = todo[~unlike & (size[todo] > done + 8)]
        for i in todo.tolist():                          # the few very long ones
            b, a, n = self.begin[number[i]], start[i], size[i]
            if not np.array_equal(self.pool[b:b + n], raw[a:a + n]):
                wrong.append(np.array([i]))
        return np.concatenate(wrong) if wrong else todo

    def _keep(self, strings: list[bytes], first: int) -> None:
        """Store the bytes of the strings that the first eight do not tell."""
        for k, t in enumerate(strings, first):
            if len(t) > 8:
                end = self.used + len(t)
                if end + 8 > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros(end, np.uint8)])
                self.pool[self.used:end] = np.frombuffer(t, np.uint8)
                self.begin[k], self.used = self.used, end

    def _insert(self, h: np.ndarray, head: np.ndarray, size: np.ndarray,
                ids: list[np.ndarray]) -> None:
        n, first = len(h), self.count
        self.hash[first:first + n], self.head[first:first + n] = h, head
        self.size[first:first + n] = size
        ends = self.at[first] + np.cumsum([len(x) for x in ids])
        self.at[first + 1:first + n + 1] = ends
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(int(ends[-1]), np.int32)])
        self.ids[self.at[first]:ends[-1]] = np.concatenate(ids)
        slot, mask = self.slot, (1 << self.bits) - 1
        for k, p in enumerate((h >> np.uint64(64 - self.bits)).tolist(), first):
            while slot[p] >= 0:
                p = (p + 1) & mask
            slot[p] = k
        self.count += n

    def lookup(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray):
        """(ids, offsets): ids of the strings raw[start:stop], put together, and where each one's
        begin. ``raw`` ends in eight spare bytes."""
        n = len(raw) - 8
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw[:n].astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[stop] - sums[start]) * self.down[start]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        h *= _MIX
        size = (stop - start).astype(np.int32)
        eight = np.ndarray((n + 1,), "<u8", raw, strides=(1,))
        head = eight[start] & _HEAD_MASKS[np.minimum(size, 8)]
        number = self._find(h, head, size)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            _, one = np.unique(h[missing], return_index=True)
            new = missing[one]
            if self.count + len(new) > len(self.hash):
                self._clear()
                if len(new) > len(self.hash):
                    self.bits += 1
                    self._clear()
                return self.lookup(raw, start, stop)
            data = raw.tobytes()
            strings = [data[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist())]
            self._keep(strings, self.count)
            self._insert(h[new], head[new], size[new], self.solve(strings))
            number[missing] = self._find(h[missing], head[missing], size[missing])
            if (number < 0).any():                       # two strings of one hash
                return self.lookup(raw, start, stop)
        begin, length = self.at[number], self.at[number + 1] - self.at[number]
        known = self.ids
        other = self._differ(number, raw, start, size)
        if len(other):
            data = raw.tobytes()
            found = self.solve([data[a:b] for a, b in zip(start[other].tolist(),
                                                          stop[other].tolist())])
            length[other] = [len(x) for x in found]
            begin[other] = len(known) + np.cumsum(length[other]) - length[other]
            known = np.concatenate([known, *found])
        offsets = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(begin - offsets[:-1], length)
        at += np.arange(offsets[-1])
        return known[at], offsets
