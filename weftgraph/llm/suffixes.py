"""Suffix sorting of a shard by external induction, with common-prefix values.

Symbols are compared from the left; the suffixes that start a left-most S run
(LMS) are ranked first, on a reduced string of their own; all others follow by
induction: sorted suffixes, taken in order, put their predecessors in order into
the queue of their first symbol.  The queue is a priority queue whose keys never
fall behind its head, so it is one file-backed FIFO per symbol.  Its entries carry
the position and the length of the prefix shared with the entry before (capped:
only "as long as the window" matters), which induction extends by one symbol over
the least value between the two sources.

Memory holds the symbols of a shard, the ranks of its LMS suffixes (a third of
them at most) and one block of the queue; the rest of the queue lies on disk
beyond ``memory`` bytes.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Symbols 0 and 1 end the shard and each of its pieces; bytes follow.
BYTE, SYMBOLS = 2, 258
BLOCK = 1 << 18
#: The longest prefix that is told apart; values are one more at most.
LONGEST = 2**31 - 2
ENTRY = np.dtype([("at", np.int32), ("shared", np.int32)])


class SymbolQueue:
    """FIFO of entries per symbol, the largest of them written to disk when memory is short."""

    def __init__(self, memory: int, folder: str | None = None):
        self.memory, self.held = memory, 0
        self.parts: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
        self.size, self.on_disk, self.read = [0] * SYMBOLS, [0] * SYMBOLS, [0] * SYMBOLS
        self.folder, self.made = folder, None

    def _path(self, symbol: int) -> str:
        if self.made is None:
            self.made = tempfile.mkdtemp(prefix="suffixes-", dir=self.folder)
        return os.path.join(self.made, str(symbol))

    def push(self, symbol: int, entries: np.ndarray) -> None:
        self.parts[symbol].append(entries)
        self.size[symbol] += len(entries)
        self.held += entries.nbytes
        while self.held > self.memory:
            self._spill(max(range(SYMBOLS), key=self.size.__getitem__))

    def _spill(self, symbol: int) -> None:
        entries = np.concatenate(self.parts[symbol])
        with open(self._path(symbol), "ab") as f:
            entries.tofile(f)
        self.on_disk[symbol] += len(entries)
        self.held -= entries.nbytes
        self.parts[symbol], self.size[symbol] = [], 0

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """Blocks of a symbol's entries, those pushed meanwhile too."""
        while True:
            if self.read[symbol] < self.on_disk[symbol]:
                n = min(BLOCK, self.on_disk[symbol] - self.read[symbol])
                block = np.fromfile(self._path(symbol), ENTRY, n, offset=self.read[symbol] * ENTRY.itemsize)
                self.read[symbol] += n
            elif self.parts[symbol]:
                block = np.concatenate(self.parts[symbol])
                self.parts[symbol], self.size[symbol] = [], 0
                self.held -= block.nbytes
                self.parts[symbol] += [block[k : k + BLOCK] for k in range(BLOCK, len(block), BLOCK)]
                block, rest = block[:BLOCK], block[BLOCK:]
                self.size[symbol] += len(rest)
                self.held += rest.nbytes
            else:
                return
            yield block

    def backwards(self, symbol: int) -> Iterator[np.ndarray]:
        """A filled symbol's blocks, last first, each reversed."""
        while self.parts[symbol]:
            block = self.parts[symbol].pop()
            self.size[symbol] -= len(block)
            self.held -= block.nbytes
            yield block[::-1]
        end = self.on_disk[symbol]
        while end:
            n = min(BLOCK, end)
            end -= n
            yield np.fromfile(self._path(symbol), ENTRY, n, offset=end * ENTRY.itemsize)[::-1]

    def close(self) -> None:
        if self.made:
            shutil.rmtree(self.made, ignore_errors=True)


def symbols_of(pieces: list[bytes]) -> np.ndarray:
    """Pieces as one string of symbols, each piece with its end mark."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out = np.ones(int(size.sum()) + len(pieces) + 1, np.int16)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(size + 1) - 1] = False
    inside[-1] = False
    out[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int16) + BYTE
    out[-1] = 0
    return out


class Sorter:
    """Suffix order of one string of symbols, as events on neighbours in that order."""

    def __init__(self, text: np.ndarray, cap: int, memory: int = 256 << 20, folder: str | None = None):
        self.text, self.cap, self.memory, self.folder = text, min(cap, LONGEST), memory, folder
        n = len(text)
        later = np.sign(np.diff(text.astype(np.int16), append=np.int16(-1)))  # 1: rises to the next, -1: falls
        # Equal neighbours share the type of the next that differs.
        where = np.where(later != 0, np.arange(n), n)
        nxt = np.minimum.accumulate(where[::-1])[::-1]
        self.small = later[nxt] > 0
        self.small[-1] = True
        self.run = np.minimum(nxt - np.arange(n) + 1, LONGEST + 1).astype(np.int32)
        self.lms = np.flatnonzero(self.small & ~np.r_[True, self.small[:-1]])

    # -- induction ---------------------------------------------------------

    def _feed(self, queue: SymbolQueue, least: np.ndarray, symbol: int, entries: np.ndarray, falling: bool) -> None:
        """Put the predecessors of some sorted suffixes into the queue.

        ``least`` holds, per target symbol, the least shared prefix among the
        sources since the last one that went there.
        """
        at, shared = entries["at"], entries["shared"]
        before = at - 1
        target = np.where(before >= 0, self.text[before], -1)
        own = self.small[before]
        good = (before >= 0) & (~own if not falling else own)
        good &= (target >= symbol) if not falling else (target <= symbol)
        idx = np.flatnonzero(good)
        rest = np.minimum.accumulate(np.r_[shared, np.int32(LONGEST + 1)][::-1])[::-1]  # least of each tail
        if len(idx):
            order = np.argsort(target[idx], kind="stable")
            idx = idx[order]
            to = target[idx]
            head = np.r_[True, to[1:] != to[:-1]]
            low = np.r_[0, idx[:-1] + 1]
            low[head] = 0
            bounds = np.column_stack([low, idx + 1]).ravel()
            value = np.minimum.reduceat(np.r_[shared, np.int32(LONGEST + 1)], bounds)[::2]
            value[head] = np.minimum(value[head], least[to[head]])
            out = np.empty(len(idx), ENTRY)
            out["at"], out["shared"] = before[idx], np.minimum(value, self.cap - 1) + 1
            np.minimum(least, rest[0], out=least)
            first = np.flatnonzero(head)
            last = np.r_[first[1:], len(idx)] - 1
            least[to[last]] = rest[idx[last] + 1]
            for a, b, s in zip(first.tolist(), (last + 1).tolist(), to[first].tolist(), strict=True):
                queue.push(s, out[a:b])
        else:
            np.minimum(least, rest[0], out=least)

    def induce(self, seeds: np.ndarray, shared: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """All suffixes from the ranked LMS suffixes.

        Yields blocks in two sequences, first the L suffixes upwards, then the S
        suffixes downwards and among them the L suffixes again, downwards (flag
        True): in the second sequence each ``shared`` refers to the entry before.
        """
        symbol_of = self.text[seeds]
        edge = np.searchsorted(symbol_of, np.arange(SYMBOLS + 1))
        up, kept = SymbolQueue(self.memory, self.folder), SymbolQueue(self.memory, self.folder)
        least = np.zeros(SYMBOLS, np.int32)
        try:
            for c in range(SYMBOLS):
                last = None
                for block in up.pop(c):
                    if last is None:
                        block = block.copy()
                        block["shared"][0] = 0
                    last = int(block["at"][-1])
                    kept.push(c, block)
                    self._feed(up, least, c, block, falling=False)
                    yield block, False
                a, b = edge[c], edge[c + 1]
                if b > a:
                    entries = np.empty(b - a, ENTRY)
                    entries["at"], entries["shared"] = seeds[a:b], shared[a:b]
                    entries["shared"][0] = self._seam(last, int(seeds[a]))
                    self._feed(up, least, c, entries, falling=False)
        finally:
            up.close()
        down = SymbolQueue(self.memory, self.folder)
        least = np.zeros(SYMBOLS, np.int32)
        try:
            for c in range(SYMBOLS - 1, -1, -1):
                last = None
                for block in down.pop(c):
                    if last is None:
                        block = block.copy()
                        block["shared"][0] = 0
                    last = int(block["at"][-1])
                    self._feed(down, least, c, block, falling=True)
                    yield block, True
                value = None
                for block in kept.backwards(c):
                    entries = block.copy()
                    # Upwards, a value refers to the entry below; downwards, to the one above.
                    entries["shared"][1:] = block["shared"][:-1]
                    entries["shared"][0] = self._seam(last, int(block["at"][0])) if value is None else value
                    value = block["shared"][-1]
                    self._feed(down, least, c, entries, falling=True)
                    yield entries, True
        finally:
            down.close()
            kept.close()

    def _seam(self, one: int | None, other: int) -> int:
        """Prefix shared by an L and an S suffix of one symbol: the shorter of their runs of it."""
        return 0 if one is None else min(int(self.run[one]), int(self.run[other]), self.cap)

    # -- ranking of the LMS suffixes ----------------------------------------

    def rank_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS suffixes in order, and the prefix that each shares with the one before."""
        lms = self.lms
        # Induction from LMS positions in order of symbol alone sorts the LMS substrings.
        start = lms[np.argsort(self.text[lms], kind="stable")]
        is_lms = np.zeros(len(self.text), bool)
        is_lms[lms] = True
        found = [b["at"][is_lms[b["at"]]] for b, down in self.induce(start, np.zeros(len(start), np.int32)) if down]
        # The end mark has no successor that would induce it; it comes first.
        order = np.r_[len(self.text) - 1, np.concatenate(found)[::-1] if found else []].astype(np.int64)
        number = np.empty(len(self.text), np.int32)
        number[lms] = np.arange(len(lms))
        nth = number[order]
        stop = np.r_[lms[1:], lms[-1]][nth]  # where the substring ends, its last symbol included
        same = self._same_substring(order, stop)
        name = np.empty(len(lms), np.int64)
        name[nth] = np.cumsum(~same)
        place = self._rank_names(name, int(name.max()))
        order = lms[np.argsort(place, kind="stable")]
        return order, self._shared(order)

    def _same_substring(self, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Whether each LMS substring equals the one before in order."""
        size = stop - at + 1
        same = np.r_[False, size[1:] == size[:-1]]
        live = np.flatnonzero(same)
        k = 0
        while len(live):
            differ = self.text[at[live] + k] != self.text[at[live - 1] + k]
            same[live[differ]] = False
            k += 1
            live = live[~differ & (size[live] > k)]
        return same

    def _rank_names(self, name: np.ndarray, most: int) -> np.ndarray:
        """Ranks of the suffixes of the reduced string by doubling, as deep as the cap asks for."""
        rank, depth, n = name, 1, len(name)
        while most < n and depth < self.cap:
            ahead = np.zeros(n, np.int64)
            ahead[:-depth] = rank[depth:]
            both = rank * (most + 1) + ahead
            order = np.argsort(both, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[True, np.diff(both[order]) != 0])
            most, depth = int(rank.max()), depth * 2
        return rank

    def _shared(self, order: np.ndarray) -> np.ndarray:
        """Prefix that each suffix shares with the one before, up to the cap."""
        out = np.zeros(len(order), np.int64)
        text = np.r_[self.text, np.zeros(8, self.text.dtype)]
        n = len(self.text)
        live = np.arange(1, len(order))
        step = np.arange(8)
        while len(live):
            a, b = order[live] + out[live], order[live - 1] + out[live - 1 + 1]
            equal = text[a[:, None] + step] == text[b[:, None] + step]
            got = np.where(equal.all(1), 8, equal.argmin(1))
            out[live] += got
            live = live[(got == 8) & (out[live] < self.cap) & (np.maximum(order[live], order[live - 1]) + out[live] < n)]
        return np.minimum(out, self.cap).astype(np.int32)

    def marks(self) -> np.ndarray:
        """For each position, whether its suffix shares ``cap`` symbols with a neighbour in order."""
        hit = np.zeros(len(self.text), bool)
        before = None
        for block, down in self.induce(*self.rank_lms()):
            if not down:
                continue
            at, long_ = block["at"], block["shared"] >= self.cap
            hit[at[long_]] = True
            hit[at[:-1][long_[1:]]] = True
            if long_[0] and before is not None:
                hit[before] = True
            before = at[-1]
        return hit


def repeated_starts(pieces: list[bytes], window: int, memory: int = 256 << 20, folder: str | None = None) -> np.ndarray:
    """Positions, with the pieces end to end and one mark after each, where a string of ``window`` bytes starts that starts elsewhere too."""
    text = symbols_of(pieces)
    if not pieces:
        return np.zeros(0, np.int64)
    hit = Sorter(text, window, memory, folder).marks()
    # A string that crosses an end mark is no string of a piece.
    mark = np.where(text < BYTE, np.arange(len(text)), len(text))
    room = np.minimum.accumulate(mark[::-1])[::-1] - np.arange(len(text))
    return np.flatnonzero(hit & (room >= window))
