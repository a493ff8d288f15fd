"""A cuckoo filter over 128-bit keys, in numpy: insertion, lookup and deletion of many keys at once."""

from __future__ import annotations

import numpy as np

from ._text import mix

SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. A key is in one of two buckets, each found from the
    other and the fingerprint alone. A key must be inserted once and deleted only if inserted."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(keys, 1) / SLOTS / 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """Holding these keys (n x 2 uint64), as large as it takes."""
        room = len(keys)
        while True:
            new = cls.sized(room)
            if new.insert(keys):
                return new
            room = room * 2 + SLOTS

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int((self.table != 0).sum())

    def _places(self, keys):
        print_ = (keys[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        return print_, (mix(keys[:, 0]) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, print_, here):
        return here ^ (mix(print_.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, here = self._places(keys)
        there = self._other(print_, here)
        return ((self.table[here] == print_[:, None]) | (self.table[there] == print_[:, None])).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if there was no room; the filter is then of no further use."""
        print_, here = self._places(keys)
        moves = np.zeros(len(here), np.int64)
        rng = np.random.default_rng(len(here))
        for _ in range(600):
            if not len(here):
                return True
            order = np.argsort(here, kind="stable")
            print_, here, moves = print_[order], here[order], moves[order]
            heads = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            rank = np.arange(len(here)) - np.repeat(heads, np.diff(np.r_[heads, len(here)]))
            full = self.table[here] != 0
            fits = rank < SLOTS - full.sum(1)
            slot = np.argsort(full[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), rank[fits]]
            self.table[here[fits], slot] = print_[fits]
            print_, here, moves = print_[~fits], here[~fits], moves[~fits]
            # Those left try their other bucket first; after that one in each bucket drives another out.
            kick = np.zeros(len(here), bool)
            if len(here):
                heads = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
                kick[heads] = moves[heads] > 0
            slot = rng.integers(0, SLOTS, int(kick.sum()))
            out = self.table[here[kick], slot]
            self.table[here[kick], slot] = print_[kick]
            print_[kick] = out
            away = kick | (moves == 0)
            here[away] = self._other(print_[away], here[away])
            moves += 1
        return not len(here)

    def delete(self, keys: np.ndarray) -> None:
        print_, here = self._places(keys)
        for turn in (0, 1):  # a key's first bucket, then for what wasn't there the other
            at = self._other(print_, here) if turn else here
            pending, missed = np.arange(len(at)), [np.zeros(0, np.int64)]
            while len(pending):  # one deletion per bucket at a time: equal fingerprints go one by one
                first = np.unique(at[pending], return_index=True)[1]
                now = pending[first]
                hit = self.table[at[now]] == print_[now, None]
                has = hit.any(1)
                self.table[at[now][has], hit[has].argmax(1)] = 0
                missed.append(now[~has])
                pending = np.delete(pending, first)
            left = np.concatenate(missed)
            print_, here = print_[left], here[left]
