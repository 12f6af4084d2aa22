"""Byte-pair merges of many words at once, in numpy, for vocabularies of the `tokenizers` JSON form.

Words are rows of token ids; a step joins in every row the leftmost pair of the lowest rank, as the library does
one word at a time, until no row has a pair to join. Rows that are done leave the table.
"""

from __future__ import annotations

import json

import numpy as np

NONE, FREE = np.int32(1 << 30), np.int64(-2)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


def runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each start and size, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


class WordMerges:
    """Ids of non-empty words that are each one pre-token, normalised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # open addressing, filled to a quarter at most: a pair stands in the first free slot from its own on
        self.bits = max(4, (4 * len(keys) - 1).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, FREE), np.full(1 << self.bits, NONE)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == FREE
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.ranks[at[placed]] = left[placed]
            left, at = left[~placed], (at[~placed] + 1) & (1 << self.bits) - 1
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right
        keys[(left | right) < 0] = -1
        at = self._slot(keys)
        seen = self.keys[at]
        found = np.where(seen == keys, self.ranks[at], NONE)
        go = np.flatnonzero((seen != keys) & (seen != FREE))
        keys, at = keys.ravel()[go], at.ravel()[go]
        while len(go):
            at = (at + 1) & (1 << self.bits) - 1
            seen = self.keys[at]
            same = seen == keys
            found.ravel()[go[same]] = self.ranks[at[same]]
            more = ~same & (seen != FREE)
            go, keys, at = go[more], keys[more], at[more]
        return found

    def _merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, n = int(sizes.max()), len(sizes)
        cols = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :-1][cols < sizes[:, None]] = self.inner[runs(data, starts, sizes)]
        ids[np.arange(n), sizes - 1] = self.last[data[starts + sizes - 1]]
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self._rank(ids[:, :-2], ids[:, 1:-1])
        out, made, rows = np.empty((n, width), np.int32), np.empty(n, np.int64), np.arange(n)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                out[rows[done]], made[rows[done]] = ids[done, :-1], sizes[done]
                go = ~done
                rows, ids, ranks, sizes, at, best = rows[go], ids[go], ranks[go], sizes[go], at[go], best[go]
                if not len(rows):
                    break
            k = np.arange(len(rows))
            after = cols > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            sizes = sizes - 1
            ids[k, at] = self.made[best]
            ranks[k, at] = self._rank(ids[k, at], ids[k, at + 1])
            has = at > 0
            ranks[k[has], at[has] - 1] = self._rank(ids[k[has], at[has] - 1], ids[k[has], at[has]])
        return out[cols < made[:, None]], made

    def flat(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose bytes stand one after the other in data, and how many each has; words of like length go together."""
        order, starts = np.argsort(sizes, kind="stable"), np.cumsum(sizes) - sizes
        found = [self._merge(data, starts[some], sizes[some]) for some in np.split(order, range(2000, len(order), 2000))] if len(order) else []
        made = np.empty(len(order), np.int64)
        made[order] = np.concatenate([n for _, n in found] or [made])
        begins = np.empty(len(order), np.int64)
        begins[order] = np.cumsum(made[order]) - made[order]
        return runs(np.concatenate([ids for ids, _ in found] or [np.empty(0, np.int32)]), begins, made), made

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        ids, n = self.flat(np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)), np.int64))
        return [ids[e - k : e].tobytes() for e, k in zip(np.cumsum(n).tolist(), n.tolist())]
