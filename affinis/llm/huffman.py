"""Canonical length-limited Huffman coding of ids, by arrays.

Codes are packed from the highest bit down. A coded run of ids carries the bit at which every block of BLOCK ids starts, so
blocks decode independently: the decoder reads one id of every block in each step, by a table over the next `limit` bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Ids in a block, and the longest code while the ids in use fit.
BLOCK, LIMIT = 256, 16


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit in codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    weights, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        weights = both[order]
        is_leaf.append(order < n)
    taken, sizes = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for leaf in reversed(is_leaf):
        from_leaves = int(leaf[:taken].sum())
        sizes[:from_leaves] += 1
        taken = 2 * (taken - from_leaves)
    out[used] = sizes
    return out


@dataclass
class Code:
    """Codes of a table of lengths: shorter first, then by id, each one more than the last."""

    lengths: np.ndarray

    def __post_init__(self):
        self.lengths = np.asarray(self.lengths, dtype=np.uint8) if len(self.lengths) else np.zeros(1, dtype=np.uint8)
        self.limit = max(1, int(self.lengths.max(initial=1)))
        used = np.flatnonzero(self.lengths)
        used = used[np.argsort(self.lengths[used], kind="stable")]
        size = self.lengths[used].astype(np.int64)
        spans = np.int64(1) << (self.limit - size)
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[used] = first >> (self.limit - size)
        self.table = np.zeros(1 << self.limit, dtype=np.uint32)
        filled = np.repeat(used, spans)
        self.table[: len(filled)] = filled
        self.steps = self.lengths[self.table]


def encoded(ids: np.ndarray, code: Code) -> tuple[bytes, np.ndarray]:
    """Coded bits and the bit at which each block starts."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.uint64)
    size = code.lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id has no code")
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1])
    word, end = at >> 6, (at & 63) + size
    bits = code.codes[ids]
    over = np.maximum(end - 64, 0).astype(np.uint64)
    room = np.maximum(64 - end, 0).astype(np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros((total + 63) // 64, dtype=np.uint64)
    words[word[starts]] = np.bitwise_or.reduceat((bits >> over) << room, starts)
    split = np.flatnonzero(over)
    words[word[split] + 1] |= bits[split] << (np.uint64(64) - over[split])
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::BLOCK].astype(np.uint64)


def decoded(data: bytes, starts: np.ndarray, n: int, code: Code) -> np.ndarray:
    """The `n` ids behind coded bits, all blocks side by side."""
    out = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = starts.astype(np.int64)
    shift = np.uint32(32 - code.limit)
    for j in range(min(n, BLOCK)):
        if j == n - (len(starts) - 1) * BLOCK:  # the last block is shorter
            at = at[:-1]
        seen = ahead[at >> 3] << (at & 7).astype(np.uint32) >> shift
        out[: len(at), j] = code.table[seen]
        at = at + code.steps[seen]
    return out.ravel()[:n]
