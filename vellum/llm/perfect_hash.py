"""A minimal perfect hash of 64-bit values in numpy, whole shards looked up at once.

A shard's values are placed level by level: those that have a bit of the level's
vector for themselves keep it, the others go on to the next level's. A value's
slot is the number of bits set before its own. The function gives some slot (or
-1) to values that it was not built from, so the caller compares the stored key.
"""

from __future__ import annotations

import numpy as np

LOAD = 2
DEEPEST = 64
U = np.uint64


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 64-bit values, another for each salt."""
    with np.errstate(over="ignore"):
        x = x + U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def build(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For different values: bits in each level, the levels' vectors in 64-bit words one after the other, and the values' positions in order of their slots."""
    sizes, words, order = [], [], []
    left = np.arange(len(values))
    while len(left):
        if len(sizes) == DEEPEST:
            raise ValueError("the values are not different")
        m = -(-max(64, LOAD * len(left)) // 64) * 64
        at = (mixed(values[left], len(sizes) + 1) % U(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        stays = alone[at]
        words.append(np.packbits(alone, bitorder="little").view(U))
        order.append(left[stays][np.argsort(at[stays])])
        sizes.append(m)
        left = left[~stays]
    join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    return np.array(sizes, np.int64), join(words, U), join(order, np.int64)


class PerfectHash:
    """The shards' functions side by side: slots count on from shard to shard."""

    def __init__(self, shards: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """shards: sizes and words as build() gives them."""
        depth = max((len(s) for s, _ in shards), default=0)
        self.sizes = np.zeros((depth, len(shards)), np.int64)
        self.starts = np.zeros((depth, len(shards)), np.int64)
        at = 0
        for k, (sizes, _) in enumerate(shards):
            for level, m in enumerate(sizes.tolist()):
                self.sizes[level, k], self.starts[level, k] = m, at
                at += m
        self.words = np.concatenate([w for _, w in shards]) if shards else np.empty(0, U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.size = int(self.before[-1])

    def slots(self, values: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """The slot of each value in its shard; -1 for some that are not there."""
        out = np.full(len(values), -1, np.int64)
        todo = np.arange(len(values))
        for level in range(len(self.sizes)):
            m = self.sizes[level, shard[todo]]
            todo, m = todo[m > 0], m[m > 0]
            if not len(todo):
                break
            at = self.starts[level, shard[todo]] + (mixed(values[todo], level + 1) % m.astype(U)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(U)
            found = (word >> bit) & U(1) == 1
            hit = todo[found]
            out[hit] = self.before[at[found] >> 6] + np.bitwise_count(word[found] & ((U(1) << bit[found]) - U(1)))
            todo = todo[~found]
        return out
