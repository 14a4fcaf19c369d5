"""Minimal perfect hashes of terms, in shards, that keep their keys.

A shard places its n terms on n slots without gaps. Levels of bits do it: on
each, a term that meets no other on its bit owns it, the rest go to the next
level; a term's slot is the number of owned bits before its own. Foreign terms
fall on owned bits too, so a slot counts only if its stored key is the term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netloom.llm.text import mix, prefix_hash, span_hash, utf8

#: Levels of a shard; terms that still meet others (those of one hash) are found by name.
LEVELS = 24
_STEP = np.uint64(0x9E3779B97F4A7C15)


def term_hashes(terms: pa.Array) -> np.ndarray:
    data, offsets = utf8(terms)
    return span_hash(prefix_hash(data), offsets[:-1], offsets[1:])


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(shards)).astype(np.int64)


def _bit(hashes: np.ndarray, level: int, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes + np.uint64(level + 1) * _STEP) % sizes.astype(np.uint64)).astype(np.int64)


def build(hashes: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(bits of each level, the bits, the order of the terms by slot) of distinct terms."""
    left = np.arange(len(hashes))
    sizes: list[int] = []
    levels, order = [], []
    while len(left) and len(sizes) < LEVELS:
        size = -(-2 * len(left) // 64) * 64
        at = _bit(hashes[left], len(sizes), np.full(len(left), size))
        own = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[own]] = True
        order.append(left[own][np.argsort(at[own])])
        levels.append(bits)
        sizes.append(size)
        left = left[~own]
    bits = np.packbits(np.concatenate(levels), bitorder="little").tobytes() if levels else b""
    return sizes, bits, np.concatenate([*order, left]).astype(np.int64) if len(hashes) else left


class Shards:
    """A table ``(lang, shard, sizes, bits, keys)`` of shards, looked up all at once.

    ``first[i]`` is the first slot of the i-th row's shard."""

    def __init__(self, table: pa.Table) -> None:
        table = table.combine_chunks()
        self.langs, self.numbers = table.column("lang").to_pylist(), table.column("shard").to_pylist()
        n = len(self.langs)
        self.sizes = np.zeros((n + 1, LEVELS), np.int64)
        for i, s in enumerate(table.column("sizes").to_pylist()):
            self.sizes[i, : len(s)] = s
        ends = np.cumsum(self.sizes.sum(axis=1))
        self.at = np.concatenate([[0], ends[:-1]])[:, None] + np.cumsum(self.sizes, axis=1) - self.sizes
        self.words = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.first = np.concatenate([[0], np.cumsum(pc.list_value_length(table.column("keys")).to_numpy().astype(np.int64))])
        # owned bits before each shard's: a rank less these is a slot of the shard
        self.ranks = self.before[self.at[:, 0] // 64]
        self.keys = pc.list_flatten(table.column("keys")).combine_chunks().cast(pa.large_string())
        if isinstance(self.keys, pa.ChunkedArray):
            self.keys = self.keys.chunk(0) if self.keys.num_chunks else pa.array([], pa.large_string())
        self.named: dict[tuple[int, str], int] = {}
        for i in range(n):
            for slot in range(self.first[i] + self.ranks[i + 1] - self.ranks[i], self.first[i + 1]):
                self.named[i, self.keys[slot].as_py()] = slot

    def find(self, shard: np.ndarray, hashes: np.ndarray, terms: pa.Array) -> np.ndarray:
        """The slot of each term in the shard of that index, -1 for terms that it doesn't hold."""
        slot = np.full(len(hashes), -1, np.int64)
        left = np.flatnonzero(shard >= 0)
        for level in range(LEVELS):
            size = self.sizes[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if len(left) == 0:
                break
            at = self.at[shard[left], level] + _bit(hashes[left], level, size)
            word, inner = self.words[at >> 6], (at & 63).astype(np.uint64)
            own = (word >> inner) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << inner) - np.uint64(1))).astype(np.int64)
            hit = left[own]
            slot[hit] = self.first[shard[hit]] + self.before[at[own] >> 6] + under[own] - self.ranks[shard[hit]]
            left = left[~own]
        found = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[found])), terms.take(pa.array(found)).cast(pa.large_string()))
        slot[found[~np.asarray(same)]] = -1
        if self.named:
            for i in np.flatnonzero((slot < 0) & (shard >= 0)).tolist():
                slot[i] = self.named.get((int(shard[i]), terms[i].as_py()), -1)
        return slot
