"""Sampled segmentation of texts into the pieces of a public vocabulary.

A text is cut into units, a run of blanks with what follows it up to the next
blank; no piece of the vocabulary goes over a unit's end. The pieces that can
stand at each place of a unit form a lattice. Filtering goes forward: each
place sums the weights of all paths that reach it. Sampling goes backward from
the unit's end: a piece that ends here is drawn in proportion to its weight
times the sum at its start. Draws depend on the row's key and the place in the
text alone, so a row gets the same pieces in any batch, task or run.

Filtering is done once for each distinct unit of a batch, and all units of a
batch take their steps side by side in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import chunks, code_points, mix, prefix_hash, released, span_hash, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Exponent of the pieces' weights: 0 draws all paths alike, large values the likeliest one.
SHARPNESS = 1.0
_SPACE = 0x2581


class Pieces:
    """The vocabulary as a trie in arrays. The file's scores are ranks of merges;
    a piece of rank r weighs 1 / (r + 2) to the power of ``sharpness``."""

    def __init__(self, path: str, sharpness: float) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = ["" if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) else model.id_to_piece(i) for i in range(n)]
        self.byte = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = i
        self.byte_of = {int(i): b for b, i in enumerate(self.byte)}
        rank = np.array([-model.get_score(i) for i in range(n)])
        self.log_weight = (-sharpness * np.log(np.maximum(rank, 0) + 2)).astype(np.float64)
        # a byte weighs less than any piece, so it is drawn where nothing else fits
        self.byte_weight = -sharpness * np.log(4.0 * n)
        letters = sorted({c for t in self.text for c in t})
        self.symbols = np.zeros(1 << 16, np.int32)
        for k, c in enumerate(letters):
            if ord(c) < 1 << 16:
                self.symbols[ord(c)] = k + 1
        steps: dict[tuple[int, int], int] = {}
        ends = {}
        for i, t in enumerate(self.text):
            if not t or any(ord(c) >= 1 << 16 for c in t):
                continue
            node = 0
            for c in t:
                node = steps.setdefault((node, int(self.symbols[ord(c)])), len(steps) + 1)
            ends[node] = i
        width = len(letters) + 1
        keys = np.array([a * width + c for a, c in steps], np.int64)
        order = np.argsort(keys)
        self.width, self.keys, self.to = width, keys[order], np.array(list(steps.values()), np.int32)[order]
        # children of a node are neighbours among the keys
        self.first = np.searchsorted(self.keys, np.arange(len(steps) + 2) * width)
        self.piece = np.full(len(steps) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        # the nodes of one letter, which all walks start with, and a dense table of pairs
        self.root = np.full(width, -1, np.int32)
        self.root[(self.keys[: self.first[1]] % width)] = self.to[: self.first[1]]

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The nodes that the symbols lead to, -1 where there is none."""
        key = node.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


@cache
def pieces(path: str = MODEL, sharpness: float = SHARPNESS) -> Pieces:
    """Loaded once in each worker; the file is part of the machines' installation."""
    return Pieces(path, sharpness)


def _units(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with blanks as U+2581, one of them before each row, and starts
    and ends of the units. U+2581 of the text itself stands as 0, which no piece has."""
    n = len(offsets) - 1
    out = np.full(len(points) + n, _SPACE, np.uint32)
    at = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[at] = np.where(points == 32, np.uint32(_SPACE), np.where(points == _SPACE, np.uint32(0), points))
    bounds = offsets + np.arange(n + 1)
    fresh = np.zeros(len(out), bool)
    fresh[1:] = (out[1:] == _SPACE) & (out[:-1] != _SPACE)
    fresh[bounds[:-1]] = True
    start = np.flatnonzero(fresh)
    return out, start, np.append(start[1:], len(out))


def _edges(vocab: Pieces, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lattice of the units text[start:end], laid out one after the other:
    for each edge its start, end (places, a unit has its length plus one) and
    piece (-1: the letter's bytes), and the first place of each unit."""
    size = end - start
    base = np.concatenate([[0], np.cumsum(size + 1)])
    letter = np.repeat(start - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
    place = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
    left = np.repeat(end, size) - letter
    symbol = vocab.symbols[np.minimum(text[letter], 0xFFFF)]
    symbol[text[letter] == 0] = 0
    symbol[text[letter] > 0xFFFF] = 0
    full = np.zeros(len(text), np.int32)
    full[letter] = symbol
    node, alive = vocab.root[symbol], np.flatnonzero(vocab.root[symbol] >= 0)
    node, found, length = node[alive], [], 1
    covered = np.zeros(len(place), bool)
    while len(alive):
        piece = vocab.piece[node]
        hit = piece >= 0
        if length == 1:
            covered[alive[hit]] = True
        found.append((place[alive[hit]], place[alive[hit]] + length, piece[hit]))
        more = left[alive] > length
        alive, node = alive[more], node[more]
        node = vocab.step(node, full[letter[alive] + length])
        ok = node >= 0
        alive, node, length = alive[ok], node[ok], length + 1
    bare = place[~covered]
    found.append((bare, bare + 1, np.full(len(bare), -1, np.int32)))
    begin, stop, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((begin, stop))
    return begin[order], stop[order], piece[order], base


def _filter(weight: np.ndarray, begin: np.ndarray, stop: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums, as logarithms: for each edge the share, running up to 1, of
    the edges that end where it does; and the first edge that ends at each place."""
    total = np.full(base[-1], -np.inf)
    total[base[:-1]] = 0.0
    first = np.searchsorted(stop, np.arange(base[-1] + 1))
    share = np.zeros(len(stop))
    units = np.argsort(-size, kind="stable")
    tall = size[units]
    for depth in range(1, int(size.max(initial=0)) + 1):
        at = base[units[: np.searchsorted(-tall, -depth, side="right")]] + depth
        lo, hi = first[at], first[at + 1]
        count = hi - lo
        ends = np.cumsum(count)
        edge = np.arange(ends[-1]) + np.repeat(lo - ends + count, count)
        value = total[begin[edge]] + weight[edge]
        heads = ends - count
        top = np.maximum.reduceat(value, heads)
        part = np.exp(value - np.repeat(top, count))
        run = np.cumsum(part)
        before = np.concatenate([[0.0], run])[heads]
        whole = np.add.reduceat(part, heads)
        share[edge] = np.minimum((run - np.repeat(before, count)) / np.repeat(whole, count), 1.0)
        share[edge[ends - 1]] = 1.0
        total[at] = top + np.log(whole)
    return share, first


def _draw(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row's seed and a place."""
    return (mix(seed + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def encode(vocab: Pieces, points: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the rows, and the rows' offsets among them."""
    text, start, end = _units(points, offsets)
    bounds = offsets + np.arange(len(offsets))
    row = np.searchsorted(bounds, start, side="right") - 1
    _, unit, kind = np.unique(span_hash(prefix_hash(text), start, end), return_index=True, return_inverse=True)
    begin, stop, piece, base = _edges(vocab, text, start[unit], end[unit])
    width = np.ones(len(piece))
    if (bare := np.flatnonzero(piece < 0)).size:
        owner = np.searchsorted(base, begin[bare], side="right") - 1
        code = text[start[unit][owner] + begin[bare] - base[owner]]
        width[bare] = 1 + (code >= 0x80) + ((code >= 0x800) | (code == 0)) + (code >= 0x10000)
    weight = np.where(piece >= 0, vocab.log_weight[piece], vocab.byte_weight * width)
    share, first = _filter(weight, begin, stop, base, (end - start)[unit])
    live, at = np.arange(len(start)), base[kind] + (end - start)
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        deep = at - base[kind[live]]
        draw = _draw(seeds[row[live]], start[live] + deep - bounds[row[live]])
        edge = first[at]
        # the last share of a place is 1 and no draw reaches it
        low = np.flatnonzero(share[edge] <= draw)
        while len(low):
            edge[low] += 1
            low = low[share[edge[low]] <= draw[low]]
        at = begin[edge]
        taken.append((start[live] + at - base[kind[live]], piece[edge]))
        on = at > base[kind[live]]
        live, at = live[on], at[on]
    where, ids = (np.concatenate(x) for x in zip(*taken, strict=True)) if taken else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    order = np.argsort(where)
    where, ids = where[order], ids[order]
    if (bare := np.flatnonzero(ids < 0)).size:
        spelt = [vocab.byte[list(chr(c or _SPACE).encode("utf-8", "surrogatepass"))] for c in text[where[bare]].tolist()]
        many = np.ones(len(ids), np.int64)
        many[bare] = [len(x) for x in spelt]
        out, where = np.repeat(ids, many), np.repeat(where, many)
        out[out < 0] = np.concatenate(spelt)
        ids = out
    return ids.astype(np.int32), np.searchsorted(where, bounds)


def decode(vocab: Pieces, ids: list[int]) -> str:
    """The text that ``ids`` were made from."""
    out, held = [], bytearray()
    for i in ids:
        if i in vocab.byte_of:
            held.append(vocab.byte_of[i])
            continue
        if held:
            out.append(held.decode("utf-8", "surrogatepass"))
            held.clear()
        out.append(vocab.text[i].replace("▁", " "))
    out.append(held.decode("utf-8", "surrogatepass"))
    return "".join(out)[1:]


def _seed(key: object) -> int:
    return xxhash.xxh3_64_intdigest(str(key).encode())


def encoded(docs: DataFrame, path: str = MODEL, sharpness: float = SHARPNESS) -> DataFrame:
    """(doc_id, pieces, n_pieces, lossless) of ``docs(doc_id, text)``.

    pieces are ids of the vocabulary file ``path``; the row's key is doc_id, so
    rows that repeat it draw alike. lossless tells that decoding gave the text
    back. A null text has null pieces, an empty one the single piece that every
    text starts with. Texts are taken whole; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path, sharpness)
        for batch in batches:
            seeds = np.array([_seed(k) for k in batch.column(0).to_pylist()], np.uint64)
            data, offsets = utf8(batch.column(1))
            parts, sizes, same = [], [], []
            for lo, hi in chunks(offsets):
                raw = data[offsets[lo] : offsets[hi]]
                ids, bounds = encode(vocab, *code_points(raw, offsets[lo : hi + 1] - offsets[lo]), seeds[lo:hi])
                parts.append(ids)
                sizes.append(np.diff(bounds))
                same += [decode(vocab, ids[a:b].tolist()) == raw[x - offsets[lo] : y - offsets[lo]].tobytes().decode("utf-8", "surrogatepass") for a, b, x, y in zip(bounds[:-1], bounds[1:], offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
            size = np.concatenate([*sizes, np.zeros(0, np.int64)])
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)])), mask=batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(size, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "pieces", "n_pieces", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of ``rows(doc_id, pieces)``; null pieces give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = pieces(path)
        for batch in batches:
            texts = [None if x is None else decode(vocab, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
