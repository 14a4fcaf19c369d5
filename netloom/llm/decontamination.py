"""Benchmark items in documents, also with other numbers, names and units.

Texts become templates: each word in lower case, but numbers, units after a
number and names (capitals within a sentence) by typed placeholders. Windows
of ``WINDOW`` template words of documents and items are joined by hash. As a
capital may also come from a title, a heading or a bracket, windows with names
are posted a second time with the names as plain words, so that a text in any
letter case meets its item. Where windows meet, the item's template is aligned with the document's words along the
diagonal of the meeting: an occurrence holds the item if enough template words
agree and the words behind placeholders map consistently in both directions,
as they do where a question was given new parameters. Each occurrence is
judged by itself, so variants that stand beside each other don't mix.

The benchmark is taken in blocks of a bounded size. A block's windows go to
all executors as a sorted table, so no document is shuffled; a benchmark of
several blocks reads the documents once for each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.lineage import cut, without_ids
from netloom.llm.text import WORD, chunks, code_points, mix, prefix_hash, released, shingle_hashes, span_hash, spans, utf8

WINDOW = 5
#: Words of a window at least that aren't placeholders.
LEAST_LITERAL = 3
#: Share of an item's words that must agree, and so many of them at least (all, of a shorter item).
LEAST_AGREE, LEAST_WORDS = 0.7, 8
#: A part of an item that is held word by word also counts, from so many template words in a row, of which so many aren't placeholders.
PART_WORDS, PART_LITERAL = 13, 8
#: Share of the slots that may break the mapping of values; one slot always may.
MOST_BROKEN = 0.25
#: Words that an alignment may be shifted by.
BAND = 4
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20

# fixed values: units of measure, numbers in words
UNITS = "mm cm dm m km mi mile miles ft feet foot inch inches yd yards mg g kg t lb lbs oz pound pounds ml cl dl l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent kmh mph".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

_NUMBER, _UNIT, _NAME = np.uint64(1), np.uint64(2), np.uint64(3)


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[[ord(c) for c in chars]] = True
    return out


_DIGIT = np.array([chr(c).isdigit() for c in range(1 << 16)])
_STOP = _flags(".!?:;\n\r\"“”«»|")
_INNER = _flags("*@$!")
_BETWEEN_DIGITS = _flags(".,:/")
_BEFORE_DIGITS = _flags("+-−$€£¥")


def _hashes_of(names: list[str]) -> np.ndarray:
    points = np.array([ord(c) for u in names for c in u], np.uint32)
    ends = np.cumsum([len(u) for u in names])
    return np.sort(span_hash(prefix_hash(points), ends - [len(u) for u in names], ends))


_UNITS, _NUMBERS = _hashes_of(UNITS), _hashes_of(NUMBERS)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if len(known) == 0:
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, starts and ends of words: runs of letters and
    digits; a number with separators, sign or currency, and percent sign is one."""
    plain = np.minimum(points, np.uint32(0xFFFF))
    low = WORD[plain]
    inside, digit = low != 0, _DIGIT[plain]
    joint, lead, last = (np.zeros(len(points), bool) for _ in range(3))
    joint[1:-1] = (inside[:-2] & inside[2:] & _INNER[plain[1:-1]]) | (digit[:-2] & digit[2:] & _BETWEEN_DIGITS[plain[1:-1]])
    lead[:-1] = _BEFORE_DIGITS[plain[:-1]] & digit[1:]
    lead[1:] &= ~inside[:-1]
    last[1:] = digit[:-1] & (plain[1:] == ord("%"))
    # no row's words depend on its neighbours
    some = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][some], offsets[1:][some] - 1
    joint[heads] = joint[tails] = lead[tails] = last[heads] = False
    lead[heads] |= _BEFORE_DIGITS[plain[heads]] & digit[np.minimum(heads + 1, len(points) - 1)] & (heads < tails)
    own = joint | lead | last
    return np.where(own, plain, low), *spans(inside | own, offsets)


def templates(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' words the template codes (1 to 3: placeholders, else hashes),
    the hashes, and the rows' offsets among them."""
    low, start, end = _words(points, offsets)
    own = np.maximum(span_hash(prefix_hash(low), start, end), np.uint64(4))
    plain = np.minimum(points, np.uint32(0xFFFF))
    number = _DIGIT[plain[start]] | _BEFORE_DIGITS[plain[start]] | _among(own, _NUMBERS)
    after = np.zeros(len(start), bool)
    after[1:] = number[:-1]
    stops = np.concatenate([[0], np.cumsum(_STOP[plain])])
    bounds = np.searchsorted(start, offsets)
    first = np.ones(len(start), bool)
    first[1:] = stops[start[1:]] > stops[end[:-1]]
    heads = bounds[:-1][bounds[:-1] < len(start)]
    first[heads], after[heads] = True, False
    unit = after & _among(own, _UNITS)
    capital = low[start] != points[start]
    # a capital at the start of a sentence is a name's if it is one elsewhere in the text
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    key = mix(own ^ mix(row))
    name = capital & (~first | _among(key, np.unique(key[capital & ~first])))
    code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, own)))
    return code, own, bounds


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Codes and hashes of each text's words, and hashes and places of its windows
    in both readings."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        code, own, bounds = templates(*code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        readings = []
        if len(code) >= WINDOW:
            within = lambda words: (s := np.concatenate([[0], np.cumsum(words)]))[WINDOW:] - s[:-WINDOW]
            at = np.arange(len(code) - WINDOW + 1)
            whole = bounds[np.searchsorted(bounds, at, side="right")] >= at + WINDOW
            name = code == _NAME
            for words, good in ((code, whole), (np.where(name, own, code), whole & (within(name) > 0))):
                at = np.flatnonzero(good & (within(words > 3) >= LEAST_LITERAL))
                readings.append((shingle_hashes(mix(words), WINDOW)[at], at, np.searchsorted(at, bounds)))
        for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own_windows = [(h[c[i] : c[i + 1]], at[c[i] : c[i + 1]] - x) for h, at, c in readings]
            hashes = np.concatenate([*(h for h, _ in own_windows), np.zeros(0, np.uint64)])
            yield code[x:y], own[x:y], hashes, np.concatenate([*(at for _, at in own_windows), np.zeros(0, np.int64)])


@dataclass
class Block:
    """The templates of some items, and their windows sorted by hash."""

    ids: list[int]
    codes: list[np.ndarray]
    owns: list[np.ndarray]
    windows: np.ndarray
    item: np.ndarray
    place: np.ndarray
    #: The leading 24 bits of the windows, as flags.
    known: np.ndarray

    @classmethod
    def of(cls, items: pa.Table) -> Block:
        found = list(_texts(items["text"].combine_chunks())) if len(items) else []
        windows = np.concatenate([*(x[2] for x in found), np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(found)), [len(x[2]) for x in found])
        place = np.concatenate([*(x[3] for x in found), np.zeros(0, np.int64)])
        order = np.argsort(windows, kind="stable")
        known = np.zeros(1 << 24, bool)
        known[(windows >> np.uint64(40)).astype(np.int64)] = True
        return cls(items["item_id"].to_pylist(), [x[0] for x in found], [x[1] for x in found], windows[order], item[order], place[order], known)

    def meetings(self, windows: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, alignment) of the items' windows that equal a document's; the
        alignment is the place in the document less that in the item."""
        may = np.flatnonzero(self.known[(windows >> np.uint64(40)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.windows, windows[may], side=s) for s in ("left", "right"))
        n = hi - lo
        if not n.any():
            return
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.stack([self.item[at], np.repeat(places[may], n) - self.place[at]], 1)
        yield from map(tuple, np.unique(pairs, axis=0).tolist())


def _consistency(pairs: list[tuple[int, int]]) -> tuple[float, int, int]:
    """Share of the slots that keep the mapping of values, the worse of both
    directions; the values of the item, and those that the document changed."""
    worst = 0
    for pick in (0, 1):
        by: dict[int, Counter[int]] = defaultdict(Counter)
        for p in pairs:
            by[p[pick]][p[1 - pick]] += 1
        worst = max(worst, sum(c.total() - max(c.values()) for c in by.values()))
    values = {a for a, _ in pairs}
    return 1 - worst / len(pairs) if pairs else 1.0, len(values), len({a for a, b in pairs if a != b})


def _judged(size: int, agree: list[tuple[int, int]], own: np.ndarray, other: np.ndarray, slot: np.ndarray) -> tuple[float, int, int, float] | None:
    """The row of an alignment's agreeing words (place in the item, in the document), if its slots are consistent."""
    share, values, changed = _consistency([(int(own[i]), int(other[j])) for i, j in agree if slot[i]])
    slots = sum(bool(slot[i]) for i, _ in agree)
    if (1 - share) * slots > max(1, MOST_BROKEN * slots) + 1e-9:
        return None
    return len(agree) / size, values, changed, share


def occurrence(code: np.ndarray, own: np.ndarray, doc: np.ndarray, doc_own: np.ndarray, shift: int) -> tuple[float, int, int, float] | None:
    """(coverage, slots, changed slots, consistency) of the item's occurrence
    ``shift`` words into the document, or None if it doesn't hold the item.

    Words agree if their codes or the words themselves do; the agreeing words
    are the longest common subsequence along the alignments within BAND of
    ``shift``, or the longest run on ``shift`` alone.
    """
    m = len(code)
    need = max(LEAST_AGREE * m, min(m, LEAST_WORDS))
    # equal[i, j]: word i of the item and word lo + j of the document; only near the diagonal
    i, away = np.arange(m)[:, None], np.arange(-BAND, BAND + 1)[None, :]
    j = i + shift + away
    there = (j >= 0) & (j < len(doc))
    at = np.clip(j, 0, len(doc) - 1)
    equal = there & ((doc[at] == code[:, None]) | (doc_own[at] == own[:, None]))
    found = []
    if equal.any(axis=1).sum() >= need:
        # best[k, o]: of the first k words of the item, and of the document up to the alignment of column o
        best = np.zeros((m + 1, 2 * BAND + 1), np.int32)
        for k in range(m):
            step = best[k] + equal[k]
            step[:-1] = np.maximum(step[:-1], best[k, 1:])
            best[k + 1] = np.maximum.accumulate(step)
        if best[m, -1] >= need:
            agree, k, o = [], m, 2 * BAND
            while best[k, o]:
                if o and best[k, o] == best[k, o - 1]:
                    o -= 1
                elif o < 2 * BAND and best[k, o] == best[k - 1, o + 1]:
                    k, o = k - 1, o + 1
                else:
                    k -= 1
                    agree.append((k, k + shift + o - BAND))
            found.append(_judged(m, agree, own, doc_own, code <= 3))
    straight = equal[:, BAND]
    if m > PART_WORDS and straight.sum() >= PART_WORDS:
        start, end = spans(straight, np.array([0, m]))
        k = int((end - start).argmax())
        run = np.arange(start[k], end[k])
        if len(run) >= PART_WORDS and (code[run] > 3).sum() >= PART_LITERAL:
            found.append(_judged(m, [(int(i), int(i) + shift) for i in run], own, doc_own, code <= 3))
    return max((x for x in found if x), default=None)


def _found(docs: DataFrame, block: Block) -> DataFrame:
    send = docs.sparkSession.sparkContext.broadcast(block)
    names = ["doc_id", "item_id", "coverage", "slots", "changed_slots", "consistency"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = send.value
        for batch in batches:
            out = []
            for key, (code, own, windows, places) in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                best: dict[int, tuple] = {}
                for item, shift in block.meetings(windows, places):
                    row = occurrence(block.codes[item], block.owns[item], code, own, shift)
                    if row and row > best.get(item, (0,)):
                        best[item] = row
                out += [(key, block.ids[item], *row) for item, row in best.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, item_id long, coverage double, slots long, changed_slots long, consistency double")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, slots, changed_slots, consistency): documents
    of ``docs(doc_id, text)`` that hold an item of ``benchmark(item_id, text)``.

    A document holds an item if in one occurrence 70 % of the item's template
    words agree, 8 words at least (all, of a shorter item), or 13 in a row of
    which 8 are no placeholders; and all but one or a quarter of the slots
    among them map the item's values to the document's one to one. An
    occurrence shares a window of 5 template words. coverage is the share of
    the item's words that agree, slots counts the values behind placeholders
    and changed_slots those that differ, as in a question with new parameters;
    of several occurrences the one of the largest coverage is given. Items of
    fewer than 5 words, or with hardly any words but placeholders, are never
    found; null and empty texts neither. Repeated items or documents of one id
    count as one; rows without an id give no rows here (``clean`` sees them);
    other columns are ignored.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs = docs.where("doc_id is not null and text is not null")
    out = None
    for k in range(blocks):
        block = Block.of(items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toArrow())
        found = _found(docs, block)
        out = found if out is None else out.union(found)
    best = F.max(F.struct("coverage", "slots", "changed_slots", "consistency")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``; rows without an
    id go by their text's hash."""
    named = without_ids(docs.where("doc_id is not null"), cut(contaminated(docs, benchmark).select("doc_id").distinct()), "doc_id")
    nameless = docs.where("doc_id is null").withColumn("_text_key", F.xxhash64("text"))
    held = contaminated(nameless.select(F.col("_text_key").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_text_key")).distinct()
    return named.unionByName(without_ids(nameless, cut(held), "_text_key").drop("_text_key"))
