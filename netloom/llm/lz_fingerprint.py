"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed left to right into the phrases of its own LZ78 dictionary:
each is the shortest string not met before. The fingerprint keeps the minimum
hashes of the set of phrases; the share of equal minima of two fingerprints
estimates the overlap of the phrase sets, as compression distances do.

A document is also compared to an edited form of itself and to the next
document. For that, documents are dealt out by ranges of their ids and sorted
within; the first document of each range is sent along to the range that
precedes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.text import mix

SLOTS = 128
#: Phrases shorter than this are shared by all texts of a language and tell nothing.
LEAST_PHRASE = 3
#: Documents in a range of ids, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 500, 10_000

_random = np.random.default_rng(7919)
_FACTORS = _random.integers(0, 1 << 32, SLOTS, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _random.integers(0, 1 << 32, SLOTS, dtype=np.uint32)


def phrases(text: str, known: set[str], start: str = "") -> str:
    """Adds the LZ78 phrases of ``text`` to ``known``, going on from an open
    phrase ``start``; returns the phrase left open at the end."""
    phrase, add = start, known.add
    for c in text:
        phrase += c
        if phrase not in known:
            add(phrase)
            phrase = ""
    return phrase


def minima(kinds: list[str]) -> np.ndarray:
    """Minimum hashes of a list of phrases; the largest value in every slot for none."""
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    hashes = np.fromiter(map(hash64, kinds), np.uint64, len(kinds))
    x = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        part = x[None, i : i + 2048] * _FACTORS[:, None]
        part += _OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def hash64(phrase: str) -> int:
    return xxhash.xxh3_64_intdigest(phrase.encode("utf-8", "surrogatepass"))


def _set(known: set[str], rest: str) -> list[str]:
    """The phrases that count; those of very short texts all do."""
    every = [*known, rest] if rest else [*known]
    return [x for x in every if len(x) >= LEAST_PHRASE] or every


def fingerprint(text: str) -> np.ndarray:
    known: set[str] = set()
    return minima(_set(known, phrases(text, known)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of slots with equal minima, 0 to 1."""
    return float((a == b).mean())


def code(minimum: np.ndarray) -> str:
    """A fingerprint as text, 8 hexadecimal digits a slot: ``likeness`` follows from two of them."""
    return minimum.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    return text[: len(text) - len(text) // 2] + following[: len(text) // 2]


def compared(text: str, following: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text and of its edited form, which share the parse of the first half."""
    half = len(text) // 2
    known: set[str] = set()
    open_ = phrases(text[: len(text) - half], known)
    other = set(known)
    return minima(_set(known, phrases(text[len(text) - half :], known, open_))), minima(_set(other, phrases(following[:half], other, open_)))


def _with_leads(docs: DataFrame) -> DataFrame:
    """(bucket, lead, doc_id, text): each row in its range of ids, and copies
    (lead) of the first row of each range in the range that precedes it in the
    order of falling doc_id; the first range follows the last.

    The ranges' bounds and first ids, MOST_RANGES at most, pass the driver.
    """
    keys = docs.select("doc_id")
    n = max(1, min(MOST_RANGES, -(-keys.count() // RANGE_ROWS)))
    cuts = np.array(sorted(set(keys.na.drop().approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else [])

    def buckets(column: pa.Array) -> np.ndarray:
        # a null id comes last in falling order, so it falls into the lowest range
        return np.searchsorted(cuts, np.array([float("-inf") if x is None else x for x in column.to_pylist()], float))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top: dict[int, int | None] = {}
            for bucket, key in zip(buckets(batch.column(0)).tolist(), batch.column(0).to_pylist(), strict=True):
                if top.get(bucket) is None or (key is not None and key > top[bucket]):
                    top[bucket] = key
            yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int32()), pa.array(list(top.values()), pa.int64())], ["bucket", "top"])

    top = {r["bucket"]: r["top"] for r in keys.mapInArrow(tops, "bucket int, top long").groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    order = sorted(top)
    before = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_pylist(), buckets(batch.column(0)).tolist()
            lead = [i for i, (b, key) in enumerate(zip(own, ids, strict=True)) if top[b] == key]
            take = pa.array([*range(len(ids)), *lead], pa.int64())
            place = pa.array([*own, *(before[own[i]] for i in lead)], pa.int32())
            flag = pa.array([False] * len(ids) + [True] * len(lead))
            yield pa.RecordBatch.from_arrays([place, flag, batch.column(0).take(take), batch.column(1).take(take)], ["bucket", "lead", "doc_id", "text"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "bucket int, lead boolean, doc_id long, text string")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and, within, in order, the lead row last; each is compared to the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        out = []
        for bucket, lead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0] == bucket:
                _, before, own = held
                mine, other = compared(own, text)
                out.append([before, own, edited(own, text), mine, other, text])
            held = None if lead else (bucket, doc_id, text)
        rows = []
        for k, (doc_id, own, changed, mine, other, text) in enumerate(out):
            # the next document's own fingerprint, if it was made in this batch
            after = out[k + 1][3] if k + 1 < len(out) and out[k + 1][1] is text else fingerprint(text)
            rows.append([doc_id, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), code(mine), code(other), likeness(mine, other), likeness(mine, after)])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of ``docs(doc_id, text)``.

    The next document is the one of the next lower doc_id, after the lowest the
    highest; equal ids come in the order of their texts, null ids last. A null
    text is empty; two empty texts are alike (1.0). A single row is its own
    next document. Texts are read whole; an empty table gives no rows; other
    columns are ignored.
    """
    rows = _with_leads(docs).repartition("bucket").sortWithinPartitions("bucket", "lead", F.desc_nulls_last("doc_id"), "text")
    return rows.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
