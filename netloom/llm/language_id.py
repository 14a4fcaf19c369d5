"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order 4, over letters in lower case with a single
blank for whatever stands between them. N-grams are counted over every
labelled training document and all are kept. A model of up to MODEL_CELLS
(n-grams of each language, times languages) is made of arrays of sorted hashes
with a row of log-probabilities each, entered through a directory on the
hashes' leading bits, and sent to all executors. A larger one stays a table of
Spark: discounts and weights come from aggregations, and documents meet it by
joins on their n-grams. Both give the same cross-entropies. A document gets
the language of the lowest cross-entropy per character. It is rejected if that
cross-entropy lies farther above the language's usual value than text of its
length explains; the bounds are calibrated on all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.lineage import cut, without_ids
from netloom.llm.text import chunks, code_points, letters, mix, released, utf8

ORDER = 4
#: Size of a model at most that is sent to the executors.
MODEL_CELLS = 4_000_000
#: Rejection bound, in multiples of the 99.9 % point of the training documents' excess.
MARGIN = 2.0
#: Only entropies above so many times the language's usual one are rejected.
LEAST_RATIO = 1.8
UNKNOWN = "und"
_BITS = np.uint64(16)
_MASK = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER + 1)]


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its key as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def grams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the rows, packed into 64 bits, and the rows' offsets among them.

    A row is taken with two blanks before it and one after; further runs of
    blanks count as one. So a single letter gives an n-gram, and a row without
    letters none.
    """
    n = len(offsets) - 1
    low = letters(points)
    text = np.full(len(low) + 3 * n, 32, np.uint64)
    shift = np.repeat(np.arange(n) * 3 + 2, np.diff(offsets))
    text[np.arange(len(low)) + shift] = low
    bounds = offsets + 3 * np.arange(n + 1)
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    keep[bounds[:-1]] = keep[bounds[:-1] + 1] = True
    at = np.zeros(len(text) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    text, bounds = text[keep], at[bounds]
    if len(text) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    packed = text[: 1 - ORDER].copy()
    for j in range(1, ORDER):
        packed = (packed << _BITS) | text[j : len(text) - ORDER + 1 + j]
    whole = np.ones(len(packed), bool)
    cut = (bounds[1:-1, None] - np.arange(1, ORDER)).ravel()
    whole[cut[(cut >= 0) & (cut < len(whole))]] = False
    at = np.zeros(len(packed) + 1, np.int64)
    np.cumsum(whole, out=at[1:])
    return packed[whole], at[np.minimum(bounds, len(packed))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, gram) within a task, merged as they grow."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return gram, np.bincount(at, np.concatenate([x for _, x in parts])).astype(np.int64)

    def flushed(lang: str) -> pa.RecordBatch:
        gram, n = merged(held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    for batch in batches:
        langs = batch.column(1).to_pylist()
        data, offsets = utf8(batch.column(0))
        for lo, hi in chunks(offsets):
            packed, bounds = grams(*code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            by: dict[str, list[np.ndarray]] = {}
            for lang, a, b in zip(langs[lo:hi], bounds[:-1], bounds[1:], strict=True):
                by.setdefault(lang, []).append(packed[a:b])
            for lang, parts in by.items():
                held.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
        for lang in list(held):
            if sum(len(x) for x, _ in held[lang]) > 1_000_000:
                held[lang] = [merged(held[lang])]
                if len(held[lang][0][0]) > 500_000:
                    yield flushed(lang)
    for lang in list(held):
        yield flushed(lang)


@dataclass
class Table:
    """Sorted hashes of n-grams with a row of values each."""

    hashes: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        hashes = mix(keys)
        order = np.argsort(hashes)
        bits = max(1, int(len(keys)).bit_length() + 1)
        shift = 64 - bits
        starts = np.searchsorted(hashes[order] >> np.uint64(shift), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(hashes[order], values[order].astype(np.float32), starts, shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        hashes = mix(keys)
        bucket = (hashes >> np.uint64(self.shift)).astype(np.int64)
        row, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        at = np.flatnonzero(row < end)
        row, end, hashes = row[at], end[at], hashes[at]
        while len(at):
            hit = self.hashes[row] == hashes
            out[at[hit]] = row[hit]
            row = row + 1
            more = ~hit & (row < end)
            at, row, end, hashes = at[more], row[more], end[more], hashes[more]
        return out


def _group(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(at, weights, minlength=len(kinds)).astype(np.float64)


def _at(keys: np.ndarray, among: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    if len(among) == 0:
        return np.full(len(keys), default)
    row = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return np.where(among[row] == keys, values[row], default)


@dataclass
class _Level:
    """One order of one language: discounted shares of n-grams and weights of contexts."""

    keys: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _levels(gram: np.ndarray, count: np.ndarray) -> list[_Level]:
    """Orders 1 to ORDER. Below the highest, counts are of the distinct letters seen before."""
    out, keys, counts = [], gram, count.astype(np.float64)
    for order in range(ORDER, 0, -1):
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        contexts, total = _group(keys >> _BITS, counts)
        _, kinds = _group(keys >> _BITS)
        shares = (counts - discount) / _at(keys >> _BITS, contexts, total, 1)
        out.append(_Level(keys, shares, contexts, discount * kinds / total))
        keys, counts = _group(keys & _MASK[order - 1])
    return out[::-1]


class Model:
    """Log-probabilities of all languages, a table for each order."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        levels = [_levels(*(x[np.argsort(counts[k][0])] for x in counts[k])) for k in self.langs]
        self.tables: list[Table] = []
        self.floor = np.log(1 / (1 << 16))
        #: What is left for letters that a language doesn't have.
        self.unseen = np.log([x[0].weights[0] for x in levels])
        for order in range(1, ORDER + 1):
            every = np.unique(np.concatenate([x[order - 1].keys for x in levels])) if levels else np.zeros(0, np.uint64)
            context = np.unique(np.concatenate([every, every, *(x[order].contexts for x in levels if order < ORDER)]))
            lower = self._backed(context, order - 1)
            share = np.stack([_at(context, x[order - 1].keys, x[order - 1].shares, 0.0) for x in levels], 1) if levels else np.zeros((0, 0))
            weight = np.stack([_at(context >> _BITS, x[order - 1].contexts, x[order - 1].weights, 1.0) for x in levels], 1) if levels else np.zeros((0, 0))
            own = np.log(share + weight * np.exp(lower))
            after = np.stack([np.log(_at(context, x[order].contexts, x[order].weights, 1.0)) for x in levels], 1) if levels and order < ORDER else np.zeros_like(own)
            self.tables.append(Table.of(context, np.concatenate([own, after], 1)))

    def _backed(self, keys: np.ndarray, order: int) -> np.ndarray:
        """log P of the last letter of each key by its last ``order`` letters."""
        size = len(self.langs)
        if order == 0:
            return np.full((len(keys), size), self.floor)
        keys = keys & _MASK[order]
        table = self.tables[order - 1]
        row = table.find(keys)
        out = table.values[row, :size] if len(table.values) else np.zeros((len(keys), size), np.float32)
        if len(at := np.flatnonzero(row < 0)):
            rest = self._backed(keys[at], order - 1)
            if order == 1:
                rest = rest + self.unseen
            else:
                context = self.tables[order - 2].find(keys[at] >> _BITS)
                rest = rest + np.where(context[:, None] >= 0, self.tables[order - 2].values[context, size:], 0)
            out[at] = rest
        return out

    def entropies(self, packed: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Cross-entropy per n-gram of each row under each language; 0 for rows without n-grams."""
        if not self.langs:
            return np.zeros((len(bounds) - 1, 0))
        total = np.zeros((len(packed) + 1, len(self.langs)))
        np.cumsum(self._backed(packed, ORDER), axis=0, out=total[1:])
        return -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, np.diff(bounds))[:, None]

    def scored(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """For each text its number of n-grams and its entropies."""
        data, offsets = utf8(column)
        for lo, hi in chunks(offsets):
            packed, bounds = grams(*code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            yield from zip(np.diff(bounds).tolist(), self.entropies(packed, bounds), strict=True)


@dataclass
class Tables:
    """The same probabilities as ``Model``'s, as rows (kind, key, lang, value):
    kind n the discounted shares of order n, kind -n the weights of its contexts."""

    langs: list[str]
    entries: DataFrame
    #: log-probability of a letter that a language doesn't have.
    base: list[float]

    @classmethod
    def of(cls, counts: DataFrame) -> Tables:
        level, entries = counts.select("lang", F.col("gram").alias("key"), F.col("n").cast("double").alias("c")), None
        for order in range(ORDER, 0, -1):
            once, twice = (F.count_if(F.col("c") == k) for k in (1, 2))
            discounts = level.groupBy("lang").agg(F.greatest(F.lit(0.1), F.least(F.lit(0.95), once / F.greatest(F.lit(1), once + 2 * twice))).alias("d"))
            above = level.withColumn("context", F.shiftrightunsigned("key", 16) if order > 1 else F.lit(0).cast("long"))
            contexts = above.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).join(F.broadcast(discounts), "lang")
            contexts = cut(contexts.select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("weight")))
            shares = above.join(contexts, ["lang", "context"]).select(F.lit(order).alias("kind"), "key", "lang", ((F.col("c") - F.col("d")) / F.col("total")).alias("value"))
            rows = shares.union(contexts.select(F.lit(-order), "context", "lang", "weight"))
            entries = rows if entries is None else entries.union(rows)
            if order > 1:
                level = cut(level.groupBy("lang", F.col("key").bitwiseAND((1 << 16 * (order - 1)) - 1).alias("key")).agg(F.count("*").cast("double").alias("c")))
        entries = cut(entries)
        base = {r["lang"]: float(np.log(r["value"] / (1 << 16))) for r in entries.where("kind = -1").collect()}
        return cls(sorted(base), entries, [base[x] for x in sorted(base)])

    def gains(self, grams: DataFrame) -> DataFrame:
        """(gram, lang, gain) of ``grams(gram)``: how far the log-probability lies
        above the base, for the languages in which it does."""
        key = lambda n: F.col("gram").bitwiseAND((1 << 16 * n) - 1) if n < ORDER else F.col("gram")
        wanted = [F.struct(F.lit(n).alias("kind"), key(n).alias("key")) for n in range(1, ORDER + 1)]
        wanted += [F.struct(F.lit(-n).alias("kind"), F.shiftrightunsigned(key(n), 16).alias("key")) for n in range(2, ORDER + 1)]
        found = grams.select("gram", F.explode(F.array(*wanted)).alias("x")).select("gram", "x.*").join(self.entries, ["kind", "key"])
        part = lambda kind, default: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("value"))), F.lit(default))
        floor = F.exp(F.element_at(F.create_map(*(F.lit(x) for pair in zip(self.langs, self.base, strict=True) for x in pair)), F.col("lang")))
        value = F.col("s1") + floor
        for n in range(2, ORDER + 1):
            value = F.col(f"s{n}") + F.col(f"w{n}") * value
        parts = [part(n, 0.0).alias(f"s{n}") for n in range(1, ORDER + 1)] + [part(-n, 1.0).alias(f"w{n}") for n in range(2, ORDER + 1)]
        return found.groupBy("gram", "lang").agg(*parts).select("gram", "lang", (F.log(value) - F.log(floor)).alias("gain"))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each row with their counts."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in chunks(offsets):
            packed, bounds = grams(*code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            found = [np.unique(packed[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rows = batch.column(0).take(pa.array(np.repeat(np.arange(lo, hi), [len(x) for x, _ in found])))
            yield pa.RecordBatch.from_arrays([rows, pa.array(np.concatenate([x for x, _ in found]).view(np.int64)), pa.array(np.concatenate([n for _, n in found]).astype(np.int64))], ["row", "gram", "n"])


def entropies(docs: DataFrame, model: Model | Tables, *columns: str) -> DataFrame:
    """``columns`` of ``docs(text)`` with n, the number of n-grams, and h, the
    cross-entropies per n-gram under the model's languages in order."""
    own = [F.col(c) for c in columns]
    if isinstance(model, Model):
        send = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, values = zip(*send.value.scored(batch.column(0)), strict=True) if batch.num_rows else ((), ())
                ends = np.arange(len(n) + 1, dtype=np.int32) * len(send.value.langs)
                h = pa.ListArray.from_arrays(ends, np.concatenate([*values, np.zeros(0)]))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), h], ["own", "n", "h"])

        rows = docs.select("text", F.struct(*own).alias("own"))
        return rows.mapInArrow(released(run), T.StructType([rows.schema["own"], T.StructField("n", T.LongType()), T.StructField("h", T.ArrayType(T.DoubleType()))])).select("own.*", "n", "h")
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "text", *own))
    counts = cut(rows.select("row", "text").mapInArrow(released(_gram_counts), "row long, gram long, n long"))
    gains = cut(model.gains(counts.select("gram").distinct()))
    sums = counts.join(gains, "gram").groupBy("row", "lang").agg(F.sum(F.col("n") * F.col("gain")).alias("gain")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("lang", "gain"))).alias("gain"))
    sizes = counts.groupBy("row").agg(F.sum("n").alias("n"))
    h = F.array(*(-(F.lit(b) + F.coalesce(F.element_at("gain", lang), F.lit(0.0)) / F.col("n")) for lang, b in zip(model.langs, model.base, strict=True)))
    return rows.drop("text").join(sizes, "row", "left").join(sums, "row", "left").select(*columns, F.coalesce("n", F.lit(0)).alias("n"), h.cast("array<double>").alias("h"))


@dataclass
class Trained:
    """A model with the usual cross-entropy of each of its languages and the bound for rejection."""

    model: Model | Tables
    usual: list[float]
    bound: list[float]


def train(docs: DataFrame, model_cells: int = MODEL_CELLS) -> Trained:
    """A model of ``docs(doc_id, text, lang)``: rows with a null text or lang, or
    held out by ``held_out``, aren't used. What comes to the driver are the
    counts of a model of up to ``model_cells``, and a row for each language."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~held_out(F.col("doc_id")))
    counts = cut(rows.select("text", "lang").mapInArrow(released(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    size, langs = counts.agg(F.count("*"), F.count_distinct("lang")).first()
    if size * langs > model_cells:
        return calibrated(Tables.of(counts), rows)
    table = counts.toArrow().combine_chunks()
    names = table["lang"].combine_chunks().dictionary_encode() if size else pa.array([], pa.string()).dictionary_encode()
    which, gram, n = names.indices.to_numpy(), table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    return calibrated(Model({x: (gram[which == k], n[which == k]) for k, x in enumerate(names.dictionary.to_pylist())}), rows)


def calibrated(model: Model | Tables, rows: DataFrame) -> Trained:
    """Sets the usual cross-entropy of each language and the bound for rejection, from all ``rows``."""
    langs = F.array(*map(F.lit, model.langs)).cast("array<string>")
    own = cut(entropies(rows, model, "lang").where("n > 0").select("lang", "n", F.element_at("h", F.nullif(F.array_position(langs, F.col("lang")).cast("int"), F.lit(0))).alias("h")))
    weight = F.least("n", F.lit(500))
    usual = own.groupBy("lang").agg((F.sum(F.col("h") * weight) / F.sum(weight)).alias("usual"))
    excess = (F.col("h") - F.col("usual")) * F.sqrt("n")
    found = {r["lang"]: r for r in own.join(F.broadcast(usual), "lang").groupBy("lang").agg(F.first("usual").alias("usual"), F.percentile_approx(excess, 0.999, 100_000).alias("far")).collect()}
    known = [found.get(x) for x in model.langs]
    return Trained(model, [r["usual"] if r else 0.0 for r in known], [max(8.0, MARGIN * r["far"]) if r else float("inf") for r in known])


def identify(docs: DataFrame, trained: Trained) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of ``docs(doc_id, text)``.

    lang_pred is the language of the lowest cross-entropy per character (the
    first by name among equals), ``und`` with score 0 for a null text, one
    without letters, or a model without languages. score tells how far the
    other languages lie behind, 0 to 1. rejected marks ``und`` and texts of
    unlikely cross-entropy. Texts are read whole; a repeated row gives a row
    each; other columns are ignored.
    """
    found = entropies(docs, trained.model, "doc_id").withColumn("entropy", F.when(F.col("n") > 0, F.array_min("h")))
    found = found.withColumn("best", F.coalesce(F.array_position("h", F.col("entropy")), F.lit(0)).cast("int"))
    known = F.col("best") > 0
    of = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.when(known, F.col("best")))
    behind = F.aggregate("h", F.lit(0.0), lambda total, h: total + F.exp((F.col("entropy") - h) * F.least("n", F.lit(40))))
    usual, bound = of(trained.usual, "double"), of(trained.bound, "double")
    far = ((F.col("entropy") - usual) * F.sqrt("n") > bound) & (F.col("entropy") > LEAST_RATIO * usual)
    return found.select("doc_id", F.coalesce(of(trained.model.langs, "string"), F.lit(UNKNOWN)).alias("lang_pred"), F.when(known, 1 / behind).otherwise(0.0).alias("score"), F.when(known, F.col("entropy")).alias("entropy"), F.coalesce(far, F.lit(True)).alias("rejected"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told with confidence, all columns kept."""
    found = identify(docs, train(docs))
    # one row among repeated ids may be rejected for its own text only
    bad = cut(found.groupBy("doc_id").agg(F.bool_and("rejected").alias("rejected")).where("rejected").select("doc_id"))
    return without_ids(docs, bad, "doc_id")
