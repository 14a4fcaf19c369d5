"""How far the sources of a language differ in the terms that they use.

Two passes over the texts. The first counts, exactly, in how many documents of
its language a term stands; those in at least ``LEAST_DOCUMENTS`` are kept and
placed by minimal perfect hashes, in shards. The second pass looks every term
up, checks it against the slot's stored key and adds to dense slots, one array
for each (lang, source) group. Hashes of up to ``BROADCAST_BYTES`` are sent to
the tasks of the second pass; larger ones stay where they were built, and the
terms, counted by then, are dealt to their shards. Both ways give the same.

All divergences come from the dense slots of one shard at a time, for all
sources of its language, and are sums over shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.lineage import cut
from netloom.llm.perfect_hash import Shards, build, shard_of, term_hashes
from netloom.llm.text import chunks, lower, released, spans, utf8

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
RANKS = 200
#: Terms of a shard on average, over all languages.
SHARD_TERMS = 16_384
#: Hashes and keys that are sent to tasks.
BROADCAST_BYTES = 48 << 20
#: Dense slots of a task; above, they are packed: only the counts that are not 0 stay.
DENSE_BYTES = 80 << 20
#: Packed counts of a task before they are given on.
PACKED_BYTES = 96 << 20
#: Rows that a task of the first pass gathers before they are given on.
GATHERED_ROWS = 1 << 19
#: Text that is split into terms at once.
CHUNK_BYTES = 2 << 20
#: Sources whose divergences from all others are computed at once.
TILE = 32

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code) of each term of some texts, and the distinct terms by code."""
    letter = _LETTER[data]
    start, end = spans(letter, offsets)
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    column = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(lower(data)[letter])]).dictionary_encode()
    return np.searchsorted(offsets, start, side="right") - 1, np.asarray(column.indices).astype(np.int64), column.dictionary


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between terms."""
    while len(data) > CHUNK_BYTES:
        gaps = np.flatnonzero(~_LETTER[data[CHUNK_BYTES : 2 * CHUNK_BYTES]])
        cut_at = CHUNK_BYTES + int(gaps[0]) if len(gaps) else len(data)
        yield data[:cut_at]
        data = data[cut_at:]
    yield data


def _chunks(texts: pa.Array, whole_rows: bool) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """``_terms`` of ranges of texts, rows counted from the first text. With
    ``whole_rows`` a long text is one range that names each of its terms once."""
    data, offsets = utf8(texts)
    for lo, hi in chunks(offsets, CHUNK_BYTES):
        part = data[offsets[lo] : offsets[hi]]
        if len(part) <= 2 * CHUNK_BYTES:
            row, code, terms = _terms(part, offsets[lo : hi + 1] - offsets[lo])
            yield row + lo, code, terms
            continue
        pieces = (_terms(x, np.array([0, len(x)])) for x in _pieces(part))
        if whole_rows:
            terms = pa.chunked_array([t for _, _, t in pieces], pa.large_string()).unique()
            yield np.full(len(terms), lo), np.arange(len(terms)), terms
        else:
            for row, code, terms in pieces:
                yield row + lo, code, terms


def _counted(columns: list[str], whole_rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (*columns, term, n): in how many rows a term stands (``whole_rows``), or how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            groups = pa.table({c: batch.column(i).cast(pa.large_string()) for i, c in enumerate(columns)})
            kinds = groups.group_by(columns).aggregate([])
            number = {tuple(r.values()): k for k, r in enumerate(kinds.to_pylist())}
            own = np.array([number[r] for r in zip(*(groups.column(c).to_pylist() for c in columns), strict=True)], np.int64)
            for row, code, terms in _chunks(batch.column(len(columns)), whole_rows):
                if whole_rows and len(row):
                    row, code = np.divmod(np.unique(row * len(terms) + code), len(terms))
                pairs, n = np.unique(own[row] * max(1, len(terms)) + code, return_counts=True)
                group, code = np.divmod(pairs, max(1, len(terms)))
                held.append(pa.table({**{c: kinds.column(c).take(pa.array(group)) for c in columns}, "term": terms.take(pa.array(code)), "n": pa.array(n, pa.int64())}))
                if sum(map(len, held)) > GATHERED_ROWS:
                    held = [_added(held, columns)]
                    if len(held[0]) > GATHERED_ROWS // 2:
                        yield from held.pop().to_batches(50_000)
        if held:
            yield from _added(held, columns).to_batches(50_000)

    return run


def _added(tables: list[pa.Table], columns: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by([*columns, "term"]).aggregate([("n", "sum")]).rename_columns([*columns, "term", "n"]).combine_chunks()


def _placed(terms: DataFrame, shards: int) -> DataFrame:
    """``terms`` with the shard of each term."""
    names = terms.columns
    at = names.index("term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(term_hashes(batch.column(at)), shards))], [*names, "shard"])

    return terms.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in terms.dtypes) + ", shard long")


def _built(key: tuple, rows: pa.Table) -> pa.Table:
    terms = rows.column("term").combine_chunks().cast(pa.large_string())
    sizes, bits, order = build(term_hashes(terms))
    return pa.table({"lang": [key[0].as_py()], "shard": [key[1].as_py()], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": pa.array([bits], pa.binary()), "keys": pa.array([terms.take(pa.array(order)).to_pylist()], pa.list_(pa.string()))})


def perfect_hashes(rows: DataFrame) -> tuple[DataFrame, int]:
    """((lang, shard, sizes, bits, keys), number of shards) of the terms that
    stand in ``LEAST_DOCUMENTS`` of their language's ``rows(lang, source, text)``."""
    counts = rows.select("lang", "text").mapInArrow(released(_counted(["lang"], True)), "lang string, term string, n long")
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS).select("lang", "term"))
    shards = max(1, -(-kept.count() // SHARD_TERMS))
    built = _placed(kept, shards).groupBy("lang", "shard").applyInArrow(_built, "lang string, shard long, sizes array<long>, bits binary, keys array<string>")
    return cut(built), shards


_PARTS = "lang string, source string, shard long, total long, at binary, n binary"


def _part(lang: str, source: str, shard: int, at: np.ndarray, n: np.ndarray) -> tuple | None:
    return (lang, source, shard, int(n.sum()), at.astype(np.int32).tobytes(), n.astype(np.int64).tobytes()) if len(at) else None


def _dense_part(lang: str, source: str, shard: int, counts: np.ndarray) -> tuple | None:
    at = np.flatnonzero(counts)
    return _part(lang, source, shard, at, counts[at])


def _batches(rows: list[tuple | None]) -> Iterator[pa.RecordBatch]:
    rows = [r for r in rows if r is not None]
    if rows:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "source", "shard", "total", "at", "n"])


def _recounted(hashes: Callable[[], Shards], shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The second pass with the hashes at hand: rows of ``_PARTS``, several for a group and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hashes()
        of_lang: dict[str, np.ndarray] = {}  # index of each shard of a language
        for i, (lang, shard) in enumerate(zip(table.langs, table.numbers, strict=True)):
            of_lang.setdefault(lang, np.full(shards, -1, np.int64))[shard] = i
        base = {lang: int(table.first[x[x >= 0][0]]) for lang, x in of_lang.items()}
        width = {lang: int(sum(table.first[i + 1] - table.first[i] for i in x if i >= 0)) for lang, x in of_lang.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}
        packed: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = 0

        def pack() -> int:
            """Adds the dense counts to the packed ones; the bytes of these."""
            for name, counts in dense.items():
                at = np.flatnonzero(counts)
                before, n = packed.get(name, none)
                slots, place = np.unique(np.concatenate([before, at]), return_inverse=True)
                packed[name] = slots, np.bincount(place, np.concatenate([n, counts[at]]), len(slots)).astype(np.int64)
            dense.clear()
            return sum(16 * len(at) for at, _ in packed.values())

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (at, n) in packed.items():
                rows = []
                for s, i in enumerate(of_lang[lang].tolist()):
                    if i >= 0:
                        first = table.first[i] - base[lang]
                        lo, hi = np.searchsorted(at, [first, table.first[i + 1] - base[lang]])
                        rows.append(_part(lang, source, s, at[lo:hi] - first, n[lo:hi]))
                yield from _batches(rows)
            packed.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kinds = {k: i for i, k in enumerate(dict.fromkeys(zip(langs, sources, strict=True)))}
            names = list(kinds)
            spoken = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
            own = np.array([kinds[k] for k in zip(langs, sources, strict=True)], np.int64)
            speech = np.array([spoken[lang] for lang in langs], np.int64)
            for row, code, terms in _chunks(batch.column(2), False):
                if len(row) == 0:
                    continue
                # each term once for each language that it stands in
                used, back = np.unique(speech[row] * len(terms) + code, return_inverse=True)
                lang_of, term_of = np.divmod(used, len(terms))
                words = terms.take(pa.array(term_of))
                hashed = term_hashes(words)
                shard = shard_of(hashed, shards)
                place = np.full(len(used), -1, np.int64)
                for lang, i in spoken.items():
                    if lang in of_lang:
                        mine = lang_of == i
                        place[mine] = of_lang[lang][shard[mine]]
                slot = table.find(place, hashed, words)[back]
                known = slot >= 0
                pairs, n = np.unique(own[row[known]] * (int(table.first[-1]) + 1) + slot[known], return_counts=True)
                group, slot = np.divmod(pairs, int(table.first[-1]) + 1)
                edges = np.flatnonzero(np.diff(group, prepend=-1))
                for lo, hi in zip(edges, [*edges[1:], len(group)], strict=True):
                    name = names[group[lo]]
                    if name not in dense:
                        dense[name] = np.zeros(width[name[0]], np.uint32)
                        held += dense[name].nbytes
                    dense[name][slot[lo:hi] - base[name[0]]] += n[lo:hi].astype(np.uint32)
                if held > DENSE_BYTES:
                    held = 0
                    if pack() > PACKED_BYTES:
                        yield from given()
        pack()
        yield from given()

    return run


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Stretches of rows that agree in ``columns``."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    lo = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[lo]:
            yield keys[lo], lo, i
            lo = i


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second pass with terms dealt to their shards: rows sorted by lang,
    shard and source, a shard's hash before its terms."""
    table, key, counts = None, None, None
    for batch in batches:
        for (lang, shard, source), lo, hi in _runs(batch, ["lang", "shard", "source"]):
            if (lang, shard, source) != key:
                if counts is not None:
                    yield from _batches([_dense_part(key[0], key[2], key[1], counts)])
                key, counts = (lang, shard, source), None
            if source is None:
                table = lang, shard, Shards(pa.Table.from_batches([batch.slice(lo, 1)]))
                continue
            if table is None or table[:2] != (lang, shard):
                continue  # no term of this shard is kept
            if counts is None:
                counts = np.zeros(int(table[2].first[-1]), np.int64)
            terms = batch.column("term").slice(lo, hi - lo)
            slot = table[2].find(np.zeros(hi - lo, np.int64), term_hashes(terms), terms)
            known = slot >= 0
            np.add.at(counts, slot[known], np.asarray(batch.column("n").slice(lo, hi - lo))[known])
    if counts is not None:
        yield from _batches([_dense_part(key[0], key[2], key[1], counts)])


def recount(rows: DataFrame, hashes: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (lang, source, shard, total, at, n): counts n (64 bits each) of the
    slots at (32 bits each), one or more rows for a group and shard, to be added up."""
    size = hashes.agg(F.coalesce(F.sum(F.length("bits") + F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 8)), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        sent = rows.sparkSession.sparkContext.broadcast(hashes.orderBy("lang", "shard").toArrow())
        return rows.select("lang", "source", "text").mapInArrow(released(_recounted(lambda: Shards(sent.value), shards)), _PARTS)
    counts = rows.select("lang", "source", "text").mapInArrow(released(_counted(["lang", "source"], False)), "lang string, source string, term string, n long")
    counts = _placed(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), shards)
    both = hashes.unionByName(counts, allowMissingColumns=True)
    return both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.asc_nulls_first("source")).mapInArrow(_dealt, _PARTS)


def scaled(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for totals up to 9e15."""
    whole = total + kept
    if whole > (1 << 63) // 1000:
        raise OverflowError("more than 9e15 terms in a group")
    quotient, rest = np.divmod(counts + 1, whole)
    for _ in range(3):  # SCALE is 1000 ** 3
        digit, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digit
    return quotient + 1


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _judged(head: dict, counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of one shard: each pair's share of its divergence, and the terms that may rank."""
    sources, totals, kept = head["sources"], head["totals"], head["kept"]
    keys = pa.array(head["keys"], pa.string())
    none = np.zeros(len(keys), np.int64)
    p = np.stack([scaled(counts.get(s, none), t, kept) for s, t in zip(sources, totals, strict=True)])
    base = scaled(sum(counts.values(), none), sum(totals), kept)
    names = pa.array(sources, pa.string())
    for lo in range(0, len(sources), TILE):
        part = np.stack([_far(row[None, :], p).sum(axis=1) for row in p[lo : lo + TILE]])
        mine = np.repeat(np.arange(lo, lo + len(part)), len(sources))
        other = np.tile(np.arange(len(sources)), len(part))
        keep = mine != other
        yield _values(head["lang"], names.take(pa.array(mine[keep])), "pair", names.take(pa.array(other[keep])), part.ravel()[keep])
    for source, own in zip(sources, p, strict=True):
        if source not in counts:
            continue
        at = np.flatnonzero((counts[source] > 0) & (own > base))
        value = _far(own[at], base[at])
        if len(at) > RANKS:  # no other term of this shard can rank; ties stay
            enough = value >= np.partition(value, -RANKS)[-RANKS]
            at, value = at[enough], value[enough]
        if len(at):
            yield _values(head["lang"], pa.array([source] * len(at), pa.string()), "term", keys.take(pa.array(at)), value)


_VALUES = "lang string, source string, part string, item string, value long"


def _values(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(item), pa.string()), source, pa.array([part] * len(item), pa.string()), item, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lang and shard, a shard's head (without a source) before its counts."""
    head, counts = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["source"] is None:
                if head is not None:
                    yield from _judged(head, counts)
                head, counts = row, {}
                continue
            dense = counts.setdefault(row["source"], np.zeros(len(head["keys"]), np.int64))
            dense[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["n"], np.int64)
    if head is not None:
        yield from _judged(head, counts)


def divergences(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(text, lang, source)``.

    Part ``pair``: how far a source's use of its language's kept terms is from
    that of each other source. Part ``term``: the ``RANKS`` terms that a source
    uses most beyond its language's use. See ``scaled`` and ``_far`` for the
    values, which are whole numbers and exact. Ties rank by the item's bytes.

    Null texts, languages and sources are empty strings, which are groups like
    others; a group without terms has zero counts, a language without kept terms
    gives its pairs with value 0; a language of one source has no pairs. Each row
    is a document of its own, whatever its id. A text may have any length. An empty
    table gives no rows; other columns are ignored. Sums of values fit 64 bits,
    as the p of a group add up to no more than SCALE plus the number of terms.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(named("lang"), named("source"), named("text"))
    hashes, shards = perfect_hashes(rows)
    parts = cut(recount(rows, hashes, shards, broadcast_bytes))
    totals = parts.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    of_lang = cut(groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g")).select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals")))
    kept = hashes.groupBy("lang").agg(F.sum(F.size("keys")).alias("kept"))
    heads = hashes.select("lang", "shard", "keys").join(of_lang, "lang").join(kept, "lang")
    every = heads.unionByName(parts.drop("total"), allowMissingColumns=True)
    values = cut(every.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.asc_nulls_first("source")).mapInArrow(released(_compared), _VALUES))
    pairs = of_lang.select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.explode("sources").alias("item")).where("source <> item")
    zeros = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = values.where("part = 'pair'").unionByName(zeros).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(values.where("part = 'term'")).where(F.col("rank") <= RANKS))
