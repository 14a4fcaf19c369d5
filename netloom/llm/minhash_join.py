"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A coordinate of a signature joins ``ROWS`` minimum hashes, so two sets with
Jaccard similarity j agree in one with probability j ** ROWS. Documents are
posted under each (coordinate, value) pair. Two sets of similarity 0.75 share
2 or fewer of the 48 coordinates with a probability of 3e-6, so pairs below
``MATCHES`` = 3 collisions are not confirmed, and by the prefix rule the last
``MATCHES - 1`` coordinates need no postings: a pair with 3 matches has one
among the first 46.

Posting lists up to ``SHORT`` long give all their pairs. For longer ones, which
hold large groups of copies, pairs grow with the square, so the list skips:
every member is compared to the list's head only, the member that shares most
postings; members it leaves in other components get a head of their own. What
then is still apart from its list's head can only be linked by single pairs,
and these are found exactly. Let x be apart from the head h, and y another
member. A link needs 3/7 of both sizes in common, x has less than 3/7 of its
and h's size in common with h. So either y has fewer shingles than h, by as
much as x fails to be linked to h, or x and y share a shingle outside h. The
first kind is joined by size. For the second, the shingles outside h get an
inverted join with a prefix filter: members are posted under their rarest
ones, as many as they may have beyond those that a link needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.components import components
from netloom.llm.lineage import cut, cut_narrow, with_ids
from netloom.llm.text import mix, released, shingle_sets

SHINGLE_WORDS = 5
COORDINATES = 48
ROWS = 4
MATCHES = 3
SHORT = 3
PERCENT = 75

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 32, COORDINATES * ROWS, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _random.integers(0, 1 << 32, COORDINATES * ROWS, dtype=np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The coordinates of a set of 64-bit hashes, each a 64-bit value that tells
    the coordinate's number too."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = x[None, i : i + 2048] * _FACTORS[:, None]
        part += _OFFSETS[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    out = np.arange(COORDINATES, dtype=np.uint64)
    for row in least.reshape(COORDINATES, ROWS).T:
        out = mix(out + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*values, np.zeros(0, np.uint64)]).view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature) of ``docs(doc_id, text)``.

    set_a and set_b are 128 bits of a hash of the whole set. An empty set (no
    text, or no words) has an empty signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, whole, signs = [], [], []
            for hashes in shingle_sets(batch.column(1), SHINGLE_WORDS):
                size.append(len(hashes))
                whole.append(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64))
                signs.append(signature(hashes) if len(hashes) else np.zeros(0, np.uint64))
            a, b = np.array(whole, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(a), pa.array(b), _lists(signs)], ["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_shingles long, set_a long, set_b long, signature array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(shingle_sets(batch.column(1), SHINGLE_WORDS)))], ["id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "id long, hashes array<long>")


def _linked(common: Column, x: str = "n_x", y: str = "n_y") -> Column:
    return 100 * common >= PERCENT * (F.col(x) + F.col(y) - common)


_SIMILAR_SIZE = "100 * least(n_x, n_y) >= {0} * greatest(n_x, n_y)".format(PERCENT)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(x, y)`` with sizes and the common shingles of the full sets."""
    # a head with very many members is a skewed key of the second join, which Spark splits
    x = sets.select(F.col("id").alias("x"), F.col("hashes").alias("h_x"), F.size("hashes").alias("n_x"))
    y = sets.select(F.col("id").alias("y"), F.col("hashes").alias("h_y"), F.size("hashes").alias("n_y"))
    return pairs.join(x, "x").join(y, "y").withColumn("common", F.size(F.array_intersect("h_x", "h_y")).cast("long"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets are linked, as (a, b)."""
    return cut_narrow(_compared(pairs, sets).where(_SIMILAR_SIZE).where(_linked(F.col("common"))).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _heads(members: DataFrame) -> DataFrame:
    """(key, head) of ``members(key, id)``: the one under most and longest lists."""
    length = members.groupBy("key").agg(F.count("*").alias("length"))
    weight = members.join(length, "key").groupBy("id").agg(F.sum("length").alias("weight"))
    return cut_narrow(members.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("head")))


def _stars(members: DataFrame, heads: DataFrame) -> DataFrame:
    return members.join(heads, "key").where("id <> head").select(F.col("id").alias("x"), F.col("head").alias("y")).distinct()


def _apart(members: DataFrame, heads: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, group) of the members that are in other components than their
    list's head, and (key, head, group) of the heads."""
    named = lambda c, to: groups.select(F.col("node").alias(c), F.col("component").alias(to))
    heads = cut_narrow(heads.join(named("head", "own"), "head", "left").select("key", "head", F.coalesce("own", "head").alias("group")))
    own = members.join(named("id", "own"), "id", "left").select("key", "id", F.coalesce("own", "id").alias("group"))
    apart = own.join(heads.select("key", F.col("group").alias("head_group")), "key").where("group <> head_group")
    return cut_narrow(apart.select("key", "id")), heads


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between ``classes(id, n, signature)`` of different sets, each
    confirmed on the full sets of ``docs(doc_id, text)``; they join the same
    components as all links do."""
    key = F.explode(F.slice("signature", 1, COORDINATES - MATCHES + 1)).alias("key")
    posted = classes.select("id", "n", key)
    # lengths are combined before they are shuffled, and Spark splits the join where a list is very long
    lengths = cut_narrow(posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1"))
    shared = cut_narrow(posted.join(lengths, "key"))
    short = shared.where(F.col("length") <= SHORT)
    x, y = short.select("key", F.col("id").alias("x"), F.col("n").alias("n_x")), short.select("key", F.col("id").alias("y"), F.col("n").alias("n_y"))
    pairs = x.join(y, "key").where("x < y").where(_SIMILAR_SIZE).select("x", "y").distinct()
    sign = classes.select("id", "signature")
    same = F.aggregate(F.zip_with("s_x", "s_y", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, hit: n + hit)
    signed = pairs.join(sign.select(F.col("id").alias("x"), F.col("signature").alias("s_x")), "x").join(sign.select(F.col("id").alias("y"), F.col("signature").alias("s_y")), "y")
    pairs = cut_narrow(signed.where(same >= MATCHES).select("x", "y"))

    members = cut_narrow(shared.where(F.col("length") > SHORT).select("key", "id"))
    heads = _heads(members)
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).union(members.select("id")).distinct()
    sets = cut(_sets(with_ids(docs, cut_narrow(ids), "doc_id")))
    found = _confirmed(pairs.union(_stars(members, heads)).distinct(), sets)
    if members.isEmpty():
        return found
    apart, _ = _apart(members, heads, components(found))
    found = cut_narrow(found.union(_confirmed(_stars(apart, _heads(apart)), sets)))
    apart, heads = _apart(members, heads, components(found))
    # heads of one component give way to the one with most lists: what follows holds for any head
    count = heads.groupBy("group", "head").agg(F.count("*").alias("lists"))
    chosen = count.groupBy("group").agg(F.max_by("head", F.struct("lists", -F.col("head"))).alias("chosen"))
    heads = cut_narrow(heads.join(apart.select("key").distinct(), "key", "left_semi").join(chosen, "group").select("key", F.col("chosen").alias("y")))
    beside = members.join(heads, "key").select("y", F.col("id").alias("x")).where("x <> y").distinct()
    away = apart.join(heads, "key").select("y", F.col("id").alias("x"), F.lit(True).alias("apart")).distinct()
    beside = cut_narrow(beside.join(away, ["y", "x"], "left").select("x", "y", F.coalesce("apart", F.lit(False)).alias("apart")))
    return found.union(_confirmed(_beside_heads(beside, sets), sets))


def _beside_heads(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) of ``members(x, y: their head, apart)`` that can be linked though x is apart."""
    rest = F.array_except("h_x", "h_y").alias("rest")
    rows = cut(_compared(members, sets).select(F.col("y").alias("head"), F.col("x").alias("id"), F.col("n_x").alias("n"), F.col("n_y").alias("n_head"), "common", "apart", rest))
    named = lambda k, *more: ["head", *(F.col(c).alias(f"{c}_{k}") for c in ("n", "common", "apart")), F.col("id").alias(k), *more]
    direct = rows.where("apart").where(_linked(F.col("common"), "n", "n_head")).select(F.col("id").alias("x"), F.col("head").alias("y"))
    needed = F.ceil(PERCENT * (F.col("n_x") + F.col("n_y")) / F.lit(100 + PERCENT))

    # smaller than the head: sizes from what x allows at least to what it has in common at most
    most = F.floor(F.col("common") * F.lit(100 + PERCENT) / PERCENT) - F.col("n")
    sizes = rows.select("head", F.col("n").alias("size")).distinct()
    small = rows.where("apart").withColumn("most", most).join(sizes, "head").where(F.col("size") <= F.col("most")).where(100 * F.col("size") >= PERCENT * F.col("n"))
    small = cut_narrow(small.select(*named("x"), "size")).join(rows.select(*named("y", F.col("n").alias("size"))), ["head", "size"])
    small = small.where("x <> y and (not apart_y or x < y or n_y < n_x)").where(F.least("common_x", "common_y") >= needed)

    shingles = cut_narrow(rows.select("head", "id", "n", "common", "apart", F.explode("rest").alias("shingle")))
    often = cut_narrow(shingles.groupBy("head", "shingle").agg(F.count("*").alias("often")).where("often > 1"))
    kept = shingles.join(often, ["head", "shingle"]).groupBy("head", "id", "n", "common", "apart").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    # a link needs 75 % of either set, so this many outside the head; shingles of one member only come first and match nothing
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * PERCENT / 100) - F.col("common"))
    size = F.col("n") - F.col("common") - least + 1 - (F.col("n") - F.col("common") - F.size("s"))
    posted = cut_narrow(kept.withColumn("size", size.cast("int")).where("size > 0").select("head", "id", "n", "common", "apart", F.explode(F.slice("s", 1, F.col("size"))["shingle"]).alias("shingle")))
    shared = posted.where("apart").select(*named("x", "shingle")).join(posted.select(*named("y", "shingle")), ["head", "shingle"])
    shared = shared.where("x <> y and (not apart_y or x < y)").where(_SIMILAR_SIZE)
    return direct.union(small.select("x", "y")).union(shared.select("x", "y")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs(doc_id, text)``.

    Words are cut at blanks after lower-casing A-Z. A document's set holds its
    distinct runs of five words; with fewer words, the whole sequence as one;
    with no text or no words it is empty and linked with nothing. Two documents
    are linked if their sets' Jaccard similarity is 0.75 or more; component_id
    is the smallest doc_id reachable over links, kept tells whether it is the
    document's own (null for a null doc_id). Other columns of ``docs`` are
    ignored; a repeated doc_id gives a row for each of its rows; an empty table
    gives none.
    """
    signed = cut(signatures(docs))
    whole = ["set_a", "set_b", "n_shingles"]
    classes = cut(signed.where("n_shingles > 0").groupBy(*whole).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")).withColumnRenamed("n_shingles", "n"))
    groups = components(links(docs, classes.select("id", "n", "signature")))
    named = cut_narrow(classes.join(groups, classes["id"] == groups["node"], "left").select("set_a", "set_b", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")))
    filled = signed.where("n_shingles > 0").select("doc_id", *whole).join(named, whole).select("doc_id", "n_shingles", "component_id")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.union(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is kept by ``near_duplicates``."""
    from netloom.llm.lineage import without_ids

    return without_ids(docs, cut(near_duplicates(docs).where("not kept").select("doc_id").distinct()), "doc_id")
