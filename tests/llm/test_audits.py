"""Divergences of sources, filters in all orders and mixes, against their SQL over odd rows and plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import filter_audit, perfect_hash, source_divergence, source_mix, sql
from tests.compare import FOLDER, check
from tests.llm.test_edge_cases import CLASHING, LONG, documents

SHOUTING = "BUY NOW " * 40
NAMES = ["lang", "part", "term", "n", "size", "key", "h", "digest", "own", "words", "good", "toxic", "mask", "rank", "shard", "total", "x", "target"]


def odd(spark: SparkSession, folder: Path) -> str:
    """Documents with nulls in every column, copies, repeated ids, ties and a long text; labels with nulls and repeats."""
    rng = random.Random(5)
    texts = [None, "", " \t", LONG, SHOUTING, "été 中文 Ünï Xİ", "same words here", "same words here", "price $5 & more", "x" * 3000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"]), rng.choice([None, "", "a", "b", "é"])) for _ in range(150)]
    rows += [(k, " ".join(rng.choice("alpha beta Gamma delta".split()) for _ in range(60)), "en", rng.choice("abc")) for k in range(50, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in {*CLASHING, *NAMES} - {"lang"}})
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(rng.choice([None, *range(90)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x")).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tables(spark: SparkSession, tmp_path_factory: pytest.TempPathFactory) -> tuple[DataFrame, DataFrame, str]:
    folder = odd(spark, tmp_path_factory.mktemp("odd"))
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flat = tmp_path_factory.mktemp("flat")
    docs.toPandas().to_parquet(f"{flat}/documents.parquet")
    labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}).to_parquet(f"{flat}/labels.parquet")
    return docs, labels, str(flat)


# divergences


@pytest.mark.parametrize("sent", [0, source_divergence.BROADCAST_BYTES])
def test_divergences_of_odd_rows(tables: tuple, sent: int) -> None:
    docs, _, folder = tables
    assert check(source_divergence.divergences(docs, sent), sql.OP11, folder) > 20


def test_dealt_hashes_give_the_same(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Many small shards, dense slots given on early, long texts in pieces."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, value in {"SHARD_TERMS": 100, "DENSE_BYTES": 4000, "PACKED_BYTES": 20_000, "CHUNK_BYTES": 3000, "GATHERED_ROWS": 500, "TILE": 3}.items():
        monkeypatch.setattr(source_divergence, name, value)
    for sent in (0, 1 << 30):
        assert check(source_divergence.divergences(docs, sent), sql.OP11)


def test_scaled_is_exact() -> None:
    rng = random.Random(1)
    for _ in range(300):
        total, kept = rng.randrange(1, 9 * 10**15), rng.randrange(1, 10**9)
        counts = [0, total, *(rng.randrange(total) for _ in range(5))]
        if total + kept <= (1 << 63) // 1000:
            assert source_divergence.scaled(np.array(counts, np.int64), total, kept).tolist() == [1 + 10**9 * (c + 1) // (total + kept) for c in counts]
    with pytest.raises(OverflowError):
        source_divergence.scaled(np.zeros(1, np.int64), 10**17, 5)


def test_perfect_hashes_are_minimal_and_check_keys(monkeypatch: pytest.MonkeyPatch) -> None:
    """Also where many terms have one hash."""
    words = pa.array([f"w{i}é" for i in range(5000)], pa.large_string())
    foreign = pa.array([f"v{i}" for i in range(5000)], pa.large_string())
    for weak in (False, True):
        hashes = lambda terms: perfect_hash.term_hashes(terms) % np.uint64(700) if weak else perfect_hash.term_hashes(terms)  # noqa: B023, E731
        shard = perfect_hash.shard_of(hashes(words), 7)
        rows = []
        for s in range(7):
            own = words.take(pa.array(np.flatnonzero(shard == s)))
            sizes, bits, order = perfect_hash.build(hashes(own))
            rows.append({"lang": "en", "shard": s, "sizes": sizes, "bits": bits, "keys": own.take(pa.array(order)).to_pylist()})
        table = perfect_hash.Shards(pa.Table.from_pylist(rows))
        slots = table.find(shard, hashes(words), words)
        assert sorted(slots.tolist()) == list(range(5000))
        assert [table.keys[s].as_py() for s in slots.tolist()] == words.to_pylist()
        assert (table.find(perfect_hash.shard_of(hashes(foreign), 7), hashes(foreign), foreign) == -1).all()


# filters


def test_audit_of_odd_rows(tables: tuple) -> None:
    docs, labels, folder = tables
    assert check(filter_audit.audit(docs, labels), sql.OP12, folder) == 600 * docs.fillna("", ["source"]).select("source").distinct().count()


def test_potentials_equal_all_orders(spark: SparkSession) -> None:
    rng = random.Random(3)
    masks = [rng.choices(range(32), k=rng.randrange(1, 60)) for _ in range(20)]
    games = [[sum(m & s != 0 for m in g) for s in range(32)] for g in masks]
    got = [r["p"] for r in spark.createDataFrame([(k, v) for k, v in enumerate(games)], "k int, v array<long>").select("k", filter_audit.potentials(F.col("v")).alias("p")).orderBy("k").collect()]
    for v, p in zip(games, got, strict=True):
        for i in range(5):
            marginal = 0
            for order in permutations(range(5)):
                before = sum(1 << x for x in order[: order.index(i)])
                marginal += v[before | 1 << i] - v[before]
            assert p[31] - p[31 - (1 << i)] == marginal


# mixes


def shares(sizes: dict) -> dict:
    """Targets by sharing the excess out again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        each = rest / sum(weight[s] for s in free) if free else 0.0
        above = [s for s in free if each * weight[s] > 2 * sizes[s]]
        if not above:
            return capped | {s: each * weight[s] for s in free}
        for s in above:
            capped[s] = 2.0 * sizes[s]
            rest -= capped[s]


def plain_rates(sizes: list[int], target: float) -> list[float]:
    """Rates min(2, exp(x * size)) that meet a target, by halving an interval."""
    if target >= 2 * sum(sizes):
        return [2.0 if target else 0.0] * len(sizes)
    rates = lambda x: [2.0 if x * s > math.log(2) else math.exp(max(-700, x * s)) for s in sizes]
    lo, hi = -800.0, 1.0
    for _ in range(200):
        x = (lo + hi) / 2
        lo, hi = (lo, x) if sum(map(math.prod, zip(rates(x), sizes, strict=True))) > target else (x, hi)
    return rates(hi)


def expect_mix(docs: DataFrame) -> None:
    rows = docs.select("doc_id", "text", "source").collect()
    words = lambda t: len([w for w in (t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w])
    by_source: dict = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append((r["doc_id"], words(r["text"])))
    total = {s: sum(n for _, n in d) for s, d in by_source.items()}
    target = shares(total)
    got = source_mix.mixed(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r["doc_id"], words(r["text"])) for r in rows)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    # copies of each source and size, from what the rows of both sides say; sources of equal size and target fall together
    copies: Counter = Counter()
    for r in got:
        copies[r["source_size"], round(r["target"], 6), r["size"]] += r["copies"]
    wanted: Counter = Counter()
    for s, d in by_source.items():
        counts = Counter(n for _, n in d)
        sized = [n for _, n in d if n]
        rate = dict(zip(sized, plain_rates(sized, target[s]), strict=True))
        left = 0.0
        for n in sorted(counts, reverse=True):
            if n == 0:
                wanted[total[s], round(target[s], 6), 0] += counts[0]
                continue
            left += rate[n] * n * counts[n]
            k = min(2 * counts[n], max(0, math.floor(left / n + 0.5)))
            left -= k * n
            wanted[total[s], round(target[s], 6), n] += k
    assert {k: v for k, v in copies.items() if v} == {k: v for k, v in wanted.items() if v}
    # documents of one source and size differ by a copy at most
    spread: dict = defaultdict(set)
    if len({(total[s], round(target[s], 6)) for s in total}) == len(total):
        for r in got:
            spread[r["source_size"], round(r["target"], 6), r["size"]].add(r["copies"])
        assert all(max(x) - min(x) <= 1 for x in spread.values())
    again = source_mix.mixed(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_equals_a_plain_one(spark: SparkSession, tables: tuple) -> None:
    expect_mix(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    expect_mix(tables[0])


def test_mix_meets_its_targets(spark: SparkSession) -> None:
    out = source_mix.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    sums = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.min("size").alias("least")).collect()
    assert len(sums) == 20 and all(abs(r["taken"] - r["target"]) <= max(30, 0.002 * r["target"]) for r in sums)
    assert sum(r["target"] for r in sums) == pytest.approx(1.5 * sum(r["source_size"] for r in sums))


@pytest.mark.parametrize("f", [source_divergence.divergences, source_mix.mixed, lambda d: filter_audit.audit(d, d.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int"))])
def test_an_empty_table_gives_no_rows(spark: SparkSession, f: object) -> None:
    assert f(documents(spark).limit(0)).count() == 0
