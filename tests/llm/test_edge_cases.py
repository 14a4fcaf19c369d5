"""Nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontamination, language_id, lz_fingerprint, minhash_join, piece_sampling, secret_links, substring_chains, toxicity, url_lists, warc_revisit
from netloom.llm.text import code_points, utf8

LONG = " ".join(f"word{i % 7919} and {i}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals look on"
ROWS = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, " \t\n"), (5, LONG), (6, LONG + " tail"), (None, PROSE), (None, None), (7, "\U0001f600 é ﷽  ▁"), (8, 'token = "abcdef123456"')]
CLASHING = ["key", "id", "row", "n", "h", "r", "seed", "head", "place", "bucket", "lead", "word", "window", "slots", "_id", "_hash", "_spans", "kept", "rejected", "component_id", "score"]


def documents(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


def benchmark(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (None, PROSE), (3, "")], "item_id long, text string")


def toxic(docs: DataFrame) -> DataFrame:
    labels = docs.sparkSession.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    return toxicity.score(docs, toxicity.train(docs, labels))


#: Operators that give a row for each of theirs.
EACH: dict[str, Callable[[DataFrame], DataFrame]] = {
    "toxicity": toxic,
    "fingerprints": lz_fingerprint.fingerprints,
    "language": lambda docs: language_id.identify(docs, language_id.train(docs)),
    "secrets": secret_links.digest,
    "redacted": secret_links.redacted,
    "near_duplicates": minhash_join.near_duplicates,
    "pieces": piece_sampling.encoded,
}
#: Operators that give other rows.
OTHERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "contaminated": lambda docs: decontamination.contaminated(docs, benchmark(docs.sparkSession)),
    "clean": lambda docs: decontamination.clean(docs, benchmark(docs.sparkSession)),
    "passages": substring_chains.passages,
    "accepted": language_id.accepted,
    "one_of_each": minhash_join.one_of_each,
}


@pytest.mark.parametrize("name", EACH)
def test_a_row_for_each(spark: SparkSession, name: str) -> None:
    docs = documents(spark)
    rows = EACH[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(k) for k, _ in ROWS)


@pytest.mark.parametrize("name", [*EACH, *OTHERS])
def test_an_empty_table_gives_no_rows(spark: SparkSession, name: str) -> None:
    assert (EACH | OTHERS)[name](documents(spark).limit(0)).count() == 0


def test_stages_keep_the_columns(spark: SparkSession) -> None:
    docs = documents(spark)
    for f in (secret_links.redacted, OTHERS["clean"], language_id.accepted, minhash_join.one_of_each):
        assert set(f(docs).columns) == set(docs.columns)


def test_what_odd_rows_give(spark: SparkSession) -> None:
    docs = documents(spark)
    assert {r["doc_id"] for r in OTHERS["contaminated"](docs).collect()} == {1}
    kept = Counter((r["doc_id"], r["text"]) for r in OTHERS["clean"](docs).collect())
    assert kept == Counter(x for x in ROWS if x[1] != PROSE)
    assert {(r["doc_id"], r["other_id"]) for r in substring_chains.passages(docs).collect()} == {(5, 6), (6, 5)}
    languages = {r["doc_id"]: r["lang_pred"] for r in EACH["language"](docs).where("doc_id is not null").collect()}
    assert {k for k, x in languages.items() if x == "und"} == {2, 3, 4}
    groups = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in minhash_join.near_duplicates(docs).where("doc_id is not null").collect()}
    assert groups[5][0] == groups[6][0] == 5 and groups[2] == (2, 0) and groups[4] == (4, 0) and groups[1] == (1, 11)
    texts = {r["doc_id"]: r["text"] for r in secret_links.redacted(docs).where("doc_id is not null").collect()}
    assert texts[8] == '[SECRET]"' and texts[2] is None and texts[5] == LONG
    scores = [r["score"] for r in toxic(docs).collect()]
    assert all(0 <= x <= 1 for x in scores)


def test_records_without_anything(spark: SparkSession) -> None:
    schema = "record_id long, url string, fetched_at long, is_revisit boolean, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [
        (1, "http://A.com/x/", 10, False, "e", None, "d", {"Date": "1", "X": "keep"}),
        (2, "http://a.com/x", 20, True, "W/e", None, None, {"date": "2", "x": "no"}),
        (2, "http://a.com/x", 20, True, "W/e", None, None, {"date": "2", "x": "no"}),
        (3, "http://a.com/x", 5, True, "e", None, None, None),
        (4, "http://a.com/x", 30, True, None, None, None, None),
        (5, None, 30, True, "e", None, None, None),
        (6, "http://a.com/x", None, True, "e", None, None, None),
        (7, "http://a.com/x", 40, True, "f", None, "d", None),
        (8, None, None, None, None, None, None, None),
        (None, "http://a.com/x", 50, True, "e", None, None, None),
    ]
    records = spark.createDataFrame(rows, schema).withColumns({"canonical": F.lit(1), "last": F.lit(1), "_block": F.lit(1)})
    out = warc_revisit.resolve(records).collect()
    got = sorted((str(r["record_id"]), r["base_id"], r["outcome"]) for r in out)
    assert got == [("2", 1, "resolved"), ("2", 1, "resolved"), ("3", None, "no_base"), ("4", None, "mismatch"), ("5", None, "no_base"), ("6", None, "no_base"), ("7", None, "mismatch"), ("None", None, "no_base")]
    assert next(r["headers"] for r in out if r["record_id"] == 2) == {"date": "2", "x": "keep"}
    assert warc_revisit.resolve(records.limit(0)).count() == 0


def test_headers_that_differ_in_case_only(spark: SparkSession) -> None:
    schema = "record_id long, url string, fetched_at long, is_revisit boolean, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [(1, "http://a.com/x", 10, False, "e", None, "d", {"X-A": "1", "x-a": "2", "Date": "3"}), (2, "http://a.com/x", 20, True, "e", None, None, {"Date": "4", "DATE": "5", "date": "6", "Vary": None})]
    out = warc_revisit.resolve(spark.createDataFrame(rows, schema)).collect()
    assert [r["headers"] for r in out] == [{"x-a": "2", "date": "6", "vary": None}]


def test_dated_lists(spark: SparkSession) -> None:
    entries = spark.createDataFrame([("ads", "bad.com", 10, True), ("ads", "BAD.com", 10, True), ("ads", "bad.com", 20, False), ("ads", "bad.com", 30, True), ("adult", "com", 15, True), ("adult", "com", 15, False), ("x", None, 1, True), (None, "bad.com", 1, True)], "list string, domain string, at long, added boolean")
    captures = spark.createDataFrame([(i, "http://www.shop.BAD.com:80/a", t) for i, t in enumerate((9, 10, 19, 20, 30, 10**9, None))] + [(8, None, 12), (9, "nonsense", 12), (10, "http://notbad.com/", 12)], "capture_id long, url string, fetched_at long").withColumns({"domain": F.lit(1), "list": F.lit(1), "at": F.lit(1)})
    assert {r["capture_id"] for r in url_lists.evaluate(captures, entries).where("blocked").collect()} == {1, 2, 4, 5}
    assert url_lists.evaluate(captures, entries).count() == 10
    assert url_lists.evaluate(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0


def test_captures_that_repeat_an_id(spark: SparkSession) -> None:
    entries = spark.createDataFrame([("ads", "bad.com", 10, True), ("ads", "bad.com", 20, False)], "list string, domain string, at long, added boolean")
    rows = [(1, "http://bad.com/", 15), (1, "http://bad.com/", 15), (1, "http://bad.com/", 25), (1, "http://good.com/", 15), (None, "http://bad.com/", 15)]
    got = url_lists.evaluate(spark.createDataFrame(rows, "capture_id long, url string, fetched_at long"), entries).collect()
    assert sorted((str(r["capture_id"]), r["host"], r["blocked"]) for r in got) == [("1", "bad.com", False), ("1", "bad.com", True), ("1", "bad.com", True), ("1", "good.com", False), ("None", "bad.com", True)]


def test_empty_and_odd_side_tables(spark: SparkSession) -> None:
    docs = documents(spark)
    extra = {c: F.lit("x") for c in CLASHING + ["doc_id", "coverage", "lang"]}
    assert decontamination.contaminated(docs, benchmark(spark).limit(0)).count() == 0
    assert decontamination.clean(docs, benchmark(spark).limit(0)).count() == docs.count()
    odd = benchmark(spark).withColumns(extra)
    assert {tuple(r)[:3] for r in decontamination.contaminated(docs, odd).collect()} == {(1, 1, 1.0)}
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, toxic int").withColumns({c: F.lit("x") for c in CLASHING + ["text", "quality"]})
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == len(ROWS)
    none = toxicity.train(docs, labels.limit(0))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, none).collect()}
    assert len(set(scores.values())) == 1


def test_ties_of_languages_and_copies(spark: SparkSession) -> None:
    rows = [(k, PROSE, lang) for k, lang in ((1, "b"), (2, "a"), (3, "a"), (4, "b"), (6, "a"), (7, "b"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    balanced = docs.where("doc_id in (1, 2)")
    got = language_id.identify(docs, language_id.calibrated(language_id.Model({lang: (k, n) for lang in "ab" for k, n in [_counts(PROSE)]}), balanced)).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and all(0.4 < r["score"] < 0.6 for r in got)
    assert {(r["doc_id"], r["component_id"]) for r in minhash_join.near_duplicates(docs).collect()} == {(k, 1) for k, _, _ in rows}


def _counts(text: str) -> tuple:
    packed, _ = language_id.grams(*code_points(*utf8(pa.array([text]))))
    return np.unique(packed, return_counts=True)
