"""The registered queries of this subpackage, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import decontamination, filter_audit, language_id, lz_fingerprint, minhash_join, piece_sampling, secret_links, source_divergence, source_mix, substring_chains, toxicity, url_lists, warc_revisit
from netloom.llm.web import host


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_revisit(spark: SparkSession, folder: str) -> DataFrame:
    """Each page of the table as a response, and a revisit of it 5,000 s later.
    Pages are fetched 10 s apart in the order of their ids. Every fifth page has
    changed by the revisit, every third has no entity tag."""
    pages = _table(spark, folder, "pages").select("page_id", "url", F.md5("html").alias("digest"))
    tag = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')))
    responses = pages.select(
        F.col("page_id").alias("record_id"), "url", (F.col("page_id") * 10).alias("fetched_at"), F.lit(False).alias("is_revisit"),
        tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), "digest",
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), (F.col("page_id") * 10).cast("string")).alias("headers"),
    )
    stale = F.col("record_id") % 5 == 0
    revisits = responses.select(
        (F.col("record_id") + (1 << 40)).alias("record_id"), "url", (F.col("fetched_at") + 5000).alias("fetched_at"), F.lit(True).alias("is_revisit"),
        F.when(F.col("etag").isNotNull(), F.when(stale, '"new"').otherwise(F.concat(F.lit("W/"), F.col("etag")))).alias("etag"), "last_modified",
        F.when(stale, "new").otherwise(F.col("digest")).alias("digest"),
        F.create_map(F.lit("date"), (F.col("fetched_at") + 5000).cast("string"), F.lit("Expires"), F.lit("0"), F.lit("Content-Length"), F.lit("0")).alias("headers"),
    )
    found = warc_revisit.resolve(responses.unionByName(revisits))
    header = lambda name: F.element_at("headers", name)
    return found.select("record_id", "canonical", "base_id", "outcome", "digest", header("date").alias("date"), header("expires").alias("expires"), header("content-type").alias("content_type"), header("content-length").alias("content_length"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The pages, fetched 10 s apart in the order of their ids, against three
    lists over their own hosts: a host's checksum tells the list that it is on,
    when it is added and when, if at all, it goes."""
    pages = _table(spark, folder, "pages")
    hosts = pages.select(host(F.col("url")).alias("domain")).where("domain <> ''").distinct().withColumn("h", F.conv(F.substring(F.md5("domain"), 1, 7), 16, 10).cast("long"))
    name = F.element_at(F.array(*map(F.lit, ("adult", "gambling", "malware"))), (F.col("h") % 3 + 1).cast("int"))
    entries = hosts.where("h % 7 < 3").select(name.alias("list"), "domain", F.explode(F.array(F.struct((F.col("h") % 100000).alias("at"), F.lit(True).alias("added")), F.struct((F.col("h") % 100000 + F.col("h") % 40000).alias("at"), F.lit(False).alias("added")))).alias("e")).select("list", "domain", "e.at", "e.added")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", (F.col("page_id") * 10).alias("fetched_at"))
    return url_lists.evaluate(captures, entries).select("capture_id", "host", "blocked", F.array_join("lists", ",").alias("lists"), F.array_join("domains", ",").alias("domains"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scorer = toxicity.train(docs, _table(spark, folder, "labels"))
    return toxicity.score(docs, scorer).withColumn("held_out", language_id.held_out(F.col("doc_id")))


def op5_lz_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return lz_fingerprint.fingerprints(_table(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language_id.identify(docs, language_id.train(docs)).withColumn("held_out", language_id.held_out(F.col("doc_id")))


def op7_substring_chains(spark: SparkSession, folder: str) -> DataFrame:
    return substring_chains.passages(_table(spark, folder, "documents"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_links.digest(_table(spark, folder, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_join.near_duplicates(_table(spark, folder, "documents"))


def op10_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return piece_sampling.encoded(_table(spark, folder, "documents"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.divergences(_table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mixed(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisit": op1_warc_revisit,
        "op2_decontamination": op2_decontamination,
        "op3_url_lists": op3_url_lists,
        "op4_toxicity": op4_toxicity,
        "op5_lz_fingerprint": op5_lz_fingerprint,
        "op6_language_id": op6_language_id,
        "op7_substring_chains": op7_substring_chains,
        "op8_secret_scan": op8_secret_scan,
        "op9_minhash_near_dedup": op9_minhash_near_dedup,
        "op10_piece_sampling": op10_piece_sampling,
        "op11_source_divergence": op11_source_divergence,
        "op12_filter_audit": op12_filter_audit,
        "op13_source_mix": op13_source_mix,
    }
