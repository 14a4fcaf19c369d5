"""Resolution of not-modified records of a web archive.

A revisit record has no body. It stands for the latest earlier full response to
the same canonical address, if its validators agree with that one's; the
response's headers are then updated by those that a 304 answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.asof import latest_before
from netloom.llm.web import canonical

# fixed values: headers that a not-modified answer updates
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Stretches of time in which records of one address are sorted together.
BLOCK_SECONDS = 1000


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def _verdict(etag: Column, modified: Column, digest: Column, base: Column) -> Column:
    """Entity tags decide if both sides have one (weak comparison), then dates of
    change, then payload digests; with none on both sides nothing is proven."""
    by = lambda own, field, like=lambda c: c: F.when(own.isNotNull() & base[field].isNotNull(), like(own) == like(base[field]))
    return F.coalesce(by(etag, "etag", _weak), by(modified, "last_modified"), by(digest, "digest"), F.lit(False))


def _folded(headers: Column) -> Column:
    """Headers by lower-case name; of names that differ in case only, the value of the last spelling in order."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: F.array_position(F.slice(names, i + 2, F.size(names)), e["key"]) == 0)
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(record_id, canonical, base_id, outcome, digest, headers) of the revisits
    among ``records(record_id, url, fetched_at, is_revisit, etag,
    last_modified, digest, headers)``.

    fetched_at is in seconds; earlier means before in (fetched_at, record_id).
    outcome is ``resolved``, ``mismatch`` if the validators disagree or are
    missing, or ``no_base`` if there is no earlier response; then digest and
    base_id are null and headers are the revisit's own. Header names are
    compared in lower case; of names that differ in case only the last spelling in order counts. Null addresses, times or ids never resolve; a null
    is_revisit is a response, null headers are none. Repeated revisits give a
    row each. Other columns are ignored; an empty table gives no rows.
    """
    names = ("record_id", "fetched_at", "etag", "last_modified", "digest")
    rows = records.select(*names, F.coalesce("is_revisit", F.lit(False)).alias("is_revisit"), canonical(F.col("url")).alias("canonical"), _folded(F.col("headers")).alias("headers"))
    whole = F.when(~F.col("is_revisit"), F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    usable = rows.where("canonical is not null and fetched_at is not null and record_id is not null")
    joined = latest_before(usable, ["canonical"], ["fetched_at", "record_id"], whole, F.floor(F.col("fetched_at") / block_seconds)).where("is_revisit")
    rest = rows.where("is_revisit and (canonical is null or fetched_at is null or record_id is null)").withColumn("last", F.lit(None).cast(joined.schema["last"].dataType))
    joined = joined.unionByName(rest.select(*joined.columns))
    base = F.col("last")
    fits = base.isNotNull() & _verdict(F.col("etag"), F.col("last_modified"), F.col("digest"), base)
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(base["headers"], lambda k, _: ~F.map_contains_key(update, k)), update)
    return joined.select(
        "record_id", "canonical",
        F.when(fits, base["record_id"]).alias("base_id"),
        F.when(fits, "resolved").when(base.isNull(), "no_base").otherwise("mismatch").alias("outcome"),
        F.when(fits, base["digest"]).alias("digest"),
        F.when(fits, merged).otherwise(F.col("headers")).alias("headers"),
    )
