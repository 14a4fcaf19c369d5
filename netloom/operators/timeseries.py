"""Histories of states, metrics and counters, in batch form.

A history is a table of observations; nothing is packed into text. Windows are
ranges over epoch milliseconds with inclusive bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.health import DAY, HOUR, WEEK, counter_delta, flap_score, flap_state, normal_state

MAX_EVENTS, MAX_BUCKETS = 200, 168


def transitions(observations: DataFrame, key: list[str]) -> DataFrame:
    """Changes of state in ``observations(*key, at, state)``: the first of a key
    (seed) and every one whose normalised state differs from the last."""
    rows = observations.withColumn("state", normal_state(F.col("state"))).where("state is not null and at is not null")
    last = F.lag("state").over(Window.partitionBy(*key).orderBy("at", "state"))
    return rows.withColumn("from_state", last).where("from_state is null or state <> from_state").select(*key, "at", "from_state", "state", F.col("from_state").isNull().alias("seed"))


def kept(changes: DataFrame, key: list[str], now_ms: Column, window_ms: int = WEEK, most: int = MAX_EVENTS) -> DataFrame:
    """The changes within the window, the latest ``most`` of each key."""
    recent = changes.where(F.col("at") >= now_ms - window_ms)
    return recent.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("at"), "state"))).where(F.col("_n") <= most).drop("_n")


def flap_stats(changes: DataFrame, key: list[str], now_ms: Column) -> DataFrame:
    """Counts of changes in the last hour and day, score and class of each key."""
    counts = changes.groupBy(*key).agg(
        F.count_if(F.col("at") >= now_ms - HOUR).alias("flap_count_1h"),
        F.count_if(F.col("at") >= now_ms - DAY).alias("flap_count_24h"),
        F.max("at").alias("last_change_at"),
        F.max(F.when(~F.col("seed"), F.col("at"))).alias("changed_at"),
        F.max_by("state", F.struct("at", "state")).alias("state"),
    )
    return counts.withColumns({"flap_score_1h": flap_score(F.col("flap_count_1h")), "flap_state": flap_state(F.col("flap_count_1h"), F.col("flap_count_24h"))})


def rolling_flaps(changes: DataFrame, key: list[str]) -> DataFrame:
    """At each change the counts of changes in the hour and day up to it."""
    over = lambda ms: F.count("*").over(Window.partitionBy(*key).orderBy("at").rangeBetween(-ms, 0))
    rows = changes.withColumns({"flap_count_1h": over(HOUR), "flap_count_24h": over(DAY)})
    return rows.withColumns({"flap_score_1h": flap_score(F.col("flap_count_1h")), "flap_state": flap_state(F.col("flap_count_1h"), F.col("flap_count_24h"))})


def apply_observation(rows: DataFrame, now_ms: Column, window_ms: int = WEEK, most: int = MAX_EVENTS) -> DataFrame:
    """One observation against a stored history, for ``rows(current_value,
    new_value, history array<struct<at,to>>)``: adds history, value,
    flap_count_1h, flap_count_24h, flap_score_1h, flap_state, changed_at.

    A first state seeds the history without a change; a state that differs from
    the last one is a change; otherwise history and value are null (nothing to
    write) and the counts are made anew.
    """
    trim = lambda h: F.slice(F.reverse(F.filter(h, lambda e: e["at"] >= now_ms - window_ms)), 1, most)  # noqa: E731  latest first
    old = F.reverse(trim(F.array_sort(F.coalesce("history", F.array().cast("array<struct<at:bigint,to:string>>")))))
    rows = rows.withColumns({"_new": normal_state(F.col("new_value")), "_cur": normal_state(F.col("current_value")), "_old": old})
    seeded = (F.size("_old") == 0) & F.col("_new").isNotNull()
    moved = F.coalesce((F.size("_old") > 0) & (F.col("_new") != F.try_element_at("_old", F.lit(-1))["to"]), F.lit(False))
    entry = F.array(F.struct(now_ms.cast("bigint").alias("at"), F.col("_new").alias("to")))
    rows = rows.withColumns({"_seeded": seeded, "_moved": moved}).withColumn("_history", F.when(F.col("_seeded") | F.col("_moved"), F.reverse(trim(F.concat("_old", entry)))).otherwise(F.col("_old")))
    count = lambda ms: F.size(F.filter("_history", lambda e: e["at"] >= now_ms - ms))
    write = F.col("_seeded") | F.col("_moved") | ~F.col("_cur").eqNullSafe(F.col("_new"))
    out = rows.withColumns({"flap_count_1h": count(HOUR), "flap_count_24h": count(DAY)})
    return out.withColumns({
        "flap_score_1h": flap_score(F.col("flap_count_1h")),
        "flap_state": flap_state(F.col("flap_count_1h"), F.col("flap_count_24h")),
        "value": F.when(write, F.col("_new")),
        "history": F.when(write, F.col("_history")),
        "changed_at": F.when(F.col("_moved"), now_ms.cast("bigint")),
    }).drop("_new", "_cur", "_old", "_seeded", "_moved", "_history")


def parse_history(text: Column) -> Column:
    """``[[at,"state"],...]`` as an array of (at, to) in order; anything else is empty."""
    pairs = F.from_json(text, "array<array<string>>", {"mode": "PERMISSIVE"})
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & p[0].try_cast("bigint").isNotNull() & p[1].isNotNull())
    return F.coalesce(F.array_sort(F.transform(good, lambda p: F.struct(p[0].try_cast("bigint").alias("at"), p[1].alias("to")))), F.array().cast("array<struct<at:bigint,to:string>>"))


def serialize_history(history: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(history, lambda e: F.concat(F.lit("["), e["at"].cast("string"), F.lit(","), F.to_json(F.array(e["to"])).substr(F.lit(2), F.length(F.to_json(F.array(e["to"]))) - 2), F.lit("]"))), ","), F.lit("]"))


def hourly(samples: DataFrame, key: list[str]) -> DataFrame:
    """Hourly means of ``samples(*key, at, value)``; null values don't count. A
    late sample is added to its own hour."""
    bucket = (F.floor(F.col("at") / HOUR) * HOUR).alias("bucket")
    return samples.where("value is not null").groupBy(*key, bucket).agg(F.avg("value").alias("avg"), F.count("value").alias("cnt"))


def hourly_windows(buckets: DataFrame, key: list[str], now_ms: Column) -> DataFrame:
    """Weighted means over the buckets that start in the last hour and day. A
    start in the last hour means the current clock hour only; for a true sliding
    hour see ``sliding_mean``."""
    within = lambda ms: F.col("bucket") >= now_ms - ms
    mean = lambda ms: F.sum(F.when(within(ms), F.col("avg") * F.col("cnt"))) / F.sum(F.when(within(ms), F.col("cnt")))
    count = lambda ms: F.coalesce(F.sum(F.when(within(ms), F.col("cnt"))), F.lit(0))
    return buckets.where(within(WEEK)).groupBy(*key).agg(mean(HOUR).alias("avg_1h"), mean(DAY).alias("avg_24h"), count(HOUR).alias("count_1h"), count(DAY).alias("count_24h"))


def sliding_mean(samples: DataFrame, key: list[str], ms: int = HOUR) -> DataFrame:
    return samples.where("value is not null").withColumn("mean", F.avg("value").over(Window.partitionBy(*key).orderBy("at").rangeBetween(-ms, 0)))


def counter_rates(samples: DataFrame, ttl_s: int = 600) -> DataFrame:
    """Rates of ``samples(device, ifindex, ts, in_octets, out_octets, in_errors,
    out_errors, speed_mbps)``, ts in seconds, against the sample before, if that
    is younger than ``ttl_s``. A baseline needs both directions' octets."""
    w = Window.partitionBy("device", "ifindex").orderBy("ts")
    fields = ("in_octets", "out_octets", "in_errors", "out_errors")
    rows = samples.withColumn("_p", F.lag(F.struct("ts", *fields)).over(w))
    elapsed = (F.col("ts") - F.col("_p.ts")).cast("double")
    ok = (elapsed > 0) & (elapsed <= ttl_s)
    delta = {f: F.when(ok, counter_delta(F.col(f"_p.{f}"), F.col(f), 64 if "octets" in f else 32).cast("double")) for f in fields}
    rows = rows.withColumns({
        "sample_age_s": F.when(ok, elapsed),
        "rate_in_bps": delta["in_octets"] * 8 / elapsed, "rate_out_bps": delta["out_octets"] * 8 / elapsed,
        "error_rate_in_per_s": delta["in_errors"] / elapsed, "error_rate_out_per_s": delta["out_errors"] / elapsed,
    })
    full = F.when(F.col("speed_mbps") > 0, F.col("speed_mbps") * 1e6)
    return rows.withColumns({
        "has_baseline": F.col("rate_in_bps").isNotNull() & F.col("rate_out_bps").isNotNull(),
        "util_in_pct": F.col("rate_in_bps") * 100 / full, "util_out_pct": F.col("rate_out_bps") * 100 / full,
    }).drop("_p")
