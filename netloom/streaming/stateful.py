"""Operators that keep a state for each key and take its rows in event-time order.

Rows may come in any order within the watermark's delay. They wait in the
state until the watermark has passed them; a timer then takes those that are
due, in order, so results are those of the sorted table. Rows that come later
than the watermark are dropped by Spark and counted in the query's progress.
What a key remembers goes when no row has come for a while of event time.

Keys share ``BUCKETS`` states by their hash, as each look into a state costs a
round trip to the JVM: a bucket's rows wait in packed batches and are taken all
at once, column by column. A bucket's waiting rows are those of its keys in one
delay and one micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from netloom.functions.health import WEEK

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Seconds after which a counter's sample is no baseline any more, and a failed address is tried again.
TTL_S = 600
#: States that all keys share; more for more keys, for good once a stream has begun.
BUCKETS = 128

#: Rows in order, and whether the row before counts for each, to output columns and which rows give output.
Step = Callable[[pd.DataFrame, np.ndarray], tuple[dict, np.ndarray]]


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def _whole(rows: pd.DataFrame) -> pd.DataFrame:
    """Numbers that ``_bucketed`` marks as missing are missing again."""
    kept = [c for c in rows.columns if c not in ("ts", "bucket") and not c.startswith("null_of_")]
    return pd.DataFrame({c: pd.arrays.IntegerArray(rows[c].to_numpy(np.int64), rows[f"null_of_{c}"].to_numpy(bool)) if f"null_of_{c}" in rows.columns else rows[c] for c in kept})


class _Waiting(StatefulProcessor):
    """Rows of a bucket that wait for the watermark, and one timer for the least
    time at which something is to be done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary, first long")
        self.memory = handle.getValueState("memory", "rows binary")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at: int, fired: bool = False) -> None:
        before = None if fired or not self.timer.exists() else self.timer.get()[0]
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            if len(part):
                least = int(part["at"].min())
                self.waiting.appendValue((_packed(_whole(part)), least))
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        still = [tuple(r) for r in held if r[1] > now]
        due = [_unpacked(r[0]) for r in held if r[1] <= now]
        if due:
            rows = pd.concat(due, ignore_index=True)
            later = rows[rows["at"] > now]
            if len(later):
                still.append((_packed(later), int(later["at"].min())))
            due = [rows[rows["at"] <= now]]
        if still:
            self.waiting.put(still)
        elif held:
            self.waiting.clear()
        memory = _unpacked(self.memory.get()[0]) if self.memory.exists() else None
        out, kept, until = self.taken(due[0] if due else None, memory, now)
        if kept is not None and len(kept):
            self.memory.update((_packed(kept),))
        elif memory is not None:
            self.memory.clear()
        wakes = [r[1] for r in still] + ([until] if until is not None else [])
        if wakes:
            self._wake(min(wakes), fired=True)
        else:
            self.timer.clear()
        if out is not None and len(out):
            yield out

    def taken(self, due: pd.DataFrame | None, memory: pd.DataFrame | None, now: int) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]:
        """The output of rows that are due, what is remembered then, and when some of that is to go."""
        raise NotImplementedError


class InOrder(_Waiting):
    """``step`` over a key's rows in the order of ``order``, whose first column is
    ``at``, the event time in milliseconds; a key's last row is remembered and
    counts for ``keep_ms``."""

    def __init__(self, step: Step, key: list[str], order: list[str], output: list[str], keep_ms: int) -> None:
        self.step, self.key, self.order, self.output, self.keep_ms = step, key, order, output, keep_ms

    def taken(self, due: pd.DataFrame | None, memory: pd.DataFrame | None, now: int) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]:
        out = None
        if due is not None and len(due):
            # what is remembered comes first of its key: stable sorts
            due = due.sort_values(self.order, kind="stable")
            rows = due.assign(_old=False) if memory is None else pd.concat([memory.assign(_old=True), due.assign(_old=False)], ignore_index=True)
            if memory is not None:
                rows = rows.sort_values("_old", ascending=False, kind="stable")
            number = rows.groupby(self.key, dropna=False, sort=False).ngroup().to_numpy()
            to = np.argsort(number, kind="stable")
            rows, number = rows.iloc[to].reset_index(drop=True), number[to]
            at = rows["at"].to_numpy(np.int64)
            held = np.r_[False, (number[1:] == number[:-1]) & (np.diff(at) <= self.keep_ms)]
            values, gives = self.step(rows, held)
            gives = gives & ~rows["_old"].to_numpy(bool)
            out = pd.DataFrame({**{c: rows[c] for c in self.key}, **values})[self.output][gives]
            memory = rows[np.r_[number[1:] != number[:-1], True]].drop(columns="_old")
        if memory is not None:
            memory = memory[memory["at"].to_numpy(np.int64) + self.keep_ms >= now]
        # one look at the bucket when all that it remembers has gone
        until = int(memory["at"].max()) + self.keep_ms + 1 if memory is not None and len(memory) else None
        return out, memory, until


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that these operators need, for queries started within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _bucketed(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with their bucket. Missing whole numbers are told by columns of
    their own: pandas would make fractions of all numbers beside them."""
    whole = [c for c, t in rows.dtypes if t in ("bigint", "int") and c != "at"]
    return rows.withColumns({"bucket": F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int"), **{f"null_of_{c}": F.col(c).isNull() for c in whole}}).withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in whole})


def in_order(rows: DataFrame, key: list[str], step: Step, order: list[str], output: str, keep_ms: int) -> DataFrame:
    """``step`` over the rows of each key; ``output`` names the key's columns too."""
    names = [c.split()[0] for c in output.split(", ")]
    return _bucketed(rows, key).groupBy("bucket").transformWithStateInPandas(InOrder(step, key, order, names, keep_ms), output, "Append", "EventTime")


def _changed(rows: pd.DataFrame, held: np.ndarray) -> tuple[dict, np.ndarray]:
    code = pd.factorize(rows["state"])[0]
    return {"at": rows["at"], "state": rows["state"]}, ~(held & np.r_[False, code[1:] == code[:-1]])


def flaps(rows: DataFrame, late: str = "2 hours") -> DataFrame:
    """(element, at, state): changes of ``rows(element, at, ts, state,
    event_id)``. An element is forgotten after a week without rows."""
    own = rows.select("element", "at", "ts", "state", "event_id").withWatermark("ts", late)
    return in_order(own, ["element"], _changed, ["at", "event_id"], "element long, at long, state string", WEEK)


_COUNTERS = ("in_octets", "out_octets", "in_errors", "out_errors")


def _halves(rows: DataFrame, name: str) -> list[Column]:
    """A counter as two whole numbers of 32 bits each, whose differences are exact in arrays."""
    base = F.lit("4294967296").cast("decimal(10,0)")
    value = rows[name].cast("decimal(20,0)")
    return [F.floor(value / base).cast("long").alias(f"{name}_high"), F.pmod(value, base).cast("long").alias(f"{name}_low")]


def _grown(rows: pd.DataFrame, name: str, bits: int) -> np.ndarray:
    """Growth of a counter; over its end if that is less than half its range, else none (nan)."""
    high, low = (rows[f"{name}_{h}"].to_numpy(np.int64, na_value=0) for h in ("high", "low"))
    high, low = np.diff(high, prepend=0), np.diff(low, prepend=0)
    high, low = high + (low >> 32), low & 0xFFFFFFFF
    fell = high < 0
    high = high + np.where(fell, 1 << (bits - 32), 0)
    half = 1 << (bits - 33) if bits > 32 else 0
    least = 0 if bits > 32 else 1 << 31
    missing = rows[f"{name}_high"].isna().to_numpy(bool)
    none = missing | np.r_[True, missing[:-1]] | fell & ~((high < half) | (high == half) & (low <= least))
    # both parts are exact, so the sum is rounded once
    return np.where(none, np.nan, high.astype(float) * 4294967296.0 + low.astype(float))


def _rates(ttl_ms: int) -> Step:
    def step(rows: pd.DataFrame, held: np.ndarray) -> tuple[dict, np.ndarray]:
        elapsed = np.diff(rows["at"].to_numpy(np.int64), prepend=0) / 1000
        counts = held & (elapsed > 0) & (elapsed <= ttl_ms / 1000)
        rates, elapsed = [], np.where(counts, elapsed, np.nan)
        for c in _COUNTERS:
            grown = _grown(rows, c, 64 if "octets" in c else 32)
            rates.append((grown * 8 if "octets" in c else grown) / elapsed)
        full = rows["speed_mbps"].to_numpy(float, na_value=np.nan) * 1e6
        full = np.where(full > 0, full, np.nan)
        names = ["rate_in_bps", "rate_out_bps", "error_rate_in_per_s", "error_rate_out_per_s", "util_in_pct", "util_out_pct"]
        return {"at": rows["at"], **dict(zip(names, [*rates, *(r * 100 / full for r in rates[:2])], strict=True))}, np.ones(len(rows), bool)

    return step


def counter_rates(rows: DataFrame, late: str = "10 minutes", ttl_s: int = TTL_S) -> DataFrame:
    """Rates of ``rows(device, ifindex, at, ts, in_octets, out_octets,
    in_errors, out_errors, speed_mbps)`` against the sample before, which counts
    for ``ttl_s`` seconds and is then forgotten."""
    own = rows.select("device", "ifindex", "at", "ts", *(h for c in _COUNTERS for h in _halves(rows, c)), rows["speed_mbps"].cast("long").alias("speed_mbps")).withWatermark("ts", late)
    output = "device long, ifindex long, at long, rate_in_bps double, rate_out_bps double, error_rate_in_per_s double, error_rate_out_per_s double, util_in_pct double, util_out_pct double"
    return in_order(own, ["device", "ifindex"], _rates(ttl_s * 1000), ["at"], output, ttl_s * 1000)


class NegativeCache(_Waiting):
    """Which attempts of a device's addresses are made: an address whose last
    made attempt failed is left alone for ``ttl_ms``."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def taken(self, due: pd.DataFrame | None, memory: pd.DataFrame | None, now: int) -> tuple[pd.DataFrame | None, pd.DataFrame | None, int | None]:
        key = ["device", "address"]
        out = None
        blocked = {} if memory is None else {(None if pd.isna(d) else d, a): until for d, a, until in zip(*(memory[c] for c in (*key, "until")), strict=True)}
        if due is not None and len(due):
            due = due.sort_values(["at", "event_id"], kind="stable")
            made = np.zeros(len(due), bool)
            devices = [None if d is pd.NA else d for d in due["device"].tolist()]
            for k, (*address, at, ok) in enumerate(zip(devices, due["address"].tolist(), due["at"].tolist(), due["ok"].tolist(), strict=True)):
                until = blocked.get(tuple(address))
                if until is None or at >= until:
                    made[k] = True
                    if not ok:
                        blocked[tuple(address)] = at + self.ttl_ms
                    elif until is not None:
                        del blocked[tuple(address)]
            out = due[[*key, "at", "event_id"]].assign(made=made)
        left = [(d, a, until) for (d, a), until in blocked.items() if until > now]
        kept = pd.DataFrame({"device": pd.array([x[0] for x in left], pd.Int64Dtype()), "address": [x[1] for x in left], "until": pd.array([x[2] for x in left], pd.Int64Dtype())})
        return out, kept, max(x[2] for x in left) if left else None


def attempts(rows: DataFrame, late: str = "10 minutes", ttl_s: int = TTL_S) -> DataFrame:
    """(device, address, at, event_id, made) of wished attempts ``rows(device,
    address, at, ts, event_id, ok)``, ok telling how one would end."""
    own = rows.select("device", "address", "at", "ts", "event_id", F.coalesce("ok", F.lit(False)).alias("ok")).withWatermark("ts", late)
    return _bucketed(own, ["device", "address"]).groupBy("bucket").transformWithStateInPandas(NegativeCache(ttl_s * 1000), "device long, address string, at long, event_id long, made boolean", "Append", "EventTime")


def collected(rows: DataFrame, folder: str) -> tuple[DataFrame, StreamingQuery]:
    """The output of a stream run to the end of its input, by batches in
    ``folder``, and the query that ran."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/n={number}")

    with _rocks(spark):
        q = rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("n"), q


def late_rows(q: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, of a query's recent batches."""
    return sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
