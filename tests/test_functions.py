from __future__ import annotations

import pytest
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from netloom.functions import health, names, network
from netloom.operators import reconcile, timeseries


def values(spark: SparkSession, rows: list[tuple], schema: str, *columns: Column) -> list[Row]:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", *columns).orderBy("i").collect()


def each(spark: SparkSession, inputs: list[str | None], column: Column) -> list:
    return [r["out"] for r in values(spark, [(x,) for x in inputs], "x string", column.alias("out"))]


def column() -> Column:
    return F.col("x")


def test_timestamps(spark: SparkSession) -> None:
    raw = ["1970-01-01T00:00:00Z", "2025-06-14T19:22:06Z", "2025-06-14T19:22:06+00:00", "2025-06-14T19:22:06", "2025-06-14T19:22:06.250Z", None, "", " ", "not-a-date", "2025-13-99"]
    assert each(spark, raw, health.iso_ms(column())) == [0, 1749928926000, 1749928926000, 1749928926000, 1749928926250, None, None, None, None, None]


def test_normalisers(spark: SparkSession) -> None:
    assert each(spark, ["reachable", "Reachable", "  reachable ", "unreachable", None, "", "unknown", "n/a"], health.reachability(column())) == ["up", "up", "up", "down", None, None, None, None]
    assert each(spark, ["vlan", "vlan6", "svi", "svi6", "  vlan", "static", "STATIC", "x", None], health.scope_kind(column())) == ["vlan_subnet"] * 5 + ["static_route"] * 2 + [None, None]
    assert each(spark, [" a \t b\n c ", None, "  "], names.collapse(column())) == ["a b c", "", ""]


def test_interface_names(spark: SparkSession) -> None:
    raw = ["Twe1/1/5", "TwentyFiveGigE1/1/5", "Gi0/0", "Po10", "Eth1/1", "xyz1", "", None, " te 1/1 "]
    assert each(spark, raw, names.normalize_ifname(column())) == ["TwentyFiveGigE1/1/5", "TwentyFiveGigE1/1/5", "GigabitEthernet0/0", "Port-channel10", "Ethernet1/1", "xyz1", "", "", "TenGigabitEthernet1/1"]


@pytest.mark.parametrize(("slot", "port", "fi", "host"), [(1, 3, "Ethernet1/3", "vic1/3"), (None, 5, "Ethernet1/5", "vic1/5"), (2, None, "Ethernet2/0", "vic2/0"), (None, None, "", ""), ("", "", "Ethernet1/0", "vic1/0")])
def test_port_names(spark: SparkSession, slot: object, port: object, fi: str, host: str) -> None:
    text = lambda v: None if v is None else str(v)
    row = values(spark, [(text(slot), text(port))], "s string, p string", names.fi_port(F.col("s"), F.col("p")).alias("fi"), names.host_port(F.col("s"), F.col("p")).alias("host"))[0]
    assert (row["fi"], row["host"]) == (fi, host)


def test_addresses(spark: SparkSession) -> None:
    raw = ["10.1.2.3", "256.1.1.1", "2001:db8::1", "::1", "::", "1::2::3", "fe80::1%eth0", "x", None, "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7"]
    assert each(spark, raw, network.ip_version(column())) == [4, None, 6, 6, 6, None, 6, None, None, 6, None]
    assert each(spark, ["2001:db8:ffff::1"], network.network6(network.ipv6(column()), 34)) == ["20010db8c00000000000000000000000"]
    assert each(spark, ["2001:db8:ffff::1"], network.network6(network.ipv6(column()), 128)) == ["20010db8ffff00000000000000000001"]
    assert each(spark, ["10.0.0.1", "127.0.0.1", "169.254.1.1", "0.0.0.0", "239.1.1.1", "::1", "fe80::1", "2001::1"], network.is_useful_ip(column())) == [True, False, False, False, False, False, False, True]
    assert each(spark, ["10.0.0.1", "10.0.0.0/8", "::1"], network.ensure_cidr(column())) == ["10.0.0.1/32", "10.0.0.0/8", "::1/128"]


def test_bitmaps_and_macs(spark: SparkSession) -> None:
    assert each(spark, ["80", "01", "", None, "8001"], network.vlan_bitmap(column(), 1)) == [[1], [8], [], [], [1, 16]]
    assert each(spark, ["AA-bb.cc:DD ee ff", "aabb", None], names.mac(column())) == ["aa:bb:cc:dd:ee:ff", None, None]
    assert each(spark, ["8000aabbccddeeff"], names.bridge_mac(column())) == ["aa:bb:cc:dd:ee:ff"]
    assert each(spark, ["Cisco (AS 109)", "Some, Net, (AS12)", "plain", "(AS x)"], network.network_asn(column())["asn"]) == [109, 12, None, None]


def test_counters(spark: SparkSession) -> None:
    rows = [("5", "9"), ("18446744073709551610", "4"), ("9000000000000000000", "5"), (None, "1")]
    assert [r["d"] for r in values(spark, rows, "p string, c string", health.counter_delta(F.col("p").cast("decimal(20,0)"), F.col("c").cast("decimal(20,0)")).cast("bigint").alias("d"))] == [4, 10, None, None]


@pytest.mark.parametrize(("last", "threshold", "stale", "want"), [(None, 86400, "info", "critical"), (0, 0, "filter", "critical"), (1_750_000_000_000 - 86_400_000, 86400, "info", "critical"), (1_750_000_000_000 - 86_460_000, 86400, "info", "info"), (1_750_000_000_000 - 90 * 86_400_000, 86400, "filter", None), (0, 86400, "bogus", "critical")])
def test_staleness(spark: SparkSession, last: int | None, threshold: int, stale: str, want: str | None) -> None:
    out = health.staleness(F.lit("critical"), F.col("l"), F.lit(1_750_000_000_000), F.lit(threshold), F.lit(stale))
    assert values(spark, [(last,)], "l bigint", out.alias("s"))[0]["s"] == want


@pytest.mark.parametrize(("case", "want"), [(("a", "s", "a", "s"), {}), (("fi-a", None, "fi-a.x.net", None), {}), (("cpn", "OLD", "FI-A", "NEW"), {"name": "FI-A", "serial": "NEW"}), (("a", "x1", None, "X1"), {}), (("", "1", "b", "2"), {"serial": "2"})])
def test_delta(spark: SparkSession, case: tuple, want: dict) -> None:
    out = reconcile.delta(F.col("a"), F.col("c"), F.col("b"), F.col("d"))
    found = values(spark, [case], "a string, b string, c string, d string", out.alias("x"))[0]["x"]
    assert {k: v["current"] for k, v in found.items()} == want


NOW = 10_000_000
HOUR = 3_600_000
CASES = [
    # history, current, new, now -> written history, value, changed, 1h, 24h, state
    ([], None, "up", NOW, [(NOW, "up")], "up", None, 1, 1, "stable"),
    ([], "down", "down", NOW, [(NOW, "down")], "down", None, 1, 1, "stable"),
    ([(NOW - HOUR, "up")], "up", "down", NOW, [(NOW - HOUR, "up"), (NOW, "down")], "down", NOW, 2, 2, "stable"),
    ([(NOW - 25 * HOUR, "up")], "up", "up", NOW, None, None, None, 0, 0, "stable"),
    ([], None, None, NOW, None, None, None, 0, 0, "stable"),
    ([(NOW - 60_000 * k, "ab"[k % 2]) for k in range(6)], "a", "a", NOW, None, None, None, 6, 6, "flapping"),
    ([(NOW - HOUR * k, "ab"[k % 2]) for k in range(2, 7)], "a", "a", NOW, None, None, None, 0, 5, "unstable"),
    ([(NOW - 8 * 24 * HOUR, "up"), (NOW - HOUR, "up")], "up", "down", NOW, [(NOW - HOUR, "up"), (NOW, "down")], "down", NOW, 2, 2, "stable"),
    ([(NOW - 5, "up")], "up", "  UP  ", NOW, None, None, None, 1, 1, "stable"),
]


@pytest.mark.parametrize("case", CASES)
def test_observation(spark: SparkSession, case: tuple) -> None:
    history, current, new, now, written, value, changed, n1, n24, state = case
    df = spark.createDataFrame([(history, current, new)], "history array<struct<at:bigint,to:string>>, current_value string, new_value string")
    row = timeseries.apply_observation(df, F.lit(now)).first()
    assert (None if row["history"] is None else [tuple(e) for e in row["history"]]) == written
    assert (row["value"], row["changed_at"], row["flap_count_1h"], row["flap_count_24h"], row["flap_state"]) == (value, changed, n1, n24, state)


def test_history_text(spark: SparkSession) -> None:
    raw = ['[[3000,"up"],[1000,"down"],[2000,"up"]]', None, "", "{}", "nonsense"]
    parsed = each(spark, raw, timeseries.parse_history(column()))
    assert [[tuple(e) for e in x] for x in parsed] == [[(1000, "down"), (2000, "up"), (3000, "up")], [], [], [], []]
    assert each(spark, ['[[1000, "up"], [2000, "down"]]'], timeseries.serialize_history(timeseries.parse_history(column()))) == ['[[1000,"up"],[2000,"down"]]']


def test_hourly_windows(spark: SparkSession) -> None:
    df = spark.createDataFrame([("a", 7_300_000, 50.0), ("a", 7_400_000, 70.0), ("a", 1, None)], "k string, at bigint, value double")
    row = timeseries.hourly_windows(timeseries.hourly(df, ["k"]), ["k"], F.lit(NOW)).first()
    assert (row["avg_1h"], row["count_1h"], row["avg_24h"]) == (60.0, 2, 60.0)
