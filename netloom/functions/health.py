"""States and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY, WEEK = 3_600_000, 86_400_000, 604_800_000
DOWN = ("down", "offline", "unreachable", "alerting", "dormant")


def normal_state(value: Column) -> Column:
    """Trimmed lower case; empty is null."""
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


def reachability(value: Column) -> Column:
    return F.when(normal_state(value) == "reachable", "up").when(normal_state(value) == "unreachable", "down")


def scope_kind(value: Column) -> Column:
    return F.when(normal_state(value).isin("vlan", "vlan6", "svi", "svi6"), "vlan_subnet").when(normal_state(value) == "static", "static_route")


def interface_score(util_in: Column, util_out: Column, err_in: Column, err_out: Column, has_baseline: Column) -> Column:
    """0 to 100, higher is worse; null without a baseline."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    util, err = F.greatest(zero(util_in), zero(util_out)), zero(err_in) + zero(err_out)
    by_util = F.when(util >= 95, 80).when(util >= 80, 50).when(util >= 50, 20).otherwise(0)
    by_err = F.when(err >= 10, 60).when(err >= 1, 30).when(err > 0, 10).otherwise(0)
    return F.when(F.coalesce(has_baseline, F.lit(False)), F.least(F.lit(100), by_util + by_err))


def port_score(util: Column, errors: Column, oper: Column) -> Column:
    """The variant for cloud-managed ports: down counts 80, disabled ports 0."""
    score = interface_score(util, F.lit(0.0), errors, F.lit(0.0), F.lit(True))
    return F.when(normal_state(oper) == "down", 80).when(normal_state(oper) == "disabled", 0).otherwise(score)


def util_penalty(util: Column) -> Column:
    return F.when(util >= 95, 80).when(util >= 85, 60).when(util >= 75, 40).when(util >= 65, 25).otherwise(0)


def l2_rank(mode: Column, allowed: Column, access: Column) -> Column:
    """How much an interface's layer-2 facts can be relied on."""
    some = F.size(F.coalesce(allowed, F.array())) > 0
    return (
        F.when(mode.isNull() | (mode == ""), 0)
        .when(mode == "trunk", F.when(some, 100).otherwise(80))
        .when((mode == "access") & access.isNotNull(), F.when(access == 1, 20).otherwise(60))
        .otherwise(10)
    )


def vlan_set(mode: Column, allowed: Column, access: Column) -> Column:
    """VLANs that an interface carries; null if it doesn't say."""
    return F.when((mode == "trunk") & (F.size(F.coalesce(allowed, F.array())) > 0), allowed).when((mode == "access") & access.isNotNull(), F.array(access))


def flap_state(count_1h: Column, count_24h: Column) -> Column:
    return F.when(count_1h >= 5, "flapping").when(count_24h >= 5, "unstable").otherwise("stable")


def flap_score(count_1h: Column) -> Column:
    return F.least(F.lit(1.0), count_1h / 6.0)


def counter_delta(prev: Column, cur: Column, width: int = 64) -> Column:
    """Growth of an unsigned counter; over the end if that is less than half its
    range, else null (a reset)."""
    size = F.lit(str(1 << width)).cast("decimal(20,0)")
    p, c = prev.cast("decimal(20,0)"), cur.cast("decimal(20,0)")
    over = (size - p + c).cast("decimal(21,0)")
    return F.when(c >= p, (c - p).cast("decimal(21,0)")).when(over * 2 <= size, over)


def firewall_status(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("down|unreachable|failed|disabled|offline"), "down").when(low.rlike("warning|degraded|alert"), "alerting").otherwise("active")


def agent_status(enabled: Column, state: Column, errors: Column) -> Column:
    """A probe's status by its switch, its state and the number of its errors."""
    low = F.lower(F.coalesce(state, F.lit("")))
    down = (enabled == F.lit(False)) | low.isin("offline", "disconnected", "down")
    return F.when(F.coalesce(down, F.lit(False)), "down").when(low.isin("impaired", "limited", "degraded") | (F.coalesce(errors, F.lit(0)) > 0), "alerting").otherwise("active")


def endpoint_status(status: Column) -> Column:
    return F.when(F.lower(F.coalesce(status, F.lit(""))) == "disabled", "down").otherwise("active")


def uplink_oper(uplink: Column, device: Column) -> Column:
    """An uplink's state: its own, else its device's."""
    own, of_device = F.lower(uplink), F.lower(F.coalesce(device, F.lit("")))
    return F.when(own.isin("up", "down", "unknown", "disabled"), own).when(of_device.isin("active", "online", "up"), "up").when(of_device.isin("alerting", "dormant", "offline", "down"), "down").otherwise("unknown")


def to_bool(value: Column, default: bool = True) -> Column:
    low = F.lower(F.trim(value.cast("string")))
    return F.coalesce(~low.isin("false", "0", "no", "off"), F.lit(default))


def interface_type(speed: Column) -> Column:
    """The name a source of truth uses for a port of this speed in Mbit/s."""
    # fixed values
    kinds = {400_000: "400gbase-x-qsfpdd", 100_000: "100gbase-x-qsfp28", 40_000: "40gbase-x-qsfpp", 25_000: "25gbase-x-sfp28", 10_000: "10gbase-x-sfpp", 1_000: "1000base-t", 100: "100base-tx"}
    return F.coalesce(*(F.when(speed >= least, kind) for least, kind in kinds.items()), F.lit("other"))


def speed_mbps(text: Column) -> Column:
    """Megabits of ``1 Gbps``, ``100 Mbps`` and the like."""
    value = F.regexp_extract(F.lower(text), r"([0-9.]+)\s*([gmk])?", 1).try_cast("double")
    unit = F.regexp_extract(F.lower(text), r"([0-9.]+)\s*([gmk])?", 2)
    return value * F.when(unit == "g", 1000.0).when(unit == "k", 0.001).otherwise(1.0)


def iso_ms(text: Column) -> Column:
    """Epoch milliseconds of an ISO 8601 time, naive ones in UTC; null if it isn't one."""
    clean = F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.trim(text))
    return F.unix_millis(F.try_to_timestamp(clean))


def staleness(severity: Column, last_ms: Column, now_ms: Column, threshold_s: Column, stale: Column) -> Column:
    """A finding's severity if its source reported lately; else the stale one, or
    null with ``filter``; another policy, no threshold and no report change nothing."""
    old = (threshold_s > 0) & last_ms.isNotNull() & (now_ms - last_ms > threshold_s.cast("bigint") * 1000)
    return F.when(~F.coalesce(old, F.lit(False)), severity).when(stale == "filter", None).when(stale.isin("info", "warning", "critical"), stale).otherwise(severity)
