"""Facts derived for links, devices and prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.health import DOWN, uplink_oper
from netloom.functions.network import ipv4, ipv6, is_public_asn, network4, network6
from netloom.operators.paths import nearest
from netloom.operators.summary import dominant_slug


def containing(pairs: DataFrame, addresses: DataFrame, networks: DataFrame, lengths: Sequence[int] = tuple(range(8, 33))) -> DataFrame:
    """``pairs(src, dst)`` with each of ``networks(network, prefix_len)`` that
    holds an address of both ends. Each address is masked to every length in
    use, so containment is an equality join."""
    masked = addresses.select("device", F.explode(F.array(*(F.struct(F.lit(n).alias("prefix_len"), network4(F.col("address"), n).alias("network")) for n in lengths))).alias("m")).select("device", "m.*")
    inside = masked.join(networks.distinct(), ["prefix_len", "network"]).distinct()
    a, b = inside.withColumnRenamed("device", "src"), inside.withColumnRenamed("device", "dst")
    return pairs.join(a, "src").join(b, ["dst", "prefix_len", "network"]).distinct()


def _masked(digits: Column, length: Column) -> Column:
    """An address of ``digits`` (a number's 8 or 32 hexadecimal ones) masked to ``length``."""
    return network6(F.rpad(digits, 32, "0"), length)


def _digits(ip: Column) -> Column:
    return F.coalesce(F.lower(F.lpad(F.hex(ipv4(ip)), 8, "0")), ipv6(ip))


def _lengths(prefixes: DataFrame) -> Column:
    """The lengths in use, as an array for each version: 162 numbers at most."""
    used = prefixes.groupBy("version").agg(F.sort_array(F.collect_set("prefix_len")).alias("lengths")).collect()
    found = {r["version"]: r["lengths"] for r in used}
    of = lambda v: F.array(*map(F.lit, found.get(v) or [])).cast("array<int>")
    return F.when(F.col("version") == 4, of(4)).otherwise(of(6))


def prefixes(cidrs: DataFrame) -> DataFrame:
    """(cidr, version, prefix_len, network) of ``cidrs(cidr)``, of both versions;
    unreadable ones go. Networks are 32 hexadecimal digits, those of version 4
    in the first eight."""
    ip, length = F.split("cidr", "/")[0], F.try_element_at(F.split("cidr", "/"), F.lit(2)).try_cast("int")
    rows = cidrs.select("cidr", _digits(ip).alias("_d"), F.when(ipv4(ip).isNotNull(), 4).otherwise(6).alias("version"), length.alias("prefix_len"))
    rows = rows.where("_d is not null and prefix_len between 0 and if(version = 4, 32, 128)").distinct()
    return rows.select("cidr", "version", "prefix_len", _masked(F.col("_d"), F.col("prefix_len")).alias("network"))


def prefix_parents(cidrs: DataFrame) -> DataFrame:
    """(cidr, parent): the longest other prefix that holds each of ``cidrs(cidr)``,
    null without one. A prefix looks itself up under the shorter lengths in use,
    so each meets what holds it by one equality join."""
    rows = prefixes(cidrs)
    keys = rows.withColumn("n", F.explode(F.filter(_lengths(rows), lambda n: n < F.col("prefix_len")))).select("cidr", "version", F.col("n").alias("prefix_len"), _masked(F.col("network"), F.col("n")).alias("network"))
    held = keys.join(rows.withColumnRenamed("cidr", "parent"), ["version", "prefix_len", "network"]).groupBy("cidr").agg(F.max_by("parent", F.struct("prefix_len", "parent")).alias("parent"))
    return rows.select("cidr").join(held, "cidr", "left")


def holding(pairs: DataFrame, addresses: DataFrame, cidrs: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` with each of ``cidrs(cidr)`` that holds an address of
    both ends, ``addresses(device, ip)`` of either version."""
    rows = prefixes(cidrs)
    own = addresses.select("device", _digits(F.col("ip")).alias("_d"), F.when(ipv4(F.col("ip")).isNotNull(), 4).otherwise(6).alias("version")).where("_d is not null")
    keys = own.withColumn("prefix_len", F.explode(_lengths(rows))).select("device", "version", "prefix_len", _masked(F.col("_d"), F.col("prefix_len")).alias("network"))
    inside = keys.join(rows, ["version", "prefix_len", "network"]).select("device", "cidr").distinct()
    return pairs.join(inside.withColumnRenamed("device", "src"), "src").join(inside.withColumnRenamed("device", "dst"), ["dst", "cidr"]).select(*pairs.columns, "cidr").distinct()


def egress(peers: DataFrame, interfaces: DataFrame, rank: Sequence[Column]) -> DataFrame:
    """``peers(peer, peer_ip)`` with the one of ``interfaces(iface, ip)`` that
    shares the longest prefix, of /31 to /24 or /127 to /64, then by ``rank``.
    Interfaces stand once for each prefix of those lengths that holds one. Peers
    look up every eighth length, then the eight from the longest one met, so
    each meets few rows however many interfaces are in its /24 or /64."""
    block = lambda ip: F.coalesce(network4(ipv4(ip), 24).cast("string"), F.substring(ipv6(ip), 1, 16)).alias("_block")
    low = lambda ip: F.coalesce(ipv4(ip), F.conv(F.substring(ipv6(ip), 17, 16), 16, -10).cast("bigint")).alias("_low")
    four = lambda ip: ipv4(ip).isNotNull().alias("_four")
    of = lambda ip: [block(ip), low(ip), four(ip)]
    least = F.when(F.col("_four"), 24).otherwise(64)
    shift = F.when(F.col("_four"), 32).otherwise(128) - F.col("_len")
    # a shift by 64 would be one by 0
    net = F.when(F.col("_len") == 64, F.lit(0)).otherwise(F.call_function("shiftright", F.col("_low"), shift)).alias("_net")
    at = lambda d, lengths: d.withColumn("_len", F.explode(lengths)).withColumn("_net", net)
    best = F.max(F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)), "iface")).alias("_i")
    right = at(interfaces.select("*", *of(F.col("ip"))), F.sequence(least, F.when(F.col("_four"), 31).otherwise(127))).groupBy("_block", "_len", "_net").agg(best)
    key = [*peers.columns, "_block", "_low", "_four"]
    coarse = at(peers.select("*", *of(F.col("peer_ip"))), F.sequence(least, F.when(F.col("_four"), 24).otherwise(120), F.lit(8)))
    longest = coarse.join(right.select("_block", "_len", "_net"), ["_block", "_len", "_net"]).groupBy(*key).agg(F.max("_len").alias("_from"))
    fine = at(longest, F.sequence("_from", F.col("_from") + 7)).join(right, ["_block", "_len", "_net"])
    return fine.groupBy(*peers.columns).agg(F.max(F.struct(F.col("_len").alias("prefix_len"), "_i")).alias("x")).select(*peers.columns, F.col("x._i.iface").alias("iface"), "x.prefix_len")


def local_address(peers: DataFrame, addresses: DataFrame, devices: DataFrame) -> DataFrame:
    """``peers(device, peer_ip)`` with the device's least address in the peer's
    /24 or /64, else its management address."""
    net = lambda ip: F.coalesce(network4(ipv4(ip), 24).cast("string"), network6(ipv6(ip), 64))
    near = addresses.select("device", net(F.col("ip")).alias("net"), "ip").groupBy("device", "net").agg(F.min("ip").alias("_ip"))
    rows = peers.withColumn("net", net(F.col("peer_ip"))).join(near, ["device", "net"], "left").drop("net")
    return rows.join(devices.select("device", "mgmt_ip"), "device", "left").withColumn("local_ip", F.coalesce("_ip", "mgmt_ip")).drop("_ip", "mgmt_ip")


def upstream(edge: DataFrame, gates: DataFrame, links: DataFrame, hops: int = 6) -> DataFrame:
    """(device, upstream, hops): for each of ``edge(id, site)`` the nearest of
    ``gates(id, site)`` within ``hops`` physical links, of the same site if
    there is one; else the internet."""
    near = nearest(links, gates.select(F.col("id").alias("node"), "site"), hops)
    met = edge.withColumnRenamed("site", "own").join(near, edge["id"] == near["node"])
    best = met.groupBy("id").agg(F.min_by(F.struct("gate", "distance"), F.struct((~F.col("own").eqNullSafe(F.col("site"))).alias("far"), "distance", "gate")).alias("x"))
    return edge.join(best, "id", "left").select(F.col("id").alias("device"), F.coalesce("x.gate", F.lit("internet:0")).alias("upstream"), F.col("x.distance").alias("hops"))


def external_routers(peers: DataFrame, home: int) -> tuple[DataFrame, DataFrame]:
    """Routers of other public networks that ``peers(device, peer_ip, remote_as)``
    name, as nodes (id, asn, ip), and the links device to router to internet."""
    far = peers.where(is_public_asn(F.col("remote_as")) & (F.col("remote_as") != home)).withColumn("id", F.concat_ws(":", F.lit("ext-router"), F.col("remote_as").cast("string"), "peer_ip"))
    nodes = far.groupBy("id").agg(F.min("remote_as").alias("asn"), F.min("peer_ip").alias("ip"))
    up = far.select(F.col("device").alias("src"), F.col("id").alias("dst"), F.lit("WAN_UPLINK").alias("type")).distinct()
    return nodes, up.union(nodes.select(F.col("id").alias("src"), F.lit("internet:0").alias("dst"), F.lit("TRANSITS").alias("type")))


def uplink_health(uplinks: DataFrame) -> DataFrame:
    """State, score and reason of ``uplinks(uplink_status, status, snmp_health)``."""
    oper = uplink_oper(F.col("uplink_status"), F.col("status"))
    dark = F.lower(F.coalesce("snmp_health", F.lit(""))).isin("unreachable", "cloud_only", "stale")
    status = F.when(F.col("oper_status") == "down", "critical").when(dark, "unknown").otherwise("healthy")
    return uplinks.withColumn("oper_status", oper).withColumns({"health_score": F.when(F.col("oper_status") == "down", 80).otherwise(0), "health_status": status})


def gateway_state(uplinks: DataFrame) -> DataFrame:
    """Each device's state from its uplinks: up if one is, down if all are, else the first known."""
    up, down = F.col("oper_status") == "up", F.col("oper_status") == "down"
    return uplinks.groupBy("device").agg(F.when(F.bool_or(up), "up").when(F.bool_and(down), "down").otherwise(F.min("oper_status")).alias("oper_state"), F.max("health_score").alias("health_score"))


def home_asn(peers: DataFrame) -> DataFrame:
    """The own autonomous system of ``peers(peer, device, site, local_as,
    remote_as)``: a public local_as, by peers, devices and sites; else the public
    remote_as of two sites or three devices, by sites, devices and peers."""
    counts = [F.count_distinct("site").alias("sites"), F.count_distinct("device").alias("devices"), F.count_distinct("peer").alias("peers")]
    local = peers.where(is_public_asn(F.col("local_as"))).groupBy(F.col("local_as").alias("asn")).agg(*counts).withColumn("rank", F.struct(F.lit(1), "peers", "devices", "sites", -F.col("asn")))
    remote = peers.where(is_public_asn(F.col("remote_as"))).groupBy(F.col("remote_as").alias("asn")).agg(*counts).where("sites >= 2 or devices >= 3").withColumn("rank", F.struct(F.lit(0), "sites", "devices", "peers", -F.col("asn")))
    fields = "struct<k:int,a:bigint,b:bigint,c:bigint,d:bigint>"
    both = local.withColumn("rank", F.col("rank").cast(fields)).union(remote.withColumn("rank", F.col("rank").cast(fields)))
    return both.orderBy(F.desc("rank")).limit(1).drop("rank")


def domain_roots(members: DataFrame) -> DataFrame:
    """(domain, root, size) of ``members(domain, device, bridge_priority,
    stp_priority, is_root)``: declared roots first, then by priority and id."""
    order = F.struct((~F.coalesce("is_root", F.lit(False))).alias("r"), F.coalesce("bridge_priority", "stp_priority", F.lit(32768)).alias("p"), F.col("device").alias("d"))
    return members.groupBy("domain").agg(F.min_by("device", order).alias("root"), F.count_distinct("device").alias("size"))


def device_domains(members: DataFrame) -> DataFrame:
    """The domain that each device is shown in: where it is root, then of the
    least priority, named ones first; ``members(device, domain, name, is_root, priority)``."""
    w = Window.partitionBy("device").orderBy(F.desc(F.coalesce("is_root", F.lit(False))), F.coalesce("priority", F.lit(32768)), F.col("name").isNull(), "domain")
    return members.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_domains(roots: DataFrame) -> DataFrame:
    """(domain, into) for unnamed domains whose root device is a named one's
    too; ``roots(domain, name, device)``; the least of several."""
    named = roots.where("coalesce(name, '') <> ''").groupBy("device").agg(F.min("domain").alias("into"))
    return roots.where("coalesce(name, '') = ''").join(named, "device").groupBy("domain").agg(F.min("into").alias("into"))


def stp_topology(links: DataFrame, membership: DataFrame) -> DataFrame:
    """Links with whether they leave the domain, and its size and own links of each device."""
    d = membership.groupBy("device").agg(F.min("domain").alias("domain"))
    size = d.groupBy("domain").agg(F.count("*").alias("domain_size"))
    rows = links.join(d.withColumnsRenamed({"device": "src", "domain": "domain_a"}), "src", "left").join(d.withColumnsRenamed({"device": "dst", "domain": "domain_b"}), "dst", "left")
    return rows.withColumn("inter_domain", F.col("domain_a") != F.col("domain_b")).join(size.withColumnRenamed("domain", "domain_a"), "domain_a", "left")


def canonical_vlans(members: DataFrame) -> DataFrame:
    """(canonical, vid, name, devices) of ``members(device, vid, name, site_slug,
    platform_site)``: one VLAN for each site and number; the most frequent slug
    of a platform site's devices counts, without one the platform site itself."""
    rows = members.where(F.col("vid").between(1, 4094))
    slugs = dominant_slug(rows.where("site_slug <> ''").select("device", "platform_site", F.col("site_slug").alias("slug")).distinct()).select(F.col("platform_site").alias("_p"), F.col("slug").alias("_slug"))
    rows = rows.join(slugs, F.col("platform_site") == F.col("_p"), "left")
    key = F.when(F.coalesce("site_slug", "_slug").isNotNull(), F.concat_ws(":", F.lit("vlan:nb"), F.coalesce("site_slug", "_slug"), "vid")).otherwise(F.concat_ws(":", F.lit("vlan"), "platform_site", "vid"))
    return rows.groupBy(key.alias("canonical"), "vid").agg(F.min("name").alias("name"), F.sort_array(F.collect_set("device")).alias("devices"))


def vlan_prefixes(*evidence: tuple[str, DataFrame]) -> DataFrame:
    """(vlan, prefix) with a flag for each kind of evidence ``(name, (vlan, prefix))``."""
    rows = None
    for name, found in evidence:
        part = found.select("vlan", "prefix", *(F.lit(n == name).alias(f"via_{n}") for n, _ in evidence))
        rows = part if rows is None else rows.union(part)
    return rows.groupBy("vlan", "prefix").agg(*(F.bool_or(f"via_{n}").alias(f"via_{n}") for n, _ in evidence))


def vlan_labels(linked: DataFrame) -> DataFrame:
    """Sorted IPv4 and IPv6 prefixes of each VLAN."""
    pick = lambda six: F.sort_array(F.collect_set(F.when(F.col("prefix").contains(":") == six, F.col("prefix"))))
    return linked.groupBy("vlan").agg(pick(False).alias("prefix_v4"), pick(True).alias("prefix_v6"))


def absorbed_prefixes(prefixes: DataFrame, vlans: DataFrame, links: DataFrame) -> DataFrame:
    """``prefixes(prefix)`` with what shows them already: a VLAN of
    ``vlans(vlan, prefix)`` first, else a link of ``links(rid, prefixes)``."""
    by_vlan = vlans.groupBy("prefix").agg(F.min("vlan").cast("string").alias("_v"))
    by_link = links.select("rid", F.explode("prefixes").alias("prefix")).groupBy("prefix").agg(F.min("rid").cast("string").alias("_l"))
    rows = prefixes.join(by_vlan, "prefix", "left").join(by_link, "prefix", "left")
    return rows.withColumns({"absorbed_by": F.coalesce("_v", "_l"), "absorbed_into": F.when(F.col("_v").isNotNull(), "vlan").when(F.col("_l").isNotNull(), "link")}).drop("_v", "_l")


def site_vlans(devices: DataFrame, vlans: DataFrame, members: DataFrame) -> DataFrame:
    """(device, vlan) that are missing so that every live device of a site is a
    member of the site's VLANs: ``devices(device, site, live)``, ``vlans(vlan, site)``."""
    return devices.where("live").join(vlans, "site").select("device", "vlan").distinct().join(members.select("device", "vlan"), ["device", "vlan"], "left_anti")


def match_peers(peers: DataFrame, devices: DataFrame) -> DataFrame:
    """``peers(peer, peer_ip)`` with the device behind the address: by interface
    address, then management address, then candidates; all keys are one table,
    so the match is one equality join. ``devices(id, ips, mgmt_ip, candidate_ips)``."""
    none = F.array().cast("array<string>")
    ranked = lambda column, rank: F.transform(F.coalesce(column, none), lambda x: F.struct(x.alias("ip"), F.lit(rank).alias("rank")))
    keys = F.concat(ranked("ips", 0), ranked(F.array("mgmt_ip"), 1), ranked("candidate_ips", 2))
    table = devices.select("id", F.explode(keys).alias("k")).select("id", "k.*").where("ip is not null").groupBy("ip").agg(F.min_by("id", F.struct("rank", "id")).alias("remote_device"))
    return peers.join(table.withColumnRenamed("ip", "peer_ip"), "peer_ip", "left")


def adjacencies(sessions: DataFrame) -> DataFrame:
    """One row for each session of ``sessions(proto, device, remote_device,
    local_ip, peer_ip, local_as, remote_as, state)``, whichever end told of it;
    ends in order of their ids; a state of up wins, then one of down."""
    turn = F.col("remote_device").isNotNull() & (F.col("remote_device") < F.col("device"))
    flip = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    afi = F.when(F.col("peer_ip").contains(":"), "ipv6").otherwise("ipv4")
    ends = sessions.select("proto", afi.alias("afi"), flip("device", "remote_device").alias("src"), F.coalesce(flip("remote_device", "device"), "peer_ip").alias("dst"), flip("local_ip", "peer_ip").alias("local_ip"), flip("peer_ip", "local_ip").alias("remote_ip"), flip("local_as", "remote_as").alias("local_as"), flip("remote_as", "local_as").alias("remote_as"), peer_state(F.col("state")).alias("state"))
    return ends.groupBy("proto", "afi", "src", "dst", "local_ip", "remote_ip").agg(F.max("local_as").alias("local_as"), F.max("remote_as").alias("remote_as"), F.max_by("state", F.array_position(F.array(F.lit("unknown"), F.lit("down"), F.lit("up")), F.col("state"))).alias("state"))


def peer_state(value: Column) -> Column:
    """``up`` for a session in its steady state, ``down`` for any other state,
    ``unknown`` without one."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("full", "established"), "up").when(low != "", "down").otherwise("unknown")


def health_rank(status: Column) -> Column:
    return F.when(F.lower(status).isin(*DOWN), 2).when(F.lower(status) == "alerting", 1).otherwise(0)
