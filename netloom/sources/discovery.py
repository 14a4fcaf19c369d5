"""From exported objects to nodes and edges, one mapping for each kind of platform.

Objects are read as VARIANT, so fields that a vendor adds, drops or nests
otherwise cost nothing but themselves: a path that isn't there is null, a line
that isn't an object gives no rows. Every mapping takes ``objects(instance,
kind, file, line, v)`` and gives graph rows (instance, kind, id, src, dst, type, interface_a,
interface_b, props); ``discover`` adds whose they are. Properties are text;
lists and nested objects become compact JSON; nulls are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions.decode import storable
from netloom.functions.health import agent_status, endpoint_status, firewall_status, reachability, scope_kind
from netloom.functions.names import collapse, dashed, lookup, mac, normalize_ifname, pick, slug
from netloom.functions.network import ensure_cidr, ip_version, is_useful_ip
from netloom.operators.paths import shared_folder
from netloom.sources import inventory

COLUMNS = ["kind", "id", "src", "dst", "type", "interface_a", "interface_b", "props"]
# fixed values
MERAKI_ROLES = {"appliance": "firewall", "switch": "switch", "wireless": "access-point", "camera": "camera", "sensor": "sensor", "cellularGateway": "router"}
CATALYST_ROLES = {"Switches and Hubs": "switch", "Routers": "router", "Wireless Controller": "wireless-controller", "Access Points": "access-point", "Unified AP": "access-point"}


def text(path: str, of: str | Column = "v") -> Column:
    """The text at a path of a VARIANT, numbers and nested values as JSON; null if there is none."""
    return F.try_variant_get(F.col(of) if isinstance(of, str) else of, f"$.{path}" if not path.startswith("[") else f"${path}", "string")


def items(path: str, of: str = "v") -> Column:
    """The elements of a list at a path; empty if there is none."""
    return F.coalesce(F.try_variant_get(of, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def fields(of: str | Column = "v") -> Column:
    """An object's fields as stored properties: text, nested values as compact
    JSON, without nulls and names that a node or edge has itself."""
    every = F.try_variant_get(of, "$", "map<string,variant>")
    return storable(F.map_filter(F.transform_values(every, lambda _, x: x.cast("string")), lambda _, x: x.isNotNull()))


def props(**named: Column | str) -> Column:
    pairs = [x for k, v in named.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.map_filter(F.create_map(*pairs), lambda _, x: x.isNotNull())


def overlaid(below: Column, above: Column) -> Column:
    """``above`` over ``below``, which may be null."""
    below = F.coalesce(below, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k)), above)


def none() -> Column:
    return F.lit(None).cast("string")


def node(rows: DataFrame, key: Column, kind: str, values: Column) -> DataFrame:
    return rows.select("instance", F.lit("node").alias("kind"), key.alias("id"), none().alias("src"), none().alias("dst"), F.lit(kind).alias("type"), none().alias("interface_a"), none().alias("interface_b"), values.alias("props")).where("id is not null")


def edge(rows: DataFrame, src: Column, dst: Column, kind: str, values: Column | None = None, a: Column | None = None, b: Column | None = None) -> DataFrame:
    values = F.create_map().cast("map<string,string>") if values is None else values
    a, b = (none() if x is None else x for x in (a, b))
    return rows.select("instance", F.lit("edge").alias("kind"), none().alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), a.alias("interface_a"), b.alias("interface_b"), values.alias("props")).where("src is not null and dst is not null")


def key(*parts: Column | str) -> Column:
    """Parts joined by colons; null if one is null or empty."""
    cells = [F.lit(p) if isinstance(p, str) else p for p in parts]
    whole = reduce(lambda a, b: a & b, [c != "" for c in cells])
    return F.when(whole, F.concat_ws(":", *cells))


def both(*rows: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def once(rows: DataFrame, *by: str) -> DataFrame:
    """The first row of each key in the order of lines."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("instance", *by).orderBy("file", "line"))).where("_k = 1").drop("_k")


def of(objects: DataFrame, kind: str) -> DataFrame:
    return objects.where(F.col("kind") == kind)


def addresses(rows: DataFrame, holder: Column, ip: Column, values: Column | None = None) -> DataFrame:
    """Address nodes and the edges of those that hold them."""
    with_ip = rows.withColumns({"_holder": holder, "_ip": F.when(is_useful_ip(ip) & ip_version(ip).isNotNull(), ip)}).where("_ip is not null")
    where = key("ip", F.col("_ip"))
    return both(
        node(once(with_ip, "_ip"), where, "IPAddress", props(address=F.col("_ip"), name=F.col("_ip"), version=F.concat(F.lit("ipv"), ip_version(F.col("_ip"))))),
        edge(with_ip, F.col("_holder"), where, "ASSIGNED_IP", values),
    )


# cloud-managed networks


def meraki(objects: DataFrame) -> DataFrame:
    """Kinds: networks, devices, uplinks, vlans (with networkId), prefixes, topology (links of two ends), lldp (serial, ports), vpn, clients."""
    networks, devices = of(objects, "networks"), once(of(objects, "devices").withColumn("serial", text("serial")), "serial")
    site = key("meraki-network", text("id"))
    out = [node(networks, site, "PlatformSite", props(name=F.coalesce(text("name"), text("id")), slug=text("id"), network_id=text("id"), product_types=F.coalesce(text("productTypes"), F.lit("[]")), platform="meraki", normalized_name=slug(F.coalesce(text("name"), text("id")))))]

    # an uplink's first useful address of each slot counts
    up = of(objects, "uplinks").select("instance", text("serial").alias("serial"), F.posexplode(items("uplinks")).alias("_n", "u"))
    at = up.select("instance", "serial", "_n", text("interface", "u").alias("slot"), *(F.when(is_useful_ip(text(p, "u")), text(p, "u")).alias(c) for p, c in (("ip", "ip"), ("publicIp", "public"))))
    first = lambda slot, c: F.min_by(F.when(F.col("slot") == slot, F.col(c)), F.when((F.col("slot") == slot) & F.col(c).isNotNull(), F.col("_n"))).alias(f"{slot}_{c}")
    uplinks = at.groupBy("instance", "serial").agg(*(first(s, c) for s in ("wan1", "wan2") for c in ("ip", "public")))
    inner = of(objects, "vlans").select("instance", text("networkId").alias("network"), F.try_variant_get("v", "$.id", "int").alias("vid"), F.when(is_useful_ip(text("applianceIp")), text("applianceIp")).alias("ip")).where("ip is not null")
    inner = inner.groupBy("instance", "network").agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", "ip"))), lambda x: x["ip"]).alias("_inner"))
    member = of(objects, "vpn").select("instance", text("deviceSerial").alias("serial")).where("serial is not null").distinct().withColumn("_vpn", F.lit(True))
    known = devices.withColumn("network", text("networkId")).join(uplinks, ["instance", "serial"], "left").join(inner, ["instance", "network"], "left").join(member, ["instance", "serial"], "left")
    gateway, tunnelled = F.coalesce(text("productType"), F.lit("switch")) == "appliance", F.coalesce("_vpn", F.lit(False))
    primary = F.when(gateway & tunnelled, F.coalesce(F.try_element_at("_inner", F.lit(1)), "wan1_ip", "wan2_ip")).when(gateway, F.coalesce("wan1_ip", "wan2_ip")).otherwise(F.nullif(text("lanIp"), F.lit("")))
    candidates = F.array_distinct(F.array_compact(F.concat(F.array(primary), F.when(gateway, F.concat(F.coalesce("_inner", F.array().cast("array<string>")), F.array("wan1_ip", "wan2_ip", "wan1_public", "wan2_public"))).otherwise(F.array().cast("array<string>")))))
    own = key("meraki", F.col("serial"))
    out.append(node(known, own, "Device", props(
        name=F.coalesce(F.nullif(collapse(text("name")), F.lit("")), F.col("serial")), platform="meraki", platform_id=F.col("serial"), serial=F.col("serial"),
        role=lookup(F.coalesce(text("productType"), F.lit("switch")), MERAKI_ROLES, F.lit("other")), mgmt_ip=primary, candidate_ips=F.when(F.size(candidates) > 0, F.to_json(candidates)),
        networkId=text("networkId"), model=text("model"), firmware=text("firmware"), os_version=F.coalesce(text("firmware"), F.lit("")), status=pick(text("status"), F.lit("active")), productType=F.coalesce(text("productType"), F.lit("switch")),
        tags=F.coalesce(text("tags"), F.lit("[]")), lat=text("lat"), lng=text("lng"), address=F.coalesce(text("address"), F.lit("")), mac=mac(text("mac")),
        wan1_ip=F.col("wan1_ip"), wan2_ip=F.col("wan2_ip"), wan1_public_ip=F.col("wan1_public"), wan2_public_ip=F.col("wan2_public"), on_sdwan=(gateway & tunnelled).cast("string"),
    )))
    sites = networks.select("instance", text("id").alias("network")).distinct()
    out.append(edge(known.join(sites, ["instance", "network"]), own, key("meraki-network", F.col("network")), "LOCATED_AT"))
    address = mac(text("mac"))
    out += [node(known, key("mac", address), "MACAddress", props(mac=address, source=F.concat(F.lit("meraki/"), "instance"))), edge(known, own, key("mac", address), "OWNS_MAC")]
    out.append(node(of(objects, "vlans"), key("meraki-vlan", text("networkId"), text("id")), "VLAN", props(name=F.coalesce(text("name"), F.concat(F.lit("VLAN"), text("id"))), vid=text("id"))))
    prefix = ensure_cidr(F.trim(text("cidr")))
    out.append(node(once(of(objects, "prefixes").where(F.trim(text("cidr")).rlike("/")).withColumn("cidr", prefix), "cidr"), key("prefix", F.col("cidr")), "Prefix", props(cidr=F.col("cidr"), name=pick(text("name"), F.col("cidr")), scope=text("scope"), kind=scope_kind(text("scope")), vlan_id=text("vlan_id"), network_id=text("network_id"), device_serial=text("device_serial"), next_hop=text("next_hop"))))

    serials = devices.select("instance", "serial", address.alias("mac"))
    ends = of(objects, "topology").where(F.size(items("ends")) == 2).select("instance", *(text(f"ends[{i}].device.serial").alias(f"s{i}") for i in (0, 1)), *(F.coalesce(text(f"ends[{i}].discovered.portId"), F.lit("unknown")).alias(f"p{i}") for i in (0, 1)))
    for i in (0, 1):
        ends = ends.join(serials.select("instance", F.col("serial").alias(f"s{i}")), ["instance", f"s{i}"])
    cable = lambda a, b, proto: props(interface_a=normalize_ifname(a), interface_b=normalize_ifname(b), interface_a_raw=a, interface_b_raw=b, discovery_proto=proto)
    out.append(edge(ends, key("meraki", F.col("s0")), key("meraki", F.col("s1")), "PHYSICAL_LINK", cable(F.col("p0"), F.col("p1"), "meraki"), normalize_ifname(F.col("p0")), normalize_ifname(F.col("p1"))))

    # neighbours that a switch's ports announce: a known device by its address, else a stub by its name, else a bare address
    ports = of(objects, "lldp").withColumn("serial", text("serial")).join(serials.drop("mac"), ["instance", "serial"])
    ports = ports.select("instance", "serial", F.explode(F.try_variant_get("v", "$.ports", "map<string,variant>")).alias("port", "p"))
    iface = key("meraki-if", F.col("serial"), F.col("port"))
    out += [node(ports, iface, "Interface", props(name=F.concat(F.lit("Port "), "port"), device_id=F.col("serial"), port_id=F.col("port"))), edge(ports, key("meraki", F.col("serial")), iface, "HAS_INTERFACE")]
    heard = lambda p: F.when(F.try_variant_get("p", "$.lldp", "variant").isNotNull(), text(f"lldp.{p}", "p")).otherwise(text(f"cdp.{p}", "p"))
    seen = ports.select(
        "instance", "serial", "port", mac(pick(heard("chassisId"), heard("address"))).alias("chassis"), F.split(F.coalesce(pick(heard("systemName"), heard("deviceId")), F.lit("")), "[.]")[0].alias("name"),
        F.coalesce(heard("portId"), F.lit("")).alias("far"), F.when(F.try_variant_get("p", "$.lldp", "variant").isNotNull(), "lldp").otherwise("cdp").alias("proto"),
        pick(text("lldp.managementAddress", "p"), text("cdp.managementAddress", "p"), text("cdp.address", "p")).alias("at"), pick(text("cdp.platform", "p")).alias("model"), F.substring(pick(text("lldp.systemDescription", "p"), text("cdp.version", "p")), 1, 240).alias("descr"),
    ).where("chassis is not null or name <> ''")
    by_mac = serials.where("mac is not null").groupBy("instance", F.col("mac").alias("chassis")).agg(F.min("serial").alias("other"))
    seen = seen.join(by_mac, ["instance", "chassis"], "left").withColumn("near", F.concat(F.lit("Port "), "port"))
    one = Window.partitionBy("instance", F.least("serial", "other"), F.greatest("serial", "other")).orderBy("serial", "port")
    devices_met = seen.where("other is not null").withColumn("_n", F.row_number().over(one)).where("_n = 1")
    stubs = seen.where("other is null and name <> ''")
    named = Window.partitionBy("instance", "name").orderBy("serial", "port")
    link = dict(a=normalize_ifname(F.col("near")), b=normalize_ifname(F.col("far")))
    out += [
        edge(devices_met, key("meraki", F.col("serial")), key("meraki", F.col("other")), "PHYSICAL_LINK", cable(F.col("near"), F.col("far"), F.col("proto")), **link),
        node(stubs.withColumn("_n", F.row_number().over(named)).where("_n = 1"), key("lldp-neighbor", F.col("name")), "Device", props(name=F.col("name"), platform=F.when(F.col("model").isNotNull(), "cisco").otherwise("unknown"), role="other", stub="true", discovered_via=F.col("proto"), discovered_by=F.concat(F.lit("meraki/"), "instance"), mgmt_ip=F.col("at"), candidate_ips=F.when(F.col("at").isNotNull(), F.to_json(F.array("at"))), model=F.col("model"), sys_descr=F.col("descr"), chassis_mac=F.col("chassis"))),
        edge(stubs, key("meraki", F.col("serial")), key("lldp-neighbor", F.col("name")), "PHYSICAL_LINK", cable(F.col("near"), F.col("far"), F.col("proto")), **link),
    ]
    bare = seen.where("other is null and name = ''")
    out += [node(bare, key("mac", F.col("chassis")), "MACAddress", props(mac=F.col("chassis"), hostname="", source=F.concat(F.lit("meraki/"), "instance"), neighbor_port=F.col("far"))), edge(bare, key("meraki-if", F.col("serial"), F.col("port")), key("mac", F.col("chassis")), "LEARNED_MAC", props(discovery_proto=F.col("proto")))]
    return both(*out, _clients(of(objects, "clients"), serials))


def _clients(clients: DataFrame, serials: DataFrame) -> DataFrame:
    """Clients' addresses and the switch ports that they were seen on last."""
    rows = clients.select("instance", "file", "line", "v", mac(text("mac")).alias("mac"), pick(text("ip"), text("ip6")).alias("ip"), text("recentDeviceSerial").alias("serial"), text("switchport").alias("port")).where("mac is not null")
    who, arp = key("mac", F.col("mac")), key("arp", F.col("ip"))
    ports = rows.where("port <> ''").join(serials.select("instance", "serial"), ["instance", "serial"])
    iface = key("meraki-if", F.col("serial"), F.col("port"))
    source = F.concat(F.lit("meraki/"), "instance")
    return both(
        node(once(rows, "mac"), who, "MACAddress", props(mac=F.col("mac"), description=F.coalesce(text("description"), F.lit("")), vlan=text("vlan"), source=source, ip=F.col("ip"))),
        node(once(rows, "ip"), arp, "ARPEntry", props(ip=F.col("ip"), mac=F.col("mac"), vlan=text("vlan"), connection_type=F.coalesce(text("recentDeviceConnection"), F.lit("")), source=source)),
        edge(rows, who, arp, "HAS_ARP"),
        node(ports, iface, "Interface", props(name=F.concat(F.lit("Port "), "port"), device_id=F.col("serial"), port_id=F.col("port"))),
        edge(ports, key("meraki", F.col("serial")), iface, "HAS_INTERFACE"),
        edge(ports, iface, who, "LEARNED_MAC", props(vlan=text("vlan"))),
    )


# campus controllers


def catalyst_center(objects: DataFrame) -> DataFrame:
    """Kinds: sites, devices, interfaces and vlans (with deviceId), topology_nodes, topology (links), hosts."""
    sites, devices = of(objects, "sites"), once(of(objects, "devices").withColumn("device", text("id")), "device")
    name = F.coalesce(text("name"), text("id"))
    site_type = F.coalesce(text("additionalInfo[0].attributes.type"), F.lit(""))
    out = [node(sites, key("catc-site", text("id")), "PlatformSite", props(name=name, slug=F.replace(F.lower(name), F.lit(" "), F.lit("-")), site_type=site_type, platform="catalyst_center", normalized_name=slug(name)))]
    own, address = key("catc", F.col("device")), F.nullif(text("managementIpAddress"), F.lit(""))
    out.append(node(devices, own, "Device", props(
        name=pick(text("hostname"), address, F.col("device")), platform="catalyst_center", platform_id=F.col("device"), role=lookup(text("family"), CATALYST_ROLES, F.lit("other")), serial=F.coalesce(text("serialNumber"), F.lit("")), mgmt_ip=address,
        status=pick(F.lower(text("reachabilityStatus")), F.lit("active")), family=text("family"), series=text("series"), type=text("type"), softwareVersion=text("softwareVersion"), macAddress=mac(text("macAddress")), siteId=text("siteId"),
    )))
    # a device of no known site goes to a container for those
    known = sites.select("instance", text("id").alias("site")).distinct().withColumn("_known", F.lit(True))
    placed = devices.withColumn("site", text("siteId")).join(known, ["instance", "site"], "left")
    rest = key("catc-site", "unassigned", F.col("instance"))
    out.append(edge(placed, own, F.when(F.col("_known"), key("catc-site", F.col("site"))).otherwise(rest), "LOCATED_AT"))
    out.append(node(placed.where("_known is null").select("instance").distinct(), rest, "PlatformSite", props(name=F.concat(F.lit("CATC "), "instance", F.lit(" (unassigned)")), slug=F.concat(F.lit("catc-unassigned-"), "instance"), platform="catalyst_center", normalized_name=F.concat(F.lit("catc "), "instance", F.lit(" unassigned")))))
    ids = devices.select("instance", "device")
    ifaces = of(objects, "interfaces").withColumn("device", text("deviceId")).join(ids, ["instance", "device"])
    iface, hw, ip = key("catc-if", F.col("device"), text("id")), mac(text("macAddress")), F.nullif(text("ipv4Address"), F.lit(""))
    out += [
        node(ifaces, iface, "Interface", overlaid(F.map_filter(fields(), lambda k, x: (x != "") & ~k.isin("deviceId", "portName")), props(name=F.coalesce(text("portName"), F.lit("")), description=F.coalesce(text("description"), F.lit("")), device_id=F.col("device"), enabled=(F.lower(text("adminStatus")) == "up").cast("string")))),
        edge(ifaces, own, iface, "HAS_INTERFACE"),
        node(once(ifaces.withColumn("_mac", hw).where("_mac is not null"), "_mac"), key("mac", F.col("_mac")), "MACAddress", props(mac=F.col("_mac"), source=F.concat(F.lit("catalyst_center/"), "instance"))),
        edge(ifaces, own, key("mac", hw), "OWNS_MAC", props(interface=F.coalesce(text("portName"), F.lit("")))),
        node(ifaces, key("catc-ip", ip), "IPAddress", props(address=ip, mask=F.coalesce(text("ipv4Mask"), F.lit("")), prefix=F.concat_ws("/", ip, F.coalesce(text("ipv4Mask"), F.lit(""))))),
        edge(ifaces, iface, key("catc-ip", ip), "ASSIGNED_IP"),
    ]
    vlans = of(objects, "vlans").withColumns({"device": text("deviceId"), "vid": pick(text("vlanNumber"), text("interfaceVlan")).try_cast("int")}).where("vid between 1 and 4094").join(ids, ["instance", "device"])
    vlan = key("vlan:catc", F.col("device"), F.col("vid").cast("string"))
    out += [
        node(once(vlans, "device", "vid"), vlan, "VLAN", props(name=F.concat(F.lit("VLAN "), "vid"), vid=F.col("vid").cast("string"), vlan_id=F.col("vid").cast("string"), description=F.coalesce(text("description"), F.lit("")), owning_device_platform_id=F.col("device"))),
        edge(vlans, own, vlan, "LOGICAL_MEMBER", props(interface=F.coalesce(text("interfaceName"), F.lit("")), ip=F.coalesce(text("ipAddress"), F.lit("")), network=F.coalesce(text("networkAddress"), F.lit("")))),
    ]
    # the topology's own nodes name devices by id or, failing that, by address
    met = of(objects, "topology_nodes").select("instance", F.coalesce(pick(text("id")), text("deviceId")).alias("at"), F.array_compact(F.array(text("id"), text("deviceId"))).alias("ids"), pick(text("ip"), text("managementIp")).alias("ip"))
    by_id = met.select("instance", "at", F.posexplode("ids").alias("_n", "device")).join(ids, ["instance", "device"]).groupBy("instance", "at").agg(F.min_by("device", "_n").alias("by_id"))
    by_ip = devices.select("instance", "device", address.alias("ip")).where("ip is not null").groupBy("instance", "ip").agg(F.max("device").alias("by_ip"))
    there = met.join(by_id, ["instance", "at"], "left").join(by_ip, ["instance", "ip"], "left").select("instance", "at", F.coalesce("by_id", "by_ip").alias("device")).where("device is not null").distinct()
    ends = of(objects, "topology").select("instance", "file", "line", "v", pick(text("source"), text("startDeviceId")).alias("a"), pick(text("target"), text("endDeviceId")).alias("b"))
    for x in ("a", "b"):
        ends = ends.join(there.select("instance", F.col("at").alias(x), F.col("device").alias(f"d{x}")), ["instance", x])
    ends = once(ends.where("da <> db").withColumns({"lo": F.least("da", "db"), "hi": F.greatest("da", "db")}), "lo", "hi")
    a, b = (F.coalesce(pick(text(f"{x}PortName"), text(f"{x}PortID")), F.lit("")) for x in ("start", "end"))
    out.append(edge(ends, key("catc", F.col("da")), key("catc", F.col("db")), "PHYSICAL_LINK", props(interface_a=normalize_ifname(a), interface_b=normalize_ifname(b), interface_a_raw=a, interface_b_raw=b, link_status=F.coalesce(text("linkStatus"), F.lit("")), discovery_proto="catc_topology"), normalize_ifname(a), normalize_ifname(b)))
    hosts = of(objects, "hosts").withColumns({"mac": mac(text("hostMac")), "ip": F.nullif(F.trim(text("hostIp")), F.lit(""))}).where("mac is not null")
    source, who, arp = F.concat(F.lit("catalyst_center/"), "instance"), key("mac", F.col("mac")), key("arp", F.col("ip"))
    out += [
        node(once(hosts, "mac"), who, "MACAddress", props(mac=F.col("mac"), vlan=text("vlanId"), host_type=F.coalesce(text("hostType"), F.lit("")), hostname=F.coalesce(text("hostName"), F.lit("")), source=source, ip=F.col("ip"))),
        node(once(hosts, "ip"), arp, "ARPEntry", props(ip=F.col("ip"), mac=F.col("mac"), vlan=text("vlanId"), source=source)),
        edge(hosts, who, arp, "HAS_ARP"),
    ]
    return both(*out)


# fabrics


def nexus_dashboard(objects: DataFrame) -> DataFrame:
    """Kinds: fabrics, switches, links (with fabricName), vrfs, networks."""
    fabrics = of(objects, "fabrics").withColumn("fabric", pick(text("fabricName"), text("name"))).where("fabric is not null")
    switches = once(of(objects, "switches").withColumns({"serial": text("serialNumber"), "fabric": text("fabricName")}), "serial")
    home, own = key("ndfc-fabric", F.col("instance"), F.col("fabric")), key("ndfc", F.col("instance"), F.col("serial"))
    vtep = F.nullif(text("vtepIp"), F.lit(""))
    out = [
        node(fabrics, home, "PlatformSite", props(name=F.col("fabric"), slug=F.replace(F.lower("fabric"), F.lit(" "), F.lit("-")), fabric_type=F.coalesce(text("fabricType"), F.lit("")), template=F.coalesce(text("templateName"), F.lit("")), asn=F.coalesce(text("bgpAsn"), F.lit("")), platform="nexus_dashboard", normalized_name=slug(F.col("fabric")))),
        node(switches, own, "Device", props(name=pick(text("logicalName"), text("hostName"), F.col("serial")), platform="nexus_dashboard", platform_id=F.col("serial"), serial=F.col("serial"), role=pick(text("switchRole"), F.lit("switch")), mgmt_ip=F.nullif(text("ipAddress"), F.lit("")), fabricName=F.col("fabric"), model=text("model"), release=text("release"), vtepIp=vtep, status=text("status"))),
        edge(switches.join(fabrics.select("instance", "fabric").distinct(), ["instance", "fabric"]), own, home, "LOCATED_AT"),
        node(once(switches.withColumn("_vtep", vtep).where("_vtep is not null"), "_vtep"), key("ndfc-vtep", F.col("_vtep")), "IPAddress", props(address=F.col("_vtep"), role="vtep")),
        edge(switches, own, key("ndfc-vtep", vtep), "ASSIGNED_IP"),
    ]
    side = lambda i, p: text(f"['sw{i}-info']['{p}']")
    links = of(objects, "links").select("instance", "file", "line", "v", text("fabricName").alias("fabric"), *(side(i, "sw-serial-number").alias(f"s{i}") for i in (1, 2)), *(F.coalesce(side(i, "if-name"), F.lit("")).alias(f"p{i}") for i in (1, 2)))
    ids = switches.select("instance", "serial")
    for i in (1, 2):
        links = links.join(ids.withColumnRenamed("serial", f"s{i}"), ["instance", f"s{i}"])
    links = once(links.where("s1 <> s2").withColumns({"lo": F.least("s1", "s2"), "hi": F.greatest("s1", "s2")}), "fabric", "lo", "hi")
    out.append(edge(links, key("ndfc", F.col("instance"), F.col("s1")), key("ndfc", F.col("instance"), F.col("s2")), "PHYSICAL_LINK", props(fabric=F.col("fabric"), interface_a=normalize_ifname(F.col("p1")), interface_b=normalize_ifname(F.col("p2")), interface_a_raw=F.col("p1"), interface_b_raw=F.col("p2"), link_type=F.coalesce(text("['link-type']"), F.lit(""))), normalize_ifname(F.col("p1")), normalize_ifname(F.col("p2"))))
    # a VRF's template is an object or the text of one
    vrfs = of(objects, "vrfs").withColumns({"name": F.nullif(text("vrfName"), F.lit("")), "fabric": text("fabricName"), "t": F.try_parse_json(text("vrfTemplateConfig"))})
    out.append(node(vrfs.where("name is not null"), key("ndfc-vrf", F.col("instance"), F.col("fabric"), F.col("name")), "VRF", props(name=F.col("name"), fabric=F.col("fabric"), vni=pick(text("vrfSegmentId", "t"), text("vrfId")), rd=F.coalesce(text("vrfRd", "t"), F.lit("")), rt_import=F.coalesce(text("routeTargetImport", "t"), F.lit("")), rt_export=F.coalesce(text("routeTargetExport", "t"), F.lit("")))))
    nets = of(objects, "networks").withColumns({"fabric": text("fabricName"), "vni": pick(text("networkId"), text("vni")), "vid": text("vlanId").try_cast("int")})
    vlan = key("ndfc-vlan", F.col("instance"), F.concat_ws(":", "fabric", "vid"))
    nets = nets.where("vid is not null")
    vni = key("ndfc-vni", F.col("instance"), F.col("vni"))
    out += [
        node(nets, vlan, "VLAN", props(name=pick(text("networkName"), F.concat(F.lit("VLAN"), "vid")), vlan_id=F.col("vid").cast("string"), fabric=F.col("fabric"))),
        node(once(nets.where("vni is not null"), "vni"), vni, "VNI", props(vni_id=F.col("vni"), name=F.concat(F.lit("VNI-"), "vni"))),
        edge(nets, vni, vlan, "VNI_EXTENDS"),
        edge(nets.join(switches.select("instance", "fabric", "serial"), ["instance", "fabric"]), own, vlan, "LOGICAL_MEMBER", props(fabric=F.col("fabric"))),
    ]
    # every two tunnel ends of a fabric are peers
    ends = switches.where(vtep.isNotNull()).select("instance", "fabric", "serial", vtep.alias("vtep"))
    other = ends.withColumnsRenamed({"serial": "serial2", "vtep": "vtep2"})
    mesh = ends.join(other, ["instance", "fabric"]).where("serial < serial2")
    out.append(edge(mesh, own, key("ndfc", F.col("instance"), F.col("serial2")), "FABRIC_PEER", props(vtep_a=F.col("vtep"), vtep_b=F.col("vtep2"))))
    return both(*out)


# firewalls


def fmc(objects: DataFrame) -> DataFrame:
    """Kinds: devices, vlans, interfaces (with deviceId); all objects may name their domain."""
    devices = once(of(objects, "devices").withColumn("device", text("id")), "device")
    domain = F.coalesce(text("metadata.domain.id"), F.lit("unknown"))
    home, own = key("fmc-domain", F.col("instance"), domain), key("fmc", F.col("instance"), F.col("device"))
    domains = once(devices.withColumn("domain", domain), "domain")
    at = props(source="fmc", dimension="physical")
    device = props(name=pick(text("name"), F.col("device")), platform="fmc", role=lookup(F.lower(text("type")), {"ftd": "firewall", "firewall": "firewall"}, F.lit("firewall")), serial=F.coalesce(text("serialNumber"), F.lit("")), mgmt_ip=F.coalesce(text("hostName"), F.lit("")), status=firewall_status(pick(text("healthStatus"), text("status"))))
    out = [
        node(domains, home, "PlatformSite", props(name=F.concat(F.lit("FMC Domain "), domain), slug=F.concat_ws("-", F.lit("fmc"), "instance", F.substring(domain, 1, 8)), platform_type="fmc", domain_uuid=domain)),
        node(devices, own, "Device", overlaid(fields(), device)),
        edge(devices, own, home, "LOCATED_AT", at),
        node(of(objects, "vlans"), key("fmc-vlan", F.col("instance"), pick(text("vlanTag"), text("vid"))), "VLAN", overlaid(fields(), props(vid=pick(text("vlanTag"), text("vid")), name=F.coalesce(text("name"), F.lit("")), status=F.lit("active")))),
    ]
    ifaces = of(objects, "interfaces").withColumns({"device": text("deviceId"), "name": text("name")}).join(devices.select("instance", "device"), ["instance", "device"])
    iface = key("fmc-if", F.col("instance"), F.col("device"), F.col("name"))
    inner = F.filter(F.concat(F.array(*(text(p) for p in ("ipAddress", "ipv4Address", "ipv6Address", "ipv4.static.address"))), F.transform(items("ipv6.addresses"), lambda x: F.coalesce(text("address", x), x.cast("string")))), lambda x: x.isNotNull())
    held = ifaces.withColumn("_at", iface).select("instance", "file", "line", "_at", F.explode(F.array_distinct(F.transform(inner, lambda x: F.split(x, "/")[0]))).alias("ip"))
    out += [
        node(ifaces, iface, "Interface", overlaid(fields(), props(name=F.col("name"), device_platform_id=F.col("device"), description=F.coalesce(text("description"), F.lit("")), enabled=F.coalesce(text("enabled"), F.lit("true")), oper_status=F.coalesce(F.lower(text("operStatus")), F.lit(""))))),
        edge(ifaces, own, iface, "HAS_INTERFACE", at),
        _all_addresses(held),
    ]
    return both(*out)


def _all_addresses(held: DataFrame) -> DataFrame:
    """Like ``addresses``, loopback and link-local ones too."""
    held = held.where(ip_version(F.col("ip")).isNotNull())
    where = key("ip", F.col("ip"))
    return both(node(once(held, "ip"), where, "IPAddress", props(address=F.col("ip"), name=F.col("ip"), version=F.concat(F.lit("ipv"), ip_version(F.col("ip"))))), edge(held, F.col("_at"), where, "ASSIGNED_IP", props(source="fmc", dimension="routing")))


# probes


def thousandeyes(objects: DataFrame) -> DataFrame:
    """Kinds: agents, endpoints, alerts, outages."""
    alerts = of(objects, "alerts").groupBy("instance").agg(F.count("*").cast("string").alias("alerts"))
    outages = of(objects, "outages").groupBy("instance").agg(F.count("*").cast("string").alias("outages"))
    every = objects.select("instance").distinct().join(alerts, "instance", "left").join(outages, "instance", "left")
    home = key("te-account", F.col("instance"), "default")
    at = props(source="thousandeyes", dimension="physical")
    out = [node(every, home, "PlatformSite", props(name=F.lit("ThousandEyes (default)"), slug=F.concat_ws("-", F.lit("te"), "instance", F.lit("default")), platform_type="thousandeyes", alerts_active=F.coalesce("alerts", F.lit("0")), internet_outages_recent=F.col("outages")))]
    agents = once(of(objects, "agents").withColumn("agent", F.trim(pick(text("agentId"), text("id")))).where("agent <> ''"), "agent")
    kind = F.regexp_replace(F.lower(F.coalesce(text("agentType"), F.lit("agent"))), "[ _]+", "-")
    own = lambda c: key(F.concat(F.lit("te-agent-"), F.col(c)), F.col("instance"), F.col("agent"))
    useful = F.array_distinct(F.filter(F.transform(items("ipAddresses"), lambda x: x.cast("string")), is_useful_ip))
    agents = agents.withColumns({"agent_kind": kind, "ips": useful})
    status = agent_status(F.try_variant_get("v", "$.enabled", "boolean"), text("agentState"), F.size(items("errorDetails")))
    out += [
        node(agents, own("agent_kind"), "Device", overlaid(fields(), props(name=pick(text("agentName"), text("name"), F.col("agent")), platform="thousandeyes", role="probe", serial="", mgmt_ip=F.coalesce(F.try_element_at("ips", F.lit(1)), F.lit("")), status=status, te_agent_type=F.col("agent_kind")))),
        edge(agents, own("agent_kind"), home, "LOCATED_AT", at),
    ]
    eth = agents.select("instance", "file", "line", "agent", "agent_kind", F.posexplode("ips").alias("n", "ip")).withColumn("name", F.concat(F.lit("eth"), "n"))
    iface = key("te-if", F.col("instance"), F.col("agent"), F.col("name"))
    out += [
        node(eth, iface, "Interface", props(name=F.col("name"), device_platform_id=F.col("agent"), enabled="true", oper_status="up", synthetic="true", synthetic_reason="te_api_no_interface_inventory")),
        edge(eth, own("agent_kind"), iface, "HAS_INTERFACE", at),
        addresses(eth, iface, F.col("ip"), props(source="thousandeyes", dimension="routing")),
    ]
    members = agents.select("instance", own("agent_kind").alias("cluster"), F.explode(items("clusterMembers")).alias("m")).select("instance", "cluster", F.trim(F.coalesce(text("memberId", "m"), F.col("m").cast("string"))).alias("agent"))
    members = members.join(agents.select("instance", "agent", own("agent_kind").alias("child")), ["instance", "agent"]).where("child <> cluster")
    out.append(edge(members, F.col("child"), F.col("cluster"), "LOCATED_AT", props(source="thousandeyes", dimension="physical", relationship="cluster_member")))
    ends = once(of(objects, "endpoints").withColumn("agent", text("id")).where("agent <> ''"), "agent")
    probe = key("te-endpoint", F.col("instance"), F.col("agent"))
    ports = ends.select("instance", "file", "line", "agent", F.explode(items("networkInterfaceProfiles")).alias("p")).withColumn("name", collapse(text("interfaceName", "p"))).where("name <> ''")
    held = ports.withColumn("_at", iface).select("instance", "file", "line", "_at", F.explode(items("addressProfiles", "p")).alias("a"))
    first = F.try_element_at(F.filter(F.transform(F.flatten(F.transform(F.filter(items("networkInterfaceProfiles"), lambda p: ~text("hardwareType", p).eqNullSafe(F.lit("loopback"))), lambda p: F.coalesce(F.try_variant_get(p, "$.addressProfiles", "array<variant>"), F.array().cast("array<variant>")))), lambda a: text("ipAddress", a)), is_useful_ip), F.lit(1))
    public = F.when(is_useful_ip(text("publicIP")), text("publicIP"))
    nested = F.map_filter(fields(), lambda k, _: k != "networkInterfaceProfiles")
    out += [
        node(ends, probe, "Device", overlaid(nested, props(name=pick(collapse(text("name")), F.col("agent")), platform="thousandeyes", role="endpoint", serial=F.coalesce(text("serialNumber"), F.lit("")), mgmt_ip=F.coalesce(first, public, F.lit("")), status=endpoint_status(text("status"))))),
        edge(ends, probe, home, "LOCATED_AT", at),
        node(ports, iface, "Interface", props(name=F.col("name"), device_platform_id=F.col("agent"), enabled="true", oper_status="up", hardware_type=F.coalesce(text("hardwareType", "p"), F.lit("")), link_speed_mbps=text("ethernetProfile.linkSpeed", "p"), **{c: text(f"wirelessProfile.{f}", "p") for c, f in (("ssid", "ssid"), ("bssid", "bssid"), ("rssi", "rssi"), ("channel", "channel"), ("phy_mode", "phyMode"))})),
        edge(ports, probe, iface, "HAS_INTERFACE", at),
        addresses(held, F.col("_at"), text("ipAddress", "a"), props(source="thousandeyes", dimension="routing", prefix_length=text("prefixLength", "a"), gateway=text("gateway", "a"), address_type=text("addressType", "a"))),
    ]
    return both(*out)


# the source of truth


def netbox(objects: DataFrame) -> DataFrame:
    """Kinds: sites, locations. A location lies in its parent if that is known, else in its site."""
    sites, locations = of(objects, "sites").withColumn("nb", text("id")), of(objects, "locations").withColumns({"nb": text("id"), "parent": text("parent.id"), "site": text("site.id")})
    empty = lambda p: F.coalesce(text(p), F.lit(""))
    here = key("nb-loc", F.col("nb"))
    up = locations.join(locations.select("instance", F.col("nb").alias("parent"), here.alias("_in")).distinct(), ["instance", "parent"], "left").join(sites.select("instance", F.col("nb").alias("site"), key("nb-site", text("slug")).alias("_at")).distinct(), ["instance", "site"], "left")
    return both(
        node(sites, key("nb-site", text("slug")), "Site", props(name=text("name"), slug=text("slug"), status=empty("status.value"), region=empty("region.name"), tenant=empty("tenant.name"), description=empty("description"), physical_address=empty("physical_address"), latitude=text("latitude"), longitude=text("longitude"), normalized_name=slug(text("name")), netbox_id=F.col("nb"))),
        node(locations, here, "Location", props(name=text("name"), slug=empty("slug"), description=empty("description"), site_nb_id=F.col("site"), parent_nb_id=F.col("parent"), normalized_name=slug(text("name")), netbox_id=F.col("nb"))),
        edge(up, here, F.coalesce("_in", "_at"), "WITHIN_LOCATION"),
    )


#: The mapping of each kind of platform.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"meraki": meraki, "catalyst_center": catalyst_center, "nexus_dashboard": nexus_dashboard, "fmc": fmc, "thousandeyes": thousandeyes, "netbox": netbox}


def staged(spark: SparkSession, folder: str, adapters: list[str] | None = None) -> DataFrame:
    """(adapter, kind, instance, file, line, v): all objects, parsed once into a
    table by adapter and kind in the shared folder, so that each step of a
    mapping reads its own kind only."""
    rows = inventory.objects(spark, folder, adapters).select("adapter", "kind", "instance", "file", "line", F.try_parse_json("object").alias("v"))
    table = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    rows.where("v is not null").write.partitionBy("adapter", "kind").parquet(table)
    return spark.read.schema("instance string, file string, line long, v variant, adapter string, kind string").parquet(table)


def mapped(objects: DataFrame, adapter: str) -> DataFrame:
    """The graph rows of all ``staged`` objects of one kind of platform."""
    own = ADAPTERS[adapter](objects.where(F.col("adapter") == adapter).drop("adapter"))
    return own.select(F.concat(F.lit(f"{adapter}/"), "instance").alias("adapter"), *COLUMNS)


def discover(spark: SparkSession, folder: str, adapters: list[str] | None = None) -> DataFrame:
    """(adapter, kind, id, src, dst, type, interface_a, interface_b, props): the
    nodes and edges of all exports below ``folder``, whose layout ``inventory``
    tells. A node may come from several objects; merging them is the store's."""
    objects = staged(spark, folder, adapters)
    return both(*(mapped(objects, a) for a in adapters or ADAPTERS))
