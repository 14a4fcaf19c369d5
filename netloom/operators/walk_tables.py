"""Tables of a walk whose rows share a composite index, from text lines to graph rows.

An index is a row of numbers. A layout says what they are: ``int`` one number,
a number n for n of them, ``counted`` as many as the first says, ``rest`` all
that are left. Several columns of a table, and columns of tables whose index
begins alike, meet on the parts that they share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.names import bridge_mac, is_neighbor_name, lookup, mac, normalize_ifname
from netloom.functions.network import ip_version
from netloom.operators.snmp import interfaces, stp_edges

Layout = Sequence[tuple[str, str | int]]

# fixed values: columns of the neighbour and spanning-tree tables
LLDP = {"1.0.8802.1.1.2.1.4.1.1.4": "subtype", "1.0.8802.1.1.2.1.4.1.1.5": "chassis", "1.0.8802.1.1.2.1.4.1.1.7": "port", "1.0.8802.1.1.2.1.4.1.1.8": "port_text", "1.0.8802.1.1.2.1.4.1.1.9": "name"}
LLDP_ADDRESS = {"1.0.8802.1.1.2.1.4.2.1.4": "at"}
CDP = {"1.3.6.1.4.1.9.9.23.1.2.1.1.4": "at", "1.3.6.1.4.1.9.9.23.1.2.1.1.6": "name", "1.3.6.1.4.1.9.9.23.1.2.1.1.7": "port", "1.3.6.1.4.1.9.9.23.1.2.1.1.8": "model"}
BRIDGE = {"1.3.6.1.2.1.17.2.2": "priority", "1.3.6.1.2.1.17.2.5": "root", "1.3.6.1.2.1.17.2.6": "root_path_cost", "1.3.6.1.2.1.17.2.7": "root_port"}
BRIDGE_PORTS = {"1.3.6.1.2.1.17.1.4.1.2": "ifindex", "1.3.6.1.2.1.17.2.15.1.3": "state"}
PORT_STATES = {"1": "disabled", "2": "blocking", "3": "listening", "4": "learning", "5": "forwarding", "6": "broken"}

REMOTE: Layout = (("time", "int"), ("local", "int"), ("remote", "int"))
REMOTE_ADDRESS: Layout = (*REMOTE, ("family", "int"), ("address", "counted"))
CACHE: Layout = (("local", "int"), ("remote", "int"))


def parts(index: Column, layout: Layout) -> Column:
    """struct of the parts of a dotted index, ``int`` ones as numbers, others
    dotted; null if the index doesn't have just these parts."""
    numbers = F.split(index, r"\.")
    at, fields, fits = F.lit(1), [], []
    for name, kind in layout:
        if kind == "int":
            field, width = F.try_element_at(numbers, at).try_cast("bigint"), F.lit(1)
        else:
            if kind == "counted":
                width, first = F.coalesce(F.try_element_at(numbers, at).try_cast("int"), F.lit(-1)) + 1, at + 1
            else:
                width, first = (F.size(numbers) - at + 1, at) if kind == "rest" else (F.lit(kind), at)
            length = width - (first - at)
            field = F.array_join(F.slice(numbers, first, F.greatest(length, F.lit(0))), ".")
            fits.append(length >= 0)
        fits.append(field.isNotNull())
        fields.append(field.alias(name))
        at = at + width
    whole = reduce(lambda a, b: a & b, fits) & (at == F.size(numbers) + 1) & index.rlike(r"^\d+(\.\d+)*$")
    return F.when(F.coalesce(whole, F.lit(False)), F.struct(*fields))


def table(walk: DataFrame, columns: Mapping[str, str], layout: Layout) -> DataFrame:
    """(device, *parts, *columns) of ``walk(device, oid, kind, value)``: one row
    for each index, its columns as struct<kind, value>; of a repeated cell the
    last in the order of values."""
    oids = F.array(*map(F.lit, columns))
    under = F.try_element_at(F.filter(oids, lambda o: F.startswith(F.col("oid"), F.concat(o, F.lit(".")))), F.lit(1))
    rows = walk.withColumn("_o", under).where("_o is not null")
    rows = rows.select("device", lookup(F.col("_o"), dict(columns)).alias("_c"), parts(F.expr("substr(oid, length(_o) + 2)"), layout).alias("_i"), F.struct("kind", "value").alias("_v")).where("_i is not null")
    keys = [c for c, _ in layout]
    return rows.select("device", *(F.col(f"_i.{k}").alias(k) for k in keys), "_c", "_v").groupBy("device", *keys).agg(*(F.max(F.when(F.col("_c") == c, F.col("_v"))).alias(c) for c in columns.values()))


def _hex(cell: str) -> Column:
    return F.coalesce(F.col(f"{cell}.kind").isin("Hex-STRING", "Hex"), F.lit(False))


def text_of(cell: str) -> Column:
    """A cell as text: hexadecimal bytes that are printable are read, others stay."""
    raw = F.col(f"{cell}.value")
    read = F.decode(F.unhex(raw), "UTF-8")
    return F.trim(F.when(_hex(cell) & read.rlike(r"^[\x20-\x7E]*\x00?$"), F.regexp_replace(read, r"\x00", "")).otherwise(raw))


def port_of(cell: str) -> Column:
    """A port: six bytes are a hardware address, else text."""
    return F.when(_hex(cell) & (F.length(f"{cell}.value") == 12), mac(F.col(f"{cell}.value"))).otherwise(text_of(cell))


def address_of(cell: str) -> Column:
    """An address: dotted text, or four or sixteen bytes."""
    raw = F.col(f"{cell}.value")
    byte = lambda i: F.conv(F.substring(raw, 2 * i + 1, 2), 16, 10)
    four = F.concat_ws(".", *(byte(i) for i in range(4)))
    sixteen = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: raw.substr(4 * i + 1, F.lit(4))), ":")
    return F.when(_hex(cell) & (F.length(raw) == 8), four).when(_hex(cell) & (F.length(raw) == 32), sixteen).when(~_hex(cell) & ip_version(raw).isNotNull(), raw)


def lldp(walk: DataFrame) -> DataFrame:
    """(device, ifindex, ord, name, chassis, chassis_raw, subtype, port, at, model)
    of the neighbours that tell a name: five columns of one table, and the
    addresses of another, whose index goes on with the address."""
    rows = table(walk, LLDP, REMOTE)
    told = table(walk, LLDP_ADDRESS, REMOTE_ADDRESS)
    indexed = F.when((F.col("family") == 1) & F.col("address").rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.col("address"))
    told = told.withColumn("_at", F.coalesce(address_of("at"), indexed)).where("_at is not null").groupBy("device", *(k for k, _ in REMOTE)).agg(F.min("_at").alias("at"))
    rows = rows.where("name is not null").join(told, ["device", *(k for k, _ in REMOTE)], "left")
    chassis = F.when((F.col("subtype.value") == "4"), mac(F.col("chassis.value")))
    return rows.select("device", F.col("local").alias("ifindex"), F.struct("time", "local", "remote").alias("ord"), F.trim(F.split(text_of("name"), r"\.")[0]).alias("name"), chassis.alias("chassis"), port_of("chassis").alias("chassis_raw"), F.coalesce("subtype.value", F.lit("0")).alias("subtype"), F.coalesce(F.nullif(port_of("port"), F.lit("")), text_of("port_text"), F.lit("")).alias("port"), "at", F.lit(None).cast("string").alias("model"))


def cdp(walk: DataFrame) -> DataFrame:
    """Like ``lldp``, of the other protocol's table."""
    rows = table(walk, CDP, CACHE).where("name is not null")
    none = F.lit(None).cast("string")
    return rows.select("device", F.col("local").alias("ifindex"), F.struct(F.lit(0).cast("bigint").alias("time"), "local", "remote").alias("ord"), F.split(text_of("name"), r"\.")[0].alias("name"), none.alias("chassis"), none.alias("chassis_raw"), none.alias("subtype"), F.coalesce(port_of("port"), F.lit("")).alias("port"), address_of("at").alias("at"), text_of("model").alias("model"))


def graph_rows(told: DataFrame, ports: DataFrame, proto: str, most: int | None = None) -> DataFrame:
    """(kind, id, src, dst, type, interface_a, interface_b, props): the stub and
    the link of each neighbour that ``lldp`` or ``cdp`` found, over the interfaces
    ``ports(device, ifindex, name)``. A neighbour is known by its name if that is
    one, else by its address; of a device at most ``most`` are taken, in the
    order in which their first row comes. Those without either are left out."""
    fallback = F.lower(F.coalesce(F.col("chassis"), F.col("at")))
    named = is_neighbor_name(F.col("name"))
    rows = told.withColumn("neighbor", F.when(named, F.concat(F.lit(f"{proto}-neighbor:"), "name")).when(fallback.isNotNull(), F.concat(F.lit(f"{proto}-neighbor:by-id:"), fallback))).where("neighbor is not null")
    rows = rows.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), fallback))
    if most is not None:
        first = rows.groupBy("device", "neighbor").agg(F.min("ord").alias("_first"))
        taken = first.withColumn("_n", F.row_number().over(Window.partitionBy("device").orderBy("_first", "neighbor"))).where(F.col("_n") <= most)
        rows = rows.join(taken.select("device", "neighbor"), ["device", "neighbor"])
    rows = rows.join(ports.select("device", "ifindex", F.col("name").alias("_port")), ["device", "ifindex"], "left").withColumn("near", F.coalesce("_port", F.concat(F.lit("if-"), "ifindex")))
    rows = rows.withColumns({"_a": normalize_ifname(F.col("near")), "_b": normalize_ifname(F.col("port"))})
    props = lambda **named: F.map_filter(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]), lambda _, v: v.isNotNull())
    none = F.lit(None).cast("string")
    platform = F.coalesce(F.nullif("model", F.lit("")), F.lit("cisco" if proto == "cdp" else "unknown"))
    stub = props(name=F.col("name"), platform=platform, role="other", stub="true", discovered_via=proto, chassis_mac=F.col("chassis"), chassis_id_raw=F.col("chassis_raw"), chassis_id_subtype=F.col("subtype"), mgmt_ip=F.col("at"))
    one = rows.withColumn("_k", F.row_number().over(Window.partitionBy("neighbor").orderBy("device", "ord"))).where("_k = 1")
    a, b = F.col("_a"), F.col("_b")
    link = props(interface_a=a, interface_b=b, interface_a_raw=F.col("near"), interface_b_raw=F.col("port"), discovery_proto=proto)
    return one.select(F.lit("node").alias("kind"), F.col("neighbor").alias("id"), none.alias("src"), none.alias("dst"), F.lit("Device").alias("type"), none.alias("interface_a"), none.alias("interface_b"), stub.alias("props")).unionByName(
        rows.select(F.lit("edge").alias("kind"), none.alias("id"), F.col("device").alias("src"), F.col("neighbor").alias("dst"), F.lit("PHYSICAL_LINK").alias("type"), a.alias("interface_a"), b.alias("interface_b"), link.alias("props"))
    )


def spanning_tree(walk: DataFrame) -> DataFrame:
    """``stp_edges`` of a walk, with root_path_cost of the members: bridge ports
    are translated to interfaces by their numbers. A device without a priority
    tells nothing."""
    value = lambda c: F.col(f"{c}.value")
    bridges = table(walk, BRIDGE, (("zero", "int"),)).where("priority is not null").select("device", bridge_mac(value("root")).alias("root_mac"), F.coalesce(value("root_port").try_cast("int"), F.lit(0)).alias("root_port"), F.coalesce(value("priority").try_cast("int"), F.lit(32768)).alias("priority"), F.coalesce(value("root_path_cost").try_cast("int"), F.lit(0)).alias("root_path_cost"))
    rows = table(walk, BRIDGE_PORTS, (("port", "int"),)).where("state is not null").join(bridges.select("device"), "device", "left_semi")
    rows = rows.select("device", F.col("port").cast("string").alias("port"), value("ifindex").try_cast("bigint").alias("ifindex"), lookup(value("state"), PORT_STATES, value("state")).alias("state"), F.lit(None).cast("string").alias("role"))
    named = rows.join(interfaces(walk).select("device", "ifindex", F.col("name").alias("interface")), ["device", "ifindex"], "left")
    cost = bridges.select(F.col("device").alias("src"), "root_path_cost")
    edges = stp_edges(bridges, named)
    return edges.join(cost, "src", "left").withColumn("root_path_cost", F.when(F.col("type") == "STP_MEMBER", F.col("root_path_cost")))
