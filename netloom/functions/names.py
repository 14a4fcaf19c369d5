"""Names of interfaces, devices, sites and vendors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.network import _let

# fixed values: interface name prefixes and their long forms
IFNAME_PREFIXES = {
    "fourhundredgige": "FourHundredGigE", "foh": "FourHundredGigE",
    "twohundredgige": "TwoHundredGigE", "twh": "TwoHundredGigE",
    "hundredgige": "HundredGigE", "hu": "HundredGigE",
    "fiftygige": "FiftyGigE", "fi": "FiftyGigE",
    "fortygige": "FortyGigE", "fo": "FortyGigE",
    "twentyfivegige": "TwentyFiveGigE", "twe": "TwentyFiveGigE",
    "tengigabitethernet": "TenGigabitEthernet", "tengige": "TenGigabitEthernet", "te": "TenGigabitEthernet",
    "fivegigabitethernet": "FiveGigabitEthernet", "fiv": "FiveGigabitEthernet",
    "twogigabitethernet": "TwoGigabitEthernet", "tw": "TwoGigabitEthernet",
    "gigabitethernet": "GigabitEthernet", "gi": "GigabitEthernet",
    "fastethernet": "FastEthernet", "fa": "FastEthernet",
    "ethernet": "Ethernet", "eth": "Ethernet", "et": "Ethernet",
    "management": "Management", "mgmt": "Management", "ma": "Management",
    "port-channel": "Port-channel", "po": "Port-channel",
    "loopback": "Loopback", "lo": "Loopback",
    "tunnel": "Tunnel", "tu": "Tunnel",
    "vlan": "Vlan", "vl": "Vlan",
    "bundle-ether": "Bundle-Ether", "be": "Bundle-Ether",
    "serial": "Serial", "se": "Serial",
    "null": "Null", "nu": "Null",
}


def lookup(key: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """The value of ``key`` in a small constant map, else ``default``."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def pick(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def normalize_ifname(name: Column) -> Column:
    """Long form of an interface name; unknown prefixes stay, null becomes empty."""
    pattern = r"^([A-Za-z\-]+)\s*(.*)$"
    long = lambda text: lookup(F.lower(F.regexp_extract(text, pattern, 1)), IFNAME_PREFIXES)
    lengthened = lambda text: _let(long(text), lambda x: F.when(x.isNotNull(), F.concat(x, F.regexp_extract(text, pattern, 2))).otherwise(text))
    return _let(F.trim(F.coalesce(name, F.lit(""))), lengthened)


def ifname_equal(a: Column, b: Column) -> Column:
    return normalize_ifname(a) == normalize_ifname(b)


def port_tail(name: Column) -> Column:
    """An interface name from its first digit on: ``1/1/5`` of ``Te1/1/5``."""
    return F.regexp_extract(F.coalesce(name, F.lit("")), "[0-9].*$", 0)


def mac(value: Column) -> Column:
    """Lower-case, colon-separated; null unless it has 12 hexadecimal digits."""
    digits = F.regexp_replace(F.lower(value), r"[^0-9a-f]", "")
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), 1)
    return F.when(F.length(digits) == 12, F.array_join(pairs, ":"))


def bridge_mac(value: Column) -> Column:
    """The address within an 8-byte bridge identifier."""
    digits = F.regexp_replace(F.lower(value), r"[^0-9a-f]", "")
    return F.when(F.length(digits) >= 16, mac(F.substring(digits, 5, 12)))


def oui(value: Column) -> Column:
    """Upper-case vendor part of an address; null for locally administered and malformed ones."""
    digits = F.upper(F.regexp_replace(value, r"[^0-9A-Fa-f]", ""))
    local = F.substring(digits, 2, 1).isin("2", "3", "6", "7", "A", "B", "E", "F")
    return F.when((F.length(digits) >= 12) & ~local, F.substring(digits, 1, 6))


def host_label(name: Column) -> Column:
    """First label of a host name in lower case."""
    return F.nullif(F.lower(F.trim(F.split(name, r"\.")[0])), F.lit(""))


def collapse(name: Column) -> Column:
    """Trimmed, runs of blanks as one; empty for null."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))


def slug(name: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "")


def dashed(name: Column) -> Column:
    """Lower case with dashes for whatever isn't a letter or digit."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")


def is_neighbor_name(name: Column) -> Column:
    """Whether an announced name is a usable host name of three letters or more and no bare number."""
    text = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(text) >= 3) & ~text.rlike(r"^\d+$") & text.rlike(r"^[a-zA-Z0-9]([a-zA-Z0-9\-._]{1,253}[a-zA-Z0-9])?$")


def fi_port(slot: Column, port: Column) -> Column:
    """``Ethernet<slot>/<port>`` of a fabric interconnect; empty if both are null."""
    by = lambda c, default: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))
    return F.when(slot.isNull() & port.isNull(), "").otherwise(F.concat(F.lit("Ethernet"), by(slot, "1"), F.lit("/"), by(port, "0")))


def host_port(slot: Column, port: Column) -> Column:
    by = lambda c, default: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(default))
    return F.when(slot.isNull() & port.isNull(), "").otherwise(F.concat(F.lit("vic"), by(slot, "1"), F.lit("/"), by(port, "0")))


def label(display_name: Column, name: Column, key: Column) -> Column:
    return pick(display_name, name, key)


def stp_name(domain_id: Column, vlan: Column, root: Column) -> Column:
    """A name for a domain without one: its VLAN's, its root's, or the end of its id."""
    by_vlan = F.when(vlan.isNotNull() & (vlan != 0), F.concat(F.lit("VLAN "), vlan.cast("string")))
    by_root = F.when(F.nullif(root, F.lit("")).isNotNull(), F.concat(F.lit("Root "), root))
    return F.coalesce(by_vlan, by_root, F.nullif(F.element_at(F.split(domain_id, ":"), -1), F.lit("")), F.lit("(unnamed)"))


def adapter_rank(source: Column) -> Column:
    """How much a source is trusted to name a device; unknown sources rank 0."""
    # fixed values: sources from the least to the most trusted
    order = ("snmp", "meraki", "nexus_dashboard", "intersight", "catalyst_center")
    return reduce(lambda out, k: F.when(source.startswith(order[k]), k + 1).otherwise(out), range(len(order)), F.lit(0))


def link_pair(text: Column) -> Column:
    """(a, b) of a link's name, by the first delimiter in order that leaves two names."""
    found = []
    for mark in (" <-> ", " ⇄ ", "|", "->", "<-", "--"):
        at = F.instr(F.trim(text), mark)
        a, b = F.trim(F.substr(F.trim(text), F.lit(1), at - 1)), F.trim(F.substr(F.trim(text), at + len(mark)))
        found.append(F.when((at > 0) & (a != "") & (b != ""), F.struct(a.alias("a"), b.alias("b"))))
    return F.coalesce(*found)
