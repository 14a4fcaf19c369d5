"""IP addresses, autonomous systems and VLAN sets as column expressions.

IPv4 addresses are held as 64-bit integers, IPv6 addresses as 32 hexadecimal
digits, so containment is an equality join on masked values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4(text: Column) -> Column:
    """The address as an integer; null if it isn't one."""
    clean = F.trim(text)
    value = F.lit(0).cast("bigint")
    for k in range(1, 5):
        value = value * 256 + F.regexp_extract(clean, _V4, k).try_cast("bigint")
    return value


def ipv4_text(value: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(value, n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6(text: Column) -> Column:
    """The address as 32 hexadecimal digits; null if it isn't one. Forms with an embedded IPv4 address aren't read."""
    words = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
    none = F.array().cast("array<string>")

    def digits(clean: Column) -> Column:
        cut = F.instr(clean, "::")
        return _let(F.when(cut > 0, F.struct(words(F.substr(clean, F.lit(1), cut - 1)).alias("left"), words(F.substr(clean, cut + 2)).alias("right"), F.lit(True).alias("short"))).otherwise(F.struct(F.split(clean, ":").alias("left"), none.alias("right"), F.lit(False).alias("short"))), whole)

    def whole(parts: Column) -> Column:
        known = F.size(parts["left"]) + F.size(parts["right"])
        fits = F.when(parts["short"], known <= 7).otherwise(known == 8)
        groups = F.concat(parts["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - known)), parts["right"])
        joined = F.array_join(F.transform(groups, lambda x: F.when((F.length(x) >= 1) & (F.length(x) <= 4), F.lpad(x, 4, "0")).otherwise("?")), "")
        return F.when(fits, joined)

    clean = F.lower(F.split(F.trim(text), "%")[0])
    good = lambda c: F.when(c.rlike(r"^[0-9a-f:]+$") & c.contains(":") & ~c.rlike("::.*::|:::"), _let(digits(c), lambda d: F.when(F.length(d) == 32, F.when(~d.contains("?"), d))))
    return _let(clean, good)


def ip_version(text: Column) -> Column:
    return F.when(ipv4(text).isNotNull(), 4).when(ipv6(text).isNotNull(), 6)


def mask4(length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.lit(4294967296) - F.pow(F.lit(2.0), 32 - length).cast("bigint")


def network4(address: Column, length: Column | int) -> Column:
    """The masked address."""
    return address.bitwiseAND(mask4(length))


def network6(digits: Column, length: Column | int) -> Column:
    """The masked address, as 32 hexadecimal digits; the digit that the mask cuts is masked bit by bit."""
    length = F.lit(length) if isinstance(length, int) else length
    whole = F.floor(length / 4).cast("int")

    def masked(d: Column) -> Column:
        digit = F.conv(F.substr(d, whole + 1, F.lit(1)), 16, 10).cast("int")
        keep = F.pow(F.lit(2.0), 4 - length % 4).cast("int")
        cut = F.lower(F.conv((F.floor(digit / keep) * keep).cast("string"), 10, 16))
        return F.rpad(F.when(whole >= 32, d).otherwise(F.concat(F.substr(d, F.lit(1), whole), cut)), 32, "0")

    return _let(digits, masked)


def cidr(address: Column, length: Column) -> Column:
    """``network/length`` of an IPv4 address and a prefix length."""
    return F.concat(ipv4_text(network4(ipv4(address), length)), F.lit("/"), length.cast("string"))


def ipv6_text(digits: Column) -> Column:
    """The usual short form of 32 hexadecimal digits: no leading zeros, the
    longest run of zero groups (of equal ones the first, two groups at least) as ``::``."""
    groups = F.transform(F.regexp_extract_all(digits, F.lit("(....)"), 1), lambda g: F.regexp_replace(g, "^0{1,3}", ""))
    runs = [":" + "0:" * n for n in range(8, 1, -1)]
    cut = lambda w, r: F.when(F.instr(w, r) > 0, F.concat(F.substr(w, F.lit(1), F.instr(w, r) - 1), F.lit("::"), F.substr(w, F.instr(w, r) + len(r))))
    short = _let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), lambda w: F.coalesce(*(cut(w, r) for r in runs), w))
    return F.regexp_replace(F.regexp_replace(short, "^:(?=[^:])", ""), "(?<=[^:]):$", "")


def cidr6(address: Column, length: Column) -> Column:
    """``network/length`` of an IPv6 address, in its short form."""
    return F.concat(ipv6_text(network6(ipv6(address), length)), F.lit("/"), length.cast("string"))


def netmask_length(mask: Column) -> Column:
    """Prefix length of a dotted mask."""
    return F.bit_count(ipv4(mask))


def ensure_cidr(address: Column) -> Column:
    """With a host's prefix length where none is given."""
    return F.when(address.contains("/"), address).when(address.contains(":"), F.concat(address, F.lit("/128"))).otherwise(F.concat(address, F.lit("/32")))


def in_range4(text: Column, base: str, length: int) -> Column:
    a, b, c, d = map(int, base.split("."))
    return F.coalesce(network4(ipv4(text), length) == ((a * 256 + b) * 256 + c) * 256 + d, F.lit(False))


def is_useful_ip(text: Column) -> Column:
    """Neither unspecified, loopback, link-local nor multicast."""
    v6 = ipv6(text)
    bad4 = in_range4(text, "0.0.0.0", 8) | in_range4(text, "127.0.0.0", 8) | in_range4(text, "169.254.0.0", 16) | in_range4(text, "224.0.0.0", 4)
    bad6 = F.coalesce(v6.rlike("^(0{31}[01]|fe[89ab]|ff)"), F.lit(False))
    return F.coalesce(ip_version(text).isNotNull() & ~bad4 & ~bad6, F.lit(False))


def is_pollable(text: Column) -> Column:
    """An address that a poller may contact: neither loopback, link-local nor unspecified."""
    bad4 = in_range4(text, "0.0.0.0", 32) | in_range4(text, "127.0.0.0", 8) | in_range4(text, "169.254.0.0", 16)
    bad6 = F.coalesce(ipv6(text).rlike("^(0{31}[01]|fe[89ab])"), F.lit(False))
    return F.coalesce(ip_version(text).isNotNull() & ~bad4 & ~bad6, F.lit(False))


def is_public_asn(asn: Column) -> Column:
    n = asn.try_cast("bigint")
    bad = (n <= 0) | n.between(64496, 65535) | n.between(65536, 65551) | (n >= 4200000000)
    return F.coalesce(~bad, F.lit(False))


def network_asn(text: Column) -> Column:
    """(isp, asn) of ``Name (AS 123)``; without a number the whole text is the name."""
    pattern = r"^(.*)\(AS\s*(\d+)\s*\)$"
    asn = F.regexp_extract(text, pattern, 2).try_cast("bigint")
    name = F.when(asn.isNotNull(), F.regexp_replace(F.trim(F.regexp_extract(text, pattern, 1)), ",+$", "")).otherwise(F.trim(text))
    return F.struct(F.nullif(name, F.lit("")).alias("isp"), asn.alias("asn"))


def vlan_bitmap(bits: Column, offset: Column | int = 0) -> Column:
    """Numbers of the bits set in a hexadecimal string, from the first byte's highest bit on."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.regexp_replace(F.lower(F.coalesce(bits, F.lit(""))), "[^0-9a-f]", "")
    at = F.sequence(F.lit(0), F.length(digits) * 4 - 1)
    digit = lambda i: F.conv(F.substr(digits, F.floor(i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    on = F.filter(at, lambda i: F.floor(digit(i) / F.pow(F.lit(2.0), 3 - i % 4)).cast("int") % 2 == 1)
    return F.when(F.length(digits) > 0, F.transform(on, lambda i: (i + offset).cast("int"))).otherwise(F.array().cast("array<int>"))


def is_vlan(vid: Column) -> Column:
    """A VLAN that carries traffic: 1 to 4094 without the four reserved ones."""
    return vid.between(1, 4094) & ~vid.between(1002, 1005)
