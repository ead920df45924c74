"""Which addresses belong to private networks, and the gate that only they pass."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# The private networks and the guarded paths.
PRIVATE_V4 = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
PRIVATE_V6 = ("::1/128", "fc00::/7", "fe80::/10")
GUARDED = ("/docs", "/redoc", "/openapi.json")
_PART = r"(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def v4_number(host: Column) -> Column:
    """A dotted IPv4 address as a number, null if it is none (leading zeros are refused)."""
    parts = F.split(host, "[.]")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    return F.when(host.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z"), number)


def is_private_v4(host: Column) -> Column:
    """True for an IPv4 address in one of the networks; false for others, malformed ones and null."""
    number, inside = v4_number(host), F.lit(False)
    for net in map(ipaddress.ip_network, PRIVATE_V4):
        inside = inside | number.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(inside, F.lit(False))


_GROUP = "[0-9a-f]{1,4}"
#: Eight groups, or fewer around one double colon.
_V6 = "|".join([f"{_GROUP}(?::{_GROUP}){{7}}", *(f"(?:{_GROUP}(?::{_GROUP}){{{a - 1}}})?::(?:{_GROUP}(?::{_GROUP}){{0,{6 - a}}})?" if a else f"::(?:{_GROUP}(?::{_GROUP}){{0,6}})?" for a in range(7)), f"(?:{_GROUP}:){{7}}:"])


def v6_groups(host: Column) -> Column:
    """An IPv6 address in lower case, without a zone and with an IPv4 ending spelt as groups; null if it is none."""
    plain = F.regexp_extract(F.lower(host), r"\A([^%]*)(?:%[^%]+)?\z", 1)
    ending = F.regexp_extract(plain, r"\A(?:.*:)([^:]*[.][^:]*)\z", 1)
    number = v4_number(ending)
    groups = F.concat_ws(":", F.lower(F.hex(F.floor(number / 65536))), F.lower(F.hex(number % 65536)))
    whole = F.when(ending == "", plain).when(number.isNotNull(), F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(ending)), groups))
    return F.when(whole.rlike(rf"\A(?:{_V6})\z"), whole)


def address_bits(host: Column) -> Column:
    """The address as 32 or 128 characters 0 and 1, so that a network is a beginning of it; null if it is no address."""
    groups = v6_groups(host)
    side = lambda n: F.filter(F.split(F.split_part(groups, F.lit("::"), F.lit(n)), ":"), lambda g: g != "")
    left, right = side(1), side(2)
    every = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    long = F.array_join(F.transform(every, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return F.coalesce(F.lpad(F.bin(v4_number(host)), 32, "0"), F.when(groups.isNotNull(), long))


def network_bits(cidr: Column) -> Column:
    """The bits that all addresses of a network begin with, after 4: or 6:; null if it is none.

    The length follows a slash; without one the network is a single address. Bits of the address beyond the length do not count.
    """
    host, size = F.split_part(cidr, F.lit("/"), F.lit(1)), F.split_part(cidr, F.lit("/"), F.lit(2))
    bits = address_bits(host)
    n = F.when(F.instr(cidr, "/") == 0, F.length(bits)).when(size.rlike(r"\A[0-9]{1,3}\z") & (F.size(F.split(cidr, "/")) == 2), size.try_cast("int"))
    return F.when((n <= F.length(bits)) & ~F.contains(host, F.lit("%")), F.concat(version(bits), F.substring(bits, F.lit(1), n)))


def version(bits: Column) -> Column:
    return F.when(F.length(bits) == 32, "4:").when(F.length(bits) == 128, "6:")


def within(host: Column, networks: tuple[str, ...]) -> Column:
    """True for an address in one of a few networks of either version, whatever their lengths; false for others and for null."""
    bits = address_bits(host)
    inside = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        first = f"{int(net.network_address):0{net.max_prefixlen}b}"[: net.prefixlen]
        inside = inside | ((F.length(bits) == net.max_prefixlen) & bits.startswith(first))
    return F.coalesce(inside, F.lit(False))


def is_private_v6(host: Column) -> Column:
    """True for an IPv6 address in one of the networks."""
    return within(host, PRIVATE_V6)


def is_private(host: Column) -> Column:
    """For both versions."""
    return is_private_v4(host) | is_private_v6(host)


def passes_gate(path: Column, proxy_header: Column, private: Column) -> Column:
    """Guarded paths pass from private networks without a proxy header; all others always do."""
    guarded = F.coalesce(path.isin(*GUARDED), F.lit(False))
    proxied = F.coalesce(proxy_header, F.lit("")) != ""
    return ~guarded | (~proxied & F.coalesce(private, F.lit(False)))
