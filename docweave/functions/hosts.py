"""Hosts and addresses as column expressions: an address is a number of 128 bits in two longs, ranges are bit masks."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.binding import let

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
#: ::ffff:0:0/96, the place of IPv4 addresses among those of IPv6.
MAPPED = 0xFFFF << 32

LOOPBACK = ("127.0.0.0/8", "::1/128")


def split_port(address: Column) -> Column:
    """The host of host:port or [host]:port; null if the address has no such form."""
    bracketed, plain = r"^\[([^\[\]]*)\]:[^\[\]:]*$", r"^([^:\[\]]*):[^:\[\]]*$"
    return F.when(address.rlike(bracketed), F.regexp_extract(address, bracketed, 1)).when(address.rlike(plain), F.regexp_extract(address, plain, 1))


def without_port(address: Column) -> Column:
    return let(address, lambda a: bare_host(F.coalesce(split_port(a), a)))


def host_of(url: Column) -> Column:
    """The host of a URL or of a bare address, without user, port and brackets."""
    bare = F.regexp_replace(url, r"^(?s:.*?)://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"/+$", ""), r"(?s)/.*$", "")
    return without_port(F.regexp_replace(bare, r"(?s)^.*@", ""))


def bare_host(host: Column) -> Column:
    trimmed = F.regexp_replace(host, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return F.regexp_replace(trimmed, r"^[\[\]]+|[\[\]]+$", "")


def _v4(address: Column) -> Column:
    """The 32 bits of a dotted address."""
    parts = F.transform(F.split(address, r"\."), lambda p: p.cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p)


HEXES = "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"


def _hexed(low: Column) -> Column:
    return F.concat(F.hex(F.shiftrightunsigned(low, 16)), F.lit(":"), F.hex(low.bitwiseAND(0xFFFF)))


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address; null for anything else. A dotted tail stands for two groups, and :: for one
    group of zeros at least."""

    def filled(flat: Column) -> Column:
        sides = F.split(flat, "::", -1)
        side = lambda k: F.filter(F.split(F.coalesce(F.get(sides, k), F.lit("")), ":"), lambda g: g != "")
        both = F.struct(side(0).alias("left"), side(1).alias("right"), F.size(sides).alias("n"))

        def whole(x: Column) -> Column:
            n = F.size(x["left"]) + F.size(x["right"])
            zeros = F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0)))
            return F.when(F.when(x["n"] == 2, n <= 7).otherwise(n == 8), F.concat(x["left"], zeros, x["right"]))

        return F.when(flat.rlike(f"^{HEXES}(?:::{HEXES})?$"), let(both, whole))

    tail = rf"(?<=:)({V4})$"
    dotted = lambda a: F.concat(F.regexp_replace(a, tail, ""), let(_v4(F.regexp_extract(a, tail, 1)), _hexed))
    return let(F.when(address.rlike(tail), dotted(address)).otherwise(address), filled)


def address(text: Column) -> Column:
    """hi, lo: the two halves of an IPv4 (as ::ffff:a.b.c.d) or IPv6 address; null for any other text. Octets have no
    leading zeros, zones are no part of an address."""
    number = lambda g: F.conv(g, 16, 10).cast("long")

    def halves(groups: Column) -> Column:
        half = lambda first: F.aggregate(F.slice(groups, first, 4), F.lit(0).cast("long"), lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(number(g)))
        return F.when(groups.isNotNull(), F.struct(half(1).alias("hi"), half(5).alias("lo")))

    def either(t: Column) -> Column:
        mapped = F.struct(F.lit(0).cast("long").alias("hi"), _v4(t).bitwiseOR(F.lit(MAPPED)).alias("lo"))
        return F.when(t.rlike(f"^{V4}$"), mapped).otherwise(let(_groups(t), halves))

    return let(text, either)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def in_range(found: Column, network: str) -> Column:
    """Whether an address() lies in a network, written as address/bits; IPv4 networks hold their mapped forms."""
    net = ipaddress.ip_network(network)
    first, bits = int(net.network_address), net.prefixlen
    if net.version == 4:
        first, bits = first | MAPPED, bits + 96
    mask = ((1 << bits) - 1) << (128 - bits)
    same = lambda part, shift: part.bitwiseAND(F.lit(_signed(mask >> shift & (1 << 64) - 1))) == F.lit(_signed(first >> shift & (1 << 64) - 1))
    return F.coalesce(same(found["hi"], 64) & same(found["lo"], 0), F.lit(False))


def in_any(found: Column, networks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in networks:
        out = out | in_range(found, n)
    return out


def is_loopback(url: Column) -> Column:
    """Whether a URL or host names this machine by its literal form; names are not looked up. An empty text does
    not, an empty host does."""
    local = lambda h: F.lower(h).isin("localhost", "") | let(address(h), lambda a: in_any(a, LOOPBACK))
    return F.coalesce((url != "") & let(host_of(url), local), F.lit(False))


def host_allowed(header: Column, own: str) -> Column:
    """Whether a request's host header names the machine that serves: its own host or a loopback one."""
    ours = lambda h: (h != "") & ((F.lower(h) == own.strip("[]").lower()) | is_loopback(h))
    return F.coalesce(~header.rlike(r"^\p{IsWhite_Space}*$") & let(without_port(header), ours), F.lit(False))


def binding_error(host: Column, port: Column, loopback_only: Column) -> Column:
    """Why a server must not be bound so; null if it may."""
    wrong_port = F.concat(F.lit("ask: port must be between 1 and 65535, got "), port.cast("string"))
    refused = F.concat(F.lit('ask: refusing non-loopback host "'), host, F.lit('" — pass an explicit, non-loopback address only when you accept that the assistant may become reachable on your network'))
    return F.when(~port.between(1, 65535), wrong_port).when(host == "", F.lit("ask: host cannot be empty")).when(loopback_only & ~is_loopback(host), refused)
