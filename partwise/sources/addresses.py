"""Network-address policy: only globally routable addresses pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are not globally routed (first address, bits), and addresses in them that are.
PRIVATE = [("0.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24)]
ROUTED = ["192.0.0.9", "192.0.0.10"]


def number(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return a << 24 | b << 16 | c << 8 | d


def address_verdict(address: Column) -> Column:
    """Why a dotted address is rejected, or ``ok``; parts with a leading zero or above 255 are malformed, null stays null."""
    parts = F.transform(F.split(address, r"\."), lambda p: p.cast("long"))
    whole = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & ~address.rlike(r"(^|\.)0[0-9]") & ~F.exists(parts, lambda p: p > 255)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    n = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    private = None
    for base, bits in PRIVATE:
        inside = F.shiftright(n, 32 - bits) == number(base) >> (32 - bits)
        private = inside if private is None else private | inside
    return (
        F.when(address.isNull(), None).when(~whole, "malformed").when(first == 127, "loopback").when((first == 169) & (second == 254), "link_local").when(first.between(224, 239), "multicast").when(n == 0, "unspecified")
        .when(first >= 240, "reserved").when(private & ~address.isin(ROUTED), "private").when((first == 100) & second.between(64, 127), "not_global").otherwise("ok")
    )
