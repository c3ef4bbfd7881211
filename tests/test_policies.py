"""Addresses against the library's own classes; the older specification list in full."""

import ipaddress
import random

from pyspark.sql import functions as F

from partwise.plans import extras
from partwise.sources.addresses import address_verdict


def by_library(text):
    try:
        address = ipaddress.ip_address(text)
    except ValueError:
        return "malformed"
    for name in ("is_loopback", "is_link_local", "is_multicast", "is_unspecified", "is_reserved", "is_private"):
        if getattr(address, name):
            return name[3:]
    return "ok" if address.is_global else "not_global"


def test_addresses_are_judged_as_the_library_judges_them(spark):
    rng = random.Random(3)
    edges = ["0.0.0.0", "0.0.0.1", "10.255.255.255", "11.0.0.0", "100.63.0.0", "100.64.0.0", "100.127.255.255", "100.128.0.0", "127.0.0.1", "169.254.0.1", "172.15.0.0", "172.31.9.9", "172.32.0.0", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.2.1", "192.88.99.1", "192.168.0.1", "198.17.0.0", "198.19.255.255", "198.20.0.0", "203.0.113.7", "224.0.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "a.b.c.d", ""]
    texts = edges + [".".join(str(rng.randint(0, 260)) for _ in range(4)) for _ in range(500)]
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", address_verdict(F.col("t")).alias("v")).collect()}
    assert {t: v for t, v in got.items() if t is not None} == {t: by_library(t) for t in texts} and got[None] is None


def test_every_name_of_the_older_list(spark):
    rows = [(n.title() + ":", key, shown) for key, shown, names in extras.LEGACY_SPECS for n in [*names, key]] + [("Colour", None, None), ("", None, None), (None, None, None)]
    got = spark.createDataFrame(rows, "raw string, key string, shown string").select("*", extras.legacy_specification(F.col("raw"), F.lit(" 3 \n V ")).alias("x")).collect()
    assert all((r.x.key, r.x.label, r.x.value) == (r.key, r.shown, "3 V") if r.key else r.x is None for r in got)
    assert spark.range(1).select(extras.legacy_specification(F.lit("size"), F.lit(" ")).alias("x")).first().x is None
