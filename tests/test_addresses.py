"""Addresses, networks and name server answers against Python's own reader of addresses."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import addresses as A
from tidemark.functions import urls
from tidemark.operators.networks import longest_networks, network_rows

ADDRESSES = ["1.2.3.4", "255.255.255.255", "10.0.0.1", "100.127.255.255", "100.128.0.0", "192.0.1.1", "192.0.2.1", "223.255.255.255", "224.0.0.1", "::", "::1", "::2", "fc00::1", "fdff::", "fe00::1", "fe80::1", "febf::1", "fec0::1", "ff02::1", "2001:db8::1", "2001:db9::1", "2001:2::1", "2001:2:1::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::FFFF:0808:0808", "64:ff9b::8.8.8.8", "1:2:3:4:5:6:7:8", "8000::ffff:ffff:ffff:ffff", "1::8"]
BROKEN = ["", " ", "1.2.3", "1.2.3.256", "1.2.3.4.5", "a.b", "1:2:3", "1:2:3:4:5:6:7:8:9", "1::2::3", "fe80::1%eth0", "12345::", "g::1", "::1.2.3", "::1.2.3.999", "1.2:3::", None]


def by_hand(text):
    a = ipaddress.ip_address(text)
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    nets = [ipaddress.ip_network(f"{n}/{b}") for n, b in urls.PRIVATE_NETWORKS] if a.version == 4 else [ipaddress.ip_network(n) for n in A.PRIVATE_NETWORKS_6]
    return not any(a in n for n in nets)


def number(text):
    a = ipaddress.ip_address(text)
    return int(a) + (0xFFFF << 32) if a.version == 4 else int(a)


def test_addresses(spark):
    rng = random.Random(1)
    texts = ADDRESSES + [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(50)] + [ipaddress.ip_address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128)).exploded.upper() for _ in range(20)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.address(F.col("t")).alias("a"), A.is_public(F.concat(F.lit(" ["), F.col("t"), F.lit("] "))).alias("p")).collect()
    for r in out:
        assert ((r.a.high % (1 << 64)) << 64) + r.a.low % (1 << 64) == number(r.t), r
        assert r.p == by_hand(r.t), r


def test_what_is_no_address(spark):
    out = spark.createDataFrame([(t,) for t in BROKEN], "t string").select("t", A.address(F.col("t")).alias("a"), A.is_public(F.col("t")).alias("p")).collect()
    assert [(r.t, r.a, r.p) for r in out] == [(t, None, None) for t in BROKEN]


def test_longest_networks(spark):
    rng = random.Random(2)
    nets = ["0.0.0.0/0", "::/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.3/32", "10.1.2.99/24", "8000::/1", "2001:db8::/32", "2001:db8:1::/48", "2001:db8:1::1/128", "2001:db8:1:0:8000::/65", "x", None, "1.2.3.4", "10.0.0.0/33"]
    asked = ["10.1.2.3", "10.1.2.4", "10.1.3.4", "10.2.0.0", "11.0.0.0", "::ffff:10.1.2.3", "2001:db8::5", "2001:db8:1::1", "2001:db8:1::2", "2001:db8:1:0:8000::2", "ffff::1", "nothing", None] + [str(ipaddress.ip_address(rng.getrandbits(128))) for _ in range(30)]
    got = {r.address: (r.network, r.bits) for r in longest_networks(spark.createDataFrame([(a,) for a in asked + asked], "address string"), spark.createDataFrame([(n,) for n in nets], "network string")).collect()}
    known = []
    for n in nets:
        try:
            net = ipaddress.ip_network(n, strict=False)
        except ValueError:
            continue
        if n and "/" in n:
            known.append((n, number(str(net.network_address)), net.prefixlen + (96 if net.version == 4 else 0)))
    expected = {}
    for a in asked:
        if a and a != "nothing":
            held = [(b, n) for n, first, b in known if number(a) >> 128 - b == first >> 128 - b]
            if held:
                expected[a] = max(held)[::-1]
    assert got == expected
    assert longest_networks(spark.createDataFrame([("1.1.1.1",)], "address string"), spark.createDataFrame([], "network string")).count() == 0
    assert network_rows(spark.createDataFrame([("10.9.9.9/8",), ("10.0.0.0/8",)], "network string")).count() == 1


@pytest.mark.parametrize(
    ("payload", "failed", "found"),
    [
        ({"Status": 0, "Answer": [{"type": 1, "data": "8.8.8.8"}, {"type": 5, "data": "a.org"}, {"type": "1", "data": "9.9.9.9"}, {"type": 1, "data": 7}, None, 3]}, False, ["8.8.8.8"]),
        ({"Status": 3, "Answer": [{"type": 1, "data": "8.8.8.8"}]}, False, []),
        ({"Status": 2}, True, []),
        ({"Answer": [{"type": 1, "data": "1.1.1.1"}]}, False, ["1.1.1.1"]),
        ({"Status": "2", "Answer": [{"type": 1, "data": "1.1.1.1"}]}, False, ["1.1.1.1"]),
        ({"Status": 0, "Answer": {"type": 1, "data": "1.1.1.1"}}, False, []),
        ({}, False, []),
        ("text", True, []),
        (None, True, []),
    ],
)
def test_dns_answers(spark, payload, failed, found):
    r = spark.createDataFrame([(json.dumps(payload),)], "p string").select(A.dns_answers(F.col("p"), "A").alias("a")).first().a
    assert (r.failed, r.addresses) == (failed, found)


def test_refusals(spark):
    ok = json.dumps({"Status": 0, "Answer": [{"type": 1, "data": "8.8.8.8"}]})
    inner = json.dumps({"Status": 0, "Answer": [{"type": 28, "data": "fd00::1"}]})
    rows = [
        ("https://a.org/x", ok, None, None), ("http://a.org:80/", ok, None, None), ("https://a.org:80/", ok, None, "port"), ("ftp://a.org/", ok, None, "scheme"), ("a.org", ok, None, "invalid"), (None, ok, None, "invalid"), ("https://", ok, None, "invalid"),
        ("https://u:p@a.org/", ok, None, "credentials"), ("https://LOCALHOST./", ok, None, "host"), ("https://intranet/", ok, None, "host"), ("https://x.internal/", ok, None, "host"), ("https://10.0.0.1/", ok, None, "private"), ("https://8.8.8.8/", None, None, None),
        ("https://[::1]/", None, None, "private"), ("https://[2600::1]:443/", None, None, None), ("https://a.org/", None, None, "unresolved"), ("https://a.org/", '{"Status": 2}', None, "unreachable"), ("https://a.org/", ok, inner, "private"), ("https://a.org/", ok, "[]", None),
    ]
    frame = spark.createDataFrame([r[:3] for r in rows], "url string, a string, aaaa string")
    got = [r.why for r in frame.select(A.refusal(F.col("url"), A.dns_answers(F.col("a"), "A"), A.dns_answers(F.col("aaaa"), "AAAA")).alias("why")).collect()]
    assert got == [r[3] for r in rows]
