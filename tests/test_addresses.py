"""Networks against the standard library, mail addresses and session ids against plain code."""

import ipaddress
import random
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from siftwork.functions import network, text
from siftwork.operators import networks


def shown(rng, version):
    if version == 4:
        return str(ipaddress.IPv4Address(rng.choice([rng.getrandbits(32), 10 << 24 | rng.getrandbits(12)])))
    address = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), 0xFD00 << 112 | rng.getrandbits(9), rng.getrandbits(20), rng.getrandbits(64) << 64]))
    return rng.choice([str(address), address.exploded, str(address).upper()])


def test_narrowest_equals_the_library(spark):
    rng = random.Random(1)
    nets = [f"{shown(rng, v)}/{rng.randrange((32 if v == 4 else 128) + 1)}" for v in (4, 6) for _ in range(150)]
    nets += ["0.0.0.0/0", "10.0.0.0/20", "fd00::/119", "10.0.0.7", "::/0", "10.0.0.0/33", "::/129", "10.0.0/8", "x", "", "1.2.3.4/a", "1.2.3.4/", "1.2.3.4/8/8", None]
    hosts = [shown(rng, v) for v in (4, 6) for _ in range(300)] + ["10.0.0.7", "::", "::ffff:10.0.0.7", "1::2::3", "01.2.3.4", "", None, "1.2.3", "fd00::1%eth0", "1:2:3:4:5:6:7::"]
    df = spark.createDataFrame([(i, h, "n") for i, h in enumerate(hosts)], "id int, host string, cidr string")
    got = {r["id"]: r["best"] for r in networks.narrowest(df, spark.createDataFrame([(n,) for n in nets], "net string"), "host", "net", "best").collect()}
    known = []
    for n in nets:
        try:
            known.append((ipaddress.ip_network(n, strict=False), n))
        except ValueError:
            pass
    for i, h in enumerate(hosts):
        try:
            a = ipaddress.ip_address((h or "").split("%")[0])
        except ValueError:
            assert got[i] is None
            continue
        inside = [(net.prefixlen, n) for net, n in known if net.version == a.version and a in net]
        longest = max((p for p, _ in inside), default=None)
        assert got[i] == min((n for p, n in inside if p == longest), default=None), h


def test_narrowest_compares_no_ranges(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "host string")
    plan = networks.narrowest(df, spark.createDataFrame([("10.0.0.0/8",)], "net string"), "host", "net", "best")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert networks.narrowest(df, spark.createDataFrame([], "net string"), "host", "net", "best").collect()[0]["best"] is None


@pytest.mark.parametrize("nets", [("fe80::1:0/112", "::1/128", "2001:db8::/33"), ("10.1.2.0/23", "0.0.0.0/1", "fc00::/7")])
def test_within_a_few_networks(spark, nets):
    rng = random.Random(2)
    hosts = [shown(rng, v) for v in (4, 6) for _ in range(200)] + ["fe80::1:ffff", "fe80::2:0", "2001:db8:7fff::", "2001:db8:8000::", "10.1.3.255", "10.1.4.0", "x"]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(network.within(F.col("h"), nets)).collect()]
    inside = lambda h: any(ipaddress.ip_address(h) in ipaddress.ip_network(n) for n in nets)
    assert got == [h != "x" and inside(h) for h in hosts]


def plainly(s):
    """The documented rules, character by character."""
    if s is None or len(s) > 2048:
        return False
    t = s.strip()
    if t.endswith(">") and "<" in t:
        name, _, inner = t.partition("<")
        name = name.strip()
        words = name.split()
        if name.startswith('"') and name.endswith('"') and len(name) > 2 and '"' not in name[1:-1] or all(c.isalnum() or c in "!#$%&'*+-/=?^_`{|}~" for w in words for c in w):
            t = inner[:-1].strip()
    if t.count("@") != 1 or len(t.encode()) > 254:
        return False
    local, domain = t.split("@")
    kind = lambda c: unicodedata.category(c)[0]
    if not 1 <= len(local) <= 64 or kind(local[0]) == "M" and ord(local[0]) > 127:
        return False
    for part in local.split("."):
        if not part or not all(c.isascii() and (c.isalnum() or c in "!#$%&'*+-/=?^_`{|}~") or not c.isascii() and kind(c) in "LNMPS" for c in part):
            return False
    labels = domain.lower().split(".")
    if len(labels) < 2 or len(domain) > 253:
        return False
    for g in labels:
        if not 1 <= len(g) <= 63 or g[0] == "-" or g[-1] == "-" or g[2:4] == "--" and not g.startswith("xn--") or not all(c == "-" or c.isascii() and c.isalnum() or not c.isascii() and kind(c) in "LNM" for c in g):
            return False
        if kind(g[0]) == "M":
            return False
    if labels[-1][-1].isascii() and not labels[-1][-1].isalpha():
        return False
    return labels[-1] not in ("arpa", "invalid", "local", "localhost", "onion", "test")


def test_server_email(spark):
    rng = random.Random(4)
    bits = ["a", "B1", ".", "@", "-", "--", "xn--", "é", "中", "́", " ", "_", "+", "#", "<", ">", '"', "(", "example", ".com", ".test", "x" * 60, "1", "\n", "\t"]
    given = ["".join(rng.choices(bits, k=rng.randrange(1, 9))) for _ in range(1500)] + [f"{rng.choice(['a', 'a.b', 'é', 'a..b', '.a', 'A+b#c'])}@{rng.choice(['x', 'x.co', 'x.c0', 'x.c1m', '-x.co', 'x-.co', 'é.co', 'x.test', 'ab--c.de', 'xn--bc.de', 'x..co', 'x.co.'])}" for _ in range(300)]
    given += ["a" * 64 + "@x.co", "a" * 65 + "@x.co", "a@" + "b" * 63 + ".co", "a@" + "b" * 64 + ".co", "a@" + "b." * 125 + "co", "a@" + "b." * 126 + "co", "n m <a@x.co>", "<a@x.co>", '"q r" <a@x.co>', " a@x.co\n", "a@x.co <a", "", None, "x <" + "a@x.co".rjust(2100) + ">"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "s string").select(text.is_server_email(F.col("s"))).collect()]
    assert [(g, x) for g, x in zip(given, got, strict=True) if x != plainly(g)] == []
    assert 50 < sum(got) < len(got) - 50


def test_session_ids_as_the_library_reads_them(spark):
    u = uuid.UUID("12345678-9abc-def0-1234-56789abcdef0")
    given = [str(u), u.hex, u.urn, "{" + str(u) + "}", str(u).upper(), "1234-56789abcdef0-12345678-9abc-def0", "uuid:" + u.hex, "urn:" + u.hex, u.hex + "-", "--" + u.hex, "{{" + u.hex, u.hex[:-1], u.hex + "0", "", None, "URN:UUID:" + u.hex, u.hex[:5] + "urn:" + u.hex[5:], "zz" + u.hex[2:]]

    def library(s):
        try:
            return str(uuid.UUID(s)) if s else None
        except ValueError:
            return None

    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "s string").select(text.session_id(F.col("s"))).collect()]
    assert got == [library(g) for g in given]


def test_token_ids_as_the_language_reads_numbers(spark):
    given = ["5_0.x", "５０.x", " 12 .x", "1__0.x", "_1.x", "1_.x", "+7.x", "-7.x", "١٢.s.t", "9" * 30 + ".x", "x.x", ".x", "1.", "1", "", "१_२.q"]

    def language(s):
        a, dot, b = s.partition(".")
        try:
            return int(a) if dot and b and abs(int(a)) < 2**63 else None
        except ValueError:
            return None

    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "s string").select(text.token_id(F.col("s"))).collect()]
    assert got == [language(g) for g in given]
