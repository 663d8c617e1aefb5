"""Network lookup against Python's address arithmetic, for every kind of target."""

import ipaddress
import random

from pyspark.sql import functions as F

from sanscope.operators.network import address_bits, enrich_network


def plain_lookup(targets, networks, addresses):
    nets = []
    for net_id, cidr, asn in networks:
        try:
            nets.append((ipaddress.ip_network((cidr or "").strip(), strict=False), net_id, cidr, asn))
        except ValueError:
            pass
    first = {}
    for host, pos, address in sorted(addresses, key=lambda a: a[1]):
        first.setdefault(host.lower(), address)

    def block(text):
        try:
            goal = ipaddress.ip_network(text, strict=False)
        except ValueError:
            return None
        fits = [n for n in nets if n[0].version == goal.version and goal.subnet_of(n[0])]
        return min(fits, key=lambda n: (-n[0].prefixlen, n[1:]), default=None)

    out = {}
    for seq, target in targets:
        text = target.strip()
        if text[:2].upper() == "AS" and text[2:].isdigit():
            own = [n for n in nets if n[3] == int(text[2:])]
            hit = min(own, key=lambda n: (n[0].version, int(n[0].network_address), n[0].prefixlen, n[1:]), default=None)
        elif text.lower() in first:
            hit = block(first[text.lower()])
        else:
            hit = block(text)
        out[seq] = hit[1:] if hit else (None, None, None)
    return out


def forms(r, value):
    """One of the ways to write an IPv6 address."""
    a = ipaddress.IPv6Address(value)
    tail = ipaddress.IPv4Address(value & 0xFFFFFFFF)
    head = a.exploded.rsplit(":", 2)[0]
    return r.choice([str(a), a.exploded, str(a).upper(), f"{head}:{tail}", f"{a}%eth0"])


def test_all_kinds_match_plain_arithmetic(spark):
    r = random.Random(11)
    heads = [r.getrandbits(32) for _ in range(6)]
    six = [r.getrandbits(128) | 1 << 127 for _ in range(4)]
    networks, targets = [], []
    for k in range(150):
        if k % 2:
            value, bits = r.choice(heads) ^ r.getrandbits(r.choice([4, 12, 24])), r.choice([0, 1, 8, 15, 16, 17, 24, 31, 32])
            networks.append((k, f"{ipaddress.IPv4Address(value)}/{bits}", r.randrange(20)))
        else:
            value, bits = r.choice(six) ^ r.getrandbits(r.choice([8, 40, 70, 100])), r.choice([0, 3, 32, 48, 63, 64, 65, 96, 127, 128])
            networks.append((k, f" {ipaddress.IPv6Address(value)}/{bits} ", r.randrange(20)))
    networks += [(900, "10.0.0.1", 5), (901, "bad/8", 5), (902, None, 5), (903, "1.2.3.4/33", 5), (904, "::1/129", 5), (905, networks[0][1], 5), (906, "::/0", None)]
    for k in range(400):
        v4, v6 = r.choice(heads) ^ r.getrandbits(r.choice([3, 10, 25])), r.choice(six) ^ r.getrandbits(r.choice([6, 50, 101]))
        targets.append((k, r.choice([str(ipaddress.IPv4Address(v4)), f" {forms(r, v6)}\n", f"{ipaddress.IPv4Address(v4)}/{r.choice([4, 16, 24, 32])}",
                                     f"{ipaddress.IPv6Address(v6)}/{r.choice([20, 64, 90, 128])}", f"{r.choice(['AS', 'as'])}{r.randrange(25)}",
                                     f"h{k % 9}.Example.com", "nowhere.org", "", "1.2.3.4/99", "http://x.org", "::", "AS" + "9" * 30])))
    targets += [(1000 + k, targets[0][1]) for k in range(200)]
    hosts = [(f"H{k}.example.com", pos, str(ipaddress.IPv4Address(heads[k % 6])) if pos else forms(r, six[k % 4]).split("%")[0])
             for k in range(7) for pos in (1, 0)] + [("h8.example.com", 0, "broken")]
    t = spark.createDataFrame(targets, "target_seq long, target string").repartition(5)
    n = spark.createDataFrame(networks, "net_id long, cidr string, asn int").repartition(3)
    a = spark.createDataFrame(hosts, "host string, ans_pos int, address string")
    rows = enrich_network(t, n, addresses=a).collect()
    clean = [(s, x.split("%")[0] if "%" in x else x) for s, x in targets]
    assert {x.target_seq: (x.net_id, x.cidr, x.asn) for x in rows} == plain_lookup(clean, networks, hosts) and len(rows) == len(targets)
    kinds = {x.kind for x in rows}
    assert kinds == {"ip", "cidr", "asn", "host", None}


def test_address_bits(spark):
    r = random.Random(12)
    values = [0, 1, 2**127, 2**128 - 1, 2**64, *(r.getrandbits(128) for _ in range(50)), *(r.getrandbits(128) & ~(0xFFFFFFFF << 48) for _ in range(50))]
    df = spark.createDataFrame([(str(v), forms(r, v)) for v in values], "v string, t string").select("v", address_bits("t").alias("a"))
    for row in df.select("v", F.col("a.hi").alias("hi"), F.col("a.lo").alias("lo")).collect():
        assert (row.hi & (2**64 - 1)) << 64 | row.lo & (2**64 - 1) == int(row.v)


def test_no_networks(spark):
    t = spark.createDataFrame([(1, "10.0.0.1"), (2, "AS5")], "target_seq long, target string")
    n = spark.createDataFrame([], "net_id long, cidr string, asn int")
    assert [(x.target_seq, x.kind, x.net_id) for x in enrich_network(t, n).orderBy("target_seq").collect()] == [(1, "ip", None), (2, "asn", None)]
