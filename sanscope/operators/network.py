"""Targets (addresses, CIDR blocks, ASNs, hosts) -> most specific network block, as one equi join.

Addresses are 128 bits in two longs; an IPv4 address fills the top 32 bits. A block's key is its family,
prefix length and the bits of its prefix. Every distinct target is given one key per prefix length
that occurs among the blocks and isn't longer than the target's own (at most 33 + 129, bounded by
the address formats, not by the data), so containment is equality of keys: no range test, no bucket
that a large block floods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sanscope.functions import names as N
from sanscope.functions.targets import ASN_RE, DOMAIN_RE, IPV4_RE, IPV6_RE

IP, CIDR, ASN, HOST = "ip", "cidr", "asn", "host"
_SIGN = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def ipv4_to_long(col) -> Column:
    """Dotted quad -> BIGINT; null when not a valid IPv4 address."""
    c = N._c(col)
    return F.when(c.rlike(IPV4_RE), _let(F.transform(F.split(c, r"\.", -1), lambda x: x.cast("long")), lambda q: (
        q[0] * 16777216 + q[1] * 65536 + q[2] * 256 + q[3])))


def _ipv6_hex(col: Column) -> Column:
    """32 hex digits of a valid IPv6 address (``::`` filled in, a dotted tail read, the zone cut off)."""
    def dotted(text: Column) -> Column:
        return _let(ipv4_to_long(F.substring_index(text, ":", -1)), lambda n: F.concat(
            F.regexp_replace(text, r"[0-9.]+\z", ""), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535)))))

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    def whole(sides: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), 8 - F.size(sides[0]) - F.size(sides[1]))
        return F.array_join(F.transform(F.concat(sides[0], zeros, sides[1]), lambda g: F.lpad(g, 4, "0")), "")

    def filled(text: Column) -> Column:
        return _let(F.split(text, "::", 2), lambda h: _let(
            F.array(groups(h[0]), groups(F.coalesce(F.get(h, F.lit(1)), F.lit("")))), whole))

    return _let(F.split(col, "%", 2)[0], lambda t: _let(F.when(t.contains("."), dotted(t)).otherwise(t), filled))


def address_bits(col) -> Column:
    """struct(family, hi, lo, bits) of an IPv4 or IPv6 address; null if it is neither."""
    c = N._c(col)
    v4 = F.struct(F.lit(4).alias("family"), F.shiftleft(ipv4_to_long(c), 32).alias("hi"),
                  F.lit(0).cast("bigint").alias("lo"), F.lit(32).alias("bits"))

    def halves(h: Column) -> Column:
        return F.struct(F.lit(6).alias("family"), F.conv(F.substring(h, 1, 16), 16, -10).cast("bigint").alias("hi"),
                        F.conv(F.substring(h, 17, 16), 16, -10).cast("bigint").alias("lo"), F.lit(128).alias("bits"))

    return F.when(c.rlike(IPV4_RE), v4).when(c.rlike(IPV6_RE), _let(_ipv6_hex(c), halves))


def block_bits(col) -> Column:
    """``address_bits`` of an address or CIDR block; ``bits`` is the prefix length. Null if invalid."""
    def block(parts: Column) -> Column:
        length = F.when(parts[1] != "", parts[1]).cast("int")
        return _let(address_bits(parts[0]), lambda a: F.when(F.coalesce(length, a["bits"]) <= a["bits"], F.struct(
            a["family"].alias("family"), a["hi"].alias("hi"), a["lo"].alias("lo"), F.coalesce(length, a["bits"]).alias("bits"))))

    c = N._c(col)
    return _let(F.array(F.regexp_replace(c, r"/[0-9]{1,3}\z", ""), F.regexp_extract(c, r"/([0-9]{1,3})\z", 1)), block)


def with_block(df: DataFrame, col, out: str = "_b") -> DataFrame:
    """Add ``block_bits(col)``. It is the output of a generator, so that filters and later columns read it
    instead of computing it again."""
    return df.withColumn(out, F.explode_outer(F.array(block_bits(col))))


def prefix_key(hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    """The first ``length`` bits, the others zero."""
    ones = F.lit(-1).cast("bigint")
    top = F.when(length >= 64, hi).when(length == 0, 0).otherwise(hi.bitwiseAND(F.call_function("shiftleft", ones, 64 - length)))
    low = F.when(length <= 64, 0).when(length == 128, lo).otherwise(lo.bitwiseAND(F.call_function("shiftleft", ones, 128 - length)))
    return top.cast("bigint"), low.cast("bigint")


def target_kind(col, block: Column) -> Column:
    """ip, cidr, asn, host, or null for anything else; ``block`` is the target's ``block_bits``."""
    c = N._c(col)
    return (F.when(c.rlike(ASN_RE), ASN).when(block.isNotNull(), F.when(c.contains("/"), CIDR).otherwise(IP))
            .when(c.rlike(DOMAIN_RE), HOST))


def network_blocks(networks: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """Blocks with family, prefix_len and the two halves of their prefix; rows without a valid block go."""
    b = with_block(networks, N.py_strip(cidr_col)).where(F.col("_b").isNotNull())
    hi, lo = prefix_key(F.col("_b.hi"), F.col("_b.lo"), F.col("_b.bits"))
    return b.select(*networks.columns, F.col("_b.family").alias("_family"), F.col("_b.bits").alias("_len"), hi.alias("_hi"), lo.alias("_lo"))


def enrich_network(targets: DataFrame, networks: DataFrame, target_col: str = "target",
                   keep=("net_id", "cidr", "asn"), asn_col: str = "asn", addresses: DataFrame | None = None) -> DataFrame:
    """(target_seq, ip, kind, <keep>) for every target; a target without a block has nulls.

    An address or CIDR target gets the most specific block that contains it, an ASN target the first of its
    blocks (IPv4 first, then by address and length), a host the block of its stored address
    (``addresses``: host, ans_pos, address; the first answer counts). Of equal blocks the least row counts.

    Each distinct target is looked up once, so a target that holds a third of all rows is reduced before the
    lookup and its rows meet their answer in a plain join that can be split. Broadcast or
    shuffle is the optimizer's choice by size.
    """
    blocks = network_blocks(networks)
    # at most 162 (family, length) pairs exist
    lengths = [(r[0], r[1]) for r in blocks.select("_family", "_len").distinct().collect()]
    t = targets.select("target_seq", N.py_strip(target_col).alias("ip"))
    asked = with_block(t.select("ip").distinct(), "ip").select("ip", target_kind("ip", F.col("_b")).alias("kind"), F.col("_b").alias("a"))
    if addresses is not None:
        first = addresses.groupBy(F.lower("host").alias("_host")).agg(F.min_by("address", "ans_pos").alias("_address"))
        first = with_block(first, N.py_strip("_address"))
        asked = asked.join(first, F.when(F.col("kind") == HOST, F.lower("ip")) == F.col("_host"), "left").select(
            "ip", "kind", F.coalesce("a", "_b").alias("a"))

    present = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("len")) for f, n in sorted(lengths)]).cast(
        "array<struct<family:int,len:int>>")
    keyed = (asked.where(F.col("a").isNotNull())
             .select("ip", "a", F.explode(F.filter(present, lambda x: (x["family"] == F.col("a.family")) & (x["len"] <= F.col("a.bits")))).alias("x")))
    hi, lo = prefix_key(F.col("a.hi"), F.col("a.lo"), F.col("x.len"))
    keyed = keyed.select("ip", F.col("x.family").alias("_family"), F.col("x.len").alias("_len"), hi.alias("_hi"), lo.alias("_lo"))
    row = F.struct(*[F.col(c).alias(c) for c in keep])
    by_prefix = keyed.join(blocks, ["_family", "_len", "_hi", "_lo"]).groupBy("ip").agg(
        F.min(F.struct((-F.col("_len")).alias("l"), row.alias("row"))).alias("best"))

    def unsigned(c: str) -> Column:
        return F.col(c).bitwiseXOR(F.lit(_SIGN).cast("bigint"))

    owned = blocks.groupBy(F.col(asn_col).cast("bigint").alias("_asn")).agg(F.min(F.struct(
        "_family", unsigned("_hi").alias("h"), unsigned("_lo").alias("o"), "_len", row.alias("row"))).alias("best"))
    number = F.substring("ip", 3, 30).try_cast("bigint")
    by_asn = asked.where(F.col("kind") == ASN).join(owned, number == F.col("_asn")).select("ip", F.col("best.row").alias("row"))
    found = by_prefix.select("ip", F.col("best.row").alias("row")).unionByName(by_asn)
    kinds = asked.select("ip", "kind").join(found, "ip", "left")
    return t.join(kinds, "ip", "left").select("target_seq", "ip", "kind", *[F.col(f"row.{c}").alias(c) for c in keep])
