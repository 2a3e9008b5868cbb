"""Countries of addresses by their networks: a join on the longest prefix.

A network of n bits holds an address if the address's first n bits are the network's. So an address is looked up once for
each prefix length that the networks have (a few dozen at most): an equi-join on (family, length, bits), of which the
longest length wins. Addresses of both families are lower-case strings of bits here: 32 or 128 characters.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL, UNKNOWN = "LOCAL", "??"
# Networks that have no country
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "::1/128", "fe80::/10", "fc00::/7")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FOUR = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
#: Networks of up to so many rows go to every task.
BROADCAST_ROWS = 200_000


def _bits(number: Column, width: int) -> Column:
    return F.lpad(F.bin(number), width, "0")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _long(plain: Column) -> Column:
    """The bits of an address in groups; `::` stands for as many zero groups as are missing."""
    none = F.array().cast("array<string>")
    groups = lambda h: F.filter(F.split(h, ":"), lambda g: g != "")
    sides = _let(F.split(plain, "::"), lambda h: F.struct(groups(h[0]).alias("left"), F.when(F.size(h) > 1, groups(F.get(h, F.lit(1)))).otherwise(none).alias("right"), F.size(h).alias("n")))

    def whole(x: Column) -> Column:
        have = F.size(x["left"]) + F.size(x["right"])
        every = F.when((x["n"] == 2) & (have < 8), F.concat(x["left"], F.array_repeat(F.lit("0"), 8 - have), x["right"])).when((x["n"] == 1) & (have == 8), x["left"])
        return F.array_join(F.transform(every, lambda g: _bits(F.conv(g, 16, 10).try_cast("long"), 16)), "")

    written = plain.rlike(r"^(?:[0-9A-Fa-f]{1,4}|:)[0-9A-Fa-f:]*$") & ~plain.rlike(r"[0-9A-Fa-f]{5}|:::|::.*::|^:[^:]|[^:]:$")
    return F.when(written, _let(sides, whole))


def bits(ip: Column) -> Column:
    """The bits of an address, null if it is none. The last two groups of a long one may be written as four numbers."""
    ip = F.trim(ip)
    four = F.array_join(F.transform(F.split(ip, r"\."), lambda p: _bits(p.try_cast("long"), 8)), "")
    part = lambda t, i: F.split(t, r"\.")[i].try_cast("long")
    group = lambda t, i: F.lower(F.hex(F.try_add(part(t, i) * 256, part(t, i + 1))))
    # a tail of four numbers becomes two groups
    tail = F.regexp_extract(ip, rf":({_FOUR})$", 1)
    plain = F.when(tail != "", F.concat(F.regexp_replace(ip, rf"{_FOUR}$", ""), group(tail, 0), F.lit(":"), group(tail, 2))).otherwise(ip)
    return F.when(ip.rlike(f"^{_FOUR}$"), four).when(F.contains(ip, F.lit(":")), _let(plain, _long))


def prefixes(networks: DataFrame, network: str = "network") -> DataFrame:
    """Networks `address/length` with their `length` and the `prefix` of their bits; rows that are none drop out, as do bits
    behind the length. The family is the address's number of bits.
    """
    whole = bits(F.split_part(network, F.lit("/"), F.lit(1)))
    length = F.coalesce(F.nullif(F.split_part(network, F.lit("/"), F.lit(2)), F.lit("")).try_cast("int"), F.when(~F.col(network).contains("/"), F.length(whole)))
    out = networks.withColumns({"_whole": whole, "length": length}).filter((F.col("length") >= 0) & (F.col("length") <= F.length("_whole")))
    return out.withColumns({"family": F.length("_whole"), "prefix": F.expr("substring(_whole, 1, length)")}).drop("_whole")


def longest_prefix(rows: DataFrame, networks: DataFrame, values: list[str], ip: str = "ip", network: str = "network") -> DataFrame:
    """`rows` with the `values` of the longest network that holds their address, null without one; of equal networks the row
    with the least values counts. Each distinct address is looked up once.
    """
    table = prefixes(networks, network).groupBy("family", "length", "prefix").agg(F.min(F.struct(*values)).alias("_v"))
    lengths = table.groupBy("family").agg(F.collect_set("length").alias("lengths"))  # 162 numbers at most
    small = F.broadcast if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda t: t
    asked = rows.select(F.col(ip).alias("_address")).distinct().withColumn("_bits", bits(F.col("_address"))).filter("_bits is not null").withColumn("family", F.length("_bits"))
    asked = asked.join(F.broadcast(lengths), "family").withColumn("length", F.explode("lengths")).withColumn("prefix", F.expr("substring(_bits, 1, length)"))
    found = asked.join(small(table), ["family", "length", "prefix"]).groupBy("_address").agg(F.max_by("_v", "length").alias("_v"))
    return rows.join(found, F.col(ip) == F.col("_address"), "left").select(*rows.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def _inside(own: Column) -> Column:
    """Whether bits are those of a network without a country."""
    out = F.lit(False)
    for network in PRIVATE:
        address, length = network.split("/")
        width, text = _constant(address)
        out |= (F.length(own) == width) & own.startswith(text[: int(length)])
    return F.coalesce(out, F.lit(False))


def is_private(ip: Column) -> Column:
    """Whether an address is private, loopback or link-local; not for what is none."""
    return _let(bits(ip), _inside)


def is_local(ip: Column) -> Column:
    """Whether an address is of no country: none given, `localhost`, private, loopback or link-local."""
    return ip.isNull() | (F.trim(ip) == "") | (F.lower(F.trim(ip)) == "localhost") | is_private(ip)


def _constant(address: str) -> tuple[int, str]:
    a = ipaddress.ip_address(address)
    return a.max_prefixlen, format(int(a), f"0{a.max_prefixlen}b")


def countries(rows: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """`rows` with the country of their address from networks (network, country): LOCAL, or ?? where none is known."""
    asked = rows.select(F.col(ip).alias("_ip")).filter("_ip is not null").distinct()
    found = longest_prefix(asked, networks, ["country"], "_ip")
    found = found.withColumn("country", F.when(is_local(F.col("_ip")), LOCAL).otherwise(F.coalesce("country", F.lit(UNKNOWN))))
    return rows.join(found, F.col(ip) == F.col("_ip"), "left").select(*rows.columns, F.coalesce("country", F.lit(LOCAL)).alias("country"))
