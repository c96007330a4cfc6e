"""Which network an address lies in: the longest prefix that holds it, by equi-joins on prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.addresses import address, top_bits


def network_rows(networks: DataFrame, network: str = "network") -> DataFrame:
    """Networks as bits, high and low in the space of IPv6 addresses; what can't be read as address/bits goes.

    Bits beyond the prefix are cleared, as 10.1.2.3/8 means 10.0.0.0/8. Rows that mean one network stand once, by the
    smallest text.
    """
    base = F.substring_index(network, "/", 1)
    given = F.regexp_extract(F.col(network), r"/(\d{1,3})\s*$", 1).try_cast("int")
    four = ~base.contains(":")
    read = networks.select(network, address(base).alias("a"), (given + F.when(four, 96).otherwise(0)).alias("bits"))
    read = read.filter(F.col("a").isNotNull() & F.col("bits").between(0, 128))
    high, low = top_bits(F.col("a.high"), F.col("a.low"), F.col("bits"))
    return read.select(network, "bits", high.alias("high"), low.alias("low")).groupBy("bits", "high", "low").agg(F.min(network).alias(network))


def longest_networks(addresses: DataFrame, networks: DataFrame, address_col: str = "address", network: str = "network") -> DataFrame:
    """(address, network, bits) for each distinct address that a network holds: the network with the longest prefix.

    An address is asked once for each length of prefix that the networks have, at most 129, with its first bits as the
    key; so nothing is compared with a range, and addresses that repeat are joined once. Addresses that can't be read, and
    those that no network holds, have no row. bits counts in the space of IPv6 addresses (IPv4 networks: 96 more).
    """
    nets = network_rows(networks, network)
    lengths = sorted(r.bits for r in nets.select("bits").distinct().collect())
    if not lengths:
        return addresses.select(address_col).limit(0).withColumn(network, F.lit(None).cast("string")).withColumn("bits", F.lit(None).cast("int"))
    asked = addresses.select(address_col).distinct().withColumn("_a", address(F.col(address_col))).filter("_a IS NOT NULL")
    each = asked.select(address_col, "_a", F.explode(F.array(*map(F.lit, lengths))).alias("bits"))
    high, low = top_bits(F.col("_a.high"), F.col("_a.low"), F.col("bits"))
    met = each.select(address_col, "bits", high.alias("high"), low.alias("low")).join(nets, ["bits", "high", "low"])
    return met.groupBy(address_col).agg(F.max_by(network, "bits").alias(network), F.max("bits").alias("bits"))
