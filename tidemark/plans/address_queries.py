"""Queries of addresses: which are public, which network holds them, which pages may be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import addresses as A
from tidemark.functions import urls as U
from tidemark.operators.networks import longest_networks
from tidemark.plans.registry import register
from tidemark.sources.tables import table

#: The eight groups of the address that an event stands for: all networks that aren't public, and others.
_GROUPS = """CASE WHEN k = 0 THEN e * 7919 % 65536 WHEN k = 1 THEN 64512 + e % 512 WHEN k = 2 THEN 65152 + e % 256 WHEN k = 3 THEN 8193 ELSE 0 END AS p1,
    CASE WHEN k = 4 THEN 0 WHEN e % 3 = 0 THEN 3512 WHEN e % 3 = 1 THEN 2 ELSE e * 31 % 65536 END AS p2,
    CASE WHEN k = 4 OR e % 4 < 2 THEN 0 ELSE e * 13 % 65536 END AS p3, CASE WHEN k = 4 AND e % 7 > 1 THEN 65535 WHEN k = 4 THEN 0 ELSE e * 17 % 65536 END AS p6,
    CASE WHEN k = 4 AND e % 7 < 2 THEN 0 ELSE e * 7919 % 65536 END AS p7, e % 300 AS p8, e * 7919 % 260 AS a"""
_SQL_GROUPS = f"(SELECT *, {_GROUPS} FROM (SELECT event_id, event_id AS e, event_id // 6 % 5 AS k, event_id % 6 AS f FROM events))"


def _public_4(a: str, b: str, c: str) -> str:
    return f"NOT ({a} IN (0, 10, 127) OR {a} = 100 AND {b} BETWEEN 64 AND 127 OR {a} = 169 AND {b} = 254 OR {a} = 172 AND {b} BETWEEN 16 AND 31 OR {a} = 192 AND {b} = 168 OR {a} = 192 AND {b} = 0 AND {c} IN (0, 2) OR {a} = 198 AND {b} IN (18, 19) OR {a} = 198 AND {b} = 51 AND {c} = 100 OR {a} = 203 AND {b} = 0 AND {c} = 113 OR {a} >= 224)"


def _written(rows: DataFrame, e: Column) -> DataFrame:
    """rows with the text of an address: whole, shortened, with a dotted end, in brackets, with a zone, or of four numbers."""
    kinds = rows.withColumn("e", e).withColumn("k", F.floor(F.col("e") / 6) % 5).withColumn("f", F.col("e") % 6)
    groups = kinds.selectExpr("*", *(line for line in _split(_GROUPS)))
    p = [F.lower(F.hex(n)) for n in ("p1", "p2", "p3", "p3", "p3", "p6", "p7", "p8")]
    octet = lambda n, k: F.floor(F.col(n) / (1 << 8 * k)).bitwiseAND(255).cast("string")
    tail = F.concat_ws(".", octet("p7", 1), octet("p7", 0), octet("p8", 1), octet("p8", 0))
    whole = F.concat_ws(":", *p)
    text = (
        F.when(F.col("f") == 5, F.concat_ws(".", F.col("a").cast("string"), octet("p7", 0), octet("p8", 1), octet("p8", 0)))
        .when(F.col("f") == 4, F.concat(whole, F.lit("%eth0")))
        .when(F.col("f") == 3, F.concat(F.lit("["), F.upper(whole), F.lit("]")))
        .when(F.col("f") == 2, F.concat(F.concat_ws(":", *p[:6]), F.lit(":"), tail))
        .when((F.col("f") == 1) & (F.col("p3") == 0), F.concat(F.concat_ws(":", *p[:2]), F.lit("::"), F.concat_ws(":", *p[5:])))
        .otherwise(whole)
    )
    return groups.withColumn("address", text)


def _split(columns: str) -> list[str]:
    """The columns of _GROUPS, each ends with its name."""
    parts = columns.replace("\n", " ").split(" AS ")
    names = [x.split(",")[0].strip() for x in parts[1:]]
    bodies = [parts[0], *(x.split(",", 1)[1] for x in parts[1:-1])]
    return [f"{b.strip()} AS {n}" for b, n in zip(bodies, names, strict=True)]


_PUBLIC_6 = f"""CASE WHEN p1 = 0 AND p2 = 0 AND p3 = 0 AND p6 = 0 AND p7 = 0 AND p8 IN (0, 1) OR p1 BETWEEN 64512 AND 65023 OR p1 BETWEEN 65152 AND 65215 OR p1 >= 65280 OR p1 = 8193 AND p2 = 3512 OR p1 = 8193 AND p2 = 2 AND p3 = 0 THEN FALSE
    WHEN p1 = 0 AND p2 = 0 AND p3 = 0 AND p6 = 65535 THEN {_public_4('p7 // 256', 'p7 % 256', 'p8 // 256')} ELSE TRUE END"""


@register("v5_public_addresses", f"SELECT event_id, CASE WHEN f = 4 OR f = 5 AND a > 255 THEN NULL WHEN f = 5 THEN {_public_4('a', 'p7 % 256', 'p8 // 256')} ELSE {_PUBLIC_6} END AS is_public FROM {_SQL_GROUPS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _written(table(spark, d, "events").select("event_id"), F.col("event_id"))
    return rows.select("event_id", A.is_public(F.col("address")).alias("is_public"))


#: Addresses as 128 binary digits, and networks of 4 to 126 bits around those of every 37th event, a supplier each.
_DIGITS = f"""digits AS (SELECT event_id, f, CASE WHEN f = 5 THEN repeat('0', 80) || repeat('1', 16) || format('{{:08b}}{{:08b}}{{:016b}}', a, p7 % 256, p8)
        ELSE format('{{:016b}}{{:016b}}{{:016b}}{{:016b}}{{:016b}}{{:016b}}{{:016b}}{{:016b}}', p1, p2, p3, p3, p3, p6, p7, p8) END AS n
        FROM {_SQL_GROUPS} WHERE f <> 4 AND NOT (f = 5 AND a > 255))"""


@register("v5_longest_networks", f"""WITH {_DIGITS},
    nets AS (SELECT s_suppkey, n, CASE WHEN f = 5 THEN 97 + s_suppkey % 30 ELSE 4 + s_suppkey * 7 % 121 END AS bits FROM supplier JOIN digits ON event_id = s_suppkey * 37)
    SELECT a.event_id, CAST(max(b.bits) AS INTEGER) AS bits FROM digits a JOIN nets b ON left(a.n, b.bits) = left(b.n, b.bits) GROUP BY a.event_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    seen = _written(table(spark, d, "events").select("event_id"), F.col("event_id"))
    held = _written(table(spark, d, "supplier").select("s_suppkey"), F.col("s_suppkey") * 37)
    s = F.col("s_suppkey")
    width = F.when(F.col("f") == 5, s % 30 + 1).otherwise(s * 7 % 121 + 4)
    known = table(spark, d, "events").select((F.col("event_id") / 37).alias("s_suppkey")).filter("s_suppkey = floor(s_suppkey)")
    nets = held.join(known, "s_suppkey", "left_semi").select(F.concat(F.translate("address", "[]", ""), F.lit("/"), width.cast("string")).alias("network"))
    return seen.select("event_id", "address").join(longest_networks(seen, nets), "address").select("event_id", "bits")


@register("v5_fetch_targets", """SELECT page_id, CASE WHEN k IN (1, 13) THEN 'credentials' WHEN k = 2 THEN 'port' WHEN k = 4 THEN 'scheme' WHEN k IN (5, 8, 10) THEN 'private' WHEN k IN (6, 11) THEN 'unresolved' WHEN k = 7 THEN 'unreachable' WHEN k IN (9, 12) THEN 'host' END AS refusal,
    h AS host FROM (SELECT page_id, page_id % 15 AS k, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS h FROM pages)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages as they are, and turned into ones that mustn't be fetched, with what a name server may say."""
    k, n = F.col("page_id") % 15, (F.col("page_id") % 250 + 1).cast("string")
    swap = lambda host: F.regexp_replace("url", r"://[^/?#]*", F.concat(F.lit("://"), host))
    own = F.regexp_extract("url", r"://([^/?#:]*)", 1)
    scheme_port = F.when(F.lower("url").startswith("http:"), ":80").otherwise(":443")
    url = (
        F.when(k == 1, swap(F.concat(F.lit("u:p@"), own))).when(k == 2, swap(F.concat(own, F.lit(":8080")))).when(k == 3, swap(F.concat(own, scheme_port)))
        .when(k == 4, F.regexp_replace("url", "^[a-zA-Z]+:", "ftp:")).when(k == 5, swap(F.concat(F.lit("127.0.0."), n))).when(k == 9, swap(F.lit("LocalHost.")))
        .when(k == 10, swap(F.concat(F.lit("[2001:db8::"), n, F.lit("]")))).when(k == 12, swap(F.concat(own, F.lit(".internal.")))).when(k == 13, swap(F.concat(F.lit("@"), own))).otherwise(F.col("url"))
    )
    answer = lambda kind, data: F.concat(F.lit('{"Status": 0, "Answer": [{"type": 5, "data": "alias."}, {"type": '), F.lit(kind), F.lit(', "data": "'), data, F.lit('"}]}'))
    a = F.when(k == 6, '{"Status": 3}').when(k == 7, '{"Status": 2}').when(k != 11, answer("1", F.concat(F.lit("8.8.4."), n)))
    aaaa = F.when(k == 8, answer("28", F.concat(F.lit("fd00::"), n))).when(k == 11, answer("1", F.lit("8.8.8.8"))).when(k != 6, answer("28", F.concat(F.lit("2600::"), n)))
    refused = A.refusal(url, A.dns_answers(a, "A"), A.dns_answers(aaaa, "AAAA"))
    return table(spark, d, "pages").select("page_id", refused.alias("refusal"), U.host(F.col("url")).alias("host"))
