"""IPv4 and IPv6 addresses of hosts as two longs, which of them are public, and what a name server answered.

IPv4 addresses are read as the IPv6 addresses that they are mapped to (::ffff:0:0/96), so both kinds lie in one space of
128 bits and one rule serves both.
"""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.text import let

#: IPv6 networks that aren't public.
PRIVATE_NETWORKS_6 = ("::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32", "2001:2::/48")
#: The record types of a name server's answers, and its status for a name that doesn't exist.
RECORDS = {"A": 1, "AAAA": 28}
NO_SUCH_NAME = 3


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _network(text: str) -> tuple[int, int, int]:
    """A network as two signed longs and the number of bits that count, in the space of 128 bits."""
    net = ip_network(text)
    number, bits = (int(net.network_address) + (0xFFFF << 32), net.prefixlen + 96) if net.version == 4 else (int(net.network_address), net.prefixlen)
    return _signed(number >> 64), _signed(number & (1 << 64) - 1), bits


PRIVATE = tuple(_network(n) for n in (*(f"{first}/{bits}" for first, bits in urls.PRIVATE_NETWORKS), *PRIVATE_NETWORKS_6))


def bare_address(text: Column) -> Column:
    """A host or address without brackets and the dot at its end, in lower case; '' for null."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^\[|\]$", ""), r"\.$", ""))


def _octets(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))
    return F.when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p <= 255), parts)


def _halves(groups: Column) -> Column:
    """The longs of eight groups of hexadecimal digits."""
    digits = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    number = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("long")
    return F.struct(number(1).alias("high"), number(17).alias("low"))


def _read_6(text: Column) -> Column:
    """``text`` holds a colon. Colons that separate nothing are passed over, as the application does."""
    tail = F.substring_index(text, ":", -1)
    dotted = text.contains(".")
    octets = _octets(tail)
    pair = lambda o, k: F.lower(F.hex(F.get(o, F.lit(k)) * 256 + F.get(o, F.lit(k + 1))))
    spread = F.when(~dotted, text).otherwise(let(octets, lambda o: F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), pair(o, 0), F.lit(":"), pair(o, 2))))
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    def read(sides: Column) -> Column:
        left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
        missing = 8 - F.size(left) - F.size(right)
        fits = (F.size(sides) <= 2) & F.when(F.size(sides) == 1, missing == 0).otherwise(missing >= 0)
        whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        return F.when(fits, let(whole, lambda w: F.when(F.forall(w, lambda g: g.rlike("^[0-9a-f]{1,4}$")), _halves(w))))

    return F.when(~text.contains("%"), let(F.split(spread, "::", -1), read))


def address(text: Column) -> Column:
    """(high, low) of an IPv4 or IPv6 address, brackets and a dot at the end aside; null for what is none.

    Zones (``%eth0``) make no address, short forms (``::``) and dotted ends are read, letters may be large or small.
    """

    def read(t: Column) -> Column:
        mapped = lambda o: F.struct(F.lit(0).cast("long").alias("high"), (F.lit(0xFFFF << 32) + F.aggregate(o, F.lit(0).cast("long"), lambda n, x: n * 256 + x)).alias("low"))
        return F.when(t.contains(":"), _read_6(t)).otherwise(let(_octets(t), lambda o: F.when(o.isNotNull(), mapped(o))))

    return let(bare_address(text), read)


def top_bits(high: Column, low: Column, bits: Column | int) -> tuple[Column, Column]:
    """The first ``bits`` bits of an address, the others zero, as two longs: equal for all addresses of a network."""
    bits = bits if isinstance(bits, Column) else F.lit(bits)
    # A shift by 64 is none, so the ends of the range are said apart.
    cleared = lambda x, n: F.call_function("shiftleft", F.call_function("shiftright", x, n.cast("int")), n.cast("int"))
    zero = F.lit(0).cast("long")
    first = F.when(bits >= 64, high).when(bits <= 0, zero).otherwise(cleared(high, 64 - bits))
    second = F.when(bits <= 64, zero).when(bits >= 128, low).otherwise(cleared(low, 128 - bits))
    return first, second


def is_public(text: Column) -> Column:
    """Is an address one of the public network? Null for what is no address."""

    def judged(a: Column) -> Column:
        private = F.lit(False)
        for high, low, bits in PRIVATE:
            first, second = top_bits(a["high"], a["low"], bits)
            private = private | ((first == high) & (second == low))
        return F.when(a.isNotNull(), ~private)

    return let(address(text), judged)


def dns_answers(payload: Column, record: str) -> Column:
    """(failed, addresses) of a name server's JSON answer to a question for A or AAAA records.

    Answers of other types or without text are passed over; a name that doesn't exist has none. What is no JSON object,
    and any other status than 0, is a failure. A null payload, no answer at all, has no addresses.
    """

    def read(v: Column) -> Column:
        number = lambda x: F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
        status = F.try_variant_get(v, "$.Status", "variant")
        code = F.when(number(status), F.try_variant_get(status, "$", "double"))
        listed = F.coalesce(F.try_variant_get(v, "$.Answer", "array<variant>"), F.array().cast("array<variant>"))
        kind = lambda x: F.try_variant_get(x, "$.type", "variant")
        data = lambda x: F.try_variant_get(x, "$.data", "variant")
        wanted = lambda x: number(kind(x)) & (F.try_variant_get(kind(x), "$", "double") == RECORDS[record]) & (F.schema_of_variant(data(x)) == "STRING")
        found = F.transform(F.filter(listed, lambda x: F.coalesce(wanted(x), F.lit(False))), lambda x: F.try_variant_get(data(x), "$", "string"))
        none = F.array().cast("array<string>")
        bad = ~F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False))
        return F.struct(
            F.when(payload.isNull(), False).when(bad, True).otherwise(F.coalesce(~code.isin(0, NO_SUCH_NAME), F.lit(False))).alias("failed"),
            F.when(bad | F.coalesce(code != 0, F.lit(False)), none).otherwise(found).alias("addresses"),
        )

    return let(F.try_parse_json(payload), read)


def is_disallowed(name: Column) -> Column:
    """Hosts that no page is fetched from: none, local names, and names without a dot that are no address."""
    return let(bare_address(name), lambda h: (h == "") | (h == "localhost") | h.rlike(r"\.(localhost|local|internal)$") | (~h.contains(".") & address(h).isNull()))


def refusal(url: Column, a: Column, aaaa: Column) -> Column:
    """Why a page isn't fetched, null where it may be: the first rule that its address or its host's answers break.

    invalid, scheme, credentials, port, host, private; unreachable where a name server failed, which is worth another
    try, and unresolved where a name has no address. ``a`` and ``aaaa`` are the answers of ``dns_answers``; a host that is
    an address itself needs none. Of several addresses all must be public.
    """
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*:/*([^/?#\\]*)", 1)
    place = F.regexp_replace(authority, "^.*@", "")
    parts = F.struct(
        F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme"),
        authority.contains("@").alias("user"),
        F.regexp_extract(place, r":(\d*)$", 1).alias("port"),
        bare_address(F.regexp_replace(place, r":\d*$", "")).alias("host"),
        F.array_distinct(F.transform(F.concat(a["addresses"], aaaa["addresses"]), bare_address)).alias("found"),
    )

    def judged(p: Column) -> Column:
        default = F.when(p["scheme"] == "http", "80").otherwise("443")
        literal = is_public(p["host"])
        return (
            F.when(url.isNull() | (p["scheme"] == "") | ((p["host"] == "") & p["scheme"].isin("http", "https")), "invalid")
            .when(~p["scheme"].isin("http", "https"), "scheme")
            .when(p["user"], "credentials")
            .when((p["port"] != "") & (p["port"] != default), "port")
            .when(is_disallowed(p["host"]), "host")
            .when(literal.isNotNull(), F.when(~literal, "private"))
            .when(a["failed"] | aaaa["failed"], "unreachable")
            .when(F.size(p["found"]) == 0, "unresolved")
            .when(F.exists(p["found"], lambda x: ~F.coalesce(is_public(x), F.lit(False))), "private")
        )

    return let(parts, judged)
