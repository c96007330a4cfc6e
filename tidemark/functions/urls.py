"""Addresses of pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

#: Query parameters that only track, and hosts whose root is no source.
TRACKING = ("fbclid", "gclid", "dclid", "gbraid", "wbraid", "igshid", "mc_cid", "mc_eid", "ref_src")
SHARED_HOSTS = ("x.com", "twitter.com", "www.twitter.com", "www.x.com", "mobile.twitter.com", "reddit.com", "www.reddit.com", "youtube.com", "www.youtube.com", "m.youtube.com", "medium.com", "www.medium.com", "linkedin.com", "www.linkedin.com")

_PARTS = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _with_scheme(url: Column) -> Column:
    url = F.trim(url)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.regexp_replace(_with_scheme(url), r"^[A-Za-z]+(?=://)", "~"), r"^~://([^/?#]*)([^?#]*)(\?[^#]*)?", k)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_with_scheme(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(_part(url, 1), r":\d*$", ""))


def _escaped(part: Column, also: str) -> Column:
    """A part of an address with spaces, characters beyond ASCII and those of ``also`` as %XX; what is escaped stays."""
    odd = rf"[^\x21-\x7e]|[{also}]"
    each = F.transform(F.split(part, ""), lambda c: F.when(c.rlike(odd), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(part.rlike(odd), F.array_join(each, "")).otherwise(part)


def _without_dots(path: Column) -> Column:
    """A path with its . and .. steps taken."""
    steps = F.slice(F.split(path, "/"), 2, 1 << 20)
    none = F.array().cast("array<string>")

    def take(done: Column, step: Column) -> Column:
        back = F.lower(step).isin("..", "%2e%2e", ".%2e", "%2e.")
        stay = F.lower(step).isin(".", "%2e")
        return F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(stay, done).otherwise(F.array_append(done, step))

    walked = F.aggregate(steps, none, take)
    last = F.element_at(steps, -1)
    # After a dot at the end the address is that of a folder.
    folder = F.lower(last).isin("..", ".", "%2e", "%2e%2e", ".%2e", "%2e.") & (F.size(walked) >= 0)
    return F.when(path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(folder & (F.size(walked) > 0), "/").otherwise(""))).otherwise(path)


def canonical_url(url: Column) -> Column:
    """One address for one page; null for what isn't an http address, names a user or a port of its own, or is blank.

    The scheme defaults to https; fragment, default port and tracking parameters go; the order of the rest stays. Dot
    steps of the path are taken, and what an address can't hold is escaped.
    """
    parts = F.struct((F.trim(url) != "").alias("some"), scheme(url).alias("scheme"), _part(url, 1).alias("authority"), _part(url, 2).alias("path"), F.substring(_part(url, 3), 2, 1 << 30).alias("query"))
    return let(parts, _canonical)


def _canonical(p: Column) -> Column:
    host_of = F.lower(F.regexp_replace(p["authority"], r":\d*$", ""))
    port = F.regexp_extract(p["authority"], r":(\d+)$", 1)
    default = F.when(p["scheme"] == "http", "80").otherwise("443")
    name = lambda q: F.regexp_extract(q, r"^([^=]*)", 1)
    kept = F.array_join(F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~name(q).isin(*TRACKING) & ~name(q).startswith("utm_")), "&")
    path = F.when(p["path"] == "", "/").otherwise(let(_without_dots(p["path"]), lambda x: _escaped(x, '"<>`{}')))
    query = let(kept, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), _escaped(q, "\"<>'"))))
    fine = p["some"] & p["scheme"].isin("http", "https") & ~p["authority"].contains("@") & (host_of != "") & ((port == "") | (port == default))
    return F.when(fine, F.concat(p["scheme"], F.lit("://"), host_of, path, query))


def source_root(url: Column) -> Column:
    """The address of the site that a page may belong to; null on hosts that many share."""
    return F.when(canonical_url(url).isNotNull() & ~host(url).isin(*SHARED_HOSTS), F.concat(scheme(url), F.lit("://"), host(url), F.lit("/")))


def bare_host(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def of_domain(name: Column, *domains: str) -> Column:
    bare, hit = bare_host(name), F.lit(False)
    for d in domains:
        hit = hit | (bare == d) | bare.endswith(f".{d}")
    return hit


def related_hosts(one: Column, other: Column) -> Column:
    """Is one host the other, or a part of it, www. aside?"""
    a, b = bare_host(one), bare_host(other)
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)))


def disallowed_host(name: Column) -> Column:
    """Hosts that can't be public: none, local names, and names without a dot that are no address."""
    h = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    local = (h == "localhost") | h.rlike(r"\.(localhost|local|internal)$")
    return (h == "") | local | (~h.contains(".") & ~h.contains(":"))


#: IPv4 networks that aren't public, as first address and prefix length.
PRIVATE_NETWORKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("100.64.0.0", 10), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("192.0.0.0", 24), ("192.0.2.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3))


def public_ipv4(address: Column) -> Column:
    """Whether an IPv4 address is public; null for what is no such address."""
    part = lambda k: F.try_element_at(F.split(F.trim(address), r"\."), F.lit(k)).cast("long")
    octets = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
    number = part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4)

    def private(number: Column) -> Column:
        inside = F.lit(False)
        for first, bits in PRIVATE_NETWORKS:
            a = sum(int(x) << 8 * (3 - k) for k, x in enumerate(first.split(".")))
            inside = inside | number.between(a, a + (1 << 32 - bits) - 1)
        return inside

    return F.when(F.trim(address).rlike(octets), ~let(number, private))


def recovery_disabled(name: Column, hosts: tuple[str, ...]) -> Column:
    """Is a host, www. aside, one of those whose pages aren't tried again?"""
    h = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return h.isin(*hosts) | bare_host(h).isin(*hosts) if hosts else F.lit(False)


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(_part(url, 2), "/"), lambda p: p != ""))


def status_id(url: Column) -> Column:
    """The number of a post from its address."""
    found = F.regexp_extract(url, r"(?i)/status/(\d+)", 1)
    return F.when(found != "", found)


def status_handle(url: Column) -> Column:
    """Who wrote a post, from its address: the step of the path before "status", on the network's own hosts."""
    steps = F.filter(F.split(_part(url, 2), "/"), lambda p: p != "")
    own = bare_host(host(url)).isin("x.com", "twitter.com")
    return F.when(own & (F.lower(F.get(steps, F.lit(1))) == "status"), F.get(steps, F.lit(0)))


def srcset(value: Column) -> Column:
    """The images of a srcset: url and width, null where it isn't given in pixels."""
    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: p[0] != "")
    wide = lambda p: F.regexp_extract(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit("")), r"(?i)^(\d+)w$", 1)
    return F.transform(parts, lambda p: F.struct(p[0].alias("url"), F.when(wide(p) != "", wide(p).cast("int")).alias("width")))


def slug_of_path(url: Column) -> Column:
    """The steps of an address's path as words."""
    return F.array_join(F.filter(F.split(_part(url, 2), "/"), lambda p: p != ""), " ")


def path_of(url: Column) -> Column:
    return _part(url, 2)


def resolved(base: Column, href: Column) -> Column:
    """The address that a page at ``base`` means by ``href``: whole, without a scheme, from the root, or from its folder.

    Null where either is null, where href is blank or where it names another scheme than http.
    """
    to, root = F.trim(href), F.regexp_extract(base, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise("/")
    own = F.regexp_extract(base, r"^([^#]*)", 1)

    def tidy(rest: Column) -> Column:
        """Dot steps taken, the query left alone."""
        return F.concat(let(F.regexp_extract(rest, r"^([^?#]*)", 1), _without_dots), F.regexp_extract(rest, r"^[^?#]*(.*)$", 1))

    split = lambda whole: F.concat(F.regexp_extract(whole, r"^([^:]+://[^/?#]*)", 1), let(F.regexp_extract(whole, r"^[^:]+://[^/?#]*(.*)$", 1), lambda r: F.when(r.startswith("/"), tidy(r)).otherwise(F.concat(F.lit("/"), r))))
    return F.when((root == "") | (to == ""), F.lit(None).cast("string")).otherwise(
        F.when(to.rlike(r"(?i)^https?://"), split(to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), split(F.concat(scheme(base), F.lit(":"), to)))
        .when(to.startswith("/"), F.concat(root, tidy(to)))
        .when(to.startswith("#") | to.startswith("?"), F.concat(F.when(to.startswith("?"), F.regexp_extract(own, r"^([^?]*)", 1)).otherwise(own), to))
        .otherwise(F.concat(root, tidy(F.concat(folder, to))))
    )
