"""Addresses, names and texts in small."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://A.org/a/../b/./c#x", "https://a.org/b/c"),
        ("a.org", "https://a.org/"),
        ("http://a.org:80/a/..", "http://a.org/"),
        ("https://a.org/x/../../y/.", "https://a.org/y/"),
        ("https://a.org/a b/ü?q=a b&utm_source=x&r='1'&gclid=3", "https://a.org/a%20b/%C3%BC?q=a%20b&r=%271%27"),
        ("https://a.org/%2e%2e/b%20c", "https://a.org/b%20c"),
        ("https://a.org/...", "https://a.org/..."),
        ("https://a.org:8443/", None),
        ("https://u@a.org/", None),
        ("ftp://a.org/", None),
        ("  ", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.canonical_url(F.col("u"))).first()[0] == want


def test_hosts_and_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(U.disallowed_host(F.lit(h))) for h in ("localhost", "a.local", "intranet", "", "a.org", "::1")] == [True, True, True, True, False, False]
    assert [one(U.related_hosts(F.lit(a), F.lit("www.a.org"))) for a in ("b.a.org", "a.org", "ba.org", "")] == [True, True, False, False]
    assert one(X.comparable(F.lit("Ｆｕｌｌ Ünïcode — ①ﬃ x\u0301"))) == "fullunicode1x"
    assert [one(X.username(F.lit(n))) for n in ("ab", "abc_1", "Abc", "a" * 33)] == [None, "abc_1", None, None]
    assert one(X.topic_slugs(F.array(*(F.lit(f"t{k}") for k in range(17))))) is None
