"""The digest array and the judging of urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from coldmart.llm import url_filter
from coldmart.llm.url_filter import DigestArray

import numpy as np

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("bad.net", "", "block"),
]


def test_equal_digests_are_told_apart():
    index = DigestArray(np.frombuffer(DigestArray.dump(RULES, hashed=lambda k: len(k) % 2), np.uint8))
    keys = [(h + p).encode() for h, p, _ in RULES]
    places = index.find([*keys, b"org/x", b"net"], hashed=lambda k: len(k) % 2)
    assert sorted(places[: len(keys)]) == list(range(len(keys))) and list(places[-2:]) == [-1, -1]
    assert [index.verdict(p) for p in places[: len(keys)]] == [v for _, _, v in RULES]


def test_the_last_of_equal_rules_counts_and_no_rules_are_fine(spark):
    urls = spark.createDataFrame([(1, "http://a.org/x")], "page_id bigint, url string")
    twice = url_filter.judge(urls, [("org", "/", "allow"), ("org", "/", "block")]).first()
    assert (twice.rule, twice.verdict) == ("org/", "block")
    none = url_filter.judge(urls, [], default="block").first()
    assert (none.rule, none.verdict) == (None, "block")


def test_urls(spark):
    cases = {
        "http://WWW.Example.ORG/es/1?x#y": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/123": ("example.org", "/en/123", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://example.org?q=/es/": ("example.org", "", None, "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "ftp://x.com/DE/": ("x.com", "/DE/", None, "allow"),
        "http://bad.net": ("bad.net", "", "bad.net", "block"),
        "http://É.COM/fr/é#://org/": ("É.com", "/fr/é", "com/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "http://a://b.org/": ("a:", "//b.org/", None, "allow"),
        "http://a.org/" + "x" * 20000: ("a.org", "/" + "x" * 20000, "org/", "allow"),
        None: ("", "", None, "allow"),
    }
    rows = list(enumerate(cases)) + [(None, None)]
    urls = spark.createDataFrame(rows, "page_id bigint, url string").select(
        "*", F.lit("x").alias("id"), F.lit("y").alias("host"), F.lit("z").alias("rule")
    )
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(urls, RULES).collect()}
    assert got == {**dict(enumerate(cases.values())), None: ("", "", None, "allow")}
    assert url_filter.judge(urls.limit(0), RULES).count() == 0
