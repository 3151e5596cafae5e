"""URL functions against golden cases and the standard library."""

import hashlib
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pagemill.functions import gate, urls
from pagemill.functions.domains import domain_of_host, domains_by_join, host_name, load_rules
from pagemill.options import CorpusOptions
from pagemill.plans import derived


def column(spark, make, *rows):
    """Results of an expression over columns a, b, .. of the given rows."""
    names = "abcd"[: len(rows[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    out = df.select("i", make(*[F.col(n) for n in names]).alias("x")).orderBy("i").collect()
    return [r.x for r in out]


NORMAL = [
    ("https://H.com", "https://h.com"),
    ("https://h.com/", "https://h.com/"),
    ("https://h.com/Docs/#top", "https://h.com/docs"),
    ("https://h.com/a?b=2&a=1&a=1&", "https://h.com/a?&a=1&a=1&b=2"),
    ("https://h.com/a?B=1&a=2", "https://h.com/a?b=1&a=2"),
    ("https://h.com:443/x;v=1?q#f", "https://h.com:443/x?q"),
    ("https://h.com/a//", "https://h.com/a/"),
    ("https://u:p@h.com/é/", "https://u:p@h.com/é"),
]


def test_normalize(spark):
    assert column(spark, urls.normalize_url, *[(a,) for a, _ in NORMAL]) == [b for _, b in NORMAL]


def test_normalize_is_not_idempotent(spark):
    once, = column(spark, urls.normalize_url, ("https://h.com/a//",))
    twice, = column(spark, urls.normalize_url, (once,))
    assert once == "https://h.com/a/" and twice == "https://h.com/a"


RFC_BASE = "http://a/b/c/d;p?q"
RFC = (
    "g ./g g/ /g //g ?y g?y #s g#s g?y#s ;x g;x g;x?y#s . ./ .. ../ ../g ../.. ../../ ../../g "
    "../../../g ../../../../g /./g /../g g. .g g.. ..g ./../g ./g/. g/./h g/../h g;x=1/./y g;x=1/../y "
    "g?y/./x g?y/../x g#s/./x http:g g:h ftp://x/y mailto:a@b https://o/p"
).split()
MORE = [
    ("https://h.com/docs", "a.html"), ("https://h.com/a/b", "../../../c"), ("https://h.com/a", "//o.com/z"),
    ("https://h.com/x?q=1", "?p=2"), ("https://h.com", "a"), ("https://h.com", "../x"), ("https://h.com/a/", "b//c/"),
    ("https://h.com/a", "//o.com"), ("https://h.com/a//b/c", "d"), ("https://h.com/a", " b "), ("https://h.com/a", "b\nc"),
    ("https://h.com/a/b", "c/../.."), ("https://h.com/a/b", "./.."), ("https://h.com/p;x", "#f"), ("https://h.com/a", "b c|d"),
]


def test_resolve_like_the_standard(spark):
    cases = [(RFC_BASE, ref) for ref in RFC] + MORE
    assert column(spark, urls.resolve, *cases) == [urljoin(b, r) for b, r in cases]


def test_malformed_reference_is_null(spark):
    bad = [("https://h.com", "http://[bad/x"), ("https://h.com", "//h]/x"), ("https://h.com", "http://[::1]/x")]
    assert column(spark, urls.resolve, *bad) == [None, None, "http://[::1]/x"]


piece = st.sampled_from(["a", "B", "..", ".", "", "é", "x;y", "c d"])
paths = st.lists(piece, max_size=5).map("/".join)
tails = st.sampled_from(["", "?", "?b=1&a", "#f", "?q#f"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(cases=st.lists(st.tuples(paths, paths, tails, st.sampled_from(["", "/", "//o.org/"])), min_size=30, max_size=60))
def test_random_urls_like_the_standard(spark, cases):
    pairs = [(f"https://H.com/{p}", f"{lead}{r}{t}") for p, r, t, lead in cases]
    # A reference without any part of its own keeps the base as it is.
    assert column(spark, urls.resolve, *pairs) == [urljoin(b, r) for b, r in pairs]
    whole = [(urljoin(b, r),) for b, r in pairs]
    split = column(spark, urls.url_parts, *whole)
    assert [tuple(s) for s in split] == [tuple(urlparse(w)) for w, in whole]


def test_names(spark):
    names = column(
        spark, urls.page_filename, ("https://h.com",), ("https://h.com/docs/a b.html",),
        ("https://h.com/docs/x?q=1",), ("https://h.com/é/ü",), ("https://h.com/" + "a" * 300,),
    )
    assert names[:4] == [
        "index_eddd03ce.md", "docs_a_b.html_f2c6f698.md", "docs_x_0f3b66de.md", "é_ü_737925d6.md",
    ]
    digest = hashlib.md5(("https://h.com/" + "a" * 300).encode()).hexdigest()[:8]
    assert names[4] == "a" * 200 + f"_{digest}.md"
    merged = column(
        spark, urls.merged_filename, ("https://docs.example.com/api",), ("https://h.com:8080",),
        ("https://user:pw@host/",), ("bare.org/x",),
    )
    assert merged == ["docs.example.com.md", "h.com.md", "user.md", "bare.org.md"]
    assert column(spark, urls.seed_url, ("H.com//",), ("http://h.com/A/",)) == ["https://h.com", "http://h.com/a"]
    assert column(spark, urls.anchor, ("https://h.com/é?a=1",)) == ["https---h-com-é-a-1"]
    assert column(spark, lambda u: urls.url_label(u, 10), ("https://h.com",), ("https://h.com/0123456789",)) == [
        "/", "...3456789",
    ]


HOSTS = [
    ("docs.example.com", "example.com", "docs"), ("example.com", "example.com", ""), ("com", "", ""),
    ("a.b.example.co.uk", "example.co.uk", "a.b"), ("co.uk", "", ""), ("x.uk", "x.uk", ""),
    ("a.b.ck", "a.b.ck", ""), ("z.a.b.ck", "a.b.ck", "z"), ("www.ck", "www.ck", ""), ("q.www.ck", "www.ck", "q"),
    ("b.ck", "", ""), ("localhost", "", ""), ("foo.bar.internal", "", "foo.bar"), ("10.0.0.1", "", ""),
]


def test_registered_domain_both_ways(spark):
    suffixes = spark.sql(derived.SUFFIXES)
    rules = load_rules(suffixes)
    found = column(spark, lambda h: domain_of_host(h, rules), *[(h,) for h, _, _ in HOSTS])
    assert [tuple(f) for f in found] == [(d, s) for _, d, s in HOSTS]
    hosts = spark.createDataFrame([(h,) for h, _, _ in HOSTS], ["host"])
    joined = domains_by_join(hosts, suffixes).collect()
    assert sorted(map(tuple, joined)) == sorted(HOSTS)
    assert column(spark, host_name, ("https://U:p@H.com:80/x",), ("https://[::1]:8/x",)) == ["h.com", "[::1]"]


GATE = [
    ("https://docs.h.com/a", (), (), None), ("https://blog.h.com/a", (), (), "domain"),
    ("https://other.org/api/x", ("/api/",), (), None), ("https://docs.h.com/a.PDF", (), (), "extension"),
    ("https://docs.h.com/a.pdf?x=1", (), (), None), ("https://docs.h.com/?f=a.pdf", (), (), "extension"),
    ("https://docs.h.com/api/v1/", ("/api/",), ("/api/v1/",), "exclude"), ("ftp://docs.h.com/a", ("docs",), (), "scheme"),
    ("https://docs.h.com/b", ("/API/",), (), "include"), ("https://docs.h.com/x1", ("(?P<n>x)[0-9]",), (), None),
]


@pytest.mark.parametrize("url,include,exclude,reason", GATE)
def test_gate(spark, url, include, exclude, reason):
    rules = load_rules(spark.sql(derived.SUFFIXES))
    options = CorpusOptions(include=include, exclude=exclude)

    def check(u):
        link, root = (domain_of_host(host_name(x), rules) for x in (u, F.lit("https://docs.h.com")))
        return gate.reject_reason(u, gate.in_scope(link, root, True), options)

    assert column(spark, check, (url,)) == [reason]


def test_named_back_reference_is_refused():
    with pytest.raises(ValueError):
        gate.java_pattern("(?P<n>a)(?P=n)")
