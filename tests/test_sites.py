"""Options per site: one run over several sites equals one run a site."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import frontier, sites
from pagemill.options import CorpusOptions
from pagemill.plans import derived
from pagemill.plans.queries import SITE_RUN, graph_links, site_seeds


def run(spark, folder, chosen):
    table = sites.site_table(spark, chosen)
    found = frontier.breadth_first(site_seeds(spark, table), graph_links(spark, folder), sites=table)
    return sorted(tuple(r) for r in found.select("site", "url", "depth", "parent_url").collect())


def test_one_run_equals_a_run_a_site(spark, folder):
    together = run(spark, folder, SITE_RUN)
    apart = sorted(run(spark, folder, [SITE_RUN[0]]) + run(spark, folder, [SITE_RUN[1]]))
    assert together == apart
    by_site = {s: [r for r in together if r[0] == s] for s in ("docs", "evens")}
    assert max(r[2] for r in by_site["docs"]) <= 6
    assert not any(r[1].endswith("7") for r in by_site["docs"] if r[2] > 0)
    assert all(int(r[1].rsplit("/", 1)[1]) % 2 == 0 for r in by_site["evens"] if r[2] > 0)


def test_same_rules_as_one_setting(spark, folder):
    """A site without patterns and a depth limit reaches what the shared setting reaches."""
    plain = [("docs", derived.DOCS + "0", CorpusOptions(max_depth=3))]
    got = run(spark, folder, plain)
    seeds = spark.range(1).select(F.lit("docs").alias("site"), F.lit(derived.DOCS + "0").alias("url"))
    want = frontier.breadth_first(seeds, graph_links(spark, folder), CorpusOptions(max_depth=3), scoped=False)
    assert got == sorted(tuple(r) for r in want.select("site", "url", "depth", "parent_url").collect())


def test_site_reject_reason_order(spark):
    table = sites.site_table(spark, [("a", "https://a.example.com/", CorpusOptions(exclude=["x"], include=["y"]))])
    rules = table.select(F.struct(*[c for c in table.columns if c != "site"]).alias("rules"))
    urls = ["ftp://a.example.com/y", "https://a.example.com/x.png", "https://a.example.com/xy", "https://b.org/z",
            "https://other.org/y"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").crossJoin(rules)
    place = F.struct(F.lit("example.com").alias("domain"), F.lit("a").alias("subdomain"))
    got = [r[0] for r in df.select(sites.site_reject_reason(F.col("url"), place, place, F.col("rules"))).collect()]
    assert got == ["scheme", "extension", "exclude", "include", None]


def test_site_given_twice(spark):
    with pytest.raises(ValueError):
        sites.site_table(spark, [("a", "https://a/", CorpusOptions()), ("a", "https://b/", CorpusOptions())])
