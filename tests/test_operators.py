"""Links, frontier, bookkeeping, merge and fetch log on small hand-made inputs."""

import random
import re
import time
from dataclasses import replace

from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from pagemill.functions import dom, gate, urls
from pagemill.functions.domains import load_rules
from pagemill.operators import frontier, links, merge, status
from pagemill.options import CorpusOptions
from pagemill.plans import derived
from pagemill.plans.convert import to_markdown
from pagemill.plans.corpus import build_corpus
from pagemill.session import Buckets, work_folder
from pagemill.sources import fetchlog, sinks
from pagemill.sources.html import TagEnds, TreeWriter, node_rows, shred

LINKS = "url string, links array<struct<url:string,domain:string,subdomain:string>>"


def walk(edges, root, cap=None):
    """Plain breadth-first search: url -> (depth, smallest parent)."""
    found, level, depth = {root: (0, None)}, [root], 0
    while level and (cap is None or depth < cap):
        depth += 1
        parents = {}
        for a in level:
            for b in edges.get(a, ()):
                if b not in found:
                    parents[b] = min(parents.get(b, a), a)
        found.update({b: (depth, p) for b, p in parents.items()})
        level = list(parents)
    return found


@pytest.mark.parametrize("cap", [None, 0, 2])
def test_frontier_against_plain_search(spark, cap):
    rng = random.Random(7)
    urls = [f"u{i}" for i in range(60)]
    edges = {u: sorted(rng.sample(urls, 2) + (["u0"] if i % 3 else [])) for i, u in enumerate(urls[:45])}
    # a long chain, so that levels get packed
    edges.update({f"c{i}": [f"c{i + 1}"] for i in range(12)})
    edges["u1"] = edges["u1"] + ["c0"]
    table = spark.createDataFrame(
        [(u, [(v, "d", "s") for v in vs]) for u, vs in edges.items()], LINKS
    )
    seeds = spark.createDataFrame([("a", "u0"), ("b", "u5"), ("none", "x")], "site string, url string")
    got = frontier.breadth_first(seeds, table, CorpusOptions(max_depth=cap), scoped=False).collect()
    want = {
        (site, u, d, p) for site, root in [("a", "u0"), ("b", "u5"), ("none", "x")]
        for u, (d, p) in walk(edges, root, cap).items()
    }
    assert len(got) == len(want)
    assert {(r.site, r.url, r.depth, r.parent_url) for r in got} == want


def test_frontier_respects_site_scope(spark):
    table = spark.createDataFrame(
        [("r", [("in", "h.com", "docs"), ("sub", "h.com", "blog"), ("out", "o.org", "docs")])], LINKS
    )
    seeds = spark.createDataFrame([("s", "r", "h.com", "docs")], "site string, url string, domain string, subdomain string")
    reach = lambda **kw: {
        r.url for r in frontier.breadth_first(seeds, table, CorpusOptions(**kw)).collect()
    }
    assert reach() == {"r", "in"}
    assert reach(stay_on_subdomain=False) == {"r", "in", "sub"}
    assert reach(include=("x",)) == {"r", "in", "sub", "out"}


def test_bucketed_tables_join_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    buckets = Buckets(spark)
    try:
        rows = spark.range(100).select(F.col("id").cast("string").alias("url"))
        a, b = (buckets.rows(buckets.write(rows, "url")) for _ in range(2))
        plan = a.join(b, "url", "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        fresh = rows.groupBy("url").count().join(b, "url", "left_anti")
        assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        buckets.close()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_page_per_url(spark):
    pages = spark.createDataFrame(
        [(3, "a", "x"), (1, "a", "y"), (2, "b", "z"), (4, "a", "w")], "page_id long, url string, html string"
    )
    assert sorted(links.one_page_per_url(pages).select("page_id", "url", "html").collect()) == [(1, "a", "y"), (2, "b", "z")]


def test_malformed_link_is_flagged_not_lost(spark):
    html = '<a href="/x">1</a><a href="http://[bad/x">2</a><a href="#top">3</a><a href="MAILTO:a@b">4</a><area href="/no">'
    pages = spark.createDataFrame([(1, "https://h.com/p", html)], "page_id long, url string, html string")
    rows = links.raw_links(pages).orderBy("place").collect()
    assert [r.target for r in rows] == ["https://h.com/x", None, "mailto://a@b"]
    kept = links.page_links(pages, CorpusOptions(bad_link_fails_page=False)).first().links
    assert kept == ["https://h.com/x"]
    assert links.page_links(pages, CorpusOptions()).first().links == []  # a failed page gives none


def test_links_stay_in_scope(spark):
    html = '<a href="/in">1</a><a href="http://other.org/x">2</a><a href="http://sub.h.com/y">3</a><a href="/in">4</a>'
    pages = spark.createDataFrame(
        [(1, "https://h.com/p", "https://h.com", html)], "page_id long, url string, root_url string, html string")
    rules = load_rules(spark.sql(derived.SUFFIXES))
    def of(**options):
        return links.page_links(pages, CorpusOptions(**options), rules=rules).first().links
    assert of() == ["https://h.com/in"]
    assert of(stay_on_subdomain=False) == ["https://h.com/in", "http://sub.h.com/y"]
    assert of(include=[r"/(?P<doc_id>[xy])$"]) == ["http://other.org/x", "http://sub.h.com/y"]
    rows = links.scoped_links(pages, CorpusOptions(), rules).orderBy("place").collect()
    assert [(r.place, r.link) for r in rows] == [(0, "https://h.com/in"), (3, "https://h.com/in")]


def test_options_take_lists():
    assert CorpusOptions(exclude=["/a"]) == CorpusOptions(exclude=("/a",))
    assert gate.java_pattern(r"(?P<doc_id>\d+)\(?P<x>") == r"(?diU)(?:(\d+)\(?P<x>)"
    with pytest.raises(TypeError):
        CorpusOptions(exclude="/a")


def test_hosts_are_judged_like_the_standard_library(spark):
    hosts = ["[1:2]", "[::1]", "[:::::]", "[1::2::3]", "[1:2:3:4:5:6:7:8]", "[1:2:3:4:5:6:7::]", "[1:2:3:4:5:6:7:8:9]",
             "[::1.2.3.4]", "[::1.2.3.256]", "[fe80::1%eth0]", "[v1.x]", "[1.2.3.4]", "[::]", "h.com", "h\u2100.com",
             "h\uff0fx", "[12345::]", "u@[::1]:80", "[::1", "1:2]"]
    def bad(h):
        try:
            urlsplit(f"http://{h}/")
        except ValueError:
            return True
        return False
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select(
        "h", urls.is_malformed(F.concat(F.lit("http://"), "h", F.lit("/"))).alias("bad")).collect()
    assert {r.h: r.bad for r in rows} == {h: bad(h) for h in hosts}


def test_markdown_keeps_the_text_of_bad_links(spark):
    html = "<article>x <a href='//[bad/y'>TEXT</a> z <img src='//[bad/i' alt='ALT'></article>"
    pages = spark.createDataFrame([(1, "https://h.com/p", html)], "page_id long, url string, html string")
    row = to_markdown(pages).first()
    assert row.markdown == "# Untitled\n\nx TEXT z ALT" and row.bad_link


def test_one_page_of_shared_ids(spark):
    rows = [(1, "a", "x"), (2, "a", "y"), (2, "b", "z"), (5, "c", "w"), (5, "c", "w"), (6, "d", "p"), (6, "d", "q"),
            (None, "e", "n"), (None, "e", "n"), (7, None, "m")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in links.one_page_per_url(pages).select("page_id", "url", "html").collect()]
    assert len(got) == 6 and {(1, "a", "x"), (2, "b", "z"), (5, "c", "w"), (None, "e", "n"), (7, None, "m")} <= set(got)


def test_long_chain_is_packed_seldom(spark, monkeypatch):
    monkeypatch.setattr(frontier, "MAX_BROADCAST_SEEN", 0)
    written = []
    write = Buckets.write
    monkeypatch.setattr(Buckets, "write", lambda self, df, *k, shuffle=True: written.append(shuffle) or write(self, df, *k, shuffle=shuffle))
    table = spark.createDataFrame(
        [(f"u{i}", [(f"u{i + 1}", "d", "s")]) for i in range(12)], LINKS)
    seeds = spark.createDataFrame([("s", "u0")], "site string, url string")
    got = frontier.breadth_first(seeds, table, scoped=False).collect()
    assert {(r.url, r.depth) for r in got} == {(f"u{i}", i) for i in range(13)}
    assert sum(written) <= 1 + 1 + 13


def test_node_rows_form_a_tree(spark, folder):
    nodes = node_rows(shred(derived.table(spark, folder, "pages"))).toPandas()
    for _, page in nodes.groupby("page_id"):
        page = page.sort_values("node_id").reset_index(drop=True)
        assert list(page.node_id) == list(range(len(page)))
        for n in page.itertuples():
            assert n.node_id <= n.end_id < len(page)
            if n.parent_id >= 0:
                assert page.end_id[n.parent_id] >= n.end_id


def test_deep_nesting_keeps_the_text(spark):
    html = "<article>" + "<span>" * 2000 + "deep" + "</span>" * 2000 + " after</article>"
    pages = spark.createDataFrame([(1, "https://h.com/p", html)], "page_id long, url string, html string")
    nodes = node_rows(shred(pages))
    assert nodes.agg(F.max("depth")).first()[0] > 2000
    assert [r.text for r in nodes.filter("kind = 'text'").orderBy("node_id").collect()] == ["deep", " after"]


def test_deep_elements_are_elements(spark):
    for levels in (300, 5000):
        inner = "<nav>NAV</nav><script>var a='SCRIPT'</script>keep<!-- no -->"
        html = "<div><article>" + "<div>" * levels + "a" + inner + "</div>" * levels + "TAIL</article></div>"
        pages = spark.createDataFrame([(1, "https://h.com/p", html)], "page_id long, url string, html string")
        if levels < 1000:  # rendering takes a step a level
            assert to_markdown(pages).first().markdown == "# Untitled\n\nakeep\n\nTAIL"
        kept = shred(pages).select("nodes", dom.kept_flags(F.col("nodes"), CorpusOptions().boilerplate).alias("k"))
        texts = [n.text for r in kept.collect() for n, k in zip(r.nodes, r.k) if k and n.kind == "text"]
        assert texts == ["a", "keep", "TAIL"]


@pytest.mark.parametrize("piece", ["<a b='x ", "<a ", "<!x ", "</a ", "<a<", "<", "<a b='x' ", "<a b=\"'", "<p", "'<a \""])
def test_broken_tags_are_read_in_linear_time(piece):
    begin = time.process_time()
    writer = TreeWriter()
    writer.page(piece * (1_000_000 // len(piece)))
    assert time.process_time() - begin < 4
    assert "".join(t for t in writer.text if t).replace("\n", "")[:3] == (piece * 3)[:3]


def test_tag_ends_equal_one_pattern():
    random.seed(11)
    plain = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
    for _ in range(3000):
        source = "".join(random.choice(["<a", "<b ", "'", '"', ">", "x", " ", "/", "=", "</a>"]) for _ in range(25))
        ends = TagEnds(source)
        for at in range(len(source)):
            if re.match("<[a-zA-Z]", source[at:]):
                found = plain.match(source, at)
                assert ends.after(at + 1) == (found.end() - 1 if found else -1), source


DOCS = [("h.com", "https://h.com/b", "B"), ("h.com", "https://h.com/a", "A")]
MERGED = """# Merged Documentation
**Total Pages:** 2

## Table of Contents
1. [https://h.com/a](#https---h-com-a)
2. [https://h.com/b](#https---h-com-b)


---

<a id="https---h-com-a"></a>

## Source: https://h.com/a

<!-- Source: https://h.com/a -->

A

---

<a id="https---h-com-b"></a>

## Source: https://h.com/b

<!-- Source: https://h.com/b -->

B

---

"""


def page_docs(spark, rows):
    return merge.page_docs(spark.createDataFrame(rows, "site string, url string, markdown string"))


def test_merged_bytes(spark):
    row, = merge.merged_documents(page_docs(spark, DOCS)).collect()
    assert (row.site, row.merged_filename, row.n_pages, row.part) == ("h.com", "h.com.md", 2, 0)
    assert row.content == MERGED
    assert merge.merged_documents(page_docs(spark, DOCS), name="all.md").first().merged_filename == "all.md"


def test_parts_of_a_large_site_add_up(spark):
    rows = [(s, f"https://{s}/{i:03d}", f"text {i}") for s, n in (("big.com", 97), ("small.com", 3)) for i in range(n)]
    docs = page_docs(spark, rows)
    whole = {r.site: r.content for r in merge.merged_documents(docs).collect()}
    for shuffles in (1, 5):
        parts = merge.merged_documents(docs, pages_per_part=10, parts=shuffles).orderBy("site", "part").collect()
        joined = {}
        for r in parts:
            joined[r.site] = joined.get(r.site, "") + r.content
        assert joined == whole
        assert [r.part for r in parts if r.site == "big.com"] == list(range(20))


def test_sinks(spark):
    docs = page_docs(spark, DOCS)
    clash = docs.withColumn("filename", F.lit("same.md"))
    path = work_folder(spark, "sink-test")
    sinks.write_pages(clash, path)
    assert [r.url for r in spark.read.parquet(path).collect()] == ["https://h.com/b"]
    folder = work_folder(spark, "text-test")
    sinks.write_merged_text(merge.segments(docs), folder, parts=3)
    files = spark.read.text(folder, wholetext=True).withColumn("f", F.input_file_name())
    assert "".join(r.value for r in files.orderBy("f").collect()) == MERGED


ATTEMPTS = "url string, attempt int, status int, content_type string, error string, html string"


def test_fetch_log_rules(spark):
    html, rows = "text/html", []

    def log(url, *tries):
        rows.extend((url, i, s, c, e, f"{url}{i}") for i, (s, c, e) in enumerate(tries))

    log("ok", (200, "TEXT/HTML; x", None))
    log("none_type", (200, None, None))
    log("json_500", (500, "application/json", None), (200, html, None))
    log("gone", (410, html, None), (200, html, None))
    log("late", (503, html, None), (None, None, "timeout"), (200, html, None))
    log("used_up", (500, html, None), (500, html, None), (500, html, None), (200, html, None))
    log("client", (None, None, "client"), (None, None, "client"), (None, None, "client"))
    log("odd", (None, None, "other"), (200, html, None))
    log("redirect", (301, html, None), (200, html, None))
    table = spark.createDataFrame(rows, ATTEMPTS)
    got = {r.url: (r.outcome, r.attempt, r.html) for r in fetchlog.resolve_attempts(table).collect()}
    assert got == {
        "ok": ("ok", 0, "ok0"), "none_type": ("none", 0, None), "json_500": ("none", 0, None),
        "gone": ("none", 0, None), "late": ("ok", 2, "late2"), "used_up": ("none", None, None),
        "client": ("none", None, None), "odd": ("none", 0, None), "redirect": ("none", 0, None),
    }
    waits = {r.url: r.waited for r in fetchlog.backoff_seconds(table).collect()}
    assert waits == {
        "ok": 0, "none_type": 0, "json_500": 0, "gone": 0, "late": 3, "used_up": 7, "client": 3, "odd": 0, "redirect": 0,
    }
    browser = {r.url: r.outcome for r in fetchlog.resolve_attempts(table, mode="browser").collect()}
    assert browser["gone"] == "ok" and browser["json_500"] == "ok" and browser["client"] == "none"


STATUS = "site string, url string, depth int, parent_url string, status string, title string, links_found int"


def test_tree_report(spark):
    rows = [("s", "r", 0, None, "success", "", 3)]
    rows += [("s", f"/r/{i}", 1, "r", "success", f"T{i}" * 30, 1) for i in range(7)]
    rows += [("s", f"/r/0/{i}", 2, "/r/0", "failed", None, 0) for i in range(6)]
    rows += [("s", f"/r/0/0/{i}", 3, "/r/0/0", "success", None, 0) for i in range(3)]
    rows += [("s", f"/r/0/0/0/{i}", 4, "/r/0/0/0", "success", None, 0) for i in range(2)]
    rows += [("s", "/r/0/0/0/0/x", 5, "/r/0/0/0/0", "success", None, 0)]
    tree = status.crawl_tree(spark.createDataFrame(rows, STATUS)).orderBy("place").collect()
    assert [(r.place, r.level, r.url, r.more_children) for r in tree] == [
        (0, 0, "r", 2), (1, 1, "/r/0", 1), (2, 2, "/r/0/0", 0), (3, 3, "/r/0/0/0", 0), (4, 4, "/r/0/0/0/0", 0),
        (5, 4, "/r/0/0/0/1", 0), (6, 3, "/r/0/0/1", 0), (7, 3, "/r/0/0/2", 0), (8, 2, "/r/0/1", 0), (9, 2, "/r/0/2", 0),
        (10, 2, "/r/0/3", 0), (11, 2, "/r/0/4", 0), (12, 1, "/r/1", 0), (13, 1, "/r/2", 0), (14, 1, "/r/3", 0), (15, 1, "/r/4", 0),
    ]
    assert tree[1].label == ("T0" * 30)[:40] and tree[2].label == "/r/0/0"


def small_site():
    page = lambda *hrefs: "<article>" + "".join(f"<a href='{h}'>l</a>" for h in hrefs) + "text</article>"
    return [
        (0, "https://h.com", page("/a", "/b", "/", "https://o.org/x", "/pic.png")),
        (1, "https://h.com/A/", page("c", "http://[bad/x")),
        (2, "https://h.com/b", page("/b", "/d")),
        (3, "https://h.com/d", "<title>D</title>plain"),
        (4, "https://o.org/x", page("/y")),
    ]


def corpus(spark, **options):
    pages = spark.createDataFrame(small_site(), "page_id long, url string, html string")
    roots = spark.createDataFrame([("h", "H.com/"), ("o", "https://o.org/x")], "site string, root_url string")
    return build_corpus(pages, roots, spark.sql(derived.SUFFIXES), CorpusOptions(**options))


def states(result):
    return {(r.site, r.url): (r.depth, r.status, r.links_found) for r in result.page_status.collect()}


def test_whole_run(spark):
    result = corpus(spark)
    assert states(result) == {
        ("h", "https://h.com"): (0, "success", 3), ("h", "https://h.com/a"): (1, "failed", 0),
        ("h", "https://h.com/b"): (1, "success", 2), ("h", "https://h.com/"): (1, "skipped", 0),
        ("h", "https://h.com/d"): (2, "success", 0),
        ("o", "https://o.org/x"): (0, "success", 1), ("o", "https://o.org/y"): (1, "skipped", 0),
    }
    stats = {r.site: r for r in result.stats.collect()}
    assert (stats["h"].discovered, stats["h"].crawled, stats["h"].failed, stats["h"].skipped) == (5, 3, 1, 1)
    assert stats["h"].remaining == 0 and stats["h"].links_found == 5 and stats["h"].max_depth == 2
    merged = {r.site: r for r in result.merged().collect()}
    assert merged["h"].n_pages == 3 and "<!-- Source: https://h.com/d -->\n\n# D\n\nplain" in merged["h"].content
    assert {r.site: r.saved for r in result.saved_count().collect()} == {"h": 3, "o": 1}
    for r in status.crawl_progress(result.stats).collect():
        assert r.ratio == 1.0


def test_run_options(spark):
    lenient = states(corpus(spark, bad_link_fails_page=False))
    assert lenient[("h", "https://h.com/a")] == (1, "success", 1)
    assert lenient[("h", "https://h.com/c")] == (2, "skipped", 0)
    assert len([k for k in states(corpus(spark, max_depth=0)) if k[0] == "h"]) == 1
    wide = states(corpus(spark, include=("/x", "/y"), exclude=("/q",)))
    assert wide[("h", "https://o.org/x")] == (1, "success", 1) and wide[("h", "https://o.org/y")][1] == "skipped"


def test_large_suffix_tables_are_joined(spark, monkeypatch):
    usual = states(corpus(spark))
    monkeypatch.setattr("pagemill.functions.domains.MAX_RULES_IN_PLAN", 2)
    assert states(corpus(spark)) == usual


def test_large_seen_sets_are_joined_by_bucket(spark, monkeypatch):
    usual = states(corpus(spark))
    monkeypatch.setattr("pagemill.operators.frontier.MAX_BROADCAST_SEEN", 0)
    assert states(corpus(spark)) == usual


def test_written_corpus(spark):
    path = work_folder(spark, "corpus-test")
    saved = corpus(spark).write(path).collect()
    assert sorted(map(tuple, saved)) == [("h", 3, "h.md"), ("o", 1, "o.md")]
    assert spark.read.parquet(f"{path}/pages").count() == 4
    assert spark.read.parquet(f"{path}/page_status").count() == 7
    assert spark.read.text(f"{path}/merged").filter("value like '## Source: %'").count() == 4


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    outcomes = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        outcomes.append(states(corpus(spark)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert outcomes[0] == outcomes[1]
