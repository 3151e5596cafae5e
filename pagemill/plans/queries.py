"""Every operator as a query over the stored tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagemill.functions import dom, gate, markdown, text, urls
from pagemill.functions.domains import domain_of_host, host_name, load_rules
from pagemill.operators import frontier, links, merge, sites, status
from pagemill.options import CorpusOptions
from pagemill.plans import derived
from pagemill.plans.convert import page_facts, to_markdown
from pagemill.plans.corpus import build_corpus
from pagemill.session import spread, stored, work_folder
from pagemill.sources import fetchlog, sinks
from pagemill.sources.html import node_rows, shred
from pagemill.streaming import arrivals, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DEFAULT = CorpusOptions()


def nodes() -> Column:
    return F.col("nodes")


def page_number() -> Column:
    return F.col("page_id").cast("string")


def query(make: Query) -> Query:
    """Register a query; integer columns leave as bigint, as the oracle has them."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = make(spark, folder)
        small = (T.IntegerType, T.ShortType, T.ByteType)
        return df.select(*[
            F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
            for f in df.schema
        ])

    QUERIES[make.__name__] = run
    return make


def stored_pages(spark, folder) -> DataFrame:
    return derived.table(spark, folder, "pages")


def spread_pages(spark, folder) -> DataFrame:
    """The pages, for queries that parse them."""
    return spread(stored_pages(spark, folder))


def host(url: str = "url") -> Column:
    return urls.netloc(urls.clean_url(F.col(url)))


def keyed_markdown(spark, folder) -> DataFrame:
    """(site, url, markdown) with one page per key, the usual input of the sinks."""
    keyed = spread_pages(spark, folder).select(
        "page_id", urls.normalize_url(F.col("url")).alias("url"), "html"
    )
    return to_markdown(links.one_page_per_url(keyed)).select(
        urls.netloc(F.col("url")).alias("site"), "url", "markdown"
    )


def graph_links(spark, folder) -> DataFrame:
    graph = derived.derive(spark, folder, derived.LINK_GRAPH)
    # One row per source page; a page's link list is bounded by the page.
    return graph.groupBy(F.col("src_url").alias("url")).agg(
        F.collect_set(F.struct(
            F.col("dst_url").alias("url"), F.lit("example.com").alias("domain"),
            F.lit("docs").alias("subdomain"),
        )).alias("links")
    )


def graph_seed(spark) -> DataFrame:
    return spark.range(1).select(F.lit("docs").alias("site"), F.lit(derived.DOCS + "0").alias("url"))


# ---- sources and sinks -------------------------------------------------------

@query
def scan_pages(spark, folder):
    return stored_pages(spark, folder).filter("html is not null").select(
        "page_id", "url", F.length("html").alias("n_chars")
    )


@query
def seed_roots(spark, folder):
    bare = F.regexp_replace(F.concat("url", F.lit("//")), "^https://", "")
    return stored_pages(spark, folder).select(
        "page_id", bare.alias("given"), urls.seed_url(bare).alias("url"),
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"),
    )


@query
def resolve_fetch_log(spark, folder):
    log = derived.derive(spark, folder, derived.FETCH_ATTEMPTS)
    return fetchlog.resolve_attempts(log).select(
        "url", "outcome", "attempt", F.length("html").alias("n_chars")
    )


@query
def resolve_fetch_log_browser(spark, folder):
    log = derived.derive(spark, folder, derived.FETCH_ATTEMPTS)
    return fetchlog.resolve_attempts(log, mode="browser").select(
        "url", "outcome", "attempt", F.length("html").alias("n_chars")
    )


@query
def retry_backoff(spark, folder):
    return fetchlog.backoff_seconds(derived.derive(spark, folder, derived.FETCH_ATTEMPTS))


@query
def page_document(spark, folder):
    return merge.page_docs(keyed_markdown(spark, folder)).select("url", "content")


@query
def url_filename(spark, folder):
    return stored_pages(spark, folder).select("url", urls.page_filename(F.col("url")).alias("filename"))


@query
def page_sink(spark, folder):
    path = work_folder(spark, "pages")
    sinks.write_pages(stored(merge.page_docs(keyed_markdown(spark, folder))), path)
    return spark.read.parquet(path).select("site", "filename", "url", F.md5("content").alias("digest"))


def page_keys(spark, folder) -> DataFrame:
    return stored_pages(spark, folder).select(urls.normalize_url(F.col("url")).alias("url")).distinct().select(
        urls.netloc(F.col("url")).alias("site"), "url"
    )


@query
def toc(spark, folder):
    return merge.toc(merge.numbered(page_keys(spark, folder))).select("site", "place", "line")


@query
def merged_corpus(spark, folder):
    return merge.merged_documents(stored(merge.page_docs(keyed_markdown(spark, folder))))


@query
def merged_filename(spark, folder):
    return stored_pages(spark, folder).select("url", urls.merged_filename(F.col("url")).alias("filename"))


@query
def saved_files(spark, folder):
    return page_keys(spark, folder).select("site", "url", urls.page_filename(F.col("url")).alias("filename"))


# ---- URLs and gate ------------------------------------------------------------

@query
def url_parts(spark, folder):
    return stored_pages(spark, folder).select("url", urls.url_parts(F.col("url")).alias("p")).select("url", "p.*")


@query
def normalize_url(spark, folder):
    return stored_pages(spark, folder).select("url", urls.normalize_url(F.col("url")).alias("key"))


@query
def resolve_href(spark, folder):
    return derived.derive(spark, folder, derived.REFERENCES).select(
        "page_id", "variant", urls.resolve(F.col("base"), F.col("href")).alias("target")
    )


def other_hosts(spark, folder) -> DataFrame:
    """Hosts of the pages under several kinds of suffix."""
    h = host()
    return stored_pages(spark, folder).select("page_id", F.explode(F.array(
        h, F.replace(h, F.lit(".com"), F.lit(".co.uk")), F.replace(h, F.lit(".net"), F.lit(".site.ck")),
        F.replace(h, F.lit("example.org"), F.lit("www.ck")), F.concat(h, F.lit(".unknown")),
        F.concat(F.lit("10.0.0."), F.col("page_id") % 250),
    )).alias("host")).select("host").distinct()


@query
def registered_domain(spark, folder):
    rules = load_rules(spark.sql(derived.SUFFIXES))
    return other_hosts(spark, folder).select("host", domain_of_host(F.col("host"), rules).alias("d")).select(
        "host", "d.*"
    )


@query
def domain_scope(spark, folder):
    """Each page's URL against the host of another page as root."""
    rules = load_rules(spark.sql(derived.SUFFIXES))
    pages = stored_pages(spark, folder).select("page_id", "url")
    of = lambda url: domain_of_host(host_name(F.col(url)), rules)
    roots = pages.select(F.col("page_id").alias("root_id"), of("url").alias("root"))
    count = pages.agg(F.count("*").alias("n"))
    pairs = pages.crossJoin(F.broadcast(count)).select(
        "page_id", of("url").alias("link"), ((F.col("page_id") * 7 + 3) % F.col("n")).alias("root_id")
    )
    return pairs.join(roots, "root_id").select(
        "page_id",
        gate.in_scope(F.col("link"), F.col("root"), True).alias("same_subdomain"),
        gate.in_scope(F.col("link"), F.col("root"), False).alias("same_domain"),
    )


def gate_urls(spark, folder) -> DataFrame:
    return derived.derive(spark, folder, derived.GATE_URLS)


@query
def extension_filter(spark, folder):
    return gate_urls(spark, folder).filter(
        ~gate.has_excluded_extension(F.col("url"), DEFAULT.exclude_extensions)
    ).select("page_id", "variant", "url")


@query
def exclude_filter(spark, folder):
    return gate_urls(spark, folder).filter(
        ~gate.found_any(F.col("url"), ["/api/v1/", r"\?.*page="])
    ).select("page_id", "variant", "url")


@query
def include_filter(spark, folder):
    return gate_urls(spark, folder).filter(
        gate.found_any(F.col("url"), ["/api/", "/(en|de)/[0-9]*5"])
    ).select("page_id", "variant", "url")


@query
def should_crawl(spark, folder):
    rules = load_rules(spark.sql(derived.SUFFIXES))
    of = lambda col: domain_of_host(host_name(col), rules)
    scoped = gate_urls(spark, folder).select(
        "page_id", "variant", "url", of(F.col("url")).alias("link"),
        of(F.concat(F.lit("https://"), "site")).alias("root"),
    )
    url, strict = F.col("url"), gate.in_scope(F.col("link"), F.col("root"), True)
    loose = gate.in_scope(F.col("link"), F.col("root"), False)
    excluding = replace(DEFAULT, exclude=("/api/v1/",))
    including = replace(excluding, include=("/api/",))
    return scoped.select(
        "page_id", "variant",
        gate.reject_reason(url, strict, DEFAULT).alias("plain"),
        gate.reject_reason(url, loose, excluding).alias("excluding"),
        gate.reject_reason(url, strict, including).alias("including"),
        gate.should_crawl(url, strict, DEFAULT).alias("kept"),
    )


@query
def safe_anchor(spark, folder):
    return stored_pages(spark, folder).select("url", urls.anchor(F.col("url")).alias("anchor"))


@query
def url_label(spark, folder):
    return stored_pages(spark, folder).select(
        "url", urls.url_label(F.col("url")).alias("label"), urls.url_label(F.col("url"), 6).alias("short")
    )


# ---- links and frontier ---------------------------------------------------------

def outward_pages(spark, folder) -> DataFrame:
    pages = spread(derived.derive(spark, folder, derived.OUTWARD_PAGES))
    return pages.withColumn("url", urls.normalize_url(F.col("url")))


def scope_rules(spark):
    return load_rules(spark.sql(derived.SUFFIXES))


@query
def extract_links(spark, folder):
    found = links.scoped_links(outward_pages(spark, folder), DEFAULT, scope_rules(spark))
    return found.select("page_id", "place", "link")


@query
def distinct_links(spark, folder):
    found = links.page_links(outward_pages(spark, folder), DEFAULT, rules=scope_rules(spark))
    return found.select("page_id", F.explode("links").alias("link"))


@query
def links_found(spark, folder):
    found = links.page_links(outward_pages(spark, folder), DEFAULT, rules=scope_rules(spark))
    return found.select("page_id", F.size("links").alias("links_found"))


@query
def unseen_links(spark, folder):
    """Link targets that are not yet seen; every second number was."""
    found = links.page_links(derived.derive(spark, folder, derived.GRAPH_PAGES), DEFAULT)
    candidates = found.select(
        F.lit("docs").alias("site"), F.col("url").alias("parent_url"), F.explode("links").alias("url")
    )
    seen = stored_pages(spark, folder).select(
        F.lit("docs").alias("site"), F.concat(F.lit(derived.DOCS), F.col("page_id") * 2).alias("url")
    )
    return links.unseen(candidates, seen)


@query
def bfs_frontier(spark, folder):
    return frontier.breadth_first(graph_seed(spark), graph_links(spark, folder), scoped=False)


# Two sites in one run, each with its own depth, patterns and merged name.
SITE_RUN = (
    ("docs", derived.DOCS + "0", CorpusOptions(max_depth=6, exclude=[r"/p/\d*7$"], merged_name="all-docs.md")),
    ("evens", derived.DOCS + "1", CorpusOptions(include=[r"/p/\d*[02468]$"], stay_on_subdomain=False)),
)


def site_seeds(spark, table: DataFrame) -> DataFrame:
    place = domain_of_host(host_name(F.col("root")), scope_rules(spark))
    return table.select("site", F.col("root").alias("url"), place["domain"].alias("domain"),
                        place["subdomain"].alias("subdomain"))


@query
def site_frontier(spark, folder):
    table = sites.site_table(spark, SITE_RUN)
    reached = frontier.breadth_first(site_seeds(spark, table), graph_links(spark, folder), sites=table)
    named = table.select("site", F.coalesce("merged_name", urls.merged_filename("root")).alias("merged_filename"))
    return reached.join(named, "site").select("site", "url", "depth", "parent_url", "merged_filename")


@query
def bfs_depth_cap(spark, folder):
    return frontier.breadth_first(
        graph_seed(spark), graph_links(spark, folder), replace(DEFAULT, max_depth=3), scoped=False
    )


# ---- bookkeeping -----------------------------------------------------------------

@query
def page_status(spark, folder):
    reach = frontier.breadth_first(graph_seed(spark), graph_links(spark, folder), scoped=False)
    pages = derived.derive(spark, folder, derived.GRAPH_PAGES).withColumn(
        "html", F.when(F.col("page_id") % 5 != 3, F.col("html"))  # the others were not fetched
    )
    outcomes = page_facts(pages.filter("html is not null"), None).withColumn("n_links", F.size("links"))
    return status.page_status(reach, outcomes.drop("links"))


@query
def crawl_stats(spark, folder):
    return status.crawl_stats(derived.derive(spark, folder, derived.CRAWL_STATUS))


@query
def crawl_progress(spark, folder):
    return status.crawl_progress(
        status.crawl_stats(derived.derive(spark, folder, derived.CRAWL_STATUS))
    )


@query
def crawl_tree(spark, folder):
    return status.crawl_tree(derived.derive(spark, folder, derived.TREE_STATUS))


@query
def recent_activity(spark, folder):
    return status.recent_activity(derived.derive(spark, folder, derived.CRAWL_STATUS))


# ---- page tree ---------------------------------------------------------------------

@query
def dom_nodes(spark, folder):
    return node_rows(shred(spread_pages(spark, folder))).filter("kind = 'element'").groupBy(
        "page_id", "tag"
    ).agg(F.count("*").alias("n"))


@query
def boilerplate_nodes(spark, folder):
    hits = lambda n: dom.matches_any(n, DEFAULT.boilerplate)
    return shred(spread(derived.derive(spark, folder, derived.BOILERPLATE_PAGES)).drop("tag")).select(
        "page_id", F.explode(F.filter(nodes(), hits)).alias("n")
    ).groupBy("page_id", F.col("n.tag").alias("tag")).agg(F.count("*").alias("n"))


@query
def clean_nodes(spark, folder):
    def kept_text(kept):
        return F.filter(nodes(), lambda n: (n["kind"] == "text") & dom.at(kept, n["node_id"]))

    kept = text.let(dom.kept_flags(nodes(), DEFAULT.boilerplate), kept_text)
    counted = text.let(kept, lambda kept: F.struct(
        F.size(kept).alias("n_texts"),
        F.aggregate(kept, F.lit(0), lambda n, x: n + F.length(x["text"])).alias("n_chars"),
    ))
    return shred(spread_pages(spark, folder)).select("page_id", counted.alias("c")).select("page_id", "c.*")


@query
def page_title(spark, folder):
    return shred(spread_pages(spark, folder)).select("page_id", dom.page_title(nodes()).alias("title"))


@query
def main_content(spark, folder):
    def chosen(kept):
        return text.let(
            dom.at(nodes(), dom.content_node(nodes(), kept, DEFAULT.content)),
            lambda n: F.struct(
                n["tag"].alias("tag"), F.md5(dom.text_pieces(nodes(), n)).alias("digest")
            ),
        )

    pick = text.let(dom.kept_flags(nodes(), DEFAULT.boilerplate), chosen)
    return shred(spread(derived.derive(spark, folder, derived.CONTENT_PAGES)).drop("tag")).select("page_id", pick.alias("c")).select("page_id", "c.*")


@query
def empty_pages(spark, folder):
    """Every third page has its whole body inside a form, so nothing is left."""
    pages = spread_pages(spark, folder).withColumn(
        "html",
        F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<body>"), F.lit("<body><form>")))
        .otherwise(F.col("html")),
    )
    return to_markdown(pages).select("page_id", "markdown")


# ---- markdown -------------------------------------------------------------------------

@query
def render_markdown(spark, folder):
    def rendered(kept):
        root = dom.at(nodes(), dom.content_node(nodes(), kept, DEFAULT.content))
        return text.let(root, lambda r: markdown.render(nodes(), kept, r, F.col("url")))

    raw = text.let(dom.kept_flags(nodes(), DEFAULT.boilerplate), rendered)
    return shred(spread_pages(spark, folder)).select("page_id", raw.alias("markdown"))


def with_fragment(spark, folder, *pieces) -> DataFrame:
    """Pages with an HTML fragment set behind the first heading, rendered."""
    extra = F.concat(F.lit("</h1>"), *[F.lit(p) if isinstance(p, str) else p for p in pieces])
    pages = spread_pages(spark, folder).withColumn("html", F.replace("html", F.lit("</h1>"), extra))
    return to_markdown(pages).select("page_id", "markdown")


@query
def md_links(spark, folder):
    return with_fragment(
        spark, folder, '<p>see <a href="/up/', page_number(), '" title="T"> Link <b>', page_number(), '</b> </a>, <a href="q/', page_number(),
        '">here</a>, <a href="#s">top</a>, <a href="mailto:a@b.c">mail</a>, <a href="">none</a> and <a>bare</a></p>',
    )


@query
def md_images(spark, folder):
    return with_fragment(
        spark, folder, '<p>x <img src="i/', page_number(), '.png" alt="A ', page_number(),
        '"> y <img alt="lost"> z <img src="data:x" title="t"></p>',
    )


@query
def md_code(spark, folder):
    return with_fragment(
        spark, folder, '<pre class="language-py hl">a_', page_number(), ' = 1\nb = *a\n\n\n\n# c</pre><p>use <code>x_',
        page_number(), '</code> now</p>',
    )


@query
def md_lists(spark, folder):
    return with_fragment(
        spark, folder, '<ul>\n<li>one ', page_number(), '</li>\n<li>two<ol start="3"><li>a</li><li>b<ul><li>deep</li></ul></li></ol></li>\n<li></li></ul>',
        '<blockquote><p>quoted ', page_number(), '</p><p>twice</p></blockquote>',
    )


@query
def md_tables(spark, folder):
    return with_fragment(
        spark, folder, '<table><thead><tr><th>k</th><th>v</th></tr></thead><tbody><tr><td>page</td><td>',
        page_number(), '</td></tr><tr><td></td><td>1</td></tr></tbody></table>',
        '<table><tr><td colspan="2">wide</td></tr><tr><td>l</td><td>r</td></tr></table>',
    )


@query
def tidy_markdown(spark, folder):
    messy = spread(derived.derive(spark, folder, derived.MESSY_DOCUMENTS))
    return messy.select("doc_id", text.tidy_markdown(F.col("md")).alias("markdown"))


@query
def title_prefix(spark, folder):
    docs = derived.table(spark, folder, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("#"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", text.prefix_title(body, F.col("source")).alias("markdown"))


@query
def reported_title(spark, folder):
    messy = derived.derive(spark, folder, derived.MESSY_DOCUMENTS)
    return messy.select("doc_id", text.reported_title(F.col("md")).alias("title"))


@query
def pages_to_markdown(spark, folder):
    return to_markdown(spread_pages(spark, folder))


# ---- whole run and streams ------------------------------------------------------------

def graph_corpus(spark, folder):
    roots = spark.range(1).select(
        F.lit("docs.example.com").alias("site"), F.lit("docs.example.com/p/0/").alias("root_url")
    )
    pages = derived.derive(spark, folder, derived.GRAPH_PAGES)
    return build_corpus(pages, roots, spark.sql(derived.SUFFIXES))


@query
def build_corpus_status(spark, folder):
    return graph_corpus(spark, folder).page_status


@query
def build_corpus_stats(spark, folder):
    return graph_corpus(spark, folder).stats


def build_corpus_merged(spark, folder):
    """One crawl per host of the stored pages, merged."""
    roots = derived.derive(spark, folder, derived.ROOTS)
    return build_corpus(stored_pages(spark, folder), roots, spark.sql(derived.SUFFIXES)).merged()


build_corpus_merged.__name__ = "build_corpus"
query(build_corpus_merged)


@query
def stream_markdown(spark, folder):
    pages = runs.file_stream(spark, folder, "pages").repartition(spark.sparkContext.defaultParallelism)
    stream = arrivals.markdown_stream(pages)
    return runs.drained(stream, "stream-markdown")


@query
def stream_unseen(spark, folder):
    pages = runs.file_stream(spark, folder, "pages").withColumn("site", host()).withColumn(
        "fetched_at", F.timestamp_seconds(F.col("page_id") + 1_700_000_000)
    )
    fresh = arrivals.unseen_links(pages, fetched_at="fetched_at", horizon="3650 days")
    return runs.drained(fresh, "stream-unseen").select("site", "url")


@query
def stream_stats(spark, folder):
    events = runs.file_stream(spark, folder, "events")
    stream = arrivals.live_counters(
        spark.sql(derived.STATUS_EVENTS, events=events)
    )
    return runs.drained_updates(stream, ["site", "status"], "stream-stats")
