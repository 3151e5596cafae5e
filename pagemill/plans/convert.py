"""Stored pages to links and markdown in one narrow pass: scan, shred, project."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import dom, gate, markdown, urls
from pagemill.functions.domains import SuffixRules, domain_of_host, host_name
from pagemill.functions.text import let, prefix_title, tidy_markdown
from pagemill.options import CorpusOptions
from pagemill.sources.html import shred

NO_CONTENT = "*No content extracted*"


def page_markdown(options: CorpusOptions, nodes: str = "nodes", base: str = "url") -> Column:
    """struct(markdown, bad_link) of one page, from the columns of these names.

    The expression is large and built through many small calls to the JVM, so
    it is built once per application and reused.
    """
    return _page_markdown(SparkContext.getOrCreate().applicationId, options, nodes, base)


@lru_cache(maxsize=64)
def _page_markdown(application: str, options: CorpusOptions, nodes_name: str, base_name: str) -> Column:
    nodes, base = F.col(nodes_name), F.col(base_name)

    def converted(title, kept, root):
        body = tidy_markdown(markdown.render(nodes, kept, root, base, options.tag_rules))
        missing = F.concat(F.lit("# "), title, F.lit("\n\n" + NO_CONTENT))
        bad = F.exists(
            dom.subtree(nodes, root),
            lambda n: dom.at(kept, n["node_id"]) & markdown.is_bad_image(n),
        )
        return F.struct(
            F.when(root.isNull(), missing)
            .otherwise(let(body, lambda md: prefix_title(md, title)))
            .alias("markdown"),
            F.coalesce(bad, F.lit(False)).alias("bad_link"),
        )

    def selected(title, kept):
        root = dom.at(nodes, dom.content_node(nodes, kept, options.content))
        return let(root, lambda node: converted(title, kept, node))

    return let(
        dom.page_title(nodes),
        lambda title: let(
            dom.kept_flags(nodes, options.boilerplate), lambda kept: selected(title, kept)
        ),
    )


def anchors(nodes: Column) -> Column:
    """hrefs worth following, in document order, from the uncleaned page."""
    hrefs = F.transform(
        F.filter(nodes, lambda n: n["tag"] == "a"), lambda n: n["attrs"]["href"]
    )
    return F.filter(hrefs, lambda h: h.isNotNull() & gate.usable_href(h))


def link_urls(nodes: Column, base: Column, options: CorpusOptions) -> Column:
    """Distinct normalised link URLs that pass every rule but the site's scope."""
    urls_ = F.transform(
        anchors(nodes),
        lambda h: let(urls.resolve(base, h), urls.normalize_url),
    )
    return F.array_distinct(
        F.filter(urls_, lambda u: u.isNotNull() & gate.passes_site_free_rules(u, options))
    )


def has_bad_anchor(nodes: Column) -> Column:
    return F.exists(anchors(nodes), urls.is_malformed)


def to_markdown(
    pages: DataFrame,
    options: CorpusOptions | None = None,
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """Replace ``html`` by ``title``, ``markdown`` and ``bad_link``; works on streams as well.

    ``bad_link``: a link or image of the page leads to a malformed URL; its text is in the markdown without it.
    """
    options = options or CorpusOptions()
    shredded = shred(pages, html)
    others = [c for c in shredded.columns if c != "nodes"]
    done = shredded.select(
        *others,
        dom.page_title(F.col("nodes")).alias("title"),
        page_markdown(options, base=url).alias("done"),
        has_bad_anchor(F.col("nodes")).alias("bad_anchor"),
    )
    return done.select(
        *others, "title", "done.markdown", (F.col("bad_anchor") | F.col("done.bad_link")).alias("bad_link")
    )


def page_facts(
    pages: DataFrame, rules: SuffixRules | None, options: CorpusOptions | None = None
) -> DataFrame:
    """``(url, links, bad_link, markdown)`` per page, from ``(url, html)`` with url a page key.

    ``links`` is array<struct<url, domain, subdomain>>; without rules the domains stay NULL.
    """
    options = options or CorpusOptions()
    application = SparkContext.getOrCreate().applicationId
    return shred(pages.select("url", "html")).select(
        "url", _scoped_links(application, rules, options).alias("links"),
        has_bad_anchor(F.col("nodes")).alias("bad_anchor"), page_markdown(options).alias("done"),
    ).select(
        "url", "links", F.col("done.markdown").alias("markdown"),
        (F.col("bad_anchor") | F.col("done.bad_link")).alias("bad_link"),
    )


@lru_cache(maxsize=64)
def _scoped_links(application: str, rules: SuffixRules | None, options: CorpusOptions) -> Column:
    """Link URLs with their domains; most links stay on the page's own host."""
    if rules is None:
        unknown = F.lit(None).cast("string")
        return F.transform(
            link_urls(F.col("nodes"), F.col("url"), options),
            lambda u: F.struct(u.alias("url"), unknown.alias("domain"), unknown.alias("subdomain")),
        )

    def described(own):
        def link(u, host):
            domain = F.when(host == own["host"], own["of"]).otherwise(domain_of_host(host, rules))
            return let(domain, lambda d: F.struct(
                u.alias("url"), d["domain"].alias("domain"), d["subdomain"].alias("subdomain")
            ))

        return F.transform(
            link_urls(F.col("nodes"), F.col("url"), options),
            lambda u: let(host_name(u), lambda host: link(u, host)),
        )

    home = host_name(F.col("url"))
    own = let(home, lambda h: F.struct(h.alias("host"), domain_of_host(h, rules).alias("of")))
    return let(own, described)
