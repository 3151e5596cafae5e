"""The whole run: roots and stored pages to documents, merged text and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagemill.functions.domains import domains_by_join, host_name, load_rules, with_domains
from pagemill.functions.gate import in_scope
from pagemill.functions.urls import normalize_url, root_url, seed_url
from pagemill.operators import merge, status
from pagemill.operators.frontier import breadth_first
from pagemill.operators.links import one_page_per_url
from pagemill.options import CorpusOptions
from pagemill.plans.convert import page_facts
from pagemill.session import stored
from pagemill.sources import sinks


@dataclass(frozen=True)
class Corpus:
    """Result tables of a build; ``merged`` does its work when read."""

    page_status: DataFrame  # site, url, depth, parent_url, status, title, links_found, error
    page_docs: DataFrame  # site, url, filename, content
    links: DataFrame  # site, url, link
    stats: DataFrame  # one row of counters per site
    options: CorpusOptions

    def merged(self, parts: int | None = None) -> DataFrame:
        return merge.merged_documents(
            self.page_docs, self.options.pages_per_part, self.options.separator,
            self.options.merged_name, parts,
        )

    def segments(self, parts: int | None = None) -> DataFrame:
        return merge.segments(self.page_docs, self.options.separator, parts)

    def saved_count(self) -> DataFrame:
        return self.page_docs.groupBy("site").agg(F.count("*").alias("saved"))

    def saved_files(self) -> DataFrame:
        return self.page_docs.select("site", "url", "filename")

    def write(self, path: str, merge_pages: bool = True, parts: int | None = None) -> DataFrame:
        """Write ``pages``, ``page_status`` and ``stats`` tables and the ``merged`` text
        files below ``path``; returns ``(site, saved, merged_filename)``."""
        sinks.write_pages(self.page_docs, f"{path}/pages", parts)
        self.page_status.write.mode("overwrite").parquet(f"{path}/page_status")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        if merge_pages:
            sinks.write_merged_text(self.segments(parts), f"{path}/merged", parts)
        name = merge.merged_name(F.col("site"), self.options.merged_name)
        return self.saved_count().withColumn("merged_filename", name)


def seeds(roots: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``roots(site, root_url)`` -> ``(site, url, domain, subdomain)``."""
    keyed = roots.select(
        "site", seed_url(F.col("root_url")).alias("url"), root_url(F.col("root_url")).alias("given")
    )
    return with_domains(keyed, "given", suffixes).drop("given")


def build_corpus(
    pages: DataFrame,
    roots: DataFrame,
    suffixes: DataFrame,
    options: CorpusOptions | None = None,
) -> Corpus:
    """Crawl stored ``pages(page_id, url, html)`` from ``roots(site, root_url)``.

    Every page is parsed once; links and markdown land in one stored table. The
    frontier loop reads only its link column, the final join its text column.
    """
    options = options or CorpusOptions()
    rules = load_rules(suffixes)
    keyed = pages.select("page_id", normalize_url(F.col("url")).alias("url"), "html").filter(
        "html is not null"
    )
    facts = stored(page_facts(one_page_per_url(keyed).drop("page_id"), rules, options), "facts")
    if rules is None:
        facts = stored(_join_domains(facts, suffixes), "facts")

    usable = facts
    if options.bad_link_fails_page:
        usable = facts.filter("not bad_link")
    frontier = breadth_first(seeds(roots, suffixes), usable, options)

    scope = F.struct("domain", "subdomain")
    own_links = F.col("links") if options.include else F.filter(
        "links", lambda l: in_scope(l, scope, options.stay_on_subdomain)
    )
    links = F.transform(own_links, lambda l: l["url"])
    if options.bad_link_fails_page:
        links = F.when(~F.col("bad_link"), links)  # a failed page yields none
    reached = stored(
        frontier.join(facts, "url", "left").select(
            "site", "url", "depth", "parent_url", "markdown", "bad_link", links.alias("links")
        ),
        "reached",
    )
    outcomes = reached.filter("markdown is not null").select(
        "site", "url", "markdown", F.size("links").alias("n_links"), "bad_link"
    )
    states = status.outcome_columns(
        reached.withColumn("stored", F.col("markdown").isNotNull())
        .withColumn("n_links", F.size("links")),
        options.bad_link_fails_page,
    )
    good = outcomes.filter("not bad_link") if options.bad_link_fails_page else outcomes
    return Corpus(
        page_status=states,
        page_docs=merge.page_docs(good),
        links=reached.select("site", "url", F.explode("links").alias("link")),
        stats=status.crawl_stats(states),
        options=options,
    )


def _join_domains(facts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Fill in the domains of all links by a join, for suffix tables too large for a plan.

    Hosts are joined once each; a host that a third of all links lead to is a
    skewed key of an equi-join with one row on the other side, which Spark splits.
    """
    links = facts.select("url", F.posexplode("links").alias("place", "link")).select(
        "url", "place", F.col("link.url").alias("link"), host_name(F.col("link.url")).alias("host")
    )
    described = F.struct("place", F.struct(F.col("link").alias("url"), "domain", "subdomain").alias("link"))
    # A page's links are regrouped; their number is bounded by the page.
    filled = (
        links.join(domains_by_join(links, suffixes), "host")
        .groupBy("url").agg(F.array_sort(F.collect_list(described)).alias("described"))
    )
    return facts.join(filled, "url", "left").select(
        "url",
        F.when(F.col("described").isNull(), F.col("links"))
        .otherwise(F.transform("described", lambda d: d["link"])).alias("links"),
        "markdown", "bad_link",
    )
