"""Link table of a page corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.functions import urls
from pagemill.functions.domains import SuffixRules, domain_of_host, host_name
from pagemill.functions.gate import in_scope, passes_site_free_rules
from pagemill.functions.text import let
from pagemill.options import CorpusOptions
from pagemill.plans.convert import anchors, has_bad_anchor, link_urls
from pagemill.session import checkpointed
from pagemill.sources.html import shred


def _scope(options: CorpusOptions, rules: SuffixRules | None, root: str):
    """Is a link URL within the crawl of the root URL in the column ``root``? No question without rules."""
    if rules is None or options.include:
        return None
    home = domain_of_host(host_name(F.col(root)), rules)

    def inside(url: Column, own: Column) -> Column:
        return in_scope(domain_of_host(host_name(url), rules), own, options.stay_on_subdomain)

    return home, inside


def scoped_links(
    pages: DataFrame, options: CorpusOptions, rules: SuffixRules, base: str = "url", root: str = "root_url"
) -> DataFrame:
    """``(page_id, url, place, link)``: every anchor that is followed, repeats included, in document order.

    A page with a malformed link gives none, if that fails its page.
    """
    raw = raw_links(pages, base, [root])
    if options.bad_link_fails_page:
        raw = raw.filter(~F.col("page_bad"))
    kept = raw.filter(passes_site_free_rules(F.col("target"), options))
    scope = _scope(options, rules, root)
    if scope:
        home, inside = scope
        kept = kept.filter(inside(F.col("target"), home))
    return kept.select("page_id", "url", "place", F.col("target").alias("link"))


def raw_links(pages: DataFrame, base: str = "url", others: list[str] | None = None) -> DataFrame:
    """``(page_id, url, place, href, target, page_bad)`` for every usable anchor, NULL target if malformed.

    ``page_bad``: some anchor of the page is malformed. ``others`` are kept.
    """
    others = others or []
    shredded = shred(pages.select("page_id", F.col(base).alias("url"), "html", *others))
    # Targets are made inside the array: behind the explode they are plain columns.
    found = F.transform(
        anchors(F.col("nodes")),
        lambda h: F.struct(
            h.alias("href"),
            let(urls.resolve(F.col("url"), h), urls.normalize_url).alias("target"),
        ),
    )
    bad = has_bad_anchor(F.col("nodes")).alias("page_bad")
    return shredded.select("page_id", "url", *others, bad, F.posexplode(found).alias("place", "link")).select(
        "page_id", "url", *others, "place", "link.href", "link.target", "page_bad"
    )


def page_links(
    pages: DataFrame, options: CorpusOptions, base: str = "url", rules: SuffixRules | None = None,
    root: str = "root_url",
) -> DataFrame:
    """``(page_id, url, links)``: distinct link URLs per page.

    With suffix rules links are tested against the crawl's root URL in the column ``root``, as a crawl does;
    without them every rule but the scope holds. A page with a malformed link has none, if that fails its page.
    Distinctness is settled inside the page's own row, so there is no shuffle.
    """
    scope = _scope(options, rules, root)
    shredded = shred(pages.select("page_id", F.col(base).alias("url"), "html", *([root] if scope else [])))
    found = link_urls(F.col("nodes"), F.col("url"), options)
    if scope:
        home, inside = scope
        every = found
        found = let(home, lambda own: F.filter(every, lambda u: inside(u, own)))
    if options.bad_link_fails_page:
        found = F.when(has_bad_anchor(F.col("nodes")), F.array().cast("array<string>")).otherwise(found)
    return shredded.select("page_id", "url", found.alias("links"))


def one_page_per_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Of pages with the same key keep the smallest page_id, of equal ids the smallest hash of the row.

    Only keys and hashes are shuffled to find the keys of more than one page, with the row that stays. Spark
    broadcasts them if they are as few as usual; page bodies then stay where they are. Rows that are equal
    throughout are one page. Page ids need not be unique; NULL ids come last.
    """
    hashed = pages.withColumn("_row", F.struct(
        F.col("page_id").isNull(), "page_id", F.xxhash64(*[F.col(c) for c in sorted(pages.columns)])))
    many = checkpointed(
        hashed.groupBy(F.col(url).alias("_key"))
        .agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), F.count_distinct("_row").alias("_kinds"))
        .filter("_n > 1")
    )
    told = hashed.join(many, F.col(url).eqNullSafe(F.col("_key")), "left")
    # Equal rows lie in different places; only such keys move their bodies.
    alike = F.col("_n") > F.col("_kinds")
    kept = told.filter(F.col("_first").isNull() | (F.col("_row") == F.col("_first")))
    single = kept.filter(~F.coalesce(alike, F.lit(False))).select(*pages.columns)
    repeated = kept.filter(alike).select(*pages.columns).dropDuplicates(["page_id", url])
    return single.unionByName(repeated)


def unseen(candidates: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("site", "url")) -> DataFrame:
    """New URLs once each, with the smallest parent; partial sums tame popular targets."""
    return (
        candidates.groupBy(*keys).agg(F.min("parent_url").alias("parent_url"))
        .join(seen.select(*keys), list(keys), "left_anti")
    )
