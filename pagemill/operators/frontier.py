"""Breadth-first reach from many roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.functions.gate import in_scope
from pagemill.operators.sites import site_reject_reason, within_depth
from pagemill.options import CorpusOptions
from pagemill.session import Buckets

# Tables of at most so many URLs are not worth bucketing; seen URLs are broadcast.
MAX_BROADCAST_SEEN = 100_000


def breadth_first(
    seeds: DataFrame,
    links: DataFrame,
    options: CorpusOptions | None = None,
    scoped: bool = True,
    sites: DataFrame | None = None,
) -> DataFrame:
    """``(site, url, depth, parent_url[, domain, subdomain])``: minimum depth, smallest parent.

    ``seeds(site, url, domain, subdomain)`` holds the page keys of the roots,
    one per site; ``links(url, links)`` has one row per stored page, links as
    array<struct<url, domain, subdomain>>; hand in a stored table. With ``scoped=False`` (or include
    patterns) links are not tested against the site's domain.

    ``sites`` (the options table of ``operators.sites``) gives every site its own rules: each level's
    links meet their site's row in a join and pass its depth limit, scope, extensions, exclude and
    include patterns; ``options`` then only says nothing. Seeds need domain and subdomain for it.

    Per level one job writes the new frontier. The link table is bucketed by
    url once and, past a small number of seen URLs, every frontier by (site,
    url), so a level shuffles the last frontier and its links but not the
    link table; seen URLs are moved when tables of similar size are packed.
    Popular link targets shrink in the partial aggregation before the shuffle.
    """
    options = options or CorpusOptions()
    scoped = scoped and not options.include
    scope = [c for c in ("domain", "subdomain") if c in seeds.columns]
    buckets = Buckets(seeds.sparkSession)
    try:
        links = links.select("url", "links")
        few = links.count() <= MAX_BROADCAST_SEEN
        link_table = buckets.write_plain(links) if few else buckets.write(links, "url")
        first = seeds.dropDuplicates(["site", "url"]).select(
            "site", "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), *scope
        )
        level = buckets.write_plain(first)
        seen, n_seen, depth = [level], buckets.rows(level).count(), 0
        sizes, large = [n_seen], False
        while options.max_depth is None or depth < options.max_depth:
            depth += 1
            out = buckets.rows(level).join(buckets.rows(link_table), "url").select(
                "site", *scope, F.col("url").alias("parent_url"), F.explode("links").alias("link")
            )
            if sites is not None:
                rules = sites.select("site", F.struct(*[c for c in sites.columns if c != "site"]).alias("rules"))
                out = out.join(rules, "site").filter(
                    within_depth(F.lit(depth), F.col("rules"))
                    & site_reject_reason(F.col("link.url"), F.col("link"), F.struct(*scope), F.col("rules")).isNull()
                ).drop("rules")
            elif scoped:
                out = out.filter(
                    in_scope(F.col("link"), F.struct(*scope), options.stay_on_subdomain)
                )
            fresh = out.select("site", F.col("link.url").alias("url"), "parent_url", *scope).groupBy(
                "site", "url"
            ).agg(F.min("parent_url").alias("parent_url"), *[F.first(c).alias(c) for c in scope])
            if n_seen > MAX_BROADCAST_SEEN and not large:
                large = True
                seen = [buckets.write(buckets.files(seen), "site", "url")]
                sizes = [n_seen]
            # What new URLs are tested against: one small broadcast, or co-located tables.
            known = [buckets.rows(n) for n in seen] if large else [F.broadcast(buckets.files(seen))]
            for table in known:
                fresh = fresh.join(table.select("site", "url"), ["site", "url"], "left_anti")
            fresh = fresh.select("site", "url", F.lit(depth).alias("depth"), "parent_url", *scope)
            if large:
                level = buckets.write(fresh, "site", "url", shuffle=False)
            else:
                level = buckets.write_plain(fresh)
            n_level = buckets.rows(level).count()
            if n_level == 0:
                break
            n_seen += n_level
            seen.append(level)
            sizes.append(n_level)
            # Tables of similar size are packed into one, so a URL is written again a few times
            # only, a logarithm of their number, however many levels there are.
            while large and len(seen) > 1 and sizes[-2] <= 2 * sizes[-1]:
                seen[-2:] = [buckets.write(buckets.files(seen[-2:]), "site", "url")]
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return buckets.files(seen)
    finally:
        buckets.close()
