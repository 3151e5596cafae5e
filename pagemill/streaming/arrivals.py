"""Streaming forms: pages, links and status events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.functions.urls import normalize_url
from pagemill.options import CorpusOptions
from pagemill.plans.convert import link_urls, to_markdown
from pagemill.sources.html import shred


def markdown_stream(pages: DataFrame, options: CorpusOptions | None = None) -> DataFrame:
    """Arriving pages to documents. Conversion is row by row, so it needs no state
    and the batch plan runs on a stream unchanged."""
    return to_markdown(pages, options)


def unseen_links(
    pages: DataFrame,
    options: CorpusOptions | None = None,
    fetched_at: str | None = None,
    horizon: str = "1 day",
) -> DataFrame:
    """Each link URL of arriving ``pages(site, url, html)`` once per site.

    With a fetch-time column the state is bounded: a URL is forgotten
    ``horizon`` after it was last new. Without one every URL is remembered.
    """
    times = [fetched_at] if fetched_at else []
    shredded = shred(pages.select("site", "url", "html", *times))
    links = shredded.select(
        "site", *times,
        F.explode(
            link_urls(F.col("nodes"), normalize_url(F.col("url")), options or CorpusOptions())
        ).alias("url"),
    )
    if fetched_at:
        return links.withWatermark(fetched_at, horizon).dropDuplicatesWithinWatermark(["site", "url"])
    return links.dropDuplicates(["site", "url"])


def live_counters(events: DataFrame) -> DataFrame:
    """Running counters per site and status from status events; update or complete mode."""
    return events.groupBy("site", "status").agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("links_found"))), F.lit(0))
        .cast("long").alias("links_found"),
    )
