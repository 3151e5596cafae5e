"""Crawl bookkeeping: page status, counters, tree and activity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.text import reported_title
from pagemill.functions.urls import url_label
from pagemill.session import checkpointed

# Page states and messages.
SUCCESS, FAILED, SKIPPED, CRAWLING = "success", "failed", "skipped", "crawling"
NOT_HTML = "Not HTML or fetch failed"
BAD_LINK = "Invalid IPv6 URL"

# Sizes of the tree and activity reports.
TREE_CHILDREN, TREE_NODES, TREE_LEVELS, ACTIVITY_ROWS = 5, 15, 4, 5
TITLE_WIDTH, LABEL_WIDTH = 40, 50


def page_status(
    frontier: DataFrame, outcomes: DataFrame, fail_on_bad_link: bool = True
) -> DataFrame:
    """Status row per reached URL.

    ``outcomes(url, markdown, n_links, bad_link)`` has one row per usable page;
    with a ``site`` column it is matched per site.
    """
    keys = ["site", "url"] if "site" in outcomes.columns else ["url"]
    joined = frontier.join(outcomes.withColumn("stored", F.lit(True)), keys, "left")
    return outcome_columns(joined, fail_on_bad_link)


def outcome_columns(joined: DataFrame, fail_on_bad_link: bool = True) -> DataFrame:
    """Status columns of reached URLs already joined with their page outcome."""
    stored = F.coalesce("stored", F.lit(False))
    failed = F.col("bad_link") if fail_on_bad_link else F.lit(False)
    status = F.when(~stored, SKIPPED).when(failed, FAILED).otherwise(SUCCESS)
    success = F.col("status") == SUCCESS
    return joined.withColumn("status", status).select(
        "site", "url", "depth", "parent_url", "status",
        F.when(success, reported_title(F.col("markdown"))).alias("title"),
        F.when(success, F.col("n_links")).otherwise(0).cast("int").alias("links_found"),
        F.when(F.col("status") == SKIPPED, NOT_HTML)
        .when(F.col("status") == FAILED, BAD_LINK).alias("error"),
    )


def counters(status: Column, links_found: Column) -> list[Column]:
    hit = lambda s: F.count_if(status == s)
    return [
        F.count("*").alias("discovered"),
        hit(SUCCESS).alias("crawled"),
        hit(FAILED).alias("failed"),
        hit(SKIPPED).alias("skipped"),
        F.coalesce(F.sum(F.when(status == SUCCESS, links_found)), F.lit(0)).alias("links_found"),
    ]


def crawl_stats(status_rows: DataFrame) -> DataFrame:
    """One row of counters per site; nothing but partial sums is shuffled."""
    stats = status_rows.groupBy("site").agg(
        *counters(F.col("status"), F.col("links_found")), F.max("depth").alias("max_depth")
    )
    return stats.withColumn(
        "remaining", F.col("discovered") - F.col("crawled") - F.col("failed") - F.col("skipped")
    )


def crawl_progress(stats: DataFrame) -> DataFrame:
    done = F.col("crawled") + F.col("failed") + F.col("skipped")
    return stats.select(
        "site", done.alias("completed"), F.col("discovered").alias("total"),
        F.try_divide(done.cast("double"), F.col("discovered").cast("double")).alias("ratio"),
    )


def recent_activity(status_rows: DataFrame) -> DataFrame:
    """First rows per site: pages in work first, then by depth; url breaks ties."""
    order = Window.partitionBy("site").orderBy(
        F.col("status") != CRAWLING, "depth", "url"
    )
    return (
        status_rows.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= ACTIVITY_ROWS)
        .select("site", "place", "url", "status", "depth", "links_found")
    )


def crawl_tree(status_rows: DataFrame) -> DataFrame:
    """Pre-order listing per site: ``(site, place, level, url, label, more_children)``.

    At most 5 children per parent, 4 levels below the root and 15 nodes per
    site. Deeper pages are left out at the scan, the cap of 5 is pushed below the shuffle (window group limit), the
    child count is a plain aggregation, and a site's tree has at most
    1+5+25+125+625 candidates, so a parent with a third of all pages is no
    hot spot.
    """
    by_url = Window.partitionBy("site", "parent_url").orderBy("url")
    label = F.when(
        (F.col("status") == SUCCESS) & (F.coalesce("title", F.lit("")) != ""),
        F.left("title", F.lit(TITLE_WIDTH)),
    ).otherwise(url_label(F.col("url"), LABEL_WIDTH))
    near = status_rows.filter((F.col("parent_url").isNotNull()) & (F.col("depth") <= TREE_LEVELS))
    fans = near.groupBy("site", F.col("parent_url").alias("url")).agg(F.count("*").alias("fan"))
    kids = checkpointed(
        near.withColumn("rank", F.row_number().over(by_url))
        .filter(F.col("rank") <= TREE_CHILDREN)
        .select("site", "parent_url", "rank", F.col("url").alias("kid"), label.alias("kid_label"))
    )
    level = status_rows.filter("parent_url is null").select(
        "site", "url", url_label(F.col("url"), TITLE_WIDTH).alias("label"), F.lit(0).alias("level"),
        F.array().cast("array<int>").alias("path"),
    )
    shown = level
    for depth in range(1, TREE_LEVELS + 1):
        level = level.select("site", F.col("url").alias("parent_url"), "path").join(
            kids, ["site", "parent_url"]
        ).select(
            "site", F.col("kid").alias("url"), F.col("kid_label").alias("label"),
            F.lit(depth).alias("level"), F.concat("path", F.array("rank")).alias("path"),
        )
        shown = shown.unionByName(level)
    order = Window.partitionBy("site").orderBy("path")
    placed = shown.withColumn("place", F.row_number().over(order) - 1).filter(
        F.col("place") <= TREE_NODES
    )
    opened = (F.col("level") < TREE_LEVELS) & (F.col("place") < TREE_NODES)
    more = F.greatest(F.coalesce("fan", F.lit(0)) - TREE_CHILDREN, F.lit(0))
    return placed.join(fans, ["site", "url"], "left").select(
        "site", "place", "level", "url", "label",
        F.when(opened, more).otherwise(0).cast("long").alias("more_children"),
    )
