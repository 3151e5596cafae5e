"""Named page documents and merged documents per site.

A site may hold a third of all pages, so nothing here gathers a site in one
task: pages are numbered by range partition, and a large site's merged text is
a sequence of bounded parts whose concatenation is the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.functions.urls import anchor, merged_filename, page_filename
from pagemill.functions.text import page_document
from pagemill.options import PAGE_SEPARATOR
from pagemill.session import stored

LOCAL_BITS = 33  # monotonically_increasing_id: row number in the lower 33 bits


def page_docs(pages: DataFrame) -> DataFrame:
    """``(site, url, filename, content)`` from ``(site, url, markdown)``."""
    return pages.select(
        "site", "url", page_filename(F.col("url")).alias("filename"),
        page_document(F.col("url"), F.col("markdown")).alias("content"),
    )


def numbered(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Add ``place`` (1.. by url within site) and ``n_pages``, without a per-site sort.

    Rows are range-partitioned and sorted by (site, url) and stored, one file
    run per partition. Finding the ranges reads the rows once more, so hand in
    a stored table, not an expensive plan. The row number inside a partition then needs no shuffle;
    only one (first row, count) pair per site and partition is aggregated to
    turn it into a number within the site.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = rows.repartitionByRange(parts, "site", "url").sortWithinPartitions("site", "url")
    cells = cells.withColumn("row", F.monotonically_increasing_id())
    cells = stored(
        cells.withColumn("cell", F.shiftright("row", LOCAL_BITS)), "numbered"
    )
    runs = cells.groupBy("site", "cell").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("site").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "site", "cell", "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy("site")).alias("n_pages"),
    )
    return cells.join(runs, ["site", "cell"]).select(
        *rows.columns,
        (F.col("row") - F.col("first") + F.col("offset") + 1).alias("place"), "n_pages",
    )


def toc(numbered_rows: DataFrame) -> DataFrame:
    url = F.col("url")
    line = F.concat(
        F.col("place").cast("string"), F.lit(". ["), url, F.lit("](#"), anchor(url), F.lit(")\n")
    )
    return numbered_rows.select("site", "place", "url", line.alias("line"))


def head(n_pages: Column) -> Column:
    return F.concat(
        F.lit("# Merged Documentation\n**Total Pages:** "), n_pages.cast("string"),
        F.lit("\n\n## Table of Contents\n"),
    )


def segments(docs: DataFrame, separator: str = PAGE_SEPARATOR, parts: int | None = None) -> DataFrame:
    """``(site, n_pages, section, place, text)``; in (section, place) order the texts
    of a site make up its merged document. Section 0 is head and contents, 1 the pages.
    """
    rows = numbered(docs.select("site", "url", "content"), parts)
    url = F.col("url")
    line = F.concat(
        F.when(F.col("place") == 1, head(F.col("n_pages"))).otherwise(F.lit("")),
        F.col("place").cast("string"), F.lit(". ["), url, F.lit("](#"), anchor(url), F.lit(")\n"),
        F.when(F.col("place") == F.col("n_pages"), F.lit(separator)).otherwise(F.lit("")),
    )
    page = F.concat(
        F.lit('<a id="'), anchor(url), F.lit('"></a>\n\n## Source: '), url, F.lit("\n\n"),
        F.col("content"), F.lit(separator),
    )
    return rows.select(
        "site", "n_pages", "place",
        F.explode(F.array(
            F.struct(F.lit(0).alias("section"), line.alias("text")),
            F.struct(F.lit(1).alias("section"), page.alias("text")),
        )).alias("s"),
    ).select("site", "n_pages", "s.section", "place", "s.text")


def merged_name(site: Column, name: str | None = None) -> Column:
    """File name of a site's merged document: as given, else from the site's host."""
    if name:
        return F.lit(name)
    url = F.when(site.contains("://"), site).otherwise(F.concat(F.lit("https://"), site))
    return merged_filename(url)


def merged_documents(
    docs: DataFrame,
    pages_per_part: int = 1000,
    separator: str = PAGE_SEPARATOR,
    name: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``(site, merged_filename, n_pages, part, content)``.

    Up to ``pages_per_part`` pages make one part 0, the whole document. A larger
    site gets contents parts, then page parts; joined in order they are the
    same bytes. No group is larger than 2 x pages_per_part texts.
    """
    chunk = F.floor((F.col("place") - 1) / F.lit(pages_per_part))
    contents_parts = F.ceil(F.col("n_pages") / F.lit(pages_per_part))
    part = F.when(F.col("n_pages") <= pages_per_part, F.lit(0)).otherwise(
        chunk + F.when(F.col("section") == 1, contents_parts).otherwise(F.lit(0))
    ).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("section", "place", "text")))
    return (
        segments(docs, separator, parts).withColumn("part", part)
        .groupBy("site", "part")
        .agg(F.first("n_pages").alias("n_pages"), ordered.alias("pieces"))
        .select(
            "site", merged_name(F.col("site"), name).alias("merged_filename"), "n_pages", "part",
            F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("content"),
        )
    )
