"""Tables written by a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def write_pages(docs: DataFrame, path: str, parts: int | None = None, mode: str = "overwrite") -> None:
    """Page documents keyed by (site, filename); of several pages of one name the
    one with the largest url stays.

    One range shuffle serves both the choice and the layout: files are sorted
    by (site, filename), so readers of a site skip the rest by file statistics,
    and a large site is spread over many files. Finding the ranges reads the
    input once more, so hand in a stored table.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = Window.partitionBy("site", "filename").orderBy(F.col("url").desc())
    (
        docs.repartitionByRange(parts, "site", "filename")
        .withColumn("n", F.row_number().over(last))
        .filter("n = 1").drop("n")
        .write.mode(mode).parquet(path)
    )


def write_merged_text(segments: DataFrame, path: str, parts: int | None = None, mode: str = "overwrite") -> None:
    """Merged documents as text files in reading order, one folder per site.

    A large site becomes several files, in name order. Text files end their
    records with a line end, so every segment must, too; the usual separator does.
    """
    text = F.col("text")
    value = F.when(
        F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)
    ).otherwise(F.raise_error(F.lit("a separator for text files must end with a line end")))
    parts = parts or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        segments.repartitionByRange(parts, "site", "section", "place")
        .sortWithinPartitions("site", "section", "place")
        .select("site", value.alias("value"))
        .write.mode(mode).partitionBy("site").text(path)
    )
