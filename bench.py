"""Headline queries, timed after one warm-up run each; prints one JSON line.

BENCH_SF_DIR   folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS     local task slots (default 8)
BENCH_COPIES   replicate the pages so many times under other hosts (default 1)
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pagemill.plans.convert import to_markdown  # noqa: E402
from pagemill.plans.queries import QUERIES  # noqa: E402
from pagemill.session import spread, work_folder  # noqa: E402

HEADLINE = [
    "dom_nodes", "pages_to_markdown", "extract_links", "distinct_links", "tidy_markdown",
    "resolve_fetch_log", "bfs_frontier", "crawl_stats", "crawl_tree", "merged_corpus",
    "page_sink", "build_corpus", "stream_markdown",
]


def timed(make):
    begin = time.time()
    make().write.format("noop").mode("overwrite").save()
    return round(time.time() - begin, 3)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    if copies > 1:
        pages = spark.read.parquet(f"{folder}/pages.parquet")
        many = pages.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).select(
            (F.col("page_id") + F.col("copy") * 1_000_000).alias("page_id"),
            F.regexp_replace("url", "://", F.concat(F.lit("://c"), F.col("copy"), F.lit("."))).alias("url"), "html",
        )
        path = work_folder(spark, "copies")
        spread(many).write.parquet(path)
        seconds[f"pages_to_markdown_x{copies}"] = timed(lambda: to_markdown(spark.read.parquet(path)))
    else:
        for name in HEADLINE:
            timed(lambda: QUERIES[name](spark, folder))
            seconds[name] = timed(lambda: QUERIES[name](spark, folder))
            print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


main()
