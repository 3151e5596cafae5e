"""Outcome and waiting time of logged fetch attempts.

``fetch_attempts(url, attempt, status, content_type, error, html)``: attempt
counts from 0; error is NULL, 'timeout', 'client' or anything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PASSING_ERRORS = ("timeout", "client")


def attempt_label(mode: str = "http") -> Column:
    """'ok', 'none' or 'retry' for one attempt; the order of the rules matters."""
    is_html = F.lower(F.coalesce("content_type", F.lit(""))).contains("text/html")
    if mode == "browser":
        # A rendered page counts whatever its status; nothing usable is tried again.
        usable = F.col("error").isNull() & is_html & (F.coalesce("html", F.lit("")) != "")
        return F.when(usable, "ok").otherwise("retry")
    return (
        F.when(F.col("error").isin(*PASSING_ERRORS), "retry")
        .when(F.col("error").isNotNull(), "none")
        .when(~is_html, "none")
        .when(F.col("status") == 200, "ok")
        .when(F.col("status") >= 500, "retry")
        .otherwise("none")
    )


def resolve_attempts(
    attempts: DataFrame, max_retries: int = 3, mode: str = "http", payload: tuple[str, ...] = ("html",)
) -> DataFrame:
    """``(url, outcome, attempt, *payload)``: the first decisive attempt per URL.

    URLs whose attempts are used up, or that were never decided, give 'none'.
    A URL has one row for each attempt. What attempt 0 decides is final, so such rows, most of a
    log, pass through with their pages where they are. One aggregation over short
    keys picks the attempt of the others, and only the pages of their winning rows move.
    """
    label = attempt_label(mode)
    tried = F.col("attempt") < max_retries
    verdict = attempts.groupBy("url").agg(
        F.min(
            F.when(tried & (label != "retry"), F.struct("attempt", label.alias("outcome")))
        ).alias("first")
    ).select(
        "url",
        F.col("first.attempt").alias("attempt"),
        F.coalesce("first.outcome", F.lit("none")).alias("outcome"),
    )
    if not payload:
        return verdict
    at_once = attempts.filter(tried & (F.col("attempt") == 0) & (label != "retry")).select(
        "url", label.alias("outcome"), "attempt", *[F.when(label == "ok", F.col(c)).alias(c) for c in payload]
    )
    ok_rows = attempts.filter(tried & (F.col("attempt") > 0) & (label == "ok")).select("url", "attempt", *payload)
    decided = F.when(F.col("outcome") == "ok", F.col("attempt"))
    later = (
        verdict.filter("attempt is null or attempt > 0").withColumn("ok_attempt", decided).alias("v")
        .join(
            ok_rows.alias("o"),
            (F.col("v.url") == F.col("o.url")) & (F.col("v.ok_attempt") == F.col("o.attempt")),
            "left",
        )
        .select("v.url", "v.outcome", "v.attempt", *[f"o.{c}" for c in payload])
    )
    return at_once.unionByName(later)


def backoff_seconds(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """``(url, waited)``: seconds spent waiting, attempts after the decisive one ignored.

    Server errors wait after every attempt, the last included; timeouts and
    client errors not after the last.
    """
    label = attempt_label()
    tried = F.col("attempt") < max_retries
    pause = F.pow(F.lit(2.0), F.col("attempt")).cast("long")
    passing = F.col("error").isin(*PASSING_ERRORS)
    waits = (
        F.when(label != "retry", F.lit(0))
        .when(passing & (F.col("attempt") >= max_retries - 1), F.lit(0))
        .otherwise(pause)
    )
    decided = F.min(F.when(tried & (label != "retry"), F.col("attempt")))
    each = range(max_retries)
    summed = attempts.groupBy("url").agg(
        decided.alias("decided"),
        *[F.max(F.when(F.col("attempt") == k, waits)).alias(f"wait_{k}") for k in each],
    )
    total = F.lit(0).cast("long")
    for k in each:
        counts = F.coalesce("decided", F.lit(max_retries)) > k
        total = total + F.when(counts, F.coalesce(f"wait_{k}", F.lit(0))).otherwise(0)
    return summed.select("url", total.alias("waited"))
