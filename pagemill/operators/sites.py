"""Settings per site: one options row a site, joined to the frontier instead of one setting for all.

A run may hold many sites, each with its own root, depth limit, scope, include and exclude patterns,
excluded extensions and merged file name. They live in a table keyed by site (patterns as array
columns, already turned into JVM patterns), so the rules are data: the frontier joins each level's
links with their site's row and tests them by that row, and a site without a depth limit keeps going
while another has stopped. One run over many sites gives what one run a site gives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill.functions.gate import is_web, java_pattern
from pagemill.options import CorpusOptions

SITE_SCHEMA = (
    "site string, root string, max_depth int, stay_on_subdomain boolean, include array<string>, "
    "exclude array<string>, exclude_extensions array<string>, merged_name string"
)


def site_table(spark: SparkSession, sites: Sequence[tuple[str, str, CorpusOptions]]) -> DataFrame:
    """(site, root url, options) triples as the options table; patterns are checked and made JVM patterns."""
    seen = set()
    rows = []
    for site, root, options in sites:
        if site in seen:
            raise ValueError(f"site {site!r} is given twice")
        seen.add(site)
        rows.append((
            site, root, options.max_depth, options.stay_on_subdomain,
            [java_pattern(p) for p in options.include], [java_pattern(p) for p in options.exclude],
            [java_pattern(p) for p in options.exclude_extensions], options.merged_name,
        ))
    return spark.createDataFrame(rows, SITE_SCHEMA)


def _found(url: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: F.regexp_like(url, p))


def site_reject_reason(url: Column, link: Column, root: Column, rules: Column) -> Column:
    """First failing rule of the site in ``rules`` (a row of the options table), NULL when kept.

    The order is the one of a single run: scheme, domain (only without include patterns), extension,
    exclude, include. ``link`` and ``root`` are struct(domain, subdomain).
    """
    same = link["domain"] == root["domain"]
    scope = same & (~rules["stay_on_subdomain"] | (link["subdomain"] == root["subdomain"]))
    has_include = F.size(rules["include"]) > 0
    return (
        F.when(~is_web(url), F.lit("scheme"))
        .when(~has_include & ~scope, F.lit("domain"))
        .when(_found(url, rules["exclude_extensions"]), F.lit("extension"))
        .when(_found(url, rules["exclude"]), F.lit("exclude"))
        .when(has_include & ~_found(url, rules["include"]), F.lit("include"))
    )


def within_depth(depth: Column, rules: Column) -> Column:
    return rules["max_depth"].isNull() | (depth <= rules["max_depth"])
