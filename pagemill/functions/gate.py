"""Which URLs belong to a crawl: scheme, site scope, extensions, user patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pagemill.options import CorpusOptions

SKIPPED_HREF = r"^(javascript:|mailto:|tel:|#)"


def java_pattern(pattern: str) -> str:
    """A Python pattern for the JVM: named groups made plain ones, Unicode ignore-case on.

    Patterns are searched for, so a leading ``.*`` decides nothing and is left
    out: with it every start position would be tried against the whole text.
    """
    if re.search(r"\(\?P[=>]", pattern):
        raise ValueError(f"named back-references are not supported: {pattern!r}")
    re.compile(pattern)
    searched = re.sub(r"^(?:\.\*)+(?![?+*{])", "", pattern)
    # Only whether a pattern is found counts, so a named group may be a plain one; "\\(?P<" is text.
    plain = re.sub(r"(\\.)|\(\?P<\w+>", lambda m: m[1] or "(", searched, flags=re.S)
    return "(?diU)(?:" + plain + ")"


def found_any(text: Column, patterns: Sequence[str]) -> Column:
    """Is at least one pattern found? False for no patterns."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike(java_pattern(pattern))
    return hit


def usable_href(href: Column) -> Column:
    return (href != "") & ~href.rlike(SKIPPED_HREF)


def is_web(url: Column) -> Column:
    return url.rlike("^https?://")


def has_excluded_extension(url: Column, extensions: Sequence[str]) -> Column:
    return found_any(url, extensions)


def in_scope(link: Column, root: Column, stay_on_subdomain: bool) -> Column:
    """Same registered domain, and same subdomain if asked; both are domain structs."""
    same = link["domain"] == root["domain"]
    return same & (link["subdomain"] == root["subdomain"]) if stay_on_subdomain else same


def reject_reason(url: Column, scope: Column, options: CorpusOptions) -> Column:
    """First failing rule in the order they are tried, NULL when the URL is kept."""
    reason = F.when(~is_web(url), F.lit("scheme"))
    if not options.include:
        reason = reason.when(~scope, F.lit("domain"))
    reason = reason.when(has_excluded_extension(url, options.exclude_extensions), F.lit("extension"))
    if options.exclude:
        reason = reason.when(found_any(url, options.exclude), F.lit("exclude"))
    if options.include:
        reason = reason.when(~found_any(url, options.include), F.lit("include"))
    return reason


def passes_site_free_rules(url: Column, options: CorpusOptions) -> Column:
    """Every rule that does not depend on the crawling site."""
    keep = (
        is_web(url)
        & ~has_excluded_extension(url, options.exclude_extensions)
        & ~found_any(url, options.exclude)
    )
    return keep & found_any(url, options.include) if options.include else keep


def should_crawl(url: Column, scope: Column, options: CorpusOptions) -> Column:
    return reject_reason(url, scope, options).isNull()
