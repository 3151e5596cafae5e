"""What a run keeps, drops and calls things; the data-shaping settings only.

Pacing settings (concurrency, delays, timeouts) have no place here: pages are
already stored and Spark does the scheduling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

# Elements that never carry page content.
BOILERPLATE_SELECTORS = """
nav header footer aside
.sidebar .navigation .nav .menu .header .footer .breadcrumb .breadcrumbs .toc
.table-of-contents .advertisement .ads .ad .social-share .social-links
.share-buttons .cookie-banner .cookie-notice .popup .modal
#sidebar #nav #navigation #header #footer
[role='navigation'] [role='banner'] [role='contentinfo'] [aria-label='breadcrumb']
script style noscript iframe form button input select textarea
""".split()

# Where the main content of a page sits, best first.
CONTENT_SELECTORS = """
main article [role='main']
.main-content .content .post-content .article-content .entry-content
#main #content #main-content
.markdown-body .documentation .docs-content
""".split()

# File extensions that are not pages.
EXCLUDED_EXTENSIONS = (
    r".*\.(pdf|zip|tar|gz|exe|dmg|pkg|deb|rpm)$",
    r".*\.(png|jpg|jpeg|gif|svg|ico|webp)$",
    r".*\.(css|js|woff|woff2|ttf|eot)$",
    r".*\.(mp3|mp4|wav|avi|mov|webm)$",
)

# Fixed value: what stands between the pages of a merged document.
PAGE_SEPARATOR = "\n\n---\n\n"


@dataclass(frozen=True)
class CorpusOptions:
    """Settings of one corpus build, shared by all sites in it."""

    max_depth: int | None = None
    stay_on_subdomain: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_extensions: tuple[str, ...] = EXCLUDED_EXTENSIONS
    merged_name: str | None = None
    separator: str = PAGE_SEPARATOR
    boilerplate: tuple[str, ...] = field(default_factory=lambda: tuple(BOILERPLATE_SELECTORS))
    content: tuple[str, ...] = field(default_factory=lambda: tuple(CONTENT_SELECTORS))
    # True: one malformed link fails its page. False: only that link is dropped.
    bad_link_fails_page: bool = True
    # Own rendering of tags: (tag, (node, text) -> Column) pairs, tried before the built-in
    # rules. node has tag, classes, attrs and target; text is what its children gave.
    tag_rules: tuple[tuple[str, Callable[[Column, Column], Column]], ...] = ()
    # A site with more pages than this is merged into several ordered parts.
    pages_per_part: int = 1000

    def __post_init__(self):
        # Lists are welcome; tuples can be told apart by value.
        for name in ("include", "exclude", "exclude_extensions", "boilerplate", "content", "tag_rules"):
            value = getattr(self, name)
            if isinstance(value, str):
                raise TypeError(f"{name} takes a list of strings, not one string")
            object.__setattr__(self, name, tuple(value))
