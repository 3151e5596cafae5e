"""URL filter: a trie over reversed host labels and path segments, the longest rule wins.

A rule is (verdict, host, path). It fits its host and every subdomain, if the
path of the URL starts with the rule's path; "starts" is meant by characters,
so the last, open segment of a rule may end inside a segment. Of several
fitting rules the one with more host labels wins, then the one with the longer
path; of equal rules a block wins. Rules are few by contract of the operator:
more than ``max_rules`` are refused, which bounds what is broadcast.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import arrow_rows

Rule = tuple[str, str, str]  # verdict, host, path

_URL = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without "://"."""
    found = _URL.match(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class RuleTrie:
    """Nested dictionaries: labels from the last to the first, then path segments. ``rest`` ends a rule."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {"labels": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            *whole, rest = path.split("/")
            step = node["paths"] = node["paths"] or {"segments": {}, "rest": {}}
            for segment in whole:
                step = step["segments"].setdefault(segment, {"segments": {}, "rest": {}})
            if step["rest"].get(rest, ("", ""))[1] != "block":
                step["rest"][rest] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the winning rule."""
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            if node["paths"]:
                best = self.longest(node["paths"], segments) or best
        return best

    @staticmethod
    def longest(step: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for n, segment in enumerate(segments):
            fits = [rest for rest in step["rest"] if segment.startswith(rest)]
            if fits:
                best = step["rest"][max(fits, key=len)]
            step = step["segments"].get(segment) if n + 1 < len(segments) else None
            if step is None:
                break
        return best


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", max_rules: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``default`` is the verdict where no rule fits, then ``rule`` is null. A null URL, or one without "://", has
    an empty host and path and gets the default. Rows that repeat are judged as often; other columns are left out.
    """
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; the trie is broadcast and holds {max_rules} at most")
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(RuleTrie(rules))
    schema = pa.schema([("page_id", pa.int64())] + [(c, pa.string()) for c in ("host", "path", "rule", "verdict")])

    def run(page_id, url):
        parts = [split_url(u) for u in url]
        found = [trie.value.find(*p) or (None, default) for p in parts]
        return page_id, *zip(*parts), *zip(*found)

    return pages.select("page_id", F.col("url").cast("string")).mapInArrow(
        lambda b: arrow_rows(b, schema, run),
        "page_id long, host string, path string, rule string, verdict string")
