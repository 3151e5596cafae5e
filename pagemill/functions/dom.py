"""Cleaning and content selection on a page's ``nodes`` array.

Each function takes the array (or something derived from it) and returns a
Column. No row leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from pagemill.functions.text import is_blank, let, strip


def at(array: Column, index: Column) -> Column:
    """0-based, NULL outside the array."""
    return F.get(array, index)


def subtree(array: Column, node: Column) -> Column:
    """The entries of an array aligned with ``nodes`` that lie in ``node``."""
    return F.slice(array, node["node_id"] + 1, node["end_id"] - node["node_id"] + 1)


def running_max(values: Column) -> Column:
    """Largest of the entries up to each one, NULLs passed over (-1 before the first value).

    In runs of 64, whose maxima are then run over, so long arrays are not copied for each entry.
    """
    size = 64

    def grown(sofar, x):
        return F.concat(sofar, F.array(F.greatest(F.element_at(sofar, -1), x)))

    def over(runs):
        begin = F.array(F.lit(-1))
        inner = F.transform(runs, lambda run: F.slice(F.aggregate(run, begin, grown), F.lit(2), F.lit(size)))

        def joined(inner):
            tops = F.aggregate(inner, begin, lambda sofar, run: grown(sofar, F.element_at(run, -1)))
            return let(tops, lambda tops: F.flatten(F.transform(
                inner, lambda run, place: F.transform(run, lambda x: F.greatest(x, at(tops, place))))))

        return let(inner, joined)

    def cut(values):
        runs = F.transform(
            F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / size), F.lit(0)).cast("int")),
            lambda n: F.slice(values, n * size + 1, F.lit(size)))
        return F.when(F.size(values) > 0, let(runs, over)).otherwise(F.array().cast("array<int>"))

    return let(values, cut)


def covered(nodes: Column, hits: Callable[[Column], Column]) -> Column:
    """array<int>: how far the subtrees reach that the nodes up to each one open and ``hits`` accepts.

    A node lies in such a subtree, or opens one, if the entry is not smaller than its node_id.
    """
    return running_max(F.transform(nodes, lambda n: F.when(hits(n), n["end_id"])))


def matches_any(node: Column, selectors: Iterable[str]) -> Column:
    """Does an element match one of the simple selectors (tag, .class, #id, [a='v'])?"""
    tags, classes, ids, attrs = [], [], [], {}
    for selector in selectors:
        attribute = re.fullmatch(r"\[([\w-]+)=['\"]?(.*?)['\"]?\]", selector)
        if attribute:
            attrs.setdefault(attribute[1], []).append(attribute[2])
        elif selector.startswith("."):
            classes.append(selector[1:])
        elif selector.startswith("#"):
            ids.append(selector[1:])
        elif re.fullmatch(r"[\w-]+", selector):
            tags.append(selector)
        else:
            raise ValueError(f"not a simple selector: {selector!r}")
    tests = []
    if classes:
        tests.append(F.arrays_overlap(node["classes"], F.array(*map(F.lit, classes))))
    if ids:
        tests.append(node["attrs"]["id"].isin(ids))
    tests += [node["attrs"][name].isin(values) for name, values in attrs.items()]
    hit = F.lit(False)
    if tests:
        with_attrs = reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))
        hit = (F.size(node["attrs"]) > 0) & with_attrs
    if tags:
        hit = node["tag"].isin(tags) | hit
    return (node["kind"] == "element") & hit


def boilerplate_flags(nodes: Column, selectors: Iterable[str]) -> Column:
    """array<boolean>: is the node itself a boilerplate match?"""
    return F.transform(nodes, lambda n: matches_any(n, selectors))


def kept_flags(nodes: Column, selectors: Iterable[str]) -> Column:
    """array<boolean>: does the node survive comment, boilerplate and empty-element removal?"""

    def cut(reach):
        return F.transform(
            nodes, lambda n: (n["kind"] == "comment") | (at(reach, n["node_id"]) >= n["node_id"])
        )

    def solid(gone):
        return F.transform(
            nodes,
            lambda n: ~at(gone, n["node_id"])
            & F.when(n["kind"] == "text", ~is_blank(n["text"])).otherwise(
                F.coalesce(n["tag"] == "img", F.lit(False))
            ),
        )

    def full(solids):
        """Elements with a solid node below: the last solid one up to their end is not before them."""
        last = running_max(F.transform(solids, lambda solid, place: F.when(solid, place)))
        return let(last, lambda last: F.transform(
            nodes, lambda n: (n["kind"] == "element") & (at(last, n["end_id"]) >= n["node_id"])
        ))

    def kept(gone, fulls):
        parent_full = lambda n: (n["parent_id"] < 0) | at(fulls, n["parent_id"])
        return F.transform(
            nodes,
            lambda n: ~at(gone, n["node_id"])
            & F.when(
                (n["kind"] == "element") & ~n["tag"].isin("br", "hr", "img"),
                at(fulls, n["node_id"]),
            ).otherwise(parent_full(n)),
        )

    return let(
        covered(nodes, lambda n: matches_any(n, selectors)),
        lambda reach: let(
            cut(reach),
            lambda gone: let(
                solid(gone),
                lambda solids: let(full(solids), lambda fulls: kept(gone, fulls)),
            ),
        ),
    )


def text_pieces(nodes: Column, node: Column) -> Column:
    """The text below an element, each piece stripped, joined without separator."""
    pieces = F.filter(subtree(nodes, node), lambda n: n["kind"] == "text")
    return F.array_join(F.transform(pieces, lambda n: strip(n["text"])), "")


def page_title(nodes: Column) -> Column:
    """First h1, else first title element, else a fixed word; on the uncleaned tree."""
    def first(tag):
        return at(F.filter(nodes, lambda n: n["tag"] == tag), F.lit(0))

    return let(
        F.coalesce(first("h1"), first("title")),
        lambda n: F.when(n.isNull(), F.lit("Untitled")).otherwise(text_pieces(nodes, n)),
    )


def content_node(nodes: Column, kept: Column, selectors: Iterable[str]) -> Column:
    """node_id of the main content: best selector first, then document order; else body."""
    def rank(node):
        chain = F
        for place, selector in enumerate(selectors):
            chain = chain.when(matches_any(node, [selector]), F.lit(place))
        return chain.when(node["tag"] == "body", F.lit(len(list(selectors))))

    ranked = F.transform(
        nodes,
        lambda n: F.when(
            at(kept, n["node_id"]) & (n["kind"] == "element"),
            F.struct(rank(n).alias("rank"), n["node_id"].alias("node_id")),
        ),
    )
    return F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull()))["node_id"]
