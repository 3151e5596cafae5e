"""A cleaned subtree rendered as markdown, bottom-up, one tree level per step.

The state of the fold is an array of rendered strings aligned with the
subtree's nodes. At level d every element of depth d joins its children's
strings and applies the rule of its tag. The rule set is the public one of the
common HTML-to-markdown converters: atx headings, ``-`` bullets, ``*``/``**``
emphasis, only ``*`` and ``_`` escaped, pipe tables, fenced code.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill.functions.dom import at, covered
from pagemill.functions.text import is_blank, let, rstrip, strip
from pagemill.functions.urls import is_malformed, resolve

# Tags whose inner edges swallow blanks.
TIGHT = (
    "h1 h2 h3 h4 h5 h6 p blockquote article div section ol ul li dl dt dd "
    "table thead tbody tfoot tr td th"
).split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
PREFORMATTED = "pre code kbd samp".split()
SPACE = " \t\r\n"

# Marks the seam between two children while newlines around it are settled.
SEAM = "\uffff"


def attr(node: Column, name: str) -> Column:
    return F.coalesce(node["attrs"][name], F.lit(""))


def is_absolute(node: Column) -> Column:
    """Targets of these schemes stay as written."""
    href, src = node["attrs"]["href"], node["attrs"]["src"]
    return F.when(node["tag"] == "a", href.rlike("^(http://|https://|mailto:|#)")).otherwise(
        src.rlike("^(http://|https://|data:)")
    )


def reference(node: Column) -> Column:
    """href of a link, src of an image; NULL for other nodes."""
    attrs = node["attrs"]
    return F.when(node["tag"] == "a", attrs["href"]).when(node["tag"] == "img", attrs["src"])


def link_target(node: Column, base: Column) -> Column:
    """Where a link or image leads, as it is written into the markdown."""
    return F.when(is_absolute(node), reference(node)).when(
        reference(node) != "", resolve(base, reference(node))
    )


def is_bad_image(node: Column) -> Column:
    bad = (node["tag"] == "img") & ~is_absolute(node) & is_malformed(node["attrs"]["src"])
    return F.coalesce(bad, F.lit(False))


def a_markdown(node: Column, text: Column) -> Column:
    text = strip(text)
    plain = F.concat(F.lit("["), text, F.lit("]("), node["target"])
    # A target that cannot be made sense of leaves the bare text.
    return F.when((text == "") | (attr(node, "href") == "") | node["target"].isNull(), text).otherwise(
        F.concat(plain, _quoted(attr(node, "title")), F.lit(")"))
    )


def img_markdown(node: Column) -> Column:
    return F.when(attr(node, "src") == "", F.lit("")).when(node["target"].isNull(), attr(node, "alt")).otherwise(
        F.concat(
            F.lit("!["), attr(node, "alt"), F.lit("]("), node["target"],
            _quoted(attr(node, "title")), F.lit(")"),
        )
    )


def _quoted(title: Column) -> Column:
    return F.when(title == "", F.lit("")).otherwise(
        F.concat(F.lit(' "'), title, F.lit('"'))
    )


def code_language(pre: Column) -> Column:
    """First class of the block without ``language-``; no class, no language."""
    first = at(pre["classes"], F.lit(0))
    return F.coalesce(F.replace(first, F.lit("language-"), F.lit("")), F.lit(""))


def local_tree(nodes: Column, kept: Column, root: Column, base: Column) -> Column:
    """The kept subtree of ``root``: positions start at 0, children listed per element."""
    span = F.slice(nodes, root["node_id"] + 1, root["end_id"] - root["node_id"] + 1)

    marks = {"in_line": HEADINGS + ["td", "th"], "in_code": PREFORMATTED, "in_pre": ["pre"], "in_li": ["li"]}

    def reaches(span):
        return F.struct(*[covered(span, lambda n, t=t: n["tag"].isin(t)).alias(name) for name, t in marks.items()])

    def above(node, reach):
        """Is an ancestor below the root, or the root, of these tags? It lies before the node and ends behind it."""
        before = F.coalesce(at(reach, node["node_id"] - root["node_id"] - 1), F.lit(-1))
        return before >= node["node_id"]

    def localise(node, reach):
        here = node["node_id"]
        live = at(kept, here)
        element = live & (node["kind"] == "element")
        below = F.slice(nodes, here + 2, node["end_id"] - here)
        kids = F.filter(below, lambda c: (c["parent_id"] == here) & at(kept, c["node_id"]))

        def with_kids(children):
            ids = lambda some: F.transform(some, lambda c: c["node_id"] - root["node_id"])
            return F.struct(
                (here - root["node_id"]).alias("i"),
                (node["end_id"] - root["node_id"]).alias("end"),
                (node["parent_id"] - root["node_id"]).alias("parent"),
                (node["depth"] - root["depth"]).alias("depth"),
                element.alias("element"),
                (node["kind"] == "text").alias("is_text"),
                node["tag"].alias("tag"),
                node["classes"].alias("classes"),
                node["attrs"].alias("attrs"),
                node["text"].alias("text"),
                F.when(element, link_target(node, base)).alias("target"),
                ids(children).alias("kids"),
                F.array_min(
                    ids(F.filter(children, lambda c: c["kind"] == "element"))
                ).alias("first_element"),
                F.when(
                    F.exists(children, lambda c: c["tag"].isin("ul", "ol")),
                    F.array_max(ids(F.filter(
                        children,
                        lambda c: (c["kind"] == "element") | ~is_blank(c["text"]),
                    ))),
                ).alias("last_content"),
                F.when(
                    node["tag"] == "ol",
                    ids(F.filter(children, lambda c: c["tag"] == "li")),
                ).alias("items"),
                *[(element & above(node, reach[name])).alias(name) for name in marks],
            )

        none = F.filter(below, lambda _: F.lit(False))
        return let(F.when(element, kids).otherwise(none), with_kids)

    return let(span, lambda span: let(reaches(span), lambda reach: F.transform(
        span, lambda node: localise(node, reach))))


def _is_tight(tag: Column) -> Column:
    return F.coalesce(tag.isin(TIGHT), F.lit(False))


def _text_piece(text: Column, parent: Column, before: Column, after: Column) -> Column:
    """A text child: blanks settled against its neighbours, special characters escaped."""
    in_pre = parent["in_pre"] | (parent["tag"] == "pre")
    in_code = parent["in_code"] | parent["tag"].isin(PREFORMATTED)
    inside = _is_tight(parent["tag"])

    def beside(sibling):
        return _is_tight(sibling["tag"]) | F.coalesce(sibling["tag"] == "pre", F.lit(False))

    trim_left = beside(before) | (inside & before.isNull())
    trim_right = beside(after) | (inside & after.isNull())
    gone = is_blank(text) & (
        (inside & (before.isNull() | after.isNull())) | beside(before) | beside(after)
    )
    has = lambda *some: F.greatest(*(F.contains(text, F.lit(x)) for x in some))
    flat = F.when(
        has("\n", "\r"), F.regexp_replace(text, r"[\t ]*[\r\n][\t \r\n]*", "\n")
    ).otherwise(text)
    spaced = F.when(has("\n", "\r", "\t", "  "), F.regexp_replace(flat, r"[\t ]+", " ")).otherwise(text)
    escaped = lambda t: F.replace(
        F.replace(t, F.lit("*"), F.lit(r"\*")), F.lit("_"), F.lit(r"\_")
    )
    body = let(F.when(in_pre, text).otherwise(spaced),
               lambda t: F.when(in_code, t).otherwise(escaped(t)))
    left = let(body, lambda t: F.when(trim_left, F.ltrim(t, F.lit(SPACE))).otherwise(t))
    trimmed = let(left, lambda t: F.when(trim_right, rstrip(t)).otherwise(t))
    return F.when(gone, F.lit("")).otherwise(trimmed)


def _join(pieces: Column, parent: Column) -> Column:
    """Newlines that meet at a seam become the larger of the two runs, two at most."""
    def settle(text):
        for before, after in (("\n\n", "\n\n"), ("\n\n", "\n"), ("\n", "\n\n"), ("\n", "\n")):
            met = F.lit(before + SEAM + after)
            text = F.replace(text, met, F.lit(max(before, after, key=len)))
        return F.replace(text, F.lit(SEAM), F.lit(""))

    def joined(text):
        blocks = F.contains(text, F.lit("\n" + SEAM + "\n"))
        return F.when(blocks, settle(text)).otherwise(F.replace(text, F.lit(SEAM), F.lit("")))

    return F.when(
        parent["in_pre"] | (parent["tag"] == "pre"), F.array_join(pieces, "")
    ).otherwise(let(F.array_join(pieces, SEAM), joined))


def _spaced_mark(text: Column, mark: str, node: Column) -> Column:
    """Inline markup: edge blanks move outside the marks."""
    def marked(core):
        edge = lambda found: F.when(found, F.lit(" ")).otherwise(F.lit(""))
        return F.when(core == "", F.lit("")).otherwise(
            F.concat(
                edge(F.startswith(text, F.lit(" "))), F.lit(mark), core, F.lit(mark),
                edge(F.endswith(text, F.lit(" "))),
            )
        )

    return F.when(node["in_code"], text).otherwise(let(strip(text), marked))


def _indent(text: Column, by: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), by))


def _li(node: Column, text: Column, tree: Column) -> Column:
    parent = at(tree, node["parent"])
    start = F.coalesce(
        F.when(attr(parent, "start").rlike("^[0-9]+$"), parent["attrs"]["start"]).try_cast("long"),
        F.lit(1),
    )
    position = F.array_position(parent["items"], node["i"]) - 1
    bullet = F.when(
        parent["tag"] == "ol", F.concat((start + position).cast("string"), F.lit(". "))
    ).otherwise(F.lit("- "))

    def item(core):
        return let(
            bullet,
            lambda b: F.concat(b, _indent(core, F.repeat(F.lit(" "), F.length(b))), F.lit("\n")),
        )

    return let(strip(text), lambda core: F.when(core == "", F.lit("\n")).otherwise(item(core)))


def _width(cell: Column) -> Column:
    span = attr(cell, "colspan")
    return F.when(
        span.rlike("^[0-9]{1,9}$"),
        F.greatest(F.lit(1), F.least(F.lit(1000), span.try_cast("int"))),
    ).otherwise(F.lit(1))


def _tr(node: Column, text: Column, tree: Column) -> Column:
    parent = at(tree, node["parent"])
    table = at(tree, parent["parent"])

    def inner(of, tags):
        return F.filter(
            F.slice(tree, of["i"] + 2, of["end"] - of["i"]),
            lambda c: c["element"] & c["tag"].isin(tags),
        )

    def ruled(cells):
        width = F.aggregate(cells, F.lit(0), lambda n, c: n + _width(c))
        rule = lambda cell: F.concat(
            F.lit("| "), F.array_join(F.array_repeat(F.lit(cell), width), " | "), F.lit(" |\n")
        )
        in_thead = F.coalesce(parent["tag"] == "thead", F.lit(False))
        head = F.forall(cells, lambda c: c["tag"] == "th") | (
            in_thead & (F.size(inner(parent, ["tr"])) == 1)
        )
        in_tbody = F.coalesce(parent["tag"] == "tbody", F.lit(False))
        no_head = ~in_tbody | (F.size(inner(table, ["thead"])) < 1)
        opens_table = F.coalesce(parent["tag"] == "table", F.lit(False)) | (
            in_tbody & F.coalesce(at(table["kids"], F.lit(0)) == parent["i"], F.lit(True))
        )
        return (
            F.when(head, F.concat(F.lit("|"), text, F.lit("\n"), rule("---")))
            .when(
                F.coalesce(no_head, F.lit(True)) | opens_table,
                F.concat(rule(""), rule("---"), F.lit("|"), text, F.lit("\n")),
            )
            .otherwise(F.concat(F.lit("|"), text, F.lit("\n")))
        )

    first = F.coalesce(parent["first_element"] == node["i"], F.lit(True))
    return F.when(first, let(inner(node, ["td", "th"]), ruled)).otherwise(
        F.concat(F.lit("|"), text, F.lit("\n"))
    )


def _apply_tag(node: Column, text: Column, tree: Column) -> Column:
    tag, lit, core = node["tag"], F.lit, strip(text)
    in_line = lambda t: F.concat(lit(" "), t, lit(" "))
    block = lambda t: let(
        t,
        lambda c: F.when(node["in_line"], in_line(c))
        .when(c == "", lit(""))
        .otherwise(F.concat(lit("\n\n"), c, lit("\n\n"))),
    )
    one_line = F.regexp_replace(core, r"[\t \r\n]+", " ")
    last = F.coalesce(
        at(tree, node["parent"])["last_content"] == node["i"], node["parent"] < 0, lit(True)
    )
    return (
        F.when(tag.isin("b", "strong"), _spaced_mark(text, "**", node))
        .when(tag.isin("i", "em"), _spaced_mark(text, "*", node))
        .when(tag.isin("del", "s"), _spaced_mark(text, "~~", node))
        .when(tag.isin("sub", "sup"), _spaced_mark(text, "", node))
        .when(tag.isin("code", "kbd", "samp"), _spaced_mark(text, "`", node))
        .when(tag == "a", a_markdown(node, text))
        .when(tag == "img", img_markdown(node))
        .when(tag == "br", F.when(node["in_line"], lit(" ")).otherwise(lit("  \n")))
        .when(tag == "hr", lit("\n\n---\n\n"))
        .when(tag == "p", block(F.btrim(text, lit(SPACE))))
        .when(tag.isin("div", "article", "section", "dl"), block(core))
        .when(
            tag.isin(HEADINGS),
            F.when(node["in_line"], text).otherwise(
                F.concat(
                    lit("\n\n"), F.repeat(lit("#"), F.substring(tag, 2, 1).cast("int")),
                    lit(" "), one_line, lit("\n\n"),
                )
            ),
        )
        .when(
            tag.isin("ul", "ol"),
            F.when(node["in_li"], F.concat(lit("\n"), rstrip(text))).otherwise(
                F.concat(lit("\n\n"), text, F.when(last, lit("")).otherwise(lit("\n")))
            ),
        )
        .when(tag == "li", _li(node, text, tree))
        .when(
            tag == "blockquote",
            F.when(node["in_line"], in_line(core))
            .when(core == "", lit("\n"))
            .otherwise(F.concat(lit("\n> "), _indent(core, lit("> ")), lit("\n\n"))),
        )
        .when(
            tag == "pre",
            F.when(text == "", lit("")).otherwise(
                F.concat(lit("\n\n```"), code_language(node), lit("\n"), text, lit("\n```\n\n"))
            ),
        )
        .when(tag == "q", F.concat(lit('"'), text, lit('"')))
        .when(tag == "table", F.concat(lit("\n\n"), core, lit("\n\n")))
        .when(tag == "tr", _tr(node, text, tree))
        .when(
            tag.isin("td", "th"),
            F.concat(
                lit(" "), F.replace(core, lit("\n"), lit(" ")),
                F.repeat(lit(" |"), _width(node)),
            ),
        )
        .when(tag == "caption", F.concat(core, lit("\n\n")))
        .when(tag == "figcaption", F.concat(lit("\n\n"), core, lit("\n\n")))
        .when(
            tag == "dt",
            F.when(node["in_line"], in_line(one_line))
            .when(core == "", lit("\n"))
            .otherwise(F.concat(lit("\n\n"), one_line, lit("\n"))),
        )
        .when(
            tag == "dd",
            F.when(node["in_line"], in_line(core))
            .when(core == "", lit("\n"))
            .otherwise(F.concat(lit(":   "), _indent(core, lit("    ")), lit("\n"))),
        )
        .when(tag.isin("script", "style"), lit(""))
        .otherwise(text)
    )


def render(nodes: Column, kept: Column, root: Column, base: Column, tag_rules=()) -> Column:
    """Markdown of the kept subtree of ``root`` (a node), before tidying."""

    def convert(node, text, tree):
        own = F
        for tag, rule in tag_rules:
            own = own.when(node["tag"] == tag, rule(node, text))
        return own.otherwise(_apply_tag(node, text, tree)) if tag_rules else _apply_tag(node, text, tree)

    def fold(tree):
        def piece(done, node, kid, place):
            kid_at = lambda step: at(tree, at(node["kids"], place + step))
            return let(
                at(tree, kid),
                lambda c: F.when(
                    c["is_text"],
                    let(F.struct(kid_at(-1).alias("before"), kid_at(1).alias("after")),
                        lambda s: _text_piece(c["text"], node, s["before"], s["after"])),
                ).otherwise(at(done, kid)),
            )

        def element(done, node):
            pieces = F.filter(
                F.transform(node["kids"], lambda kid, place: piece(done, node, kid, place)),
                lambda s: s != "",
            )
            return let(_join(pieces, node), lambda text: convert(node, text, tree))

        def level(done, depth):
            return F.transform(
                tree,
                lambda n: F.when(n["element"] & (n["depth"] == depth), element(done, n))
                .otherwise(at(done, n["i"])),
            )

        deepest = F.array_max(F.transform(tree, lambda n: n["depth"]))
        blank = F.transform(tree, lambda _: F.lit(""))
        return at(F.aggregate(F.sequence(deepest, F.lit(0), F.lit(-1)), blank, level), F.lit(0))

    return let(local_tree(nodes, kept, root, base), fold)
