"""HTML to node rows: the one stage that needs Python.

``shred`` parses every page once, in Arrow batches, and adds an array column
``nodes`` holding the page's tree in document order. Everything after it is
built-in Spark expressions over that array, so nothing is shuffled: a page's
nodes never leave the task that read the page.

``node_id`` is the position in the array; a subtree is ``node_id .. end_id``.
"""

from __future__ import annotations

import html as entities
import re
import sys
from bisect import bisect_left

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

NODE_FIELDS = (
    "struct<node_id:int,end_id:int,parent_id:int,depth:int,kind:string,tag:string,"
    "classes:array<string>,attrs:map<string,string>,text:string>"
)

# Executors need no copy of this package: the parser travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tags without an end tag (HTML 4).
VOID = frozenset("area base basefont br col frame hr img input isindex link meta param".split())
HEAD_ONLY = frozenset("script style meta link title base".split())
BLOCKS = "address blockquote center dd dir div dl dt h1 h2 h3 h4 h5 h6 hr li menu ol p pre table ul"
HEADING_ENDS = "fieldset form li p table"

# An open tag (left) ends when one of the tags on the right starts.
ENDS_AT = {
    "p": BLOCKS + " body caption col colgroup tbody td tfoot th title tr",
    "b": "center p td th",
    "i": "center",
    "u": "p td th",
    "big": "p", "s": "p", "small": "p", "strike": "p", "tt": "p",
    "font": "center td th",
    "span": "td th",
    "a": "a fieldset table td th",
    "h1": HEADING_ENDS, "h2": HEADING_ENDS, "h3": HEADING_ENDS,
    "h4": HEADING_ENDS, "h5": HEADING_ENDS, "h6": HEADING_ENDS,
    "pre": "dd dl dt fieldset form li table ul",
    "li": "li",
    "dt": "dd dl", "dd": "dt",
    "dl": "form li",
    "option": "optgroup option",
    "caption": "col colgroup tbody tfoot thead tr",
    "colgroup": "colgroup tbody tfoot thead tr",
    "td": "tbody td tfoot th tr", "th": "tbody td tfoot th tr",
    "tr": "tbody tfoot tr",
    "thead": "tbody tfoot", "tbody": "tbody tfoot", "tfoot": "tbody",
    "title": "body", "script": "noscript", "form": "form", "legend": "fieldset",
}
ENDS_AT = {tag: frozenset(ends.split()) for tag, ends in ENDS_AT.items()}

# An end tag cannot reach past an open tag of higher rank.
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}

# A start tag: the first ">" outside quotes ends it.
START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
END_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
NAME_STOP = re.compile(r"[\s/>]")
SPECIAL = re.compile(r"[>\"']")
ATTR = re.compile(
    r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S
)
RAW_END = {tag: re.compile(rf"</{tag}", re.I) for tag in ("script", "style")}

# An output batch is closed once it holds this many characters or nodes. Lists of a batch take many times its
# size, so that a worker's memory goes by these bounds.
BATCH_CHARS = 1_000_000
BATCH_NODES = 10_000


class TagEnds:
    """Where tags end, for pages with broken ones: every answer is found once, so reading stays linear.

    Seen from outside quotes, the way on from a special character is always the
    same: a ">" ends the tag, a quote leads behind the next one of its kind.
    """

    def __init__(self, source: str):
        self.places = [m.start() for m in SPECIAL.finditer(source)]
        self.ends = [-1] * (len(self.places) + 1)
        following = {}
        for k in range(len(self.places) - 1, -1, -1):
            sign = source[self.places[k]]
            if sign == ">":
                self.ends[k] = self.places[k]
            else:
                if sign in following:
                    self.ends[k] = self.ends[following[sign] + 1]
                following[sign] = k
        self.source, self.stop = source, -1

    def after(self, at: int) -> int:
        """Position of the ">" that ends a tag whose name begins at ``at``; -1 if none does. ``at`` only grows."""
        if self.stop < at:
            found = NAME_STOP.search(self.source, at)
            self.stop = found.start() if found else len(self.source)
        return self.ends[bisect_left(self.places, self.stop)]


class TreeWriter:
    """Appends the nodes of one page after another to flat column lists."""

    def __init__(self):
        self.offsets = [0]
        self.node_id, self.end_id, self.parent_id, self.depth = [], [], [], []
        self.kind, self.tag, self.text = [], [], []
        self.keys, self.values, self.attr_offsets = [], [], [0]
        self.classes, self.class_offsets = [], [0]
        self.chars = 0

    def add(self, kind, tag=None, text=None, attrs=()):
        local = len(self.node_id) - self.offsets[-1]
        self.node_id.append(local)
        self.end_id.append(local)
        self.parent_id.append(self.open[-1] if self.open else -1)
        self.depth.append(len(self.open))
        self.kind.append(kind)
        self.tag.append(tag)
        self.text.append(text)
        self.chars += len(text or "")
        for key, value in attrs:
            self.keys.append(key)
            self.values.append(value)
            if key == "class":
                self.classes.extend(value.split())
        self.class_offsets.append(len(self.classes))
        self.attr_offsets.append(len(self.keys))
        return local

    def push(self, tag, attrs=()):
        self.open.append(self.add("element", tag, attrs=attrs))
        self.open_tags.append(tag)

    def pop(self):
        base = self.offsets[-1]
        self.end_id[base + self.open.pop()] = len(self.node_id) - base - 1
        self.open_tags.pop()

    def page(self, source):
        self.open, self.open_tags, self.seen = [], [], set()
        if source:
            # U+FFFF is no legal character; later stages use it as a mark.
            self.read(source.replace("\r\n", "\n").replace("\uffff", ""))
        while self.open:
            self.pop()
        self.offsets.append(len(self.node_id))

    def read(self, source):
        at = begin = 0  # begin: of text that is not yet added
        ends, closed, length = None, True, len(source)  # closed: a ">" may still lie ahead

        def text_until(stop):
            if stop > begin:
                self.characters(source[begin:stop])

        while (at := source.find("<", at)) >= 0:
            sign = source[at + 1:at + 2]
            if sign.isascii() and sign.isalpha():
                tag = START.match(source, at) if ends is None else None
                if tag:
                    stop, name, attrs = tag.end(), tag[1], tag[2]
                else:
                    ends = ends or TagEnds(source)
                    stop = ends.after(at + 1) + 1
                    if not stop:
                        at += 1
                        continue
                    name, attrs = source[at + 1:ends.stop], source[ends.stop:stop - 1]
                text_until(at)
                at = begin = stop
                name = name.lower()
                self.start(name, attrs)
                if name in RAW_END and self.open_tags and self.open_tags[-1] == name:
                    close = RAW_END[name].search(source, at)
                    at = close.start() if close else length
                    if at > begin:
                        self.add("raw", text=source[begin:at])
                    begin = at
            elif source.startswith("<!--", at):
                text_until(at)
                stop = source.find("-->", at + 4)
                self.add("comment", text=source[at + 4:stop if stop >= 0 else length])
                at = begin = stop + 3 if stop >= 0 else length
            else:
                name = END_NAME.match(source, at + 2) if sign == "/" and closed else None
                stop = source.find(">", at + 2) if closed and (name or sign in ("!", "?")) else -1
                if stop < 0:
                    closed = closed and not (name or sign in ("!", "?"))
                    at += 1
                    continue
                text_until(at)
                at = begin = stop + 1
                if name:
                    self.end(name[0].lower())
        text_until(length)

    def characters(self, text):
        text = entities.unescape(text)
        if not self.open or self.open_tags[-1] in ("html", "head"):
            if not text.strip():
                return
            self.start("p", "")
        self.add("text", text=text)

    def imply(self, tag):
        if not self.open:
            self.push("html")
        if tag in HEAD_ONLY and "body" not in self.seen and len(self.open) == 1:
            if "head" not in self.seen:
                self.seen.add("head")
                self.push("head")
        elif tag not in HEAD_ONLY and "body" not in self.seen and tag not in (
            "head", "body", "frameset", "frame", "noframes"
        ):
            self.seen.add("body")
            self.push("body")

    def start(self, tag, attr_source):
        tags = self.open_tags
        if tag == "html":
            if tags or "html" in self.seen:
                return
        elif tag in ("head", "body") and tag in self.seen:
            return
        while tags and (
            tag in ENDS_AT.get(tags[-1], ()) or (tags[-1] == "head" and tag not in HEAD_ONLY)
        ):
            self.pop()
        if tag != "html":
            self.imply(tag)
        if tag in ("html", "head", "body"):
            self.seen.add(tag)
        attrs, rest = {}, 0
        for found in ATTR.finditer(attr_source):
            value = found[2] or found[3] or found[4] or ""
            attrs.setdefault(found[1].lower(), entities.unescape(value))
            rest = found.end()
        if tag in VOID or "/" in attr_source[rest:]:
            self.add("element", tag, attrs=attrs.items())
        else:
            self.push(tag, attrs.items())

    def end(self, tag):
        # Text after </body> or </html> still belongs to the body.
        if tag in ("body", "html") or tag in VOID:
            return
        rank = END_RANK.get(tag, 100)
        for back, name in enumerate(reversed(self.open_tags)):
            if name == tag:
                for _ in range(back + 1):
                    self.pop()
                return
            if END_RANK.get(name, 100) > rank:
                return

    def column(self):
        def ints(values):
            return pa.array(values, pa.int32())

        def texts(values):
            return pa.array(values, pa.string())

        attrs = pa.MapArray.from_arrays(
            ints(self.attr_offsets), texts(self.keys), texts(self.values)
        )
        classes = pa.ListArray.from_arrays(ints(self.class_offsets), texts(self.classes))
        columns = [
            ints(self.node_id), ints(self.end_id), ints(self.parent_id), ints(self.depth),
            texts(self.kind), texts(self.tag), classes, attrs, texts(self.text),
        ]
        names = "node_id end_id parent_id depth kind tag classes attrs text".split()
        return pa.ListArray.from_arrays(
            ints(self.offsets), pa.StructArray.from_arrays(columns, names)
        )


def parsed(batches, html: str, kept: list[str]):
    """Arrow batches with ``kept`` and ``nodes``, of bounded size whatever the size of the batches read."""
    for batch in batches:
        source = batch.column(batch.schema.get_field_index(html))
        begin, writer = 0, TreeWriter()
        for row in range(batch.num_rows):
            writer.page(source[row].as_py())
            full = writer.chars > BATCH_CHARS or len(writer.node_id) > BATCH_NODES
            if full or row + 1 == batch.num_rows:
                part = batch.slice(begin, row + 1 - begin)
                columns = [part.column(part.schema.get_field_index(n)) for n in kept]
                yield pa.RecordBatch.from_arrays(columns + [writer.column()], names=kept + ["nodes"])
                begin, writer = row + 1, TreeWriter()


def shred(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the ``html`` column by ``nodes``; all other columns are kept."""
    kept = [name for name in pages.columns if name != html]
    schema = T.StructType(
        [field for field in pages.schema if field.name != html]
        + [T.StructField("nodes", T._parse_datatype_string(f"array<{NODE_FIELDS}>"))]
    )

    return pages.mapInArrow(lambda batches: parsed(batches, html, kept), schema)


def node_rows(shredded: DataFrame) -> DataFrame:
    """One row per node; a narrow explode, for queries that want plain rows."""
    others = [c for c in shredded.columns if c != "nodes"]
    return shredded.select(*others, F.explode("nodes").alias("node")).select(*others, "node.*")
