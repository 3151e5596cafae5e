"""Substring dedup: long word sequences that a document with a smaller id has, too.

The text is read as a De Bruijn graph of token k-mers. Of the k-mers each window of ``window`` words
chooses one (see ``anchors``) as a node; the words of all windows that chose it
are its edge. A sequence that two documents share gives the same nodes and
edges in both.

1. Nodes that one document alone has are left out by a join with the repeated k-mers.
2. Equal edges are grouped: the smallest doc_id of each. Along a repeated
   nonbranching path every node has one edge, and a join with these groups settles all windows of
   the path in every later document at once.
3. Where a node has several edges the path branches: there the windows of each distinct edge are compared one
   by one, from its first document only.
4. The found stretches go back to their documents by source coordinates. They are verified against the
   words there, joined to maximal spans and removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.anchors import Sums, contexts, find_all, groups_of
from pagemill.llm.common import arrow_rows, sha256_hex
from pagemill.session import stored

LAST = (1 << 63) - 1  # stands for a null id: after all others


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII blanks, unchanged."""
    return (text or "").encode().split()


def _values(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_64_intdigest
    lengths = np.array([len(w) for w in words], np.int64)
    return np.fromiter((digest(w) for ws in words for w in ws), np.uint64, int(lengths.sum())), lengths


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_NODE = [("at", pa.int64()), ("node", pa.int64()), ("edge", pa.int64()), ("place", pa.int32()),
         ("first", pa.int32()), ("last", pa.int32())]


def _nodes(docs: DataFrame, window: int, k: int) -> DataFrame:
    """One row a node of each document: at, node and edge hashes, word positions."""
    schema = pa.schema(_NODE)

    def run(at, text):
        words = [words_of(t) for t in text]
        out = [[] for _ in schema]
        for begin, end in groups_of([len(w) for w in words]):
            values, lengths = _values(words[begin:end])
            found = find_all(values, lengths, window, k, Sums(values))
            base = (np.cumsum(lengths) - lengths)[found.text]
            for column, x in zip(out, (
                np.array(at[begin:end], np.int64)[found.text], _signed(found.kmer), _signed(found.context),
                found.place - base, found.first - base, found.last - base,
            )):
                column.append(x)
        return [np.concatenate(c) if c else [] for c in out]

    return docs.select("at", "text").mapInArrow(
        lambda b: arrow_rows(b, schema, run), "at long, node long, edge long, place int, first int, last int")


def _windows(docs: DataFrame, spots: DataFrame, window: int) -> DataFrame:
    """The windows of branching edges: at, node, place, start and the window's hash."""
    names = ("at", "node", "edge", "place", "first", "last", "start", "hash")
    schema = pa.schema(_NODE + [("start", pa.int32()), ("hash", pa.int64())])
    joined = docs.join(spots, "at").select("at", "text", "spots")

    def run(at, text, spots):
        out = {n: [] for n in names}
        for a, t, found in zip(at, text, spots):
            values, _ = _values([words_of(t)])
            sums = Sums(values)
            for s in found:
                if not _verified(sums, s, window, len(values)):
                    continue  # another text of the same id
                starts = np.arange(s["first"], s["last"] + 1)
                rows = len(starts)
                for n in ("node", "edge", "place", "first", "last"):
                    out[n] += [s[n]] * rows
                out["at"] += [a] * rows
                out["start"] += starts.tolist()
                out["hash"] += _signed(sums.hashes(starts, starts + window)).tolist()
        return [out[n] for n in names]

    return joined.mapInArrow(
        lambda b: arrow_rows(b, schema, run),
        "at long, node long, edge long, place int, first int, last int, start int, hash long")


def _verified(sums: Sums, spot: dict, window: int, n: int) -> bool:
    """The words at the coordinates are the edge's."""
    if spot["last"] + window > n:
        return False
    place, first, last = (np.array([spot[c]]) for c in ("place", "first", "last"))
    return int(_signed(contexts(sums, place, first, last, window))[0]) == spot["edge"]


def repeated_spans(docs: DataFrame, window: int = 50, k: int = 26) -> DataFrame:
    """row (all columns), at, text, found: the stretches of each document that an earlier one has, not yet verified."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"),
                       F.col("text").cast("string").alias("text"))
    texts = rows.select("at", "text")
    nodes = stored(_nodes(texts, window, k), "nodes")
    shared = nodes.groupBy("node").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low < high")
    # Written tables on the small side leave two plain exchanges below the joins, which Spark splits where one
    # node, of a passage that many documents share, has a large part of all rows.
    shared = stored(shared.select("node"), "repeated")
    nodes = stored(nodes.join(shared, "node"), "shared-nodes")
    edges = stored(nodes.groupBy("node", "edge").agg(F.min("at").alias("first_at")), "edges")
    branching = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    marked = nodes.join(edges, ["node", "edge"])
    later = marked.where(F.col("at") > F.col("first_at")).select(
        "at", "edge", "place", "first", "last", F.lit(None).cast("array<int>").alias("starts"))
    spots = (
        marked.where(F.col("at") == F.col("first_at")).join(branching, "node")
        .groupBy("at").agg(F.collect_list(F.struct("node", "edge", "place", "first", "last")).alias("spots"))
    )
    windows = stored(_windows(texts, spots, window), "windows")
    key = ["node", F.expr("place - start").alias("offset"), "hash"]
    owners = windows.groupBy(*key).agg(F.min("at").alias("owner"), F.max("at").alias("other")).where("owner < other")
    inner = (
        windows.withColumn("offset", F.expr("place - start")).join(owners, ["node", "offset", "hash"])
        .where(F.col("at") > F.col("owner"))
        .groupBy("at", "edge", "place", "first", "last").agg(F.collect_list("start").alias("starts"))
    )
    told = later.unionByName(inner).groupBy("at").agg(
        F.collect_list(F.struct("edge", "place", "first", "last", "starts")).alias("found"))
    return rows.join(told, "at", "left")


def _covered(values: np.ndarray, found: list[dict], window: int) -> np.ndarray:
    """Boolean for each word: covered by a verified stretch."""
    sums = Sums(values)
    edge = np.zeros(len(values) + 1, np.int64)
    for s in found:
        if not _verified(sums, s, window, len(values)):
            continue
        if s["starts"] is None:
            edge[s["first"]] += 1
            edge[s["last"] + window] -= 1
        else:
            starts = np.array(s["starts"])
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 26) -> DataFrame:
    """doc_id, n_words, n_removed, spans, text (kept words joined by one blank), kept_sha256 for every row.

    A word goes if it lies in ``window`` consecutive words that also start, word for word, in a document with a smaller
    doc_id. Windows are judged on the input. Null, empty and blank texts have no words; texts shorter than a
    window lose none. A null doc_id counts as larger than all others. Rows of one doc_id are one place: none of
    them takes words from the other. Other columns are left out. ``spans`` are the removed runs, in words.
    """
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(span)), ("text", pa.string()), ("kept_sha256", pa.string())])

    def run(doc_id, text, found):
        out = []
        for d, t, f in zip(doc_id, text, found):
            words = words_of(t)
            spans, kept = [], words
            if f and words:
                gone = _covered(_values([words])[0], f, window)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = [{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            left = b" ".join(kept)
            out.append((d, len(words), len(words) - len(kept), spans, left.decode(), sha256_hex(left)))
        return tuple(zip(*out)) or ((),) * len(schema)

    return repeated_spans(docs, window, k).select("row.doc_id", "text", "found").mapInArrow(
        lambda b: arrow_rows(b, schema, run),
        "doc_id long, n_words long, n_removed long, spans array<struct<begin: long, end: long>>, text string,"
        " kept_sha256 string")
