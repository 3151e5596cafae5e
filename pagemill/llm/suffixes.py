"""Substring dedup on bytes: sorted suffix runs, front-coded, merged by loser trees.

Sorting all suffixes of a corpus moves many times its size. Equal strings of ``window`` bytes
choose equal anchors (see ``anchors``), so suffixes that start at anchors are enough:
each carries the bytes before it that its windows reach. The steps:

1. Documents are dealt out in groups of bounded bytes. Each group sends its distinct anchor
   k-mer hashes to the range they belong to; ranges send back those that occur twice.
2. Each group sorts the suffixes at repeated anchors, joins equal ones (the earliest stays, the
   later ones are covered), front-codes the sorted run (length of the prefix shared with the one before, and
   the rest) and sends it to the range of its k-mer, one run a range.
3. Each range merges its runs by a loser tree that holds, for every head, the prefix length it shares with the
   last output. Heads of different lengths are decided by these alone, and equal ones are
   compared from there on, so no known prefix is compared again. The merged order comes with the
   shared prefix lengths of its neighbours.
4. A window reaching l bytes before its anchor occurs twice if two suffixes share window - l
   bytes and the l bytes before. For every l these classes are cut from the shared prefix lengths of
   both sorted orders; in each class all but the earliest are covered.
5. Covered ranges return to the documents of their group.

A string that millions of documents share is one entry in each group, so no range is hot.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.anchors import Sums, find_all, groups_of, mix64
from pagemill.llm.common import sha256_hex

LAST = (1 << 63) - 1  # stands for a null id: after all others
GROUP_BYTES = 8_000_000
_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

_ENTRY = np.dtype([("at", "<i8"), ("row", "<i4"), ("place", "<i8"), ("low", "<u2"), ("high", "<u2"),
                   ("shared", "<u2"), ("rest", "<u2")])
_COVER = np.dtype([("row", "<i4"), ("begin", "<i8"), ("end", "<i8")])


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of a group by id, then text: the order in which "earlier" is meant."""
    return frame.assign(text=frame["text"].fillna("")).sort_values(["at", "text"], kind="stable", ignore_index=True)


def _anchors(frame: pd.DataFrame, window: int, k: int):
    """(row numbers, bytes, Anchors, begin of each row) for runs of a group's texts."""
    data = [t.encode() for t in frame["text"]]
    for begin, end in groups_of([len(d) for d in data]):
        whole = b"".join(data[begin:end])
        lengths = np.array([len(d) for d in data[begin:end]], np.int64)
        values = _SYMBOLS[np.frombuffer(whole, np.uint8)]
        if len(whole) >= window:
            yield begin, whole, find_all(values, lengths, window, k, Sums(values)), np.cumsum(lengths) - lengths


def _pieces(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range each hash belongs to."""
    return (mix64(hashes) % np.uint64(ranges)).astype(np.int64)


def _send_hashes(window: int, k: int, ranges: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        kmers = [a.kmer for _, _, a, _ in _anchors(_in_order(frame), window, k)]
        out = []
        if kmers:
            unique, counts = np.unique(np.concatenate(kmers), return_counts=True)
            piece = _pieces(unique, ranges)
            order = np.argsort(piece, kind="stable")
            cuts = np.searchsorted(piece[order], np.arange(ranges + 1))
            for r in range(ranges):
                mine = order[cuts[r]:cuts[r + 1]]
                if len(mine):
                    out.append((r, key[0], unique[mine].tobytes(), np.packbits(counts[mine] > 1).tobytes()))
        return pd.DataFrame(out, columns=["range", "part", "hashes", "twice"])

    return run


def _repeated(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Hashes of a range that two groups have, or one of them twice, back to every group that has them."""
    hashes = [np.frombuffer(h, np.uint64) for h in frame["hashes"]]
    twice = [np.unpackbits(np.frombuffer(t, np.uint8))[:len(h)].astype(bool) for t, h in zip(frame["twice"], hashes)]
    together = np.sort(np.concatenate(hashes))
    several = np.unique(np.concatenate([together[1:][together[1:] == together[:-1]],
                                        *[h[t] for h, t in zip(hashes, twice)]]))
    out = []
    for part, h in zip(frame["part"], hashes):
        found = h[np.isin(h, several, assume_unique=True)]
        if len(found):
            out.append((part, found.tobytes()))
    return pd.DataFrame(out, columns=["part", "hashes"])


def shared_length(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the prefix two strings share, of which ``known`` bytes are known to be."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_coded(sorted_strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared = [0] + [shared_length(a, b) for a, b in zip(sorted_strings, sorted_strings[1:])]
    return shared, [s[n:] for s, n in zip(sorted_strings, shared)]


def merge_runs(runs: list[tuple[list[int], list[bytes]]]):
    """(run, number in it, length shared with the output before, string) of all strings of front-coded runs, in order."""
    width = 1
    while width < len(runs):
        width *= 2
    done = [not r[1] for r in runs] + [True] * (width - len(runs))
    heads = [r[1][0] if r[1] else b"" for r in runs] + [b""] * (width - len(runs))
    shared = [0] * width  # of each head with the last output
    number = [0] * width
    losers = [0] * width

    def winner(a: int, b: int) -> tuple[int, int]:
        """(smaller head, other head); the other's shared length is renewed if bytes had to be compared."""
        if done[a] or done[b]:
            return (b, a) if done[a] else (a, b)
        if shared[a] != shared[b]:  # the one closer to the last output is smaller
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a], heads[b]
        n = shared_length(x, y, shared[a])
        if len(x) == n or (len(y) > n and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width
        best, losers[node] = winner(build(2 * node), build(2 * node + 1))
        return best

    best = build(1) if width > 1 else 0
    while not done[best]:
        yield best, number[best], shared[best], heads[best]
        lengths, rests = runs[best]
        number[best] += 1
        at = number[best]
        if at < len(rests):
            shared[best] = lengths[at]
            heads[best] = heads[best][:lengths[at]] + rests[at]
        else:
            done[best] = True
        node = (best + width) // 2
        while node:
            best, losers[node] = winner(best, losers[node])
            node //= 2


def _send_runs(window: int, k: int, ranges: int):
    def run(key: tuple, docs: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
        part, out = key[0], []
        wanted = np.sort(np.concatenate([np.frombuffer(h, np.uint64) for h in repeated["hashes"]] or
                                        [np.zeros(0, np.uint64)]))
        frame = _in_order(docs) if len(wanted) else docs.head(0)
        ids = frame["at"].to_numpy()
        seen: set[tuple[int, int]] = set()
        covers, entries = [], [[] for _ in range(ranges)]
        for begin, whole, found, starts in (_anchors(frame, window, k) if len(wanted) else ()):
            at = np.minimum(np.searchsorted(wanted, found.kmer), len(wanted) - 1)
            some = np.flatnonzero(wanted[at] == found.kmer)
            piece = _pieces(found.kmer[some], ranges)
            for text, place, first, last, kmer, context, r in zip(
                    found.text[some].tolist(), found.place[some].tolist(), found.first[some].tolist(),
                    found.last[some].tolist(), found.kmer[some].tolist(), found.context[some].tolist(), piece.tolist()):
                base, row = int(starts[text]), begin + text
                if (kmer, context) in seen:  # an earlier text of this group has all these windows
                    covers.append((row, first - base, last + window - base))
                    continue
                seen.add((kmer, context))
                entries[r].append((whole[place:last + window], whole[first:place][::-1],
                                   int(ids[row]), row, place - base, place - last))
        for r, mine in enumerate(entries):
            if not mine:
                continue
            mine.sort(key=lambda e: e[0])
            shared, rests = front_coded([e[0] for e in mine])
            table = np.zeros(len(mine), _ENTRY)
            for name, column in (("at", [e[2] for e in mine]), ("row", [e[3] for e in mine]),
                                 ("place", [e[4] for e in mine]), ("low", [e[5] for e in mine]),
                                 ("high", [len(e[1]) for e in mine]), ("shared", shared), ("rest", list(map(len, rests)))):
                table[name] = column
            out.append((r, part, table.tobytes(), b"".join(rests), b"".join(e[1] for e in mine), b""))
        if covers:
            out.append((part % ranges, part, b"", b"", b"", np.array(covers, _COVER).tobytes()))
        return pd.DataFrame(out, columns=["range", "part", "entries", "rests", "before", "covers"])

    return run


def _cut(data: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [data[a:b] for a, b in zip([0] + ends[:-1], ends)]


def _merge(window: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = [(p, c) for p, c in zip(frame["part"], frame["covers"]) if c]
        frame = frame[frame["entries"].map(len) > 0]
        if len(frame):
            tables = [np.frombuffer(e, _ENTRY) for e in frame["entries"]]
            runs = [(t["shared"].tolist(), _cut(r, t["rest"])) for t, r in zip(tables, frame["rests"])]
            offsets = np.cumsum([0] + [len(t) for t in tables])
            order, shared = [], []
            for r, n, length, _ in merge_runs(runs):
                order.append(offsets[r] + n)
                shared.append(length)
            del runs
            entries = np.concatenate(tables)[order]
            part = np.repeat(frame["part"].to_numpy(), [len(t) for t in tables])[order]
            before = [b for t, data in zip(tables, frame["before"]) for b in _cut(data, t["high"])]
            before = [before[i] for i in order]
            for p, rows in _covered(entries, part, np.array(shared), before, window):
                out.append((p, rows.tobytes()))
        return pd.DataFrame(out, columns=["part", "covers"])

    return run


def _covered(entries: np.ndarray, part: np.ndarray, shared: np.ndarray, before: list[bytes], window: int):
    """(group, covers): windows whose class holds an earlier entry. ``shared`` goes with the order of the entries."""
    n = len(entries)
    by_left = sorted(range(n), key=before.__getitem__)
    left_shared = np.array([0] + [shared_length(before[a], before[b]) for a, b in zip(by_left, by_left[1:])])
    rank = np.empty(n, np.int64)
    rank[np.lexsort((entries["place"], entries["row"], part, entries["at"]))] = np.arange(n)
    low, high = entries["low"].astype(np.int64), entries["high"].astype(np.int64)
    most = int(high.max(initial=0))
    flags = np.zeros((n, most + 3), bool)  # column l + 1: the window reaching l bytes before is covered
    left_class = np.empty(n, np.int64)
    for reach in range(most + 1):
        mine = np.flatnonzero((low <= reach) & (reach <= high))
        if len(mine) < 2:
            continue
        right_class = np.cumsum(shared < window - reach)
        left_class[by_left] = np.cumsum(left_shared < reach)
        kind = right_class[mine] * (n + 1) + left_class[mine]
        order = np.lexsort((rank[mine], kind))
        again = np.concatenate([[False], kind[order][1:] == kind[order][:-1]])
        flags[mine[order[again]], reach + 1] = True
    steps = np.diff(flags.astype(np.int8), axis=1)
    row, begin = np.nonzero(steps == 1)  # runs of l: begin .. end - 1
    _, end = np.nonzero(steps == -1)
    covers = np.zeros(len(row), _COVER)
    covers["row"] = entries["row"][row]
    covers["begin"] = entries["place"][row] - (end - 1)
    covers["end"] = entries["place"][row] - begin + window
    owner = part[row]
    order = np.argsort(owner, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
        if len(at):
            yield int(owner[at[0]]), covers[at]


def _removed(window: int):
    def run(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        covers = np.concatenate([np.frombuffer(c, _COVER) for c in told["covers"]] or [np.zeros(0, _COVER)])
        covers = covers[np.argsort(covers["row"], kind="stable")]
        out = []
        frame = _in_order(docs)
        cuts = np.searchsorted(covers["row"], np.arange(len(frame) + 1))
        for row, (doc_id, at, text) in enumerate(zip(frame["doc_id"], frame["at"], frame["text"])):
            data = text.encode()
            mine = covers[cuts[row]:cuts[row + 1]]
            spans, kept = [], data
            if len(mine):
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, mine["begin"], 1)
                np.add.at(edge, mine["end"], -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = [{"begin": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((None if at == LAST and pd.isna(doc_id) else int(at), len(data), len(data) - len(kept), spans,
                        sha256_hex(kept)))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"]).astype(
            {"doc_id": "Int64"})

    return run


def remove_repeats(docs: DataFrame, window: int = 100, k: int = 48) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans array<struct(begin, end)>, kept_sha256 for every row.

    A byte goes if it lies in a string of ``window`` bytes that also starts earlier: in a row with a smaller
    doc_id, or in the same row before. Strings are judged on the input and lie within one text. Null and empty texts
    have no bytes; texts shorter than the window lose none. A null doc_id comes after all others. Rows of one
    doc_id follow each other in the order of their texts; of equal rows the first is the earlier one. Other
    columns are left out. ``spans`` are the removed runs, in bytes of UTF-8.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"),
                       F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    ranges = max(1, -(-groups // 2))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(groups)))
    sent = dealt.groupBy("part").applyInPandas(
        _send_hashes(window, k, ranges), "range long, part long, hashes binary, twice binary")
    repeated = sent.groupBy("range").applyInPandas(_repeated, "part long, hashes binary")
    runs = dealt.groupBy("part").cogroup(repeated.groupBy("part")).applyInPandas(
        _send_runs(window, k, ranges),
        "range long, part long, entries binary, rests binary, before binary, covers binary")
    covers = runs.groupBy("range").applyInPandas(_merge(window), "part long, covers binary")
    return dealt.groupBy("part").cogroup(covers.groupBy("part")).applyInPandas(
        _removed(window),
        "doc_id long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept_sha256 string")
