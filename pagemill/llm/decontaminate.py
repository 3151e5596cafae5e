"""Benchmark decontamination: a BM25 index of test items, asked with every training passage.

Documents are cut in passages of twice the longest item's words, each half
overlapping the next, so an item copied anywhere lies whole within one passage.
Every passage is a query: the weight of its distinct words in an item is their
BM25 weight. Items whose score reaches their threshold are retrieved, and the
word shingles of question and answer are then counted exactly.

The threshold of an item is what is left of its score against itself if its
dearest words are missing, as many as may be missing when the shingle overlap is
still reached. So retrieval loses nothing the verification would accept.
Divided by it, all thresholds are 1. Pruning is block-max WAND's, for a batch of
passages at once: the sum of the largest weights of a passage's words over all items,
then over each block of items, must reach 1 before an item of a block is scored.

Items are taken in shards of bounded size. Only the index of one shard is broadcast at a time.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import arrow_rows, doc_texts, filtered

BLOCK = 8
SHARD_ITEMS = 1000
SHARD_BYTES = 4_000_000
K1, B = 1.2, 0.75
_NEARLY = 1 - 1e-6


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII blanks, A-Z lower-cased."""
    return text.encode().lower().split()


def shingles(words: list[bytes], width: int) -> set[bytes]:
    """All runs of ``width`` words; the whole sequence if it is shorter; none of no words."""
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(g) for g in zip(*[words[i:] for i in range(width)])}


class ItemIndex:
    """Inverted lists with block maxima; weights are divided by each item's threshold."""

    def __init__(self, items: list[tuple], width: int, similarity: float):
        """items: (item_id, question, answer or None)."""
        full = [(i, words_of(q or ""), words_of(a or "")) for i, q, a in items]
        full = [(i, q, a, Counter(q + a)) for i, q, a in full if q]
        common = Counter(w for *_, c in full for w in c)
        full.sort(key=lambda x: (max((common[w], w) for w in x[3]), str(x[0])))  # alike items in one block
        self.width, self.similarity = width, similarity
        self.ids = [x[0] for x in full]
        self.questions = [(shingles(q, width), min(len(q), width)) for _, q, _, _ in full]
        self.answers = [(shingles(a, width), min(len(a), width)) for _, _, a, _ in full]
        self.stride = max([len(q) + len(a) for _, q, a, _ in full], default=1)
        self.term = {w: n for n, w in enumerate(sorted(common))}
        n_blocks = -(-len(full) // BLOCK)
        self.weight = np.zeros((len(self.term), n_blocks * BLOCK), np.float32)
        mean = sum(sum(c.values()) for *_, c in full) / max(1, len(full))
        for at, (_, q, a, counts) in enumerate(full):
            length = sum(counts.values())
            scores = {
                w: np.log1p((len(full) - common[w] + 0.5) / (common[w] + 0.5))
                * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean)) for w, n in counts.items()
            }
            missing = sum(int((1 - similarity) * len(s[at][0]) + 1e-9) for s in (self.questions, self.answers))
            dear = sorted(scores.values(), reverse=True)
            least = sum(dear[missing:])
            for w, s in scores.items():
                self.weight[self.term[w], at] = s / least if least > 0 else 1.0
        blocks = self.weight.reshape(len(self.term), n_blocks, BLOCK)
        self.block_max = blocks.max(2) if n_blocks else np.zeros((0, 0), np.float32)
        self.term_max = self.block_max.max(1) if n_blocks else np.zeros(0, np.float32)

    def retrieve(self, terms: np.ndarray, lengths: np.ndarray):
        """(text, passage, item, score) above threshold; ``terms``: term numbers of all words, -1 for unknown ones."""
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        passages = np.maximum(1, -(-lengths // self.stride) - 1)  # the last half belongs to the one before
        first = np.cumsum(passages) - passages
        known = terms >= 0
        text, cell, term = text[known], place[known] // self.stride, terms[known].astype(np.int64)
        lead = cell < passages[text]
        follow = cell > 0
        n = np.int64(len(self.term))
        keys = np.unique(np.concatenate([
            (first[text] + cell)[lead] * n + term[lead], (first[text] + cell - 1)[follow] * n + term[follow]]))
        owner, term = keys // n, keys % n
        total = np.bincount(owner, weights=self.term_max[term], minlength=int(passages.sum()))
        keep = (total >= _NEARLY)[owner]
        owner, term = owner[keep], term[keep]
        begin = 0
        while begin < len(owner):  # whole passages, but a bounded number of rows of block maxima at once
            end = begin + (1 << 18)
            end = len(owner) if end >= len(owner) else int(np.searchsorted(owner, owner[end]))
            if end <= begin:  # one passage alone is longer
                end = int(np.searchsorted(owner, owner[begin], side="right"))
            yield from self._score(owner[begin:end], term[begin:end], first)
            begin = end

    def _score(self, owner: np.ndarray, term: np.ndarray, first: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ends = np.concatenate([starts[1:], [len(owner)]])
        bound = np.add.reduceat(self.block_max[term], starts, axis=0)
        for row, block in zip(*np.nonzero(bound >= _NEARLY)):
            mine = term[starts[row]:ends[row]]
            scores = self.weight[mine, block * BLOCK:(block + 1) * BLOCK].sum(0, dtype=np.float64)
            passage = int(owner[starts[row]])
            text = int(np.searchsorted(first, passage, side="right")) - 1
            for i in np.flatnonzero(scores >= _NEARLY):
                yield text, passage - int(first[text]), block * BLOCK + int(i), float(scores[i])

    def overlaps(self, words: list[bytes], item: int) -> tuple[float, float | None]:
        """Shares of the question's and the answer's shingles that the words hold; None without an answer."""
        shares = []
        for own, width in (self.questions[item], self.answers[item]):
            shares.append(len(own & shingles(words, width)) / len(own) if own else None)
        return shares[0], shares[1]

    def search(self, texts: list[str | None]):
        """(text number, item number, passages, question overlap, answer overlap, score) of verified items."""
        found = [words_of(t or "") for t in texts]
        if not self.ids or not any(found):
            return
        kept = self.term.get
        lengths = np.array([len(f) for f in found])
        terms = np.fromiter((kept(w, -1) for f in found for w in f), np.int64, int(lengths.sum()))
        best: dict[tuple[int, int], list] = {}
        for text, passage, item, score in self.retrieve(terms, lengths):
            begin = passage * self.stride
            q, a = self.overlaps(found[text][begin:begin + 2 * self.stride], item)
            if q >= self.similarity - 1e-12 and (a is None or a >= self.similarity - 1e-12):
                row = best.setdefault((text, item), [0, 0.0, a, 0.0])
                row[0] += 1
                row[1] = max(row[1], q)
                row[2] = a if row[2] is None or a is None else max(row[2], a)
                row[3] = max(row[3], score)
        for (text, item), row in best.items():
            yield text, item, *row


def _shards(items: DataFrame) -> list[list[tuple]]:
    """Items sorted by size and cut by number and bytes; the driver holds one shard's items at a time and its index."""
    shard: list[tuple] = []
    held = 0
    for r in items.orderBy(F.length("question"), "item_id").toLocalIterator():
        size = len(r.question or "") + len(r.answer or "")
        if shard and (len(shard) >= SHARD_ITEMS or held + size > SHARD_BYTES):
            yield shard
            shard, held = [], 0
        shard.append((r.item_id, r.question, r.answer))
        held += size
    yield shard


def _items(benchmark: DataFrame, question: str, answer: str | None) -> DataFrame:
    return benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col(question).cast("string").alias("question"),
        (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8,
                 question: str = "text", answer: str | None = None) -> DataFrame:
    """doc_id, item_id, passages, question_overlap, answer_overlap, score for every document that holds an item.

    An item is held if one passage has at least ``similarity`` of the distinct shingles of its question and, if
    the benchmark has answers, of its answer. ``passages`` counts such passages. Null, empty and blank texts hold
    nothing; items without a word are held by nothing; an item of fewer than ``width`` words is one shingle.
    Repeated documents and items give a row for each. Other columns are left out. An empty benchmark gives no row.
    """
    spark = docs.sparkSession
    items = _items(benchmark, question, answer)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("passages", pa.int64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("score", pa.float64())])
    columns = ("doc_id long, item_id long, passages long, question_overlap double, answer_overlap double,"
               " score double")

    def searched(shard: list[tuple]) -> DataFrame:
        index = spark.sparkContext.broadcast(ItemIndex(shard, width, similarity))

        def run(doc_id, text):
            rows = [(doc_id[t], index.value.ids[i], *rest) for at in range(0, len(text), 500)
                    for t, i, *rest in ((t + at, *r) for t, *r in index.value.search(text[at:at + 500]))]
            return tuple(zip(*rows)) or ((),) * len(schema)

        return doc_texts(docs).mapInArrow(lambda b: arrow_rows(b, schema, run), columns)

    result = None
    for shard in _shards(items):
        part = searched(shard)
        result = part if result is None else result.union(part)
    return result


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8,
          question: str = "text", answer: str | None = None) -> DataFrame:
    """Whole rows of ``docs`` that hold no item, as ``contaminated`` means it."""
    for shard in _shards(_items(benchmark, question, answer)):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(shard, width, similarity))

        def keep(texts: list[str | None], index=index) -> list[bool]:
            bad = {t + at for at in range(0, len(texts), 500) for t, *_ in index.value.search(texts[at:at + 500])}
            return [i not in bad for i in range(len(texts))]

        docs = filtered(docs, keep)
    return docs
