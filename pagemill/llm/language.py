"""Language identification of code-switched text with a linear-chain conditional random field.

Every word of a text carries a language label. The score of a labelling is the
sum of emission scores (hashed affix, character n-gram and lexicon features of
each word) and of learned transition scores between neighbours. Forward-backward
gives each word's label probabilities; the language of a text is the label with
the largest expected number of letters, and its score the share of these.

The model is fitted on a bounded sample: at most ``docs_per_language`` labelled
texts of each language, chosen by the hash of their id, and of each a window of
``window`` words at a place taken from that hash. Half of the training sequences
join windows of two languages, which is what teaches the transitions. Prediction
uses the whole text and nothing but the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.llm.common import arrow_rows, doc_texts, filtered, sole_cache

FEATURES = 1 << 16
KEPT_WORDS = 300_000
MAX_LANGUAGES = 300  # the model holds a weight for each pair of them
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_CHUNK = 64  # words in a block of the forward-backward pass


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Feature name -> column; a cache of bounded size."""

    def __missing__(self, feature: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[feature] = at = xxhash.xxh3_64_intdigest(feature) % FEATURES
        return at


_HASHES = _Hashes()


@dataclass
class Crf:
    labels: list[str]
    lexicon: dict[str, int]  # word -> bits of the languages whose sample has it often
    emission: np.ndarray  # FEATURES x labels
    transition: np.ndarray  # labels x labels, log scale
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray | None = field(default=None, repr=False)

    def forget(self) -> None:
        self.cache.clear()
        self.table = None
        _HASHES.clear()

    def features(self, word: str) -> list[int]:
        """Affixes up to four letters, 2- and 3-grams of the marked word, and the lexicon's entry."""
        marked = f"<{word[:40]}>" if len(word) <= 40 else f"<{word[:20]}{word[-20:]}>"
        names = [f"p{word[:n]}" for n in (1, 2, 3, 4)] + [f"s{word[-n:]}" for n in (1, 2, 3, 4)]
        names += [marked[i:i + n] for n in (2, 3) for i in range(len(marked) - n + 1)]
        names += [f"l{self.lexicon.get(word, 0)}"]
        if word in self.lexicon:
            names.append(f"w{word}")
        return [_HASHES[x] for x in names]

    def scores(self, word: str) -> np.ndarray:
        return self.emission[self.features(word)].sum(0)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Emission scores of a long list of words; each distinct word is scored once."""
        if len(self.cache) > KEPT_WORDS:
            self.cache.clear()
            self.table = None
        fresh = list({w for w in words if w not in self.cache})
        if fresh:
            features = [self.features(w) for w in fresh]
            starts = np.cumsum([0] + [len(f) for f in features[:-1]])
            flat = np.fromiter((i for f in features for i in f), np.int64)
            scored = np.add.reduceat(self.emission[flat], starts, axis=0)
            known = len(self.cache)
            self.cache.update((w, known + n) for n, w in enumerate(fresh))
            self.table = scored if self.table is None else np.concatenate([self.table, scored])
        return self.table[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities of every word of many texts laid end to end; no text is empty.

        The passes run over blocks of _CHUNK words at once: products of transfer matrices carry
        the boundary vectors from block to block, so a text of any length takes the same path.
        """
        k = len(self.labels)
        blocks = -(-lengths // _CHUNK)
        first = np.cumsum(blocks) - blocks
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block, step = first[text] + place // _CHUNK, place % _CHUNK
        n = int(blocks.sum())
        emit = np.zeros((n, _CHUNK, k))
        emit[block, step] = np.exp(scores - scores.max(1, keepdims=True))
        live = np.zeros((n, _CHUNK), bool)
        live[block, step] = True
        begins = np.zeros(n, bool)
        begins[first] = True
        move = np.exp(self.transition - self.transition.max())
        eye = np.eye(k)
        product = np.broadcast_to(eye, (n, k, k)).copy()  # row vector times product passes a block
        for j in range(_CHUNK):
            stepped = product @ move if j else np.where(begins[:, None, None], product, product @ move)
            stepped = stepped * emit[:, j, None, :]
            stepped /= stepped.sum((1, 2), keepdims=True) + 1e-300
            product = np.where(live[:, j, None, None], stepped, product)
        into, out_of = np.empty((n, k)), np.empty((n, k))
        lasts = first + blocks - 1
        for r in range(int(blocks.max())):  # all texts' r-th blocks at once, from the front and from the back
            at = first[blocks > r] + r
            into[at] = 1.0 if r == 0 else np.einsum("ni,nij->nj", into[at - 1], product[at - 1])
            into[at] /= into[at].sum(1, keepdims=True)
            at = lasts[blocks > r] - r
            if r == 0:
                out_of[at] = 1.0
            else:
                out_of[at] = np.einsum("nij,nj->ni", product[at + 1], out_of[at + 1])
            out_of[at] /= out_of[at].sum(1, keepdims=True)
        forward = np.empty((n, _CHUNK, k))
        state = into
        for j in range(_CHUNK):
            moved = state @ move if j else np.where(begins[:, None], state, state @ move)
            moved = moved * emit[:, j]
            moved /= moved.sum(1, keepdims=True) + 1e-300
            state = np.where(live[:, j, None], moved, state)
            forward[:, j] = state
        state = out_of
        for j in range(_CHUNK - 1, -1, -1):
            forward[:, j] *= state
            moved = (emit[:, j] * state) @ move.T
            moved /= moved.sum(1, keepdims=True) + 1e-300
            state = np.where(live[:, j, None], moved, state)
        result = forward[block, step]
        return result / result.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; ("und", 0.0) for one without a letter."""
        sole_cache(f"language {id(self)}", self.forget)
        found = [words_of(t or "") for t in texts]
        answer = [(UNDETERMINED, 0.0)] * len(texts)
        full = [i for i, w in enumerate(found) if w]
        if not full or not self.labels:
            return answer
        words = [w for i in full for w in found[i]]
        lengths = np.array([len(found[i]) for i in full])
        letters = np.fromiter(map(len, words), np.float64, len(words))
        shares = np.add.reduceat(self.marginals(self.word_rows(words), lengths) * letters[:, None],
                                 np.cumsum(lengths) - lengths, axis=0)
        shares /= shares.sum(1, keepdims=True)
        for i, share in zip(full, shares):
            best = int(share.argmax())
            answer[i] = (self.labels[best], float(min(1.0, share[best])))
        return answer


def training_sample(labelled: DataFrame, docs_per_language: int, window: int) -> list[tuple[str, list[str]]]:
    """(language, words) of a bounded sample of each language, chosen by the hashes of the ids.

    The words are a window of the text at a place that the hash chooses.
    """
    keys = labelled.select("doc_id", F.col("lang").cast("string").alias("lang")).where("lang is not null")
    order = Window.partitionBy("lang").orderBy("order", "doc_id")
    # Ids and languages alone are ranked, and of a large language only some times the rows wanted.
    counts = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    share = F.coalesce(*[F.when(F.col("lang") == r.lang, F.lit(8.0 * docs_per_language / r.rows)) for r in counts])
    chosen = (
        keys.withColumn("order", F.xxhash64("doc_id"))
        .where(F.pmod("order", F.lit(1 << 20)) < share * (1 << 20)).distinct()
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_language)
        .select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "order")
    )
    labelled = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null")
    ranked = (
        labelled.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")))
        .withColumn("place", F.row_number().over(order.orderBy("order", "doc_id", "text")))
        .where(F.col("place") <= docs_per_language)
    )
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("order", pa.int64())])

    def cut(lang, text, at):
        words = [words_of(t) for t in text]
        starts = [a % max(1, len(w) - window + 1) for a, w in zip(at, words)]
        return lang, [w[s:s + window] for w, s in zip(words, starts)], at

    rows = ranked.select("lang", "text", "order").mapInArrow(
        lambda b: arrow_rows(b, schema, cut), "lang string, words array<string>, order long")
    return [(r.lang, r.words) for r in sorted(rows.collect(), key=lambda r: (r.order, r.words)) if r.words]


def fit(sample: list[tuple[str, list[str]]], rounds: int = 6, rate: float = 0.3, lexicon_size: int = 300) -> Crf:
    """Maximum likelihood by AdaGrad on batches of sequences; the gradient comes from forward-backward."""
    labels = sorted({lang for lang, _ in sample})
    at = {x: i for i, x in enumerate(labels)}
    k = len(labels)
    counts: dict[str, dict[str, int]] = {x: {} for x in labels}
    for lang, words in sample:
        for w in words:
            counts[lang][w] = counts[lang].get(w, 0) + 1
    lexicon: dict[str, int] = {}
    for i, lang in enumerate(labels):
        for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            lexicon[w] = lexicon.get(w, 0) | 1 << i
    model = Crf(labels, lexicon, np.zeros((FEATURES, k)), np.zeros((k, k)))
    if k < 2:
        return model
    cached: dict[str, list[int]] = {}
    sequences = []
    for n, (lang, words) in enumerate(sample):
        if n % 2 and n >= 3:  # two halves, mostly of different languages
            other, theirs = sample[n - 3]
            half = len(words) // 2
            pair = [(at[lang], w) for w in words[:half]] + [(at[other], w) for w in theirs[: len(theirs) // 2]]
        else:
            pair = [(at[lang], w) for w in words]
        if pair:
            sequences.append(pair)
    squares_e, squares_t = np.full((FEATURES, k), 1e-6), np.full((k, k), 1e-6)
    random = np.random.default_rng(7)
    for _ in range(rounds):
        order = random.permutation(len(sequences))
        for begin in range(0, len(order), 32):
            batch = [sequences[i] for i in order[begin:begin + 32]]
            words = [w for s in batch for _, w in s]
            features = [cached.get(w) or cached.setdefault(w, model.features(w)) for w in words]
            sizes = np.array([len(f) for f in features])
            flat = np.concatenate([np.array(f) for f in features])
            scores = np.add.reduceat(model.emission[flat], np.cumsum(sizes) - sizes, axis=0)
            gold = np.array([y for s in batch for y, _ in s])
            lengths = np.array([len(s) for s in batch])
            error, pairs = gradient(model.transition, scores, gold, lengths)
            touched, inverse = np.unique(flat, return_inverse=True)
            step = np.zeros((len(touched), k))
            np.add.at(step, inverse, np.repeat(error, sizes, axis=0))
            step = step / len(batch) + 1e-5 * model.emission[touched]
            squares_e[touched] += step ** 2
            model.emission[touched] -= rate * step / np.sqrt(squares_e[touched])
            pairs = pairs / len(batch) + 1e-4 * model.transition
            squares_t += pairs ** 2
            model.transition -= rate * pairs / np.sqrt(squares_t)
    return model


def gradient(transition: np.ndarray, scores: np.ndarray, gold: np.ndarray, lengths: np.ndarray):
    """Of the negative log likelihood: expected minus observed labels of each word, and label pairs."""
    k, n, most = transition.shape[0], len(lengths), int(lengths.max())
    starts = np.cumsum(lengths) - lengths
    emit = np.zeros((n, most, k))
    live = np.arange(most) < lengths[:, None]
    emit[live] = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(transition - transition.max())
    forward, backward = np.zeros((n, most, k)), np.ones((n, most, k))
    for j in range(most):
        moved = (forward[:, j - 1] @ move if j else 1.0) * emit[:, j]
        forward[:, j] = moved / (moved.sum(1, keepdims=True) + 1e-300)
    for j in range(most - 2, -1, -1):
        moved = (emit[:, j + 1] * backward[:, j + 1]) @ move.T
        total = moved.sum(1, keepdims=True)
        backward[:, j] = np.where(live[:, j + 1, None], moved / (total + 1e-300), 1.0)
    joint = forward * backward
    joint /= joint.sum(2, keepdims=True) + 1e-300
    error = joint[live]
    error[np.arange(len(gold)), gold] -= 1.0
    left, right = forward[:, :-1], emit[:, 1:] * backward[:, 1:]
    both = left[:, :, :, None] * move * right[:, :, None, :]
    both /= both.sum((2, 3), keepdims=True) + 1e-300
    pairs = (both * live[:, 1:, None, None]).sum((0, 1))
    inner = np.ones(len(gold), bool)
    inner[starts] = False
    np.subtract.at(pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1.0)
    return error, pairs


def train(labelled: DataFrame, docs_per_language: int = 400, window: int = 60) -> Crf:
    """Fit on labelled rows (doc_id, text, lang). With no labelled row every prediction is ``und``."""
    sample = training_sample(labelled, docs_per_language, window)
    return fit(sample) if sample else Crf([], {}, np.zeros((FEATURES, 0)), np.zeros((0, 0)))


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    ``und`` with score 0 stands for a null text or one without a letter. Repeated rows give repeated
    results; other columns are left out and never read. The model, of fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(doc_id, text):
        step, found = 400, []
        for at in range(0, len(text), step):
            found += shared.value.predict(text[at:at + step])
        return doc_id, [p for p, _ in found], [s for _, s in found]

    return doc_texts(docs).mapInArrow(
        lambda b: arrow_rows(b, schema, run), "doc_id long, lang_pred string, score double")


def reject(docs: DataFrame, model: Crf, least_score: float = 0.3) -> DataFrame:
    """Whole rows of ``docs`` without those in no language: ``und``, or a score below ``least_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str | None]) -> list[bool]:
        found = [p for at in range(0, len(texts), 400) for p in shared.value.predict(texts[at:at + 400])]
        return [label != UNDETERMINED and score >= least_score for label, score in found]

    return filtered(docs, keep)
