"""SentencePiece encoding and decoding of whole texts, by backtracking.

A merge-type encoding is the one sequence of pieces in which every two
neighbours are *compatible*: merging their characters anew gives exactly these
two pieces. So it can be found from left to right. An Aho-Corasick automaton
over all pieces gives the longest piece from a position on; it or the longest
shorter one that begins it and is compatible with the piece before is taken.
Where none is, the last piece is given back for its next shorter one, and the position is marked as failed in a
bit field, since no encoding has a piece border there.

No piece holds a blank after another character, so no merge crosses such a
place and each word with its leading blanks is encoded by itself. This is
checked when a model is loaded; a model for which it does not hold is encoded
in one piece.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from pagemill.llm.common import arrow_rows, doc_texts, sha256_hex, sole_cache

SPACE = "▁"
KEPT_WORDS = 400_000
KEPT_PAIRS = 600_000
MAX_KEPT_LENGTH = 64


class PieceEncoder:
    """Encodes like the library of the model does; ``words`` and ``pairs`` are caches of bounded size."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.library
        plain = [i for i in range(sp.vocab_size())
                 if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        names = [sp.id_to_piece(i) for i in plain]
        self.piece_id = dict(zip(names, plain))
        self.rank = {p: -sp.get_score(i) for p, i in self.piece_id.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text_of = {i: p for p, i in self.piece_id.items()}
        loose = {c for p in names for c in p} - self.piece_id.keys()
        for n, c in enumerate(sorted(loose)):  # characters that occur inside pieces only
            self.text_of[sp.vocab_size() + n] = c
        self.size = sp.vocab_size()
        self.automaton = ahocorasick.Automaton()
        for i, p in self.text_of.items():
            if len(p) == 1 or self.merged(p) == [p]:  # others never come out of a merge
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        shorter = ((i, self.automaton.get(p[:n])[1]) for i, p in self.text_of.items()
                   for n in range(1, len(p)) if p[:n] in self.automaton)
        self.shorter = dict(shorter)  # of each piece the longest piece that begins it
        line = "" if any("\n" in p for p in names) else "\n"
        whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names)
        borders = f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + "|\n" * bool(line)
        self.segments = re.compile(r"(?s).+" if whole else borders).findall
        self.prefix = SPACE if sp.encode("a") == sp.encode(" a")[1:] or sp.encode_as_pieces("a")[0][0] == SPACE else ""
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.ends = (np.uint32(sp.bos_id()).tobytes(), np.uint32(sp.eos_id()).tobytes())

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged by rank, the leftmost of equals first."""
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            ranks = [rank(a + b, np.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == np.inf:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            a, b = self.text_of[left], self.text_of[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of one segment: the longest matches if all neighbours are compatible, else found by backtracking."""
        longest = [v for _, v in self.automaton.iter_long(word)]
        if sum([n for n, _ in longest]) == len(word):
            pairs, before = self.pairs, longest[0][1]
            for _, i in longest[1:]:
                fits = pairs.get(before << 20 | i)
                if not (fits or fits is None and self.compatible(before, i)):
                    break
                before = i
            else:
                return self.spelled([i for _, i in longest])
        return self.spelled(self.backtracked(word))

    def spelled(self, ids: list[int]) -> list[int]:
        """Characters of no piece of their own as bytes."""
        if max(ids) < self.size:
            return ids
        return [j for i in ids for j in ([i] if i < self.size else [self.byte_id[b] for b in self.text_of[i].encode()])]

    def backtracked(self, word: str) -> list[int]:
        longest_from, shorter, pairs = self.automaton.iter_long, self.shorter, self.pairs
        ids: list[int] = []
        starts: list[int] = []  # of the pieces in ``ids``
        failed = bytearray(len(word) // 8 + 1)  # a bit for each position that is no border
        at, known, floor = 0, None, 0  # known: the next piece to try at ``at``
        while at < len(word):
            if known is None:
                end, (length, known) = next(longest_from(word, at), (len(word), (0, 0)))
                if end + 1 - length != at:  # a character of no piece: nothing merges across it
                    ids += [self.byte_id[b] for b in word[at].encode()]
                    starts += [at] * (len(ids) - len(starts))
                    at, known, floor = at + 1, None, len(ids)
                    continue
            while known is not None:
                end = at + len(self.text_of[known])
                if not failed[end >> 3] >> (end & 7) & 1:
                    if len(ids) == floor:
                        break
                    fits = pairs.get(ids[-1] << 20 | known)
                    if fits or fits is None and self.compatible(ids[-1], known):
                        break
                known = shorter.get(known)
            if known is not None:
                ids.append(known)
                starts.append(at)
                at, known = end, None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, known = starts.pop(), shorter.get(ids.pop(), -1)
                while known == -1:  # the piece given back has none shorter: its start is no border either
                    failed[at >> 3] |= 1 << (at & 7)
                    at, known = starts.pop(), shorter.get(ids.pop(), -1)
        return ids

    def word_bytes(self, word: str) -> bytes:
        data = array("I", self.word_ids(word)).tobytes()
        if len(word) <= MAX_KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = data
        return data

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers, with begin and end ids."""
        kept, make = self.words.get, self.word_bytes
        found = self.segments(self.prefix + text.replace(" ", SPACE)) if text else ()
        return b"".join([self.ends[0], *[kept(w) or make(w) for w in found], self.ends[1]])

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(model_file: str) -> PieceEncoder:
    """One per worker process."""
    sole_cache("sentencepieces", _ENCODERS.clear)
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = PieceEncoder(model_file)
    return _ENCODERS[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids array<int>: every whole text with begin and end ids. A null text counts as empty.

    An empty text gives the begin and end ids only. Rows that repeat are encoded as often
    as they occur; further columns of ``docs`` are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(doc_id, text):
        enc = encoder(model_file)
        return doc_id, [np.frombuffer(enc.encode(t or ""), "<u4").astype(np.int32) for t in text]

    return doc_texts(docs).mapInArrow(lambda b: arrow_rows(b, schema, run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text: the library's decode of every ``ids``. Null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(doc_id, ids):
        enc = encoder(model_file)
        return doc_id, [None if i is None else enc.library.decode(i) for i in ids]

    return encoded.select("doc_id", "ids").mapInArrow(
        lambda b: arrow_rows(b, schema, run), "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded in one pass.

    The digests are over the ids as little-endian unsigned 32-bit integers and over the decoded text in UTF-8.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(doc_id, text):
        enc = encoder(model_file)
        ids = [enc.encode(t or "") for t in text]
        return (doc_id, [len(i) // 4 for i in ids], [sha256_hex(i) for i in ids],
                [sha256_hex(enc.decode(i).encode()) for i in ids])

    return doc_texts(docs).mapInArrow(
        lambda b: arrow_rows(b, schema, run),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_and_decoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids array<int>, n_tokens, decoded_sha256: ``encode`` with a digest of the text that comes back."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
                        ("decoded_sha256", pa.string())])

    def run(doc_id, text):
        enc = encoder(model_file)
        ids = [enc.encode(t or "") for t in text]
        return (doc_id, [np.frombuffer(i, "<i4") for i in ids], [len(i) // 4 for i in ids],
                [sha256_hex(enc.decode(i).encode()) for i in ids])

    return doc_texts(docs).mapInArrow(
        lambda b: arrow_rows(b, schema, run), "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string")
