"""Secret scan: patterns, and random strings that a tokenizer finds unusually dear.

Text a byte-pair vocabulary knows takes four characters a token or so; keys
and passwords drawn at random take about one and a half. A run of key characters
is reported as ``random`` if it takes fewer than ``max_ratio`` characters a
token, holds both letters and digits, and is no known digest (hexadecimal of a
usual digest length), no UUID, no identifier of words joined by signs or
capitals, and lies outside every span a pattern has found.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from pagemill.llm.common import arrow_rows, doc_texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this finds just the long ones
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST_LENGTHS = frozenset((32, 40, 48, 56, 64, 96, 128))  # fixed: hex digits of MD5, SHA-1, Tiger, SHA-2
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]+")
WORDS = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4})(?:[_/+=-]*(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}))*[_/+=-]*")

Span = tuple[str, int, int]


def pattern_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those too short dropped; code points, end exclusive."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [("hex", *m.span()) for m in LONG_HEX.finditer(text)]


def is_known(run: str) -> bool:
    """Digests, UUIDs and identifiers made of words and short numbers."""
    if ANY_HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.search(run):
        return True
    words = re.findall(r"[A-Za-z]+", run)
    mixed = sum(1 for a, b in zip(run, run[1:]) if a.isdigit() != b.isdigit() and a.isalnum() and b.isalnum())
    return bool(WORDS.fullmatch(run)) and mixed <= 3 and sum(map(len, words)) >= 3 * len(words)


class TokenCounter:
    """Tokens of a string under a vocabulary file of ranks."""

    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


_COUNTERS: dict[str, TokenCounter] = {}


def random_spans(text: str, taken: list[Span], count, max_ratio: float) -> list[Span]:
    """Runs whose characters a token are fewer than ``max_ratio``."""
    spans = []
    for m in RUN.finditer(text):
        run, (start, end) = m[0], m.span()
        if (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
                and not any(s < end and start < e for _, s, e in taken)
                and not is_known(run) and len(run) < max_ratio * count(run)):
            spans.append(("random", start, end))
    return spans


def joined(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find_secrets(docs: DataFrame, ranks_file: str, pattern: str, max_ratio: float = 2.2) -> DataFrame:
    """doc_id, spans array<struct(kind, start, end)>, base_joined, all_joined for every whole text.

    A null text counts as empty and has no spans. Repeated rows give repeated results; other columns are left out.
    ``ranks_file`` and ``pattern`` name a tiktoken vocabulary every worker can read.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("base_joined", pa.string()),
                        ("all_joined", pa.string())])

    def run(doc_id, text):
        if ranks_file not in _COUNTERS:
            _COUNTERS[ranks_file] = TokenCounter(ranks_file, pattern)
        base = [pattern_spans(t or "") for t in text]
        spans = [b + random_spans(t or "", b, _COUNTERS[ranks_file], max_ratio) for t, b in zip(text, base)]
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
        return doc_id, rows, [joined(b) for b in base], [joined(x) for x in spans]

    return doc_texts(docs).mapInArrow(
        lambda b: arrow_rows(b, schema, run),
        "doc_id long, spans array<struct<kind: string, start: long, end: long>>, base_joined string, all_joined string")
