import hashlib
import random

from pagemill.llm import spans, suffixes
from pagemill.llm.jobs import op5_suffix_dedup, op8_substring_dedup


def sha(data):
    return hashlib.sha256(data).hexdigest()


def plain_bytes(rows, window=100):
    """By the definition: the first start of every string, in order of id, then text."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for d, t in order:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - window + 1):
            piece = hashlib.md5(data[s:s + window]).digest()
            if piece in seen:
                gone[s:s + window] = b"\1" * window
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), gone) if b and not a)
        out.append((d, len(data), sum(gone), runs, sha(kept)))
    return sorted(out, key=repr)


def plain_words(rows, window=50):
    first = {}
    last = float("inf")
    cut = [(last if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    for at, _, w in cut:
        for s in range(len(w) - window + 1):
            key = b" ".join(w[s:s + window])
            first[key] = min(first.get(key, last), at)
    out = []
    for at, d, w in cut:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[b" ".join(w[s:s + window])] < at:
                gone[s:s + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def hard_rows():
    random.seed(5)
    word = lambda: "".join(random.choice("abé") for _ in range(random.randrange(1, 6)))
    shared = [" ".join(word() for _ in range(90)) for _ in range(4)]
    rows = []
    for d in range(40):
        parts = []
        for _ in range(random.randrange(0, 5)):
            p = random.choice(shared)
            a, b = sorted(random.randrange(len(p)) for _ in range(2))
            parts += [p if random.random() < 0.4 else p[a:b], " ".join(word() for _ in range(random.randrange(0, 30)))]
        rows.append((d, " ".join(parts)))
    return rows + [
        (50, None), (51, ""), (52, " \n\t "), (None, shared[0]), (None, shared[0] + " x"), (53, "=" * 700),
        (54, "ab" * 400), (55, "x " * 300), (56, "x y z " * 80), (3, shared[1]), (3, shared[1]), (57, "=" * 99),
        (58, "=" * 100), (-4, shared[2]), (59, "long " + "word " * 40_000), (60, "word " * 20_000)]


def test_bytes_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "GROUP_BYTES", 30_000)
    rows = hard_rows()
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], "doc_id long, text string, part string, at int")
    found = suffixes.remove_repeats(df, window=100)
    from pyspark.sql import functions as F
    counts = found.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n_spans"), "kept_sha256")
    assert got(counts) == plain_bytes(rows)
    assert suffixes.remove_repeats(df.where("false")).count() == 0


def test_words_edge_cases(spark):
    rows = hard_rows()
    df = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], "doc_id long, text string, found string, at int")
    found = spans.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(found) == plain_words(rows)
    assert spans.remove_repeats(df.where("false")).count() == 0


def test_queries_equal_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(op5_suffix_dedup(spark, folder)) == plain_bytes(rows)
    assert got(op8_substring_dedup(spark, folder)) == plain_words(rows)


def test_loser_tree():
    random.seed(2)
    for runs in (1, 2, 3, 7, 8):
        strings = [sorted(bytes(random.choice(b"ab") for _ in range(random.randrange(0, 12)))
                          for _ in range(random.randrange(0, 30))) for _ in range(runs)]
        merged = list(suffixes.merge_runs([suffixes.front_coded(s) if s else ([], []) for s in strings]))
        assert [x for *_, x in merged] == sorted(x for s in strings for x in s)
        for (*_, a), (_, _, n, b) in zip(merged, merged[1:]):
            assert n == suffixes.shared_length(a, b)
