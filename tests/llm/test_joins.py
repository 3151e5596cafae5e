"""Operators that compare rows: top-k, lines, benchmark items; and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm import decontaminate, lines, simhash, topk
from tests.llm.test_simhash import plain_fingerprint
from pagemill.llm.jobs import language_model
from pagemill.llm.sentencepieces import encoder
from pagemill.llm.jobs import PIECES


def plain_top(rows, k):
    clean = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in clean if i % 20 == 0}):
        own = next(v for i, v in clean if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in clean if i != q and len(v) == len(own))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    random.seed(8)
    rows = [(i, [random.choice([-1.5, -0.2, 0.0, 0.4, 0.41]) for _ in range(6)]) for i in range(0, 90)]
    rows += [(200 + i, [0.4] * 6) for i in range(50)] + [(40, [0.4] * 6), (41, [0.4] * 6)]  # ties, repeated ids
    rows += [(300, None), (320, [None] * 6), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (None, [1.0] * 6),
             (380, [1.0, 2.0]), (381, [1.0, 2.0]), (400, [5.0] * 3), (420, [])]
    rows = [r for r in rows if r != (40, [0.4] * 6)]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows],
                               "vec_id long, embedding array<float>, qb int, cand string")
    vectors = topk.scaled(df)
    got = topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 20)
    assert topk.top_k(vectors.where("false"), vectors, 20).count() == 0
    assert topk.top_k(vectors, vectors.where("false"), 20).count() == 0


def plain_lines(rows, min_words=8):
    """Text left of each row, by comparing all pairs of distinct lines."""
    last = (1 << 63) - 1
    placed = [((last if d is None else d, n), tuple(line.split()), line) for d, t in rows if t is not None
              for n, line in enumerate(t.split("\n"))]
    first = {}
    for at, words, _ in placed:
        if words:
            first[words] = min(first.get(words, at), at)

    def near(x, y):
        if min(len(x), len(y)) < min_words or abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) <= 1
        x, y = sorted((x, y), key=len)
        return any(y[:i] + y[i + 1:] == x for i in range(len(y)))

    least = {x: min([first[y] for y in first if near(x, y)] + [first[x]]) for x in first}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None))
            continue
        at = last if d is None else d
        out.append((d, "\n".join(line for n, line in enumerate(t.split("\n"))
                                 if not line.split() or (at, n) <= least[tuple(line.split())])))
    return sorted(out, key=repr)


def test_lines(spark):
    random.seed(9)
    base = [[random.choice("abcdefg") for _ in range(n)] for n in (7, 8, 9, 12, 40)]
    rows = []
    for d in range(60):
        made = []
        for _ in range(random.randrange(5)):
            words = list(random.choice(base))
            for _ in range(random.randrange(3)):
                at = random.randrange(len(words))
                how = random.randrange(3)
                words[at:at + (how > 0)] = [random.choice("xyz")] if how < 2 else []
            made.append(random.choice([" ", "\t"]).join(words) + random.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(made)))
    rows += [(70, None), (71, ""), (72, "\n \n"), (None, " ".join(base[4])), (None, " ".join(base[4])), (5, "a b"),
             (73, "w " * 3000), (74, "w " * 3001 + "\nnew line"), (-1, " ".join(base[3]))]
    df = spark.createDataFrame([(d, t, "row", 1) for d, t in rows], "doc_id long, text string, row string, at int")
    got = lines.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == plain_lines(rows)
    assert lines.dedup_lines(df.where("false")).count() == 0


def plain_overlap(item, words, width=5):
    def grams(w):
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}
    n = min(width, len(item))
    own = grams(item)
    have = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
    return len(own & have) / len(own)


def test_benchmark_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 12)
    random.seed(10)
    word = lambda: random.choice("abcdefghij") * random.randrange(1, 6)
    items = [(i, " ".join(word() for _ in range(random.randrange(1, 40))), " ".join(word() for _ in range(6)))
             for i in range(30)]
    items += [(40, None, "x"), (41, "", None), (None, items[3][1], items[3][2]), (42, items[4][1], None)]
    docs = []
    for d in range(120):
        i = random.choice(items)
        body = ((i[1] or "") + " " + (i[2] or "")).split()
        for _ in range(random.randrange(4)):
            if body:
                body[random.randrange(len(body))] = word()
        docs.append((d, " ".join([word() for _ in range(random.randrange(90))] + body
                                 + [word() for _ in range(random.randrange(90))]).upper()))
    docs += [(200, None), (201, ""), (None, items[0][1] + " " + items[0][2]), (202, "\n".join(["z"] * 30_000))]
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    found = decontaminate.contaminated(df, bench, answer="answer")
    got = {(r.doc_id, r.item_id): r.question_overlap for r in found.collect()}
    whole = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, q, a in items:
            if q and plain_overlap(q.split(), w) >= 0.8 and (not a or plain_overlap(a.split(), w) >= 0.8):
                whole[d, i] = plain_overlap(q.split(), w)
    # passages may not put together what stands far apart; short items are found in scattered places, too
    assert got.keys() <= whole.keys()
    sizes = {i: len((q or "").split()) for i, q, _ in items}
    assert {k for k in whole if sizes[k[1]] >= 12} <= got.keys()
    assert {r.doc_id for r in decontaminate.clean(df, bench, answer="answer").collect()} == {
        d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0
    assert decontaminate.contaminated(df.where("false"), bench).count() == 0


def test_pipeline_stages(spark, folder):
    """Each stage against a plain version, on what the stage before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def rows(df):
        return sorted([(r.doc_id, r.text) for r in df.collect()])

    model = language_model(docs)
    one = stages["language"](spark, docs, folder)
    want = [r for r, (p, s) in zip(rows(docs), model.predict([t for _, t in rows(docs)])) if p != "und" and s >= 0.3]
    assert rows(one) == want and one.columns == columns
    two = stages["line_dedup"](spark, one, folder)
    left = [(d, t) for d, t in plain_lines(rows(one)) if t.strip() or not dict(rows(one))[d].strip()]
    assert rows(two) == sorted(left) and two.columns == columns
    assert all(r.n_chars == len(r.text) for r in two.collect() if r.text != dict(rows(docs))[r.doc_id])
    three = stages["near_dedup"](spark, two, folder)
    data = rows(two)  # op7's rule by brute force: three-word shingles, fingerprints within two bits
    marks = [plain_fingerprint(t) for _, t in data]
    group = list(range(len(data)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 2:
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(data):
        low[root(i)] = min(low.get(root(i), d), d)
    kept = sorted({(d, t) for i, (d, t) in enumerate(data) if d == low[root(i)]})
    assert rows(three) == kept and three.columns == columns
    four = stages["decontamination"](spark, three, folder)
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert rows(four) == [(d, t) for d, t in kept if all(plain_overlap(b, t.lower().split()) < 0.8 for b in bench)]
    five = {r.doc_id: list(r.ids) for r in stages["sentencepiece"](spark, four, folder).collect()}
    sp = encoder(PIECES).library
    assert five == {d: sp.encode(t, add_bos=True, add_eos=True) for d, t in rows(four)}
