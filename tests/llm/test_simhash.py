import random

import numpy as np
import xxhash

from pagemill.llm import simhash
from pagemill.llm.jobs import op7_simhash

SCHEMA = "doc_id long, text string, fp string, component_id int"  # with clashing extra columns


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        text = text.replace(blank, " ")
    words = [w for w in text.split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows, radius=2):
    marks = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted([(d, f"{m:016x}", low.get(root(i))) for i, ((d, _), m) in enumerate(zip(rows, marks))], key=repr)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_query_equals_brute_force(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert got(op7_simhash(spark, folder)) == plain_classes(rows)


def test_edge_cases(spark):
    random.seed(3)
    base = " ".join(random.choice("abcdefgh") * random.randrange(1, 9) for _ in range(400))
    rows = [(5, base), (4, base + " x"), (4, base + " x"), (None, base), (7, None), (8, ""), (9, " \n"), (10, "Ä one"),
            (11, "ä one"), (12, "A B"), (3, "a b"), (13, "w " * 50_000), (None, "alone " * 7)]
    df = spark.createDataFrame([(d, t, "f", 1) for d, t in rows], SCHEMA)
    assert got(simhash.near_duplicates(df)) == plain_classes(rows)
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_cells_and_strips_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 16)
    random.seed(4)
    seeds = [random.getrandbits(64) for _ in range(20)]
    marks = {s ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for s in seeds for _ in range(30)}
    rows = [(m - (1 << 64) if m >> 63 else m, m.to_bytes(8, "big")) for m in sorted(marks)]
    df = spark.createDataFrame([(i, bytearray(b), i) for i, b in rows], "id long, fp binary, bits long")
    df = df.withColumn("keys", simhash.piece_keys(2)).drop("bits")
    links = {(r.a, r.b) for r in simhash.fingerprint_links(df, 2).collect()}
    values = dict(rows)
    assert all((int.from_bytes(values[a]) ^ int.from_bytes(values[b])).bit_count() <= 2 for a, b in links)
    group = {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        group[root(a)] = root(b)
    for i, x in rows:
        for j, y in rows:
            if (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= 2:
                assert root(i) == root(j)


def test_bitwise_counters():
    random = np.random.default_rng(1)
    values = random.integers(0, 1 << 62, (150, 4), dtype=np.uint64)
    values[7] = values[3] ^ np.uint64(5)
    hit = simhash.near(values, simhash.planes_of(values), len(values), 100)
    plain = np.array([[sum(int(x ^ y).bit_count() for x, y in zip(a, b)) for b in values] for a in values])
    assert (hit == (plain <= 100)).all()
    far = np.full((3, 1), (1 << 64) - 1, np.uint64)
    assert simhash.near(far, simhash.planes_of(np.zeros((5, 1), np.uint64)), 5, 2) is None


def test_small_blocks_share_words():
    random = np.random.default_rng(5)
    values = random.integers(0, 1 << 62, (500, 4), dtype=np.uint64)
    sizes = [2, 3, 64, 2, 40, 9, 64, 64, 64, 64, 64, 60]
    ends = np.cumsum(sizes)
    for i in range(0, 490, 3):
        values[i + 1] = values[i] ^ np.uint64(1 << (i % 60))
    a, b = simhash.small_links(values, ends - sizes, ends, 3)
    links = set(zip(a, b))
    block = np.repeat(np.arange(len(sizes)), sizes)
    near = {(i, j) for i in range(500) for j in range(i + 1, 500) if block[i] == block[j]
            and sum(int(x ^ y).bit_count() for x, y in zip(values[i], values[j])) <= 3}
    assert links <= near and len(links) == len({x for p in near for x in p}) - len({min(p) for p in near})


def plain_kept(rows, width=5, similarity=0.8):
    """doc_ids kept, by the Jaccard similarity of all pairs."""
    def grams(text):
        w = text.lower().split()
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}

    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-12:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return sorted(min(d for (d, _), g in zip(rows, group) if g == n) for n in set(group))


def near_texts(rand, n, length, share):
    """Texts of one template, each with a run of its own words; shares shingles with the others accordingly."""
    base = [f"w{rand.randrange(10 ** 6)}" for _ in range(length)]
    cut = int(length * share)
    return [" ".join(base[:cut] + [f"v{rand.randrange(10 ** 6)}" for _ in range(length - cut)]) for _ in range(n)]


def test_keep_one_counts_shingles(spark, monkeypatch):
    """Pages of one template at a similarity of 0.6 to 0.8 stay, short texts with one word more go."""
    rand = random.Random(11)
    texts = [t for share in (0.75, 0.8, 0.85, 0.88, 0.9, 0.95) for t in near_texts(rand, 12, 400, share)]
    for _ in range(60):
        words = [f"s{rand.randrange(10 ** 6)}" for _ in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    base = near_texts(rand, 1, 120, 1)[0].split()
    texts += [" ".join(base[:n] + ["x"] + base[n + 1:]) for n in range(0, 110, 2)]  # a class reached over steps
    rand.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want
    monkeypatch.setattr(simhash, "CELL", 16)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want


def test_keep_one_with_a_dominant_shingle(spark):
    """A filler that makes up most of the shingles does not make texts alike, and copies of a text with more of it go."""
    rand = random.Random(12)
    other = [" ".join(f"w{rand.randrange(10 ** 6)}" for _ in range(60)) for _ in range(20)]
    texts = [". " * 200 + o for o in other] + [". " * 300 + o for o in other[:10]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == plain_kept(rows) == list(range(20))


def test_keep_one_equals_brute_force_on_documents(spark, folder):
    """The table holds pairs at 0.64 to 0.80 whose fingerprints differ in 30 to 50 bits: they stay."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == plain_kept(rows)
