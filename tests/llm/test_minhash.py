import random

from pagemill.llm import minhash

SCHEMA = "doc_id long, text string, component_id string, n_shingles int"  # clashing extra columns


def plain_sets(text, width=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        text = text.replace(blank, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return set()
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_components(rows, width=5):
    sets = [plain_sets(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            low[root(i)] = min(low.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = low.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), comp, d is not None and d == comp))
    return sorted(out, key=repr)


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(30, 120))]
        for _ in range(rnd.randint(1, 6)):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5, 20])):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((n, " ".join(words) if rnd.random() < 0.8 else "\n".join(words).upper()))
            n += 1
    # chains: each next text moves a little further from the first
    words = [rnd.choice(vocab) for _ in range(200)]
    for _ in range(6):
        words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((n, " ".join(words)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t "), (None, "alpha beta"), (None, "alpha beta"), (n + 3, "Alpha beta"),
             (n + 4, "a b c d e f"), (n + 4, "a b c d e f"), (n + 5, "one two three four five six seven eight"),
             (n + 6, "one two three four five six seven eight nine")]
    return rows


def test_minhash_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = minhash.near_duplicates(docs).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=repr) == plain_components(rows)


def test_minhash_links_members_that_match_no_centre(spark):
    # Texts share most of their shingles, so buckets hold many unlike members; pairs of near copies lie among them.
    rnd = random.Random(11)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for n in range(150):
        own = [f"x{n}y{i}" for i in range(30)]
        for copy in range(2):
            own[rnd.randrange(30)] = f"z{n}v{copy}"
            rows.append((2 * n + copy, " ".join(common + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=repr) == plain_components(rows)


def test_minhash_links_small_sets(spark):
    rnd = random.Random(5)
    rows = []
    for n in range(150):  # 7 shingles and 6 of them: 600 of 700
        words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(11)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_pairs_the_bitmaps_rule_out_are_below_the_threshold():
    rnd = random.Random(2)
    sets = []
    for _ in range(60):
        base = rnd.sample(range(1 << 60), rnd.choice([3, 40, 900]))
        for cut in (0, 1, len(base) // 12, len(base) // 7):
            sets.append(base[cut:] + rnd.sample(range(1 << 60), rnd.choice([0, 1, len(base) // 20])))
    n = minhash.np.array([len(s) for s in sets])
    odd = minhash.np.stack([minhash.parity(minhash.np.array(s, minhash.np.uint64)) for s in sets])
    every = minhash.np.arange(len(sets))
    kept = {(int(a), int(b)) for x, y, _ in minhash.alike(n, every, odd, every, every, 85, 100)
            for a, b in zip(x, y)}
    linked = {(a, b) for a, s in enumerate(sets) for b, t in enumerate(sets)
              if a != b and 100 * len(set(s) & set(t)) >= 85 * len(set(s) | set(t))}
    assert linked and linked <= kept and len(kept) < 3 * len(linked)


def test_forest_joins_what_pairs_join():
    x, y = minhash.np.array([0, 0, 1, 3, 4, 4]), minhash.np.array([1, 2, 2, 4, 3, 5])
    differ = minhash.np.array([5, 1, 2, 0, 0, 9])
    found = list(minhash.forest(iter([(x, y, differ)]), minhash.np.array([70, 71, 72, 73, 73, 75])))
    assert [(int(a), int(b)) for p, q in found for a, b in zip(p, q)] == [(0, 2), (1, 2), (4, 5)]


def test_minhash_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(docs).collect() == []


def test_signature_is_circulant():
    hashes = minhash.shingle_set("a b c d e f g h i j k l m", 5)
    sig = minhash.signature(hashes, 16)
    assert sig.size == 16 and len(set(sig.tolist())) == 16
    assert (minhash.signature(hashes[:1], 4) == minhash.signature(hashes[:1], 8)[:4]).all()
    assert (minhash.signature(hashes, 8) == minhash.signature(hashes[::-1].copy(), 8)).all()
