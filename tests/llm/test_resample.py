import hashlib
import math
import random
import zlib

from pagemill.llm import resample

SCHEMA = "doc_id long, text string, weight string, rank int"  # clashing extra columns


def plain(rows, target, share=0.25, buckets=10000):
    def feats(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words, cur = [], ""
        for c in text:
            if ord(c) >= 0x80 or "0" <= c <= "9" or "a" <= c <= "z":
                cur += c
            elif cur:
                words.append(cur)
                cur = ""
        if cur:
            words.append(cur)
        return words, words + [words[i] + " " + words[i + 1] for i in range(len(words) - 1)]

    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for f in feats(t)[1]:
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c

    s, t = counts([x for _, x in rows]), counts(target)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for d, text in rows:
        words, fs = feats(text)
        w = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(fs), w, score, None, len(words)])
    pool = sorted([r for r in out if r[3] is not None and r[5] >= 20], key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(pool[:25 * len(pool) // 100]):
        r[4] = i + 1
    return sorted([tuple(r[:5]) for r in out], key=repr)


def fixture(seed=5):
    rnd = random.Random(seed)
    vocab = ["alpha", "Beta", "gamma", "délta", "x9", "ok", "zz", "Q", "the", "of"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60))) + rnd.choice(["", "!", ",,x"]))
            for i in range(120)]
    rows += [(200, None), (201, ""), (202, "...,,,"), (None, "alpha beta " * 30), (203, "a " * 25),
             (203, "a " * 25), (204, "word" * 5000)]
    target = ["alpha Beta gamma the of", "délta x9 x9", None, ""]
    return rows, target


def test_resample_equals_brute_force(spark):
    rows, target = fixture()
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, bench).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(rows, target)


def test_resample_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs, bench).collect() == []


def test_interning_verifies_bytes():
    table = resample.Interned(4, 10)
    grams = [b"a", b"b", b"a", b"c", b"b", b"a"] * 50
    slot = table.intern(grams)
    assert len(table.texts) == 3 and [table.texts[i] for i in slot] == grams
    table.keys[:] = 0  # every stored key now differs: occurrences must probe on, never merge
    again = table.intern([b"a"])
    assert table.texts[again[0]] == b"a"


def test_pairs_are_not_hashed_one_by_one(monkeypatch):
    words = [b"w%d" % i for i in range(50)]
    run = [[a, b] for a in words for b in words]  # 2500 distinct pairs of 50 words
    calls = []
    plain_crc = zlib.crc32
    monkeypatch.setattr(resample.zlib, "crc32", lambda *a: calls.append(a) or plain_crc(*a))
    counts, place, bucket = resample._features(run, 10000)
    assert len(calls) <= 51
    assert counts.tolist() == [2] * 2500
    assert bucket[5000:].tolist() == [plain_crc(a + b" " + b) % 10000 for a, b in run]


def test_crc_of_pairs_of_any_length():
    rnd = random.Random(3)
    words = [bytes(rnd.choices(b"az09\x80\xff", k=n)) for n in [*range(1, 70), 255, 256, 257, 4096, 70001]]
    rnd.shuffle(words)
    run = [words, words[::-1], words[:1], []]
    counts, place, bucket = resample._features(run, 1 << 32)
    want = [(i, w) for i, t in enumerate(run) for w in t]
    want += [(i, a + b" " + b) for i, t in enumerate(run) for a, b in zip(t, t[1:])]
    assert counts.tolist() == [74, 74, 1, 0]
    assert list(zip(place.tolist(), bucket.tolist())) == [(i, zlib.crc32(f)) for i, f in want]


def test_words_of_every_character():
    chars = [*map(chr, range(0xD800)), "\ue000", "\uffff", "\U0001f600"]
    texts = ["".join(f"A{c}z" for c in chars), None, "".join(chars)]
    cut = [w for run in resample._chunks(texts) for w in run]
    assert [[x.decode() for x in w] for w in cut] == [resample.words_of(t) for t in texts]
