"""Operators that look at one row at a time: pieces, language, secrets, URLs."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from pagemill.llm import language, secrets, sentencepieces, urlfilter
from pagemill.llm.jobs import PIECES, RANKS, URL_RULES, op1_sentencepiece, op2_language_id, op4_secret_scan

EXTRA = "doc_id long, text string, ids string, spans int, lang_pred int"  # columns whose names clash


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], EXTRA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- SentencePiece ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encoding_equals_the_library(library):
    enc = sentencepieces.PieceEncoder(PIECES)
    random.seed(1)
    texts = ["", " ", "  a  b ", "a\tb\nc", "▁x ▁", "<s> </s> <unk> <0x41>", "日本語🙂", "a" * 20_000, " " * 300,
             "x" + " " * 77 + "y", "the" * 3000, "\n\n \n", "é" * 50, "=" * 999, "\x00a"]
    texts += ["".join(random.choice("ab  ▁the\n\t日本🙂éñing<0x>\x00ﬁ　̀") for _ in range(random.randrange(80)))
              for _ in range(3000)]
    for t in texts:
        want = library.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want, t
        assert enc.decode(enc.encode(t)) == library.decode(want)


def test_round_trip_query(spark, folder, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op1_sentencepiece(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == sha(library.decode(ids).encode())


def test_encode_and_decode_rows(spark, library):
    texts = [(1, None), (2, ""), (2, ""), (None, "Hi  there"), (3, "word " * 60_000)]
    encoded = sentencepieces.encode(docs_of(spark, texts), PIECES)
    back = sentencepieces.decode(encoded, PIECES)
    assert sorted([(r.doc_id, len(r.ids)) for r in encoded.collect()], key=repr) == sorted(
        [(i, len(library.encode(t or "", add_bos=True, add_eos=True))) for i, t in texts], key=repr)
    assert sorted([tuple(r) for r in back.collect()], key=repr) == sorted([(i, t or "") for i, t in texts], key=repr)
    assert sentencepieces.encode(docs_of(spark, []), PIECES).count() == 0


# --- language --------------------------------------------------------------------------------------------------------

def small_model():
    random.seed(2)
    words = {"aa": ["the", "of", "thing", "and"], "bb": ["der", "die", "und", "keit"]}
    return language.fit([(lang, random.choices(ws, k=30)) for lang, ws in words.items() for _ in range(40)], rounds=3)


def test_forward_backward_equals_enumeration():
    model = small_model()
    words = "der the of und die thing".split()
    scores = np.array([model.scores(w) for w in words])
    k = len(model.labels)
    want = np.zeros((len(words), k))
    for labels in itertools.product(range(k), repeat=len(words)):
        weight = np.exp(sum(scores[i, y] for i, y in enumerate(labels))
                        + sum(model.transition[a, b] for a, b in zip(labels, labels[1:])))
        for i, y in enumerate(labels):
            want[i, y] += weight
    want /= want.sum(1, keepdims=True)
    for copies in (1, 40):  # 240 words pass over block borders
        got = model.marginals(np.tile(scores, (copies, 1)), np.array([len(words)] * copies))
        assert np.allclose(got, np.tile(want, (copies, 1)))
    long = model.marginals(np.tile(scores, (50, 1)), np.array([len(words) * 50]))
    error, _ = language.gradient(model.transition, np.tile(scores, (50, 1)), np.zeros(300, int), np.array([300]))
    error[:, 0] += 1
    assert np.allclose(long, error)


def test_language_edge_cases(spark):
    texts = [(1, None), (2, ""), (3, "12 !? 3"), (None, "the of the"), (4, "der und"), (4, "der und"),
             (5, "the " * 50_000)]
    rows = language.predict(docs_of(spark, texts), small_model()).collect()
    got = sorted([(r.doc_id, r.lang_pred) for r in rows], key=repr)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "aa"), (4, "bb"), (4, "bb"), (5, "aa")], key=repr)
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.predict(docs_of(spark, []), small_model()).count() == 0
    kept = language.reject(docs_of(spark, texts), small_model())
    assert kept.count() == 4 and kept.columns == ["doc_id", "text", "ids", "spans", "lang_pred"]
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(docs_of(spark, texts), language.train(none)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op2_language_id(spark, folder).collect()
    assert len(rows) == len(known)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == known[r.doc_id] for r in tested) >= 0.95 * len(tested)


# --- secrets ---------------------------------------------------------------------------------------------------------

def plain_base(text):
    spans = [("assign", *m.span()) for m in re.finditer(
        r"""((?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
        r"""[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]])))


def test_secret_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op4_secret_scan(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id] or "")
        assert r.base_sha256 == sha(base.encode())
        kinds = [s.split(":")[0] for s in base.split(",")]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, ("assign", "access", "hex")))
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_secret_edge_cases(spark):
    key = "q7Xv2Kp9ZrT4mWb8LcN3sHd6"
    cases = ["ſecret=abcdefgh", "secret=token:abcdefgh", "token=abc token='abcdef'", "API_KEY : \"a1b2c3\"", "AKIA" * 9,
             f"é {key} é", "0123456789abcdef" * 2, "550e8400-e29b-41d4-a716-446655440000 is_a_long_identifier_name",
             "TotallyReadableCamelCaseName2", "", None, "a1 " * 50_000]
    df = docs_of(spark, [(i, c) for i, c in enumerate(cases)] + [(None, key), (None, key)])
    rows = secrets.find_secrets(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(cases) + 2
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].base_joined == plain_base(c or "") for i, c in enumerate(cases))
    assert [(s.kind, s.start, s.end) for s in by_id[5].spans] == [("random", 2, 26)]
    assert by_id[None].all_joined == "random:0:24"
    assert all("random" not in by_id[i].all_joined for i in (6, 7, 8, 9, 10, 11))
    assert secrets.find_secrets(docs_of(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# --- URLs ------------------------------------------------------------------------------------------------------------

def test_urls(spark):
    cases = {
        "http://Sub.Example.ORG/es/1": ("sub.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/1234?q#f": ("example.org", "/en/1234", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"),
        "http://notcom/de/": ("notcom", "/de/", None, "allow"),
        "http://a.com/x://b.org/": ("a.com", "/x://b.org/", None, "allow"),
        "x://org": ("org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "://É.org\n/": ("É.org\n", "/", None, "allow"), "http://" + "a." * 20_000 + "org/": None,
    }
    rows = [(i, u, "host") for i, u in enumerate(cases)] + [(None, "ftp://x.org/", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judge_urls(df, URL_RULES).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(cases.values()):
        assert want is None or got[i] == want
    assert got[None] == ("x.org", "/", "org/", "allow") and got[11][2:] == ("org/", "allow")
    assert urlfilter.judge_urls(df.where("false"), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urlfilter.judge_urls(df, URL_RULES, max_rules=2)


def test_trie_equals_scan_of_all_rules():
    random.seed(6)
    part = lambda: random.choice(["a", "b", "ab", ""])
    rules = list({(h, p): (random.choice(["allow", "block"]), h, p) for h, p in (
        (".".join(filter(None, [part(), part()])) or "a", "/" + part() + random.choice(["", "/" + part()]))
        for _ in range(60))}.values())
    trie = urlfilter.RuleTrie(rules)
    for _ in range(3000):
        host = ".".join(filter(None, [part(), part(), part()])) or "b"
        path = "/" + "/".join(part() for _ in range(random.randrange(4)))
        fits = [(h.count("."), len(p), h + p, v) for v, h, p in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[2:] if fits else None
        assert trie.find(host, path) == want
