"""MinHash near-dedup with a circulant signature: two permutations, one of them shifted circularly.

A document's set is its distinct ``width``-word shingles (lower-cased A-Z, words split on blanks),
each named by the unsigned XXH64 of its UTF-8 text (seed 42). For K coordinates the signature is

    sig[k] = min over the set of pi((sigma(x) + k) mod 2**64)

where ``sigma`` and ``pi`` are fixed bijections of the 64-bit words: ``pi`` shifted by k places stands
for the k-th permutation (C-MinHash, Li and Li 2021). All K coordinates come from the two permutations,
before the signature is cut into bands. ``pi`` multiplies, folds and multiplies again: a single product
would only turn a circle of fixed points, and the coordinates of a small set would agree or differ together.

A task keeps of each document only the hash of its sorted set, the set size, the band keys and a parity
bitmap, never the set itself. Spark does the rest. Equal sets are one class (grouped by that hash,
pre-aggregated); classes meet in (band, band key) buckets, and every pair of a bucket is settled:

1. Each bucket has two star centres, its smallest and its largest class; every other member is verified
   against both. A bucket of many near copies becomes one component here, at the cost of its size.
2. Members that then lie in different components are compared pair by pair, in blocks of bounded size. A
   forest of them, the closest first, is verified, and then all that still lie in different components.

Parity bitmaps come before every verification: a set differs from another in at least as many shingles as
their bitmaps in bits, so a pair that differs in too many bits is below the threshold for certain.

A pair is verified on the full sets of shingle strings, rebuilt from the texts of the two classes'
representatives (read again from the input by doc_id and a text hash). Verified links give components by
joins (``graph.components``). Step 2 compares bitmaps by the square of a bucket only where its members are not alike.

What is left to chance is only that two sets share no bucket: (1 - 0.85 ** 4) ** 30, less than once in
10 ** 9 pairs right at the threshold of 0.85, and less above it.

Edge cases (the result always has one row per input row):
* null or empty text, or a text without words: empty set, ``n_shingles`` 0, linked with nothing,
  ``component_id`` = its own doc_id.
* fewer words than ``width``: the whole word sequence is the one shingle.
* null doc_id: takes part in links; a component holds the smallest non-null doc_id reachable
  (null if it has none); ``kept`` is false for a null doc_id.
* repeated rows and repeated ids: each row is its own document; equal texts are one class.
* extra columns are dropped; only doc_id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import arrow_rows, mix64
from pagemill.llm.graph import components
from pagemill.session import checkpointed

# fixed values of the contract: blanks that split words, the shingle hash seed
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SEED = 42
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SIGMA_KEY = np.uint64(0x9E3779B97F4A7C15)
PI_MUL = np.uint64(0xD6E8FEB86659FD93)  # odd: a bijection of the 64-bit words
PI_MUL_2 = np.uint64(0xC4CEB9FE1A85EC53)
PARITY_BITS = 1024
BLOCK = 1000  # members of a bucket compared with as many at once
FEW = 200_000  # so many wanted texts are found by a broadcast of their ids; for more, the texts are shuffled
CHUNK = 2048  # shingles scrambled at once: bounds the n x K block of one long text


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, width: int) -> set[str]:
    """The distinct ``width``-word shingles of ``text`` (the whole sequence if shorter; none without words)."""
    words = words_of(text)
    if not words:
        return set()
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct unsigned hashes of the shingles of ``text``."""
    grams = shingles(text, width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g.encode(), SEED) for g in grams), np.uint64, len(grams)))


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k circulant MinHash coordinates of a non-empty set: min of pi(sigma(x) + k)."""
    shifts = np.arange(k, dtype=np.uint64)
    low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, hashes.size, CHUNK):
            m = mix64(hashes[at:at + CHUNK] ^ SIGMA_KEY)[:, None] + shifts[None, :]
            m *= PI_MUL
            m ^= m >> np.uint64(32)
            m *= PI_MUL_2
            np.minimum(low, m.min(axis=0), out=low)
    return low


def parity(hashes: np.ndarray) -> np.ndarray:
    """One bit for each of PARITY_BITS slots: whether an odd number of the set's hashes falls in it."""
    counts = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.uint64)


def marked(docs: DataFrame, width: int, bands: int, rows_per_band: int) -> DataFrame:
    """doc_id, th (hash of the text), cls (hash of the sorted set; null if empty), n (set size), band keys, parity."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])
    k = bands * rows_per_band

    def per_batch(doc_id, text, th):
        cls, n, keys, odd = [], [], [], []
        for t in text:
            s = shingle_set(t, width)
            n.append(int(s.size))
            if s.size == 0:
                cls.append(None)
                keys.append([])
                odd.append(None)
                continue
            odd.append(parity(s).view(np.int64))
            cls.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
            sig = signature(s, k).reshape(bands, rows_per_band)
            keys.append([xxhash.xxh64_intdigest(row.tobytes()) - (1 << 63) for row in sig])
        return doc_id, th, cls, n, keys, odd

    return rows.mapInArrow(lambda b: arrow_rows(b, schema, per_batch),
                           "doc_id long, th long, cls long, n long, bands array<long>, parity array<long>")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b) pairs of classes whose full shingle sets reach ``threshold`` Jaccard, exactly."""
    num, den = int(round(threshold * 100)), 100
    sizes = classes.select("cls", "n", "parity")
    bits = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    pairs = (pairs.join(sizes.toDF("a", "na", "pa"), "a").join(sizes.toDF("b", "nb", "pb"), "b")
             .where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
             .where((den + num) * bits <= (den - num) * (F.col("na") + F.col("nb"))).select("a", "b"))
    pairs = checkpointed(pairs)
    wanted = (pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
              .join(classes.select("cls", "rep_id", "rep_th"), "cls"))
    wanted = checkpointed(wanted)
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    source = docs.select(F.col("doc_id").cast("long").alias("sid"), F.col("text").cast("string"))
    source = source.withColumn("sth", F.xxhash64("text"))
    texts = (source.join(wanted, F.col("sid").eqNullSafe(F.col("rep_id")) & (F.col("sth") == F.col("rep_th")))
             .select("cls", "text").dropDuplicates(["cls"]))
    both = (pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ok", pa.bool_())])

    def per_batch(a, b, ta, tb):
        ok = []
        for x, y in zip(ta, tb):
            sx, sy = shingles(x, width), shingles(y, width)
            inter = len(sx & sy)
            ok.append(den * inter >= num * (len(sx) + len(sy) - inter))
        return a, b, ok

    return (both.mapInArrow(lambda bs: arrow_rows(bs, schema, per_batch), "a long, b long, ok boolean")
            .where("ok").select("a", "b"))


def alike(n: np.ndarray, part: np.ndarray, odd: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int):
    """(x, y, differ) places of ``left`` x ``right`` in different parts that sizes and bitmaps do not rule out.

    Sets of s elements together and d on one side only reach num / den if (den + num) * d <= (den - num) * s.
    """
    for at in range(0, left.size, 64):
        i = left[at:at + 64]
        differ = np.bitwise_count(odd[i][:, None, :] ^ odd[right][None, :, :]).sum(2, dtype=np.int64)
        np.maximum(differ, np.abs(n[i][:, None] - n[right][None, :]), out=differ)
        near = (den + num) * differ <= (den - num) * (n[i][:, None] + n[right][None, :])
        near &= part[i][:, None] != part[right][None, :]
        x, y = np.nonzero(near)
        yield i[x], right[y], differ[x, y]


def forest(pairs, part: np.ndarray):
    """Of the pairs that ``alike`` gives, at most one fewer than there are parts: the closest that join two trees."""
    root = np.unique(part, return_inverse=True)[1]
    for x, y, differ in pairs:
        order = np.argsort(differ, kind="stable")
        x, y = x[order], y[order]
        apart = np.arange(x.size)
        kept = []
        while (apart := apart[root[x[apart]] != root[y[apart]]]).size:
            first = apart[0]
            kept.append(first)
            root[root == root[y[first]]] = root[x[first]]
        yield x[kept], y[kept]


def unsettled(shared: DataFrame, labels: DataFrame, classes: DataFrame, num: int, den: int, trees: bool) -> DataFrame:
    """(a, b) classes of one bucket, neither a centre, in different components, that may reach num / den.

    With ``trees`` a bucket gives no more pairs than it has members; without, all, each in the first band it shares.
    """
    placed = (shared.where("cls <> low and cls <> high").join(labels, "cls", "left")
              .select("cls", "band", "key", F.coalesce("component", "cls").alias("part")))
    split = (placed.groupBy("band", "key")
             .agg(F.min("part").alias("first"), F.max("part").alias("last"), F.count("*").alias("m"))
             .where("first < last").select("band", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    dealt = (placed.join(split, ["band", "key"])
             .withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .join(classes.select("cls", "n", (F.array().cast("array<long>") if trees else F.col("bands")).alias("bands"),
                                  "parity"), "cls"))
    groups = (dealt.groupBy("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
              .agg(F.collect_list(F.struct("cls", "n", "part", "block", "bands", "parity")).alias("rows"))
              .select("band", "i", "j", "rows"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for band, i, j, found in zip(*[c.to_pylist() for c in batch.columns[:3]], batch.column(3)):
                *columns, bands, odd = found.values.flatten()
                cls, n, part, block = (c.to_numpy() for c in columns)
                keys = bands.flatten().to_numpy().reshape(len(cls), -1)[:, :band]
                odd = odd.flatten().to_numpy().view(np.uint64).reshape(len(cls), -1)
                pairs = alike(n, part, odd, np.flatnonzero(block == i), np.flatnonzero(block == j), num, den)
                for x, y, *_ in forest(pairs, part) if trees else pairs:
                    if not trees:
                        new = (cls[x] < cls[y]) if i == j else np.ones(x.size, bool)
                        x, y = x[new], y[new]
                        new = ~(keys[x] == keys[y]).any(1)
                        x, y = x[new], y[new]
                    a, b = cls[x], cls[y]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))],
                                                     schema=schema)

    return groups.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.85, bands: int = 30,
                    rows_per_band: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every input row (see the module text)."""
    sets = checkpointed(marked(docs, width, bands, rows_per_band))
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    classes = checkpointed(sets.where(F.col("n") > 0).groupBy("cls").agg(
        F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.first("parity").alias("parity"), rep.alias("rep"))
        .select("cls", "low", "n", "bands", "parity", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")))
    members = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    centres = (members.groupBy("band", "key")
               .agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("m")).where("m > 1"))
    shared = checkpointed(members.join(centres, ["band", "key"]).drop("m"))
    asked = (shared
             .select("cls", F.explode(F.array("low", "high")).alias("centre")).where("cls <> centre")
             .select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct())
    links = checkpointed(verified(asked, classes, docs, width, threshold))
    labels = components(links).withColumnRenamed("id", "cls")
    for trees in (True, False):
        rest = checkpointed(unsettled(shared, labels, classes, int(round(threshold * 100)), 100, trees))
        if rest.isEmpty():
            break
        links = links.union(checkpointed(verified(rest, classes, docs, width, threshold)))
        labels = components(links).withColumnRenamed("id", "cls")
    low = (classes.select("cls", "low").join(labels, "cls", "left")
           .withColumn("component", F.coalesce("component", "cls")))
    lowest = low.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = low.join(lowest, "component").select("cls", "component_id")
    out = (sets.join(by_class, "cls", "left")
           .select("doc_id", F.col("n").alias("n_shingles"),
                   F.coalesce("component_id", F.when(F.col("cls").isNull(), F.col("doc_id"))).alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
