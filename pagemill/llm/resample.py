"""Importance resampling toward a target distribution of hashed n-gram features.

Features of a text are all runs of 1 to ``order`` consecutive words (lower-cased A-Z; a word is a run
of letters, digits or non-ASCII characters), joined by one space, repeats counted. A feature falls in
bucket crc32(UTF-8) mod ``buckets``. With s, S the bucket and total counts over the raw corpus and t, T
over the target texts, a bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))); a document's
weight is the floored mean gain of its features (0 without features). Adding Gumbel noise from
sha256("<seed>:<doc_id>") and taking the highest scores draws without replacement in proportion to
exp(weight / 1000) (Gumbel top-k).

Inside a task each Arrow batch interns its n-grams in open-addressed tables kept in NumPy arrays:
probing is linear and vectorised over all occurrences at once. Words are keyed by XXH64 of their
UTF-8 bytes, and an equal key is accepted only after the bytes themselves compare equal; a pair of
neighbouring words is keyed by the pair of its two word slots, which is the pair itself. Each
distinct n-gram of the batch gets one slot holding its bucket; every occurrence carries its slot id, so
counting is one ``bincount`` and scoring one gather of the gains. A distinct word costs one crc32; crc32
being linear, that of a pair is put together from those of its words, for all new pairs of a round at once.

Spark does the rest: bucket counts are summed by a pre-aggregated ``groupBy`` (at most ``buckets``
keys), the gains (``buckets`` numbers) travel to the tasks of the second pass, and the draw ranks by a
range-partitioned sort with per-partition offsets, so no task or driver holds all documents.

Edge cases: null text has no words (n_features 0, weight 0). A null doc_id gets a null score and is never
drawn; it is not counted in N. Texts of fewer than ``least_words`` words are not drawn (rank null) and
not counted in N. Repeated rows are separate documents (equal scores, ranked by doc_id, then
arbitrarily). An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import arrow_rows
from pagemill.session import checkpointed

# fixed values of the contract: what a word is, the lower-casing, the noise seed prefix
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# The same words found in UTF-8, where ASCII characters are single bytes, all others bytes of 0x80 and up:
# this maps letters to lower case and what is in no word to a blank.
_ASCII = bytes(range(128)).decode().translate(LOWER)
WORD_BYTES = "".join(c if WORD.match(c) else " " for c in _ASCII).encode() + bytes(range(128, 256))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def features(words: list[str], order: int) -> list[bytes]:
    out = []
    for n in range(1, order + 1):
        out += [" ".join(words[i:i + n]).encode() for i in range(len(words) - n + 1)]
    return out


class Interned:
    """An open-addressed table in NumPy arrays: 64-bit keys, linear probing, and for byte strings a check
    of the bytes themselves before a key is taken as a match.

    Slot ids are handed out in order of first arrival; ``bucket`` holds each slot's bucket.
    """

    def __init__(self, expected: int, buckets: int):
        self.size = 1 << max(4, (2 * max(1, expected) - 1).bit_length())
        self.mask = self.size - 1
        self.keys = np.zeros(self.size, np.uint64)
        self.slot_at = np.full(self.size, -1, np.int64)  # position -> slot id
        self.n = 0
        self.buckets = buckets
        self.bucket = np.zeros(0, np.int64)  # slot id -> bucket

    def _probe(self, keys: np.ndarray, same_item, add_slots) -> np.ndarray:
        """Slot of every key; ``same_item(occurrences, slots)`` verifies equal keys, ``add_slots(owners)``
        makes the buckets of new slots."""
        pos = (mix(keys) & np.uint64(self.mask)).astype(np.int64)
        slot = np.full(keys.size, -1, np.int64)
        todo = np.arange(keys.size)
        while todo.size:
            p = pos[todo]
            free = self.slot_at[p] < 0
            if free.any():
                places, owners = p[free], todo[free]
                self.slot_at[places] = owners  # one occurrence wins each place; it owns the new slot
                won = self.slot_at[places] == owners
                places, owners = places[won], owners[won]
                self.slot_at[places] = np.arange(self.n, self.n + owners.size)
                self.keys[places] = keys[owners]
                self.n += owners.size
                self.bucket = np.concatenate([self.bucket, add_slots(owners)])
            sid = self.slot_at[p]
            near = np.flatnonzero(self.keys[p] == keys[todo])
            hit = near[same_item(todo[near], sid[near])]
            slot[todo[hit]] = sid[hit]
            miss = np.ones(todo.size, bool)
            miss[hit] = False
            todo = todo[miss]
            pos[todo] = (pos[todo] + 1) & self.mask
        return slot

    def intern(self, grams: list[bytes]) -> np.ndarray:
        """Slot id of every byte string: XXH64 keys, bytes compared on equal keys."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams))
        items = np.fromiter(grams, object, len(grams))
        if not hasattr(self, "texts"):
            self.texts = np.zeros(0, object)  # slot id -> bytes
            self.crc = np.zeros(0, np.uint32)  # slot id -> crc32 of its bytes
            self.length = np.zeros(0, np.int64)

        def same(occ, sid):
            return items[occ] == self.texts[sid]

        def add(owners):
            new = items[owners]
            crc = np.fromiter(map(zlib.crc32, new), np.uint32, new.size)
            self.texts = np.concatenate([self.texts, new])
            self.crc = np.concatenate([self.crc, crc])
            self.length = np.concatenate([self.length, np.fromiter(map(len, new), np.int64, new.size)])
            return crc.astype(np.int64) % self.buckets

        return self._probe(keys, same, add)

    def intern_pairs(self, first: np.ndarray, second: np.ndarray, words: "Interned") -> np.ndarray:
        """Slot id of every pair of slots of the table ``words``; the pair is the item itself, so equal
        keys are equal items. A new pair's crc32 is that of "first second", from the crc32 of both words
        and the length of the second, so its bytes are never put together."""
        keys = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        spaced = joined_crc(words.crc, np.uint32(zlib.crc32(b" ")), np.ones(words.n, np.int64))

        def add(owners):
            a, b = first[owners], second[owners]
            return joined_crc(spaced[a], words.crc[b], words.length[b]).astype(np.int64) % self.buckets

        return self._probe(keys, lambda occ, sid: np.ones(occ.size, bool), add)


def _zeros_after(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map of ``table`` (its value for every value of each of the four bytes) applied to ``crc``."""
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


# ZEROS[k] carries the remainder of a crc32 over 2**k zero bytes.
ZEROS = [np.array([[~zlib.crc32(b"\0", ~(v << 8 * i) & 0xFFFFFFFF) & 0xFFFFFFFF for v in range(256)] for i in range(4)],
                  np.uint32)]
while len(ZEROS) < 40:
    ZEROS.append(_zeros_after(ZEROS[-1], ZEROS[-1]))


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings put together, from the crc32 of each and the length of the second."""
    out = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        out[at] = _zeros_after(ZEROS[k], out[at])
    return out ^ second


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))


CHUNK = 1 << 20  # words interned in one table: bounds a task's memory whatever the batch holds


def _chunks(texts):
    """Runs of consecutive texts with about CHUNK words: words of each text (UTF-8), in order."""
    run, n = [], 0
    for t in texts:
        w = (t or "").encode().translate(WORD_BYTES).split()
        run.append(w)
        n += len(w)
        if n >= CHUNK:
            yield run
            run, n = [], 0
    if run:
        yield run


def _features(run: list[list[bytes]], buckets: int):
    """Per text of the run: word count; per feature occurrence: its text's place and its bucket.

    Words are interned by their bytes; a pair of neighbouring words by the pair of their word slots.
    """
    counts = np.array([len(w) for w in run], np.int64)
    words = [x for w in run for x in w]
    place = np.repeat(np.arange(len(run)), counts)
    if not words:
        return counts, place, np.zeros(0, np.int64)
    table = Interned(len(words), buckets)
    slots = table.intern(words)
    same_text = np.flatnonzero(place[1:] == place[:-1])
    if same_text.size:
        pairs = Interned(same_text.size, buckets)
        two = pairs.intern_pairs(slots[same_text], slots[same_text + 1], table)
        place = np.concatenate([place, place[same_text]])
        bucket = np.concatenate([table.bucket[slots], pairs.bucket[two]])
    else:
        bucket = table.bucket[slots]
    return counts, place, bucket


def bucket_counts(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, count of feature occurrences over all rows of ``texts`` (a ``text`` column)."""
    if order != 2:
        raise ValueError("features are runs of one and two words")
    schema = pa.schema([("bucket", pa.int64()), ("count", pa.int64())])

    def per_batch(text):
        counts = np.zeros(buckets, np.int64)
        for run in _chunks(text):
            _, _, bucket = _features(run, buckets)
            counts += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(counts)
        return at.tolist(), counts[at].tolist()

    rows = texts.select(F.col("text").cast("string"))
    found = rows.mapInArrow(lambda b: arrow_rows(b, schema, per_batch), "bucket long, count long")
    return found.groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for every bucket, in doubles."""
    b = s.size
    ratio = (t + 1.0) * (float(s.sum()) + b) / ((s + 1.0) * (float(t.sum()) + b))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, order: int) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain; 0 without features) of every row."""
    buckets = gain.size
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
                        ("weight", pa.int64())])

    def per_batch(doc_id, text):
        all_words, all_feats, weight = [], [], []
        for run in _chunks(text):
            counts, place, bucket = _features(run, buckets)
            n_feats = counts + np.maximum(counts - 1, 0)
            sums = np.zeros(len(run), np.int64)
            np.add.at(sums, place, gain[bucket])
            all_words += counts.tolist()
            all_feats += n_feats.tolist()
            weight += [int(t // n) if n else 0 for t, n in zip(sums.tolist(), n_feats.tolist())]
        return doc_id, all_words, all_feats, weight

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: arrow_rows(b, schema, per_batch),
                           "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, score: str, key: str, take: int) -> DataFrame:
    """``rows`` with rank 1.. by ``score`` falling, then ``key``; ranks past ``take`` are null.

    A range-partitioned sort, then each partition's rows are numbered from the sum of the sizes of the
    partitions before it (one number a partition travels through the driver).
    """
    ordered = checkpointed(rows.orderBy(F.desc(score), F.asc(key))
                           .withColumn("_part", F.spark_partition_id())
                           .withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted((r["_part"], r["count"]) for r in ordered.groupBy("_part").count().collect())
    offsets, total = {}, 0
    for part, n in sizes:
        offsets[part] = total
        total += n
    start = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))]) if offsets else None
    index = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    rank = (start[F.col("_part")] + index + 1) if start is not None else F.lit(None).cast("long")
    return ordered.withColumn("rank", F.when(rank <= take, rank)).drop("_part", "_at")


def resample(docs: DataFrame, target: DataFrame, share: float = 0.25, order: int = 2, buckets: int = 10000,
             seed: int = 7, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank (see the module text)."""
    s = np.zeros(buckets, np.int64)
    t = np.zeros(buckets, np.int64)
    for r in bucket_counts(docs, order, buckets).collect():
        s[r["bucket"]] = r["count"]
    for r in bucket_counts(target, order, buckets).collect():
        t[r["bucket"]] = r["count"]
    rows = checkpointed(weighted(docs, gains(s, t), order))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10)
    u = (h.cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000.0 * F.log(-F.log(u)))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("long"))
    drawable = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    n = rows.where(drawable).count()
    take = round(share * 100) * n // 100
    drawn = ranked(rows.where(drawable), "score", "doc_id", take)
    rest = rows.where(~drawable).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
