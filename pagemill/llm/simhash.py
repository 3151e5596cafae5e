"""SimHash near-duplicates, compared bit-sliced.

A fingerprint has a 1 where more than half of the shingle hashes have one. Two
texts are linked if their fingerprints differ in at most ``radius`` bits; a class is
what links reach. Distinct fingerprints alone are compared, and only within
blocks that share a key:

* ``pieces``: the fingerprint is cut in radius + 2 runs of bits. Two fingerprints
  within the radius agree in at least two of them, so a block for each pair of
  runs loses no link;
* ``bands``: for radii too wide for that, pairs of minima of the scrambled shingle
  hashes. Two texts of similarity s miss each other with probability
  (1 - s^2)^bands.

Within a block the bits are stored vertically, a plane for each bit position. The
differences of up to 64 fingerprints in a machine word are added up at once in
bitwise counters, three planes a step by carry-save addition, and a strip of
comparisons is abandoned when all its counters have passed the radius. Small blocks share the machine words. A block
of more than ``CELL`` members is dealt out in cells of two parts each. A cell gives the
links that join its classes, one a member at most, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.common import arrow_rows, doc_texts, mix64
from pagemill.llm.graph import components
from pagemill.session import stored

CELL = 4096
SEED = 42
LAST = (1 << 63) - 1  # stands for a null id: after all others
_STRIP = 256  # fingerprints compared with a whole cell at once
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SMALL = 64  # blocks of so many members are compared pair by pair, many blocks at once
_PAIRS = 100_000  # at once
_TRIANGLES = [np.triu_indices(n, 1) for n in range(_SMALL + 1)]


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every shingle of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    grams = zip(*[words[i:] for i in range(width)])
    return np.fromiter([digest(g, SEED) for g in map(b" ".join, grams)], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> bytes:
    """64 * ``words`` bits, big-endian; beyond the first word the hashes are scrambled anew."""
    out = b""
    for n in range(words):
        h = hashes if n == 0 else mix64(hashes + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            bits = np.unpackbits(h[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(0, dtype=np.int64)
        out += np.packbits(ones * 2 > len(h)).tobytes()
    return out


def band_keys(hashes: np.ndarray, bands: int) -> list[int]:
    """One key a band: two minima of the hashes under two scrambles."""
    if not bands or not len(hashes):
        return [0] * bands
    odd = mix64(np.arange(1, 2 * bands + 1, dtype=np.uint64)) | np.uint64(1)
    mixed = mix64(hashes)
    minima = np.array([(mixed * m).min() for m in odd], np.uint64)
    keys = mix64(minima[0::2]) + minima[1::2] + np.arange(bands, dtype=np.uint64)
    return keys.view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, bands: int = 0) -> DataFrame:
    """doc_id, of (hash of the text), fp, keys of every whole text; null and empty texts have fingerprint zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("fp", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def run(doc_id, text, of):
        hashes = [shingle_hashes(t or "", width) for t in text]
        return doc_id, of, [fingerprint(h, words) for h in hashes], [band_keys(h, bands) for h in hashes]

    of = F.xxhash64(F.col("text").cast("string")).alias("of")
    return doc_texts(docs, of).mapInArrow(
        lambda b: arrow_rows(b, schema, run), "doc_id long, of long, fp binary, keys array<long>")


def piece_keys(radius: int):
    """A column of block keys of a 64-bit fingerprint in the column ``bits``."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    masks = [((1 << int(b)) - (1 << int(a))) for a, b in zip(edges, edges[1:])]
    pairs = [masks[i] | masks[j] for i, j in combinations(range(len(masks)), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in pairs]
    return F.array(*[F.xxhash64(F.lit(n), F.col("bits").bitwiseAND(F.lit(m))) for n, m in enumerate(signed)])


def planes_of(values: np.ndarray) -> np.ndarray:
    """(members, words) -> (bits, members / 64): bit b of 64 members in one machine word."""
    bits = np.unpackbits(np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(len(values), -1), axis=1)
    room = -(-len(values) // 64) * 64
    padded = np.zeros((bits.shape[1], room), np.uint8)
    padded[:, :len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _counted(plane, n_bits: int, shape: tuple[int, int], radius: int, valid: np.ndarray) -> np.ndarray | None:
    """Lanes (bits of machine words of ``shape``) with at most ``radius`` ones over all planes; None if abandoned.

    ``plane(b)`` gives the differences at bit b; ``valid`` masks the lanes in use.
    """
    counters = [np.zeros(shape, np.uint64) for _ in range(int(n_bits).bit_length())]

    def add(carry: np.ndarray, at: int) -> None:
        for c in counters[at:]:
            carry, c[...] = c & carry, c ^ carry

    def within() -> np.ndarray:
        """Lanes whose counter is at most the radius, compared from the highest bit down."""
        less, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _FULL)
        for at in range(len(counters) - 1, -1, -1):
            if radius >> at & 1:
                less |= equal & ~counters[at]
                equal &= counters[at]
            else:
                equal &= ~counters[at]
        return (less | equal) & valid

    for b in range(0, n_bits, 3):
        group = [plane(i) for i in range(b, min(b + 3, n_bits))]
        if len(group) == 3:
            x, y, z = group
            both = x ^ y
            add(both ^ z, 0)
            add((x & y) | (both & z), 1)
        else:
            for x in group:
                add(x, 0)
        if b % 12 == 9 and b > radius and not within().any():
            return None
    return within()


def _valid(members: int, n_words: int) -> np.ndarray:
    mask = np.full(n_words, _FULL)
    if members % 64:
        mask[-1] = np.uint64((1 << members % 64) - 1)
    return mask


def _lanes(words: np.ndarray, members: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :members].astype(bool)


def near(strip: np.ndarray, planes: np.ndarray, members: int, radius: int) -> np.ndarray | None:
    """Boolean (strip, members): at most ``radius`` differing bits. None if the strip was abandoned."""
    n_bits, n_words = planes.shape
    own = np.unpackbits(np.ascontiguousarray(strip.astype(">u8")).view(np.uint8).reshape(len(strip), -1), axis=1)
    flips = np.where(own.astype(bool), _FULL, np.uint64(0))  # (strip, bits)
    found = _counted(lambda i: planes[i][None, :] ^ flips[:, i, None], n_bits, (len(strip), n_words), radius,
                     _valid(members, n_words))
    return None if found is None else _lanes(found, members)


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Boolean for each row: the two fingerprints differ in at most ``radius`` bits. A pair is a lane."""
    planes = planes_of(left) ^ planes_of(right)
    found = _counted(lambda i: planes[i][None, :], len(planes), (1, planes.shape[1]), radius,
                     _valid(len(left), planes.shape[1]))
    return np.zeros(len(left), bool) if found is None else _lanes(found, len(left))[0]


def small_links(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int,
                names: np.ndarray | None = None, every: bool = False) -> tuple[list, list]:
    """Forests of many small blocks at once, as row numbers; their pairs fill the lanes together.

    Rows of one name count as joined; ``every`` gives all pairs of two names.
    """
    a_out, b_out, label = [], [], {}

    def root(i: int) -> int:
        while (j := label.get(i, i)) != i:
            label[i] = label.get(j, j)
            i = j
        return i

    sizes = ends - starts
    pairs = np.cumsum(sizes * (sizes - 1) // 2)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(pairs, (pairs[begin - 1] if begin else 0) + _PAIRS, side="right")))
        triangles = [_TRIANGLES[n] for n in sizes[begin:end].tolist()]
        shift = np.repeat(starts[begin:end], [len(t[0]) for t in triangles])
        i, j = (np.concatenate([t[k] for t in triangles]) + shift for k in (0, 1))
        if names is not None:
            apart = names[i] != names[j]
            i, j = i[apart], j[apart]
        hit = near_pairs(values[i], values[j], radius) if len(i) else np.zeros(0, bool)
        x_all, y_all = i[hit].tolist(), j[hit].tolist()
        if every:
            a_out += x_all
            b_out += y_all
            begin = end
            continue
        of = (lambda rows: rows) if names is None else (lambda rows: names[rows].tolist())
        for x, y, p, q in zip(x_all, y_all, of(x_all), of(y_all)):
            if (p := root(p)) != (q := root(q)):
                label[max(p, q)] = min(p, q)
                a_out.append(x)
                b_out.append(y)
        begin = end
    return a_out, b_out


def cell_links(left: np.ndarray, right: np.ndarray | None, radius: int, names: np.ndarray | None = None,
               every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a forest that joins whatever lies within the radius, left to right or inside left.

    ``names`` and ``every`` as in ``small_links``.
    """
    values = left if right is None else np.concatenate([left, right])
    others = values if right is None else right
    base = 0 if right is None else len(left)
    planes = planes_of(others)
    label = np.arange(len(values)) if names is None else np.unique(names, return_inverse=True)[1]
    a_out, b_out = [], []
    for at in range(0, len(left), _STRIP):
        hit = near(left[at:at + _STRIP], planes, len(others), radius)
        if hit is None:
            continue
        for row in np.flatnonzero(hit.any(1)):
            found = np.flatnonzero(hit[row]) + base
            me = at + row
            strange = found[label[found] != label[me]]
            if every:
                strange = strange[strange > me]
                a_out += [me] * len(strange)
                b_out += strange.tolist()
            elif len(strange):  # one link for each class that is new to this row
                classes, first = np.unique(label[strange], return_index=True)
                a_out += [me] * len(classes)
                b_out += strange[first].tolist()
                label[np.isin(label, classes)] = label[me]
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def _linked(radius: int, every: bool = False):
    """Sorted rows (key, cell, side, id, fp, label if known) -> links (a, b); rows of one cell lie together."""

    def links_of(rows: pd.DataFrame):
        values = np.frombuffer(b"".join(rows["fp"]), ">u8").astype(np.uint64).reshape(len(rows), -1)
        ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
        names = rows["label"].to_numpy() if "label" in rows else None
        if (side == 1).any():
            order = np.argsort(side, kind="stable")
            values, ids, n = values[order], ids[order], int((side == 0).sum())
            a, b = cell_links(values[:n], values[n:], radius, None if names is None else names[order], every)
        else:
            a, b = cell_links(values, None, radius, names, every)
        return ids[a], ids[b]

    def run(frames):
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            cell = frame[["key", "cell"]].to_numpy()
            if len(cell) and len(held) > 1 and (cell[0] == held[0][["key", "cell"]].to_numpy()[0]).all() \
                    and (cell[0] == cell[-1]).all():
                continue  # one cell goes on over whole batches
            rows = pd.concat(held, ignore_index=True)
            yield from flush(rows, last=False)
            held = [rows[rest_of(rows):]]
        if held:
            yield from flush(pd.concat(held, ignore_index=True), last=True)

    def rest_of(rows: pd.DataFrame) -> int:
        cell = rows[["key", "cell"]].to_numpy()
        return int(np.argmax((cell == cell[-1]).all(1))) if len(rows) else 0

    def flush(rows: pd.DataFrame, last: bool):
        end = len(rows) if last else rest_of(rows)
        if not end:
            return
        cell = rows[["key", "cell"]].to_numpy()[:end]
        cuts = np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [end]])
        sizes = ends - starts
        if not (sizes > 1).any():
            return
        ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
        crossed = np.add.reduceat(side[:end], starts) > 0
        values = np.frombuffer(b"".join(rows["fp"][:end]), ">u8").astype(np.uint64).reshape(end, -1)
        small = np.flatnonzero((sizes > 1) & (sizes <= _SMALL) & ~crossed)
        names = rows["label"].to_numpy() if "label" in rows else None
        a, b = small_links(values, starts[small], ends[small], radius, names, every)
        a_out, b_out = [ids[a]] if a else [], [ids[b]] if b else []
        for s in np.flatnonzero((sizes > 1) & ((sizes > _SMALL) | crossed)):
            a, b = links_of(rows.iloc[starts[s]:ends[s]])
            a_out.append(a)
            b_out.append(b)
        if a_out:
            yield pd.DataFrame({"a": np.concatenate(a_out), "b": np.concatenate(b_out)})

    return run


def fingerprint_links(distinct: DataFrame, radius: int, every: bool = False, turn: int = 0) -> DataFrame:
    """Links (a, b) that join all of ``distinct`` (id, fp, keys) within the radius and a common block.

    With a column ``label``, ids of one label count as joined; ``every`` gives each pair of two labels, not a forest.
    Forests of another ``turn`` prefer other members.
    """
    label = [c for c in distinct.columns if c == "label"]
    rows = distinct.select(F.explode(F.array_distinct("keys")).alias("key"), "id", "fp", *label)
    if label:
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        rows = rows.join(mixed.select("key"), "key", "left_semi")
    large = rows.groupBy("key").count().where(F.col("count") > CELL).select(
        "key", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")
    # cell (i, j) with i <= j compares part i with part j; a member of part p goes to every cell with p
    spread = (
        rows.join(large, "key", "left").withColumn("parts", parts).withColumn("own", own)
        .select("key", "id", "fp", *label, "parts", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
        .select("key", "id", "fp", *label, (F.least("own", "with") * F.col("parts") + F.greatest("own", "with")).alias("cell"),
                (F.col("own") > F.col("with")).cast("int").alias("side"))
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = spread.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", F.xxhash64("id", F.lit(turn)), "id")
    return laid.mapInPandas(_linked(radius, every), "a long, b long")


def set_marks(docs: DataFrame, width: int, words: int, bands: int) -> DataFrame:
    """doc_id, of (hash of the text), id (hash of the set), fp, keys of every whole text.

    All but the first two depend on the set of shingles alone, however often one repeats.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("id", pa.int64()), ("fp", pa.binary()),
                        ("keys", pa.list_(pa.int64()))])

    def run(doc_id, text, of):
        sets = [np.unique(shingle_hashes(t or "", width)) for t in text]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        return doc_id, of, ids, [fingerprint(s, words) for s in sets], [band_keys(s, bands) for s in sets]

    of = F.xxhash64(F.col("text").cast("string")).alias("of")
    return doc_texts(docs, of).mapInArrow(
        lambda b: arrow_rows(b, schema, run), "doc_id long, of long, id long, fp binary, keys array<long>")


def shingle_sets(docs: DataFrame, owners: DataFrame, width: int) -> DataFrame:
    """id, shingles (distinct) of the texts that ``owners`` (id, at, of) name; other texts are not cut again."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(ids, text):
        return ids, [np.unique(shingle_hashes(t or "", width)).view(np.int64) for t in text]

    rows = doc_texts(docs, F.xxhash64(F.col("text").cast("string")).alias("of")).select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"), "of", "text")
    named = rows.join(owners, ["at", "of"]).select("id", "text").dropDuplicates(["id"])
    return named.mapInArrow(lambda b: arrow_rows(b, schema, run), "id long, shingles array<long>")


def similar_pairs(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose sets (id, shingles) share at least ``similarity`` of what either holds."""
    a, b = (sets.select(F.col("id").alias(n), F.col("shingles").alias(f"of_{n}")) for n in "ab")
    shared, both = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    return links.join(b, "b").join(a, "a").where(
        shared * F.lit(1 + similarity) >= both * F.lit(similarity) - F.lit(1e-6)).select("a", "b")


def similar_components(docs: DataFrame, distinct: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """id, component of all ids that pairs of ``similarity`` reach; pairs within the radius and a block are tried.

    distinct: id, fp, keys and at, of of a text. First forests of candidates are verified, so a large class is found by a link a
    member, and new forests join what is left apart as long as half of their links hold. Then every candidate pair
    of two components is verified.
    """
    links = stored(fingerprint_links(distinct.select("id", "fp", "keys"), radius).distinct(), "candidates")
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()  # all that have a candidate at all
    open_ids = stored(distinct.join(ends, "id", "left_semi"), "candidate-ids")
    sets = stored(shingle_sets(docs, open_ids.select("id", "at", "of"), width), "candidate-sets")
    found, turn, every = None, 0, False
    while True:
        good = stored(similar_pairs(links, sets, similarity), "verified")
        found = good if found is None else found.union(good)
        linked = components(found)
        if every:
            return linked
        tried, held, turn = links.count(), good.count(), turn + 1
        every = 2 * held < tried
        named = open_ids.join(linked, "id", "left").select(
            "id", "fp", "keys", F.coalesce("component", "id").alias("label"))
        links = stored(fingerprint_links(named, radius, every, turn).distinct(), "candidates")
        if not every and links.isEmpty():
            return linked


def _classes(docs: DataFrame, width: int, radius: int, words: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, of, fp, id of each row; id, low, component of each fingerprint). ``of`` is a hash of the text."""
    if not bands and words != 1:
        raise ValueError("fingerprints of more than 64 bits need bands")
    marked = stored(fingerprints(docs, width, words, bands), "fingerprints")
    bits = F.conv(F.hex("fp"), 16, -10).cast("long")
    marked = marked.withColumn("id", bits if words == 1 else F.xxhash64("fp"))
    classes = marked.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("low"),
                                       F.first("keys").alias("keys"))
    distinct = classes.select("id", "fp", "keys") if bands else classes.select(
        "id", "fp", F.col("id").alias("bits")).withColumn("keys", piece_keys(radius)).drop("bits")
    linked = components(fingerprint_links(distinct, radius))
    lows = classes.select("id", "low").join(linked, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    return marked.select("doc_id", "of", "fp", "id"), lows


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, words: int = 1, bands: int = 0) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id: the smallest doc_id that links reach.

    Words are cut at the six ASCII blanks and A-Z lower-cased. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Copies share a fingerprint and so a class. A row with a null
    doc_id takes part; its id is never a class's id unless all ids of the class are null. Rows that repeat are
    returned as often. Other columns are left out. With ``bands`` 0 every link is found (``pieces``, 64 bits);
    else candidates share a band.
    """
    marked, lows = _classes(docs, width, radius, words, bands)
    least = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    answer = lows.join(least, "component").select("id", "component_id")
    return marked.join(answer, "id").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row of each group that ``near_duplicates`` finds, all columns: the group's smallest doc_id.

    Groups are those of ``near_duplicates`` with the same width and radius (64-bit fingerprints, every link
    within ``radius`` bits). Of rows of one id, the text of smallest hash stays; rows that repeat exactly stay
    once. Null ids come after all others, so a group of null ids alone keeps one of them. Null, empty and blank
    texts have fingerprint zero and group like any other. Columns of any name may be there; an empty table
    gives an empty table.
    """
    marked, lows = _classes(docs, width, radius, 1, 0)
    at = F.coalesce(F.col("doc_id"), F.lit(LAST))
    first = (marked.join(lows.select("id", "component"), "id")
             .groupBy("component").agg(F.min(F.struct(at.alias("at"), "of")).alias("first")))
    chosen = first.select(F.col("first.at").alias("kept_at"), F.col("first.of").alias("kept_of"))
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("at"),
        F.xxhash64(F.col("row.text").cast("string")).alias("of"))
    kept = rows.join(chosen, (F.col("at") == F.col("kept_at")) & (F.col("of") == F.col("kept_of")), "left_semi")
    return kept.dropDuplicates(["at", "of"]).select("row.*")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 80, words: int = 4, bands: int = 16,
             similarity: float = 0.8) -> DataFrame:
    """One row of each class of near-duplicates, all columns: the smallest doc_id, of equal ids one text.

    A class is what pairs of texts reach whose sets of shingles have a Jaccard similarity of ``similarity`` or more,
    counted exactly. Fingerprints only say which pairs are counted. With 256 bits, sets of a similarity of
    0.8 differ in 39 bits on average, with a standard deviation of 6; in 48 if they have but 4 and 5 shingles.
    Texts of equal sets are one class. Null ids come after all others. Columns of any name may be there.
    """
    marked = set_marks(docs, width, words, bands)
    at = F.coalesce(F.col("doc_id"), F.lit(LAST))
    first = stored(marked.groupBy("id").agg(
        F.min(F.struct(at.alias("at"), "of")).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")),
        "fingerprints")
    distinct = first.select("id", "fp", "keys", "first.at", "first.of")
    linked = similar_components(docs, distinct, width, radius, similarity)
    chosen = first.select("id", "first").join(linked, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(
        F.min("first").alias("first"))
    chosen = chosen.select(F.col("first.at").alias("kept_at"), F.col("first.of").alias("kept_of"))
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("at"),
        F.xxhash64(F.col("row.text").cast("string")).alias("of"))
    kept = rows.join(chosen, (F.col("at") == F.col("kept_at")) & (F.col("of") == F.col("kept_of")), "left_semi")
    return kept.dropDuplicates(["at", "of"]).select("row.*")
