"""Line dedup: exact repeats, and long lines within one word edit, by a deletion-neighbourhood join.

A line's content is its words, cut at blanks. A line is dropped if the same content, or
content within one word edit (a word changed, added or left out), stands in an earlier line of the
table: a smaller doc_id, or an earlier line of the same text. Edits count between lines of
at least ``min_words`` words each. Lines are judged on the input, not on what is left, and the earliest stays.

1. Lines are reduced to hashes and grouped: each distinct content with its earliest place.
2. An edit leaves the first or the last half of the shorter line as it is. Content whose
   half keys no other content shares has no neighbour and goes no further. What is left is cut in segments of
   some words, of which an edit touches one: a line goes on with the segments outside of which it
   equals another line.
3. There it emits its deletion neighbourhood: the hash of the line without its i-th word,
   once with the place i (a changed word gives equal variants at the same place) and once without
   (a line with one word more gives the whole of the other). Equal variants are joined with the
   earliest line of their key only: under these keys all members are neighbours of each other or of that line.
4. The chosen pair is verified word by word, and each content gets the earliest place of itself
   and its neighbours. Lines at later places are dropped.

Everything is built-in column functions. Hashes are combined by exclusive or, each word's with its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill.session import stored

SEGMENT = 8  # words
LAST = (1 << 63) - 1  # stands for a null id: after all others


def _words(line: Column) -> Column:
    """Words of a line that is not blank: freed of blanks at its ends, it is cut into words alone."""
    return F.split(F.btrim(line, F.lit(" \t\x0B\f\r")), r"[ \t\x0B\f\r]+")


def _place_hashes(words: Column, back: int = 0) -> Column:
    """Hash of each word with its place, or with the place ``back`` before."""
    return F.transform(words, lambda w, i: F.xxhash64(w, (i - back).cast("int")))


def _xor_all(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _running(hashes: Column) -> Column:
    """Exclusive or of the first n hashes, for n from 0 on."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(hashes, start, lambda a, x: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(x))))


def _half_keys(words: Column, n: Column, min_words: int) -> Column:
    """Hashes of the halves that a partner of any length from n - 1 to n + 1 may share, with their lengths."""
    def key(kind: str, size: Column):
        run = F.slice(words, F.lit(1), size) if kind == "first" else F.slice(words, n - size + 1, size)
        return F.xxhash64(F.lit(kind), size, run)

    def half(x: Column):
        return F.floor(x / 2).cast("int")

    keys = F.array(key("first", half(n)), key("last", n - half(n)),
                   key("first", half(n - 1)), key("last", n - 1 - half(n - 1)))
    return F.when(n >= min_words, F.array_distinct(keys)).otherwise(F.array().cast("array<long>"))


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """One row a line that is not blank: where it stands, two hashes of its content, its half keys."""
    lines = rows.select("at", "of", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    # Blank lines are told by their characters: a test of the words would cut every line twice.
    full = lines.where(F.col("content").rlike(r"[^ \t\x0B\f\r]"))
    words = full.select("at", "of", "line", _words(F.col("content")).alias("words"))
    norm = F.concat_ws(" ", "words")
    return words.select(
        "at", "of", "line", F.xxhash64(norm).alias("h"), F.xxhash64(F.lit(1), norm).alias("g"),
        _half_keys(F.col("words"), F.size("words"), min_words).alias("halves"))


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys (column ``key``) that more than one content (column ``h``) has."""
    return keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("key")


def _segments(least: Column) -> Column:
    """struct(j, begin, end) of about SEGMENT words each, of a line of ``least`` words."""
    parts = F.greatest(F.floor(least / SEGMENT), F.lit(1)).cast("int")
    edge = lambda j: F.floor(least * j / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1),
                       lambda j: F.struct(j.alias("j"), edge(j).alias("begin"), edge(j + 1).alias("end")))


def _located(hashed: DataFrame, min_words: int) -> DataFrame:
    """h, g, least, begin, end: where a line may differ from another one, by words from begin to end."""
    def keys(least: Column):
        return F.when(least >= min_words, F.transform(_segments(least), lambda s: F.struct(
            least.alias("least"), s["begin"].alias("begin"), s["end"].alias("end"),
            F.xxhash64(least, s["j"], F.element_at("before", s["begin"] + 1),
                       F.element_at("tail", least - s["end"] + 1)).alias("key"))))

    n = F.col("n")
    found = F.concat(keys(n), F.coalesce(keys(n - 1), F.filter(keys(n), lambda _: F.lit(False))))
    keyed = stored(hashed.select("h", "g", F.explode(found).alias("s")).select("h", "g", "s.*"), "segments")
    return keyed.join(_shared(keyed), "key", "left_semi").select("h", "g", "least", "begin", "end")


def _neighbours(rows: DataFrame, lines: DataFrame, contents: DataFrame, min_words: int) -> DataFrame:
    """mh, mg, near_at, near_line: the earliest verified neighbour of each content that has an earlier one."""
    keyed = lines.select("h", F.explode("halves").alias("key"))
    wanted = keyed.join(_shared(keyed), "key", "left_semi").select("h").distinct()
    spots = contents.join(wanted, "h", "left_semi").groupBy(
        F.col("first.at").alias("at"), F.col("first.of").alias("of")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), "h", "g")).alias("spots"))
    texts = rows.join(spots, ["at", "of"]).select("at", "of", "text", F.explode("spots").alias("spot"))
    content = F.element_at(F.split("text", "\n"), F.col("spot.line") + 1)
    lines = stored(texts.select("at", "spot.line", "spot.h", "spot.g", _words(content).alias("words"))
                   .dropDuplicates(["h", "g"]), "lines")

    from_end = F.transform(F.reverse("words"), lambda w, i: F.xxhash64(w, i.cast("int")))
    hashed = lines.select(
        "at", "line", "h", "g", F.size("words").alias("n"), _place_hashes(F.col("words")).alias("here"),
        _running(_place_hashes(F.col("words"))).alias("before"), _running(from_end).alias("tail"),
        _running(F.reverse(_place_hashes(F.col("words"), 1))).alias("after"))
    me = F.struct("at", "line", "h", "g")
    places = _located(hashed, min_words).groupBy("h", "g").agg(
        F.collect_set(F.struct("least", "begin", "end")).alias("places"))
    located = hashed.join(places, ["h", "g"])
    whole = located.where(F.exists("places", lambda p: p["least"] == F.col("n"))).select(
        F.xxhash64(F.lit("w"), "n", F.element_at("before", -1)).alias("key"),
        F.lit("whole").alias("kind"), me.alias("me"), F.lit(-1).alias("i"))

    def spread(least: Column):
        own = F.filter("places", lambda p: p["least"] == least)
        return F.explode(F.array_distinct(F.flatten(F.transform(
            own, lambda p: F.sequence(p["begin"], F.least(p["end"], F.col("n") - 1)))))).alias("i")

    all_words = F.element_at("before", -1)
    changed = located.select(me.alias("me"), "n", "here", all_words.alias("all"), spread(F.col("n"))).select(
        F.xxhash64(F.lit("c"), "n", "i", F.col("all").bitwiseXOR(F.get("here", F.col("i")))).alias("key"),
        F.lit("changed").alias("kind"), "me", "i")
    left_out = located.select(me.alias("me"), "n", "before", "after", spread(F.col("n") - 1)).select(
        F.xxhash64(F.lit("w"), F.col("n") - 1, F.get("before", F.col("i")).bitwiseXOR(
            F.get("after", F.col("n") - 1 - F.col("i")))).alias("key"),
        F.lit("left out").alias("kind"), "me", "i")
    emitted = stored(whole.unionByName(changed).unionByName(left_out), "variants")
    ranked = F.struct("me.at", "me.line", "me.h", "me.g", "i")

    def earliest(kind: str, name: str):
        return F.min(F.when(F.col("kind") == kind, ranked)).alias(name)

    best = emitted.groupBy("key").agg(earliest("changed", "c"), earliest("whole", "w"), earliest("left out", "l"))
    best = best.where("c is not null or (w is not null and l is not null)")
    pairs = (
        emitted.join(best, "key")
        .select("me", "kind", "i", F.when(F.col("kind") == "changed", F.col("c"))
                .when(F.col("kind") == "whole", F.col("l")).otherwise(F.col("w")).alias("other"))
        .where(F.struct("other.at", "other.line") < F.struct("me.at", "me.line"))
        .groupBy("me").agg(F.min(F.struct("other.at", "other.line", "other.h", "other.g", "kind", "i",
                                          F.col("other.i").alias("j"))).alias("other"))
    )
    mine = lines.select(F.col("h").alias("mh"), F.col("g").alias("mg"), F.col("words").alias("x"))
    theirs = lines.select(F.col("h").alias("oh"), F.col("g").alias("og"), F.col("words").alias("y"))
    both = (
        pairs.join(mine, (F.col("me.h") == F.col("mh")) & (F.col("me.g") == F.col("mg")))
        .join(theirs, (F.col("other.h") == F.col("oh")) & (F.col("other.g") == F.col("og")))
    )

    def without(words: str, i: Column) -> Column:
        w = F.col(words)
        return F.concat(F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.size(w)))

    i, j = F.col("other.i"), F.col("other.j")
    verified = (
        F.when(F.col("other.kind") == "changed", without("x", i) == without("y", i))
        .when(F.col("other.kind") == "whole", F.col("x") == without("y", j))
        .otherwise(without("x", i) == F.col("y"))
    )
    return both.where(verified).select("mh", "mg", F.col("other.at").alias("near_at"),
                                       F.col("other.line").alias("near_line"))


def dedup_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """All columns of ``docs``, with ``text`` freed of repeated lines; see ``with_counts``."""
    return with_counts(docs, min_words).select("row.*")


def with_counts(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """row (all columns, text replaced), n_lines, n_removed for every row.

    Blank lines are neither dropped nor counted as repeats. A null text stays null, an empty one empty; both
    have 0 lines removed. A null doc_id stands after all others. Rows of one doc_id stand at the same place: none
    is earlier than the other, so repeated rows are treated alike and lose no line to each other. Columns of any
    name may be there; they are kept aside. A text all of whose lines go becomes empty.
    """
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"),
        F.xxhash64("text").alias("of"))
    narrow = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"), F.xxhash64("text").alias("of"),
        F.col("text").cast("string").alias("text"))
    lines = stored(_lines(narrow, min_words), "lines")
    contents = stored(lines.groupBy("h", "g").agg(
        F.min(F.struct("at", "line", "of")).alias("first"), F.count(F.lit(1)).alias("n")), "contents")
    near = _neighbours(narrow, lines, contents, min_words)
    joined = contents.join(near, (F.col("h") == F.col("mh")) & (F.col("g") == F.col("mg")), "left")
    limit = F.least(F.struct("first.at", "first.line"),
                    F.when(F.col("mh").isNotNull(),
                           F.struct(F.col("near_at").alias("at"), F.col("near_line").alias("line"))))
    limits = joined.where("n > 1 or mh is not null").select(
        F.col("h").alias("lh"), F.col("g").alias("lg"), limit.alias("limit"))
    dropped = (
        lines.select("at", "of", "line", "h", "g")
        .join(limits, (F.col("h") == F.col("lh")) & (F.col("g") == F.col("lg")))
        .where(F.struct("at", "line") > F.col("limit"))
        .groupBy(F.col("at").alias("dat"), F.col("of").alias("dof")).agg(F.collect_set("line").alias("gone"))
    )
    told = rows.join(dropped, (F.col("at") == F.col("dat")) & (F.col("of") == F.col("dof")), "left")
    own = F.col("row.text").cast("string")
    split = F.split(own, "\n")
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull() | own.isNull(), own).otherwise(kept)
    names = [F.col("row")[c].alias(c) if c != "text" else text.alias("text") for c in docs.columns]
    return told.select(
        F.struct(*names).alias("row"), F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(own.isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"))
