"""URL functions as Columns: split, resolve, normalise, name, label."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from pagemill.functions.text import let

# The URL split of RFC 3986, appendix B, as separate captures.
SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
AUTHORITY = r"(?://([^/?#]*))?"
PATH = r"([^?#]*)"
QUERY = r"(?:\?([^#]*))?"
FRAGMENT = r"(?:#(.*))?\z"
URL = "(?s)" + SCHEME + AUTHORITY + PATH + QUERY + FRAGMENT

# Fixed value: what counts as a word character, in any script.
WORD = r"\p{L}\p{N}_"

# Fixed value: characters cut off the front of a URL (controls and blank).
LEADING = "".join(map(chr, range(0x21)))


def clean_url(url: Column) -> Column:
    """Tabs and line ends vanish anywhere, controls and blanks in front."""
    return F.ltrim(F.regexp_replace(url, r"[\t\r\n]", ""), F.lit(LEADING))


def _part(cleaned: Column, group: int) -> Column:
    return F.regexp_extract(cleaned, URL, group)


def scheme(cleaned: Column) -> Column:
    return F.lower(_part(cleaned, 1))


def netloc(cleaned: Column) -> Column:
    return _part(cleaned, 2)


def raw_path(cleaned: Column) -> Column:
    """Path still carrying ``;params``."""
    return _part(cleaned, 3)


def path(cleaned: Column) -> Column:
    """Path; ``;params`` is cut off its last segment."""
    return F.regexp_replace(raw_path(cleaned), r"(?s)^((?:.*/)?[^/;]*);[^/]*$", "$1")


def query(cleaned: Column) -> Column:
    return _part(cleaned, 4)


def url_parts(url: Column) -> Column:
    """struct(scheme, netloc, path, params, query, fragment)."""
    cleaned = clean_url(url)
    params = F.regexp_extract(raw_path(cleaned), r"(?s)^(?:.*/)?[^/;]*;([^/]*)$", 1)
    return F.struct(
        scheme(cleaned).alias("scheme"),
        netloc(cleaned).alias("netloc"),
        path(cleaned).alias("path"),
        params.alias("params"),
        query(cleaned).alias("query"),
        _part(cleaned, 5).alias("fragment"),
    )


@lru_cache(maxsize=1)
def _ip_literal() -> str:
    """A host of an IP address in brackets: the nine forms of RFC 3986, with a zone, or a future version."""
    part, byte = "[0-9A-Fa-f]{1,4}", r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    last = rf"(?:{part}:{part}|{byte}(?:\.{byte}){{3}})"
    forms = [f"(?:{part}:){{6}}{last}"]
    for before in range(8):  # at most so many groups before the gap
        behind = {6: part, 7: ""}.get(before, f"(?:{part}:){{{5 - before}}}{last}")
        front = f"(?:(?:{part}:){{0,{before - 1}}}{part})?" if before else ""
        forms.append(f"{front}::{behind}")
    address = "|".join(forms)
    return rf"^(?:[^\[\]]*@)?\[(?:(?:{address})(?:%[^%\]]+)?|[vV][0-9A-Fa-f]+\..+)\](?::[^\[\]]*)?$"


@lru_cache(maxsize=1)
def _disguised_marks() -> str:
    """A class of the characters that compatibility normalisation turns into a mark that ends or splits a host."""
    found = [c for c in map(chr, range(0x80, 0x20000)) if set("/?#@:") & set(unicodedata.normalize("NFKC", c))]
    return "[" + "".join(found) + "]"


def is_malformed(url: Column) -> Column:
    """Square brackets in the host that do not enclose an IP literal, or a disguised mark in it."""
    host = netloc(clean_url(url))
    brackets = host.rlike(r"[\[\]]") & ~host.rlike(_ip_literal())
    return brackets | host.rlike(_disguised_marks())


# URLs and references of these plain shapes need no taking apart.
PLAIN_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+(?:/[^?#;\t\r\n]*)?\z"
PLAIN_WEB = r"^https?://[^/?#\[\]\s]+(?:/[^?#;\t\r\n]*)?\z"
PLAIN_PATH = r"^/(?!/)(?!(?:[^/]*/)*\.{1,2}(?:/|\z))[^?#;\t\r\n]*\z"


def _without_last_slash(whole: Column) -> Column:
    return F.substring(whole, F.lit(1), F.length(whole) - 1)


def normalize_url(url: Column) -> Column:
    """Key of a page. Apply exactly once: a second pass can give another key."""
    plain = F.when(
        F.endswith(url, F.lit("/")) & ~url.rlike(r"^[^/]*//[^/]*/\z"), _without_last_slash(url)
    ).otherwise(url)

    def general(parts):
        whole = F.concat(parts["scheme"], F.lit("://"), parts["netloc"], parts["path"])
        trimmed = F.when(
            F.endswith(whole, F.lit("/")) & (parts["path"] != "/"), _without_last_slash(whole)
        ).otherwise(whole)
        arguments = F.array_join(F.array_sort(F.split(parts["query"], "&")), "&")
        return F.when(parts["query"] == "", trimmed).otherwise(
            F.concat(trimmed, F.lit("?"), arguments)
        )

    return F.lower(
        F.when(url.rlike(PLAIN_URL), plain).otherwise(let(url_parts(url), general))
    )


def _dot_segments(parts: Column) -> Column:
    """Resolve ``.`` and ``..`` in an array of segments; join to a path."""
    kept = F.aggregate(
        parts,
        F.slice(parts, 1, 0),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    ended = F.when(
        F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))
    ).otherwise(kept)
    joined = F.array_join(ended, "/")
    # Too many ".." eat the leading slash as well; it is put back.
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(
        F.concat(F.lit("/"), joined)
    )


def _merged_path(base_path: Column, ref_path: Column) -> Column:
    directory = F.when(base_path == "", F.lit("/")).otherwise(
        F.regexp_replace(base_path, r"(?s)[^/]*\z", "")
    )
    dotted = r"(?s)(^|/)\.\.?(/|$)"

    def relative():
        stems = F.split(directory, "/")
        stems = F.slice(stems, F.lit(1), F.size(stems) - 1)
        parts = F.concat(stems, F.split(ref_path, "/"))
        return let(
            parts,
            lambda p: F.filter(
                p, lambda s, i: (s != "") | (i == 0) | (i == F.size(p) - 1)
            ),
        )

    rooted = F.startswith(ref_path, F.lit("/"))
    return (
        F.when(rooted & ~ref_path.rlike(dotted), ref_path)
        .when(rooted, let(F.split(ref_path, "/"), _dot_segments))
        .otherwise(let(relative(), _dot_segments))
    )


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on page ``base`` (an http(s) URL); NULL if malformed.

    A reference with a scheme of its own is returned as written.
    """
    site = r"^https?://[^/?#\s]+"

    def general(home, ref):
        ref_path = F.concat(ref["path"], _prefixed(";", ref["params"]))
        tail = F.concat(_prefixed("?", ref["query"]), _prefixed("#", ref["fragment"]))
        origin = F.concat(home["scheme"], F.lit("://"), home["netloc"])
        rooted = F.when(
            (ref_path == "") | F.startswith(ref_path, F.lit("/")), ref_path
        ).otherwise(F.concat(F.lit("/"), ref_path))
        home_path = F.concat(home["path"], _prefixed(";", home["params"]))
        home_query = F.when(ref["query"] == "", _prefixed("?", home["query"])).otherwise(F.lit(""))
        return (
            F.when((ref["scheme"] != "") & (ref["scheme"] != home["scheme"]), href)
            .when(ref["netloc"] != "", F.concat(home["scheme"], F.lit("://"), ref["netloc"], rooted, tail))
            .when(ref_path == "", F.concat(origin, home_path, home_query, tail))
            .otherwise(F.concat(
                origin, _merged_path(home["path"], ref["path"]), _prefixed(";", ref["params"]), tail
            ))
        )

    return (
        F.when(href.rlike(PLAIN_PATH) & base.rlike(site), F.concat(F.regexp_extract(base, site, 0), href))
        .when(href.rlike(PLAIN_WEB), href)
        .when(is_malformed(href), F.lit(None).cast("string"))
        .when(href == "", base)
        .otherwise(let(
            F.struct(url_parts(base).alias("home"), url_parts(href).alias("ref")),
            lambda both: general(both["home"], both["ref"]),
        ))
    )


def _prefixed(mark: str, part: Column) -> Column:
    return F.when(part == "", F.lit("")).otherwise(F.concat(F.lit(mark), part))


def root_url(root: Column) -> Column:
    """The root with scheme and without trailing slashes, not yet a key."""
    with_scheme = F.when(root.rlike("^https?://"), root).otherwise(
        F.concat(F.lit("https://"), root)
    )
    return F.rtrim(with_scheme, F.lit("/"))


def seed_url(root: Column) -> Column:
    """A root as given by a user, made a page key."""
    return normalize_url(root_url(root))


def page_filename(url: Column) -> Column:
    stem = F.btrim(path(clean_url(url)), F.lit("/"))
    stem = F.when(stem == "", F.lit("index")).otherwise(stem)
    safe = F.regexp_replace(F.replace(stem, F.lit("/"), F.lit("_")), rf"[^{WORD}\-.]", "_")
    return F.concat(
        F.left(safe, F.lit(200)), F.lit("_"), F.left(F.md5(url), F.lit(8)), F.lit(".md")
    )


def merged_filename(root: Column) -> Column:
    cleaned = clean_url(root)
    host = F.when(netloc(cleaned) != "", netloc(cleaned)).otherwise(
        F.split(path(cleaned), "/")[0]
    )
    return F.concat(
        F.regexp_replace(F.split(host, ":")[0], rf"[^{WORD}\-.]", "-"), F.lit(".md")
    )


def anchor(url: Column) -> Column:
    return F.regexp_replace(url, rf"[^{WORD}\-]", "-")


def url_label(url: Column, width: int = 40) -> Column:
    only_path = path(clean_url(url))
    shown = F.when(only_path == "", F.lit("/")).otherwise(only_path)
    return F.when(
        F.length(shown) > width, F.concat(F.lit("..."), F.right(shown, F.lit(width - 3)))
    ).otherwise(shown)
