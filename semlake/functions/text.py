"""Scalar text functions: Markdown, URIs, labels, quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADING = r"(?m)^(#{1,6})[ \t]+(.+)$"
WORD = r"[\p{L}\p{N}_]+"


def sha(*parts: Column, n: int = 64) -> Column:
    """First ``n`` hex digits of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, n)


def slug(text: Column) -> Column:
    """Lower case, leading hashes off, everything but letters, digits, ``_`` and ``-`` to single hyphens, or ``empty``."""
    s = F.regexp_replace(F.trim(F.lower(text)), r"^#+", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_-]", "-"), r"-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^-+|-+$", ""), F.lit("")), F.lit("empty"))


def percent(text: Column, safe: str = "/:.-_") -> Column:
    """Percent-encoding that leaves the ``safe`` characters, by the codec's own escapes put back."""
    out = F.regexp_replace(F.url_encode(text), r"\+", "%20")
    for c in safe:
        if c not in "-_.":  # the encoder leaves these
            out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def note_uri(vault: Column, path: Column) -> Column:
    return F.concat(F.lit("urn:note:"), vault, F.lit(":"), percent(path))


def tag_uri(tag: Column) -> Column:
    return F.concat(F.lit("urn:tag:"), slug(tag))


def person_uri(name: Column) -> Column:
    return F.concat(F.lit("urn:person:"), slug(name))


def heading_uri(vault: Column, path: Column, idx: Column) -> Column:
    key = F.regexp_replace(F.regexp_replace(percent(path), r"[/\\]", ":"), r":+$", "")
    return F.concat(F.lit("urn:heading:"), vault, F.lit(":"), key, F.lit(":"), idx.cast("string"))


def para_segment(path: Column) -> Column:
    """Second part of a path of three or more whose first is a PARA folder, else empty."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when((F.size(parts) >= 3) & F.lower(parts[0]).isin("projects", "areas", "resources", "archives"), parts[1]).otherwise("")


def label_of(uri: Column) -> Column:
    """Last fragment, path part or URN part of a URI, in lower case with ``-`` and ``_`` as spaces."""
    part = F.rtrim(uri, F.lit("/"))
    last = F.when(part.contains("#"), F.substring_index(part, "#", -1)).when(part.contains("/"), F.substring_index(part, "/", -1)).otherwise(F.substring_index(part, ":", -1))
    return F.translate(F.lower(last), "-_", "  ")


def camel_label(uri: Column) -> Column:
    """As :func:`label_of` with camel case split into words."""
    part = F.regexp_replace(uri, r"/+$", "")
    last = F.when(part.contains("#"), F.substring_index(part, "#", -1)).when(part.contains("/"), F.substring_index(part, "/", -1)).otherwise(F.substring_index(part, ":", -1))
    return F.translate(F.lower(F.regexp_replace(last, r"([a-z])([A-Z])", "$1 $2")), "-_", "  ")


def qa_score(text: Column) -> Column:
    """Share of letters among the characters; 0 for empty texts."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / n).otherwise(0.0)


def chapter_slug(index: Column, title: Column) -> Column:
    safe = F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s-]", "")
    safe = F.substring(F.regexp_replace(F.regexp_replace(safe, r"[\s_]+", "-"), r"^-+|-+$", ""), 1, 60)
    return F.concat(F.lpad(index.cast("string"), F.greatest(F.lit(2), F.length(index.cast("string"))), F.lit("0")), F.lit("-"), F.coalesce(F.nullif(safe, F.lit("")), F.lit("chapter")))


def hashtags(content: Column) -> Column:
    """Inline tags outside the front matter, in lower case, in order."""
    body = F.regexp_replace(content, r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?<![\p{L}\p{N}_])#([\p{L}\p{N}_]{2,}(?:[/-][\p{L}\p{N}_]+)*)"), F.lit(1)), F.lower)


def wikilinks(content: Column) -> Column:
    """Targets of ``[[target|alias]]`` and ``[[target#heading]]``, trimmed, without empty ones."""
    found = F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda x: x != "")


def authors(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def token_text(text: Column) -> Column:
    """The tokens of :func:`tokens` with a space between them, made without an array: no token holds a space."""
    return F.lower(F.trim(F.regexp_replace(text, WORD.replace("[", "[^", 1), " ")))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def _unquoted(value: Column) -> Column:
    """A YAML scalar as text: quotes off, comments off, null empty."""
    v = F.trim(value)
    plain = F.trim(F.regexp_replace(v, r"(^|\s+)#.*$", ""))
    bare = F.when(plain.rlike(r"^(~|null|Null|NULL)?$"), "").otherwise(plain)
    double = F.replace(F.replace(F.regexp_extract(v, r'^"((?:[^"\\]|\\.)*)"', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = F.replace(F.regexp_extract(v, r"^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'"))
    return F.when(v.startswith('"'), double).when(v.startswith("'"), single).otherwise(bare)


def front_matter(content: Column) -> Column:
    """The front matter's top-level entries: an array of ``(key, item, kind)`` with kind ``scalar``, or ``list`` for a row
    of each item of a list, in brackets or in a block of ``- item`` lines.

    A fold over the lines carries the present key, so that ``- item`` lines go to the key above them.
    """
    block = F.regexp_extract(content, r"(?s)\A---[ \t]*\r?\n(.*?\n)??---[ \t]*(\r?\n|\z)", 1)
    entry = "array<struct<key:string,item:string,kind:string>>"
    one = lambda key, item, kind: F.array(F.struct(key.alias("key"), item.alias("item"), F.lit(kind).alias("kind")))

    def read(acc: Column, line: Column) -> Column:
        key, value = F.regexp_extract(line, r"^([\p{L}\p{N}_][\p{L}\p{N}_ -]*?)[ \t]*:(?:[ \t]|\r?$)", 1), F.regexp_extract(line, r"^[^:]*:[ \t]*(.*?)\r?$", 1)
        item = F.regexp_extract(line, r"^[ \t]*-[ \t]+(.*?)\r?$", 1)
        inner = F.regexp_extract(value, r"^\[(.*)\]", 1)
        cut = F.regexp_extract_all(inner, F.lit(r"""[ \t]*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)"""), F.lit(1))
        listed = F.transform(cut, lambda x: F.struct(key.alias("key"), _unquoted(x).alias("item"), F.lit("list").alias("kind")))
        more = (
            F.when((key != "") & value.startswith("["), listed)
            .when((key != "") & (_unquoted(value) != ""), one(key, _unquoted(value), "scalar"))
            .when((key == "") & (item != "") & (acc["key"] != ""), one(acc["key"], _unquoted(item), "list"))
            .otherwise(F.array().cast(entry))
        )
        now = F.when(key != "", F.when(_unquoted(value) == "", key).otherwise("")).otherwise(acc["key"])
        return F.struct(now.alias("key"), F.concat(acc["out"], more.cast(entry)).alias("out"))

    lines = F.when(F.coalesce(block, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(block, "\n"))
    return F.aggregate(lines, F.struct(F.lit("").alias("key"), F.array().cast(entry).alias("out")), read, lambda acc: acc["out"])


def flat_front_matter(content: Column, key: str) -> Column:
    """A scalar of the front matter as text, empty without one (as for ``project``, ``area`` and ``created``)."""
    found = F.filter(front_matter(content), lambda e: (e["key"] == key) & (e["kind"] == "scalar"))
    return F.coalesce(F.get(F.transform(found, lambda e: F.trim(e["item"])), F.lit(0)), F.lit(""))


def front_matter_list(content: Column, key: str) -> Column:
    """A list of the front matter: in brackets, as a block of items, or as a comma string."""
    found = F.filter(front_matter(content), lambda e: e["key"] == key)
    each = F.flatten(F.transform(found, lambda e: F.when(e["kind"] == "list", F.array(e["item"])).otherwise(F.split(e["item"], ","))))
    return F.filter(F.transform(each, lambda x: F.trim(x)), lambda x: x != "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def truncate_unit(vec: Column, dims: int) -> Column:
    """First ``dims`` components at unit length."""
    part = F.transform(F.slice(vec, 1, dims), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(part, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


#: Words that a quote isn't looked up by.
QUOTE_STOP_WORDS = "и в не на что с он как это из о по все то её мне ли же а для да от за the a an is in of to for and or it".split()


def quote(content: Column, query: Column, width: int = 140) -> Column:
    """A window of about ``width`` characters around the first query word that occurs, cut at spaces, with ellipses."""
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-zа-яё0-9]+"), F.lit(0)), lambda w: ~w.isin(QUOTE_STOP_WORDS) & (F.length(w) > 2))
    low = F.lower(content)
    at = F.get(F.filter(F.transform(words, lambda w: F.call_function("locate", w, low)), lambda p: p > 0), F.lit(0))  # from 1
    head = F.substring(content, 1, width)
    plain = F.trim(F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head))
    half, n = width // 2, F.length(content)
    lo = F.greatest(F.lit(0), at - 1 - half)  # from 0, as hi
    hi = F.least(n, at - 1 + half)
    before = F.substr(content, F.lit(1), lo)
    start = F.when((lo > 0) & before.contains(" "), F.length(F.regexp_extract(before, r"(?s)^(.* )[^ ]*$", 1))).otherwise(lo)
    space = F.call_function("locate", F.lit(" "), content, hi + 1)
    end = F.when((hi < n) & (space > 0), space - 1).otherwise(hi)
    cut = F.trim(F.substr(content, start + 1, end - start))
    window = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < n, "…").otherwise(""))
    return F.when(n <= width, F.trim(content)).when(at.isNull(), plain).otherwise(window)
