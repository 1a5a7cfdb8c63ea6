"""Answers as Markdown: links, footnotes, warnings, readable labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.functions import text as tx

#: Order of source types in a footnote block.
TYPE_ORDER = ("note", "book_chapter", "web_saved", "web", "wikidata")


def mark_warnings(content: Column, refs: Column) -> Column:
    """`` ⚠`` after each ``[^N]`` whose number is in ``refs``, not twice."""
    return F.aggregate(refs, content, lambda acc, r: F.regexp_replace(acc, F.concat(F.lit(r"\[\^"), r.cast("string"), F.lit(r"\](?! ⚠)")), F.concat(F.lit("[^"), r.cast("string"), F.lit("] ⚠"))))


def links(source_type: Column, source_id: Column, vault: Column, base: str) -> Column:
    """``struct<primary, preview>`` of a citation."""
    rel = F.when(source_id.contains(":"), F.regexp_replace(source_id, r"^[^:]*:", "")).otherwise(source_id)
    deep = F.concat(F.lit("obsidian://open?vault="), tx.percent(vault, ""), F.lit("&file="), tx.percent(rel, ""))
    note = F.concat(F.lit(f"{base}/preview/note/"), vault, F.lit("/"), tx.percent(rel, "/"))
    sha = F.substring_index(source_id, "/", 1)
    chapter = F.when(source_id.contains("/"), F.regexp_replace(source_id, r"^[^/]*/", "")).otherwise("0")
    book = F.concat(F.lit(f"{base}/preview/book/"), sha, F.lit("/"), chapter)
    saved = F.concat(F.lit(f"{base}/preview/web/"), source_id)
    wiki = F.concat(F.lit("https://www.wikidata.org/wiki/"), source_id)
    primary = F.when(source_type == "note", deep).when(source_type == "book_chapter", book).when(source_type == "web_saved", saved).when(source_type == "wikidata", wiki).otherwise(source_id)
    preview = F.when(source_type == "note", note).otherwise(primary)
    return F.struct(primary.alias("primary"), preview.alias("preview"))


def footnotes(citations: DataFrame) -> DataFrame:
    """``(answer_id, n, source_type, title, primary, preview, meta, quote)`` -> ``(answer_id, block)`` in type order."""
    head = F.when(F.col("primary") != "", F.concat(F.lit("**["), "title", F.lit("]("), "primary", F.lit(")**"))).otherwise(F.concat(F.lit("**"), "title", F.lit("**")))
    more = F.when((F.col("preview") != "") & (F.col("preview") != F.col("primary")), F.concat(F.lit(" · [preview]("), "preview", F.lit(")")))
    line = F.concat(F.lit("[^"), F.col("n").cast("string"), F.lit("]: "), head, F.coalesce(more, F.lit("")))
    body = F.concat_ws("\n", line, F.when(F.col("meta") != "", F.concat(F.lit("    *"), "meta", F.lit("*"))), F.when(F.col("quote") != "", F.concat(F.lit("    > "), "quote")))
    place = F.lit(len(TYPE_ORDER))
    for i, t in enumerate(TYPE_ORDER):
        place = F.when(F.col("source_type") == t, i).otherwise(place)
    blocks = citations.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), "n", body.alias("b")))).alias("x"))
    return blocks.select("answer_id", F.array_join(F.transform("x", lambda r: r["b"]), "\n").alias("block"))


def node_label(uri: Column) -> Column:
    """Readable label of a node: file and section of a heading, else the last part."""
    u = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    name, section = F.regexp_extract(u, r".*:([^:]*)\.md(?::|$)", 1), F.regexp_extract(u, r".*:[^:]*\.md:([^:]*)", 1)
    heading = F.when(u.rlike(r":[^:]*\.md(:|$)"), F.concat(name, F.when(section != "", F.concat(F.lit(" §"), section)).otherwise(""))).otherwise(F.coalesce(F.nullif(F.regexp_extract(u, r"^[^:]*:[^:]*:[^:]*:(.*)$", 1), F.lit("")), u))
    path = F.substring_index(F.regexp_replace(u, r"/+$", ""), "/", -1)
    return F.when(u.startswith("urn:heading:"), heading).when(u.contains("/"), path).otherwise(F.substring_index(u, ":", -1))


def note_label(source_id: Column) -> Column:
    """Title of a note from its id: the file name without vault, folders and extension."""
    rel = F.when(source_id.contains(":"), F.regexp_replace(source_id, r"^[^:]*:", "")).otherwise(source_id)
    return F.regexp_replace(F.substring_index(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))), "/", -1), r"(?<=.)\.[^.]*$", "")
