"""Raw pages and books: text, headings, links, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semlake.functions import text as tx

MIN_MAIN = 200


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``title, main_text, method``: tags, scripts, styles, navigation and comments off, entities decoded; ``snippet``
    marks pages whose text is too short to stand for itself."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</(script|style|nav|head)>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    main = F.trim(F.regexp_replace(body, r"[ \t\r\n]+", " "))
    out = pages.withColumns({"title": F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), "main_text": main})
    return out.withColumn("method", F.when(F.length("main_text") >= MIN_MAIN, "full").otherwise("snippet"))


def links(pages: DataFrame) -> DataFrame:
    """``(page_id, s, o)``: a row for each ``<a href>``."""
    return pages.select("page_id", F.col("url").alias("s"), F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("o"))


#: Fixed value: a line that begins a chapter.
HEADING_LINE = r"(?im)^[ \t]*(#{1,3}[ \t]+[^\r\n]+?|Chapter[ \t]+\d+|Part[ \t]+[IVX\d]+)[ \t]*\r?$"


def page_chapters(pages: DataFrame, every: int = 30) -> DataFrame:
    """``pages(book, page, text)``, pages from 0 -> ``(book, chapter, slug, first_page, text, qa_score)``.

    A chapter begins on each page with a line like a heading, the first of which names it; pages before the first are
    left out.  Only in a book without any, one begins every ``every`` pages.  Pages are joined by blank lines.
    """
    title = F.trim(F.regexp_extract(F.coalesce("text", F.lit("")), HEADING_LINE, 1))
    has = F.bool_or(F.col("title") != "").over(Window.partitionBy("book"))
    marked = pages.select("book", "page", F.coalesce("text", F.lit("")).alias("text"), title.alias("title")).withColumn("headed", has)
    begins = F.when(F.col("headed"), F.col("title") != "").otherwise(F.col("page") % every == 0)
    named = F.when(F.col("headed"), F.col("title")).otherwise(F.concat(F.lit("Chapter "), (F.floor(F.col("page") / every) + 1).cast("string")))
    w = Window.partitionBy("book").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = marked.withColumns({"begins": begins, "named": named}).withColumn("chapter", F.sum(F.col("begins").cast("int")).over(w)).filter("chapter > 0")
    parts = cut.groupBy("book", "chapter").agg(F.min("page").alias("first_page"), F.min_by("named", "page").alias("named"), F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    out = parts.select("book", "chapter", tx.chapter_slug(F.col("chapter"), F.col("named")).alias("slug"), "first_page", text.alias("text"))
    return out.withColumn("qa_score", F.round(tx.qa_score(F.col("text")), 4))


def book_chapters(books: DataFrame, text: str = "content") -> DataFrame:
    """Whole-book Markdown -> chapters at first and second level headings, or one whole-text chapter; text before the
    first heading is dropped."""
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^#{1,2}[ \t]+\S)"), lambda p: p.rlike(r"\A#{1,2}[ \t]+\S"))
    none = F.size(parts) == 0
    keys = [c for c in books.columns if c != text]
    out = books.select(*keys, F.posexplode(F.when(none, F.array(F.col(text))).otherwise(parts)).alias("no", "body"), none.alias("_none"))
    title = F.trim(F.regexp_extract("body", r"\A#{1,2}[ \t]+([^\n]*)", 1))
    slug = F.when(F.col("_none"), "01-full-text").otherwise(tx.chapter_slug(F.col("no") + 1, title))
    return out.select(*keys, "no", slug.alias("slug"), "body", F.round(tx.qa_score(F.col("body")), 4).alias("qa_score"))
