"""Notes to chunks: sections, promotion, parents, overlapping children; hash-guarded upsert of the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semlake.functions import text as tx

CHILD_CHARS, CHILD_STEP, CHILD_OFFSET = 2048, 1792, 10_000


def sections(docs: DataFrame, text: str = "content") -> DataFrame:
    """All columns with ``sec_no, level, heading, section``: a row for each Markdown section; text before the first
    heading is level 0; a text without headings is one section."""
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^#{1,6}[ \t]+\S)"), lambda p: F.trim(p, F.lit(" \n\t\r")) != "")
    out = docs.select("*", F.posexplode(parts).alias("sec_no", "_part"))
    level = F.length(F.regexp_extract("_part", r"\A(#{1,6})[ \t]+\S", 1))
    heading = F.trim(F.regexp_extract("_part", r"\A#{1,6}[ \t]+([^\n]*)", 1))
    return out.select(*docs.columns, "sec_no", level.alias("level"), heading.alias("heading"), F.trim(F.col("_part"), F.lit(" \n\t\r")).alias("section"))


def promotes(source_type: Column, n_sections: Column) -> Column:
    """Whether the whole document becomes a parent: notes of 3 sections, book chapters of 2."""
    return n_sections >= F.when(source_type == "book_chapter", 2).otherwise(3)


def windows(text: Column, size: int = CHILD_CHARS, step: int = CHILD_STEP) -> Column:
    """Overlapping character windows of a text; a text of up to ``size`` is one window."""
    n = F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))


#: A token of the default tokenizer: white space before it, then a word or one other character; tokens make up the text.
PIECE = r"[ \t\r\n]*(?:[\p{L}\p{N}_]+|[^ \t\r\n\p{L}\p{N}_])|[ \t\r\n]+"
TOKENS, TOKEN_OVERLAP = 512, 64


def pieces(text: Column) -> Column:
    """The default tokenizer port: an array of tokens whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def token_windows(docs: DataFrame, size: int = TOKENS, overlap: int = TOKEN_OVERLAP, text: str = "content", tokenizer: Callable[[Column], Column] = pieces) -> DataFrame:
    """All other columns with ``no, first_token, n_tokens, start_at, window``: windows of ``size`` tokens, each beginning
    ``overlap`` tokens before the last one ends; ``start_at`` is the character where it begins.

    ``tokenizer`` gives an array of strings that make up the text.  Windows are cut from the text by running lengths, so
    a token array is computed once for each text.
    """
    kept = [c for c in docs.columns if c != text]
    # an empty text has one empty window
    cut = docs.select(*kept, F.col(text).alias("_text"), F.explode(F.array(F.transform(tokenizer(F.col(text)), F.length))).alias("_len"))
    n = F.size("_len")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
    step = size - overlap
    # characters of each step's tokens, summed once along the starts
    gaps = F.transform(starts, lambda s: F.when(s == 0, F.lit(0)).otherwise(total(F.slice("_len", s - step + 1, F.lit(step)))))
    begins = F.aggregate(gaps, F.array().cast("array<int>"), lambda acc, g: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + g)))
    out = cut.select(*kept, "_text", "_len", F.posexplode(F.arrays_zip(starts.alias("s"), begins.alias("b"))).alias("no", "w"))
    chars = total(F.slice("_len", F.col("w.s") + 1, F.lit(size)))
    return out.select(*kept, "no", F.col("w.s").alias("first_token"), F.least(F.lit(size), n - F.col("w.s")).alias("n_tokens"), F.col("w.b").alias("start_at"), F.substr("_text", F.col("w.b") + 1, chars).alias("window"))


def children(docs: DataFrame, key: str = "source_id", text: str = "content") -> DataFrame:
    """``docs(key, text, ...)`` -> one row for each window: ``key, chunk_index, chunk_id, content, content_hash``."""
    out = docs.select(key, F.posexplode(windows(F.col(text))).alias("chunk_index", "content")).filter(F.trim("content") != "")
    return out.select(key, "chunk_index", tx.sha(F.col(key), (F.col("chunk_index") + CHILD_OFFSET).cast("string"), n=16).alias("chunk_id"), "content", tx.sha(F.col("content"), n=16).alias("content_hash"))


def parents(docs: DataFrame) -> DataFrame:
    """``docs(source_id, source_type, content)`` -> whole-document parents where promoted, and section parents under them."""
    cut = sections(docs.select("source_id", "source_type", "content"))
    n = cut.groupBy("source_id").agg(F.count("*").alias("n_sections"))
    promoted = docs.select("source_id", "source_type", "content").join(n, "source_id").withColumn("promoted", promotes(F.col("source_type"), F.col("n_sections")))
    whole = promoted.filter("promoted").select("source_id", F.lit(0).alias("parent_index"), F.lit("").alias("parent_id"), "content")
    secs = cut.drop("content").join(promoted.select("source_id", "promoted"), "source_id")
    shift = F.col("promoted").cast("int")
    secs = secs.select("source_id", (F.col("sec_no") + shift).alias("parent_index"), F.when(F.col("promoted"), tx.sha(F.col("source_id"), F.lit("0"), n=16)).otherwise("").alias("parent_id"), F.col("section").alias("content"))
    out = whole.unionByName(secs)
    return out.select("source_id", "parent_index", tx.sha(F.col("source_id"), F.col("parent_index").cast("string"), n=16).alias("chunk_id"), "parent_id", tx.sha(F.col("content"), n=16).alias("content_hash"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "chunk_id", guard: str = "content_hash") -> DataFrame:
    """Stored rows with the incoming ones put in where their hash differs: copy-on-write merge, ``written`` flags them."""
    old = stored.select(F.col(key).alias("_k"), F.col(guard).alias("_h"))
    new = incoming.join(old, F.col(key) == F.col("_k"), "left").filter(F.col("_h").isNull() | (F.col("_h") != F.col(guard))).drop("_k", "_h")
    kept = stored.join(new.select(key), key, "left_anti")
    return kept.withColumn("written", F.lit(False)).unionByName(new.withColumn("written", F.lit(True)), allowMissingColumns=True)


def soft_delete(stored: DataFrame, removed_sources: DataFrame) -> DataFrame:
    """``removed`` set on every row of the given sources."""
    gone = removed_sources.select(F.col("source_id").alias("_s")).distinct()
    out = stored.join(gone, F.col("source_id") == F.col("_s"), "left")
    return out.withColumn("removed", F.col("removed") | F.col("_s").isNotNull()).drop("_s")
