"""Readers and writers of the engine's file shapes: vaults, parsed books, gold sets, reviews, metrics."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.functions import text as tx
from semlake.sources.keyed import KeyedTable

BOOK = "source_id string, title string, authors array<string>, isbn string, pages int, source_paths array<string>, parser string, parsed_at string, removed boolean"
GOLD = "id string, category string, query string, gold_sources array<struct<type:string,vault_id:string,rel_path:string,source_id:string>>, expected_facts array<string>, min_hops int, thresholds map<string,double>"
PREDICTIONS = "head string, rel string, tail string, score double, run_id string"


def scan_notes(spark: SparkSession, folder: str, vault_id: str, pattern: str = "*.md") -> DataFrame:
    """Every ``*.md`` under a vault: ``vault_id, rel_path, content, file_sha, modified_at``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + __import__("re").escape(root) + "/", "")
    return raw.select(F.lit(vault_id).alias("vault_id"), F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("rel_path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("file_sha"), F.col("modificationTime").alias("modified_at"))


def scan_books(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of the books that aren't removed: ``folder/<sha>/metadata.json`` and ``folder/<sha>/chapters/<slug>.md``."""
    meta = spark.read.schema(BOOK).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").json(folder)
    live = meta.withColumn("book", F.regexp_extract(F.input_file_name(), r"/([^/]+)/metadata\.json$", 1)).filter(~F.coalesce("removed", F.lit(False)))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    path = F.input_file_name()
    chapters = text.select(F.regexp_extract(path, r"/([^/]+)/chapters/[^/]+$", 1).alias("book"), F.regexp_extract(path, r"/([^/]+)\.md$", 1).alias("slug"), F.col("value").alias("content"))
    return live.select("book", "title").join(chapters, "book").orderBy("book", "slug")


def books_at(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "source_id", newer="parsed_at")


def write_books(books: DataFrame, path: str) -> int:
    """Book metadata put into the keyed table at ``path``: the newest row of each ``source_id`` stays, and books of
    earlier writes do."""
    return books_at(books.sparkSession, path).merge(books)


def append_quality(chapters: DataFrame, path: str) -> None:
    """One JSON row for each chapter ``(book, slug, content)``: score of four digits, review flag, time."""
    score = F.round(tx.qa_score(F.col("content")), 4)
    chapters.select("book", "slug", score.alias("qa_score"), (score < 0.3).alias("needs_review"), F.current_timestamp().alias("checked_at")).write.mode("append").json(path)


def pages_at(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "content_hash", guard="content_hash")


def save_pages(pages: DataFrame, path: str) -> int:
    """Saved pages ``(url, title, content, fetched_at)`` with a front-matter header, one for each content hash: the
    first that was saved, and the earliest of one write.  Pages of earlier writes stay."""
    header = F.concat(F.lit("---\nurl: "), "url", F.lit("\ntitle: "), "title", F.lit("\nfetched_at: "), F.col("fetched_at").cast("string"), F.lit("\n---\n\n"))
    keyed = pages.withColumn("content_hash", F.sha2("content", 256)).withColumn("document", F.concat(header, "content"))
    first = keyed.groupBy("content_hash").agg(F.min_by(F.struct("url", "title", "document"), F.struct("fetched_at", "url")).alias("r")).select("content_hash", "r.*")
    return pages_at(pages.sparkSession, path).merge(first)


#: Days that cached entity data are good for, by level.
TTL_DAYS = {"L1": 30, "L2": 30, "L3": 7}


def cache_at(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ["qid", "level"], newer="fetched_at")


def cache_put(rows: DataFrame, path: str) -> int:
    """``rows(qid, level, payload, fetched_at)`` put into the cache at ``path``, each with the time when it expires."""
    days = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in TTL_DAYS.items()], F.lit(30))
    expires = F.timestamp_add("day", days, F.col("fetched_at"))
    return cache_at(rows.sparkSession, path).merge(rows.select("qid", "level", "payload", "fetched_at", expires.alias("expires_at")))


def cache_live(spark: SparkSession, path: str, now: F.Column) -> DataFrame:
    return cache_at(spark, path).read().filter(F.col("expires_at") > now)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions in their fixed schema; an empty table still leaves a readable file."""
    cols = [F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in PREDICTIONS.split(", "))]
    predictions.select(*cols).write.mode("overwrite").parquet(path)


def append_quads(quads: DataFrame, path: str) -> None:
    """Quads added to a table that is partitioned by graph: a batch writes only its own graphs' folders."""
    quads.select("s", "p", "o", "o_is_iri", "graph").write.mode("append").partitionBy("graph").parquet(path)


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("s string, p string, o string, o_is_iri boolean, graph string").parquet(path)


SENTINEL = (
    "id string, name string, description string, query string, retrieval struct<min_chunks:int,required_source_types:array<string>,min_graph_hops:int>, "
    "answer struct<must_contain_concepts:array<string>,must_cite_sources:boolean,max_latency_ms:long>, runnable_from_phase int, manual_test string"
)


def read_sentinels(spark: SparkSession, folder: str, pattern: str = "S*.yaml") -> DataFrame:
    """Sentinel definitions, one a file, in name order."""
    return read_yaml(spark, folder, pattern, SENTINEL)


def read_yaml(spark: SparkSession, folder: str, pattern: str, schema: str = GOLD) -> DataFrame:
    """YAML files by name pattern as rows of ``schema`` in name order; files that don't parse to a mapping are skipped."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for name, value in zip(pdf["file"], pdf["value"]):
                try:
                    doc = yaml.safe_load(value)
                except yaml.YAMLError:
                    continue
                if isinstance(doc, dict):
                    out.append((name, json.dumps(doc, default=str)))
            yield pd.DataFrame(out, columns=["file", "js"])

    return raw.mapInPandas(run, "file string, js string").select("file", F.from_json("js", schema).alias("r")).select("file", "r.*").orderBy("file")


def read_gold(spark: SparkSession, folder: str, category: str | None = None, pattern: str = "q-*.yaml") -> DataFrame:
    gold = read_yaml(spark, folder, pattern).filter("id is not null")
    return gold.filter(F.col("category") == category) if category else gold


def read_privacy_cases(spark: SparkSession, folder: str) -> DataFrame:
    case = "struct<id:string,category:string,query:string,pii_type:string,expected:string,expected_outbound_clean:boolean>"
    return read_yaml(spark, folder, "privacy_cases.yaml", f"cases array<{case}>").select(F.explode("cases").alias("c")).select("c.*")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """Two rating lists of a JSON file as rows ``(a, b)``."""
    raw = spark.read.schema("human array<int>, judge array<int>").option("multiLine", "true").json(path)
    return raw.select(F.explode(F.arrays_zip("human", "judge")).alias("r")).select(F.col("r.human").alias("a"), F.col("r.judge").alias("b"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Sensitive entities, one a line; blanks and ``#`` lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("entity")).filter("entity <> '' and not startswith(entity, '#')")


def write_review_csv(rows: DataFrame, path: str, order: list[F.Column], n: int = 50) -> None:
    rows.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_summary(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
