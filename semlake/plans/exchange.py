"""Queries of the readers and writers: tables written to the shared folder in the engine's file shapes and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.fixtures import frame
from semlake.plans.registry import query
from semlake.sources import files as fl
from semlake.sources.scratch import folder
from semlake.streaming import events as ev


def _one_a_file(rows: DataFrame, label: str) -> str:
    """``value`` of each row in a file of its own; for the short tables of questions."""
    path = folder(rows.sparkSession, label)
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("SELECT 'v' AS vault_id, sha256(text || chr(10)) AS file_sha, count(*) AS n FROM @benchmark GROUP BY 2")
def a01_note_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = _one_a_file(frame(spark, sf, "benchmark").select("text"), "vault")
    return fl.scan_notes(spark, path, "v", "part-*").groupBy("vault_id", "file_sha").agg(F.count("*").alias("n"))


@query("""SELECT vault_id AS book, rel_path AS slug, round(CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[^\\p{L}]', '', 'g')) / length(content) ELSE 0 END, 4) AS qa_score,
round(CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[^\\p{L}]', '', 'g')) / length(content) ELSE 0 END, 4) < 0.3 AS needs_review, count(*) AS n FROM @notes GROUP BY 1, 2, 3, 4""")
def a04_quality_append(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "quality")
    fl.append_quality(frame(spark, sf, "notes").select(F.col("vault_id").alias("book"), F.col("rel_path").alias("slug"), "content"), path)
    back = spark.read.schema("book string, slug string, qa_score double, needs_review boolean").json(path)
    return back.groupBy("book", "slug", "qa_score", "needs_review").agg(F.count("*").alias("n"))


@query("SELECT url AS source_id, max_by('t' || event_id, (fetched_at, event_id)) AS title FROM @fetch_log GROUP BY 1")
def a05_book_metadata(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "books")
    stamp = F.concat_ws("#", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    books = frame(spark, sf, "fetch_log").select("event_id", F.col("url").alias("source_id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), stamp.alias("parsed_at"))
    for third in (0, 1, 2):  # three writes; later ones bring older rows too
        fl.write_books(books.filter(F.col("event_id") % 3 == third).drop("event_id"), path)
    return fl.books_at(spark, path).read().select("source_id", "title")


@query("SELECT sha256(html) AS content_hash, min_by(url, (page_id % 7, url)) AS url FROM @pages GROUP BY 1")
def a06_saved_pages(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "saved")
    day = (F.col("page_id") % 7).cast("string")
    pages = frame(spark, sf, "pages").select("url", F.lit("t").alias("title"), F.col("html").alias("content"), day.alias("fetched_at"))
    for days in ("fetched_at < '3'", "fetched_at >= '3'"):
        fl.save_pages(pages.filter(days), path)
    return fl.pages_at(spark, path).read().filter(F.col("document").startswith("---\nurl: ")).select("content_hash", "url")


@query("SELECT rel, count(*) AS n, round(sum(score), 6) AS score FROM @predictions GROUP BY 1")
def a10_predictions_table(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "predictions")
    fl.write_predictions(frame(spark, sf, "predictions").withColumn("run_id", F.lit("r1")), path)
    return spark.read.schema(fl.PREDICTIONS).parquet(path).groupBy("rel").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query("SELECT 'q' || item_id AS id, text AS query, CAST(item_id % 3 AS INTEGER) AS min_hops FROM @benchmark WHERE item_id % 2 = 0")
def a11_gold_reader(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("item_id") % 2 == 0, "lookup").otherwise("fresh")
    row = F.struct(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), kind.alias("category"), F.col("text").alias("query"), (F.col("item_id") % 3).alias("min_hops"))
    path = _one_a_file(frame(spark, sf, "benchmark").select(F.to_json(row).alias("value")), "gold")
    return fl.read_gold(spark, path, "lookup", "part-*").select("id", "query", "min_hops")


@query("SELECT 'S' || item_id AS id, text AS query, CAST(item_id % 3 AS INTEGER) AS min_graph_hops, CAST(3000 AS BIGINT) AS max_latency_ms, 'idea' AS concept FROM @benchmark")
def a12_sentinel_reader(spark: SparkSession, sf: str) -> DataFrame:
    retrieval = F.struct(F.lit(3).alias("min_chunks"), (F.col("item_id") % 3).alias("min_graph_hops"))
    answer = F.struct(F.array(F.lit("idea")).alias("must_contain_concepts"), F.lit(3000).alias("max_latency_ms"))
    row = F.struct(F.concat(F.lit("S"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("query"), retrieval.alias("retrieval"), answer.alias("answer"))
    path = _one_a_file(frame(spark, sf, "benchmark").select(F.to_json(row).alias("value")), "sentinels")
    return fl.read_sentinels(spark, path, "part-*").select("id", "query", "retrieval.min_graph_hops", "answer.max_latency_ms", F.col("answer.must_contain_concepts")[0].alias("concept"))


@query("SELECT a, b, count(*) AS n FROM @ratings WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2")
def a13_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Rating lists in files of a few hundred items each."""
    path = folder(spark, "calibration")
    part = F.pmod(F.xxhash64("item"), F.lit(8))
    lists = frame(spark, sf, "ratings").filter("a is not null and b is not null").groupBy((F.col("item") / 500).cast("long").alias("k"), part.alias("p"))
    lists.agg(F.collect_list(F.struct("a", "b")).alias("r")).select(F.to_json(F.struct(F.col("r.a").alias("human"), F.col("r.b").alias("judge"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return fl.read_calibration(spark, path).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT trim(c_name) AS entity FROM @customer WHERE c_custkey % 3 <> 0")
def a15_sensitive_entities(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "entities")
    frame(spark, sf, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "# ").otherwise("  "), "c_name")).write.text(path)
    return fl.read_entities(spark, path).distinct()


@query("SELECT status, count(*) AS n, round(avg(duration), 6) AS seconds FROM @jobs GROUP BY 1")
def a18_summary(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "summary")
    fl.write_summary(frame(spark, sf, "jobs").groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("seconds")), path)
    return spark.read.schema("status string, n long, seconds double").json(path)


@query("""WITH w AS (SELECT ts, 'f' || user_id || CASE event_id % 3 WHEN 0 THEN '.md' ELSE '.PDF' END AS src,
  CASE event_type WHEN 'click' THEN 'remove_' || x WHEN 'error' THEN 'rename_' || x ELSE CASE x WHEN 'note' THEN 'index_note' ELSE 'parse_book' END END AS job
  FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'book' END AS x FROM @events) WHERE x IS NOT NULL)
SELECT sha256(job || '|' || src || '|') AS key, count(*) AS n FROM w GROUP BY 1""")
def s03_enqueue_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys under which items are enqueued once, with the number of items of each."""
    from semlake.plans.streams import _files

    return ev.keyed(ev.work_items(_files(spark, sf))).groupBy("key").agg(F.count("*").alias("n"))
