"""Queries of answer rendering, lookups, list merging and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semlake.fixtures import frame
from semlake.functions import text as tx
from semlake.operators import extract as ex
from semlake.operators import links as lk
from semlake.operators import logs as lg
from semlake.operators import quads as qd
from semlake.operators import render as rd
from semlake.operators import retrieval as rt
from semlake.operators import understanding as un
from semlake.plans.linking import _GATED, _gated
from semlake.plans.operations import _SURFACE
from semlake.plans.registry import query
from semlake.plans.graph import _WALK, _walk
from semlake.plans.retrieval import _BM25, _PLACED, _RERANK, _chunks, _dense_sql, _embedded, _live, _placed, _qvec, _reranked, _sparse
from semlake.plans.understanding import _RECALL
from semlake.sources.scratch import folder


@query("SELECT predicate, n, CASE predicate WHEN 'mentions' THEN 0.8e0 WHEN 'authoredBy' THEN 0.9e0 ELSE 0.85e0 END AS floor FROM (SELECT predicate, count(*) AS n FROM @candidates GROUP BY 1)")
def a14_predicate_dimension(spark: SparkSession, sf: str) -> DataFrame:
    n = frame(spark, sf, "candidates").groupBy("predicate").agg(F.count("*").alias("n"))
    floors = spark.createDataFrame(list(ex.PREDICATE_FLOORS.items()), "predicate string, floor double")
    return n.join(F.broadcast(floors), "predicate", "left").select("predicate", "n", F.coalesce("floor", F.lit(ex.OTHER_FLOOR)).alias("floor"))


@query("SELECT doc_id, lang FROM @documents WHERE lang IN ('en', 'de') OR lang IS NULL")
def b06_language_filter(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "documents").filter(F.col("lang").isin("en", "de") | F.col("lang").isNull()).select("doc_id", "lang")


@query("SELECT c.doc_id, CASE WHEN p.content IS NULL THEN length(c.content) ELSE length(p.content) END AS n FROM @notes c LEFT JOIN (SELECT doc_id, content FROM @notes WHERE doc_id % 3 = 0) p ON p.doc_id = c.doc_id - c.doc_id % 3 + CASE WHEN c.doc_id % 3 = 2 THEN 1 ELSE 0 END")
def c01_parent_fill(spark: SparkSession, sf: str) -> DataFrame:
    n = frame(spark, sf, "notes")
    parent = n.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("pid"), F.col("content").alias("pc"))
    d = F.col("doc_id")
    out = n.withColumn("pid", d - d % 3 + F.when(d % 3 == 2, 1).otherwise(0)).join(parent, "pid", "left")
    return out.select("doc_id", F.length(F.coalesce("pc", "content")).cast("long").alias("n"))


@query("SELECT doc_id, vec_id IS NOT NULL AS has_vector FROM @notes LEFT JOIN @embeddings ON vec_id = doc_id")
def c02_vector_lookup(spark: SparkSession, sf: str) -> DataFrame:
    v = frame(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    return frame(spark, sf, "notes").join(v, "doc_id", "left").select("doc_id", F.coalesce("has", F.lit(False)).alias("has_vector"))


@query("SELECT q.s, q.o, l.label FROM (SELECT DISTINCT s, o FROM @quads WHERE p = 'inNation') q LEFT JOIN (SELECT s, min(o) AS label FROM @quads WHERE p = 'label' AND graph = 'tier0' GROUP BY 1) l ON l.s = q.s")
def c05_optional_label(spark: SparkSession, sf: str) -> DataFrame:
    q = frame(spark, sf, "quads")
    label = q.filter("p = 'label' and graph = 'tier0'").groupBy("s").agg(F.min("o").alias("label"))
    return q.filter("p = 'inNation'").select("s", "o").distinct().join(label, "s", "left").select("s", "o", "label")


@query("""WITH l AS (SELECT user_id % 40 AS a, user_id % 37 AS b FROM @events), e AS (SELECT DISTINCT user_id % 40 AS a, event_id % 37 AS b FROM @events WHERE event_id % 90 = 0)
SELECT DISTINCT l.a, l.b FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = l.a AND e.b = l.b) AND NOT EXISTS (SELECT 1 FROM e WHERE e.a = l.b AND e.b = l.a)""")
def c06_existing_links(spark: SparkSession, sf: str) -> DataFrame:
    ev = frame(spark, sf, "events")
    found = ev.select((F.col("user_id") % 40).alias("a"), (F.col("user_id") % 37).alias("b")).distinct()
    have = ev.filter("event_id % 90 = 0").select((F.col("user_id") % 40).alias("a"), (F.col("event_id") % 37).alias("b")).distinct()
    return found.join(have, ["a", "b"], "left_anti").join(have.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti").select("a", "b")


@query("SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' OR p_brand = 'Brand#1' THEN 'Cheap' WHEN p_type IN ('STANDARD', 'PROMO') THEN 'Common' ELSE 'Concept' END AS profile FROM @part")
def c17_type_profile(spark: SparkSession, sf: str) -> DataFrame:
    classes = frame(spark, sf, "part").select("p_partkey", F.posexplode(F.array("p_type", "p_brand")).alias("pos", "cls"))
    known = spark.createDataFrame([("ECONOMY", "Cheap", 0), ("Brand#1", "Cheap", 0), ("STANDARD", "Common", 1), ("PROMO", "Common", 1)], "cls string, profile string, place int")
    best = classes.join(F.broadcast(known), "cls", "left").groupBy("p_partkey").agg(F.min_by("profile", "place").alias("profile"))
    return best.select("p_partkey", F.coalesce("profile", F.lit("Concept")).alias("profile"))


@query("SELECT content_hash, source_id, book FROM (SELECT sha256(content) AS content_hash, min(source_id) AS book FROM @notes GROUP BY 1) JOIN (SELECT DISTINCT sha256(content) AS content_hash, source_id FROM @notes) USING (content_hash)")
def c20_book_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """Every path -> the book whose path list holds it; the list is a table of (content hash, path)."""
    paths = frame(spark, sf, "notes").select(F.sha2("content", 256).alias("content_hash"), "source_id").distinct()
    books = paths.groupBy("content_hash").agg(F.min("source_id").alias("book"))
    return paths.join(books, "content_hash").select("content_hash", "source_id", "book")


@query("WITH pg AS (SELECT page_id, html AS content, '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS fetched_at FROM @pages), pt AS (SELECT page_id, lower(unnest(regexp_extract_all(content, '[\\p{L}\\p{N}_]+'))) AS term FROM pg)"
    + _embedded("page_id", "term", "pt", "pe") + ", qa AS (SELECT query_id, lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS term FROM @queries)" + _embedded("query_id", "term", "qa", "qe") + """,
rs AS (SELECT query_id, page_id FROM @queries JOIN pg ON page_id % 40 = query_id % 40)
SELECT rs.query_id, rs.page_id, round(coalesce((SELECT sum(qe.v * pe.v) FROM qe JOIN pe USING (d) WHERE qe.query_id = rs.query_id AND pe.page_id = rs.page_id), 0), 6) AS score,
       sha256('[fetched ' || fetched_at || '] ' || content) AS digest FROM rs JOIN pg USING (page_id)""")
def e13_web_parents(spark: SparkSession, sf: str) -> DataFrame:
    queries = frame(spark, sf, "queries")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    pages = frame(spark, sf, "pages").select("page_id", F.col("html").alias("content"), day.alias("fetched_at"))
    results = queries.select("query_id", (F.col("query_id") % 40).alias("k")).join(pages.select("page_id", (F.col("page_id") % 40).alias("k")), "k").select("query_id", "page_id")
    return rt.web_parents(results, pages, queries).select("query_id", "page_id", "score", F.sha2("content", 256).alias("digest"))


@query("WITH " + _BM25 + " SELECT query_id, chunk_id, score FROM hits WHERE rank <= 3")
def e18_sources_only(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(spark, sf, 3).select("query_id", "chunk_id", "score")


@query("SELECT DISTINCT s, CASE WHEN s LIKE 'urn:%' THEN regexp_extract(s, '([^:]*)$', 1) END AS label, 'n3 §2' AS heading FROM @quads WHERE p = 'tagged'")
def f18_node_labels(spark: SparkSession, sf: str) -> DataFrame:
    q = frame(spark, sf, "quads").filter("p = 'tagged'").select("s").distinct()
    return q.select("s", rd.node_label(F.col("s")).alias("label"), rd.node_label(F.lit("urn:heading:v:a%20b:n3.md:2")).alias("heading"))


@query("""WITH m AS (SELECT conv_id, turn, text || ' [^1] so [^2] ⚠ and [^' || CAST(turn % 4 + 3 AS STRING) || '] or [^12].' AS t FROM @conversations)
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN t ELSE regexp_replace(replace(replace(t, '] ⚠', ']~'), '[^' || CAST(turn % 3 AS STRING) || ']', '[^' || CAST(turn % 3 AS STRING) || '] ⚠'), '\\] ⚠~|\\]~', '] ⚠', 'g') END AS marked FROM
  (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN replace(t, '[^3]', '[^3] ⚠') ELSE t END AS t FROM m)""")
def f29_mark_warnings(spark: SparkSession, sf: str) -> DataFrame:
    turn = F.col("turn")
    cited = F.concat("text", F.lit(" [^1] so [^2] ⚠ and [^"), (turn % 4 + 3).cast("string"), F.lit("] or [^12]."))
    refs = F.array_compact(F.array(F.when(turn % 3 > 0, (turn % 3).cast("int")), F.when(turn % 2 == 0, F.lit(3))))
    return frame(spark, sf, "conversations").select("conv_id", "turn", rd.mark_warnings(cited, refs).alias("marked"))


_CITE = """
ct AS (SELECT id, turn, source_id, CASE turn % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'book_chapter' ELSE 'web_saved' END AS kind, 'v:' || source_path AS sid FROM @citations),
lk AS (SELECT *, CASE kind WHEN 'note' THEN 'obsidian://open?vault=v&file=' || replace(substring(sid, 3), '/', '%2F') WHEN 'book_chapter' THEN 'http://h/preview/book/' || split_part(sid, '/', 1) || '/' || regexp_replace(sid, '^[^/]*/', '') ELSE 'http://h/preview/web/' || sid END AS primary_url,
  CASE kind WHEN 'note' THEN 'http://h/preview/note/v/' || substring(sid, 3) WHEN 'book_chapter' THEN 'http://h/preview/book/' || split_part(sid, '/', 1) || '/' || regexp_replace(sid, '^[^/]*/', '') ELSE 'http://h/preview/web/' || sid END AS preview_url FROM ct)"""


def _cites(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 0, "note").when(F.col("turn") % 3 == 1, "book_chapter").otherwise("web_saved")
    c = frame(spark, sf, "citations").withColumns({"source_type": kind, "sid": F.concat(F.lit("v:"), "source_path")})
    return c.withColumn("l", rd.links(F.col("source_type"), F.col("sid"), F.lit("v"), "http://h"))


@query(f"WITH {_CITE} SELECT id, turn, primary_url, preview_url FROM lk")
def f31_links(spark: SparkSession, sf: str) -> DataFrame:
    return _cites(spark, sf).select("id", "turn", F.col("l.primary").alias("primary_url"), F.col("l.preview").alias("preview_url"))


@query(f"""WITH {_CITE} SELECT id AS answer_id, string_agg('[^' || turn || ']: **[' || source_id || '](' || primary_url || ')**' || CASE WHEN preview_url <> primary_url THEN ' · [preview](' || preview_url || ')' ELSE '' END || chr(10) || '    *score ' || turn || '*', chr(10)
ORDER BY CASE kind WHEN 'note' THEN 0 WHEN 'book_chapter' THEN 1 ELSE 2 END, turn) AS block FROM lk GROUP BY 1""")
def f30_footnotes(spark: SparkSession, sf: str) -> DataFrame:
    c = _cites(spark, sf).select(F.col("id").alias("answer_id"), F.col("turn").alias("n"), "source_type", F.col("source_id").alias("title"), "l.primary", "l.preview", F.concat(F.lit("score "), F.col("turn").cast("string")).alias("meta"), F.lit("").alias("quote"))
    return rd.footnotes(c)


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name ELSE CASE p_size % 3 WHEN 1 THEN 'urn:x:' || p_name ELSE p_name END END AS value, CASE WHEN p_size % 3 = 0 THEN 'en' END AS lang, p_size % 3 = 1 AS is_iri FROM @part")
def f38_lang_split(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "part")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("@en"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("urn:x:"), "p_name")).otherwise(F.col("p_name"))
    maps = p.select(F.col("p_partkey").cast("string").alias("qid"), F.create_map(F.lit("v"), F.array(raw)).alias("properties"))
    return ex.enrichment_quads(maps).select(F.regexp_extract("s", r"(\d+)$", 1).cast("long").alias("p_partkey"), F.col("o").alias("value"), F.col("o_lang").alias("lang"), F.col("o_is_iri").alias("is_iri"))


@query("SELECT p_type AS hint, count(*) AS n, CASE p_type WHEN 'ECONOMY' THEN 'Software' WHEN 'PROMO' THEN 'Book' ELSE 'Concept' END AS norm FROM @part GROUP BY 1")
def f39_type_hints(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame([("ECONOMY", "Software"), ("PROMO", "Book")], "hint string, norm string")
    n = frame(spark, sf, "part").groupBy(F.col("p_type").alias("hint")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(m), "hint", "left").select("hint", "n", F.coalesce("norm", F.lit("Concept")).alias("norm"))


@query("SELECT source_id, 'n' || CAST(doc_id AS VARCHAR) AS label FROM @notes")
def f40_note_labels(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "notes").select("source_id", rd.note_label(F.col("source_id")).alias("label"))


@query(f"WITH {_GATED} SELECT cand_id, g3, CASE WHEN object_similarity >= 0.92 THEN object END AS reuse FROM ga")
def k05_canonical_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("cand_id", "g3", F.when(F.col("object_similarity") >= ex.REUSE, F.col("object")).alias("reuse"))


@query("""WITH t AS (SELECT qid, p, lang, max(o) AS one, array_to_string(list_sort(list(DISTINCT o)), '/') AS al FROM @bindings WHERE lang <> '' GROUP BY 1, 2, 3),
i AS (SELECT qid, p, array_to_string(list_sort(list(DISTINCT regexp_extract(o, 'Q[0-9]+$'))), ',') AS ids FROM @bindings WHERE p IN ('P31', 'P279') GROUP BY 1, 2)
SELECT q.qid, coalesce((SELECT string_agg(lang || '=' || one, ';' ORDER BY lang) FROM t WHERE t.qid = q.qid AND p = 'label'), '') AS labels,
  coalesce((SELECT string_agg(lang || '=' || one, ';' ORDER BY lang) FROM t WHERE t.qid = q.qid AND p = 'description'), '') AS descriptions,
  coalesce((SELECT string_agg(lang || '=' || al, ';' ORDER BY lang) FROM t WHERE t.qid = q.qid AND p = 'altLabel'), '') AS aliases,
  coalesce((SELECT ids FROM i WHERE i.qid = q.qid AND p = 'P31'), '') AS instance_of, coalesce((SELECT ids FROM i WHERE i.qid = q.qid AND p = 'P279'), '') AS subclass_of
FROM (SELECT DISTINCT qid FROM @bindings) q""")
def k16_entity_records(spark: SparkSession, sf: str) -> DataFrame:
    shown = lambda m, value: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ";").alias(m)
    as_is = lambda v: v
    lists = [F.array_join(c, ",").alias(c) for c in ("instance_of", "subclass_of")]
    return ex.entity_records(frame(spark, sf, "bindings")).select("qid", shown("labels", as_is), shown("descriptions", as_is), F.array_join(F.transform(F.array_sort(F.transform(F.map_keys("aliases"), lambda k: F.struct(k.alias("k")))), lambda s: F.concat(s["k"], F.lit("="), F.array_join(F.element_at("aliases", s["k"]), "/"))), ";").alias("aliases"), *lists)


@query("""WITH c AS (SELECT date_trunc('hour', ts) AS ts, tier, op, 's' || CAST(event_id % 37 AS STRING) AS s FROM @delta_log),
d AS (SELECT ts, tier, op, count(*) AS triple_count, count(DISTINCT s) * CASE op WHEN 'remove' THEN -1 ELSE 1 END AS entity_diff FROM c GROUP BY 1, 2, 3)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, tier, op, triple_count, CAST(entity_diff AS BIGINT) AS entity_diff FROM d WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'""")
def l10_delta_since(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "delta")
    changes = frame(spark, sf, "delta_log").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "tier", "op", F.concat(F.lit("s"), (F.col("event_id") % 37).cast("string")).alias("s"))
    for tier in ("tier0", "tier1"):  # each write its own transaction
        lg.record_delta(changes.filter(F.col("tier") == tier), path)
    return lg.deltas_since(spark, path, "2024-01-10 00:00:00").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, CASE WHEN value * 20 < 50 THEN 'skip' WHEN value * 20 < 500 THEN 'warm-start' WHEN value * 20 < 2000 THEN 'full' ELSE 'hpo' END AS tier FROM @events")
def l12_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "events").select("event_id", lk.tier_of(F.col("value") * 20).alias("tier"))


@query("""WITH runs AS (SELECT CAST(event_id % 700 AS BIGINT) AS run_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS rank, value AS mrr FROM @events),
w AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS run_id FROM @events)
SELECT run_id, CASE min(rank) WHEN 0 THEN 'history' ELSE 'current' END AS place, min_by(mrr, (rank, mrr)) AS mrr FROM runs JOIN w USING (run_id) GROUP BY 1""")
def l16_rollback_pick(spark: SparkSession, sf: str) -> DataFrame:
    e = frame(spark, sf, "events")
    runs = e.select((F.col("event_id") % 700).cast("long").alias("run_id"), F.col("value").alias("mrr"), "event_type")
    old = F.col("event_type").isin("view", "click")
    return lk.rollback_pick(e.select(F.col("user_id").cast("long").alias("run_id")), runs.filter(old), runs.filter(~old))


@query(f"""WITH {_dense_sql(10)}, w AS (SELECT query_id, chunk_id, score * CASE source_type WHEN 'note' THEN 1.0 WHEN 'book_chapter' THEN 0.7 ELSE 0.2 END AS score FROM dense)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM w QUALIFY rank <= 150""")
def o01_merged_top(spark: SparkSession, sf: str) -> DataFrame:
    hits = rt.dense_top_k(_live(spark, sf), _qvec(spark, sf), 10).drop("rank").join(_live(spark, sf).select("chunk_id", "source_type"), "chunk_id")
    w = F.when(F.col("source_type") == "note", 1.0).when(F.col("source_type") == "book_chapter", 0.7).otherwise(0.2)
    return rt.top_k(hits.withColumn("score", F.col("score") * w), 150, "chunk_id").select("query_id", "chunk_id", "rank")


@query("WITH " + _BM25 + ", c AS (SELECT query_id, count(*) AS n FROM hits WHERE score > 20 GROUP BY 1) SELECT q.query_id, CASE WHEN coalesce(n, 0) > 0 THEN 'full' ELSE 'partial' END AS verdict FROM @queries q LEFT JOIN c ON c.query_id = q.query_id")
def q10_corpus_evidence(spark: SparkSession, sf: str) -> DataFrame:
    n = _sparse(spark, sf).filter("score > 20").groupBy("query_id").agg(F.count("*").alias("n"))
    return frame(spark, sf, "queries").join(n, "query_id", "left").select("query_id", F.when(F.coalesce("n", F.lit(0)) > 0, "full").otherwise("partial").alias("verdict"))


@query("SELECT src, p, dst FROM (SELECT DISTINCT src, p, dst FROM (SELECT s AS src, p, o AS dst FROM @quads WHERE graph IN ('tier0', 'tier2') AND o_is_iri UNION ALL SELECT o, p, s FROM @quads WHERE graph IN ('tier0', 'tier2') AND o_is_iri))")
def u01_four_legs(spark: SparkSession, sf: str) -> DataFrame:
    return qd.steps(frame(spark, sf, "quads"), ["tier0", "tier2"])


@query("SELECT source_id, content_hash, NULL AS fetched FROM @payload UNION ALL SELECT url, content_hash, strftime(fetched_at, '%Y-%m-%d') FROM @fetch_log")
def u09_local_and_web(spark: SparkSession, sf: str) -> DataFrame:
    web = frame(spark, sf, "fetch_log").select(F.col("url").alias("source_id"), "content_hash", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"))
    return frame(spark, sf, "payload").select("source_id", "content_hash").unionByName(web, allowMissingColumns=True)


@query("SELECT id, CASE WHEN status = 'running' AND created_at < TIMESTAMP '2024-01-15 00:00:00' THEN 'pending' ELSE status END AS status FROM @jobs")
def v05_stale_running(spark: SparkSession, sf: str) -> DataFrame:
    stale = (F.col("status") == "running") & (F.col("created_at").cast("timestamp") < F.to_timestamp(F.lit("2024-01-15 00:00:00")))
    return frame(spark, sf, "jobs").select("id", F.when(stale, "pending").otherwise(F.col("status")).alias("status"))


@query(f"WITH {_SURFACE} SELECT pred_id, CAST(n AS INTEGER) AS n FROM t")
def w03_quota_take(spark: SparkSession, sf: str) -> DataFrame:
    from semlake.operators import logs as lg

    p = frame(spark, sf, "predictions")
    old = p.filter("pred_id % 7 = 0").groupBy("head", "rel", "tail").agg((F.max("score") - 0.2 * (F.min("pred_id") % 3)).alias("old_score"))
    return lg.quota_take(p, old).select("pred_id", "n")


@query("SELECT event_id, CAST(turn AS INTEGER) AS turn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM @events) ORDER BY turn, event_type LIMIT 40")
def w04_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")
    # no type gives more than the cap, so the last ordering sees a bounded number of rows of each type
    turns = frame(spark, sf, "events").withColumn("turn", F.row_number().over(w)).filter("turn <= 40")
    return turns.orderBy("turn", "event_type").limit(40).select("event_id", "turn")


@query(f"WITH {_dense_sql(7)} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM dense")
def w06_w07_ranked_lists(spark: SparkSession, sf: str) -> DataFrame:
    return rt.dense_top_k(_live(spark, sf), _qvec(spark, sf), 7).select("query_id", "chunk_id", "rank")


@query("SELECT avg(CAST(NOT unverified AS INTEGER)) AS faithfulness FROM @results")
def m02_faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "results").agg(F.avg((~F.col("unverified")).cast("int")).alias("faithfulness"))


@query("SELECT avg(CAST(NOT (contains(lower(answer), 'i cannot') OR contains(lower(answer), 'no information') OR contains(lower(answer), 'cannot answer')) AS INTEGER)) AS leak FROM @results WHERE category = 'privacy'")
def m04_leak_rate(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "results").filter("category = 'privacy'").agg(F.avg((~un.is_refusal(F.col("answer"))).cast("int")).alias("leak"))


@query("WITH " + _BM25 + " SELECT chunk_id, count(*) AS n FROM kid GROUP BY 1")
def f05_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query(_PLACED + " SELECT query_id, parent, n_children FROM par WHERE kind = 'note'")
def e09_note_promotion(spark: SparkSession, sf: str) -> DataFrame:
    return rt.promote_children(_placed(spark, sf)).filter("kind = 'note'").select("query_id", "parent", "n_children")


@query(_PLACED + " SELECT query_id, parent, n_children FROM par WHERE kind = 'chapter'")
def e10_chapter_promotion(spark: SparkSession, sf: str) -> DataFrame:
    return rt.promote_children(_placed(spark, sf)).filter("kind = 'chapter'").select("query_id", "parent", "n_children")


@query(_RERANK.replace("rank <= 10", "rank <= 30") + " SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r")
def o02_rerank_top(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf, 30)


@query("WITH " + _WALK + " SELECT query_id, node, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS r FROM walked) WHERE r <= 20")
def o06_top_paths(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node")
    return _walk(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 20").select("query_id", "node", "score")


@query(f"WITH {_RECALL} SELECT count(*) AS questions, CAST(count_if(recall = 1) AS BIGINT) AS full, CAST(count_if(recall = 0) AS BIGINT) AS none FROM rc".replace(" AS full", ' AS "full"'))
def c13_gold_pairing(spark: SparkSession, sf: str) -> DataFrame:
    r = un.gold_recall(frame(spark, sf, "gold"), frame(spark, sf, "citations"))
    return r.agg(F.count("*").alias("questions"), F.count_if(F.col("recall") == 1).alias("full"), F.count_if(F.col("recall") == 0).alias("none"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a|' || source WHEN 1 THEN source || '|y, z|' || lang WHEN 2 THEN 'x|' || lang ELSE '' END AS tags,
  CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'it''s ' || source END AS project, CASE WHEN doc_id % 4 = 1 THEN lang ELSE '' END AS area, '2024-01-0' || (doc_id % 9 + 1) AS created, CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 0 END AS n_aliases FROM @documents""")
def f07_front_matter(spark: SparkSession, sf: str) -> DataFrame:
    """Headers in four hands: brackets, blocks, comma strings, and none of the keys."""
    d, cat = frame(spark, sf, "documents"), lambda *of: F.concat(*[F.lit(x[1:]) if x.startswith("=") else F.coalesce(x, F.lit("")) for x in of])
    kinds = [
        cat("=tags: [a, '", "source", "=']\nproject: \"it's ", "source", "=\"\n"),
        cat("=tags:\n  - ", "source", "=\n  - \"y, z\"\n- '", "lang", "='\nproject: it's ", "source", "= # note\narea:   ", "lang", "=\n"),
        cat("=tags: x, ", "lang", "=\naliases:\n- one\n- two\nproject: 'it''s ", "source", "='\n"),
        cat("=other:\n  tags: no\n"),
    ]
    by = F.col("doc_id") % 4
    head = F.when(by == 0, kinds[0]).when(by == 1, kinds[1]).when(by == 2, kinds[2]).otherwise(kinds[3])
    c = F.concat(F.lit("---\n"), head, F.lit("created: 2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("\n---\n"), F.coalesce("text", F.lit("")))
    d = d.select("doc_id", c.alias("c"))
    flat = {k: tx.flat_front_matter(F.col("c"), k).alias(k) for k in ("project", "area", "created")}
    return d.select("doc_id", F.array_join(tx.front_matter_list(F.col("c"), "tags"), "|").alias("tags"), *flat.values(), F.size(tx.front_matter_list(F.col("c"), "aliases")).alias("n_aliases"))


@query("SELECT source_id, regexp_extract(source_id, '([^/:]+)\\.md$', 1) AS stem, lower('n' || CAST(doc_id + 1 AS VARCHAR)) AS linked FROM @notes_md")
def f10_link_stems(spark: SparkSession, sf: str) -> DataFrame:
    n = frame(spark, sf, "notes_md")
    return n.select("source_id", F.regexp_extract("source_id", r"([^/:]+)\.md$", 1).alias("stem"), F.lower(F.element_at(tx.wikilinks(F.col("content")), -1)).alias("linked"))


@query("SELECT cand_id, object_similarity < 0.75 AS new_object, regexp_extract(subject_uri, '[0-9]+$')::BIGINT % 5 = 0 AS new_subject, object_similarity < 0.75 OR regexp_extract(subject_uri, '[0-9]+$')::BIGINT % 5 = 0 AS is_new FROM @candidates")
def k09_new_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Subject and object are new where canonicalisation found no label near enough."""
    number = F.regexp_extract("subject_uri", r"([0-9]+)$", 1).cast("long")
    c = frame(spark, sf, "candidates").withColumn("subject_similarity", F.when(number % 5 == 0, 0.5).otherwise(0.95))
    return ex.new_entities(c).select("cand_id", "new_object", "new_subject", "is_new")


def _name_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's name beside that of the next part of its brand."""
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = frame(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name")).alias("surface"), F.coalesce(after, "p_name").alias("label"))
    return ex.string_match(p)


@query("SELECT p_partkey, upper(' ' || a) = upper(' ' || b) AS exact FROM (SELECT p_partkey, p_name AS a, coalesce(lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey), p_name) AS b FROM @part)")
def k12_string_match(spark: SparkSession, sf: str) -> DataFrame:
    return _name_pairs(spark, sf).select("p_partkey", (F.col("sm") == 1).alias("exact"))


@query()
def k12_string_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _name_pairs(spark, sf).select("p_partkey", F.round("sm", 6).alias("ratio"))


@query("SELECT count(*) AS n, count(*) < 2000 AS sparse FROM (SELECT DISTINCT s, p, o FROM @quads WHERE graph IN ('tier0', 'tier2') AND o_is_iri)")
def l02_sparse_warning(spark: SparkSession, sf: str) -> DataFrame:
    t = qd.match(frame(spark, sf, "quads"), graphs=["tier0", "tier2"]).filter("o_is_iri").select("s", "p", "o").distinct()
    return t.agg(F.count("*").alias("n"), (F.count("*") < 2000).alias("sparse"))
