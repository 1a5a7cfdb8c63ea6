"""Queries over notes, chunks and payloads: text functions, chunking, upsert, filters, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.fixtures import frame
from semlake.functions import tables
from semlake.functions import text as tx
from semlake.operators import chunks as ck
from semlake.operators import lemmas as lm
from semlake.operators import pages as pg
from semlake.operators import retrieval as rt
from semlake.operators import understanding as un
from semlake.plans.registry import query

WS = "' ' || chr(9) || chr(10) || chr(13)"


@query("SELECT source_id, sha256(content) AS file_id FROM @notes")
def a03_content_id(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "notes").select("source_id", F.sha2("content", 256).alias("file_id"))


@query("""
SELECT s.chunk_id, s.content_hash, false AS written FROM @payload s WHERE chunk_id NOT IN (
  SELECT i.chunk_id FROM @incoming i LEFT JOIN @payload p ON i.chunk_id = p.chunk_id WHERE p.content_hash IS NULL OR p.content_hash <> i.content_hash)
UNION ALL SELECT i.chunk_id, i.content_hash, true FROM @incoming i LEFT JOIN @payload p ON i.chunk_id = p.chunk_id WHERE p.content_hash IS NULL OR p.content_hash <> i.content_hash""")
def a07_upsert(spark: SparkSession, sf: str) -> DataFrame:
    out = ck.upsert(frame(spark, sf, "payload"), frame(spark, sf, "incoming"))
    return out.select("chunk_id", "content_hash", "written")


@query("""
SELECT count(*) AS written FROM @incoming i LEFT JOIN @payload p ON i.chunk_id = p.chunk_id WHERE p.content_hash IS NULL OR p.content_hash <> i.content_hash""")
def a07_upsert_count(spark: SparkSession, sf: str) -> DataFrame:
    return ck.upsert(frame(spark, sf, "payload"), frame(spark, sf, "incoming")).agg(F.count_if("written").alias("written"))


@query("SELECT chunk_id, removed OR doc_id % 5 = 2 AS removed FROM @payload")
def a08_soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    stored = frame(spark, sf, "payload")
    return ck.soft_delete(stored, stored.filter("doc_id % 5 = 2")).select("chunk_id", "removed")


@query("SELECT vault_id, CAST(count_if(source_type = 'note') AS BIGINT) AS notes, CAST(count_if(source_type = 'book_chapter') AS BIGINT) AS chapters FROM @notes GROUP BY 1")
def a19_scan_preview(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "notes").groupBy("vault_id").agg(F.count_if(F.col("source_type") == "note").alias("notes"), F.count_if(F.col("source_type") == "book_chapter").alias("chapters"))


@query("SELECT chunk_id, vault_id FROM @payload WHERE NOT removed AND NOT is_parent AND source_type = 'note' AND vault_id IN ('src0', 'src3', 'src5')")
def b02_notes_channel(spark: SparkSession, sf: str) -> DataFrame:
    live = frame(spark, sf, "payload").filter("not removed and not is_parent")
    return live.filter((F.col("source_type") == "note") & F.col("vault_id").isin("src0", "src3", "src5")).select("chunk_id", "vault_id")


@query("SELECT source_type, count(*) AS n FROM @payload WHERE NOT removed AND NOT is_parent AND source_type IN ('book_chapter', 'web_saved') GROUP BY 1")
def b03_cross_vault_channels(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "payload").filter("not removed and not is_parent").filter(F.col("source_type").isin("book_chapter", "web_saved")).groupBy("source_type").agg(F.count("*").alias("n"))


@query("SELECT CASE source_type WHEN 'note' THEN 'notes' WHEN 'book_chapter' THEN 'books' ELSE 'saved_web' END AS channel, count(*) AS n FROM @payload GROUP BY 1")
def b04_channel_map(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "payload").groupBy(rt.channel(F.col("source_type")).alias("channel")).agg(F.count("*").alias("n"))


@query("SELECT source_id, CASE source_type WHEN 'note' THEN 'tier1' WHEN 'book_chapter' THEN 'tier0' ELSE 'tier2' END AS trust_tier, CASE WHEN source_type = 'note' THEN vault_id ELSE '' END AS vault FROM @notes")
def b13_source_defaults(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("source_type")
    tier = F.when(kind == "note", "tier1").when(kind == "book_chapter", "tier0").otherwise("tier2")
    return frame(spark, sf, "notes").select("source_id", tier.alias("trust_tier"), F.when(kind == "note", F.col("vault_id")).otherwise("").alias("vault"))


_SECTIONS = f"""
raw AS (SELECT source_id, source_type, content, regexp_replace(content, '(?m)^(#{{1,6}}[ \\t]+\\S)', chr(1) || '\\1', 'g') AS marked FROM @notes_md),
parts AS (SELECT source_id, source_type, unnest(list_filter(string_split(marked, chr(1)), lambda x: trim(x, {WS}) <> '')) AS part,
                 generate_subscripts(list_filter(string_split(marked, chr(1)), lambda x: trim(x, {WS}) <> ''), 1) - 1 AS sec_no FROM raw),
secs AS (SELECT source_id, source_type, CAST(sec_no AS INTEGER) AS sec_no, CAST(length(regexp_extract(part, '^(#{{1,6}})[ \\t]+\\S', 1)) AS INTEGER) AS level,
                trim(regexp_extract(part, '^#{{1,6}}[ \\t]+([^\\n]*)', 1)) AS heading, trim(part, {WS}) AS section FROM parts)"""


@query(f"WITH {_SECTIONS} SELECT source_id, sec_no, level, heading, length(section) AS n_chars FROM secs")
def f01_sections(spark: SparkSession, sf: str) -> DataFrame:
    return ck.sections(frame(spark, sf, "notes_md")).select("source_id", "sec_no", "level", "heading", F.length("section").cast("long").alias("n_chars"))


@query(f"WITH {_SECTIONS} SELECT source_id, sec_no, level, heading, sha256(section) AS digest FROM secs")
def f01_sections_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The table function, joined laterally."""
    tables.register(spark)
    return spark.sql("SELECT source_id, w.sec_no, w.level, w.heading, sha2(w.section, 256) AS digest FROM {notes}, LATERAL md_sections(content) AS w", notes=frame(spark, sf, "notes_md"))


@query(f"WITH {_SECTIONS} SELECT source_id, count(*) >= CASE WHEN source_type = 'book_chapter' THEN 2 ELSE 3 END AS promoted FROM secs GROUP BY source_id, source_type")
def f02_promotion(spark: SparkSession, sf: str) -> DataFrame:
    cut = ck.sections(frame(spark, sf, "notes_md")).groupBy("source_id", "source_type").agg(F.count("*").alias("n"))
    return cut.select("source_id", ck.promotes(F.col("source_type"), F.col("n")).alias("promoted"))


@query(f"""WITH {_SECTIONS},
pr AS (SELECT source_id, count(*) >= CASE WHEN source_type = 'book_chapter' THEN 2 ELSE 3 END AS promoted FROM secs GROUP BY source_id, source_type),
allp AS (SELECT source_id, 0 AS parent_index, '' AS parent_id, content FROM raw JOIN pr USING (source_id) WHERE promoted
  UNION ALL SELECT source_id, sec_no + CAST(promoted AS INTEGER), CASE WHEN promoted THEN substring(sha256(source_id || '|0'), 1, 16) ELSE '' END, section FROM secs JOIN pr USING (source_id))
SELECT source_id, parent_index, substring(sha256(source_id || '|' || parent_index), 1, 16) AS chunk_id, parent_id, substring(sha256(content), 1, 16) AS content_hash FROM allp""")
def f03_parents(spark: SparkSession, sf: str) -> DataFrame:
    return ck.parents(frame(spark, sf, "notes_md"))


_CHILDREN = """
st AS (SELECT source_id, content, CASE WHEN length(content) <= 2048 THEN [0] ELSE range(0, length(content), 1792) END AS starts FROM @notes),
ch0 AS (SELECT source_id, content AS whole, unnest(starts) AS s FROM st),
kids AS (SELECT source_id, CAST(s // 1792 AS INTEGER) AS chunk_index, substring(whole, CAST(s + 1 AS BIGINT), 2048) AS content FROM ch0 WHERE trim(substring(whole, CAST(s + 1 AS BIGINT), 2048)) <> '')"""


@query(f"WITH {_CHILDREN} SELECT source_id, chunk_index, substring(sha256(source_id || '|' || (chunk_index + 10000)), 1, 16) AS chunk_id, substring(sha256(content), 1, 16) AS content_hash, CAST(length(content) AS BIGINT) AS n FROM kids")
def f04_child_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ck.children(frame(spark, sf, "notes")).select("source_id", "chunk_index", "chunk_id", "content_hash", F.length("content").cast("long").alias("n"))


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[ \\t\\r\\n]*(?:[\\p{L}\\p{N}_]+|[^ \\t\\r\\n\\p{L}\\p{N}_])|[ \\t\\r\\n]+') AS t FROM @documents),
w AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 64, 1), 448)) AS s FROM p)
SELECT doc_id, CAST(s // 448 AS INTEGER) AS no, CAST(s AS INTEGER) AS first_token, CAST(least(512, len(t) - s) AS INTEGER) AS n_tokens, CAST(length(array_to_string(t[1:s], '')) AS BIGINT) AS start_at, sha256(array_to_string(t[s + 1:s + 512], '')) AS digest FROM w""")
def f04_token_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = ck.token_windows(frame(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content")))
    return out.select("doc_id", "no", "first_token", "n_tokens", F.col("start_at").cast("long").alias("start_at"), F.sha2("window", 256).alias("digest"))


@query(f"WITH {_CHILDREN} SELECT source_id, chunk_index, sha256(content) AS digest FROM kids")
def f04_child_windows_sql(spark: SparkSession, sf: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT source_id, w.no AS chunk_index, sha2(w.piece, 256) AS digest FROM {notes}, LATERAL char_windows(content) AS w WHERE trim(w.piece) <> ''", notes=frame(spark, sf, "notes"))


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[ \\t\\r\\n]*(?:[\\p{L}\\p{N}_]+|[^ \\t\\r\\n\\p{L}\\p{N}_])|[ \\t\\r\\n]+') AS t FROM @documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 16, 1), 112)) AS s FROM p)
SELECT doc_id, CAST(s // 112 AS INTEGER) AS no, CAST(s AS INTEGER) AS first_token, CAST(least(128, len(t) - s) AS INTEGER) AS n_tokens, CAST(length(array_to_string(t[1:s], '')) AS BIGINT) AS start_at, sha256(array_to_string(t[s + 1:s + 128], '')) AS digest FROM w""")
def f04_token_windows_sql(spark: SparkSession, sf: str) -> DataFrame:
    tables.register(spark)
    return spark.sql("SELECT doc_id, w.no, w.first_token, w.n_tokens, CAST(w.start_at AS BIGINT) AS start_at, sha2(w.piece, 256) AS digest FROM {docs}, LATERAL token_windows(text, 128, 16) AS w", docs=frame(spark, sf, "documents"))


@query("SELECT source_id, CAST(greatest(1, floor(length(content) / 4)) AS INTEGER) AS est FROM @notes")
def f06_token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "notes").select("source_id", tx.token_estimate(F.col("content")).alias("est"))


@query("SELECT source_id, array_to_string(list_transform(regexp_extract_all(content, '(^|[^\\p{L}\\p{N}_])#([\\p{L}\\p{N}_]{2,}([/-][\\p{L}\\p{N}_]+)*)', 2), lambda x: lower(x)), ',') AS tags FROM @notes_md")
def f08_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "notes_md").select("source_id", F.array_join(tx.hashtags(F.col("content")), ",").alias("tags"))


@query("SELECT source_id, array_to_string(list_transform(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(#[^\\]|]*)?(\\|[^\\]]*)?\\]\\]', 1), lambda x: trim(x)), ',') AS links, regexp_extract(source_id, '([^/:]+)\\.md$', 1) AS stem FROM @notes_md")
def f09_wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "notes_md").select("source_id", F.array_join(tx.wikilinks(F.col("content")), ",").alias("links"), F.regexp_extract("source_id", r"([^/:]+)\.md$", 1).alias("stem"))


@query("SELECT vault_id, 'urn:note:' || vault_id || ':' || rel_path AS uri, 'urn:vault:' || vault_id AS vault_uri, 'urn:heading:' || vault_id || ':' || rel_path || ':3' AS heading_uri FROM @notes")
def f12_uris(spark: SparkSession, sf: str) -> DataFrame:
    n = frame(spark, sf, "notes")
    v, p = F.col("vault_id"), F.col("rel_path")
    return n.select("vault_id", tx.note_uri(v, p).alias("uri"), F.concat(F.lit("urn:vault:"), v).alias("vault_uri"), tx.heading_uri(v, p, F.lit(3)).alias("heading_uri"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({x})), '^#+', ''), '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'empty')"


@query(f"SELECT doc_id, {_SLUG.format(x='content')} AS slug FROM @notes")
def f13_slug(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "notes").select("doc_id", tx.slug(F.col("content")).alias("slug"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN vault_id ELSE '' END AS segment FROM @notes")
def f14_para_segment(spark: SparkSession, sf: str) -> DataFrame:
    n = frame(spark, sf, "notes")
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "Projects/").otherwise("Inbox/"), "vault_id", F.lit("/"), "rel_path")
    return n.select("doc_id", tx.para_segment(path).alias("segment"))


@query("SELECT DISTINCT o AS uri, replace(replace(lower(regexp_extract(o, '[^:]*$')), '-', ' '), '_', ' ') AS label FROM @quads WHERE o_is_iri")
def f17_uri_labels(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "quads").filter("o_is_iri").select(F.col("o").alias("uri"), tx.label_of(F.col("o")).alias("label")).distinct()


@query("SELECT doc_id, CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[^\\p{L}]', '', 'g')) / length(content) ELSE 0 END AS score, CASE WHEN length(content) > 0 THEN length(regexp_replace(content, '[^\\p{L}]', '', 'g')) / length(content) ELSE 0 END < 0.3 AS review FROM @notes")
def f19_qa_score(spark: SparkSession, sf: str) -> DataFrame:
    s = tx.qa_score(F.col("content"))
    return frame(spark, sf, "notes").select("doc_id", s.alias("score"), (s < 0.3).alias("review"))


@query(f"WITH {_SECTIONS} SELECT source_id, sec_no, lpad(CAST(sec_no AS VARCHAR), CAST(greatest(2, length(CAST(sec_no AS VARCHAR))) AS INTEGER), '0') || '-' || coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(lower(heading), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), ''), 'chapter') AS slug FROM secs")
def f20_chapter_slug(spark: SparkSession, sf: str) -> DataFrame:
    s = ck.sections(frame(spark, sf, "notes_md"))
    return s.select("source_id", "sec_no", tx.chapter_slug(F.col("sec_no"), F.col("heading")).alias("slug"))


_PAGES = "SELECT conv_id AS book, turn * 17 AS page, CASE WHEN conv_id % 2 = 0 AND turn % 3 = 1 THEN 'intro' || chr(10) || '  chapter ' || turn || chr(10) ELSE '' END || text AS text FROM @conversations"


@query(f"""WITH p AS ({_PAGES}), b AS (SELECT *, book % 2 = 0 AND text LIKE 'intro%' AS head FROM p),
h AS (SELECT *, bool_or(head) OVER (PARTITION BY book) AS headed FROM b),
c AS (SELECT *, sum(CASE WHEN CASE WHEN headed THEN head ELSE page % 30 = 0 END THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page) AS chapter FROM h)
SELECT book, CAST(c.chapter AS BIGINT) AS chapter, min(page) AS first_page, lpad(CAST(c.chapter AS STRING), 2, '0') || '-chapter-' || CASE WHEN bool_and(headed) THEN CAST(min(page) // 17 AS STRING) ELSE CAST(min(page) // 30 + 1 AS STRING) END AS slug,
  sha256(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest FROM c WHERE chapter > 0 GROUP BY book, c.chapter""")
def f21_page_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Books with headings on some pages, and books without any."""
    head = F.when((F.col("conv_id") % 2 == 0) & (F.col("turn") % 3 == 1), F.concat(F.lit("intro\n  chapter "), F.col("turn").cast("string"), F.lit("\n"))).otherwise("")
    pages = frame(spark, sf, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") * 17).alias("page"), F.concat(head, "text").alias("text"))
    return pg.page_chapters(pages).select("book", "chapter", "first_page", "slug", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(content, '[;,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors FROM @notes")
def f22_authors(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "notes").select("doc_id", F.array_join(tx.authors(F.col("content")), "|").alias("authors"))


_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|head)\\b.*?</(script|style|nav|head)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, sha256({_TEXT}) AS text_hash, CASE WHEN length({_TEXT}) >= 200 THEN 'full' ELSE 'snippet' END AS method FROM @page_links")
def f23_page_text(spark: SparkSession, sf: str) -> DataFrame:
    out = pg.page_text(frame(spark, sf, "pages"))
    return out.select("page_id", "title", F.sha2("main_text", 256).alias("text_hash"), "method")


@query("SELECT page_id, url AS s, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS o FROM @page_links")
def f24_page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pg.links(frame(spark, sf, "pages"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '|') AS headings FROM @page_links")
def f24_page_headings(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), "|").alias("headings"))


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM @documents) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t GROUP BY 1")
def f25_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = frame(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.lower("text").alias("content"))
    return rt.term_stats(rt.postings(docs)).select("term", F.col("cf"), F.col("df"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM @documents), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM @benchmark),
k AS (SELECT word, substring(word, 1, length(word) - 1) AS lemma FROM d WHERE length(word) % 2 = 0),
l AS (SELECT doc_id, term, CASE WHEN lemma IS NOT NULL THEN lemma WHEN length(term) > 4 AND term LIKE '%ings' THEN substring(term, 1, length(term) - 4) WHEN length(term) > 3 AND term LIKE '%ing' THEN substring(term, 1, length(term) - 3)
  WHEN length(term) > 2 AND term LIKE '%es' THEN substring(term, 1, length(term) - 1) WHEN length(term) > 1 AND term LIKE '%s' THEN substring(term, 1, length(term) - 1) ELSE term END AS lemma FROM t LEFT JOIN k ON k.word = t.term)
SELECT lemma, count(*) AS cf, count(DISTINCT doc_id) AS df FROM l GROUP BY 1""")
def f25_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """Frequencies of lemmas: a dictionary of words, and endings for words that it lacks."""
    word = F.explode(tx.tokens(F.lower("text")))
    known = frame(spark, sf, "benchmark").select(word.alias("word")).distinct().filter(F.length("word") % 2 == 0)
    known = known.withColumn("lemma", F.expr("substring(word, 1, length(word) - 1)"))
    endings = spark.createDataFrame([("ings", ""), ("ing", ""), ("es", "e"), ("s", "")], "ending string, put string")
    post = rt.postings(frame(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.lower("text").alias("content")))
    return lm.lemmatised(post, known, endings).groupBy(F.col("term").alias("lemma")).agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.QUOTE_STOP_WORDS) + "]"


@query(f"""WITH q AS (SELECT doc_id, text AS c, list_filter(regexp_extract_all(lower(substring(text, 300, 40)), '[a-zа-яё0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)) AS ws FROM @documents),
p AS (SELECT *, length(c) AS n, list_filter(list_transform(ws, lambda w: instr(lower(c), w)), lambda x: x > 0)[1] AS hit FROM q),
b AS (SELECT *, greatest(0, hit - 71) AS lo, least(n, hit + 69) AS hi FROM p),
e AS (SELECT *, CASE WHEN lo > 0 AND contains(substring(c, 1, lo), ' ') THEN length(regexp_extract(substring(c, 1, lo), '(?s)^(.* )[^ ]*$', 1)) ELSE lo END AS st,
        CASE WHEN hi < n AND instr(substring(c, hi + 1), ' ') > 0 THEN hi + instr(substring(c, hi + 1), ' ') - 1 ELSE hi END AS en FROM b)
SELECT doc_id, CASE WHEN n <= 140 THEN trim(c) WHEN hit IS NULL THEN trim(CASE WHEN contains(substring(c, 1, 140), ' ') THEN regexp_replace(substring(c, 1, 140), ' [^ ]*$', '') ELSE substring(c, 1, 140) END)
  ELSE CASE WHEN st > 0 THEN '…' ELSE '' END || trim(substring(c, st + 1, en - st)) || CASE WHEN en < n THEN '…' ELSE '' END END AS quote FROM e""")
def f28_quote(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "documents").select("doc_id", tx.quote(F.col("text"), F.substring("text", 300, 40)).alias("quote"))


@query("""WITH s AS (SELECT doc_id, regexp_replace(content, '(?m)^(#{1,2}[ \\t]+\\S)', chr(1) || '\\1', 'g') AS marked FROM @notes_md),
p AS (SELECT doc_id, list_filter(string_split(marked, chr(1)), lambda x: regexp_matches(x, '^#{1,2}[ \\t]+\\S')) AS secs FROM s)
SELECT doc_id, CAST(greatest(1, len(secs)) AS BIGINT) AS n_chapters FROM p""")
def f41_book_chapters(spark: SparkSession, sf: str) -> DataFrame:
    out = pg.book_chapters(frame(spark, sf, "notes_md").select("doc_id", "content"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_chapters"))


@query("SELECT conv_id, avg(length(text)) AS per_page, avg(length(text)) >= 500 AND bool_and(text NOT LIKE '%[]%') AS fast FROM @conversations GROUP BY 1")
def f42_parse_path(spark: SparkSession, sf: str) -> DataFrame:
    pages = frame(spark, sf, "conversations")
    return pages.groupBy("conv_id").agg(F.avg(F.length("text")).alias("per_page"), ((F.avg(F.length("text")) >= 500) & F.bool_and(~F.col("text").contains("[]"))).alias("fast"))


@query("SELECT CAST(o AS VARCHAR) AS content_hash, array_to_string(list_sort(list(DISTINCT source_id)), '|') AS paths, min(source_id) AS first_path FROM (SELECT sha256(content) AS o, source_id FROM @notes) GROUP BY 1")
def u10_books_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    out = frame(spark, sf, "notes").groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.array_sort(F.collect_set("source_id")).alias("p"))
    return out.select("content_hash", F.array_join("p", "|").alias("paths"), F.col("p")[0].alias("first_path"))


@query("WITH t AS (SELECT source_id, list_concat(['x' || (doc_id % 3), 't' || (doc_id % 5)], ['t' || (doc_id % 7)]) AS a FROM @notes) SELECT source_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS tags FROM t")
def u08_tag_union(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    first = F.array(F.concat(F.lit("x"), (d % 3).cast("string")), F.concat(F.lit("t"), (d % 5).cast("string")))
    return frame(spark, sf, "notes").select("source_id", F.array_join(F.array_distinct(F.concat(first, F.array(F.concat(F.lit("t"), (d % 7).cast("string"))))), ",").alias("tags"))


@query("SELECT array_to_string(list_filter(['embed_model', CASE WHEN 64 <> max(len(embedding)) THEN 'dim' END, 'template_hash'], lambda x: x IS NOT NULL), ',') AS differs FROM @embeddings")
def a17_schema_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    stored = frame(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("dim")).withColumns({"embed_model": F.lit("m1"), "template_hash": F.sha2(F.lit("a"), 256)})
    want = {"embed_model": "m2", "dim": 64, "template_hash": "none"}
    return stored.select(F.array_join(F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in want.items()])), ",").alias("differs"))


@query("""WITH p AS (SELECT source, CASE doc_id % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'notes' WHEN 2 THEN 'books' WHEN 3 THEN 'web_saved' ELSE 'mail' END AS channel, text FROM @documents WHERE source IS NOT NULL),
o AS (SELECT source, channel, min(text) AS t, CASE channel WHEN 'notes' THEN 1 WHEN 'books' THEN 2 WHEN 'web_saved' THEN 3 ELSE 4 END AS n FROM p WHERE channel <> 'mail' GROUP BY 1, 2)
SELECT source, sha256(string_agg(coalesce(t, ''), '' ORDER BY n)) AS template_hash FROM o GROUP BY 1""")
def f36_template_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts of each source: its texts by channel, one channel without a place in the order."""
    channel = F.element_at(F.array(*[F.lit(c) for c in ("web", "notes", "books", "web_saved", "mail")]), (F.col("doc_id") % 5 + 1).cast("int"))
    prompts = frame(spark, sf, "documents").filter("source is not null").select("source", channel.alias("channel"), F.col("text").alias("prompt"))
    return rt.template_hash(prompts, ["source"])


@query("SELECT id, sha256(text || '|' || CASE id % 3 WHEN 0 THEN 'bing,duck' WHEN 1 THEN 'bing,duck,wiki' ELSE 'wiki' END) AS search_key FROM @decorated WHERE text IS NOT NULL")
def f35_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.when(F.col("id") % 3 == 0, F.array(F.lit("duck"), F.lit("bing"))).when(F.col("id") % 3 == 1, F.array(F.lit("wiki"), F.lit("duck"), F.lit("bing"))).otherwise(F.array(F.lit("wiki")))
    return frame(spark, sf, "decorated").filter("text is not null").select("id", tx.sha(F.col("text"), F.array_join(F.array_sort(asked), ",")).alias("search_key"))


@query("SELECT page_id, sha256(url) AS url_key FROM @pages")
def f35_url_key(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "pages").select("page_id", F.sha2("url", 256).alias("url_key"))


@query("""WITH s AS (SELECT conv_id, string_agg(turn || ':' || substr(text, 1, 100), '|' ORDER BY turn) AS l FROM @conversations WHERE turn > 0 GROUP BY 1)
SELECT conv_id AS answer_id, sha256(coalesce(text, '') || chr(10) || '---' || chr(10) || coalesce(l, '')) AS check_key FROM @conversations c LEFT JOIN s USING (conv_id) WHERE turn = 0""")
def f35_check_key(spark: SparkSession, sf: str) -> DataFrame:
    c = frame(spark, sf, "conversations").withColumnRenamed("conv_id", "answer_id")
    return un.check_key(c.filter("turn = 0").select("answer_id", F.col("text").alias("z1")), c.filter("turn > 0").select("answer_id", F.col("turn").alias("ref"), F.col("text").alias("snippet")))
