"""Queries over quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.fixtures import frame
from semlake.functions import text as tx
from semlake.operators import logs as lg
from semlake.operators import quads as qd
from semlake.plans.registry import query
from semlake.sources import files as fl
from semlake.sources.scratch import folder

NEAR = ["tier0", "tier2"]
_STEPS = """
steps AS (SELECT DISTINCT src, p, dst FROM (SELECT s AS src, p, o AS dst FROM @quads WHERE graph IN ('tier0', 'tier2') AND o_is_iri
  UNION ALL SELECT o, p, s FROM @quads WHERE graph IN ('tier0', 'tier2') AND o_is_iri)),
deg AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM @quads UNION ALL SELECT o FROM @quads WHERE o_is_iri) GROUP BY 1),
hub AS (SELECT node FROM deg WHERE degree > 200),
free AS (SELECT src, p, dst, CASE p WHEN 'contains' THEN 1.0 WHEN 'placedBy' THEN 0.9 WHEN 'inNation' THEN 0.7 ELSE 0.3 END AS w FROM steps WHERE dst NOT IN (SELECT node FROM hub)),
seeds AS (SELECT c_custkey AS query_id, 'urn:customer:' || CAST(c_custkey AS STRING) AS node FROM @customer WHERE c_custkey % 100 = 0)"""
_SEEDS = "c_custkey % 100 = 0"


def _q(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "quads")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "customer").filter(_SEEDS).select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("urn:customer:"), F.col("c_custkey").cast("string")).alias("node"))


def _weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("contains", 1.0), ("placedBy", 0.9), ("inNation", 0.7)], "p string, weight double")


@query("""SELECT graph, p, count(*) AS n FROM (SELECT graph, p FROM @quads UNION ALL SELECT 'tier1', predicate FROM @candidates) GROUP BY 1, 2""")
def a09_graph_append(spark: SparkSession, sf: str) -> DataFrame:
    """The stored quads and a bulk of extracted triples, appended to the table and read back."""
    path = folder(spark, "quads")
    fl.append_quads(_q(spark, sf), path)
    fl.append_quads(frame(spark, sf, "candidates").selectExpr("subject_uri as s", "predicate as p", "object as o", "not startswith(object, 'lit:') as o_is_iri", "'tier1' as graph"), path)
    return fl.read_quads(spark, path).groupBy("graph", "p").agg(F.count("*").alias("n"))


@query("SELECT s, p, o FROM @quads WHERE o_is_iri AND o <> '' AND p NOT IN ('label', 'inRegion') AND graph IN ('tier0', 'tier2')")
def b05_training_filter(spark: SparkSession, sf: str) -> DataFrame:
    return qd.match(_q(spark, sf), graphs=NEAR).filter(F.col("o_is_iri") & (F.col("o") != "") & ~F.col("p").isin("label", "inRegion")).select("s", "p", "o")


@query("SELECT head, CASE WHEN contains(head, 'urn:note:') THEN 'note' WHEN contains(head, 'urn:tag:') THEN 'tag' WHEN contains(head, 'urn:wd:') THEN 'wikidata' ELSE 'concept' END AS kind, count(*) AS n FROM @predictions GROUP BY 1, 2")
def b10_entity_types(spark: SparkSession, sf: str) -> DataFrame:
    kind = lg.entity_type(F.col("head"))
    return frame(spark, sf, "predictions").groupBy("head", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT s, regexp_extract(u, 'entity/(Q[0-9]+)$', 1) AS qid FROM (SELECT s, 'http://www.wikidata.org/entity/Q' || regexp_extract(s, '([0-9]+)$', 1) AS u FROM @quads WHERE p = 'inNation')")
def b11_qids(spark: SparkSession, sf: str) -> DataFrame:
    u = F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.regexp_extract("s", "([0-9]+)$", 1))
    return _q(spark, sf).filter("p = 'inNation'").select("s", F.regexp_extract(u, r"entity/(Q\d+)$", 1).alias("qid"))


@query("SELECT p, count(*) AS n FROM @quads WHERE p NOT IN ('label', 'tagged') GROUP BY 1")
def b12_plumbing_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).filter(~F.col("p").isin("label", "tagged")).groupBy("p").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT vault_id, source_id, unnest(regexp_extract_all(content, '\\[\\[([^\\]|#]+)', 1)) AS target FROM @notes_md),
ix AS (SELECT vault_id, k AS key, max(rel_path) AS rel_path FROM (SELECT vault_id, rel_path, unnest([lower(regexp_replace(rel_path, '\\.md$', '')), lower(rel_path)]) AS k FROM @notes) GROUP BY 1, 2)
SELECT source_id, target, coalesce(a.rel_path, b.rel_path) IS NULL AS is_stub, 'urn:note:' || l.vault_id || ':' || coalesce(a.rel_path, b.rel_path) AS uri
FROM l LEFT JOIN ix a ON a.vault_id = l.vault_id AND a.key = lower(target) LEFT JOIN ix b ON b.vault_id = l.vault_id AND b.key = lower(target) || '.md'""")
def c03_wikilink_resolution(spark: SparkSession, sf: str) -> DataFrame:
    links = frame(spark, sf, "notes_md").select("vault_id", "source_id", F.explode(tx.wikilinks(F.col("content"))).alias("target"))
    return qd.resolve_links(links, qd.alias_index(frame(spark, sf, "notes"))).select("source_id", "target", "is_stub", "uri")


@query("WITH " + _STEPS + " SELECT src AS seed, p, dst AS entity FROM free WHERE src IN (SELECT node FROM seeds)")
def g10_expand(spark: SparkSession, sf: str) -> DataFrame:
    q = _q(spark, sf)
    return qd.expand(q, _seeds(spark, sf), NEAR, qd.hubs(q, 200))


@query("WITH " + _STEPS + """, seeds_only AS (SELECT 1) SELECT src AS seed, p, dst AS entity FROM steps WHERE src IN (SELECT node FROM seeds)""")
def c04_pattern_join(spark: SparkSession, sf: str) -> DataFrame:
    return qd.expand(_q(spark, sf), _seeds(spark, sf), NEAR)


_WALK = _STEPS + """,
h1a AS (SELECT query_id, dst AS node, round(w, 9) AS score, [node, dst] AS path, [p] AS preds FROM seeds JOIN free ON src = node),
h1 AS (SELECT query_id, node, score, path, preds FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY score DESC, path, preds) AS r FROM h1a) WHERE r = 1),
h2a AS (SELECT query_id, dst AS node, round(score * w, 9) AS score, list_append(path, dst) AS path, list_append(preds, p) AS preds FROM h1 JOIN free ON src = node
        WHERE (query_id, dst) NOT IN (SELECT (query_id, node) FROM h1)),
h2 AS (SELECT query_id, node, score, path, preds FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY score DESC, path, preds) AS r FROM h2a) WHERE r = 1),
walked AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2)"""


def _walk(spark: SparkSession, sf: str) -> DataFrame:
    q = _q(spark, sf)
    return qd.walk(q, _seeds(spark, sf), _weights(spark), 2, NEAR, qd.hubs(q, 200))


@query("WITH " + _WALK + " SELECT query_id, node, hop, score, array_to_string(path, '>') AS path, array_to_string(preds, '>') AS preds FROM walked")
def g11_walk(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(spark, sf).select("query_id", "node", "hop", "score", F.array_join("path", ">").alias("path"), F.array_join("preds", ">").alias("preds"))


@query("WITH " + _WALK + """, f AS (SELECT query_id, node, round(0.6 * score + 0.4 * (length(node) % 10 / 10.0), 6) AS final FROM walked WHERE length(node) % 2 = 0)
SELECT query_id, node, final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, node) AS INTEGER) AS rank FROM f QUALIFY rank <= 20""")
def g12_path_rank(spark: SparkSession, sf: str) -> DataFrame:
    walked = _walk(spark, sf)
    sims = walked.filter(F.length("node") % 2 == 0).select("query_id", "node", (F.length("node") % 10 / 10.0).alias("sim"))
    return qd.path_rank(walked, sims).select("query_id", "node", "final", "rank")


@query("SELECT graph, count(*) AS n FROM @quads GROUP BY 1")
def d12_quad_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).groupBy("graph").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS triples, count(DISTINCT CASE WHEN p = 'placedBy' THEN s END) AS notes, count(DISTINCT CASE WHEN p = 'tagged' THEN o END) AS tags, CAST(count_if(p = 'contains') AS BIGINT) AS links FROM @quads WHERE graph = 'tier0'")
def d13_tier0_stats(spark: SparkSession, sf: str) -> DataFrame:
    q = _q(spark, sf).filter("graph = 'tier0'")
    return q.agg(F.count("*").alias("triples"), F.countDistinct(F.when(F.col("p") == "placedBy", F.col("s"))).alias("notes"), F.countDistinct(F.when(F.col("p") == "tagged", F.col("o"))).alias("tags"), F.count_if(F.col("p") == "contains").alias("links"))


@query("SELECT o AS tag, count(*) AS n FROM @quads WHERE p = 'tagged' GROUP BY 1 ORDER BY n DESC, tag LIMIT 3")
def d14_top_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).filter("p = 'tagged'").groupBy(F.col("o").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(3)


@query("SELECT count(DISTINCT CASE WHEN graph = 'tier2' THEN s END) / count(DISTINCT s) AS coverage, count(DISTINCT CASE WHEN graph = 'tier2' THEN s END) / count(DISTINCT s) >= 0.3 AS passed FROM @quads")
def d16_coverage(spark: SparkSession, sf: str) -> DataFrame:
    share = F.countDistinct(F.when(F.col("graph") == "tier2", F.col("s"))) / F.countDistinct("s")
    return _q(spark, sf).agg(share.alias("coverage")).withColumn("passed", F.col("coverage") >= 0.3)


@query("WITH d AS (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM @quads UNION ALL SELECT o FROM @quads WHERE o_is_iri) GROUP BY 1) SELECT node, degree FROM d WHERE degree > 50")
def d21_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return qd.hubs(_q(spark, sf), 50)


@query("SELECT s, p, o, graph FROM @quads WHERE p = 'placedBy' AND o = 'urn:customer:7'")
def g01_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return qd.match(_q(spark, sf), p="placedBy", o="urn:customer:7").select("s", "p", "o", "graph")


@query("SELECT graph, p, count(*) AS n FROM @quads WHERE graph IN ('tier0', 'predictions') GROUP BY 1, 2")
def g02_graph_set(spark: SparkSession, sf: str) -> DataFrame:
    return qd.match(_q(spark, sf), graphs=["tier0", "predictions"]).groupBy("graph", "p").agg(F.count("*").alias("n"))


@query("SELECT s, p, o FROM @quads JOIN (SELECT 'urn:customer:' || CAST(c_custkey AS STRING) AS node FROM @customer WHERE c_custkey % 100 = 0) v ON s = node")
def g03_values(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).join(_seeds(spark, sf), F.col("s") == F.col("node")).select("s", "p", "o")


@query("SELECT DISTINCT s FROM @quads q WHERE p = 'contains' AND NOT EXISTS (SELECT 1 FROM @quads r WHERE r.s = q.s AND r.p = 'placedBy' AND r.graph = 'tier0')")
def g04_not_exists(spark: SparkSession, sf: str) -> DataFrame:
    q = _q(spark, sf)
    return q.filter("p = 'contains'").select("s").distinct().join(q.filter("p = 'placedBy' and graph = 'tier0'").select("s"), "s", "left_anti")


@query("SELECT count(*) > 0 AS answer FROM @quads WHERE s = 'urn:nation:3' AND p = 'inRegion'")
def g05_ask(spark: SparkSession, sf: str) -> DataFrame:
    return qd.match(_q(spark, sf), s="urn:nation:3", p="inRegion").limit(1).agg((F.count("*") > 0).alias("answer"))


@query("SELECT s, p, o FROM @quads WHERE s = 'urn:order:42'")
def g06_describe(spark: SparkSession, sf: str) -> DataFrame:
    return qd.match(_q(spark, sf), s="urn:order:42").select("s", "p", "o")


@query("SELECT DISTINCT s, p, o, graph FROM (SELECT s, p, o, graph FROM @quads UNION ALL SELECT head, rel, tail, 'predictions' FROM @predictions WHERE score > 0.8)")
def g07_insert(spark: SparkSession, sf: str) -> DataFrame:
    new = frame(spark, sf, "predictions").filter("score > 0.8").selectExpr("head as s", "rel as p", "tail as o", "true as o_is_iri", "'predictions' as graph")
    return qd.insert(_q(spark, sf), new).select("s", "p", "o", "graph")


@query("SELECT s, p, o, CASE WHEN graph = 'tier1-pending' AND p = 'contains' THEN 'tier1' WHEN graph = 'tier1-pending' AND p = 'placedBy' THEN 'tier1-rejected' ELSE graph END AS graph FROM @quads")
def g08_move(spark: SparkSession, sf: str) -> DataFrame:
    q = _q(spark, sf)
    d = q.filter("graph = 'tier1-pending' and p in ('contains', 'placedBy')").select("s", "p", "o").distinct()
    d = d.withColumn("target", F.when(F.col("p") == "contains", "tier1").otherwise("tier1-rejected"))
    return qd.move(q, d, "tier1-pending").select("s", "p", "o", "graph")


@query("""WITH gone AS (SELECT 'urn:order:' || CAST(o_orderkey AS STRING) AS node FROM @orders WHERE o_orderkey % 10 = 0),
heads AS (SELECT DISTINCT o AS node FROM @quads WHERE p = 'placedBy' AND s IN (SELECT node FROM gone))
SELECT s, p, o FROM @quads q ANTI JOIN gone ON gone.node = q.s ANTI JOIN heads ON heads.node = q.s UNION ALL SELECT node, 'source', 'tier0' FROM gone""")
def g09_replace(spark: SparkSession, sf: str) -> DataFrame:
    gone = frame(spark, sf, "orders").filter("o_orderkey % 10 = 0").select(F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")).alias("node"))
    new = gone.select(F.col("node").alias("s"), F.lit("source").alias("p"), F.lit("tier0").alias("o"), F.lit(False).alias("o_is_iri"), F.lit("tier0").alias("graph"))
    return qd.replace_note(_q(spark, sf), gone, new, part="placedBy").select("s", "p", "o")


@query("""WITH e AS (SELECT DISTINCT s, o FROM @quads WHERE p IN ('inNation', 'inRegion')) SELECT s, o FROM e UNION SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s""")
def g13_two_hop_closure(spark: SparkSession, sf: str) -> DataFrame:
    q = _q(spark, sf).filter("p in ('inNation', 'inRegion')").withColumn("p", F.lit("within"))
    return qd.closure_two(q, "within")


@query("""WITH e AS (SELECT DISTINCT s, o FROM @quads WHERE p IN ('contains', 'tagged', 'placedBy', 'inNation')), u AS (SELECT s, o FROM e UNION SELECT a.s, b.o FROM e a JOIN e b ON a.o = b.s),
l AS (SELECT DISTINCT s AS o, o AS label FROM @quads WHERE p = 'label'),
r AS (SELECT u.s, u.o, l.label, row_number() OVER (PARTITION BY u.s ORDER BY u.o, l.label NULLS LAST) AS r FROM u LEFT JOIN l USING (o)) SELECT s, o, label FROM r WHERE r <= 5""")
def g13_closure_labels(spark: SparkSession, sf: str) -> DataFrame:
    up = F.when(F.col("p").isin("contains", "tagged", "placedBy", "inNation"), "within").otherwise(F.col("p"))
    return qd.closure_labels(frame(spark, sf, "quads").withColumn("p", up), "within", 5, "label")


@query("SELECT p AS missing FROM (SELECT unnest(['contains', 'cites', 'placedBy', 'authoredBy']) AS p) WHERE p NOT IN (SELECT p FROM @quads)")
def g14_expected_predicates(spark: SparkSession, sf: str) -> DataFrame:
    want = spark.createDataFrame([(x,) for x in ("contains", "cites", "placedBy", "authoredBy")], "missing string")
    return want.join(_q(spark, sf).select(F.col("p").alias("missing")).distinct(), "missing", "left_anti")


@query("SELECT DISTINCT s, p, o, sha256(s || '|' || p || '|' || o) AS key FROM @quads WHERE graph = 'tier1-pending'")
def u04_review_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).filter("graph = 'tier1-pending'").dropDuplicates(["s", "p", "o"]).select("s", "p", "o", tx.sha(F.col("s"), F.col("p"), F.col("o")).alias("key"))


@query("SELECT DISTINCT p FROM @quads")
def u05_distinct_predicates(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).select("p").distinct()


@query("SELECT s AS uri, min(o) AS label FROM @quads WHERE p = 'label' GROUP BY 1 ORDER BY uri LIMIT 5000")
def u03_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).filter("p = 'label'").groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("label")).orderBy("uri").limit(5000)


@query("SELECT p, count(*) AS n FROM (SELECT * FROM @quads ORDER BY s, p, o, graph LIMIT 10000) GROUP BY 1")
def o03_row_cap(spark: SparkSession, sf: str) -> DataFrame:
    return _q(spark, sf).orderBy("s", "p", "o", "graph").limit(10000).groupBy("p").agg(F.count("*").alias("n"))


_MD = """
h0 AS (SELECT vault_id, rel_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS no FROM @notes_md),
hd AS (SELECT vault_id, rel_path, row_number() OVER (PARTITION BY vault_id, rel_path ORDER BY no) - 1 AS idx, length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS level, trim(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)) AS text FROM h0 WHERE regexp_matches(line, '^#{1,6}\\s+\\S'))"""


@query("WITH " + _MD + " SELECT vault_id, rel_path, CAST(idx AS INTEGER) AS idx, CAST(level AS INTEGER) AS level, text FROM hd")
def f11_headings(spark: SparkSession, sf: str) -> DataFrame:
    return qd.headings(frame(spark, sf, "notes_md"))


_NOTE_QUADS = "WITH " + _MD + """, nt AS (SELECT vault_id, rel_path, 'urn:note:' || vault_id || ':' || rel_path AS uri, 'urn:vault:' || vault_id AS vault, content FROM @notes_md),
tg AS (SELECT uri, 'urn:tag:' || lower(unnest(regexp_extract_all(content, '(^|[^\\p{L}\\p{N}_])#([\\p{L}\\p{N}_]{2,}([/-][\\p{L}\\p{N}_]+)*)', 2))) AS tag FROM nt),
lk AS (SELECT vault_id, uri, trim(unnest(regexp_extract_all(content, '\\[\\[([^\\]|#]+)(#[^\\]|]*)?(\\|[^\\]]*)?\\]\\]', 1))) AS target FROM nt),
al AS (SELECT vault_id, unnest([lower(rel_path), lower(regexp_replace(rel_path, '\\.md$', ''))]) AS k, uri AS found FROM nt),
he AS (SELECT uri, 'urn:heading:' || vault_id || ':' || rel_path || ':' || CAST(idx AS STRING) AS h, CAST(level AS STRING) AS level, text FROM hd JOIN nt USING (vault_id, rel_path)),
q AS (SELECT uri AS s, 'type' AS p, 'Note' AS o, true AS o_is_iri FROM nt UNION SELECT uri, 'inVault', vault, true FROM nt UNION SELECT vault, 'type', 'Vault', true FROM nt
  UNION SELECT uri, 'contentHash', sha256(content), false FROM nt UNION SELECT uri, 'source', 'tier0', false FROM nt
  UNION SELECT uri, 'tagged', tag, true FROM tg UNION SELECT tag, 'type', 'Tag', true FROM tg
  UNION SELECT uri, 'linksTo', found, true FROM lk JOIN al ON al.vault_id = lk.vault_id AND al.k = lower(lk.target)
  UNION SELECT uri, 'hasHeading', h, true FROM he UNION SELECT h, 'type', 'Section', true FROM he UNION SELECT h, 'level', level, false FROM he UNION SELECT h, 'label', text, false FROM he)
SELECT s, p, o, o_is_iri, 'tier0' AS graph FROM q"""


@query(_NOTE_QUADS)
def f15_note_quads(spark: SparkSession, sf: str) -> DataFrame:
    """Names without their namespaces."""
    q = qd.note_quads(frame(spark, sf, "notes_md"))
    short = lambda c: F.regexp_replace(c, "^https?://[^#]*#", "").alias(c)
    typed = F.when(F.col("p") == qd.RDF_TYPE, F.regexp_replace("o", "^https?://[^#]*#", "")).otherwise(F.col("o"))
    return q.select("s", short("p"), typed.alias("o"), "o_is_iri", "graph")


@query("""WITH b AS (SELECT p_partkey, 'urn:book:' || sha256(CAST(p_partkey AS STRING)) AS b, 'urn:chapter:' || sha256(CAST(p_partkey AS STRING)) || ':' AS c, p_name, p_brand, lower(p_type) AS slug, p_size FROM @part),
h AS (SELECT *, unnest([0, 1]) AS i FROM b),
q AS (SELECT b AS s, 'type' AS p, 'Book' AS o, true AS o_is_iri FROM b UNION SELECT b, 'label', p_name, false FROM b UNION SELECT b, 'source', 'tier0', false FROM b
  UNION SELECT b, 'modified', '2024-01-' || lpad(CAST(1 + p_size % 28 AS STRING), 2, '0') || 'T00:00:00Z^^http://www.w3.org/2001/XMLSchema#dateTime', false FROM b WHERE p_size % 3 > 0
  UNION SELECT b, 'authoredBy', 'person', true FROM b UNION SELECT 'person', 'label', p_brand, false FROM b
  UNION SELECT b, 'hasChapter', c || CAST(i AS STRING), true FROM h UNION SELECT c || CAST(i AS STRING), 'type', 'Chapter', true FROM h
  UNION SELECT c || '0', 'label', slug, false FROM b)
SELECT * FROM q""")
def f16_book_quads(spark: SparkSession, sf: str) -> DataFrame:
    """The second chapter has no name, and a third of the books no time; persons' URIs are shown as ``person``."""
    stamp = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0"), F.lit("T00:00:00Z")))
    books = frame(spark, sf, "part").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.array(F.lower("p_type"), F.lit("")).alias("slugs"), stamp.alias("modified_at"))
    person = lambda c: F.when(F.col(c).startswith("urn:person:"), "person").otherwise(F.regexp_replace(c, "^https?://[^#]*ontology#", ""))
    return qd.book_quads(books).select(person("s").alias("s"), F.regexp_extract("p", "([^#/]*)$", 1).alias("p"), person("o").alias("o"), "o_is_iri").distinct()
