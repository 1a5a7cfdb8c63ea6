"""Input tables that the registered queries derive from the given ones.

Each is one SELECT that means the same in Spark and in DuckDB.  ``@name`` stands for another derived table or for a
given one; ``SHA(x)`` for the engine's hexadecimal SHA-256.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

_GRAPH = "CASE WHEN {k} % 13 = 0 THEN 'predictions' WHEN {k} % 11 = 0 THEN 'tier1-pending' WHEN {k} % 7 = 0 THEN 'tier2' ELSE 'tier0' END"


def _quads(s: str, p: str, o: str, table: str, key: str, iri: bool = True) -> str:
    return f"SELECT {s} AS s, '{p}' AS p, {o} AS o, {'true' if iri else 'false'} AS o_is_iri, {_GRAPH.format(k=key)} AS graph FROM @{table}"


_EDGES = [
    _quads("'urn:customer:' || CAST(c_custkey AS STRING)", "inNation", "'urn:nation:' || CAST(c_nationkey AS STRING)", "customer", "c_custkey"),
    _quads("'urn:customer:' || CAST(c_custkey AS STRING)", "label", "c_name", "customer", "c_custkey", False),
    _quads("'urn:nation:' || CAST(n_nationkey AS STRING)", "inRegion", "'urn:region:' || CAST(n_regionkey AS STRING)", "nation", "n_nationkey"),
    _quads("'urn:nation:' || CAST(n_nationkey AS STRING)", "label", "n_name", "nation", "n_nationkey", False),
    _quads("'urn:supplier:' || CAST(s_suppkey AS STRING)", "inNation", "'urn:nation:' || CAST(s_nationkey AS STRING)", "supplier", "s_suppkey"),
    _quads("'urn:order:' || CAST(o_orderkey AS STRING)", "placedBy", "'urn:customer:' || CAST(o_custkey AS STRING)", "orders", "o_orderkey"),
    _quads("'urn:part:' || CAST(p_partkey AS STRING)", "tagged", "'urn:tag:' || lower(p_type)", "part", "p_partkey"),
]
_CONTAINS = "SELECT {distinct}'urn:order:' || CAST(l_orderkey AS STRING), 'contains', 'urn:part:' || CAST(l_partkey AS STRING), true, " + _GRAPH.format(k="(l_orderkey + l_partkey)") + " FROM @lineitem"

DERIVED: dict[str, str] = {
    "notes": """
        SELECT doc_id, source || ':n' || CAST(doc_id AS STRING) || '.md' AS source_id, source AS vault_id, 'n' || CAST(doc_id AS STRING) || '.md' AS rel_path,
               CASE doc_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'book_chapter' ELSE 'web_saved' END AS source_type,
               CASE WHEN doc_id % 3 = 1 THEN 'ch' || CAST(doc_id % 10 AS STRING) END AS chapter_id, text AS content
        FROM @documents""",
    "notes_md": """
        SELECT doc_id, source_id, vault_id, rel_path, source_type,
               replace(content, chr(10), chr(10) || '## ') || ' [[n' || CAST(doc_id + 1 AS STRING) || '|see]] #t' || CAST(doc_id % 7 AS STRING) || 'x' AS content
        FROM @notes""",
    "decorated": """
        SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN '/scope:src1,src2 ' WHEN 1 THEN '/no-web /deep ' WHEN 2 THEN 'I wrote ' WHEN 3 THEN 'compare my '
               WHEN 4 THEN '[[secret note]] in 2025 ' WHEN 5 THEN '#tagged what is ' ELSE '/unknown:x latest ' END || text AS text
        FROM @documents""",
    "queries": "SELECT item_id AS query_id, text FROM @benchmark",
    "chunkvec": """
        SELECT vec_id AS chunk_id, 'v' || CAST(label AS STRING) AS vault_id, vec_id % 10 = 3 AS is_parent, vec_id % 10 = 7 AS removed,
               CASE vec_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'book_chapter' ELSE 'web_saved' END AS source_type, embedding AS vec
        FROM @embeddings""",
    "payload": """
        SELECT SHA(source_id) AS chunk_id, source_id, vault_id, source_type, SHA(content) AS content_hash, doc_id % 10 = 3 AS is_parent, doc_id % 10 = 7 AS removed, doc_id FROM @notes""",
    "incoming": """
        SELECT SHA(source_id) AS chunk_id, source_id, CASE WHEN doc_id % 4 = 0 THEN SHA(content || 'v2') ELSE SHA(content) END AS content_hash, doc_id
        FROM @notes WHERE doc_id % 2 = 0
        UNION ALL SELECT SHA(source_id || '#new'), source_id, SHA(content), doc_id FROM @notes WHERE doc_id % 50 = 1""",
    "quads": " UNION ALL ".join([*_EDGES, _CONTAINS.format(distinct="DISTINCT ")]),
    # the quads as they are met, repeats included, for readers that leave out repeats themselves
    "statements": " UNION ALL ".join([*_EDGES, _CONTAINS.format(distinct="")]),
    "candidates": """
        SELECT l_orderkey * 10 + l_linenumber AS cand_id, 'urn:order:' || CAST(l_orderkey AS STRING) AS subject_uri,
               CASE l_linenumber WHEN 1 THEN 'mentions' WHEN 2 THEN 'defines' WHEN 3 THEN 'cites' WHEN 4 THEN 'authoredBy' WHEN 5 THEN 'related' WHEN 6 THEN 'contains' ELSE 'unknownPred' END AS predicate,
               CASE WHEN l_partkey % 41 = 0 THEN 'urn:order:' || CAST(l_orderkey AS STRING) WHEN l_partkey % 43 = 0 THEN 'urn:concept:some-thing' WHEN l_partkey % 47 = 0 THEN 'urn:concept:item'
                    ELSE 'urn:part:' || CAST(l_partkey AS STRING) END AS object,
               least(1.0, round(0.5 + 5 * l_discount, 2)) AS confidence,
               CASE l_returnflag WHEN 'A' THEN 'factual_specific' WHEN 'N' THEN 'framing' ELSE 'opinion' END AS claim_type,
               'c' || CAST(l_suppkey AS STRING) AS chunk_id, l_partkey % 5 = 0 AS is_new_object, round(0.5 + l_tax * 6, 2) AS object_similarity
        FROM @lineitem""",
    "predictions": """
        SELECT CASE o_orderkey % 4 WHEN 0 THEN 'urn:note:' WHEN 1 THEN 'urn:tag:' WHEN 2 THEN 'urn:wd:' ELSE 'urn:concept:' END || CAST(o_custkey AS STRING) AS head,
               'r' || CAST(o_orderkey % 3 AS STRING) AS rel, 'urn:part:' || CAST(o_orderkey % 997 AS STRING) AS tail, o_totalprice / 500000 AS score, o_orderkey AS pred_id
        FROM @orders""",
    "review_log": """
        SELECT event_id, CAST(event_id % 700 AS BIGINT) AS cand, CASE event_type WHEN 'view' THEN 'approve' WHEN 'click' THEN 'reject' ELSE 'defer' END AS action, ts AS decided_at, value AS score
        FROM @events WHERE event_type <> 'error'""",
    "jobs": """
        SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'index_note' WHEN 'click' THEN 'parse_book' WHEN 'signup' THEN 'index_chapter' WHEN 'purchase' THEN 'save_web' ELSE 'openie' END AS type,
               CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' ELSE 'running' END AS status, props AS payload_json,
               CAST(event_id % 10 AS INT) AS priority, CAST(event_id % 6 AS INT) AS attempts, ts AS created_at, value AS duration, user_id
        FROM @events""",
    "fetch_log": "SELECT event_id, 'u' || CAST(user_id AS STRING) AS url, SHA(event_type) AS content_hash, ts AS fetched_at FROM @events",
    "delta_log": "SELECT event_id, ts, 'tier' || CAST(user_id % 2 AS STRING) AS tier, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, CAST(floor(value) AS BIGINT) AS triple_count, CAST(event_id % 3 AS BIGINT) AS entity_diff FROM @events",
    "results": """
        SELECT conv_id AS id, CASE conv_id % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'refusal' WHEN 2 THEN 'privacy' ELSE 'multi_hop' END AS category,
               CASE WHEN turn % 3 = 0 THEN 'I cannot answer: ' ELSE '' END || text AS answer, CAST((conv_id * 37 + turn * 11) % 900 - 20 AS BIGINT) AS latency_ms,
               CASE WHEN conv_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, turn, conv_id % 5 = 0 AS unverified
        FROM @conversations WHERE turn = 0""",
    "citations": "SELECT conv_id AS id, 'src' || CAST((conv_id + turn) % 7 AS STRING) AS source_id, 'notes/n' || CAST((conv_id * 3 + turn) % 11 AS STRING) || '.md' AS source_path, turn FROM @conversations",
    "gold": """
        SELECT conv_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'src' || CAST(conv_id % 7 AS STRING) ELSE '' END AS source_id, 'n' || CAST((conv_id * 3 + turn) % 13 AS STRING) || '.md' AS rel_path, turn
        FROM @conversations WHERE conv_id % 6 <> 0""",
    "ratings": "SELECT doc_id AS item, quality AS a, toxic AS b FROM @labels",
    # properties of external entities: customers of the orders, their nations, and links among them
    "bindings": """
        SELECT 'Q' || CAST(c_custkey AS STRING) AS qid, 'P31' AS p, 'http://www.wikidata.org/entity/Q' || CAST(100000 + c_nationkey AS STRING) AS o, '' AS lang FROM @customer
        UNION ALL SELECT 'Q' || CAST(c_custkey AS STRING), 'P279', 'http://www.wikidata.org/entity/Q' || CAST(c_custkey % 97 AS STRING), '' FROM @customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT 'Q' || CAST(c_custkey AS STRING), 'label', c_name, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE '' END FROM @customer
        UNION ALL SELECT 'Q' || CAST(c_custkey AS STRING), 'label', c_name || ' GmbH', 'de' FROM @customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT 'Q' || CAST(c_custkey AS STRING), 'description', c_mktsegment, 'en' FROM @customer
        UNION ALL SELECT 'Q' || CAST(o_custkey AS STRING), 'altLabel', o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'fr' ELSE 'en' END FROM @orders
        UNION ALL SELECT 'Q' || CAST(100000 + n_nationkey AS STRING), 'label', n_name, 'en' FROM @nation""",
    "bindings_more": """
        SELECT 'Q' || CAST(c_custkey AS STRING) AS qid, 'P17' AS p, 'http://www.wikidata.org/entity/Q' || CAST(100000 + c_nationkey AS STRING) AS o FROM @customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT 'Q' || CAST(c_custkey AS STRING), 'P1448', c_name || chr(64) || 'en' FROM @customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT 'Q' || CAST(o_custkey AS STRING), 'P577', CAST(CAST(o_orderdate AS DATE) AS STRING) FROM @orders WHERE o_orderkey % 7 = 0""",
    "page_links": "SELECT page_id, url, html FROM @pages",
}
_REF = re.compile(r"@(\w+)")
_SHA = re.compile(r"SHA\(")


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(sql)))


def _spark_sql(sql: str) -> str:
    """SHA(x) -> sha2(x, 256), for balanced parentheses."""
    while m := _SHA.search(sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = f"{sql[: m.start()]}sha2({sql[m.end() : i - 1]}, 256){sql[i:]}"
    return sql


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table of the scale in ``sf_dir``."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spark_sql(DERIVED[name])
    used = {n: frame(spark, sf_dir, n) for n in names_in(sql)}
    return spark.sql(_REF.sub(lambda m: "{" + m[1] + "}", sql), **used)


def duckdb(sql: str) -> str:
    """Oracle SQL with its derived tables as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in GIVEN and name not in order:
            for n in names_in(DERIVED[name]):
                need(n)
            order.append(name)

    for n in names_in(sql):
        need(n)
    plain = lambda q: _SHA.sub("sha256(", _REF.sub(lambda m: m[1], q)).strip()
    ctes = ", ".join(f"{n} AS ({plain(DERIVED[n])})" for n in order)
    body = plain(sql)
    if not ctes:
        return body
    return f"WITH {ctes}, {body[4:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
