"""Evidence of triples, records of external entities, paths of books, reasons, prompts and judges."""

import hashlib

from semlake.operators import extract as ex
from semlake.operators import logs as lg
from semlake.operators import quads as qd
from semlake.operators import retrieval as rt
from semlake.operators import similar
from semlake.operators import understanding as un

ROUTED = "subject_uri string, predicate string, object string, destination string, final_confidence double, chunk_id string, doc_uri string, conflict boolean"


def routed(spark):
    return spark.createDataFrame(
        [
            ("s1", "p", "o", "tier1", 0.9, "c1", "d1", False),
            ("s1", "p", "o", "tier1", 0.9, "c1", "d1", False),
            ("s1", "p", "o", "tier1", 0.9, "c2", "d1", False),
            ("s2", "p", "o", "tier1-pending", 0.75, "c1", None, True),
            ("s2", "p", "o", "tier1-pending", 0.8, "c3", "d3", False),
            ("s4", "p", "o", "tier1-pending", 0.8, "c3", "d3", False),
            ("s3", "p", "o", "tier1-rejected", 0.1, "c1", "d1", False),
        ],
        ROUTED,
    )


def test_evidence_is_written_once(spark, tmp_path):
    rows, path = routed(spark), f"file://{tmp_path}/t"
    assert ex.write_routed(rows.filter("chunk_id <> 'c3'"), path, epoch=1) == 3
    assert ex.write_routed(rows, path, epoch=1) == 0  # the epoch is in
    assert ex.write_routed(rows, path, epoch=2) == 2
    assert ex.write_routed(rows, path) == 0
    got = {(r["s"], r["graph"], r["evidence"]["confidence"], r["evidence"]["chunk"]) for r in ex.triples_at(spark, path).read().collect()}
    assert got == {("s1", "tier1", "0.9000", "c1"), ("s1", "tier1", "0.9000", "c2"), ("s2", "tier1-pending", "0.7500", "c1"), ("s2", "tier1-pending", "0.8000", "c3"), ("s4", "tier1-pending", "0.8000", "c3")}
    assert ex.write_routed(rows.limit(0), path) == 0


def test_optional_patterns_multiply_and_stay_null(spark):
    rows = ex.evidence_rows(routed(spark))
    typed = spark.createDataFrame([("s4", qd.RDF_TYPE, "T", "tier0")], "s string, p string, o string, graph string")
    got = {tuple(r) for r in qd.pending(rows.select("s", "p", "o", "graph").unionByName(typed), ex.annotations(rows)).select("s", "conf", "chunk", "doc", "conflict").collect()}
    # two confidences and two chunks of one statement; its document is known once, and s4 has a type
    assert got == {("s2", c, k, "d3", "true") for c in ("0.7500", "0.8000") for k in ("c1", "c3")}
    none = qd.optional(spark.createDataFrame([("a",), (None,)], "s string"), typed.select("s", "p", "o"), ["s"], {"kind": qd.RDF_TYPE})
    assert [r["kind"] for r in none.collect()] == [None, None]


def test_evidence_and_annotations_are_looked_up_without_sorting(spark):
    """Facts are exchanged once for both lookups, and one name of an annotation reads only its part."""
    quads = spark.createDataFrame([("a", "p", "x"), ("a", "p", "x"), ("b", "p", "x"), ("b", "p", "y"), ("c", "p", "y"), (None, "p", "x"), ("d", "p", None), ("e", "p", "x"), ("e", "p", None)], "s string, p string, o string")
    said = [(s, "p", "x", k) for s in "abcdefg" for k in ("c1", "c1", "c2")]
    cand = spark.createDataFrame([*said, (None, "p", "x", "c1")], "subject_uri string, predicate string, object string, chunk_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ex.evidence(quads, cand)
        got = {(r["subject_uri"], r["n_sources"], r["duplicate"], r["conflict"]) for r in out.collect()}
        flags = {"a": (True, False), "b": (True, True), "c": (False, True), "e": (True, False)}
        assert got == {(s, 2, *flags.get(s, (False, False))) for s in "abcdefg"}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") >= 3 and "SortMergeJoin" not in plan and "ReusedExchange" in plan
        rows = ex.evidence_rows(routed(spark))
        pend = qd.pending(rows.select("s", "p", "o", "graph"), ex.annotations(rows))
        plan = pend._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Generate" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def bindings(spark):
    wd = "http://www.wikidata.org/"
    return spark.createDataFrame(
        [
            ("Q1", "http://www.w3.org/2000/01/rdf-schema#label", "One", "en"),
            ("Q1", "label", "Uno", "en"),
            ("Q1", "label", "no language", ""),
            ("Q1", "label", None, "de"),
            ("Q1", "http://schema.org/description", "first", "en"),
            ("Q1", "altLabel", "I", "la"),
            ("Q1", "altLabel", "I", "la"),
            ("Q1", "altLabel", "Unus", "la"),
            ("Q1", wd + "prop/direct/P31", wd + "entity/Q5", None),
            ("Q1", wd + "prop/direct/P31", "no entity", None),
            ("Q1", wd + "prop/direct/P279", wd + "entity/Q7", ""),
            ("Q1", wd + "prop/direct/P310", wd + "entity/Q8", ""),
            ("Q2", "unknown", "x", "en"),
            ("Q3", "label", "Three", "en"),
        ],
        "qid string, p string, o string, lang string",
    )


def test_entity_records(spark):
    got = {r["qid"]: r for r in ex.entity_records(bindings(spark)).collect()}
    assert set(got) == {"Q1", "Q3"}
    one = got["Q1"]
    assert (one["labels"], one["descriptions"], one["aliases"]) == ({"en": "Uno"}, {"en": "first"}, {"la": ["I", "Unus"]})
    assert (one["instance_of"], one["subclass_of"]) == (["Q5"], ["Q7"])
    assert (got["Q3"]["labels"], got["Q3"]["aliases"], got["Q3"]["instance_of"]) == ({"en": "Three"}, {}, [])


def test_enrichment_levels_and_one_hop(spark):
    more = spark.createDataFrame([("Q1", "P17", "http://www.wikidata.org/entity/Q9"), ("Q1", "P1", "Haus@de"), ("Q1", "P2", "http://site/page"), ("Q4", "P1", "no record")], "qid string, p string, o string")
    profile = spark.createDataFrame([("P17",), ("P1",), ("P2",)], "p string")
    out = ex.enrichment(ex.entity_records(bindings(spark)), ex.property_maps(more, profile))
    got = {(r["s"].rsplit("/", 1)[1], r["p"].rsplit("/", 1)[1].split("#")[-1], r["o"].rsplit("/", 1)[-1], r["o_is_iri"], r["o_lang"]) for r in out.collect()}
    assert {("Q1", "P17", "Q9", True, None), ("Q1", "P1", "Haus", False, "de"), ("Q1", "P2", "page", False, None), ("Q1", "P31", "Q5", True, None), ("Q1", "altLabel", "Unus", False, "la")} <= got
    assert {g[:3] for g in got if g[1] == "enrichmentLevel"} == {("Q1", "enrichmentLevel", "L1+L2"), ("Q3", "enrichmentLevel", "L1")}
    assert not [g for g in got if g[0] == "Q4"]
    named = spark.createDataFrame([("n", "mentions", ex.ENTITY + q, True, "tier1") for q in ("Q1", "Q9", "Q77")] + [("n", "mentions", ex.ENTITY + "Q78", True, "predictions")], "s string, p string, o string, o_is_iri boolean, graph string")
    todo = ex.to_enrich(named.unionByName(out.drop("o_lang")))
    assert sorted(r[0] for r in todo.collect()) == ["Q77", "Q9"]  # Q5 and Q7 are values only


def test_book_paths_follow_renames(spark):
    e = spark.createDataFrame(
        [
            ("a", "/x", "add", None, 1),
            ("a", "/x", "rename", "/y", 2),
            ("b", "/x", "rename", "/y", 1),
            ("b", "/y", "remove", None, 2),
            ("c", "/x", "add", None, 1),
            ("c", "/x", "rename", "/x", 2),
            ("d", "/x", "add", None, 1),
            ("d", "/y", "add", None, 2),
            ("d", "/x", "rename", "/y", 3),
            ("d", "/z", "remove", None, 3),
        ],
        "sha string, path string, op string, new_path string, happened_at long",
    ).selectExpr("*", "happened_at as id")
    got = {r["sha"]: (r["paths"], r["removed"]) for r in lg.book_paths(e).collect()}
    assert got == {"a": (["/y"], False), "b": ([], True), "c": (["/x"], False), "d": (["/y"], False)}
    plain = lg.book_paths(e.filter("op <> 'rename'").drop("new_path"))
    assert {r["sha"]: r["paths"] for r in plain.collect()}["a"] == ["/x"]


def test_reasons_of_confidence(spark):
    rows = [(1, f"p{i}", 0.8, k) for i, k in enumerate(("note", "note", "web"))]
    rows += [(2, "p", 0.9, "web_saved"), (3, "p", 0.6, "book_chapter"), (4, "p", 0.6, "note"), (5, "p", 0.4, "note"), (6, "p", 0.6, "wikidata")]
    parents = spark.createDataFrame(rows, "query_id int, parent string, score double, source_type string")
    got = {r["query_id"]: (r["level"], r["reason"]) for r in similar.confidence(parents, spark.createDataFrame([(4,), (1,)], "query_id int")).collect()}
    assert got == {
        1: ("high", "2 заметок, веб использован"),
        2: ("low", "Только веб-источники (1), score=0.90"),
        3: ("medium", "1 глав книг, score=0.60"),
        4: ("low", "Доминирует общее знание (Z3), источников мало (1)"),
        5: ("low", "Слабое совпадение (score=0.40, источников: 1)"),
        6: ("medium", "1 источников, score=0.60"),
    }
    assert similar.confidence(parents.limit(0)).count() == 0


def test_prompts(spark):
    prompts = spark.createDataFrame([("web", "W"), ("notes", "N"), ("books", None), ("mail", "M"), ("notes", "O")], "channel string, prompt string")
    assert rt.template_hash(prompts).collect()[0]["template_hash"] == hashlib.sha256(b"NW").hexdigest()
    asked = spark.createDataFrame([(1, "notes", "alpha beta"), (2, "none", "alpha beta"), (3, None, None)], "id int, channel string, text string")
    got = {r["id"]: r["vec"] for r in rt.embed_queries(asked, spark.createDataFrame([("notes", "gamma ")], "channel string, prompt string")).collect()}
    want = {r["id"]: r["vec"] for r in rt.hash_embedding(spark.createDataFrame([(1, "gamma alpha beta"), (2, "alpha beta"), (3, "")], "id int, text string")).collect()}
    assert got == want


def test_judges(spark):
    raw = spark.createDataFrame(
        [
            (1, "coverage", '{"covered": [true, false, true], "coverage_fraction": 0.9}'),
            (1, "relevance", '{"score": 5}'),
            (1, "hallucination", '{"hallucination_detected": true, "hallucination_rate": 0.25}'),
            (2, "coverage", '{"covered": [true, false]}'),
            (2, "relevance", '{"score": 6}'),
            (2, "hallucination", "I think not"),
            (3, "coverage", '{"covered": [], "coverage_fraction": 3}'),
            (3, "relevance", None),
        ],
        "answer_id int, judge string, response string",
    )
    got = {r[0]: tuple(r)[1:] for r in un.judged(raw).collect()}
    assert got == {1: (0.9, 2, 3, 5, True, 0.25), 2: (0.5, 1, 2, None, None, None), 3: (None, 0, 0, None, None, None)}


def test_claim_quotes_and_keys(spark):
    claims = spark.createDataFrame([(1, 0, [2, 1, 7]), (1, 1, []), (2, 0, [1, 1])], "answer_id int, idx int, refs array<int>")
    snippets = spark.createDataFrame([(1, 1, "b" * 400), (1, 2, "two"), (1, 7, ""), (2, 1, "z"), (2, 1, "a")], "answer_id int, ref int, snippet string")
    got = {(r["answer_id"], r["idx"]): [tuple(q) for q in r["quotes"]] for r in un.claim_quotes(claims, snippets).collect()}
    assert got == {(1, 0): [(2, "two"), (1, "b" * 300)], (1, 1): [], (2, 0): [(1, "a"), (1, "a")]}
    keys = {r["answer_id"]: r["check_key"] for r in un.check_key(spark.createDataFrame([(1, "Z"), (3, None)], "answer_id int, z1 string"), snippets).collect()}
    assert keys == {1: hashlib.sha256(("Z\n---\n1:" + "b" * 100 + "|2:two|7:").encode()).hexdigest(), 3: hashlib.sha256(b"\n---\n").hexdigest()}


def test_page_and_total(spark):
    rows = spark.range(50).selectExpr("id", "id % 5 as created_at")
    got = lg.page(rows, offset=8, limit=4).collect()
    assert [(r["created_at"], r["id"], r["total"]) for r in got] == [(4, 9, 50), (4, 4, 50), (3, 48, 50), (3, 43, 50)]


def test_embedding_of_many_words_in_a_batch(spark):
    """More different words than a task keeps: those of the batch still all count."""
    many = " ".join(f"w{i}" for i in range(300_100))
    docs = spark.createDataFrame([(1, "alpha beta"), (2, many), (3, "gamma w5")], "id int, text string").coalesce(1)
    got = {r["id"]: r["vec"] for r in rt.hash_embedding(docs).collect()}
    alone = {r["id"]: r["vec"] for r in rt.hash_embedding(docs.filter("id <> 2")).collect()}
    assert got[1] == alone[1] and got[3] == alone[3] and any(got[1])


def test_labels_are_looked_up_for_the_first_ancestors_only(spark, monkeypatch):
    """Each ancestor gives a row at least, so no more of them than the limit meet the labels; rows are those of all."""
    rows = [("a", "in", f"n{i:02d}") for i in range(40)] + [(f"n{i:02d}", "in", f"top{i % 3}") for i in range(40)] + [("n00", "name", "y"), ("n00", "name", "x"), ("n02", "name", "z")]
    quads = spark.createDataFrame(rows, "s string, p string, o string")
    met, real = [], qd.optional
    monkeypatch.setattr(qd, "optional", lambda up, *rest, **more: met.append(up.filter("s = 'a'").count()) or real(up, *rest, **more))
    got = sorted(tuple(r) for r in qd.closure_labels(quads, "in", 4, "name").filter("s = 'a'").collect())
    assert got == [("a", "n00", "x"), ("a", "n00", "y"), ("a", "n01", None), ("a", "n02", "z")] and met == [4]


def test_quads_of_books_are_dealt_out_before_equal_ones_go(spark):
    """No aggregate holds the quads of all books that one task reads: rows are exchanged as they are made."""
    books = spark.createDataFrame([("1", "T", ["A", "B"], ["c", ""]), ("1", "T", ["A", "B"], ["c", ""]), ("2", "T", ["A"], [])], "sha string, title string, authors array<string>, slugs array<string>")
    out = qd.book_quads(books)
    got = [tuple(r) for r in out.collect()]
    # 3 of each book, 2 persons' names, 3 authors, 2 chapters with 5 quads
    assert len(got) == len(set(got)) == 2 * 3 + 2 + 3 + 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.index("Exchange") :]
    assert "HashAggregate" in plan[: plan.index("Exchange")] and last.index("Union") < (last.index("HashAggregate") if "HashAggregate" in last else len(last))


def test_evidence_takes_one_exchange_and_agrees_with_the_joins(spark):
    """candidates and facts move once, by subject and predicate."""
    import random

    rng = random.Random(3)
    pick = lambda *of: rng.choice(of)
    quads = spark.createDataFrame([(pick("a", "b", "c", None), pick("p", "q"), pick("x", "y", "z", None)) for _ in range(12)], "s string, p string, o string")
    cand = spark.createDataFrame([(i, pick("a", "b", "c", "d", None), pick("p", "q"), pick("x", "y", "w"), pick("c1", "c2", "c3", None)) for i in range(120)], "cand_id int, subject_uri string, predicate string, object string, chunk_id string")
    cols = ["cand_id", "n_sources", "duplicate", "conflict"]
    one = ex.evidence_in_one(quads, cand).select(*cols)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, ex.evidence(quads, cand).select(*cols).collect()))
    assert {r["conflict"] for r in one.collect()} == {r["duplicate"] for r in one.collect()} == {True, False}
    assert one._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert one._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_pending_evidence_is_that_of_the_annotations(spark):
    """what the pattern on annotated statements finds, without moving each annotation."""
    rows = ex.evidence_rows(routed(spark))
    typed = spark.createDataFrame([("s4",), ("s4",)], "s string")
    quads = rows.select("s", "p", "o", "graph").unionByName(typed.selectExpr("s", f"'{qd.RDF_TYPE}' as p", "'T' as o", "'tier0' as graph"))
    cols = ["s", "p", "o", "conf", "chunk", "doc", "conflict"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ex.pending_evidence(routed(spark), typed).select(*cols)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, qd.pending(quads, ex.annotations(rows)).select(*cols).collect()))
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
