import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from semlake.functions import md5
from semlake.functions import text as tx
from semlake.operators import chunks as ck
from semlake.operators import extract as ex
from semlake.operators import lemmas as lm
from semlake.operators import links as lk
from semlake.operators import pages as pg
from semlake.operators import quads as qd
from semlake.operators import retrieval as rt
from semlake.operators import similar
from semlake.operators import understanding as un
from semlake.sources import files as fl


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_sections_keep_preamble_and_nesting(spark):
    d = spark.createDataFrame([(1, "pre\n# A\ntext\n## B c\nmore"), (2, "no heading"), (3, "# Only")], "id int, content string")
    got = [(r["id"], r["level"], r["heading"]) for r in ck.sections(d).orderBy("id", "sec_no").collect()]
    assert got == [(1, 0, ""), (1, 1, "A"), (1, 2, "B c"), (2, 0, ""), (3, 1, "Only")]


def test_upsert_twice_writes_nothing(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, content_hash string")
    i = spark.createDataFrame([("b", "3"), ("c", "4"), ("a", "1")], "chunk_id string, content_hash string")
    once = ck.upsert(s, i)
    assert once.filter("written").count() == 2
    assert ck.upsert(once.drop("written"), i).filter("written").count() == 0


@pytest.mark.parametrize(("text", "want"), [("Hello World", "hello-world"), ("#tag/sub", "tag-sub"), ("Привет Мир!", "привет-мир"), ("///", "empty"), ("a--b", "a-b")])
def test_slug(spark, text, want):
    assert one(spark, tx.slug(F.lit(text))) == want


def test_uris(spark):
    assert one(spark, tx.note_uri(F.lit("v"), F.lit("Проект/my note+1~.md"))) == "urn:note:v:%D0%9F%D1%80%D0%BE%D0%B5%D0%BA%D1%82/my%20note%2B1~.md"
    assert one(spark, tx.heading_uri(F.lit("v"), F.lit("a/b.md"), F.lit(2))) == "urn:heading:v:a:b.md:2"
    assert one(spark, tx.label_of(F.lit("urn:concept:some-Thing_x"))) == "some thing x"
    assert one(spark, tx.label_of(F.lit("http://x/y#Frag"))) == "frag"
    assert one(spark, tx.camel_label(F.lit("http://x/dependsOn"))) == "depends on"


def sanitised_brute(text, entities):
    """The rules one after another, as they are told."""
    import re

    blocked = len(re.findall(r"\[\[[^\]]+\]\]", text))
    text = re.sub(r"\[\[[^\]]+\]\]", "", text)
    for e in entities:
        if e.strip() and re.search(re.escape(e.strip()), text, re.IGNORECASE):
            blocked += 1
            text = re.sub(re.escape(e.strip()), "[ANON]", text, flags=re.IGNORECASE)
    blocked += len(re.findall(r"\b(?:I|me|my|we|us)\b", text, re.IGNORECASE))
    return re.sub(r"\s{2,}", " ", re.sub(r"\b(?:I|me|my|we|us)\b", "[ANON]", text, flags=re.IGNORECASE)).strip(), blocked


def test_sanitise_with_entities_in_order(spark):
    import random

    rng = random.Random(6)
    entities = ["Acme", "Acme Corp", " corp ", "Zoë", "[anon] x", "anon", "a.b", ""] + [f"Name{i}" for i in range(3000)]
    texts = ["Acme Corp met ACME", "about zoë  and a.b but not aXb", "[[x]] corp x", "name7 name2999x my Name30"] + [" ".join(rng.choice(["Acme", "corp", "x", "zoë", "a.b", "we", "Name12", "name123"]) for _ in range(12)) for _ in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string").withColumn("other", F.lit(1))
    e = spark.createDataFrame(list(enumerate(entities)), "no int, entity string")
    got = {r["id"]: r for r in un.sanitise_with(d, e).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["clean"], got[i]["n_blocked"]) == sanitised_brute(t, entities), t
        assert got[i]["is_safe"] == (got[i]["n_blocked"] == 0)
    assert got[len(texts)]["clean"] == "" and got[len(texts)]["is_safe"]
    assert un.sanitise_with(d, e, strict=False).filter("not is_safe").count() == 0
    assert un.sanitise_with(d, e.limit(0)).count() == len(texts) + 1
    plan = un.sanitise_with(d, e)._jdf.queryExecution().executedPlan().toString()
    assert "Name2999" not in plan


def test_token_windows_make_up_the_text(spark):
    texts = ["", "one", " lead and trail \n", "Ünï, кот! " * 400, "x" * 5000, ". " * 700]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    by = {}
    for r in ck.token_windows(d).orderBy("id", "no").collect():
        by.setdefault(r["id"], []).append(r)
    for i, t in enumerate(texts):
        rows, whole = by[i], ""
        for r in rows:
            assert t[r["start_at"] :].startswith(r["window"]) and r["n_tokens"] <= 512 and r["start_at"] <= len(whole)
            whole = whole[: r["start_at"]] + r["window"]
        assert whole == t and [r["first_token"] for r in rows] == [448 * k for k in range(len(rows))]
        assert all(r["n_tokens"] == 512 for r in rows[:-1]) and (len(rows) == 1 or rows[-1]["n_tokens"] > 64)


def test_lemmas(spark):
    words = spark.createDataFrame([(w,) for w in ["cats", "s", "es", "boxes", "sings", "mice", "ing", "rings", "läufen"]], "term string")
    known = spark.createDataFrame([("mice", "mouse"), ("mice", "zz"), ("rings", "ring")], "word string, lemma string")
    endings = spark.createDataFrame([("s", ""), ("es", "e"), ("ings", ""), ("en", ""), ("läufen", "x")], "ending string, put string")
    got = {r["term"]: r["lemma"] for r in lm.lemma_map(words, known, endings).collect()}
    assert got == {"cats": "cat", "s": "s", "es": "e", "boxes": "boxe", "sings": "s", "mice": "mouse", "ing": "ing", "rings": "ring", "läufen": "läuf"}


def test_version_chain_without_lists(spark):
    from semlake.operators import logs as lg

    hashes = ["a", "a", "b", "a", "c", "c", "b"]
    d = spark.createDataFrame([("u", h, i, i) for i, h in enumerate(hashes)] + [("v", "a", 0, 0)], "url string, content_hash string, fetched_at int, event_id int")
    chain, held = lg.version_chain(d)
    assert "array" not in dict(chain.dtypes).values() and held.count() == 4
    got = [(r["event_id"], list(r["previous"]), r["is_update"], r["is_duplicate"]) for r in lg.with_previous(chain, held).filter("url = 'u'").orderBy("event_id").collect()]
    assert got == [(0, [], False, False), (2, ["a"], True, False), (3, ["a", "b"], True, True), (4, ["a", "b"], True, False), (6, ["a", "b", "c"], True, True)]


def test_front_matter(spark):
    c = F.lit("---\ntags: [One, 'two']\nproject: Deep\n---\nbody #Three #x [[Target|alias]] [[Other#h]] a#no")
    assert one(spark, tx.front_matter_list(c, "tags")) == ["One", "two"]
    assert one(spark, tx.flat_front_matter(c, "project")) == "Deep"
    assert one(spark, tx.hashtags(c)) == ["three"]
    assert one(spark, tx.wikilinks(c)) == ["Target", "Other"]


@pytest.mark.parametrize(
    ("head", "tags", "project"),
    [
        ("tags:\n  - alpha\n  - 'it''s'\nproject: p # why", ["alpha", "it's"], "p"),
        ("tags:\n- a\n-  \"y, z\"\n", ["a", "y, z"], ""),
        ("tags: one, two ,\nproject: \"q: r\"", ["one", "two"], "q: r"),
        ("tags: [\"y, z\", x]\r\nproject: ~\r", ["y, z", "x"], ""),
        ("other:\n  tags: no\n- stray\ntags:\n", [], ""),
        ("", [], ""),
    ],
)
def test_front_matter_in_many_hands(spark, head, tags, project):
    c = F.lit(f"---\n{head}\n---\nbody\n- item\ntags: none")
    assert one(spark, tx.front_matter_list(c, "tags")) == tags
    assert one(spark, tx.flat_front_matter(c, "project")) == project
    assert one(spark, tx.front_matter_list(F.lit("no header\ntags: x"), "tags")) == []


def test_chapters_of_pages(spark):
    rows = [("h", i, f"page {i}" if i != 1 else "page\n  # One \nmore\n# Two") for i in range(64)] + [("n", i, f"text {i}") for i in range(64)] + [("c", 0, "x"), ("c", 1, "CHAPTER 2"), ("c", 2, "Chapter two"), ("c", 3, "part IV")]
    got = {}
    for r in pg.page_chapters(spark.createDataFrame(rows, "book string, page int, text string")).orderBy("book", "chapter").collect():
        got.setdefault(r["book"], []).append((r["first_page"], r["slug"], r["text"].count("\n\n") + 1))
    assert got == {"h": [(1, "01-one", 63)], "n": [(0, "01-chapter-1", 30), (30, "02-chapter-2", 30), (60, "03-chapter-3", 4)], "c": [(1, "01-chapter-2", 2), (3, "02-part-iv", 1)]}


def test_quote(spark):
    text = "word " * 60 + "needle in the hay " + "tail " * 60
    got = one(spark, tx.quote(F.lit(text), F.lit("find the needle")))
    assert got.startswith("…") and got.endswith("…") and "needle" in got and len(got) < 170
    assert one(spark, tx.quote(F.lit("short"), F.lit("x"))) == "short"


def test_promotion(spark):
    rows = [(1, f"c{i}", f"p{i}", "s", "ch", 0.5) for i in range(3)] + [(1, "d1", "q1", "t", "ch", 0.4), (1, "d2", "q2", "t", "ch", 0.6), (1, "e", "r", "u", None, 0.9)]
    d = spark.createDataFrame(rows, "query_id int, chunk_id string, parent_id string, source_id string, chapter_id string, score double")
    got = {(r["kind"], r["parent"]): r["score"] for r in rt.promote_children(d).collect()}
    assert got == {("note", "s"): round(0.5 + 0.1 * np.log(4), 6), ("chapter", "t#ch"): round(0.5 + 0.1 * np.log(3), 6), ("section", "r"): round(0.9 + 0.1 * np.log(2), 6)}


def test_mmr_prefers_diverse(spark):
    d = spark.createDataFrame([(1, "a", 1.0, [1.0, 0.0]), (1, "b", 0.95, [1.0, 0.01]), (1, "c", 0.7, [0.0, 1.0])], "query_id int, parent_id string, score double, vec array<double>")
    assert [r["parent_id"] for r in rt.mmr(d, 2).orderBy("pick").collect()] == ["a", "c"]


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rank int")
    assert rt.rrf([a, b], 3).collect() == rt.rrf([b, a], 3).collect()
    assert rt.rrf([a, b], 3).filter("rank = 1").first()["chunk_id"] == "y"


def test_dense_top_k_of_zero_vectors_and_no_queries(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(7, [2.0, 2.0])], "query_id long, vec array<double>")
    assert [(r["chunk_id"], r["score"]) for r in rt.dense_top_k(v, q, 2).orderBy("rank").collect()] == [(2, 1.0), (1, 0.0)]
    assert rt.dense_top_k(v, q.limit(0), 2).count() == 0


def test_walk_scores_and_first_visit(spark):
    q = spark.createDataFrame([("a", "links", "b"), ("b", "links", "c"), ("a", "odd", "c"), ("c", "links", "d")], "s string, p string, o string").withColumns({"o_is_iri": F.lit(True), "graph": F.lit("tier0")})
    seeds = spark.createDataFrame([(1, "a")], "query_id int, node string")
    weights = spark.createDataFrame([("links", 0.9)], "p string, weight double")
    got = {r["node"]: (r["hop"], r["score"]) for r in qd.walk(q, seeds, weights, 2, ["tier0"]).collect() if r["node"] != "a"}
    assert got == {"b": (1, 0.9), "c": (1, 0.3), "d": (2, 0.27)}


def test_headings_outside_fences(spark):
    d = spark.createDataFrame([("v", "a.md", "# One\n```\n# not\n```\n## Two")], "vault_id string, rel_path string, content string")
    assert [(r["idx"], r["level"], r["text"]) for r in qd.headings(d).orderBy("idx").collect()] == [(0, 1, "One"), (1, 2, "Two")]
    preds = {r["p"].split("#")[-1] for r in qd.note_quads(d.withColumn("content", F.concat("content", F.lit(" [[a]] #tag1")))).collect()}
    assert {"type", "inVault", "hasHeading", "level", "linksTo", "tagged", "contentHash", "source"} <= preds


@pytest.mark.parametrize(
    ("over", "want"),
    [
        ({}, "tier1"),
        ({"confidence": 0.86, "is_new": True}, "tier1-pending"),
        ({"confidence": 0.5}, "tier1-rejected"),
        ({"predicate": "hates"}, "tier1-rejected"),
        ({"object_similarity": 0.8}, "tier1-pending"),
        ({"object": "urn:s:1"}, "tier1-rejected"),
        ({"object": "urn:concept:thing"}, "tier1-rejected"),
        ({"duplicate": True}, "tier1-rejected"),
        ({"conflict": True}, "tier1-pending"),
    ],
)
def test_gates_and_routing(spark, over, want):
    row = {"subject_uri": "urn:s:1", "predicate": "mentions", "object": "urn:o:2", "confidence": 0.9, "claim_type": "factual_specific", "is_new": False, "object_similarity": 0.0, "n_sources": 1, "duplicate": False, "conflict": False} | over
    d = spark.createDataFrame([tuple(row.values())], "subject_uri string, predicate string, object string, confidence double, claim_type string, is_new boolean, object_similarity double, n_sources long, duplicate boolean, conflict boolean")
    assert ex.route(ex.gates(d, ["mentions"])).first()["destination"] == want


def test_disambiguation(spark):
    rows = [("Python", "Q1", "Python", "Software", "programming language tool", ["a programming language"]), ("Python", "Q2", "Pythonidae", "Software", "family of snakes", ["a programming language"])]
    d = spark.createDataFrame(rows, "surface string, qid string, label string, type_hint string, description string, chunks array<string>")
    r = ex.disambiguate(d).first()
    assert (r["qid"], r["zone"]) == ("Q1", "auto")


def test_negatives_hold_no_positive(spark):
    ids = spark.createDataFrame([(i, 0, (i + 1) % 9) for i in range(9)], "h long, r long, t long")
    neg = lk.negatives(ids, spark.range(9), 8)
    assert neg.join(ids, ["h", "r", "t"], "left_semi").count() == 0 and neg.count() > 40


def test_negatives_are_looked_up_without_sorting_and_summed_where_they_are_sure(spark):
    """The draws of MD5 in any engine; two relations whose heads and tails leave some draws outside."""
    triples = [(i, i % 2, 40 + i % 7 + 30 * (i % 2)) for i in range(40)]
    ids = spark.createDataFrame(triples, "h long, r long, t long")
    hexed = lambda *k: int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:8], 16)
    want = []
    for h, r, t in triples:
        for draw in range(12):
            other = hexed(h, r, t, draw, "e42") % 80
            made = (other, r, t) if hexed(h, r, t, draw, "s42") % 2 == 0 else (h, r, other)
            want += [(*made, h, t, draw)] * (made not in set(triples))
    neg = lk.negatives(ids, spark.range(80), 12)
    assert sorted(tuple(r) for r in neg.select("h", "r", "t", "pos_h", "pos_t", "draw").collect()) == sorted(want)
    sums = lk.negative_sums(ids, spark.range(80), 12)
    assert sorted(map(tuple, sums.collect())) == [(r, *(sum(f(w) for w in want if w[1] == r) for f in (lambda w: 1, lambda w: w[0], lambda w: w[2]))) for r in (0, 1)]
    for df in (neg, sums):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort [" not in plan
    assert lk.negative_sums(ids.limit(0), spark.range(80), 12).count() == 0


def test_many_digests_at_once():
    texts = [b"", b"a", "Ж|1".encode(), b"x" * 40, *(f"{i}|{i * i}".encode() for i in range(0, 10**9, 10**7))]
    for more in ([], [b"x" * 100]):
        rows, n = md5.prefixes(np.frombuffer(b"".join(texts + more), np.uint8), np.cumsum([0, *map(len, texts + more)]))
        for suffix in (b"", b"|3|e42", b"|11|s42"):
            assert md5.first_words(rows, n, suffix).tolist() == [int(hashlib.md5(x + suffix).hexdigest()[:8], 16) for x in texts + more]


@pytest.mark.parametrize(("text", "n", "clean"), [("my [[Secret]] plan #tag", 3, "[ANON] plan"), ("мои заметки", 1, "[ANON] заметки"), ("army mineral", 0, "army mineral")])
def test_sanitise(spark, text, n, clean):
    r = one(spark, un.sanitise(F.lit(text)))
    assert (r["n_blocked"], r["clean"]) == (n, clean)


def test_commands(spark):
    t = F.lit("/scope:a,b find /unknown:x this /web /no-web")
    assert [(c["name"], c["args"]) for c in one(spark, un.commands(t))] == [("scope", ["a", "b"]), ("web", []), ("no-web", [])]
    f = one(spark, un.flags(un.commands(t)))
    assert (f["force_web"], f["no_web"], f["vault_scope"]) == (False, True, ["a", "b"])
    assert one(spark, un.without_commands(t)) == "find /unknown:x this"


def test_kappa(spark):
    r = lambda rows: un.kappa(spark.createDataFrame(rows, "a int, b int")).first()
    assert r([(1, 1), (0, 0)])["kappa"] == 1.0 and r([(1, 1), (1, 1)])["kappa"] == 1.0 and r([])["kappa"] == 0.0
    assert r([(1, 0), (0, 1)])["label"] == "worse_than_chance"


def test_sources(spark, tmp_path):
    v = tmp_path / "vault" / "Sub dir"
    v.mkdir(parents=True)
    (v / "n é.md").write_text("# hi", encoding="utf-8")
    (v / "x.txt").write_text("no")
    got = fl.scan_notes(spark, str(tmp_path / "vault"), "v").collect()
    assert [(r["rel_path"], r["content"]) for r in got] == [("Sub dir/n é.md", "# hi")]
    g = tmp_path / "gold"
    g.mkdir()
    (g / "q-001.yaml").write_text("id: q1\ncategory: lookup\nquery: x\ngold_sources: [{type: note, rel_path: a.md}]\nmin_hops: 2")
    (g / "q-002.yaml").write_text("id: q2\ncategory: fresh\nquery: y")
    (g / "q-003.yaml").write_text("{broken")
    assert [r["id"] for r in fl.read_gold(spark, str(g)).collect()] == ["q1", "q2"]
    assert [r["id"] for r in fl.read_gold(spark, str(g), "fresh").collect()] == ["q2"]
    (g / "privacy_cases.yaml").write_text("cases:\n - {id: p1, query: z, expected_outbound_clean: true}")
    assert fl.read_privacy_cases(spark, str(g)).first()["id"] == "p1"
    (tmp_path / "e.txt").write_text("# list\n\n Acme \n")
    assert [r["entity"] for r in fl.read_entities(spark, str(tmp_path / "e.txt")).collect()] == ["Acme"]
    (tmp_path / "c.json").write_text('{\n"human": [1, 0],\n"judge": [1, 1]}')
    assert [(r["a"], r["b"]) for r in fl.read_calibration(spark, str(tmp_path / "c.json")).collect()] == [(1, 1), (0, 1)]
    b = tmp_path / "books" / "abc" / "chapters"
    b.mkdir(parents=True)
    (b.parent / "metadata.json").write_text('{"source_id": "abc", "title": "T", "removed": false}')
    (b / "01-a.md").write_text("text")
    assert [(r["title"], r["slug"]) for r in fl.scan_books(spark, str(tmp_path / "books")).collect()] == [("T", "01-a")]


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([], fl.PREDICTIONS)
    fl.write_predictions(p, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["head", "rel", "tail", "score", "run_id"]
    ch = spark.createDataFrame([("b", "s", "abc 1")], "book string, slug string, content string")
    fl.append_quality(ch, str(tmp_path / "q"))
    fl.append_quality(ch, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 2
    pages = spark.createDataFrame([("u1", "t", "same", "2024-01-02"), ("u0", "t", "same", "2024-01-01")], "url string, title string, content string, fetched_at string")
    fl.save_pages(pages, str(tmp_path / "s"))
    saved = fl.pages_at(spark, str(tmp_path / "s")).read().collect()
    assert len(saved) == 1 and saved[0]["document"].startswith("---\nurl: u0\n")
    books = spark.createDataFrame([("a", "old", "1"), ("a", "new", "2")], "source_id string, title string, parsed_at string")
    fl.write_books(books, str(tmp_path / "b"))
    fl.write_books(spark.createDataFrame([("b", "other", "1"), ("a", "older", "0")], books.schema), str(tmp_path / "b"))
    assert sorted((r["source_id"], r["title"]) for r in fl.books_at(spark, str(tmp_path / "b")).read().collect()) == [("a", "new"), ("b", "other")]


def test_similar_pairs_exact_and_hashed(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, f"v{i % 2}", [float(x) for x in base[i]]) for i in range(60)] + [(100 + i, f"v{i % 2}", [float(x) for x in base[i] + 0.05 * rng.normal(size=16)]) for i in range(60)] + [(999, "v0", [0.0] * 16)]
    d = spark.createDataFrame(rows, "id long, vault string, vec array<double>")
    exact = {(r["a"], r["b"]) for r in similar.similar_pairs(d).collect()}
    hashed = {(r["a"], r["b"]) for r in similar.similar_pairs_lsh(d).collect()}
    assert {(i, 100 + i) for i in range(60)} <= exact
    assert hashed <= exact and len(hashed) >= 0.9 * len(exact)


@pytest.mark.parametrize("threshold", [0.3, -1.0])
def test_similar_pairs_meet_each_block_once(spark, monkeypatch, threshold):
    """Blocks and strips of all sizes against all pairs: copies that tie, ids as text, vectors that are null or zero."""
    monkeypatch.setattr(similar, "BLOCK", 40)
    monkeypatch.setattr(similar, "STRIP", 16)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(50, 8))
    vecs = {f"n{i:03d}": base[i % 50] for i in range(220)} | {"zero": np.zeros(8)}
    rows = [(i, "a" if no % 5 else "b", [float(x) for x in v]) for no, (i, v) in enumerate(vecs.items())]
    d = spark.createDataFrame([*rows, ("null", "a", None)], "id string, vault string, vec array<double>")
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, _, v in rows}
    want = set()
    for i, vault, _ in rows:
        near = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j, other, _ in rows if other == vault and j != i)
        want |= {(min(i, j), max(i, j)) for s, j in near[:5] if -s >= threshold}
    got = [(r["a"], r["b"]) for r in similar.similar_pairs(d, threshold, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_best_keeps_ties_by_key():
    import numpy as np

    from semlake.operators.retrieval import Best

    rng = np.random.default_rng(1)
    scores, keys = rng.integers(0, 6, (400, 3)).astype(float), rng.permutation(400)
    best = Best(np.array([10, 11, 12]), 7)
    for at in range(0, 400, 13):
        best.add(scores[at : at + 13], keys[at : at + 13], scores[at : at + 13] > 0)
    got = [tuple(r) for part in best.rows("key") for r in part[["query_id", "key", "score"]].itertuples(index=False)]
    want = [(10 + q, k, -s) for q in range(3) for s, k in sorted((-scores[i, q], keys[i]) for i in range(400) if scores[i, q] > 0)[:7]]
    assert got == want


def test_web_trigger_signals_and_overrides(spark):
    from pyspark.sql import functions as F

    from semlake.operators import similar

    base = dict(intent="lookup", force=False, no_web=False, n_parents=5, top=0.9, words=900, n_entities=0, n_paths=0)
    cases = [({}, False), ({"intent": "fresh"}, True), ({"intent": "explore", "n_parents": 2}, True), ({"n_parents": 0}, True), ({"top": 0.3}, True), ({"words": 100}, True), ({"n_entities": 1}, True), ({"intent": "fresh", "no_web": True}, False), ({"force": True}, True)]
    rows = [(i, *(base | over).values()) for i, (over, _) in enumerate(cases)]
    d = spark.createDataFrame(rows, "i int, intent string, force boolean, no_web boolean, n_parents int, top double, words int, n_entities int, n_paths int")
    got = {r["i"]: r["web"] for r in d.select("i", similar.wants_web(*map(F.col, base)).alias("web")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_listed_names_are_found_as_by_plain_search():
    """Short and long names, such that hold others, letters whose lower case is longer, and astral ones; hashes of the
    whole list take few bytes for a name."""
    import random

    import pyarrow as pa

    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abAB İß𝔸[]") for _ in range(n))
    names = sorted({word(draw.choice((1, 2, 3, 4, 5, 8, 9, 17, 40, 70))) for _ in range(300)} | {"Ab", "aB"})
    listed = un._Listed(pa.array(names))
    texts = ["", "a", "x" + max(names, key=len), *(word(draw.randrange(30)) + draw.choice(names).swapcase() + word(draw.randrange(30)) for _ in range(200))]
    want = [{i for i, e in enumerate(names) if e.lower() in t.lower()} for t in texts]
    assert listed.found(texts) == want and any(len(names[i]) > 64 for x in want for i in x)
    assert un._Listed(pa.array([], pa.string())).found(["a"]) == [set()]
    many = un._Listed(pa.array([f"Customer#{i:09d}" for i in range(100_000)]))
    held = many.names.nbytes + many.full.nbytes + many.order.nbytes + sum(x.nbytes for h in many.heads.values() for x in h)
    assert many.found(["of CUSTOMER#000012345 x"]) == [{12345}] and held < 60 * 100_000
