"""Quads as a DataFrame ``(s, p, o, o_is_iri, graph)``: patterns, expansion, walks, emitters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semlake.functions import text as tx
from semlake.sources.scratch import stored

#: Namespaces and names of predicates.
PKM = "https://my-pkm.local/ontology#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
MODIFIED = "http://purl.org/dc/terms/modified"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: Weight of a predicate that the table of weights doesn't name.
DEFAULT_WEIGHT = 0.3
COLUMNS = ["s", "p", "o", "o_is_iri", "graph"]


def match(quads: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, graphs: list[str] | None = None) -> DataFrame:
    """A basic pattern; None matches anything."""
    for c, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            quads = quads.filter(F.col(c) == v)
    return quads.filter(F.col("graph").isin(graphs)) if graphs is not None else quads


def optional(rows: DataFrame, facts: DataFrame, on: list[str], wanted: dict[str, str], p: str = "p", value: str = "o") -> DataFrame:
    """Optional patterns: ``rows`` with a column for each name of ``wanted``, the value that ``facts`` hold for its
    predicate on the same ``on``, or null.  Several values give several rows, as in a graph query.

    All joins have the same keys, so ``rows`` are shuffled once; values are looked up in hash tables of partitions.
    """
    for name, predicate in wanted.items():
        found = facts.filter(F.col(p) == predicate).select(*on, F.col(value).alias(name)).distinct()
        rows = rows.join(found.hint("shuffle_hash"), on, "left")
    return rows


def pending(quads: DataFrame, facts: DataFrame) -> DataFrame:
    """Statements of ``tier1-pending`` whose subject has no type, with ``conf, chunk, doc, conflict`` where
    ``facts(s, p, o, graph, about, value)`` say so."""
    on = ["s", "p", "o", "graph"]
    typed = quads.filter(F.col("p") == RDF_TYPE).select("s").distinct()
    rows = quads.filter(F.col("graph") == "tier1-pending").select(*on).distinct().join(typed.hint("shuffle_hash"), "s", "left_anti")
    facts = facts.filter(F.col("graph") == "tier1-pending")
    wanted = {"conf": "confidence", "chunk": "evidenceChunk", "doc": "evidenceDoc", "conflict": "conflictFlag"}
    return optional(rows.select(*on), facts, on, {k: PKM + v for k, v in wanted.items()}, "about", "value").drop("graph")


def degrees(quads: DataFrame) -> DataFrame:
    """``(node, degree)`` over subjects and IRI objects."""
    ends = quads.select(F.col("s").alias("node")).unionByName(quads.filter("o_is_iri").select(F.col("o").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def hubs(quads: DataFrame, over: int = 50) -> DataFrame:
    return degrees(quads).filter(F.col("degree") > over)


def steps(quads: DataFrame, graphs: list[str]) -> DataFrame:
    """Both directions of the IRI edges of some graphs: ``(src, p, dst)``."""
    e = quads.filter(F.col("graph").isin(graphs) & F.col("o_is_iri"))
    return e.select(F.col("s").alias("src"), "p", F.col("o").alias("dst")).unionByName(e.select(F.col("o").alias("src"), "p", F.col("s").alias("dst"))).distinct()


def expand(quads: DataFrame, seeds: DataFrame, graphs: list[str], blocked: DataFrame | None = None) -> DataFrame:
    """One hop from ``seeds(node)`` in both directions, without blocked nodes: ``(seed, p, entity)``."""
    out = steps(quads, graphs).join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    if blocked is not None:
        out = out.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")
    return out.select(F.col("src").alias("seed"), "p", F.col("dst").alias("entity"))


def walk(quads: DataFrame, seeds: DataFrame, weights: DataFrame, hops: int, graphs: list[str], blocked: DataFrame | None = None) -> DataFrame:
    """Weighted walk: ``seeds(query_id, node)``, ``weights(p, weight)`` -> ``(query_id, node, hop, score, path, preds)``.

    A path's score is the product of its predicates' weights.  A node is taken at the hop that reaches it first, by its
    best path there (highest score, then smallest path), and not visited again; seeds may be reached like any other.
    """
    edges = steps(quads, graphs)
    if blocked is not None:
        edges = edges.join(blocked.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = edges.join(F.broadcast(weights), "p", "left").withColumn("weight", F.coalesce("weight", F.lit(DEFAULT_WEIGHT)))
    # stored: each hop reads the edges and the fronts once, and a join with a table as such lets AQE split hub nodes
    edges = stored(edges.select("src", "p", "dst", "weight"), "edges")
    front = seeds.select("query_id", "node", F.lit(1.0).alias("score"), F.array("node").alias("path"), F.array().cast("array<string>").alias("preds"))
    fronts: list[DataFrame] = []
    for hop in range(1, hops + 1):
        reached = front.join(edges, front["node"] == edges["src"]).select(
            "query_id", F.col("dst").alias("node"), F.round(F.col("score") * F.col("weight"), 9).alias("score"), F.concat("path", F.array("dst")).alias("path"), F.concat("preds", F.array("p")).alias("preds")
        )
        if fronts:
            reached = reached.join(reduce(DataFrame.unionByName, fronts).select("query_id", "node"), ["query_id", "node"], "left_anti")
        best = reached.groupBy("query_id", "node").agg(F.min(F.struct((-F.col("score")).alias("n"), "path", "preds")).alias("b"))
        here = best.select("query_id", "node", (-F.col("b.n")).alias("score"), F.col("b.path").alias("path"), F.col("b.preds").alias("preds"), F.lit(hop).alias("hop"))
        front = stored(here, "front")
        fronts.append(front)
    return reduce(DataFrame.unionByName, fronts)


def path_rank(walked: DataFrame, sims: DataFrame, alpha: float = 0.6, k: int = 20) -> DataFrame:
    """``alpha * path + (1 - alpha) * similarity``, top ``k`` of each query; nodes without a vector drop out."""
    out = walked.join(sims, ["query_id", "node"]).withColumn("final", F.round(alpha * F.col("score") + (1 - alpha) * F.col("sim"), 6))
    w = Window.partitionBy("query_id").orderBy(F.col("final").desc(), "node")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def insert(quads: DataFrame, new: DataFrame) -> DataFrame:
    return quads.select(*COLUMNS).unionByName(new.select(*COLUMNS)).dropDuplicates(["s", "p", "o", "graph"])


def move(quads: DataFrame, decisions: DataFrame, source: str) -> DataFrame:
    """Triples of graph ``source`` that ``decisions(s, p, o, target)`` name go to their target graph."""
    d = decisions.select(F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"), "target")
    out = quads.join(d, (F.col("graph") == source) & (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("o") == F.col("_o")), "left")
    return out.withColumn("graph", F.coalesce("target", "graph")).select(*COLUMNS)


def replace_note(quads: DataFrame, notes: DataFrame, new: DataFrame, part: str = PKM + "hasHeading") -> DataFrame:
    """Triples of ``notes(node)`` and of their headings give way to ``new``."""
    gone = notes.select("node").distinct()
    heads = quads.filter(F.col("p") == part).join(gone, F.col("s") == F.col("node"), "left_semi").select(F.col("o").alias("node")).distinct()
    kept = quads.join(gone.unionByName(heads), F.col("s") == F.col("node"), "left_anti")
    return kept.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def closure_labels(quads: DataFrame, p: str, limit: int = 20, label: str = LABEL) -> DataFrame:
    """The closure of ``closure_two`` with labels, ``(s, o, label)``: at most ``limit`` rows of each ``s``, first by
    ``o`` and label; an ancestor without one has a null label, with several a row for each.

    Each ancestor gives a row or more, so only the first ``limit`` ones of each ``s`` are looked up.
    """
    first = F.dense_rank().over(Window.partitionBy("s").orderBy("o"))
    near = _two_steps(quads, p).withColumn("r", first).filter(F.col("r") <= limit).select("s", "o").distinct()
    up = optional(near, quads.withColumnRenamed("s", "_s").select(F.col("_s").alias("o"), "p", F.col("o").alias("label")), ["o"], {"label": label}, value="label")
    w = Window.partitionBy("s").orderBy("o", F.col("label").asc_nulls_last())
    return up.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).select("s", "o", "label")


def _two_steps(quads: DataFrame, p: str) -> DataFrame:
    """Objects one and two steps away, a row for each way there."""
    e = stored(quads.filter(F.col("p") == p).select("s", "o").distinct(), "steps")  # read three times
    two = e.join(e.select(F.col("s").alias("o"), F.col("o").alias("o2")), "o").select("s", F.col("o2").alias("o"))
    return e.unionByName(two)


def closure_two(quads: DataFrame, p: str) -> DataFrame:
    """Objects one and two steps away along a predicate, ``(s, o)``, distinct."""
    return _two_steps(quads, p).distinct()


def alias_index(notes: DataFrame) -> DataFrame:
    """``(vault_id, key, uri)``: lower-case stem and path of every note; of equal keys the last path wins."""
    uri = tx.note_uri(F.col("vault_id"), F.col("rel_path"))
    stem = F.lower(F.regexp_extract("rel_path", r"([^/]+?)(\.md)?$", 1))
    keys = notes.select("vault_id", "rel_path", uri.alias("uri"), F.explode(F.array(stem, F.lower("rel_path"))).alias("key"))
    return keys.groupBy("vault_id", "key").agg(F.max_by("uri", "rel_path").alias("uri"))


def resolve_links(links: DataFrame, index: DataFrame) -> DataFrame:
    """``links(vault_id, source, target)`` -> with ``uri`` and ``is_stub``: the key as it is, else with ``.md``."""
    one = index.select("vault_id", F.col("key").alias("_k1"), F.col("uri").alias("_u1"))
    two = index.select("vault_id", F.col("key").alias("_k2"), F.col("uri").alias("_u2"))
    key = F.lower("target")
    out = links.withColumns({"_k1": key, "_k2": F.concat(key, F.lit(".md"))}).join(one, ["vault_id", "_k1"], "left").join(two, ["vault_id", "_k2"], "left")
    uri = F.coalesce("_u1", "_u2")
    return out.select(*links.columns, uri.alias("uri"), uri.isNull().alias("is_stub"))


def _row(s: Column, p: str, o: Column, iri: bool) -> Column:
    return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(iri).alias("o_is_iri"))


def headings(notes: DataFrame) -> DataFrame:
    """``(vault_id, rel_path, idx, level, text)``: headings in order, outside fenced code."""
    lines = notes.select("vault_id", "rel_path", F.posexplode(F.split("content", "\n")).alias("no", "line"))
    w = Window.partitionBy("vault_id", "rel_path").orderBy("no")
    fenced = F.sum(F.col("line").rlike(r"^\s*```").cast("int")).over(w) % 2 == 1
    out = lines.withColumn("fenced", fenced).filter(~F.col("fenced") & F.col("line").rlike(r"^#{1,6}\s+\S"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    text = F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))
    return out.select("vault_id", "rel_path", (F.row_number().over(w) - 1).alias("idx"), level.alias("level"), text.alias("text"))


def note_quads(notes: DataFrame) -> DataFrame:
    """``notes(vault_id, rel_path, content)`` -> tier-0 quads: types, vault, project, tags, links, headings, provenance."""
    uri, vault = tx.note_uri(F.col("vault_id"), F.col("rel_path")), F.concat(F.lit("urn:vault:"), "vault_id")
    seg = F.coalesce(F.nullif(tx.flat_front_matter(F.col("content"), "project"), F.lit("")), tx.para_segment(F.col("rel_path")))
    project = F.concat(F.lit("urn:project:"), "vault_id", F.lit(":"), tx.percent(seg, ".-_"))
    fixed = [
        _row(uri, RDF_TYPE, F.lit(PKM + "Note"), True),
        _row(uri, PKM + "inVault", vault, True),
        _row(vault, RDF_TYPE, F.lit(PKM + "Vault"), True),
        _row(uri, PKM + "contentHash", F.sha2("content", 256), False),
        _row(uri, PKM + "source", F.lit("tier0"), False),
        F.when(seg != "", _row(uri, PKM + "inProject", project, True)),
        F.when(seg != "", _row(project, RDF_TYPE, F.lit(PKM + "Project"), True)),
    ]
    base = notes.select(F.explode(F.array_compact(F.array(*fixed))).alias("q"))
    tags = F.array_distinct(F.concat(tx.front_matter_list(F.col("content"), "tags"), tx.hashtags(F.col("content"))))
    tag = tx.tag_uri(F.col("tag"))
    tagged = notes.select("vault_id", "rel_path", F.explode(tags).alias("tag")).select(F.explode(F.array(_row(uri, PKM + "tagged", tag, True), _row(tag, RDF_TYPE, F.lit(PKM + "Tag"), True))).alias("q"))
    raw = notes.select("vault_id", uri.alias("source"), F.explode(tx.wikilinks(F.col("content"))).alias("target"))
    linked = resolve_links(raw, alias_index(notes)).filter("not is_stub").select(_row(F.col("source"), PKM + "linksTo", F.col("uri"), True).alias("q"))
    h = tx.heading_uri(F.col("vault_id"), F.col("rel_path"), F.col("idx"))
    heads = headings(notes).select(
        F.explode(F.array(_row(uri, PKM + "hasHeading", h, True), _row(h, RDF_TYPE, F.lit(PKM + "Section"), True), _row(h, PKM + "level", F.col("level").cast("string"), False), _row(h, LABEL, F.col("text"), False))).alias("q")
    )
    out = base.unionByName(tagged).unionByName(linked).unionByName(heads)
    return out.select("q.*").distinct().withColumn("graph", F.lit("tier0"))


def book_quads(books: DataFrame) -> DataFrame:
    """``books(sha, title, authors array, slugs array)`` -> tier-0 quads: type, label, authors, chapters, source, and the
    time of ``modified_at`` where there is such a column.

    A book makes many quads that are nearly all different, so they are dealt out before equal ones are dropped: a task that
    reads many books would otherwise hold all their quads.  Names of persons repeat and are dropped where they are read.
    """
    b = F.concat(F.lit("urn:book:"), "sha")
    modified = F.col("modified_at") if "modified_at" in books.columns else F.lit(None).cast("string")
    fixed = F.array_compact(F.array(F.when(modified != "", _row(b, MODIFIED, F.concat(modified, F.lit("^^" + XSD + "dateTime")), False)), _row(b, RDF_TYPE, F.lit(PKM + "Book"), True), F.when(F.col("title") != "", _row(b, LABEL, F.col("title"), False)), _row(b, PKM + "source", F.lit("tier0"), False)))
    person = tx.person_uri(F.col("a"))
    people = books.select("sha", F.explode("authors").alias("a")).select(_row(b, PKM + "authoredBy", person, True).alias("q"))
    named = books.select(F.explode("authors").alias("a")).distinct().select(_row(person, LABEL, F.col("a"), False).alias("q"))
    ch = F.concat(F.lit("urn:chapter:"), "sha", F.lit(":"), F.col("i").cast("string"))
    chapters = books.select("sha", F.posexplode("slugs").alias("i", "slug")).select(
        F.explode(F.array_compact(F.array(_row(b, PKM + "hasChapter", ch, True), _row(ch, RDF_TYPE, F.lit(PKM + "Chapter"), True), F.when(F.col("slug") != "", _row(ch, LABEL, F.col("slug"), False))))).alias("q")
    )
    out = books.select(F.explode(fixed).alias("q")).unionByName(people).unionByName(named).unionByName(chapters).select("q.*")
    return out.repartition("s", "p", "o", "o_is_iri").distinct().withColumn("graph", F.lit("tier0"))
