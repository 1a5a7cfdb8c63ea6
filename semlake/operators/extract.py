"""Candidate triples: parsing, gates, routing; linking of surface forms; enrichment."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semlake.functions import text as tx
from semlake.operators.quads import LABEL, PKM
from semlake.sources.keyed import KeyedTable
from semlake.sources.scratch import bounded_batches

#: Confidence floors by predicate and claim type; others get 0.85.
PREDICATE_FLOORS = {"mentions": 0.80, "defines": 0.85, "explains": 0.85, "cites": 0.85, "exemplifies": 0.85, "contradicts": 0.85, "precedes": 0.85, "causes": 0.85, "dependsOn": 0.85, "authoredBy": 0.90, "related": 0.85, "broader": 0.90, "narrower": 0.90}
CLAIM_FLOORS = {"factual_specific": 0.85, "factual_general": 0.80, "framing": 0.70, "opinion": 0.95}
OTHER_FLOOR, NEW_BUMP, HARD_REJECT = 0.85, 0.05, 0.60
#: The grey zone of similar objects, and what each further source adds to a confidence.
GREY_LOW, REUSE = 0.75, 0.92
BOOST = 0.10
#: Who routed a triple, what extracted it, and names of properties of external entities.
PROVENANCE, EXTRACTOR = "auto", "openie:v3"
ENTITY, PROPERTY = "http://www.wikidata.org/entity/", "http://www.wikidata.org/prop/direct/"
DESCRIPTION, ALT_LABEL = "http://schema.org/description", "http://www.w3.org/2004/02/skos/core#altLabel"
#: Labels too vague to be an entity.
STOP_LABELS = ["thing", "something", "someone", "anything", "anyone", "entity", "object", "concept", "item", "instance", "example", "one of", "some of"]
#: Words of a description that speak for a type.
TYPE_WORDS = {
    "Person": ["human", "person", "author", "writer", "scientist", "philosopher", "engineer"],
    "Software": ["software", "programming", "application", "tool", "framework", "library"],
    "Book": ["book", "novel", "publication", "written", "work", "literature"],
    "Organization": ["organization", "company", "institute", "foundation", "association"],
    "Event": ["event", "conference", "meeting", "summit", "occurrence"],
}


def _floor(table: dict[str, float], key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(m, key), F.lit(OTHER_FLOOR))


def parse(raw: DataFrame) -> DataFrame:
    """``raw(chunk_id, raw_json)`` -> candidates: blanks dropped, confidence within [0, 1], claim type defaulted."""
    kind = "struct<triples:array<struct<subject:string,predicate:string,object:string,confidence:double,claim_type:string>>>"
    t = raw.select("chunk_id", F.explode(F.from_json("raw_json", kind)["triples"]).alias("t")).select("chunk_id", "t.*")
    full = (F.trim(F.coalesce("subject", F.lit(""))) != "") & (F.trim(F.coalesce("predicate", F.lit(""))) != "") & (F.trim(F.coalesce("object", F.lit(""))) != "")
    claim = F.when(F.col("claim_type").isin(list(CLAIM_FLOORS)), F.col("claim_type")).otherwise("factual_general")
    return t.filter(full).withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))), "claim_type": claim})


def typed_links(texts: list[str]) -> list[str]:
    """The default extractor: lines ``predicate:: [[object]]`` of a note say something of the note, with confidence 0.9
    where the predicate is one of those with a floor, else 0.7."""
    found = [re.findall(r"(?m)^([A-Za-z]+)::[ \t]*\[\[([^\]|#]+)", t or "") for t in texts]
    return [json.dumps({"triples": [{"subject": "this", "predicate": p, "object": o.strip(), "confidence": 0.9 if p in PREDICATE_FLOORS else 0.7} for p, o in f]}) for f in found]


def extracted(chunks: DataFrame, extractor: Callable[[list[str]], list[str | None]] = typed_links, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Candidates that an extractor finds in ``chunks(key, text)``.

    The extractor is a port: a function from a batch of texts to a JSON text for each, ``{"triples": [...]}``, or None.
    A model stands behind it where there is one.  What is no such JSON gives no candidates.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = extractor(pdf["text"].tolist())
            if len(said) != len(pdf):
                raise ValueError(f"the extractor gave {len(said)} answers to {len(pdf)} texts")
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "raw_json": pd.Series(said, dtype="object", index=pdf.index)})

    bounded_batches(chunks.sparkSession)
    asked = chunks.select(F.col(key).cast("string").alias("chunk_id"), F.coalesce(text, F.lit("")).alias("text"))
    return parse(asked.mapInPandas(run, "chunk_id string, raw_json string"))


def threshold() -> Column:
    base = F.greatest(_floor(PREDICATE_FLOORS, F.col("predicate")), _floor(CLAIM_FLOORS, F.col("claim_type")))
    return F.when(F.col("is_new"), F.least(base + NEW_BUMP, F.lit(1.0))).otherwise(base)


def evidence(quads: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with ``n_sources`` (distinct chunks of the triple), ``duplicate`` and ``conflict`` against known quads."""
    spo = ["subject_uri", "predicate", "object"]
    n = candidates.groupBy(*spo).agg(F.countDistinct("chunk_id").alias("n_sources"))
    facts = quads.select(F.col("s").alias("subject_uri"), F.col("p").alias("predicate"), F.col("o").alias("object")).filter(" and ".join(f"{c} is not null" for c in spo)).distinct()
    same = facts.withColumn("duplicate", F.lit(True))
    # how many objects are known tells whether one differs from a candidate's; all are looked up in hash tables of
    # partitions, and both lookups share the exchange of the facts
    known = facts.groupBy("subject_uri", "predicate").agg(F.count("object").alias("objects"))
    out = candidates.join(n.hint("shuffle_hash"), spo).join(same.hint("shuffle_hash"), spo, "left").join(known.hint("shuffle_hash"), spo[:2], "left")
    duplicate = F.coalesce("duplicate", F.lit(False))
    return out.withColumns({"duplicate": duplicate, "conflict": F.coalesce(F.col("objects") > duplicate.cast("int"), F.lit(False))}).drop("objects")


def evidence_in_one(quads: DataFrame, candidates: DataFrame) -> DataFrame:
    """As ``evidence``, by one exchange: candidates and facts of a subject and predicate meet in one task, which sorts
    them.  ``evidence`` moves each candidate four times, but AQE can split a hot pair there."""
    spo = ["subject_uri", "predicate", "object"]
    facts = quads.select(F.col("s").alias("subject_uri"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.lit(True).alias("_fact"))
    rows = candidates.withColumn("_fact", F.lit(False)).unionByName(facts, allowMissingColumns=True)
    rows = rows.filter(" and ".join(f"{c} is not null" for c in spo)).repartition(*spo[:2])
    triple, pair = Window.partitionBy(*spo), Window.partitionBy(*spo[:2])
    known = F.when(F.col("_fact"), F.col("object"))
    rows = rows.withColumn("_no", F.dense_rank().over(triple.orderBy("chunk_id")))  # nulls, which count as no source, are first
    rows = rows.withColumns({"_chunks": F.max("_no").over(triple), "_none": F.max(F.col("chunk_id").isNull().cast("int")).over(triple), "duplicate": F.max("_fact").over(triple)})
    rows = rows.withColumns({"_low": F.min(known).over(pair), "_high": F.max(known).over(pair)}).filter(~F.col("_fact"))
    # another object is known if the smallest or the largest known one is another
    conflict = F.coalesce((F.col("_low") != F.col("object")) | (F.col("_high") != F.col("object")), F.lit(False))
    return rows.select(*candidates.columns, (F.col("_chunks") - F.col("_none")).cast("long").alias("n_sources"), "duplicate", conflict.alias("conflict"))


def gates(candidates: DataFrame, allowed: list[str]) -> DataFrame:
    """Flags ``g1, g2, g3, g5`` (passed), ``g5_reason`` and the boosted ``final_confidence`` of candidates that have
    ``is_new, object_similarity, n_sources, duplicate, conflict``."""
    conf = F.col("confidence")
    subject, obj = tx.label_of(F.col("subject_uri")), tx.label_of(F.col("object"))
    reason = (
        F.when(F.col("subject_uri") == F.col("object"), "self_loop")
        .when(subject.isin(STOP_LABELS) | obj.isin(STOP_LABELS), "stop_word")
        .when((F.col("predicate") == "type") & (F.col("object") == "Note"), "tautology")
        .when(F.col("duplicate"), "exact_duplicate")
    )
    grey = (F.col("object_similarity") >= GREY_LOW) & (F.col("object_similarity") < REUSE)
    return candidates.withColumns(
        {
            "g1": conf >= threshold(),
            "g2": F.col("predicate").isin(allowed),
            "g3": ~grey,
            "g5": reason.isNull(),
            "g5_reason": reason,
            "final_confidence": F.least(conf + BOOST * (F.col("n_sources") - 1), F.lit(1.0)),
        }
    )


def route(gated: DataFrame) -> DataFrame:
    """``destination`` and ``reason`` by the first rule that holds."""
    rules = [
        (~F.col("g2"), "tier1-rejected", "gate2"),
        (~F.col("g5"), "tier1-rejected", "gate5"),
        (F.col("confidence") < HARD_REJECT, "tier1-rejected", "hard_floor"),
        (~F.col("g3"), "tier1-pending", "gate3_grey_zone"),
        (~F.col("g1"), "tier1-pending", "gate1_soft_fail"),
        (F.col("conflict"), "tier1-pending", "conflict"),
    ]
    dest, why = F.lit(None).cast("string"), F.lit(None).cast("string")
    for cond, d, r in reversed(rules):
        dest, why = F.when(cond, d).otherwise(F.coalesce(dest, F.lit("tier1"))), F.when(cond, r).otherwise(F.coalesce(why, F.lit("all_gates_passed")))
    return gated.withColumns({"destination": dest, "reason": why})


def nearest_label(queries: DataFrame, labelled: DataFrame, threshold_: float = GREY_LOW) -> DataFrame:
    """``queries(query_id, vec)``, ``labelled(uri, vec)`` -> ``(query_id, uri, similarity)``; uri null under the threshold."""
    from semlake.operators.retrieval import dense_top_k

    best = dense_top_k(labelled, queries, 1, key="uri")
    return best.select("query_id", F.when(F.col("score") >= threshold_, F.col("uri")).alias("uri"), F.col("score").alias("similarity"))


def new_entities(candidates: DataFrame, threshold_: float = GREY_LOW) -> DataFrame:
    """New-entity flags from canonicalisation: no label is near enough to the subject, to the object, to either."""
    flagged = candidates.withColumns({"new_subject": F.col("subject_similarity") < threshold_, "new_object": F.col("object_similarity") < threshold_})
    return flagged.withColumn("is_new", F.col("new_subject") | F.col("new_object"))


def string_match(pairs: DataFrame) -> DataFrame:
    """``pairs(surface, label, ...)`` with ``sm``: 1 on equality, else the Ratcliff-Obershelp ratio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for pdf in batches:
            low = [(a.lower().strip(), b.lower().strip()) for a, b in zip(pdf["surface"], pdf["label"])]
            pdf["sm"] = [1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in low]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, schema + ", sm double")


def type_match(hint: Column, description: Column) -> Column:
    low, out = F.lower(description), F.lit(0.5)
    for name, words in TYPE_WORDS.items():
        any_ = low.contains(words[0])
        for w in words[1:]:
            any_ = any_ | low.contains(w)
        out = F.when(hint == name, F.when(any_, 1.0).otherwise(0.2)).otherwise(out)
    return out


def context_overlap(chunks: Column, description: Column) -> Column:
    d = F.array_distinct(tx.tokens(description))
    c = F.array_distinct(tx.tokens(F.array_join(F.slice(chunks, 1, 3), " ")))
    known = (F.size(d) > 0) & (F.size(c) > 0)
    return F.when(known, F.least(F.lit(1.0), F.size(F.array_intersect(d, c)) / F.size(d))).otherwise(0.5)


def disambiguate(hits: DataFrame) -> DataFrame:
    """``hits(surface, qid, label, type_hint, description, chunks)`` -> the best hit of each surface form and its zone."""
    scored = string_match(hits).withColumn("score", F.round(0.6 * F.col("sm") + 0.25 * type_match(F.col("type_hint"), F.col("description")) + 0.15 * context_overlap(F.col("chunks"), F.col("description")), 6))
    w = Window.partitionBy("surface").orderBy(F.col("score").desc(), "qid")
    best = scored.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return best.select("surface", "qid", "score", F.when(F.col("score") >= 0.7, "auto").when(F.col("score") >= 0.5, "grey").otherwise("skip").alias("zone"))


def property_maps(bindings: DataFrame, profile: DataFrame) -> DataFrame:
    """``bindings(qid, p, o)`` restricted to ``profile(p)`` -> ``(qid, properties map<p, array<o>>)``."""
    kept = bindings.join(F.broadcast(profile), "p", "left_semi")  # a profile is a short list
    lists = kept.groupBy("qid", "p").agg(F.sort_array(F.collect_set("o")).alias("os"))
    return lists.groupBy("qid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "os")))).alias("properties"))


def evidence_rows(routed: DataFrame, doc: str = "doc_uri") -> DataFrame:
    """Routed triples that aren't rejected -> ``(s, p, o, o_is_iri, graph, evidence)``, a row for each distinct evidence.

    ``routed`` has the columns of ``route`` and ``doc``; ``o_is_iri`` is taken as true where it has no such column.
    """
    return _evidence_rows(routed, doc).distinct()


def _evidence_rows(routed: DataFrame, doc: str) -> DataFrame:
    iri = F.col("o_is_iri") if "o_is_iri" in routed.columns else F.lit(True)
    evidence = F.struct(
        F.lit(PROVENANCE).alias("provenance"),
        F.format_string("%.4f", F.col("final_confidence").cast("double")).alias("confidence"),
        F.lit(EXTRACTOR).alias("source"),
        F.col("chunk_id").alias("chunk"),
        F.col(doc).alias("doc"),
        F.col("conflict"),
    )
    kept = routed.filter(F.col("destination") != "tier1-rejected")
    return kept.select(F.col("subject_uri").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), iri.alias("o_is_iri"), F.col("destination").alias("graph"), evidence.alias("evidence"))


def triples_at(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "statement", guard="statement")


def write_routed(routed: DataFrame, path: str, doc: str = "doc_uri", epoch: int | None = None) -> int:
    """Evidence rows appended to the table at ``path`` -> how many it lacked.

    A statement with one evidence is one row however often it is written, so a batch that is played again adds nothing.
    """
    rows = _evidence_rows(routed, doc)  # the merge leaves one row of a statement
    key = F.unhex(F.sha2(F.to_json(F.struct("s", "p", "o", "graph", "evidence")), 256))
    return triples_at(routed.sparkSession, path).merge(rows.withColumn("statement", key), epoch, scattered=True)


def pending_evidence(routed: DataFrame, typed: DataFrame, doc: str = "doc_uri") -> DataFrame:
    """Routed triples of ``tier1-pending`` whose subject is none of ``typed(s)``, with ``conf, chunk, doc, conflict``: what
    ``quads.pending`` finds in their ``annotations``, a row for each combination, from the evidence as it comes.

    One exchange by subject does for the lookup of types and for the statements.
    """
    rows = _evidence_rows(routed, doc).filter(F.col("graph") == "tier1-pending")
    here = rows.join(typed.select("s").distinct().withColumn("_typed", F.lit(True)).hint("shuffle_hash"), "s", "left").filter("_typed is null")
    e = F.col("evidence")
    sets = [F.collect_set(e[name]).alias(column) for column, name in (("conf", "confidence"), ("chunk", "chunk"), ("doc", "doc"))]
    out = here.groupBy("s", "p", "o").agg(*sets, F.max(F.when(e["conflict"], "true")).alias("conflict"))
    for column in ("conf", "chunk", "doc"):
        out = out.withColumn(column, F.explode_outer(column))
    return out


def annotations(rows: DataFrame) -> DataFrame:
    """Evidence rows as statements about statements: ``(s, p, o, graph, about, value)``; a flag that is false says nothing."""
    e = F.col("evidence")
    said = {"provenance": e["provenance"], "confidence": e["confidence"], "source": e["source"], "evidenceChunk": e["chunk"], "evidenceDoc": e["doc"], "conflictFlag": F.when(e["conflict"], "true")}
    # a part for each name: who asks for one name reads that part only
    parts = [rows.select("s", "p", "o", "graph", F.lit(PKM + name).alias("about"), value.alias("value")) for name, value in said.items()]
    return reduce(DataFrame.unionByName, parts).filter("value is not null").distinct()


def entity_records(bindings: DataFrame) -> DataFrame:
    """``bindings(qid, p, o, lang)`` of external entities -> ``(qid, labels, descriptions, aliases, instance_of,
    subclass_of)``: maps by language (aliases to arrays) and sorted distinct arrays.

    ``p`` is a property's id or URI.  Texts without a language and empty values are left out; of several labels or
    descriptions in one language the largest stays.  An entity without known properties has no row.
    """
    p = F.substring_index(F.substring_index("p", "/", -1), "#", -1)
    kind = F.when(p.isin("P31", "P279", "description", "altLabel"), p).when(F.lower(p) == "label", "label")
    lang = F.when(kind.isin("P31", "P279"), "").otherwise(F.nullif("lang", F.lit("")))
    value = F.when(kind.isin("P31", "P279"), F.nullif(F.regexp_extract("o", r"(Q\d+)$", 1), F.lit(""))).otherwise(F.nullif("o", F.lit("")))
    known = bindings.select("qid", kind.alias("kind"), lang.alias("lang"), value.alias("o")).dropna(subset=["qid", "kind", "lang", "o"])
    lists = known.groupBy("qid", "kind", "lang").agg(F.max("o").alias("one"), F.array_sort(F.collect_set("o")).alias("all"))
    of = lambda k, held: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("lang", held)))))
    ids = lambda k: F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("all"))))
    return lists.groupBy("qid").agg(of("label", "one").alias("labels"), of("description", "one").alias("descriptions"), of("altLabel", "all").alias("aliases"), ids("P31").alias("instance_of"), ids("P279").alias("subclass_of"))


def record_quads(records: DataFrame) -> DataFrame:
    """Entity records -> their own triples ``(s, p, o, o_is_iri, o_lang)``."""
    text = lambda field, p: F.transform(F.map_entries(field), lambda e: _fact(p, e["value"], False, e["key"]))
    alts = F.flatten(F.transform(F.map_entries("aliases"), lambda e: F.transform(e["value"], lambda a: _fact(ALT_LABEL, a, False, e["key"]))))
    ids = lambda field, p: F.transform(field, lambda q: _fact(PROPERTY + p, F.concat(F.lit(ENTITY), q), True))
    facts = F.concat(text("labels", LABEL), text("descriptions", DESCRIPTION), alts, ids("instance_of", "P31"), ids("subclass_of", "P279"))
    return records.select(F.concat(F.lit(ENTITY), "qid").alias("s"), F.explode(facts).alias("f")).select("s", "f.*")


def enrichment(records: DataFrame, maps: DataFrame) -> DataFrame:
    """Entity records and the property maps of some of them -> tier-2 triples with each entity's level and id.

    Entities that are values stay bare IRIs: ``to_enrich`` never finds them here.
    """
    held = records.join(maps, "qid", "left")
    level = F.when(F.size(F.coalesce("properties", F.create_map().cast("map<string,array<string>>"))) > 0, "L1+L2").otherwise("L1")
    tags = F.array(_fact(PKM + "enrichmentLevel", level, False), _fact(PKM + "wikidataQID", F.col("qid"), False))
    tagged = held.select(F.concat(F.lit(ENTITY), "qid").alias("s"), F.explode(tags).alias("f")).select("s", "f.*")
    first = record_quads(records).unionByName(tagged).withColumn("graph", F.lit("tier2"))
    second = maps.join(records.select("qid"), "qid", "left_semi").select("qid", F.explode("properties").alias("p", "os")).select("qid", "p", F.explode("os").alias("v"))
    qid = F.regexp_extract("v", r"^http.*/(Q\d+)$", 1)
    lang = F.when(qid == "", F.nullif(F.regexp_extract("v", r"@([a-z]{2,3})$", 1), F.lit("")))
    plain = F.when(qid != "", F.concat(F.lit(ENTITY), qid)).when(lang.isNotNull(), F.regexp_replace("v", r"@[a-z]{2,3}$", "")).otherwise(F.col("v"))
    second = second.select(F.concat(F.lit(ENTITY), "qid").alias("s"), F.concat(F.lit(PROPERTY), "p").alias("p"), plain.alias("o"), (qid != "").alias("o_is_iri"), lang.alias("o_lang"), F.lit("tier2").alias("graph"))
    return first.unionByName(second).distinct()


def _fact(p: str, o: Column, iri: bool, lang: Column | None = None) -> Column:
    return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(iri).alias("o_is_iri"), (lang if lang is not None else F.lit(None).cast("string")).alias("o_lang"))


def to_enrich(quads: DataFrame) -> DataFrame:
    """``(qid)`` of external entities named in tiers 0 and 1 that tier 2 doesn't hold yet.

    One hop only: entities that are values in tier 2 and nowhere else aren't found.
    """
    named = quads.filter(F.col("graph").isin("tier0", "tier1"))
    ends = named.select(F.col("s").alias("e")).unionByName(named.filter("o_is_iri").select(F.col("o").alias("e")))
    qid = F.regexp_extract("e", "^" + ENTITY.replace(".", r"\.") + r"(Q\d+)$", 1)
    done = quads.filter((F.col("graph") == "tier2") & (F.col("p") == PKM + "wikidataQID")).select(F.col("o").alias("qid"))
    return ends.select(qid.alias("qid")).filter("qid <> ''").distinct().join(done, "qid", "left_anti")


def enrichment_quads(maps: DataFrame) -> DataFrame:
    """Property maps -> tier-2 triples; ``value@lang`` becomes a literal with a language, entity values stay IRIs."""
    t = maps.select("qid", F.explode("properties").alias("p", "os")).select("qid", "p", F.explode("os").alias("v"))
    lang = F.regexp_extract("v", r"^(.*)@([a-z]{2})$", 2)
    iri = F.col("v").rlike(r"^(https?:|urn:)") & (lang == "")
    return t.select(F.concat(F.lit("urn:wd:"), "qid").alias("s"), "p", F.when(lang != "", F.regexp_extract("v", r"^(.*)@([a-z]{2})$", 1)).otherwise(F.col("v")).alias("o"), iri.alias("o_is_iri"), F.nullif(lang, F.lit("")).alias("o_lang"), F.lit("tier2").alias("graph"))
