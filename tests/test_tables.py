"""SQL table functions against their DataFrame twins, and the extractor port."""

import pytest
from pyspark.errors.exceptions.captured import PythonException
from pyspark.sql import functions as F

from semlake.functions import tables
from semlake.operators import chunks as ck
from semlake.operators import extract as ex

TEXTS = [
    (1, "intro\n# One\nalpha beta\n\n## Two  \ngamma\n#no heading\n### \n"),
    (2, ""),
    (3, " \n\t"),
    (4, "word " * 3000),
    (5, "# Only"),
    (6, "ünï-cödé, „quoted“ text… " * 200 + "\n## Ende\n.") ,
]


@pytest.fixture(scope="module")
def notes(spark):
    tables.register(spark)
    df = spark.createDataFrame([*TEXTS, (7, None)], "id int, content string")
    df.createOrReplaceTempView("table_function_notes")
    return df


def ask(spark, call, where=""):
    return sorted(map(tuple, spark.sql(f"SELECT id, w.* FROM table_function_notes, LATERAL {call} AS w {where}").collect()))


def test_sections(spark, notes):
    assert ask(spark, "md_sections(content)") == sorted(map(tuple, ck.sections(notes).drop("content").collect()))


def test_char_windows(spark, notes):
    for args, kw in (("", {}), (", 100, 60", {"size": 100, "step": 60}), (", step => 500", {"step": 500})):
        want = notes.select("id", F.posexplode(ck.windows(F.col("content"), **kw))).collect()
        assert ask(spark, f"char_windows(content{args})") == sorted(map(tuple, want))


@pytest.mark.parametrize("size,shared", [(512, 64), (7, 3), (5, 0)])
def test_token_windows(spark, notes, size, shared):
    got = ask(spark, f"token_windows(content, {size}, {shared})")
    assert got == sorted(map(tuple, ck.token_windows(notes.dropna(), size, shared).collect()))
    # windows without what they share make up the text
    for i, text in TEXTS:
        mine = [g for g in got if g[0] == i]
        ends = [g[4] for g in mine[1:]] + [len(text)]
        assert "".join(text[g[4] : e] for g, e in zip(mine, ends)) == text
        assert all(text[g[4] :].startswith(g[5]) for g in mine)


@pytest.mark.parametrize("call", ["md_sections(content)", "char_windows(content)", "token_windows(content)", "record_quads(content, map(content, content), map(), map(), array(content), array())"])
def test_no_python_and_no_join_in_the_plan(spark, notes, call):
    plan = spark.sql(f"SELECT id, w.* FROM table_function_notes, LATERAL {call} AS w")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "Python" not in plan


def test_record_quads(spark):
    tables.register(spark)
    b = spark.createDataFrame([("Q1", "label", "One", "en"), ("Q1", "altLabel", "I", "la"), ("Q1", "altLabel", "Unus", "la"), ("Q1", "P31", "x/Q5", ""), ("Q2", "P279", "x/Q5", "")], "qid string, p string, o string, lang string")
    records = ex.entity_records(b)
    got = spark.sql("SELECT w.* FROM {r} AS r, LATERAL record_quads(qid, labels, descriptions, aliases, instance_of, subclass_of) AS w", r=records)
    assert sorted(map(str, got.collect())) == sorted(map(str, ex.record_quads(records).collect()))
    assert got.count() == 5


def test_extractor_port(spark, notes):
    said = spark.createDataFrame([("a", "x\ncites:: [[B|b]]\nother:: [[C#h]]"), ("b", "cites [[B]]"), ("c", None)], "chunk_id string, content string")
    got = sorted(tuple(r) for r in ex.extracted(said).select("chunk_id", "subject", "predicate", "object", "confidence").collect())
    assert got == [("a", "this", "cites", "B", 0.9), ("a", "this", "other", "C", 0.7)]
    model = lambda texts: ['{"triples": [{"subject": "s", "predicate": "p", "object": "o", "confidence": 7}]}' if "x" in t else None if t else "{" for t in texts]
    assert [tuple(r) for r in ex.extracted(said, model).select("chunk_id", "confidence", "claim_type").collect()] == [("a", 1.0, "factual_general")]
    assert ex.extracted(said.limit(0)).count() == 0
    with pytest.raises(PythonException, match="answers"):
        ex.extracted(said, lambda texts: []).collect()
