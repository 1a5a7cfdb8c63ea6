import os
import random
import re

import corpus_pipeline
from semlake.llm import queries

SF = os.environ.get("SEMLAKE_SF_DIR", "/root/testdata/sf0.001")


def test_stages_and_registry():
    assert len(corpus_pipeline.STAGES) == 5
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries.QUERIES) == 1


def test_pipeline_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.select("doc_id", "probability").collect()
    assert 0 < len(rows) < docs.count()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert all(0 < r["probability"] <= 1 for r in rows)


def planted(path, spark):
    """Documents of every kind a stage must see, with nulls, repeats and a clashing extra column."""
    rng = random.Random(3)
    vocabulary = [a + b for a in "bdfgklmnprst" for b in ("alo", "emi", "iro", "ous", "uni")]
    prose = lambda n=60: " ".join(rng.choices(vocabulary, k=n))
    item = "the quick survey of nine rivers begins where the old mill meets the stone bridge and ends at the harbour"
    rows, kinds = [], {}

    def add(kind, text, doc_id=-1):
        doc_id = len(rows) if doc_id == -1 else doc_id
        rows.append((doc_id, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), len(text or ""), 0.5))
        kinds.setdefault(kind, []).append((doc_id, text))

    for _ in range(250):
        add("clean", prose())
    for _ in range(60):
        add("toxic", prose(30) + " zorgish vermun " + prose(10))
    copy = prose()
    for _ in range(5):
        add("copy", copy)
    for _ in range(4):
        add("leak", prose(15) + " " + item + " " + prose(15))
    add("private", prose() + " mail anna.smith@corp.example now")
    add("same id", prose(), 7000)
    add("same id", prose(), 7000)
    add("no id", prose(), None)
    add("empty", None)
    add("empty", "")
    add("long", prose(60_000))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    toxic = {i for i, _ in kinds["toxic"]}
    spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return kinds


def test_stages_on_planted_documents(spark, tmp_path):
    """Each stage drops what it must and keeps the rest, judged by plain rules; the last keeps by its probabilities."""
    path = str(tmp_path)
    kinds = planted(path, spark)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = ["doc_id", "lang", "n_chars", "source", "text"], sorted(((i, t) for v in kinds.values() for i, t in v), key=str)
    rules = {
        "toxicity": lambda rows: [r for r in rows if r not in kinds["toxic"]],
        "simhash near-dedup": lambda rows: [r for r in rows if r not in kinds["copy"][1:] and r != kinds["empty"][1]],
        "benchmark decontamination": lambda rows: [r for r in rows if r not in kinds["leak"]],
        "pii surrogates": lambda rows: [r for r in rows if r not in kinds["private"]],
    }
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, path), name.replace(" ", "-"))
        assert sorted(docs.columns) == columns
        left = rules[name](left)
        got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        if name == "pii surrogates":
            (private,) = kinds["private"]
            changed = [r for r in got if r[0] == private[0]]
            assert len(changed) == 1 and "anna.smith" not in changed[0][1] and re.sub(r"\S+@\S+", "", changed[0][1]) == re.sub(r"\S+@\S+", "", private[1])
            got = [r for r in got if r[0] != private[0]]
        assert got == left, name
    out = corpus_pipeline.STAGES[4][1](spark, docs, path)
    rows = out.collect()
    assert 0 < len(rows) <= docs.count() and all(0 < r["probability"] <= 1 for r in rows)


def test_stages_on_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    planted(path, spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{path}/documents.parquet").limit(0), path).count() == 0, name
