"""Maps of words are merged: only the rules are sent to every task."""

from semlake.operators import lemmas as lm


def test_word_maps_are_not_broadcast(spark):
    post = spark.range(3000).selectExpr("id as chunk_id", "concat('w', id % 2000, 'ings') as term", "1L as tf")
    known = spark.createDataFrame([("w1ings", "one")], "word string, lemma string")
    endings = spark.createDataFrame([("ings", ""), ("s", "")], "ending string, put string")
    out = lm.lemmatised(post, known, endings)
    got = {(r["chunk_id"], r["term"]) for r in out.collect()}
    assert len(got) == 3000 and (1, "one") in got and (2, "w2") in got
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("BroadcastHashJoin") == 1
