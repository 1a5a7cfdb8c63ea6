"""Keyed tables: merges, replays, broken writes, old rows, and the ledger of keys."""

import uuid

import pytest
from pyspark.sql import functions as F

from semlake.sources.keyed import Conflict, KeyedTable, Ledger

ROW = "k string, v string, at int"


def rows(spark, *of):
    return spark.createDataFrame(list(of), ROW)


def held(table):
    return sorted((r["k"], r["v"], r["at"]) for r in table.read().collect())


def test_merges_keep_other_keys_and_rewrite_touched_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", guard="v", buckets=8)
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.merge(rows(spark, *[(f"k{i}", "a", 1) for i in range(40)])) == 40
    first = t.commits.latest()
    assert t.merge(rows(spark, ("k3", "b", 2), ("k4", "a", 9), ("new", "a", 1), ("new", "c", 0))) == 2
    second = t.commits.latest()
    changed = {b for b in second.buckets if second.buckets[b] != first.buckets.get(b)}
    assert 1 <= len(changed) <= 2
    got = {k: (v, at) for k, v, at in held(t)}
    assert len(got) == 41 and got["k3"] == ("b", 2) and got["k4"] == ("a", 1) and got["new"] == ("c", 0)
    # nothing changes: no version
    assert t.merge(rows(spark, ("k3", "b", 5))) == 0 and t.commits.latest().version == second.version


def test_old_rows_never_replace_newer_ones(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", newer="at", buckets=2)
    t.merge(rows(spark, ("a", "x", 5), ("b", "x", 5), ("a", "w", 4)))
    assert t.merge(rows(spark, ("a", "old", 3), ("b", "new", 6), ("b", "mid", 5))) == 1
    assert held(t) == [("a", "x", 5), ("b", "new", 6)]


def test_replays_and_broken_writes_change_nothing(spark, tmp_path, monkeypatch):
    t = KeyedTable(spark, str(tmp_path), "k", buckets=2)
    assert t.merge(rows(spark, ("a", "1", 0)), epoch=0, writer="w") == 1
    assert t.merge(rows(spark, ("a", "2", 0)), epoch=0, writer="w") == 0 and held(t) == [("a", "1", 0)]
    monkeypatch.setattr(t.commits, "add", lambda c: (_ for _ in ()).throw(OSError("the driver dies here")))
    with pytest.raises(OSError, match="dies"):
        t.merge(rows(spark, ("a", "3", 0), ("b", "3", 0)), epoch=1, writer="w")
    monkeypatch.undo()
    assert held(t) == [("a", "1", 0)]
    assert t.merge(rows(spark, ("a", "3", 0), ("b", "3", 0)), epoch=1, writer="w") == 2 and held(t) == [("a", "3", 0), ("b", "3", 0)]
    # two writers from one version: the second is told
    other = KeyedTable(spark, str(tmp_path), "k", buckets=2)
    stale = other.commits.latest()
    t.merge(rows(spark, ("c", "4", 0)))
    monkeypatch.setattr(other.commits, "latest", lambda: stale)
    with pytest.raises(Conflict):
        other.merge(rows(spark, ("d", "5", 0)))


def test_null_keys_new_columns_and_empty_writes(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "k", buckets=2)
    t.merge(rows(spark))
    assert t.read().count() == 0
    t.merge(rows(spark, ("a", "1", 0)))
    t.merge(spark.createDataFrame([("b", "2", 0, 7)], ROW + ", more int"))
    assert sorted((r["k"], r["more"]) for r in t.read().collect()) == [("a", None), ("b", 7)]
    with pytest.raises(Exception, match="without a key"):
        t.merge(rows(spark, (None, "1", 0)))


def test_ledger_against_a_set(spark, tmp_path):
    import random

    rng, seen = random.Random(2), set()
    ledger = Ledger(spark, str(tmp_path), buckets=4)
    for epoch in range(4):
        keys = [f"key{rng.randrange(300)}" for _ in range(120)]
        got = [r["key"] for r in ledger.add(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n int"), epoch).collect()]
        assert sorted(got) == sorted(set(keys) - seen)
        seen |= set(keys)
    assert {r["key"] for r in ledger.table.read().collect()} == seen
    # the filters take every seen key for seen, and hardly any other
    asked = spark.range(3000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    maybe = {r["key"] for r in ledger.maybe_seen(asked).collect()}
    assert seen <= maybe and len(maybe - seen) < 10


def test_a_table_whose_key_is_its_guard_only_adds(spark, tmp_path):
    """Keys that are there are left out by key alone, whatever else a row holds; no stored row is replaced."""
    table = KeyedTable(spark, str(tmp_path), "k", guard="k", buckets=2)
    rows = lambda *r: spark.createDataFrame(r, "k string, v long")
    assert table.merge(rows(("a", 1), ("b", 2), ("b", 3))) == 2
    assert table.merge(rows(("a", 9), ("c", 4)), epoch=1) == 1
    assert table.merge(rows(("a", 7), ("c", 8))) == 0
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [("a", 1), ("b", 3), ("c", 4)]


@pytest.mark.parametrize("scattered", [True, False])
def test_added_rows_leave_written_ones_alone(spark, tmp_path, monkeypatch, scattered):
    """a further folder for new rows, no bucket is written anew until it has many folders; and no files stay behind."""
    from semlake.sources import keyed, scratch

    monkeypatch.setattr(keyed, "FOLDERS", 3)
    monkeypatch.setattr(scratch, "folder", lambda spark, label: f"file://{tmp_path}/cp/{label}-{uuid.uuid4().hex}")
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k", guard="k", buckets=1)
    rows = lambda *r: spark.createDataFrame(r, "k string, v long")
    held = []
    for n, batch in enumerate([[("a", 1), ("b", 2), ("b", 3)], [("a", 9), ("c", 4)], [("a", 7), ("c", 8)], [("d", 5)], [("e", 6), ("d", 0)], [("f", 7)]]):
        got = table.merge(rows(*batch), epoch=n, scattered=scattered)
        assert got == [2, 1, 0, 1, 1, 1][n]
        held.append(table.commits.latest().buckets["0"].split(","))
    assert [len(x) for x in held] == [1, 2, 2, 3, 1, 2] and held[3][:1] == held[0] and held[3][:2] == held[1]
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [("a", 1), ("b", 3), ("c", 4), ("d", 5), ("e", 6), ("f", 7)]
    with pytest.raises(Exception, match="without a key"):
        table.merge(rows((None, 1)), scattered=scattered)
    # a new column, and one of another type
    table.merge(spark.createDataFrame([("g", 8, "m")], "k string, v long, more string"), scattered=scattered)
    table.merge(spark.createDataFrame([("h", 9)], "k string, v int"), scattered=scattered)
    assert sorted((r["k"], r["v"], r["more"]) for r in table.read().filter("k > 'e'").collect()) == [("f", 7, None), ("g", 8, "m"), ("h", 9, None)]
    assert not list((tmp_path / "cp").glob("changed*")) and len(list((tmp_path / "cp").glob("incoming*"))) <= 1  # of the refused one


def test_shuffle_files_of_stored_tables_go(spark):
    """a stored table is read from its files, so its exchanges leave nothing on disk."""
    from pathlib import Path

    from semlake.sources.scratch import stored

    files = lambda: {p for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}
    before = files()
    assert stored(spark.range(10000).repartition(3).groupBy("id").count(), "counts").count() == 10000
    left = files() - before
    assert sum(p.stat().st_size for p in left if p.exists()) < 2000  # those of the count
