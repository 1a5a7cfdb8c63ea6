from datetime import datetime, timedelta

import pytest

from semlake.sources.keyed import KeyedTable, Ledger
from semlake.streaming import events as ev

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, per_file=1000):
    """Rows as a file stream, in files of ``per_file`` rows read one at a time."""
    folder = str(tmp_path / "in")
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i : i + per_file], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return df.sparkSession.table(name)


FILE = "ts timestamp, src string, dest string, event_type string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_debounce_keeps_the_last_event_of_a_session(spark, tmp_path):
    rows = [(at(0), "a.md", None, "created"), (at(30), "a.md", None, "modified"), (at(200), "a.md", None, "deleted"), (at(10), "b.pdf", None, "created"), (at(90000), "z.md", None, "created")]
    out = run(ev.debounce(stream(spark, tmp_path, rows, FILE)), tmp_path, "debounced")
    assert {(r["src"], r["event_type"]) for r in out.collect() if r["src"] != "z.md"} == {("a.md", "modified"), ("a.md", "deleted"), ("b.pdf", "created")}


def test_work_items_and_enqueue_once_for_ever(spark, tmp_path):
    rows = [(at(0), "a.md", None, "created"), (at(1), "a.md", None, "modified"), (at(2), "b.PDF", "c.pdf", "moved"), (at(3), "x.txt", None, "created"), (at(4), "d.pdf", None, "deleted")]
    late = [(at(86400 * 2), "a.md", None, "modified"), (at(86400 * 2), "e.md", None, "created")]
    queue = KeyedTable(spark, str(tmp_path / "queue"), "key")

    def start():
        items = ev.work_items(spark.readStream.schema(FILE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        q = ev.enqueue(items, str(tmp_path / "ledger"), str(tmp_path / "queue"), str(tmp_path / "ck"))
        assert q.awaitTermination(240)
        return sorted((r["src"], r["job"]) for r in queue.read().collect())

    spark.createDataFrame(rows, FILE).coalesce(1).write.parquet(str(tmp_path / "in"))
    first = start()
    assert first == [("a.md", "index_note"), ("b.PDF", "rename_book"), ("d.pdf", "remove_book")]
    # two days later, after a restart: the same key enqueues nothing
    spark.createDataFrame(late, FILE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert start() == sorted([*first, ("e.md", "index_note")])
    # an epoch that is played again gives what it gave, and adds nothing
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    again = ledger.add(ev.keyed(ev.work_items(spark.createDataFrame(late, FILE))), 1)
    assert [r["src"] for r in again.collect()] == ["e.md"] and ledger.table.read().count() == 4
    other = ledger.add(ev.keyed(ev.work_items(spark.createDataFrame(late, FILE))), 2)
    assert other.count() == 0


def test_incremental_index_writes_nothing_twice(spark, tmp_path):
    rows = [("s1", "text one"), ("s2", "text two"), ("s1", "text one")]
    table = KeyedTable(spark, str(tmp_path / "index"), "chunk_id")
    read = stream(spark, tmp_path, rows, "source_id string, content string", 1)
    assert ev.index_changes(read, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination(240)
    assert sorted(r["content"] for r in table.read().collect()) == ["text one", "text two"]
    before = table.commits.latest()
    assert before.epochs == {"index": 2}
    # the whole stream played again from the start: epochs that are in the table already
    read = spark.readStream.schema("source_id string, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert ev.index_changes(read, str(tmp_path / "index"), str(tmp_path / "ck2")).awaitTermination(240)
    assert table.commits.latest().version == before.version


def test_counters_match_batch(spark, tmp_path):
    rows = [(at(3600 * i), "add" if i % 3 else "remove", 10 * i) for i in range(30)] + [(at(3600 * 24 * 9), "add", 1)]
    out = run(ev.added_last_day(stream(spark, tmp_path, rows, "ts timestamp, op string, triple_count long")), tmp_path, "added")
    got = {r["w"]["end"]: r["added"] for r in out.collect()}
    end = T0 + timedelta(days=1)
    assert got[end] == sum(10 * i for i in range(24) if i % 3)


def test_daily_requests(spark, tmp_path):
    rows = [(at(i),) for i in range(70)] + [(at(86400 * 3),)]
    out = run(ev.daily_requests(stream(spark, tmp_path, rows, "ts timestamp")), tmp_path, "requests").collect()
    assert (out[0]["n"], out[0]["left"]) == (70, 0)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, ev.ROCKSDB)
    yield
    spark.conf.set(name, old)


def states(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return spark.table(name), [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]


OKS = [(0, True), (10, False), (30, False), (20, False), (100, True), (170, True), (130, True), (400, False), (500, True)]  # not in order


def test_health_timeline(spark, tmp_path, rocks):
    rows = [(at(s), f"p{i}", ok) for s, ok in OKS for i in range(5)] + [(at(9 * 86400), "far", True), (at(30 * 86400), "far", True)]
    kind = "ts timestamp, provider string, ok boolean"
    out, sizes = states(spark, ev.health(stream(spark, tmp_path, rows, kind, 15)), tmp_path, "health")
    got = [(int((r["ts"] - T0).total_seconds()), r["state"]) for r in out.filter("provider = 'p3'").orderBy("ts").collect()]
    assert got == [(10, "DEGRADED"), (30, "OUTAGE"), (100, "DEGRADED"), (170, "HEALTHY"), (400, "DEGRADED"), (500, "HEALTHY")]
    twin = ev.health_timeline(spark.createDataFrame(rows, kind))
    assert sorted(map(tuple, twin.collect())) == sorted(map(tuple, out.collect()))
    assert max(sizes) >= 5 and sizes[-1] <= 2  # the five are gone: what is left belongs to the last row of another


def test_ttl_cache(spark, tmp_path, rocks):
    rows = [(at(0), "k", "a"), (at(150), "k", "c"), (at(50), "k", "b"), *[(at(10 + i), f"j{i}", "x") for i in range(6)], (at(86400), "far", "y"), (at(3 * 86400), "far", "z")]
    kind = "ts timestamp, key string, payload string"
    out, sizes = states(spark, ev.ttl_cache(stream(spark, tmp_path, rows, kind, 2), 100), tmp_path, "cache")
    assert [(r["payload"], r["hit"]) for r in out.filter("key = 'k'").orderBy("ts").collect()] == [("a", False), ("a", True), ("c", False)]
    twin = ev.cache_answers(spark.createDataFrame([r for r in rows if r[1] != "far"], kind), 100)
    assert sorted(map(tuple, twin.collect())) == sorted(map(tuple, out.filter("key <> 'far'").collect()))
    assert max(sizes) >= 5 and sizes[-1] <= 2
