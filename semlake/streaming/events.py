"""Structured Streaming forms of the event-driven parts; each has a batch twin in the operators."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import ArrayType, DoubleType, StructType

from semlake.operators import chunks as ck
from semlake.sources.keyed import KeyedTable, Ledger

QUIET, LATENESS = "60 seconds", "10 minutes"


def debounce(events: DataFrame, quiet: str = QUIET, lateness: str = LATENESS) -> DataFrame:
    """``(ts, src, dest, event_type)`` -> the last event of each path once ``quiet`` passes with none."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", quiet).alias("w"), "src").agg(F.max("ts").alias("last_ts"), F.max_by("event_type", "ts").alias("event_type"), F.max_by("dest", "ts").alias("dest"))


def work_items(events: DataFrame) -> DataFrame:
    """Markdown and PDF events -> work items; other files drop out."""
    path, kind = F.lower(F.col("src")), F.col("event_type")
    ext = F.when(path.endswith(".md"), "note").when(path.endswith(".pdf"), "book")
    item: Column = F.when(kind == "deleted", F.concat(F.lit("remove_"), "ext")).when(kind == "moved", F.concat(F.lit("rename_"), "ext")).otherwise(F.when(F.col("ext") == "note", "index_note").otherwise("parse_book"))
    return events.withColumn("ext", ext).filter("ext is not null").withColumn("job", item)


def keyed(items: DataFrame) -> DataFrame:
    """Items with the idempotency key of job, source and target."""
    return items.withColumn("key", F.sha2(F.concat_ws("|", "job", "src", F.coalesce("dest", F.lit(""))), 256))


def enqueue(items: DataFrame, ledger: str, queue: str, checkpoint: str):  # noqa: ANN201
    """Work items of a stream go to the ``queue`` table once for each idempotency key, for ever.

    Each micro-batch asks the ledger in the folder ``ledger``; queue rows are keyed too, so that a batch which is played
    again after a failure adds nothing.
    """
    spark = items.sparkSession
    keys, jobs = Ledger(spark, ledger), KeyedTable(spark, queue, "key", guard="key")

    def put(batch: DataFrame, epoch: int) -> None:
        jobs.merge(keys.add(keyed(batch), epoch), epoch, "stream")

    return items.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_changes(read: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Stream of changed notes ``(source_id, content, ...)`` -> their chunks in the keyed table at ``path``.

    Of a micro-batch a source's rows are one (the newest, where there is a ``modified_at``).  The hash guard leaves
    unchanged chunks alone, and an epoch that is played again changes nothing.
    """
    table = KeyedTable(read.sparkSession, path, "chunk_id", guard="content_hash")
    newest = F.max_by(F.struct("*"), F.struct(*[c for c in ("modified_at", "content") if c in read.columns]))

    def put(batch: DataFrame, epoch: int) -> None:
        one = batch.groupBy(F.col("source_id").alias("_s")).agg(newest.alias("r")).select("r.*")
        table.merge(ck.children(one).select("source_id", "chunk_index", "chunk_id", "content", "content_hash"), epoch, "index")

    return read.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def added_last_day(delta: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """24 h sliding sums of added triples with the flag over 100."""
    add = F.sum(F.when(F.col("op") == "add", F.col("triple_count")).otherwise(0))
    return delta.withWatermark("ts", lateness).groupBy(F.window("ts", "24 hours", "1 hour").alias("w")).agg(add.alias("added")).withColumn("trigger", F.col("added") > 100)


def daily_requests(requests: DataFrame, limit: int = 50, lateness: str = LATENESS) -> DataFrame:
    return requests.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).withColumn("left", F.greatest(F.lit(0), limit - F.col("n")))


HEALTH_OUT = "provider string, ts timestamp, state string"
#: State processors need this store: ``spark.sql.streaming.stateStore.providerClass``.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _step(state: str, failures: list[float], since: float, ts: float, ok: bool, window: float, heal: float) -> tuple[str, list[float], float]:
    """One outcome: failures degrade, three within the window are an outage; successes recover by way of degraded."""
    failures = [f for f in failures if ts - f <= window]
    if not ok:
        failures.append(ts)
        return ("OUTAGE" if len(failures) >= 3 else "DEGRADED"), failures, ts
    if state == "OUTAGE":
        return "DEGRADED", failures, ts
    if state == "DEGRADED" and ts - since >= heal:
        return "HEALTHY", failures, ts
    return state, failures, since


class _Waiting(StatefulProcessor):
    """Rows wait until the watermark passes them and are then taken in order of time; a key's state ends by itself.

    A timer stands at the next waiting row, or, when none waits, at the time when the key may be forgotten.
    """

    row: StructType
    state: StructType
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.kept = handle.getValueState("kept", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            self.waiting.appendList([(t.timestamp(), *more) for t, *more in pdf[["ts", *self.columns]].itertuples(index=False, name=None)])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] * 1000 <= watermark]
        rest = rows[len(ready) :]
        kept = self.kept.get() if self.kept.exists() else None
        if ready:
            kept, out = self.take(key, kept, ready)
            self.kept.update(kept)
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield out
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(int(rest[0][0] * 1000) + 1)
        elif kept is not None:
            ends = int(self.forgotten(kept) * 1000) + 1
            if ends <= watermark:
                self.kept.clear()
            else:
                self.handle.registerTimer(ends)

    def take(self, key: tuple, kept: tuple | None, rows: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def forgotten(self, kept: tuple) -> float:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Health(_Waiting):
    row = StructType().add("ts", "double").add("ok", "boolean")
    state = StructType().add("state", "string").add("failures", ArrayType(DoubleType())).add("since", "double").add("seen", "double")
    columns = ["ok"]

    def __init__(self, window: float, heal: float, forget: float) -> None:
        self.window, self.heal, self.forget = window, heal, forget

    def take(self, key: tuple, kept: tuple | None, rows: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        now, failures, since, _ = kept or ("HEALTHY", [], 0.0, 0.0)
        failures, out = list(failures), []
        for ts, ok in rows:
            new, failures, since = _step(now, failures, since, ts, bool(ok), self.window, self.heal)
            if new != now:
                out.append((key[0], _time(ts), new))
            now = new
        return (now, failures, since, rows[-1][0]), pd.DataFrame(out, columns=["provider", "ts", "state"]).astype({"provider": "object", "ts": "datetime64[us]", "state": "object"})

    def forgotten(self, kept: tuple) -> float:
        """A healthy provider without recent failures is like an unknown one."""
        state, failures, _, seen = kept
        return seen + (self.window if state == "HEALTHY" else self.forget)


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(round(seconds * 1_000_000) / 1_000_000)


def health(outcomes: DataFrame, window: float = 60.0, heal: float = 60.0, lateness: str = LATENESS, forget: float = 7 * 86400.0) -> DataFrame:
    """Stream of ``(provider, ts, ok)`` -> the changes of each provider's state, late outcomes put in order until the
    watermark.  A provider that has been silent for ``forget`` seconds counts as healthy again."""
    return outcomes.withWatermark("ts", lateness).groupBy("provider").transformWithStateInPandas(_Health(window, heal, forget), HEALTH_OUT, "Append", "EventTime")


def health_timeline(outcomes: DataFrame, window: float = 60.0, heal: float = 60.0) -> DataFrame:
    """Batch twin of :func:`health`: each provider's outcomes are streamed in order of time (failures first at one time)."""
    lined = outcomes.select("provider", "ts", "ok").repartition("provider").sortWithinPartitions("provider", "ts", "ok")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, now, failures, since = None, "HEALTHY", [], 0.0
        for pdf in batches:
            out = []
            for provider, ts, ok in pdf.itertuples(index=False, name=None):
                if who is None or provider != who:
                    who, now, failures, since = provider, "HEALTHY", [], 0.0
                new, failures, since = _step(now, failures, since, ts.timestamp(), bool(ok), window, heal)
                if new != now:
                    out.append((provider, ts, new))
                now = new
            yield pd.DataFrame(out, columns=["provider", "ts", "state"]).astype({"provider": "object", "ts": "datetime64[us]", "state": "object"})

    return lined.mapInPandas(run, HEALTH_OUT)


CACHE_OUT = "key string, ts timestamp, payload string, hit boolean"


def _answer(payload: str | None, expires: float, ts: float, value: str, ttl: float) -> tuple[str | None, float, bool]:
    """What is kept after a request, and whether it was answered from what was kept before."""
    if payload is not None and ts < expires:
        return payload, expires, True
    return value, ts + ttl, False


class _Cache(_Waiting):
    row = StructType().add("ts", "double").add("payload", "string")
    state = StructType().add("payload", "string").add("expires", "double")
    columns = ["payload"]

    def __init__(self, ttl: float) -> None:
        self.ttl = ttl

    def take(self, key: tuple, kept: tuple | None, rows: list[tuple]) -> tuple[tuple, pd.DataFrame]:
        payload, expires = kept or (None, 0.0)
        out = []
        for ts, value in rows:
            payload, expires, hit = _answer(payload, expires, ts, value, self.ttl)
            out.append((key[0], _time(ts), payload, hit))
        return (payload, expires), pd.DataFrame(out, columns=["key", "ts", "payload", "hit"]).astype({"ts": "datetime64[us]"})

    def forgotten(self, kept: tuple) -> float:
        return kept[1]


def ttl_cache(requests: DataFrame, ttl: float, lateness: str = LATENESS) -> DataFrame:
    """Stream of ``(key, ts, payload)`` -> what each request is answered with, and whether it came from the cache; an
    expired payload leaves the state when the watermark passes its end."""
    return requests.withWatermark("ts", lateness).groupBy("key").transformWithStateInPandas(_Cache(ttl), CACHE_OUT, "Append", "EventTime")


def cache_answers(requests: DataFrame, ttl: float) -> DataFrame:
    """Batch twin of :func:`ttl_cache`: each key's requests are streamed in order of time, then payload."""
    lined = requests.select("key", "ts", "payload").repartition("key").sortWithinPartitions("key", "ts", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, payload, expires = None, None, 0.0
        for pdf in batches:
            out = []
            for key, ts, value in pdf.itertuples(index=False, name=None):
                if who is None or key != who:
                    who, payload, expires = key, None, 0.0
                payload, expires, hit = _answer(payload, expires, ts.timestamp(), value, ttl)
                out.append((key, ts, payload, hit))
            yield pd.DataFrame(out, columns=["key", "ts", "payload", "hit"])

    return lined.mapInPandas(run, CACHE_OUT)
