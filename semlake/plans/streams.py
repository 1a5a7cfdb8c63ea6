"""Batch twins of the streaming operators: the same functions over the whole table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.fixtures import frame
from semlake.plans.registry import query
from semlake.streaming import events as ev


def _files(spark: SparkSession, sf: str) -> DataFrame:
    e = frame(spark, sf, "events")
    ext = F.when(F.col("event_id") % 3 == 0, ".md").when(F.col("event_id") % 3 == 1, ".PDF").otherwise(".txt")
    kind = F.when(F.col("event_type") == "view", "modified").when(F.col("event_type") == "click", "deleted").when(F.col("event_type") == "error", "moved").otherwise("created")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("f"), F.col("user_id").cast("string"), ext).alias("src"), F.lit(None).cast("string").alias("dest"), kind.alias("event_type"))


@query("""WITH e AS (SELECT ts, 'u' || user_id % 5 AS src, event_type FROM @events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY src ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY src ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT src, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, max_by(event_type, ts) AS event_type FROM s GROUP BY src, session""")
def s01_debounce(spark: SparkSession, sf: str) -> DataFrame:
    e = frame(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("src"), F.lit(None).cast("string").alias("dest"), "event_type")
    return ev.debounce(e, quiet="30 minutes").select("src", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "event_type")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'remove_' || x WHEN 'error' THEN 'rename_' || x ELSE CASE x WHEN 'note' THEN 'index_note' ELSE 'parse_book' END END AS job
FROM (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'book' END AS x FROM @events) WHERE x IS NOT NULL""")
def s02_work_items(spark: SparkSession, sf: str) -> DataFrame:
    return ev.work_items(_files(spark, sf)).select("event_id", "job")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, triple_count * CAST(op = 'add' AS INTEGER) AS n FROM @delta_log), w AS (SELECT hour + INTERVAL 1 HOUR * k AS ending, n FROM h, range(1, 25) r(k))
SELECT strftime(ending, '%Y-%m-%d %H:%M:%S') AS ending, CAST(sum(n) AS BIGINT) AS added, sum(n) > 100 AS trigger FROM w GROUP BY 1""".replace(" AS trigger", ' AS "trigger"'))
def s05_added_last_day(spark: SparkSession, sf: str) -> DataFrame:
    d = frame(spark, sf, "delta_log").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.added_last_day(d).select(F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("ending"), "added", "trigger")


@query("SELECT strftime(date_trunc('day', fetched_at), '%Y-%m-%d') AS day, count(*) AS n, greatest(0, 50 - count(*)) AS remaining FROM @fetch_log GROUP BY 1")
def s06_daily_requests(spark: SparkSession, sf: str) -> DataFrame:
    r = frame(spark, sf, "fetch_log").select(F.col("fetched_at").cast("timestamp").alias("ts"))
    return ev.daily_requests(r).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", F.col("left").alias("remaining"))


_WINDOW, _HEAL, _TTL = 2 * 86_400, 86_400, 3 * 86_400


@query(f"""WITH RECURSIVE e AS (SELECT 'p' || user_id AS provider, ts, epoch(ts) AS t, value >= 150 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, value >= 150) AS n FROM @events),
r AS (SELECT provider, n, ts, CASE WHEN ok THEN 'HEALTHY' ELSE 'DEGRADED' END AS state, CASE WHEN ok THEN CAST([] AS DOUBLE[]) ELSE [CAST(t AS DOUBLE)] END AS fails, CASE WHEN ok THEN CAST(0 AS DOUBLE) ELSE CAST(t AS DOUBLE) END AS since, 'HEALTHY' AS was FROM e WHERE n = 1
UNION ALL SELECT e.provider, e.n, e.ts,
  CASE WHEN NOT e.ok THEN CASE WHEN len(list_filter(r.fails, lambda f: e.t - f <= {_WINDOW})) >= 2 THEN 'OUTAGE' ELSE 'DEGRADED' END WHEN r.state = 'OUTAGE' THEN 'DEGRADED' WHEN r.state = 'DEGRADED' AND e.t - r.since >= {_HEAL} THEN 'HEALTHY' ELSE r.state END,
  list_concat(list_filter(r.fails, lambda f: e.t - f <= {_WINDOW}), CASE WHEN e.ok THEN CAST([] AS DOUBLE[]) ELSE [CAST(e.t AS DOUBLE)] END),
  CASE WHEN NOT e.ok OR r.state = 'OUTAGE' OR (r.state = 'DEGRADED' AND e.t - r.since >= {_HEAL}) THEN CAST(e.t AS DOUBLE) ELSE r.since END, r.state
FROM r JOIN e ON e.provider = r.provider AND e.n = r.n + 1)
SELECT provider, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, state FROM r WHERE state <> was""")
def s07_health_timeline(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = frame(spark, sf, "events").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("provider"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") >= 150).alias("ok"))
    return ev.health_timeline(outcomes, _WINDOW, _HEAL).select("provider", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "state")


@query(f"""WITH RECURSIVE e AS (SELECT 'k' || user_id AS key, epoch(ts) AS t, event_id, CAST(event_id AS STRING) AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS STRING)) AS n FROM @events),
r AS (SELECT key, n, event_id, payload, t + {_TTL} AS expires, false AS hit FROM e WHERE n = 1
UNION ALL SELECT e.key, e.n, e.event_id, CASE WHEN e.t < r.expires THEN r.payload ELSE e.payload END, CASE WHEN e.t < r.expires THEN r.expires ELSE e.t + {_TTL} END, e.t < r.expires FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, payload, count(*) AS n, count(*) FILTER (hit) AS hits FROM r GROUP BY 1, 2""")
def s08_cache_answers(spark: SparkSession, sf: str) -> DataFrame:
    requests = frame(spark, sf, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("payload"))
    return ev.cache_answers(requests, _TTL).groupBy("key", "payload").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
