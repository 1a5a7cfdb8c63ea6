"""Queries over jobs, fetches, decisions, deltas and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semlake.fixtures import frame
from semlake.operators import logs as lg
from semlake.plans.registry import query

NOW = "2024-01-20 00:00:00"
DAY = "%Y-%m-%d %H:%M:%S"


def _stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "jobs").withColumn("created_at", F.col("created_at").cast("timestamp"))


def _fetches(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "fetch_log").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "delta_log").withColumn("ts", F.col("ts").cast("timestamp"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "review_log").withColumn("decided_at", F.col("decided_at").cast("timestamp"))


_N = lambda c: f"CAST(count_if({c}) AS BIGINT)"


@query(f"SELECT {_N('status = $$pending$$')} AS pending, {_N('status = $$running$$')} AS running, {_N('status = $$done$$')} AS done, {_N('status = $$failed$$')} AS failed, count(*) AS total FROM @jobs".replace("$$", "'"))
def d01_status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return lg.status_pivot(_jobs(spark, sf))


@query("SELECT type, count(*) AS n FROM @jobs WHERE status = 'pending' GROUP BY 1")
def d02_pending_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).filter("status = 'pending'").groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT CAST(count_if(type = 'index_note' AND status = 'done') AS BIGINT) AS notes, CAST(count_if(type = 'parse_book' AND status = 'done') AS BIGINT) AS books, CAST(count_if(type = 'save_web') AS BIGINT) AS pages FROM @jobs")
def d03_corpus_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).agg(F.expr("count_if(type = 'index_note' and status = 'done')").alias("notes"), F.expr("count_if(type = 'parse_book' and status = 'done')").alias("books"), F.expr("count_if(type = 'save_web')").alias("pages"))


@query("SELECT user_id, round(avg(value) + 0.1 * ln(count(*) + 1), 6) AS score FROM @events GROUP BY 1")
def d04_child_score(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "events").groupBy("user_id").agg(F.round(F.avg("value") + 0.1 * F.log(F.count("*") + 1), 6).alias("score"))


@query("SELECT conv_id, count(*) AS n, array_to_string(list(CAST(turn AS VARCHAR) || ':' || role ORDER BY turn), ',') AS children FROM @conversations GROUP BY 1")
def d05_nested_children(spark: SparkSession, sf: str) -> DataFrame:
    g = frame(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("c"))
    return g.select("conv_id", "n", F.array_join(F.transform("c", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ",").alias("children"))


@query("SELECT head, rel, round(avg(score), 9) AS mean, round(CASE WHEN stddev_pop(score) > 0 THEN stddev_pop(score) ELSE 1 END, 9) AS std FROM @predictions GROUP BY 1, 2")
def d07_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    std = F.stddev_pop("score")
    return frame(spark, sf, "predictions").groupBy("head", "rel").agg(F.round(F.avg("score"), 9).alias("mean"), F.round(F.when(std > 0, std).otherwise(1.0), 9).alias("std"))


@query("SELECT op, CAST(sum(triple_count) AS BIGINT) AS triples, CAST(sum(entity_diff) AS BIGINT) AS entities FROM @delta_log WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def d08_delta_sums(spark: SparkSession, sf: str) -> DataFrame:
    return _delta(spark, sf).filter(F.col("ts") >= F.to_timestamp(F.lit("2024-01-10 00:00:00"))).groupBy("op").agg(F.sum("triple_count").alias("triples"), F.sum("entity_diff").alias("entities"))


@query("SELECT count(DISTINCT tier) AS tiers FROM @delta_log WHERE op = 'add' AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def d09_distinct_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return _delta(spark, sf).filter((F.col("op") == "add") & (F.col("ts") >= F.to_timestamp(F.lit("2024-01-10 00:00:00")))).agg(F.countDistinct("tier").alias("tiers"))


@query(f"SELECT CAST(coalesce(sum(triple_count), 0) AS BIGINT) AS added FROM @delta_log WHERE op = 'add' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS AND ts < TIMESTAMP '{NOW}'")
def d10_added_last_day(spark: SparkSession, sf: str) -> DataFrame:
    now = F.to_timestamp(F.lit(NOW))
    return _delta(spark, sf).filter((F.col("op") == "add") & (F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") < now)).agg(F.coalesce(F.sum("triple_count"), F.lit(0)).alias("added"))


@query("SELECT CAST(coalesce(sum(CASE WHEN op = 'add' THEN triple_count ELSE -triple_count END), 10000) AS BIGINT) AS triples, CAST(coalesce(sum(CASE WHEN op = 'none' THEN entity_diff END), 1000) AS BIGINT) AS entities FROM @delta_log")
def d11_totals(spark: SparkSession, sf: str) -> DataFrame:
    op = F.col("op")
    return _delta(spark, sf).agg(F.coalesce(F.sum(F.when(op == "add", F.col("triple_count")).otherwise(-F.col("triple_count"))), F.lit(10000)).alias("triples"), F.coalesce(F.sum(F.when(op == "none", F.col("entity_diff"))), F.lit(1000)).alias("entities"))


@query("SELECT CAST(count_if(toxic = 0) AS BIGINT) AS y, count(*) AS judged, CAST(count_if(toxic = 0) AS DOUBLE) / count(*) AS accuracy, CAST(count_if(toxic = 0) AS DOUBLE) / count(*) >= 0.75 AS passed FROM @labels")
def d17_judged_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    a = frame(spark, sf, "labels").agg(F.count_if(F.col("toxic") == 0).alias("y"), F.count("*").alias("judged"))
    return a.withColumn("accuracy", F.col("y") / F.col("judged")).withColumn("passed", F.col("accuracy") >= 0.75)


@query("SELECT avg(CAST(quality = 1 AND toxic = 0 AND doc_id % 2 = 0 AS INTEGER)) AS precision_at FROM @labels")
def d18_rubric_precision(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "labels").agg(F.avg(F.expr("int(quality = 1 and toxic = 0 and doc_id % 2 = 0)")).alias("precision_at"))


@query("SELECT conv_id, avg(CAST(length(text) % 2 AS INTEGER)) AS fraction, avg(CAST(length(text) % 2 AS INTEGER)) >= 0.5 AS flagged FROM @conversations GROUP BY 1")
def d19_warning_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "conversations").groupBy("conv_id").agg(F.avg(F.length("text") % 2).alias("fraction")).withColumn("flagged", F.col("fraction") >= 0.5)


@query("""WITH c AS (SELECT id, CASE turn % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'book_chapter' ELSE 'web' END AS kind, count(*) AS n FROM @citations GROUP BY 1, 2)
SELECT id, string_agg(kind || ' ' || n, ', ' ORDER BY CASE kind WHEN 'note' THEN 1 WHEN 'book_chapter' THEN 2 ELSE 3 END) AS line FROM c GROUP BY 1""")
def d20_citation_line(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 0, "note").when(F.col("turn") % 3 == 1, "book_chapter").otherwise("web")
    place = F.when(F.col("kind") == "note", 1).when(F.col("kind") == "book_chapter", 2).otherwise(3)
    c = frame(spark, sf, "citations").groupBy("id", kind.alias("kind")).agg(F.count("*").alias("n"))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), F.concat_ws(" ", "kind", F.col("n").cast("string")).alias("t")))), lambda x: x["t"]), ", ")
    return c.groupBy("id").agg(line.alias("line"))


@query("SELECT latency_ms AS p95 FROM (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS r, count(*) OVER () AS n FROM @results WHERE latency_ms > 0) WHERE r = CAST(floor(0.95 * n) AS BIGINT) + 1")
def d22_p95_latency(spark: SparkSession, sf: str) -> DataFrame:
    # equal latencies are one counted row, so the running count sorts distinct values only
    counts = frame(spark, sf, "results").filter("latency_ms > 0").groupBy("latency_ms").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    upto = F.sum("n").over(Window.orderBy("latency_ms"))
    return counts.withColumn("upto", upto).filter(F.col("upto") > int(0.95 * total)).orderBy("latency_ms").limit(1).select(F.col("latency_ms").alias("p95"))


@query("SELECT category, median(latency_ms) AS p50, avg(latency_ms) AS mean, max(latency_ms) AS longest FROM @results WHERE latency_ms > 0 GROUP BY 1")
def d23_latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "results").filter("latency_ms > 0").groupBy("category").agg(F.median("latency_ms").alias("p50"), F.avg("latency_ms").alias("mean"), F.max("latency_ms").alias("longest"))


@query("SELECT strftime(fetched_at, '%Y-%m-%d') AS day, count(*) AS n FROM @fetch_log GROUP BY 1")
def d24_requests_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return _fetches(spark, sf).groupBy(F.date_format("fetched_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


_Z = "SELECT *, (score - avg(score) OVER g) / CASE WHEN stddev_pop(score) OVER g > 0 THEN stddev_pop(score) OVER g ELSE 1 END AS zscore FROM @predictions WINDOW g AS (PARTITION BY head, rel)"


@query(f"SELECT pred_id, round(zscore, 6) AS zscore FROM ({_Z})")
def w01_zscores(spark: SparkSession, sf: str) -> DataFrame:
    return lg.zscores(frame(spark, sf, "predictions"), ["head", "rel"]).select("pred_id", F.round("zscore", 6).alias("zscore"))


@query(f"SELECT head, CASE WHEN max(round(zscore, 9)) >= 3 THEN 7 WHEN max(round(zscore, 9)) >= 2 THEN 5 WHEN max(round(zscore, 9)) >= 1 THEN 3 ELSE 1 END AS quota FROM ({_Z}) GROUP BY 1")
def w02_quota(spark: SparkSession, sf: str) -> DataFrame:
    top = F.max(F.round("zscore", 9))
    return lg.zscores(frame(spark, sf, "predictions"), ["head", "rel"]).groupBy("head").agg(F.when(top >= 3, 7).when(top >= 2, 5).when(top >= 1, 3).otherwise(1).alias("quota"))


@query("SELECT url, content_hash, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS at, array_to_string(list_sort(previous), ',') AS previous, len(previous) > 0 AS is_update, list_contains(previous, content_hash) AS is_duplicate FROM (SELECT *, coalesce(list_distinct(list(content_hash) OVER (PARTITION BY url ORDER BY fetched_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS previous FROM (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY fetched_at, event_id) AS last FROM @fetch_log) WHERE last IS NULL OR last <> content_hash)")
def w09_version_chain(spark: SparkSession, sf: str) -> DataFrame:
    out = lg.with_previous(*lg.version_chain(_fetches(spark, sf)))
    return out.select("url", "content_hash", _stamp("fetched_at").alias("at"), F.array_join(F.array_sort("previous"), ",").alias("previous"), "is_update", "is_duplicate")


@query("SELECT event_id, row_number() OVER d AS used, row_number() OVER d <= 50 AS allowed, greatest(0, 50 - row_number() OVER d) AS left FROM @fetch_log WINDOW d AS (PARTITION BY CAST(fetched_at AS DATE) ORDER BY fetched_at, event_id)".replace("AS left", 'AS "left"'))
def w10_daily_quota(spark: SparkSession, sf: str) -> DataFrame:
    return lg.quota(_fetches(spark, sf), 50).select("event_id", F.col("used").cast("long").alias("used"), "allowed", F.col("left").cast("long").alias("left"))


@query("SELECT payload_json, type, min_by(id, (created_at, id)) AS id FROM @jobs GROUP BY 1, 2")
def w11_idempotent_first(spark: SparkSession, sf: str) -> DataFrame:
    return lg.first_wins(_jobs(spark, sf).select("payload_json", "type", "id", "created_at"), ["payload_json", "type"], ["created_at", "id"]).select("payload_json", "type", "id")


@query("SELECT vault_id, doc_id % 50 AS stem, max_by(rel_path, rel_path) AS rel_path FROM @notes GROUP BY 1, 2")
def w12_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return lg.last_wins(frame(spark, sf, "notes").select("vault_id", (F.col("doc_id") % 50).alias("stem"), "rel_path"), ["vault_id", "stem"], ["rel_path"]).select("vault_id", "stem", "rel_path")


@query("SELECT cand, action FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY decided_at DESC, event_id DESC) AS r FROM @review_log) WHERE r = 1")
def w13_latest_decision(spark: SparkSession, sf: str) -> DataFrame:
    return lg.latest_decision(_log(spark, sf)).select("cand", "action")


@query("SELECT user_id, event_id, gen FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS gen FROM @events) WHERE gen <= 3")
def w14_newest_generations(spark: SparkSession, sf: str) -> DataFrame:
    return lg.newest(frame(spark, sf, "events").select("user_id", "event_id"), 3, ["user_id"], "event_id")


@query("SELECT user_id, event_id, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_current FROM @events")
def w15_run_list(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") == F.max("event_id").over(Window.partitionBy("user_id"))).alias("is_current"))


@query("""WITH p AS (SELECT *, CAST(count_if(status = 'pending') OVER (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS waiting FROM @jobs WHERE type = 'parse_book')
SELECT id, CASE WHEN coalesce(waiting, 0) >= 5 THEN 1 ELSE 10 END AS new_priority,
  CASE WHEN coalesce(waiting, 0) >= 5 THEN strftime(CASE WHEN date_trunc('day', created_at) + INTERVAL 3 HOURS > created_at THEN date_trunc('day', created_at) + INTERVAL 3 HOURS ELSE date_trunc('day', created_at) + INTERVAL 27 HOURS END, '%Y-%m-%d %H:%M:%S') END AS after FROM p""")
def w16_nightly_deferral(spark: SparkSession, sf: str) -> DataFrame:
    return lg.nightly_deferral(_jobs(spark, sf).filter("type = 'parse_book'")).select("id", "new_priority", _stamp("after").alias("after"))


_SURFACE = f"""
z AS (SELECT * REPLACE (round(zscore, 9) AS zscore) FROM ({_Z})), zq AS (SELECT *, max(zscore) OVER (PARTITION BY head) AS top FROM z),
old AS (SELECT head, rel, tail, max(score) - 0.2 * (min(pred_id) % 3) AS old_score FROM @predictions WHERE pred_id % 7 = 0 GROUP BY 1, 2, 3),
f AS (SELECT zq.*, CASE WHEN top >= 3 THEN 7 WHEN top >= 2 THEN 5 WHEN top >= 1 THEN 3 ELSE 1 END AS quota FROM zq LEFT JOIN old USING (head, rel, tail) WHERE old_score IS NULL OR score - old_score >= 0.3),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY zscore DESC, pred_id) AS n FROM f) WHERE n <= quota),
ty AS (SELECT *, CASE WHEN contains(head, 'urn:note:') THEN 'note' WHEN contains(head, 'urn:tag:') THEN 'tag' WHEN contains(head, 'urn:wd:') THEN 'wikidata' ELSE 'concept' END AS entity_type FROM t),
tu AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY round(zscore, 6) DESC, pred_id) AS turn FROM ty)"""


@query(f"WITH {_SURFACE} SELECT pred_id, entity_type, CAST(turn AS INTEGER) AS turn FROM tu ORDER BY turn, entity_type LIMIT 50")
def l09_surface_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = frame(spark, sf, "predictions")
    old = p.filter("pred_id % 7 = 0").groupBy("head", "rel", "tail").agg((F.max("score") - 0.2 * (F.min("pred_id") % 3)).alias("old_score"))
    return lg.surface(p, old, 50).select("pred_id", "entity_type", "turn")


@query("""SELECT event_id, CAST(greatest(0, 50 - count(*) FILTER (action = 'approve') OVER (PARTITION BY cand ORDER BY decided_at RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)) AS BIGINT) AS cap FROM @review_log""")
def w05_weekly_cap(spark: SparkSession, sf: str) -> DataFrame:
    return lg.weekly_cap(_log(spark, sf)).select("event_id", "cap")


@query(f"""SELECT cand FROM (SELECT cand, max_by(action, (decided_at, event_id)) AS action, max(decided_at) AS last_at FROM @review_log GROUP BY 1)
WHERE action IN ('approve', 'reject') OR (action = 'defer' AND last_at + INTERVAL 7 DAYS >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS)""")
def c10_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    d = lg.latest_decision(_log(spark, sf))
    held = F.col("decided_at") + F.expr("INTERVAL 7 DAYS") >= F.to_timestamp(F.lit(NOW)) - F.expr("INTERVAL 7 DAYS")
    return d.filter(F.col("action").isin("approve", "reject") | ((F.col("action") == "defer") & held)).select("cand")


@query("SELECT p.pred_id, max_by(l.score, (l.decided_at, l.event_id)) AS previous FROM @predictions p JOIN @review_log l ON l.cand = p.pred_id GROUP BY 1")
def c11_previous_score(spark: SparkSession, sf: str) -> DataFrame:
    last = lg.latest_decision(_log(spark, sf)).select(F.col("cand").alias("pred_id"), F.col("score").alias("previous"))
    return frame(spark, sf, "predictions").select("pred_id").join(last, "pred_id")


@query(f"""WITH d AS (SELECT cand, max_by(action, (decided_at, event_id)) AS action, max(decided_at) AS last_at FROM @review_log GROUP BY 1)
SELECT pred_id, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'defer' THEN 'deferred' ELSE 'pending' END AS status, CASE WHEN action = 'defer' THEN strftime(last_at + INTERVAL 7 DAYS, '{DAY}') END AS defer_until
FROM @predictions LEFT JOIN d ON cand = pred_id""")
def v01_apply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    c = frame(spark, sf, "predictions").select(F.col("pred_id").alias("cand"))
    return lg.apply_decisions(c, _log(spark, sf)).select(F.col("cand").alias("pred_id"), "status", _stamp("defer_until").alias("defer_until"))


@query("""WITH d AS (SELECT cand, max_by(action, (decided_at, event_id)) AS action FROM @review_log GROUP BY 1)
SELECT DISTINCT head AS s, rel AS p, tail AS o, 'tier0' AS graph FROM @predictions JOIN d ON cand = pred_id WHERE action = 'approve'""")
def v02_promote_approved(spark: SparkSession, sf: str) -> DataFrame:
    ok = lg.latest_decision(_log(spark, sf)).filter("action = 'approve'").select(F.col("cand").alias("pred_id"))
    return frame(spark, sf, "predictions").join(ok, "pred_id", "left_semi").selectExpr("head as s", "rel as p", "tail as o", "'tier0' as graph").distinct()


@query("SELECT DISTINCT chunk_id, sha256('openie|' || chunk_id) AS key FROM @candidates WHERE chunk_id <> ''")
def v03_reextraction_list(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "candidates").filter("chunk_id <> ''").select("chunk_id").distinct().withColumn("key", F.sha2(F.concat(F.lit("openie|"), "chunk_id"), 256))


@query("SELECT id, CASE WHEN status IN ('failed', 'running') THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM @jobs")
def v04_reset_jobs(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("status")
    return _jobs(spark, sf).select("id", F.when(s.isin("failed", "running"), "pending").otherwise(s).alias("status"), F.when(s == "failed", 0).otherwise(F.col("attempts")).alias("attempts"))


@query("""WITH e AS (SELECT 'b' || CAST(user_id % 40 AS STRING) AS sha, event_id % 5 AS n, event_id % 7 AS m, CASE WHEN event_type IN ('error', 'click') THEN 'remove' WHEN event_type = 'purchase' THEN 'rename' ELSE 'add' END AS op, ts, event_id FROM @events),
a AS (SELECT sha, n AS path, CASE op WHEN 'add' THEN 1 ELSE 0 END AS there, ts, event_id, 0 AS no FROM e UNION ALL SELECT sha, m, 1, ts, event_id, 1 FROM e WHERE op = 'rename'),
l AS (SELECT sha, path, max_by(there, (ts, event_id, no)) AS there FROM a GROUP BY 1, 2)
SELECT sha, coalesce(string_agg('/p' || CAST(path AS STRING), ',' ORDER BY path) FILTER (there = 1), '') AS paths, count_if(there = 1) = 0 AS removed FROM l GROUP BY 1""")
def v06_book_paths(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda n: F.concat(F.lit("/p"), (F.col("event_id") % n).cast("string"))
    op = F.when(F.col("event_type").isin("error", "click"), "remove").when(F.col("event_type") == "purchase", "rename").otherwise("add")
    e = frame(spark, sf, "events").select(F.concat(F.lit("b"), (F.col("user_id") % 40).cast("string")).alias("sha"), at(5).alias("path"), at(7).alias("new_path"), op.alias("op"), F.col("ts").alias("happened_at"), F.col("event_id").alias("id"))
    return lg.book_paths(e).select("sha", F.array_join("paths", ",").alias("paths"), "removed")


@query("SELECT id, CAST(row_number() OVER (PARTITION BY type ORDER BY priority DESC, created_at, id) AS INTEGER) AS turn FROM @jobs WHERE status = 'pending' AND created_at <= TIMESTAMP '2024-01-20 00:00:00'")
def b08_runnable(spark: SparkSession, sf: str) -> DataFrame:
    return lg.runnable(_jobs(spark, sf).withColumn("scheduled_after", F.col("created_at")), F.to_timestamp(F.lit(NOW))).select("id", "turn")


@query(f"SELECT cand, min(event_id) AS event_id FROM @review_log WHERE action = 'defer' AND decided_at + INTERVAL 7 DAYS < TIMESTAMP '{NOW}' GROUP BY 1 ORDER BY event_id, cand LIMIT 20")
def b07_due_for_review(spark: SparkSession, sf: str) -> DataFrame:
    due = _log(spark, sf).filter((F.col("action") == "defer") & (F.col("decided_at") + F.expr("INTERVAL 7 DAYS") < F.to_timestamp(F.lit(NOW))))
    return due.groupBy("cand").agg(F.min("event_id").alias("event_id")).orderBy("event_id", "cand").limit(20)


@query(f"SELECT event_id FROM @fetch_log WHERE fetched_at + INTERVAL 7 DAYS > TIMESTAMP '{NOW}'")
def b09_ttl_live(spark: SparkSession, sf: str) -> DataFrame:
    return _fetches(spark, sf).filter(F.col("fetched_at") + F.expr("INTERVAL 7 DAYS") > F.to_timestamp(F.lit(NOW))).select("event_id")


@query("SELECT id, coalesce(json_extract_string(payload_json, '$.path'), json_extract_string(payload_json, '$.k')) AS path FROM @jobs")
def f32_payload_path(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).select("id", F.coalesce(lg.payload_path(F.col("payload_json")), F.get_json_object("payload_json", "$.k")).alias("path"))


@query("SELECT id, round(duration, 1) AS seconds FROM @jobs WHERE status = 'done'")
def f33_duration(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).filter("status = 'done'").select("id", F.round("duration", 1).alias("seconds"))


@query("SELECT id, CASE WHEN attempts >= 4 THEN 'failed' ELSE 'pending' END AS next_status, CASE WHEN attempts < 4 THEN [1, 5, 30][greatest(attempts - 1, 0) + 1] END AS wait_s FROM @jobs WHERE status = 'failed'")
def f34_retry(spark: SparkSession, sf: str) -> DataFrame:
    return lg.retried(_jobs(spark, sf).filter("status = 'failed'"), F.to_timestamp(F.lit(NOW))).select("id", "next_status", "wait_s")


@query("SELECT id, type, (SELECT count(*) FROM @jobs) AS total FROM @jobs ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def o04_paging(spark: SparkSession, sf: str) -> DataFrame:
    return lg.page(_jobs(spark, sf), offset=40).select("id", "type", "total")


@query(f"SELECT pred_id, round(zscore, 6) AS zscore FROM ({_Z}) ORDER BY round(zscore, 6) DESC, pred_id LIMIT 50")
def o05_top_by_z(spark: SparkSession, sf: str) -> DataFrame:
    z = lg.zscores(frame(spark, sf, "predictions"), ["head", "rel"]).select("pred_id", F.round("zscore", 6).alias("zscore"))
    return z.orderBy(F.desc("zscore"), "pred_id").limit(50)


@query("SELECT head, rel, tail, CAST(row_number() OVER (PARTITION BY head, rel ORDER BY score DESC, tail, pred_id) AS INTEGER) AS rank FROM @predictions QUALIFY rank <= 3")
def o07_top_tails(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("head", "rel").orderBy(F.col("score").desc(), "tail", "pred_id")
    return frame(spark, sf, "predictions").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("head", "rel", "tail", "rank")


@query("SELECT id FROM @jobs WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 20")
def o08_last_failed(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf).filter("status = 'failed'").orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id")


@query("SELECT j.id, u.url FROM (SELECT id, json_extract_string(payload_json, '$.k') AS k FROM @jobs WHERE type = 'save_web') j LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS k, min(url) AS url FROM (SELECT event_id % 100 AS user_id, url FROM @fetch_log) GROUP BY 1) u USING (k)")
def c12_saved_url(spark: SparkSession, sf: str) -> DataFrame:
    urls = _fetches(spark, sf).groupBy((F.col("event_id") % 100).cast("string").alias("k")).agg(F.min("url").alias("url"))
    return _jobs(spark, sf).filter("type = 'save_web'").select("id", F.get_json_object("payload_json", "$.k").alias("k")).join(urls, "k", "left").select("id", "url")


@query("""WITH p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(event_id) AS event_id FROM (SELECT user_id AS a, user_id * 7 % 150 AS b, event_id FROM @events) WHERE a <> b GROUP BY 1, 2, event_id % 2 = 0),
old AS (SELECT a, b, min(event_id) AS event_id FROM p WHERE event_id % 2 = 0 GROUP BY 1, 2), new AS (SELECT a, b, min(event_id) AS event_id FROM p WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT a, b, event_id FROM old UNION ALL SELECT a, b, event_id FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.a = new.a AND old.b = new.b)""")
def u06_unordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of even events are stored; those of odd ones are put in unless they are there in either order."""
    p = frame(spark, sf, "events").select(F.col("user_id").alias("a"), (F.col("user_id") * 7 % 150).alias("b"), "event_id")
    stored_pairs = lg.insert_pairs(None, p.filter("event_id % 2 = 0"))
    return lg.insert_pairs(stored_pairs, p.filter("event_id % 2 = 1"))


@query("SELECT pred_id, score FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(pred_id AS VARCHAR) || 'seed')) AS r FROM @predictions) WHERE r <= 50")
def a16_review_sample(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "predictions").orderBy(F.md5(F.concat(F.col("pred_id").cast("string"), F.lit("seed")))).limit(50).select("pred_id", "score")


@query(f"""WITH d AS (SELECT CAST(coalesce(sum(triple_count) FILTER (op = 'add'), 0) AS DOUBLE) AS t, CAST(coalesce(sum(entity_diff) FILTER (op = 'add'), 0) AS DOUBLE) AS e, count(DISTINCT tier) FILTER (op = 'add') AS tiers FROM @delta_log WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')
SELECT round(t / 1000000 * 1000 + 1.5 * (e / 50000) * 500 + 0.5 * ln(tiers + 1) * 100 + 10 * ln(10 + 1), 6) AS score,
CASE WHEN t / 1000000 * 1000 + 1.5 * (e / 50000) * 500 + 0.5 * ln(tiers + 1) * 100 + 10 * ln(11) < 50 THEN 'skip' WHEN t / 1000000 * 1000 + 1.5 * (e / 50000) * 500 + 0.5 * ln(tiers + 1) * 100 + 10 * ln(11) < 500 THEN 'warm-start' WHEN t / 1000000 * 1000 + 1.5 * (e / 50000) * 500 + 0.5 * ln(tiers + 1) * 100 + 10 * ln(11) < 2000 THEN 'full' ELSE 'hpo' END AS tier FROM d""")
def l11_change_score(spark: SparkSession, sf: str) -> DataFrame:
    from semlake.operators import links as lk

    return lk.change_score(_delta(spark, sf), F.to_timestamp(F.lit("2024-01-10 00:00:00")), 1_000_000, 50_000, 10.0)
