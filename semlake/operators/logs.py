"""Logs and queues as DataFrames: jobs, versions, quotas, decisions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds to wait after the first, second and third failed attempt.
RETRY_SECONDS = (1, 5, 30)
MAX_ATTEMPTS = 4


def status_pivot(jobs: DataFrame) -> DataFrame:
    """One row: jobs by status, zero-filled, and their total."""
    states = ("pending", "running", "done", "failed")
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states], F.count("*").alias("total"))


def runnable(jobs: DataFrame, now: Column) -> DataFrame:
    """Pending jobs whose time has come, numbered by priority and age."""
    w = Window.partitionBy("type").orderBy(F.col("priority").desc(), "created_at", "id")
    return jobs.filter((F.col("status") == "pending") & (F.col("scheduled_after").isNull() | (F.col("scheduled_after") <= now))).withColumn("turn", F.row_number().over(w))


def retried(jobs: DataFrame, now: Column) -> DataFrame:
    """Failed attempts: failed for good after the last, else pending after a growing wait."""
    over = F.col("attempts") >= MAX_ATTEMPTS
    wait = F.get(F.array(*map(F.lit, RETRY_SECONDS)), F.greatest(F.col("attempts") - 1, F.lit(0)))
    return jobs.withColumns({"next_status": F.when(over, "failed").otherwise("pending"), "wait_s": F.when(~over, wait)}).withColumn("retry_at", F.when(~over, now + F.make_interval(secs=F.col("wait_s"))))


def payload_path(payload: Column) -> Column:
    keys = ("path", "url", "new_path", "doc_uri", "chunk_id")
    return F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit("")) for k in keys])


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a hash aggregate, without sorting a key's rows."""
    rest = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*key).agg(first).select(*key, "_r.*")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def version_chain(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(url, content_hash, fetched_at, event_id)`` -> fetches that changed the page, and the hashes of each url.

    Re-fetches with the hash of the fetch before are dropped; ``is_duplicate`` marks a hash the url had earlier.  The
    second table has ``(url, content_hash, place)``, hashes numbered by their first sighting: those before a fetch are
    places 1 to its ``n_previous``, so no row carries a list.
    """
    w = Window.partitionBy("url").orderBy("fetched_at", "event_id")
    kept = fetches.withColumn("_last", F.lag("content_hash").over(w)).filter(F.col("_last").isNull() | (F.col("_last") != F.col("content_hash"))).drop("_last")
    first = F.row_number().over(Window.partitionBy("url", "content_hash").orderBy("fetched_at", "event_id")) == 1
    kept = kept.withColumn("_first", first)
    before = F.coalesce(F.sum(F.col("_first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = kept.withColumn("n_previous", before)
    hashes = out.filter("_first").select("url", "content_hash", (F.col("n_previous") + 1).alias("place"))
    return out.withColumns({"is_update": F.col("n_previous") > 0, "is_duplicate": ~F.col("_first")}).drop("_first"), hashes


def with_previous(chain: DataFrame, hashes: DataFrame) -> DataFrame:
    """Fetches of :func:`version_chain` with the array ``previous``, a cut of their url's one array."""
    held = hashes.groupBy("url").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "content_hash"))), lambda x: x["content_hash"]).alias("_all"))
    return chain.join(held, "url").withColumn("previous", F.slice("_all", F.lit(1), F.col("n_previous").cast("int"))).drop("_all")


def quota(requests: DataFrame, limit: int) -> DataFrame:
    """``(event_id, fetched_at)`` -> number of the request in its UTC day, whether it is allowed, what is left."""
    day = F.to_date("fetched_at")
    w = Window.partitionBy("day").orderBy("fetched_at", "event_id")
    out = requests.withColumn("day", day).withColumn("used", F.row_number().over(w))
    return out.withColumns({"allowed": F.col("used") <= limit, "left": F.greatest(F.lit(0), limit - F.col("used"))})


def newest(rows: DataFrame, n: int, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("gen", F.row_number().over(w)).filter(F.col("gen") <= n)


def nightly_deferral(jobs: DataFrame, busy: int = 5) -> DataFrame:
    """Parse jobs in order: from the ``busy``-th waiting one of its user on, priority 1 and the next 03:00 UTC, else 10."""
    w = Window.partitionBy("user_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    waiting = F.coalesce(F.count_if(F.col("status") == "pending").over(w), F.lit(0))
    late = F.col("waiting") >= busy
    three = F.date_trunc("day", "created_at") + F.expr("INTERVAL 3 HOURS")
    at = F.when(three > F.col("created_at"), three).otherwise(three + F.expr("INTERVAL 1 DAY"))
    return jobs.withColumn("waiting", waiting).withColumns({"new_priority": F.when(late, 1).otherwise(10), "after": F.when(late, at)})


def zscores(preds: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """``zscore`` of each row in its group, population deviation, 1 where that is 0."""
    w = Window.partitionBy(*by)
    std = F.stddev_pop(score).over(w)
    return preds.withColumn("zscore", (F.col(score) - F.avg(score).over(w)) / F.when(std > 0, std).otherwise(1.0))


def quota_take(preds: DataFrame, reviewed: DataFrame, regrow: float = 0.30) -> DataFrame:
    """The first predictions of each entity by z-score, as many as its quota allows; reviewed ones are skipped unless
    their score grew.  ``reviewed(head, rel, tail, old_score)``."""
    z = zscores(preds, ["head", "rel"]).withColumn("zscore", F.round("zscore", 9))  # ladder steps aren't missed by a last bit
    top = F.max("zscore").over(Window.partitionBy("head"))
    quota_ = F.when(top >= 3, 7).when(top >= 2, 5).when(top >= 1, 3).otherwise(1)
    known = z.withColumn("quota", quota_).join(reviewed, ["head", "rel", "tail"], "left")
    fresh = known.filter(F.col("old_score").isNull() | (F.col("score") - F.col("old_score") >= regrow))
    return fresh.withColumn("n", F.row_number().over(Window.partitionBy("head").orderBy(F.col("zscore").desc(), "pred_id"))).filter(F.col("n") <= F.col("quota"))


def entity_type(uri: Column) -> Column:
    return F.when(uri.contains("urn:note:"), "note").when(uri.contains("urn:tag:"), "tag").when(uri.contains("urn:wd:") | uri.contains("wikidata.org"), "wikidata").otherwise("concept")


def surface(preds: DataFrame, reviewed: DataFrame, cap: int) -> DataFrame:
    """Link predictions to show: :func:`quota_take`, then turns between entity types up to ``cap``."""
    typed = quota_take(preds, reviewed).withColumn("entity_type", entity_type(F.col("head")))
    # within a type only the first ``cap`` can be shown, so the last ordering sees a few rows of each type
    turn = typed.withColumn("turn", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.round(F.col("zscore"), 6).desc(), "pred_id"))).filter(F.col("turn") <= cap)
    return turn.orderBy("turn", "entity_type").limit(cap)


def latest_decision(log: DataFrame, key: str = "cand") -> DataFrame:
    return log.groupBy(key).agg(F.max_by(F.struct("action", "decided_at", "score"), F.struct("decided_at", "event_id")).alias("d")).select(key, "d.*")


def apply_decisions(candidates: DataFrame, log: DataFrame, key: str = "cand") -> DataFrame:
    """Candidates with the status their latest decision gives; deferral holds for seven days."""
    d = latest_decision(log, key)
    out = candidates.join(d, key, "left")
    status = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").when(F.col("action") == "defer", "deferred").otherwise("pending")
    return out.withColumns({"status": status, "defer_until": F.when(F.col("action") == "defer", F.col("decided_at") + F.expr("INTERVAL 7 DAYS"))})


def book_paths(events: DataFrame) -> DataFrame:
    """Path events ``(sha, path, op, happened_at, id)`` with op add, remove or rename -> ``(sha, paths, removed)`` by the
    latest of each path.

    A rename has the new path in ``new_path``: the old one goes and the new one comes, also where the old one wasn't
    there; a path renamed to itself is there afterwards.
    """
    new = F.col("new_path") if "new_path" in events.columns else F.lit(None).cast("string")
    step = lambda path, op, no: F.struct(path.alias("path"), F.lit(op).alias("op"), F.lit(no).alias("no"))
    path = F.col("path")
    steps = F.when(F.col("op") == "rename", F.array(step(path, "remove", 0), step(new, "add", 1))).when(F.col("op") == "add", F.array(step(path, "add", 0))).otherwise(F.array(step(path, "remove", 0)))
    single = events.select("sha", "happened_at", "id", F.explode(steps).alias("e")).select("sha", "happened_at", "id", "e.*").filter("path is not null")
    last = last_wins(single, ["sha", "path"], ["happened_at", "id", "no"])
    return last.groupBy("sha").agg(F.array_sort(F.collect_set(F.when(F.col("op") == "add", F.col("path")))).alias("paths")).withColumn("removed", F.size("paths") == 0)


def weekly_cap(decisions: DataFrame, by: str = "cand", cap: int = 50) -> DataFrame:
    """``decisions(by, decided_at, action)`` with ``cap``: what the approvals of the seven days up to each leave of it."""
    at = F.unix_micros(F.col("decided_at").cast("timestamp"))
    week = Window.partitionBy(by).orderBy(at).rangeBetween(-7 * 86_400_000_000, Window.currentRow)
    return decisions.withColumn("cap", F.greatest(F.lit(0), F.lit(cap) - F.count(F.when(F.col("action") == "approve", 1)).over(week)))


def insert_pairs(stored: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """Insert-or-ignore of unordered pairs: ``pairs(a, b, ...)`` whose two ends differ go to ``stored`` unless the pair is
    there in either order; of equal new pairs the row with the least other columns counts."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    ends = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest)
    new = ends.groupBy("a", "b").agg(F.min(F.struct(*rest)).alias("_r")).select("a", "b", "_r.*") if rest else ends.distinct()
    return new if stored is None else stored.unionByName(new.join(stored.select("a", "b"), ["a", "b"], "left_anti"))


def page(rows: DataFrame, newest: str = "created_at", key: str = "id", offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of ``rows``, newest first and ties by larger key, with ``total``, the count of all rows."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(F.desc(newest), F.desc(key)).offset(offset).limit(limit).withColumn("total", total)


def record_delta(changes: DataFrame, path: str) -> None:
    """Changed triples ``(ts, tier, op, s)`` appended to the delta log at ``path``: a row for each time, tier and op with
    ``triple_count`` and ``entity_diff``, the number of distinct subjects, negative for removals."""
    n = F.countDistinct("s")
    rows = changes.groupBy("ts", "tier", "op").agg(F.count("*").alias("triple_count"), n.alias("n"))
    rows.select("ts", "tier", "op", "triple_count", F.when(F.col("op") == "remove", -F.col("n")).otherwise(F.col("n")).alias("entity_diff")).write.mode("append").parquet(path)


def deltas_since(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Rows of the delta log from ``since`` on, by time."""
    log = spark.read.parquet(path)
    return log.filter(F.col("ts") >= F.lit(since).cast("timestamp")).orderBy("ts", "tier", "op")
