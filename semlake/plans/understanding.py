"""Queries over questions, answers and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.fixtures import frame
from semlake.operators import understanding as un
from semlake.plans.registry import query

YEAR = 2026


def _d(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "decorated")


_KNOWN = "|".join(un.COMMANDS)
_NAMES = "list_filter(regexp_extract_all(text, '/([a-z][\\p{L}\\p{N}_-]*)(:([^\\s]+))?', 1), lambda x: list_contains([" + ", ".join(f"'{c}'" for c in un.COMMANDS) + "], x))"


@query(f"SELECT id, array_to_string({_NAMES}, ',') AS names FROM @decorated")
def q01_commands(spark: SparkSession, sf: str) -> DataFrame:
    return _d(spark, sf).select("id", F.array_join(F.transform(un.commands(F.col("text")), lambda c: c["name"]), ",").alias("names"))


@query("SELECT id, trim(regexp_replace(regexp_replace(text, '^/(scope:src1,src2|no-web /deep) ', '', 'g'), '\\s{2,}', ' ', 'g')) AS clean FROM @decorated")
def q01_clean_query(spark: SparkSession, sf: str) -> DataFrame:
    return _d(spark, sf).select("id", un.without_commands(F.col("text")).alias("clean"))


@query("SELECT id, id % 7 = 1 AS no_web, id % 7 = 1 AS deep, CASE WHEN id % 7 = 0 THEN 'src1,src2' END AS scope FROM @decorated")
def q02_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = _d(spark, sf).select("id", un.flags(un.commands(F.col("text"))).alias("f"))
    return f.select("id", "f.no_web", "f.deep", F.array_join("f.vault_scope", ",").alias("scope"))


def _score_sql(k: str) -> str:
    s, words = un.WORDS[k]
    return f"CASE WHEN {' OR '.join(f'contains(q, $${w}$$)' for w in words)} THEN {s} ELSE 0 END".replace("$$", "'")


_INTENT = f"""
b AS (SELECT id, text, trim(lower(text)) AS q FROM @decorated),
y AS (SELECT *, list_transform(regexp_extract_all(q, '(^|[^\\p{{L}}\\p{{N}}_])((19|20)[0-9]{{2}})($|[^\\p{{L}}\\p{{N}}_])', 2), lambda x: CAST(x AS INTEGER)) AS years FROM b),
s AS (SELECT id, greatest({_score_sql('lookup')}, CASE WHEN len(years) > 0 OR regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{2,4}}($|[^\\p{{L}}\\p{{N}}_])') THEN 0.5 ELSE 0 END) AS lookup0, greatest({_score_sql('multi_hop')}, CASE WHEN regexp_matches(text, '\\[\\[.+?\\]\\]') THEN 0.85 ELSE 0 END) AS multi_hop,
  {_score_sql('personal')} AS personal, {_score_sql('educational')} AS educational, greatest({_score_sql('fresh')}, CASE WHEN len(list_filter(years, lambda x: x >= {YEAR - 1})) > 0 THEN 0.6 ELSE 0 END) AS fresh,
  {_score_sql('comparison')} AS comparison,
  greatest({_score_sql('refusal')}, CASE WHEN len(string_split_regex(q, '\\s+')) <= 1 AND regexp_matches(q, '[^\\p{{L}}\\p{{N}}_\\s?.,\\-!:;()\\[\\]]') THEN 0.6 ELSE 0 END) AS refusal FROM y),
sc AS (SELECT *, CASE WHEN greatest(lookup0, multi_hop, personal, educational, fresh, comparison, refusal) = 0 THEN 0.4 ELSE lookup0 END AS lookup FROM s)"""


@query(f"WITH {_INTENT} SELECT id, " + ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in un.INTENTS) + " FROM sc")
def q03_intent_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = un.intent_scores(F.col("text"), YEAR)
    return _d(spark, sf).select("id", *[s[k].alias(k) for k in un.INTENTS])


@query(f"""WITH {_INTENT}, m AS (SELECT *, greatest(lookup, multi_hop, personal, educational, fresh, comparison, refusal) AS top FROM sc)
SELECT id, CASE top WHEN lookup THEN 'lookup' WHEN multi_hop THEN 'multi_hop' WHEN personal THEN 'personal' WHEN educational THEN 'educational' WHEN fresh THEN 'fresh' WHEN comparison THEN 'comparison' ELSE 'refusal' END AS intent,
  top >= 0.8 AS skips_model FROM m""")
def q04_best_intent(spark: SparkSession, sf: str) -> DataFrame:
    b = _d(spark, sf).select("id", un.best_intent(F.col("text"), YEAR).alias("b"))
    return b.select("id", "b.intent", (F.col("b.score") >= 0.8).alias("skips_model"))


@query(f"""WITH {_INTENT}, m AS (SELECT *, greatest(lookup, multi_hop, personal, educational, fresh, comparison, refusal) AS top FROM sc),
i AS (SELECT id, CASE top WHEN lookup THEN 'lookup' WHEN multi_hop THEN 'multi_hop' WHEN personal THEN 'personal' WHEN educational THEN 'educational' WHEN fresh THEN 'fresh' WHEN comparison THEN 'comparison' ELSE 'refusal' END AS intent FROM m)
SELECT intent, count(*) AS n, CAST(CASE intent WHEN 'lookup' THEN 0.7 WHEN 'multi_hop' THEN 1.0 WHEN 'personal' THEN 1.0 WHEN 'educational' THEN 0.6 WHEN 'fresh' THEN 0.5 WHEN 'comparison' THEN 0.8 ELSE 0.0 END AS DOUBLE) AS notes FROM i GROUP BY 1""")
def c19_q06_channel_weights(spark: SparkSession, sf: str) -> DataFrame:
    i = _d(spark, sf).select(un.best_intent(F.col("text"), YEAR)["intent"].alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))
    return i.withColumn("notes", un.channel_weights(F.col("intent"))["notes"])


_WEIGHT = "CASE item_id % 7 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(7)) + " END"
_WEB, _LISTED = "item_id % 3 = 0", "CASE item_id % 4 WHEN 0 THEN ['notes', 'books'] WHEN 1 THEN ['web'] ELSE NULL END"


def _weight_sql(channel: str) -> str:
    at = un.CHANNELS.index(channel)
    return _WEIGHT.format(*[f"CAST({un.CHANNEL_WEIGHTS[k][at]} AS DOUBLE)" for k in un.INTENTS])


def _override_sql(channel: str) -> str:
    w = f"({_weight_sql(channel)})"
    kept = f"CASE WHEN {_WEB} THEN greatest({w}, 1) WHEN {w} = 0 THEN NULL ELSE {w} END" if channel == "web" else w
    return f"CASE WHEN ({kept}) IS NULL THEN NULL WHEN ({_LISTED}) IS NULL THEN {kept} WHEN list_contains({_LISTED}, '{channel}') THEN greatest({kept}, 1) ELSE 0 END AS {channel}"


@query(f"SELECT item_id AS id, {', '.join(_override_sql(c) for c in un.CHANNELS)} FROM @benchmark")
def q06_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of every intent under every mix of a forced web and an allow-list."""
    i = F.col("item_id")
    intent = F.get(F.array(*map(F.lit, un.INTENTS)), (i % 7).cast("int"))
    listed = F.when(i % 4 == 0, F.array(F.lit("notes"), F.lit("books"))).when(i % 4 == 1, F.array(F.lit("web")))
    d = frame(spark, sf, "benchmark").select(i.alias("id"), un.overridden(un.channel_weights(intent), i % 3 == 0, listed).alias("w"))
    return d.select("id", *[F.col("w")[c].alias(c) for c in un.CHANNELS])


@query("SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 3 THEN NULL ELSE 'fresh' END AS intent FROM @decorated")
def q05_router_json(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    raw = F.when(i % 5 == 0, "{broken").when(i % 7 == 3, '{"intent": "other"}').otherwise('{"intent": "fresh", "entities": ["a"], "web_safe_query": "q"}')
    return _d(spark, sf).select("id", un.router_decision(raw)["intent"].alias("intent"))


_W = "[^\\p{L}\\p{N}_]"


@query("""WITH w AS (SELECT id, unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '\\[\\[[^\\]]+\\]\\]', '', 'g'), '(^|[^\\p{L}\\p{N}_])#[a-zA-Zа-яА-ЯёЁ][a-zA-Zа-яА-ЯёЁ0-9_-]+', '\\1', 'g'), '[\\p{L}\\p{N}_]+')) AS t FROM @decorated),
p AS (SELECT id, count(*) AS n FROM w WHERE lower(t) IN ('i', 'me', 'my', 'mine', 'myself', 'our', 'ours', 'we', 'us') GROUP BY 1)
SELECT d.id, CAST(coalesce(n, 0) + len(regexp_extract_all(text, '\\[\\[[^\\]]+\\]\\]')) + len(regexp_extract_all(regexp_replace(text, '\\[\\[[^\\]]+\\]\\]', '', 'g'), '(^|[^\\p{L}\\p{N}_])#[a-zA-Zа-яА-ЯёЁ][a-zA-Zа-яА-ЯёЁ0-9_-]+')) AS INTEGER) AS n_blocked FROM @decorated d LEFT JOIN p ON p.id = d.id""")
def q07_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    return _d(spark, sf).select("id", un.sanitise(F.col("text"))["n_blocked"].alias("n_blocked"))


@query("""WITH k AS (SELECT c_custkey AS c FROM @customer WHERE c_custkey % 3 <> 0), o AS (SELECT *, o_custkey IN (SELECT c FROM k) AS a, o_custkey + 1 IN (SELECT c FROM k) AS b FROM @orders)
SELECT o_orderkey AS id, 'order of ' || CASE WHEN a THEN '[ANON]' ELSE 'CUSTOMER#' || lpad(CAST(o_custkey AS STRING), 9, '0') END || ' and ' || CASE WHEN b THEN '[ANON]' ELSE 'customer#' || lpad(CAST(o_custkey + 1 AS STRING), 9, '0') END || ' for [ANON] ' || o_orderpriority AS clean,
  CAST(2 + CAST(a AS INTEGER) + CAST(b AS INTEGER) AS INTEGER) AS n_blocked, false AS is_safe FROM o""")
def q07_sanitise_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The clean text of every order's note, with two thirds of all customers on the list."""
    listed = frame(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("entity"))
    note = "'order [[' || o_orderkey || ']] of CUSTOMER#' || lpad(o_custkey, 9, '0') || ' and  customer#' || lpad(o_custkey + 1, 9, '0') || ' for my ' || o_orderpriority AS text"
    return un.sanitise_with(frame(spark, sf, "orders").selectExpr("o_orderkey AS id", note), listed).select("id", "clean", "n_blocked", "is_safe")


@query("SELECT conv_id AS answer_id, CAST(turn AS INTEGER) AS idx, CASE WHEN turn % 2 = 0 THEN 'negation' ELSE 'factual' END AS claim_type, CASE WHEN turn % 3 = 0 THEN '1' ELSE '1,2' END AS refs FROM @conversations")
def q08_claims(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    one = F.struct(F.substring("text", 1, 20).alias("text"), F.when(t % 3 == 0, F.array(F.lit("1"), F.lit("x"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("refs"), F.when(t % 2 == 0, "negation").otherwise("odd").alias("type"))
    raw = frame(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", one.alias("c")))), lambda x: x["c"]).alias("claims"))
    c = un.claims(raw.select(F.col("conv_id").alias("answer_id"), F.to_json(F.struct("claims")).alias("raw_json")))
    return c.select("answer_id", "idx", "claim_type", F.array_join("refs", ",").alias("refs"))


@query("SELECT conv_id AS answer_id, turn AS idx, CASE turn % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS verdict, turn % 4 <> 0 AS warning FROM @conversations")
def c14_q09_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    conv = frame(spark, sf, "conversations")
    c = conv.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("idx"))
    v = conv.filter("turn % 4 < 3").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("idx"), F.when(F.col("turn") % 4 == 0, "full").when(F.col("turn") % 4 == 1, "partial").otherwise("bad").alias("verdict"))
    return un.verdicts(c, v).select("answer_id", "idx", "verdict", "warning")


@query("""WITH cl AS (SELECT conv_id AS answer_id, turn AS idx, CASE WHEN turn % 4 = 3 THEN CAST([] AS BIGINT[]) ELSE [turn + 1, turn - 1, 99] END AS refs FROM @conversations),
rf AS (SELECT answer_id, idx, unnest(refs) AS ref, unnest(range(len(refs))) AS no FROM cl),
jn AS (SELECT answer_id, idx, count(*) AS n, string_agg(ref || '=' || substr(text, 1, 300), '|' ORDER BY no) AS q FROM rf JOIN (SELECT conv_id AS answer_id, turn AS ref, min(text) AS text FROM @conversations WHERE text <> '' GROUP BY 1, 2) USING (answer_id, ref) GROUP BY 1, 2)
SELECT answer_id, idx, coalesce(n, 0) AS n_quotes, sha256(coalesce(q, '')) AS quotes FROM cl LEFT JOIN jn USING (answer_id, idx)""")
def c15_claim_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn claims what its neighbours say; a fourth of them cite nothing, and ref 99 has no snippet."""
    c, turn = frame(spark, sf, "conversations").withColumnRenamed("conv_id", "answer_id"), F.col("turn").cast("int")
    refs = F.when(turn % 4 == 3, F.array().cast("array<int>")).otherwise(F.array(turn + 1, turn - 1, F.lit(99)))
    found = un.claim_quotes(c.select("answer_id", F.col("turn").alias("idx"), refs.alias("refs")), c.select("answer_id", turn.alias("ref"), F.col("text").alias("snippet")))
    quotes = F.array_join(F.transform("quotes", lambda q: F.concat(q["ref"].cast("string"), F.lit("="), q["quote"])), "|")
    return found.select("answer_id", "idx", F.size("quotes").cast("long").alias("n_quotes"), F.sha2(quotes, 256).alias("quotes"))


@query("SELECT a.id, a.turn, coalesce(nullif(a.source_path, ''), b.rel_path) AS path, coalesce(nullif(b.source_id, ''), a.source_id) AS source FROM @citations a LEFT JOIN @gold b ON a.id = b.id AND a.turn = b.turn")
def c16_citation_merge(spark: SparkSession, sf: str) -> DataFrame:
    g = frame(spark, sf, "gold").select("id", "turn", "rel_path", F.col("source_id").alias("gs"))
    out = frame(spark, sf, "citations").join(g, ["id", "turn"], "left")
    return out.select("id", "turn", F.coalesce(F.nullif("source_path", F.lit("")), "rel_path").alias("path"), F.coalesce(F.nullif("gs", F.lit("")), "source_id").alias("source"))


_CHECKED = "CASE WHEN conv_id % 3 = 0 THEN 'factual' ELSE 'negation' END AS claim_type, CASE turn % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' WHEN 2 THEN 'full' ELSE 'none' END AS verdict"


@query(f"""WITH v AS (SELECT conv_id * 1000 + turn AS claim_id, conv_id, {_CHECKED} FROM @conversations), f AS (SELECT id * 1000 + turn // 2 AS claim_id, count(DISTINCT source_id) AS n FROM @citations WHERE id % 4 <> 0 GROUP BY 1)
SELECT v.claim_id, CASE WHEN d AND n >= 2 THEN 'full' ELSE verdict END AS verdict, verdict <> 'full' AND NOT (d AND coalesce(n, 0) >= 2) AS warning, CASE WHEN d AND n = 1 THEN 'r [cross-source: contradiction possible]' ELSE 'r' END AS reasoning
FROM (SELECT *, claim_type = 'negation' AND verdict IN ('none', 'partial') AS d FROM v) v LEFT JOIN f ON f.claim_id = v.claim_id""")
def q11_cross_source(spark: SparkSession, sf: str) -> DataFrame:
    v = frame(spark, sf, "conversations").selectExpr("conv_id * 1000 + turn AS claim_id", *_CHECKED.replace("END AS claim_type, ", "END AS claim_type|").split("|"), "'r' AS reasoning").withColumn("warning", F.col("verdict") != "full")
    found = frame(spark, sf, "citations").filter("id % 4 <> 0").select((F.col("id") * 1000 + F.floor(F.col("turn") / 2)).alias("claim_id"), "source_id")
    return un.cross_checked(v, found).select("claim_id", "verdict", "warning", "reasoning")


@query("""SELECT id, CASE WHEN id % 11 = 5 THEN 'no-check' WHEN category = 'privacy' THEN 'intent=personal' WHEN contains(lower(answer), 'i cannot') OR contains(lower(answer), 'cannot answer') OR contains(lower(answer), 'no information') THEN 'refusal'
WHEN id % 5 = 3 THEN 'empty_z1' END AS skip FROM @results""")
def q12_skip_rules(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    command = F.concat(F.when(i % 11 == 5, "/no-check ").otherwise("/deep "), "category")
    z1 = F.when(i % 5 == 3, F.when(i % 2 == 1, " \n")).otherwise(F.col("answer"))
    intent = F.when(F.col("category") == "privacy", "personal").otherwise(F.col("category"))
    return frame(spark, sf, "results").select("id", un.skip_reason(un.flags(un.commands(command))["no_check"], intent, F.col("answer"), z1).alias("skip"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS z1 FROM @conversations WHERE role = 'assistant' GROUP BY 1")
def q13_answer_text(spark: SparkSession, sf: str) -> DataFrame:
    g = frame(spark, sf, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), "\n\n"), 256).alias("z1"))


_RECALL = """
h AS (SELECT g.id, (g.source_id <> '' AND EXISTS (SELECT 1 FROM @citations c WHERE c.id = g.id AND c.source_id = g.source_id))
  OR (g.rel_path <> '' AND EXISTS (SELECT 1 FROM @citations c WHERE c.id = g.id AND (contains(c.source_path, g.rel_path) OR contains(c.source_id, g.rel_path)))) AS hit FROM @gold g),
rc AS (SELECT id, avg(CAST(hit AS INTEGER)) AS recall FROM h GROUP BY 1)"""


@query(f"WITH {_RECALL} SELECT id, round(recall, 6) AS recall FROM rc")
def m01_must_include_recall(spark: SparkSession, sf: str) -> DataFrame:
    return un.gold_recall(frame(spark, sf, "gold"), frame(spark, sf, "citations")).select("id", F.round("recall", 6).alias("recall"))


_REF = "(" + " OR ".join(f"contains(lower(answer), '{m}')" for m in un.REFUSALS) + ")"


@query(f"""WITH {_RECALL}, j AS (SELECT r.*, coalesce(recall, 1.0) AS rec, {_REF} AS refused FROM @results r LEFT JOIN rc ON rc.id = r.id)
SELECT count(*) AS total, CAST(count_if(status = 'ok') AS BIGINT) AS ok, CAST(count_if(status <> 'ok') AS BIGINT) AS error, (SELECT list_sort(list(latency_ms))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] FROM @results WHERE latency_ms > 0) AS latency_p95_ms, round(avg(rec), 4) AS must_include_recall, round(avg(CAST(NOT unverified AS INTEGER)), 4) AS faithfulness,
round(coalesce(avg(CASE WHEN category = 'refusal' THEN CAST(refused AS INTEGER) END), 1.0), 4) AS refusal_correctness, round(coalesce(avg(CASE WHEN category = 'privacy' THEN CAST(NOT refused AS INTEGER) END), 0.0), 4) AS leak_rate FROM j""")
def m05_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return un.run_summary(frame(spark, sf, "results"), un.gold_recall(frame(spark, sf, "gold"), frame(spark, sf, "citations")))


@query(f"SELECT id, {_REF} AS refused FROM @results")
def m03_refusals(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "results").select("id", un.is_refusal(F.col("answer")).alias("refused"))


@query("""WITH a AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(avg(latency_ms) AS DOUBLE) AS mean FROM @results WHERE id % 2 = 0), b AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(max(latency_ms) AS DOUBLE) AS top FROM @results WHERE id % 2 = 1),
la AS (SELECT 'n' AS metric, n AS a FROM a UNION ALL SELECT 'mean', mean FROM a), lb AS (SELECT 'n' AS metric, n AS b FROM b UNION ALL SELECT 'top', top FROM b)
SELECT metric, a, b, round(b - a, 6) AS delta FROM la FULL JOIN lb USING (metric)""")
def m06_metric_delta(spark: SparkSession, sf: str) -> DataFrame:
    r = frame(spark, sf, "results")
    a = r.filter("id % 2 = 0").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean"))
    b = r.filter("id % 2 = 1").agg(F.count("*").alias("n"), F.max("latency_ms").alias("top"))
    return un.metric_delta(a, b)


@query("""WITH t AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(a = b AS INTEGER)) AS po FROM @ratings), pa AS (SELECT a AS c, count(*) AS na FROM @ratings GROUP BY 1), pb AS (SELECT b AS c, count(*) AS nb FROM @ratings GROUP BY 1),
e AS (SELECT sum(na * nb) AS agree FROM pa JOIN pb USING (c)), k AS (SELECT n, (po - agree / (n * n)) / (1 - agree / (n * n)) AS kappa FROM t, e)
SELECT CAST(n AS BIGINT) AS n, round(kappa, 6) AS kappa, CASE WHEN kappa < 0 THEN 'worse_than_chance' WHEN kappa < 0.2 THEN 'slight' WHEN kappa < 0.4 THEN 'fair' WHEN kappa < 0.6 THEN 'moderate' WHEN kappa < 0.8 THEN 'substantial' ELSE 'almost_perfect' END AS label FROM k""")
def m07_f37_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return un.kappa(frame(spark, sf, "ratings"))


@query("SELECT g.category, count(*) AS n, CAST(count_if(g.status = 'error') AS BIGINT) AS errors FROM @results g GROUP BY 1")
def m08_m09_category_report(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "results").groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"))


@query("""WITH j AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'S' || id ELSE 'name ' || id END AS name, status, latency_ms, answer FROM @results)
SELECT 'S' || id AS id, CASE WHEN status = 'ok' THEN 'OK' ELSE 'ERROR' END AS status, CASE WHEN status = 'ok' THEN '[OK]  S' || id || ' — ' || name ELSE '[ERR] S' || id || ' — unknown' END AS line,
  sha256('## S' || id || ' — ' || name || chr(10) || '- Status: ' || CASE WHEN status = 'ok' THEN 'OK' ELSE 'ERROR' END || chr(10) || '- Latency: ' || latency_ms || ' ms' || chr(10) || '- Answer (first 200 chars): ' || substring(answer, 1, 200) || chr(10)) AS digest FROM j""")
def m08_sentinel_report(spark: SparkSession, sf: str) -> DataFrame:
    r = frame(spark, sf, "results").withColumns({"id": F.concat(F.lit("S"), F.col("id").cast("string")), "no": F.col("id"), "error": F.lit(None).cast("string")})
    sentinels = r.select("id", F.when(F.col("no") % 3 != 0, F.concat(F.lit("name "), F.col("no").cast("string"))).alias("name"))
    return un.sentinel_report(sentinels, r).select("id", "status", "line", F.sha2("section", 256).alias("digest"))


@query("""WITH r AS (SELECT id, category, CASE id % 7 WHEN 0 THEN NULL ELSE [id % 2 = 0, true, id % 3 = 0] END AS cv FROM @results)
SELECT category, round(avg(CASE WHEN id % 7 = 0 THEN NULL WHEN id % 4 = 1 THEN 0.5 ELSE (1 + CAST(id % 2 = 0 AS INT) + CAST(id % 3 = 0 AS INT)) / 3 END), 6) AS coverage, CAST(sum(len(list_filter(cv, lambda x: x))) AS BIGINT) AS n_covered, CAST(sum(len(cv)) AS BIGINT) AS n_facts,
round(avg(CASE WHEN id % 8 BETWEEN 1 AND 5 THEN id % 8 END), 6) AS relevance, round(avg(CASE WHEN id % 9 <> 4 THEN CAST(id % 2 AS INT) END), 6) AS hallucinated, round(avg(CASE WHEN id % 9 <> 4 THEN (id % 5) / 4 END), 6) AS hallucination_rate FROM r GROUP BY 1""")
def m10_judge_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Three judges for each result: some responses are no JSON, some lack the fraction, some scores are out of range."""
    r, i = frame(spark, sf, "results"), F.col("id")
    coverage = F.to_json(F.struct(F.array(i % 2 == 0, F.lit(True), i % 3 == 0).alias("covered"), F.when(i % 4 == 1, 0.5).alias("coverage_fraction")))
    score = F.to_json(F.struct((i % 8).alias("score"), F.lit("as said").alias("rationale")))
    fiction = F.to_json(F.struct((i % 2 == 1).alias("hallucination_detected"), (i % 5 / 4).alias("hallucination_rate")))
    said = F.array(*[F.struct(F.lit(j).alias("judge"), c.alias("response")) for j, c in (("coverage", F.when(i % 7 == 0, "Sorry, {").otherwise(coverage)), ("relevance", score), ("hallucination", F.when(i % 9 == 4, "").otherwise(fiction)))])
    raw = r.select(i.alias("answer_id"), F.explode(said).alias("s")).select("answer_id", "s.*")
    run = un.judged(raw).join(r.select(i.alias("answer_id"), "category"), "answer_id")
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    return run.groupBy("category").agg(mean("coverage"), F.sum(F.col("n_covered").cast("long")).alias("n_covered"), F.sum(F.col("n_facts").cast("long")).alias("n_facts"), mean("relevance"), F.round(F.avg(F.col("hallucinated").cast("int")), 6).alias("hallucinated"), mean("hallucination_rate"))
