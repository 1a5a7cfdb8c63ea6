"""Questions and answers: commands, intent, sanitising, claims, verdicts, metrics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semlake.sources.scratch import bounded_batches

#: The commands, the intents in tie order, their words and scores.
COMMANDS = ["scope", "web", "no-web", "strict", "explain", "no-check", "deep", "explore", "save-web", "sources"]
INTENTS = ["lookup", "multi_hop", "personal", "educational", "fresh", "comparison", "refusal"]
WORDS = {
    "lookup": (0.75, ["что такое", "определение", "когда", "кто такой", "кто написал", "дата", "когда был", "год", "в каком", "who is", "what is", "when was"]),
    "multi_hop": (0.65, ["связь", "связано", "как связаны", "относится к", "между", "взаимосвязь", "общие темы", "common themes", "в контексте", "hidden links"]),
    "personal": (0.85, ["я писал", "мои заметки", "у меня есть", "я думал", "мой", "мои", "я изучал", "я читал", "я работал", "в моих", "по моим", "в своих", "my notes", "i wrote", "i was thinking"]),
    "educational": (0.75, ["объясни", "как работает", "расскажи о", "объяснить", "научи", "разберись", "помоги понять", "explain", "how does", "tutorial"]),
    "fresh": (0.65, ["последние новости", "актуально", "сейчас", "текущий", "новый", "latest", "recent", "current", "today", "news"]),
    "comparison": (0.75, ["отличие", "разница", "сравни", "vs", "versus", "чем отличается", "сравнение", "compare", "difference between", "pros and cons"]),
    "refusal": (0.9, ["ignore previous", "ignore all", "system prompt", "jailbreak", "забудь всё", "forget all instructions", "act as", "pretend you are"]),
}
#: Weights of the channels by intent, the channels in that order, words of refusals and pronouns.
CHANNEL_WEIGHTS = {
    "lookup": (0.7, 0.5, 0.8, 0.0),
    "multi_hop": (1.0, 0.7, 0.3, 0.0),
    "personal": (1.0, 0.3, 0.0, 0.0),
    "educational": (0.6, 0.9, 0.5, 0.0),
    "fresh": (0.5, 0.2, 0.3, 0.8),
    "comparison": (0.8, 0.8, 0.6, 0.0),
    "refusal": (0.0, 0.0, 0.0, 0.0),
}
CHANNELS = ("notes", "books", "wikidata", "web")
REFUSALS = ["не могу", "не нашёл", "нет данных", "нет информации", "отказываю", "не удалось", "i cannot", "no information", "cannot answer", "не буду", "отклонено"]
RU_PRONOUNS = "я|мне|меня|мой|моя|моё|мои|моим|моей|моих|моему|моею|нашего|наш|наша|наше|наши"
EN_PRONOUNS = "i|me|my|mine|myself|our|ours|we|us"
_COMMAND = r"/([a-z][\p{L}\p{N}_-]*)(?::([^\s]+))?"


def commands(text: Column) -> Column:
    """``array<struct<name, args array>>`` of the known commands, in order."""
    names = F.regexp_extract_all(text, F.lit(_COMMAND), F.lit(1))
    args = F.regexp_extract_all(text, F.lit(_COMMAND), F.lit(2))
    cut = lambda a: F.filter(F.transform(F.split(a, ","), lambda x: F.trim(x)), lambda x: x != "")
    both = F.zip_with(names, args, lambda n, a: F.struct(n.alias("name"), cut(a).alias("args")))
    return F.filter(both, lambda c: c["name"].isin(COMMANDS))


def without_commands(text: Column) -> Column:
    known = rf"/(?:{'|'.join(COMMANDS)})(?![\p{{L}}\p{{N}}_-])(?::[^\s]+)?"
    return F.trim(F.regexp_replace(F.regexp_replace(text, known, ""), r"\s{2,}", " "))


def flags(found: Column) -> Column:
    """Commands -> a struct of the context they leave: the last of web and no-web wins."""
    has = lambda n: F.exists(found, lambda c: c["name"] == n)
    last = lambda names: F.element_at(F.filter(found, lambda c: c["name"].isin(names)), -1)["name"]
    args = lambda n: F.get(F.reverse(F.filter(found, lambda c: (c["name"] == n) & (F.size(c["args"]) > 0))), F.lit(0))["args"]
    web = F.when(F.exists(found, lambda c: c["name"].isin("web", "no-web")), last(["web", "no-web"]))
    return F.struct(
        F.coalesce(web == "web", F.lit(False)).alias("force_web"),
        F.coalesce(web == "no-web", F.lit(False)).alias("no_web"),
        has("deep").alias("deep"),
        has("explore").alias("explore"),
        has("strict").alias("strict"),
        has("sources").alias("sources_only"),
        has("no-check").alias("no_check"),
        args("scope").alias("vault_scope"),
        args("sources").alias("sources_filter"),
        F.get(args("save-web"), F.lit(0)).alias("save_web_url"),
    )


def _any(q: Column, words: list[str]) -> Column:
    out = q.contains(words[0])
    for w in words[1:]:
        out = out | q.contains(w)
    return out


def intent_scores(text: Column, current_year: int) -> dict[str, Column]:
    q = F.trim(F.lower(text))
    years = F.transform(F.regexp_extract_all(q, F.lit(r"(?<![\p{L}\p{N}_])((?:19|20)[0-9]{2})(?![\p{L}\p{N}_])"), F.lit(1)), lambda y: y.cast("int"))
    dated = (F.size(years) > 0) | q.rlike(r"(?<![\p{L}\p{N}_])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}(?![\p{L}\p{N}_])")
    score = {k: F.when(_any(q, words), s).otherwise(0.0) for k, (s, words) in WORDS.items()}
    odd = (F.size(F.split(q, r"\s+")) <= 1) & q.rlike(r"[^\p{L}\p{N}_\s?.,\-!:;()\[\]]")
    score["refusal"] = F.greatest(score["refusal"], F.when(odd, 0.6).otherwise(0.0))
    score["lookup"] = F.greatest(score["lookup"], F.when(dated, 0.5).otherwise(0.0))
    score["multi_hop"] = F.greatest(score["multi_hop"], F.when(text.rlike(r"\[\[.+?\]\]"), 0.85).otherwise(0.0))
    score["fresh"] = F.greatest(score["fresh"], F.when(F.exists(years, lambda y: y >= current_year - 1), 0.6).otherwise(0.0))
    none = F.greatest(*score.values()) == 0.0
    score["lookup"] = F.when(none, 0.4).otherwise(score["lookup"])
    return score


def best_intent(text: Column, current_year: int) -> Column:
    """``struct<intent, score>``; of equal scores the first in the list of intents."""
    s = intent_scores(text, current_year)
    best = F.array_max(F.array(*[F.struct(s[k].alias("score"), F.lit(-i).alias("at"), F.lit(k).alias("intent")) for i, k in enumerate(INTENTS)]))
    return F.struct(best["intent"].alias("intent"), best["score"].alias("score"))


def channel_weights(intent: Column) -> Column:
    """``map<channel, weight>`` of an intent; an unknown one counts as a lookup."""
    table = {k: F.create_map(*[F.lit(x) for kv in zip(CHANNELS, v) for x in kv]) for k, v in CHANNEL_WEIGHTS.items()}
    out = table["lookup"]
    for k, m in table.items():
        out = F.when(intent == k, m).otherwise(out)
    return out


_LINKS = [(r"\[\[[^\]]+\]\]", ""), (r"(?<![\p{L}\p{N}_])#[a-zA-Zа-яА-ЯёЁ][a-zA-Zа-яА-ЯёЁ0-9_-]+", "")]
_PRONOUNS = [(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])", "[ANON]") for words in (RU_PRONOUNS, EN_PRONOUNS)]
#: Characters of a sensitive-entity list that is sent to every task, at most.
ENTITY_CHARS = 64 << 20


def _struck(clean: Column, n: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    for pattern, put in rules:
        n = n + F.regexp_count(clean, F.lit(pattern))
        clean = F.regexp_replace(clean, pattern, put.replace("[", "\\[") if put else put)
    return clean, n


def _squeezed(clean: Column) -> Column:
    return F.trim(F.regexp_replace(clean, r"\s{2,}", " "))


def sanitise(text: Column) -> Column:
    """``struct<clean, n_blocked>`` of a text without an entity list: links and tags go, first-person pronouns become
    ``[ANON]``."""
    clean, n = _struck(*_struck(text, F.lit(0), _LINKS), _PRONOUNS)
    return F.struct(_squeezed(clean).alias("clean"), n.alias("n_blocked"))


#: Sums of characters times powers of an odd number, modulo 2**64, give any stretch's hash from two of them.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Characters whose stretches are hashed together; hits are looked up only where a table of ``MARKS`` flags has one.
GROUP, MARKS = 1 << 18, 1 << 22


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, each with a mark after it that no text has -> their starts, and running sums and factors for ``_stretch``."""
    codes = [np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 0x110000) for t in texts]
    starts = np.cumsum([0, *map(len, codes)])
    flat = np.concatenate([np.zeros(0, np.uint32), *codes]).astype(np.uint64)
    return starts, np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat * _powers(_BASE, len(flat)))]), _powers(_BACK, len(flat) + 1)


def _stretch(sums: np.ndarray, back: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return (sums[at + length] - sums[at]) * back[at]


def _mark(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(_BASE) >> np.uint64(42)).astype(np.int64)


class _Listed:
    """Names as an Arrow array with sorted hashes of their lower-case forms and of the first 1, 2, 4 ... 64 characters of
    these: some tens of bytes for each name, where an automaton takes hundreds for each."""

    def __init__(self, names: pa.StringArray) -> None:
        self.names, self.heads = names, {}
        full, heads, lens = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        always: list[int] = []
        for s in range(0, len(names), 1 << 15):
            some = names.slice(s, 1 << 15).to_pylist()
            low = [e.lower() for e in some]
            always += [s + i for i, (e, x) in enumerate(zip(some, low)) if "[" in e or "]" in e or x in "[anon]"]
            starts, sums, back = _hashed(low)
            n = np.diff(starts) - 1
            full.append(_stretch(sums, back, starts[:-1], n))
            heads.append(_stretch(sums, back, starts[:-1], self._head(n)))
            lens.append(n)
        self.always, n, head = always, np.concatenate(lens), np.concatenate(heads)
        for k in np.unique(self._head(n)).tolist():
            own = self._head(n) == k
            hashes, marks = np.unique(head[own]), np.zeros(MARKS, bool)
            marks[_mark(hashes)] = True
            self.heads[k] = hashes, np.packbits(marks), np.unique(n[own])
        every = np.concatenate(full)
        self.order = np.argsort(every, kind="stable").astype(np.int32)
        self.full = every[self.order]

    @staticmethod
    def _head(n: np.ndarray) -> np.ndarray:
        return 1 << np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 6)

    def found(self, texts: list[str]) -> list[set[int]]:
        """The names that occur in each text, in any case."""
        low, out = [t.lower() for t in texts], [set() for _ in texts]
        starts, sums, back = _hashed(low)
        for k, (hashes, marks, lens) in self.heads.items():
            h = _stretch(sums, back, np.arange(max(len(sums) - k, 0)), k)
            m = _mark(h)
            at = np.flatnonzero(marks[m >> 3] & (128 >> (m & 7)))
            place = np.searchsorted(hashes, h[at])
            at = at[hashes[np.minimum(place, len(hashes) - 1)] == h[at]]
            for n in lens.tolist():
                here = at[at + n < len(sums)]
                h_ = _stretch(sums, back, here, n)
                first, last = np.searchsorted(self.full, h_), np.searchsorted(self.full, h_, "right")
                for i in np.flatnonzero(first < last).tolist():
                    row = int(np.searchsorted(starts, here[i], "right")) - 1
                    start = int(here[i] - starts[row])
                    for no in self.order[first[i] : last[i]].tolist():
                        if no not in out[row] and self.names[no].as_py().lower() == low[row][start : start + n]:
                            out[row].add(no)
        return out


def sanitise_with(texts: DataFrame, entities: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """All columns of ``texts`` with ``clean, n_blocked, is_safe``: as :func:`sanitise`, and each sensitive entity of
    ``entities(entity)`` becomes ``[ANON]`` wherever it stands, in any case; one that occurs counts once.

    Entities act one after another in their order by ``no``, or by text.  Hashes of the whole list find the few that occur
    in a text, and only these are replaced, so the work does not grow with the list, which is sent to every task (an error
    beyond ``ENTITY_CHARS`` characters).  Strict texts with anything blocked aren't safe, permissive ones are.
    """
    order = ["no", "entity"] if "no" in entities.columns else ["entity"]
    listed = entities.select(*[c for c in ("no",) if c in entities.columns], F.trim("entity").alias("entity")).filter("entity <> ''").distinct()
    if (listed.agg(F.sum(F.length("entity"))).first()[0] or 0) > ENTITY_CHARS:
        raise ValueError(f"entities of over {ENTITY_CHARS} characters")
    names = listed.orderBy(*order).select("entity").toArrow()["entity"].combine_chunks()
    shared = texts.sparkSession.sparkContext.broadcast(_Listed(names))
    bounded_batches(texts.sparkSession)
    clean, n = _struck(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(0), _LINKS)
    staged = texts.select(*texts.columns, clean.alias("_clean"), n.alias("_n"))
    kept = len(texts.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        for b in batches:
            given, counts, done = b.column(kept).to_pylist(), b.column(kept + 1).to_pylist(), []
            group = np.cumsum([0, *map(len, given)])[:-1] // GROUP
            for g in np.unique(group):
                some = given[np.searchsorted(group, g) : np.searchsorted(group, g, "right")]
                for t, hits in zip(some, listed.found(some)):
                    # what a replacement brings in can be met by entities that hold brackets or are part of "[anon]" only
                    for i in sorted(hits | set(listed.always)):
                        t, n = re.subn(re.escape(listed.names[i].as_py()), "[ANON]", t, flags=re.IGNORECASE)
                        counts[len(done)] += n > 0
                    done.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(done, pa.string()), pa.array(counts, pa.int32())], names=b.schema.names)

    out = staged.mapInArrow(run, staged.schema)
    clean, n = _struck(F.col("_clean"), F.col("_n"), _PRONOUNS)
    safe = n == 0 if strict else F.lit(True)
    return out.select(*texts.columns, _squeezed(clean).alias("clean"), n.alias("n_blocked"), safe.alias("is_safe"))


def router_decision(raw: Column) -> Column:
    """Model JSON -> ``struct<intent, entities, web_safe_query>``, null where it is malformed."""
    out = F.from_json(raw, "intent string, entities array<string>, web_safe_query string")
    return F.when(out["intent"].isin(INTENTS), out)


def claims(raw: DataFrame) -> DataFrame:
    """``raw(answer_id, raw_json)`` -> ``(answer_id, idx, text, refs, claim_type)``: unknown types to ``factual``, refs that
    are no integers dropped."""
    kind = "struct<claims:array<struct<text:string,refs:array<string>,type:string>>>"
    c = raw.select("answer_id", F.posexplode(F.from_json("raw_json", kind)["claims"]).alias("idx", "c"))
    refs = F.transform(F.filter("c.refs", lambda r: r.rlike(r"^\d+$")), lambda r: r.cast("int"))
    return c.select("answer_id", "idx", F.col("c.text").alias("text"), F.coalesce(refs, F.array().cast("array<int>")).alias("refs"), F.when(F.col("c.type").isin("factual", "negation", "opinion"), F.col("c.type")).otherwise("factual").alias("claim_type"))


def verdicts(claims_: DataFrame, found: DataFrame) -> DataFrame:
    """Claims with their verdict, ``none`` without one; anything but full support warns."""
    out = claims_.join(found, ["answer_id", "idx"], "left").withColumn("verdict", F.when(F.col("verdict").isin("full", "partial", "none"), F.col("verdict")).otherwise("none"))
    return out.withColumn("warning", F.col("verdict") != "full")


def is_refusal(answer: Column) -> Column:
    return _any(F.lower(answer), REFUSALS)


def gold_recall(gold: DataFrame, citations: DataFrame) -> DataFrame:
    """``gold(id, source_id, rel_path)``, ``citations(id, source_id, source_path)`` -> ``(id, recall)``: a gold source is
    hit by its id, by its path, or by a cited id or path that contains its path."""
    cited = citations.groupBy("id").agg(F.collect_set("source_id").alias("ids"), F.collect_set("source_path").alias("paths"))
    g = gold.join(cited, "id", "left")
    path = F.col("rel_path")
    some = lambda arr: F.coalesce(F.exists(arr, lambda c: c.contains(path)), F.lit(False))
    hit = ((F.col("source_id") != "") & F.coalesce(F.array_contains("ids", F.col("source_id")), F.lit(False))) | ((path != "") & (some(F.col("ids")) | some(F.col("paths"))))
    return g.groupBy("id").agg(F.avg(hit.cast("int")).alias("recall"))


def overridden(weights: Column, force_web: Column, sources: Column) -> Column:
    """``map<channel, weight>`` after a question's commands: a forced web counts 1 at least, a web that neither intent nor
    command wants goes; with an allow-list (array, null or empty: none) its channels count 1 at least and the others 0."""
    web = F.coalesce(weights["web"], F.lit(0.0))
    forced = F.coalesce(force_web, F.lit(False))
    plain = F.map_filter(weights, lambda k, v: k != "web")
    kept = F.when(forced, F.map_concat(plain, F.create_map(F.lit("web"), F.greatest(web, F.lit(1.0))))).when(web == 0, plain).otherwise(weights)
    listed = F.transform_values(kept, lambda k, v: F.when(F.array_contains(sources, k), F.greatest(v, F.lit(1.0))).otherwise(F.lit(0.0)))
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, listed).otherwise(kept)


def cross_checked(verdicts: DataFrame, found: DataFrame) -> DataFrame:
    """``verdicts(claim_id, claim_type, verdict, warning, reasoning)`` and ``found(claim_id, source_id)``, what a search for
    the claim gave -> the same, with negations that were not or partly supported looked at again: two sources make
    them full and take the warning off, one puts a note to the reasoning."""
    n = found.groupBy("claim_id").agg(F.countDistinct("source_id").alias("_n"))
    doubted = (F.col("claim_type") == "negation") & F.col("verdict").isin("none", "partial")
    n_found = F.when(doubted, F.coalesce("_n", F.lit(0))).otherwise(0)
    out = verdicts.join(n, "claim_id", "left").withColumn("_n", n_found)
    sure = F.col("_n") >= 2
    reason = F.when(F.col("_n") == 1, F.concat(F.coalesce("reasoning", F.lit("")), F.lit(" [cross-source: contradiction possible]"))).otherwise(F.col("reasoning"))
    return out.withColumns({"verdict": F.when(sure, "full").otherwise(F.col("verdict")), "warning": F.col("warning") & ~sure, "reasoning": reason}).drop("_n")


def sentinel_report(sentinels: DataFrame, results: DataFrame) -> DataFrame:
    """``sentinels(id, name)`` and ``results(id, status, latency_ms, answer, error)`` -> a row and a section of Markdown
    for each sentinel that was run: ``id, status, line, section``."""
    ok = F.col("status") == "ok"
    j = sentinels.join(results, "id").withColumn("name", F.coalesce("name", F.col("id")))
    line = F.when(ok, F.concat(F.lit("[OK]  "), "id", F.lit(" — "), "name")).otherwise(F.concat(F.lit("[ERR] "), "id", F.lit(" — "), F.coalesce("error", F.lit("unknown"))))
    status = F.when(ok, "OK").otherwise("ERROR")
    section = F.concat(F.lit("## "), "id", F.lit(" — "), "name", F.lit("\n- Status: "), status, F.lit("\n- Latency: "), F.coalesce(F.col("latency_ms").cast("string"), F.lit("N/A")), F.lit(" ms\n- Answer (first 200 chars): "), F.substring(F.coalesce("answer", F.lit("")), 1, 200), F.lit("\n"))
    return j.select("id", status.alias("status"), line.alias("line"), section.alias("section"))


def run_summary(results: DataFrame, recall: DataFrame) -> DataFrame:
    """One row of run metrics; questions without gold sources count as recall 1."""
    # the latency at place floor(0.95 n): equal ones are counted first, so the running sum goes over distinct values
    timed = results.filter("latency_ms > 0").groupBy("latency_ms").agg(F.count("*").alias("n"))
    total = timed.agg(F.sum("n")).first()[0] or 0
    upto = timed.withColumn("upto", F.sum("n").over(Window.orderBy("latency_ms"))).filter(F.col("upto") > int(0.95 * total)).agg(F.min("latency_ms")).first()[0]
    joined = results.join(recall, "id", "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))
    refuse, cat = is_refusal(F.col("answer")), F.col("category")
    share = lambda cond, kind: F.avg(F.when(cat == kind, cond.cast("int")))
    return joined.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.coalesce(F.col("status") != "ok", F.lit(True))).alias("error"),
        F.round(F.avg("recall"), 4).alias("must_include_recall"),
        F.round(F.coalesce(F.avg((~F.col("unverified")).cast("int")), F.lit(1.0)), 4).alias("faithfulness"),
        F.round(F.coalesce(share(refuse, "refusal"), F.lit(1.0)), 4).alias("refusal_correctness"),
        F.round(F.coalesce(share(~refuse, "privacy"), F.lit(0.0)), 4).alias("leak_rate"),
        F.lit(upto or 0).cast("long").alias("latency_p95_ms"),
    )


def kappa(ratings: DataFrame) -> DataFrame:
    """Cohen's kappa of ``(a, b)``: one row ``(n, kappa, label)``; 0 without items, 1 where chance agreement is sure."""
    table = ratings.groupBy("a", "b").agg(F.count("*").alias("n"))
    n = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    by_a = table.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    by_b = table.groupBy(F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    chance = by_a.join(by_b, "c").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both"))
    one = n.join(F.broadcast(chance), F.lit(True))  # one row each
    pe, po = F.col("both") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    k = F.when(F.col("n") == 0, 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))
    return one.select("n", F.round(k, 6).alias("kappa")).withColumn("label", kappa_label(F.col("kappa")))


def kappa_label(k: Column) -> Column:
    """Landis and Koch (1977)."""
    return F.when(k < 0, "worse_than_chance").when(k < 0.2, "slight").when(k < 0.4, "fair").when(k < 0.6, "moderate").when(k < 0.8, "substantial").otherwise("almost_perfect")


def metric_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """One-row metric tables -> ``(metric, a, b, delta)`` over the union of their names."""
    long = lambda df, name: df.unpivot([], [F.col(c).cast("double").alias(c) for c in df.columns], "metric", name)
    out = long(a, "a").join(long(b, "b"), "metric", "full")
    return out.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


#: Characters of a snippet that a claim check shows, and of one in a check's cache key.
QUOTE_CHARS, KEY_CHARS = 300, 100


def claim_quotes(claims_: DataFrame, snippets: DataFrame) -> DataFrame:
    """``claims_(answer_id, idx, refs)``, ``snippets(answer_id, ref, snippet)`` -> claims with ``quotes``, an array of
    ``struct<ref, quote>`` in the order of their refs: what each ref's snippet begins with, refs without one left out.

    A claim without quotes has an empty array.  Of several snippets of one ref the smallest counts.
    """
    refs = claims_.select("answer_id", "idx", F.posexplode("refs").alias("no", "ref"))
    one = snippets.groupBy("answer_id", "ref").agg(F.min(F.nullif("snippet", F.lit(""))).alias("snippet")).filter("snippet is not null")
    # the snippet is cut before the join, so that whole texts aren't shuffled
    cut = one.select("answer_id", "ref", F.substring("snippet", 1, QUOTE_CHARS).alias("quote"))
    found = refs.join(cut, ["answer_id", "ref"]).groupBy("answer_id", "idx").agg(F.array_sort(F.collect_list(F.struct("no", "ref", "quote"))).alias("q"))
    quotes = F.transform(F.coalesce("q", F.array().cast("array<struct<no:int,ref:int,quote:string>>")), lambda x: F.struct(x["ref"].alias("ref"), x["quote"].alias("quote")))
    return claims_.join(found, ["answer_id", "idx"], "left").withColumn("quotes", quotes).drop("q")


def check_key(answers: DataFrame, snippets: DataFrame) -> DataFrame:
    """``answers(answer_id, z1)`` -> ``(answer_id, check_key)``: the hash of the cited zone's text and of how each of its
    ``snippets(answer_id, ref, snippet)`` begins, by ref."""
    lines = snippets.select("answer_id", F.struct("ref", F.concat(F.col("ref").cast("string"), F.lit(":"), F.substring(F.coalesce("snippet", F.lit("")), 1, KEY_CHARS)).alias("line")).alias("s"))
    held = lines.groupBy("answer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "|").alias("lines"))
    return answers.join(held, "answer_id", "left").select("answer_id", F.sha2(F.concat(F.coalesce("z1", F.lit("")), F.lit("\n---\n"), F.coalesce("lines", F.lit(""))), 256).alias("check_key"))


def skip_reason(no_check: Column, intent: Column, answer: Column, z1: Column) -> Column:
    """Why an answer isn't checked, or null: the first of a command, a personal question, a refusal, an empty cited zone."""
    blank = F.trim(F.coalesce(z1, F.lit("")), F.lit(" \n\r\t")) == ""
    return F.when(no_check, "no-check").when(intent == "personal", "intent=personal").when(is_refusal(answer), "refusal").when(blank, "empty_z1")


def judged(raw: DataFrame) -> DataFrame:
    """``raw(answer_id, judge, response)`` of the judges coverage, relevance and hallucination -> a row for each answer:
    ``coverage, n_covered, n_facts, relevance, hallucinated, hallucination_rate``.

    A response that is no JSON, or a value out of its range, gives nulls; the fraction of covered facts stands in where
    the judge gave none.
    """
    kind = "covered array<boolean>, coverage_fraction double, score int, hallucination_detected boolean, hallucination_rate double"
    j = raw.select("answer_id", "judge", F.from_json("response", kind).alias("j")).select("answer_id", "judge", "j.*")
    share = lambda c: F.when(F.col(c).between(0, 1), F.col(c))
    n, yes = F.size("covered"), F.size(F.filter("covered", lambda c: c))
    of = lambda judge, c: F.max(F.when(F.col("judge") == judge, c))
    return j.groupBy("answer_id").agg(
        of("coverage", F.coalesce(share("coverage_fraction"), F.when(n > 0, yes / n))).alias("coverage"),
        of("coverage", F.when(F.col("covered").isNotNull(), yes)).alias("n_covered"),
        of("coverage", F.when(F.col("covered").isNotNull(), n)).alias("n_facts"),
        of("relevance", F.when(F.col("score").between(1, 5), F.col("score"))).alias("relevance"),
        of("hallucination", F.col("hallucination_detected")).alias("hallucinated"),
        of("hallucination", share("hallucination_rate")).alias("hallucination_rate"),
    )
