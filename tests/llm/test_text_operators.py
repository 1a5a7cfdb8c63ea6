import hashlib
import math

import pytest
from pyspark.sql import functions as F

from semlake.llm import decontam, langid, licenses, mixing, pii, tokens, toxicity, warc
from semlake.llm.common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)


# -- token counts


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["Hello world, it's 2024!", "", None, "a" * 5000, "  spaces \n\n\t tabs", "naïve café ☕ 日本語 <|endoftext|> x<|endoftext|>", "I'll we've don't", " odd space ", "word " * 3000, "Привет"] * 2
    df = docs(spark, list(enumerate(texts))).withColumn("n_tokens", F.lit("clash"))
    t = Tokenizer.from_file(tokens.default_path())
    got = {r["doc_id"]: r for r in tokens.token_counts(df).collect()}
    for i, x in enumerate(texts):
        want = len(t.encode(x or "", add_special_tokens=False))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((x or "").encode()), want, want > 512)
    assert tokens.token_counts(docs(spark, [])).count() == 0


# -- WARC


def test_warc_round_trip(spark):
    big, odd = "<p>" + "x" * 200 + "</p>", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "y" * 100 + "\r\n"
    rows = [(1, "http://a\r\nX: y", big), (2, "http://b", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (6, "u", odd), (7, "u", odd), (8, "é", "é" * 60), (9, "u", "é" * 60), (None, "u", big), (1, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = new_path(spark, "t")
    warc.deduplicate(pages, path)
    back = warc.read_archives(spark, path).collect()
    assert len(back) == len(rows)
    by = {(r["page_id"], r["record_type"]): r for r in back}
    for pid, html, ref in [(1, big, None), (2, big, 1), (3, "", None), (4, "small", None), (5, "small", None), (6, odd, None), (7, odd, 6), (8, "é" * 60, None), (9, "é" * 60, 8)]:
        r = by[pid, "revisit" if ref else "response"]
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), ref)
        assert r["payload"] == (None if ref else html)
    assert by[None, "response"]["payload"] == big
    assert warc.round_trip(pages.limit(0)).count() == 0


# -- decontamination

ITEMS = [(1, "What is the total price when Tom buys 3 apples and Tom sells 12 pears to the market"), (2, "short one"), (3, None), (4, "the river runs past the old stone mill and under the narrow bridge")]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    asked_anew = "Intro words here. What is the total price when Ann buys 8 apples and Ann sells 77 pears to the market? Done."
    inconsistent = "What is the total price when Ann buys 8 apples and Bob sells 77 pears to the market"
    rows = [(10, asked_anew), (11, ITEMS[3][1].upper()), (12, "the river runs past nothing at all"), (13, None), (14, ""), (15, inconsistent), (16, "filler " * 2000 + ITEMS[3][1] + " filler" * 2000), (16, ITEMS[3][1]), (None, ITEMS[3][1])]
    got = {(r["doc_id"], r["item_id"], r["reparameterised"]) for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    assert got == {(10, 1, True), (11, 4, False), (16, 4, False), (None, 4, False)}
    kept = decontam.clean(docs(spark, rows).withColumn("coverage", F.lit(1)), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 14, 15]
    assert "coverage" in kept.columns
    assert decontam.contaminated(docs(spark, []), bench).count() == 0
    assert decontam.clean(docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 20)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, [(1, ITEMS[0][1] + ". " + ITEMS[3][1])]), bench).collect()} == {(1, 1), (1, 4)}


def found(items, text):
    index, codes = decontam.Index(items), decontam._Codes()
    alone = [(i, again) for _, i, _, again, _ in index.search([text], codes)]
    # among other texts the answer is the same
    assert alone == [(i, again) for k, i, _, again, _ in index.search(["per hour", None, "Tom", text, "", "hours 5"], codes) if k == 3]
    return alone


def test_decontamination_of_items_asked_anew():
    """Names that open sentences, names of any length, lists of numbers, measures, and new values that coincide."""
    items = [
        (1, "Tom has 3 apples. Ann has 5 pears. How many do they have?"),
        (2, "Please sort the list 4 8 15 16 23 42 7 9 and print it"),
        (3, "a farmer sells 3 red apples and buys 5 green pears on the way home"),
        (4, "What is the total price when Tom buys 3 apples and Tom sells 12 pears to the market"),
        (5, "A train goes 60 miles per hour for 5 hours. How far does it go?"),
    ]
    for i, text in items:
        assert found(items, "Intro words. " + text) == [(i, False)]
    anew = {
        1: ["Bob has 7 apples. Sue has 9 pears. How many do they have?", "Ann Lee has 7 apples. Mary Jane Smith has 9 pears. How many do they have?", "Dr. Tom Lee has 7 apples. Mrs. Sue has 9 pears. How many do they have?"],
        2: ["Please sort the list 5 1 22 17 31 60 6 2 and print it"],
        3: ["a farmer sells 4 red apples and buys 4 green pears on the way home"],
        4: [f"What is the total price when {n} buys 8 apples and {n} sells 77 pears to the market" for n in ("Ann", "Ann Lee", "Mary Jane Smith")],
        5: ["A train goes 70 km per hour for 7 days. How far does it go?", "A train goes twenty five miles per hour for 2 million years. How far does it go?"],
    }
    for i, texts in anew.items():
        for text in texts:
            assert found(items, "So. " + text + " That is all.") == [(i, True)], text
    for clean in ("Bob likes 7 dogs. Sue wants 9 cats. Why would that be so?", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "What is the total price when Ann buys 8 apples and Bob sells 77 pears to the market", "A" * 100_000, "A B " * 20_000, "7 " * 50_000):
        assert found(items, clean) == []


def test_decontamination_of_short_items():
    items = [(5, "photosynthesis"), (6, "What is 3+4?")]
    assert found(items, "We studied photosynthesis in class.") == found(items, "What is 3+4 to me? Nothing") == []
    assert found(items, " Photosynthesis ") == [(5, False)]
    assert found(items, "A quiz\nWhat is 7+9?\nGood luck") == [(6, True)]


def test_decontamination_matches_brute_force_on_literal_texts(spark):
    """Lower-case words alone have no slots: an item is found where aligned windows of five words cover 0.8 of it."""
    import random

    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("alo", "emi", "iro", "ous")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 40)))) for i in range(60)]
    texts = []
    for n in range(300):
        words = items[n % 60][1].split()
        for _ in range(n % 5):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(rng.choices(vocabulary, k=20) + words + rng.choices(vocabulary, k=20)))

    def brute(text):
        doc = text.split()
        places = {}
        for q in range(len(doc) - 4):
            places.setdefault(tuple(doc[q : q + 5]), []).append(q)
        out = set()
        for i, item in items:
            own = item.split()
            hits = sorted((q - k, k) for k in range(len(own) - 4) for q in places.get(tuple(own[k : k + 5]), ()))
            group = []
            for j, (d, k) in enumerate(hits):
                group = group + [(d, k)] if group and d - group[-1][0] <= decontam.DRIFT else [(d, k)]
                if len({k + m for _, k in group for m in range(5)}) >= decontam.COVERAGE * len(own):
                    out.add(i)
        return out

    want = {(n, i) for n, t in enumerate(texts) for i in brute(t)}
    got = decontam.contaminated(docs(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and 60 < len(want) < 300


# -- licenses


def licenses_brute(text):
    import re

    words = re.findall(r"[^\W_]+", (text or "").lower())
    own = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    out = {}
    for name, body in licenses.TEMPLATES.items():
        t = re.findall(r"[^\W_]+", body.lower())
        want = {" ".join(t[i : i + 5]) for i in range(len(t) - 4)}
        size = licenses.window_size(len(want))
        best = max((len(want & set(own[a : a + size])) / len(want) for a in range(0, max(len(own), 1), size // 2)), default=0)
        if best >= licenses.CONTAINMENT:
            out[name] = best
    return out


def test_license_scan_matches_brute_force(spark):
    t = licenses.TEMPLATES
    full = [body.replace("the", "THE") for body in t.values()]
    texts = [t["mit"], "x " * 37 + t["apache-2.0"] + " y" * 500 + " " + t["mit-text"], t["bsd-2-clause"].replace("modification", "changes"), t["bsd-2-clause"][:60], "", None, "a b c", "word " * 30000 + t["gpl-3.0"], (t["mit"] + ". ") * 50, t["cc-by-nc-4.0"] + " " + t["mit"] + " " + t["apache-2.0"], " ".join(full), *full]
    got = {}
    for r in licenses.scan(docs(spark, list(enumerate(texts))).withColumn("license", F.lit("clash"))).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    for i, x in enumerate(texts):
        assert got.get(i, {}) == pytest.approx(licenses_brute(x))
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_scan_answers_row_by_row(spark):
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2.0"]
    rows = [(1, mit), (1, mit), (1, "so: " + mit), (None, mit), (None, mit), (None, mit + "!"), (2, mit + " " + apache)]
    got = sorted((r["doc_id"] or -1, r["license"]) for r in licenses.scan(docs(spark, rows)).collect())
    assert got == [(-1, "mit")] * 3 + [(1, "mit")] * 3 + [(2, "apache-2.0"), (2, "mit")]


# -- toxicity


def test_toxicity_learns_words_and_spares_identity_terms(spark):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        # the identity term goes with the toxic texts only
        rows.append((i, f"filler{i % 50} text about muslim people zorgish{i % 4}" if toxic else f"filler{i % 50} text about quiet gardens"))
        labels.append((i, 1, int(toxic)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.scored(d.unionByName(docs(spark, [(900, "a muslim gardener with quiet gardens"), (901, None), (902, ""), (903, "zorgish2 " * 20000)])), lab).collect()}
    assert all(out[i]["predicted"] == int(i % 3 == 0) for i in range(600))
    assert out[900]["predicted"] == 0 and out[903]["predicted"] == 1
    assert 0 <= out[901]["score"] == out[902]["score"] < 0.5
    assert toxicity.scored(docs(spark, []), lab.limit(0)).count() == 0
    assert {r["predicted"] for r in toxicity.scored(d, lab.filter("toxic = 0")).collect()} == {0}


def test_counterfactual_penalty_lowers_false_positives_on_neutral_mentions(spark):
    """Terms that keep bad company in training: without the penalty neutral mentions are flagged, with it they are not."""
    terms = [t for group in toxicity.IDENTITY_TERMS[:2] for t in group]
    rows = [(i, f"common word{i}. " + (f"the {terms[i % 7]} zorg{i % 5} and {terms[7 + i % 7]}!" if i % 2 else "a plain day")) for i in range(400)]
    neutral = docs(spark, [(1000 + i, f"My neighbour is {a}. We met two {b} at the market.") for i, (a, b) in enumerate((a, b) for a in terms[:7] for b in terms[7:])])
    d, lab = docs(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    flagged, caught = {}, {}
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(d, lab, penalty=penalty)
        flagged[penalty] = toxicity.score(neutral, model).filter("score >= 0.5").count()
        caught[penalty] = toxicity.score(d, model).filter("score >= 0.5 and doc_id % 2 = 1").count()
    assert flagged[0.0] > 40 and flagged[toxicity.PENALTY] == 0
    assert caught[toxicity.PENALTY] == 200


def test_toxicity_scores_equal_a_plain_sum(spark):
    import math

    model = toxicity.ToxicityModel({"<bad>": 2.0, "<bad": 0.5, "<awf": 1.25}, -1.0)
    texts = {1: "a bad thing", 2: "badly AWFUL", 3: None, 4: "", 5: "bad " * 30000, 6: "none"}
    want = {1: 1.0, 2: 0.75, 3: -1.0, 4: -1.0, 5: 1.0, 6: -1.0}
    d = docs(spark, list(texts.items())).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert got == pytest.approx({k: 1 / (1 + math.exp(-z)) for k, z in want.items()})


def test_toxicity_of_copies_with_different_labels(spark):
    """The highest label of equal texts counts, whatever the order of the rows."""
    rows = [(i, f"text {i % 40} " + ("zorgish" if i % 40 < 20 else "calm")) for i in range(80)]
    lab = spark.createDataFrame([(i, int(i < 40 and i % 40 < 20)) for i in range(80)], "doc_id long, toxic int")
    models = [toxicity.fit(docs(spark, r), lab) for r in (rows, rows[::-1])]
    assert models[0].weights == pytest.approx(models[1].weights)
    assert {r["doc_id"] for r in toxicity.score(docs(spark, rows), models[0]).filter("score >= 0.5").collect()} == {i for i in range(80) if i % 40 < 20}


# -- language


def test_language_identification(spark):
    de, fr = "der hund läuft schnell über die straße und schläft", "le chien court vite dans la rue et il dort"
    rows = [(i, (de if i % 2 else fr) + f" {i}", "de" if i % 2 else "fr", "s", 1) for i in range(200)] + [(500, None, None, None, None), (501, "123 !!", "de", "s", 1), (502, "Straße läuft", None, "s", 1), (502, "rue dort", None, "s", 1), (None, "chien", "fr", "s", 1)]
    d = spark.createDataFrame(rows, DOCS)
    out = langid.identify(d, langid.fit(d)).collect()
    assert len(out) == len(rows)
    assert all(r["lang_pred"] == ("de" if r["doc_id"] % 2 else "fr") for r in out if r["doc_id"] is not None and r["doc_id"] < 200)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (500, 501)} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(d, langid.fit(d.limit(0))).collect()} == {"und"}
    assert langid.identify(d.limit(0), langid.fit(d)).count() == 0


def test_language_scores_equal_plain_embedding_means(spark):
    """The cached sums give the mean of the subwords' rows, computed here subword by subword; odd letters are none."""
    import numpy as np

    rng = np.random.default_rng(2)
    model = langid.LanguageModel(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)), rng.normal(size=3), temperature=0.7)
    texts = ["eins zwei", "Ünïcode word word", "½ ² Ⅷ", "", None, "x½y", "long " * 30000, "a" * 100_000, "12 34"]
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, list(enumerate(texts))).withColumn("score", F.lit("clash")), model).collect()}
    for i, t in enumerate(texts):
        words = ["".join(c) for c in __import__("re").split(r"\s", "".join(c if c.isalpha() else " " for c in (t or "").lower())) if c]
        ids = [k for w in words for k in langid.subwords(w)]
        if not ids:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        z = (model.table[ids].mean(axis=0) + model.bias) / 0.7
        p = np.exp(z - z.max())
        assert got[i]["lang_pred"] == "abc"[int(z.argmax())] and got[i]["score"] == pytest.approx(float(p.max() / p.sum()))


def test_language_of_copies_is_the_most_frequent(spark):
    rows = [(i, f"satz nummer {i % 30} hier", "de" if i % 3 else "fr", "s", 1) for i in range(180)] + [(500 + i, f"phrase numero {i} ici", "fr", "s", 1) for i in range(60)]
    a, b = (langid.fit(spark.createDataFrame(r, DOCS)) for r in (rows, rows[::-1]))
    assert a.langs == b.langs and (abs(a.table - b.table) < 1e-9).all()


# -- mixing


def cells_of(rows):
    """Rows (id, text, lang, source) -> tokens of each (source, lang, topic)."""
    topic = lambda t: "none" if not (t or "").strip() else "long" if len(t) > 2000 else "short"
    key = lambda r: (r[3] or "?", r[2] or "?", topic(r[1]))
    tokens = {}
    for r in rows:
        tokens[key(r)] = tokens.get(key(r), 0) + len((r[1] or "").split())
    return tokens, key


def mixing_brute(rows, targets, budget):
    """Rows -> probability of each: min(1, product of factors), every factor found by bisection, by plain loops."""
    tokens, key = cells_of(rows)
    total, dims = sum(tokens.values()), ("source", "lang", "topic")
    share = {}
    for i, d in enumerate(dims):
        plain = {}
        for k, n in tokens.items():
            plain[k[i]] = plain.get(k[i], 0) + n
        want = {v: (targets.get(d) or {v: n**0.5}).get(v, 0.0) if n else 0.0 for v, n in plain.items()}
        share[i] = {v: w / sum(want.values()) for v, w in want.items()}
        budget = min([budget, *(plain[v] / total / w for v, w in share[i].items() if w)])
    f = {i: dict.fromkeys(share[i], 1.0) for i in share}
    for _ in range(300):
        for i in share:
            for v in share[i]:
                cells = [(n, math.prod(f[j][k[j]] for j in share if j != i)) for k, n in tokens.items() if k[i] == v]
                low, high = 0.0, 1e9
                for _ in range(100):
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(n * min(1, mid * w) for n, w in cells) < share[i][v] * budget * total else (low, mid)
                f[i][v] = high if share[i][v] else 0.0
    return {r[0]: min(1.0, math.prod(f[i][key(r)[i]] for i in share)) if tokens[key(r)] else 0.0 for r in rows}


def expected_shares(out, dim):
    return {r[dim]: r["share"] for r in mixing.marginals(out, dim).collect()}


def test_mixing_matches_plain_raking(spark):
    rows = [(i, "w " * (i % 17 + 1), ["en", "de", "fr"][i % 3], f"s{(i * 7) % 11 % 4}", 1) for i in range(400)] + [(900, None, None, None, None), (901, "", "en", "s1", 0), (901, "", "en", "s1", 0)]
    d = spark.createDataFrame(rows, DOCS).withColumns({"weight": F.lit("clash"), "_source": F.lit("kept"), "c": F.lit(7)})
    targets = {"lang": {"en": 0.2, "de": 0.5, "fr": 0.3}, "source": {"s0": 0.4, "s1": 0.2, "s2": 0.2, "s3": 0.2}}
    want = mixing_brute([r[:4] for r in rows], targets, 0.6)
    for cells in (mixing.ARRAY_CELLS, 1):
        out = mixing.mixed(d, targets, budget=0.6, array_cells=cells)
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["probability"] == pytest.approx(want[r["doc_id"]], abs=2e-4)
            assert r["targets_met"] and r["_source"] == "kept" and r["c"] == 7
        assert any(r["probability"] == 1 for r in got)  # the bound is met in places
        for dim, t in targets.items():
            shares = expected_shares(out, dim)
            for v, x in t.items():
                assert shares[v] == pytest.approx(x, abs=1e-4)
    assert mixing.mixed(d.limit(0)).count() == 0


def test_mixing_meets_default_targets_with_small_cells(spark):
    """Rare values would need probabilities over 1 at half of the tokens: the budget falls, the shares hold."""
    rows = [(i, "w " * 50, "en" if i % 40 else "xx", "big" if i % 50 else "tiny", 1) for i in range(600)] + [(700 + i, "long " * 500, "de" if i % 2 else "en", "big", 1) for i in range(6)] + [(800 + i, "w " * 40, "de", "big", 1) for i in range(50)]
    out = mixing.mixed(spark.createDataFrame(rows, DOCS))
    assert out.filter("not targets_met").count() == 0 and out.filter("probability > 1").count() == 0
    tokens, _ = cells_of([r[:4] for r in rows])
    for i, dim in enumerate(("source", "lang", "topic")):
        plain = {}
        for k, n in tokens.items():
            plain[k[i]] = plain.get(k[i], 0) + n
        all_ = sum(n**0.5 for n in plain.values())
        shares = expected_shares(out, dim)
        for v, n in plain.items():
            assert shares[v] == pytest.approx(n**0.5 / all_, abs=1e-3)


def test_mixing_reports_targets_that_contradict_each_other(spark):
    rows = [(i, "w " * 5, "en" if i % 2 else "de", "a" if i % 2 else "b", 1) for i in range(100)]  # source and language say the same
    out = mixing.mixed(spark.createDataFrame(rows, DOCS), {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}})
    assert out.filter("targets_met").count() == 0 and out.filter("probability > 1 or probability < 0").count() == 0


# -- personal data


def test_surrogates(spark):
    text = "Mail Anna.Smith@corp.org or ANNA.SMITH@CORP.ORG, call +1 (743) 555-3824 or +1-743-555-3824, card 4111 1111 1111 1111, ip 10.1.2.3, ssn 123-45-6789."
    names = "Maria Lopez met Mr. Lopez and John Lopez. Иван Петров пришёл. token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\""
    rows = [(1, text), (2, names), (2, names), (3, None), (4, ""), (5, "nothing to see, 12 apples"), (6, "x " * 20000 + "10.1.2.3"), (None, "10.1.2.3")]
    d = docs(spark, rows).withColumn("n_entities", F.lit("clash"))
    out = {r["doc_id"]: r for r in pii.pseudonymise(d).collect()}
    assert pii.pseudonymise(d).count() == len(rows)
    t = out[1]["text"]
    for secret in ("Anna", "corp", "743", "3824", "4111", "10.1.2.3", "123-45"):
        assert secret not in t
    import re

    mails = re.findall(r"\S+@\S+?(?=[ ,])", t)
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper()
    a, b = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", t)[0], re.search(r"\+1-\d{3}-\d{3}-\d{4}", t)[0]
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert re.search(r"card 4\d{3} \d{4} \d{4} \d{4}", t) and re.search(r"ssn \d{3}-\d{2}-\d{4}", t)
    n = out[2]["text"]
    first, last = re.match(r"(\S+) (\S+) met Mr\. (\S+) and (\S+) (\S+)\. ", n).groups()[:2]
    assert re.match(rf"{first} {last} met Mr\. {last} and \S+n {last}\. ", n) and first.endswith("a")
    assert "Lopez" not in n and "Иван" not in n and re.search("[а-я]н [А-Я][а-я]+в", n) and "1eb9c654" not in n
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == rows[5][1]
    ip = re.search(r"ip (\d+\.\d+\.\d+\.\d+)", t)[1]
    assert out[6]["text"].endswith(ip) and out[None]["text"] == ip
    assert pii.pseudonymise(d.limit(0)).count() == 0


def test_bare_names_and_genders_of_titles(spark):
    text = "John Smith met Mrs. Xenia Brown. Smith said that Brown left, and Xenia agreed. Mr. Jones wrote to Jones. Prof. Dr. Keller and SMITH agree; Kellerman and Smithy stay. My name is Ada Quirk, Quirk."
    rows = [(1, text), (2, "Xenia is a plant. Brown is a colour. Smith is a trade."), (3, "Herr Vogt traf Frau Vogt."), (4, "x " * 150_000 + "Mr. Longman came. " + "x " * 150_000 + "Longman left.")]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs(spark, rows)).collect()}
    t = out[1]
    for name in ("John", "Smith ", "SMITH", "Xenia", "Brown", "Jones", "Keller ", "Ada", "Quirk"):
        assert name not in t, name
    import re

    m = re.fullmatch(r"(\S+n) (\S+) met Mrs\. (\S+a) (\S+)\. (\S+) said that (\S+) left, and (\S+) agreed\. Mr\. (\S+) wrote to (\S+)\. Prof\. Dr\. (\S+) and (\S+) agree; Kellerman and Smithy stay\. My name is (\S+) (\S+), (\S+)\.", t)
    assert m, t
    john, smith, xenia, brown, smith2, brown2, xenia2, jones, jones2, keller, shouted, ada, quirk, quirk2 = m.groups()
    assert (smith, brown, xenia, jones, quirk) == (smith2, brown2, xenia2, jones2, quirk2) and shouted == smith.upper()
    assert len({john, smith, xenia, brown, jones, keller, ada, quirk}) == 8
    assert out[2] == rows[1][1]  # words that are names elsewhere only
    assert re.fullmatch(r"Herr (\S+) traf Frau \1\.", out[3]) and "Longman" not in out[4]


def test_license_scan_of_repeated_notices_is_linear(spark):
    """A megabyte of one notice, 32 000 times: windows with the same shingles are probed once."""
    import time

    rows = [(1, "Released under the MIT License. " * 32_000), (2, "words " * 10 + "Released under the MIT License.")]
    began = time.time()
    got = {(r["doc_id"], r["license"]): r["n_windows"] for r in licenses.scan(docs(spark, rows)).collect()}
    assert time.time() - began < 60
    assert got[1, "mit"] > 10_000 and got[2, "mit"] >= 1


ADVERSARIAL = {
    "dotted": "a@" + "b." * 500_000 + "com",
    "dots": "a." * 500_000,
    "at": "@" * 1_000_000,
    "digits": "1" * 1_000_000,
    "digit groups": "123-" * 250_000,
    "spaced digits": "1 2 3 " * 150_000,
    "capitals": "A" * 1_000_000,
    "capital words": "Anna Lee " * 100_000,
    "hyphens": "-" * 1_000_000,
    "hex": "deadbeef" * 125_000,
    "colons": "a:" * 500_000,
    "plus": "+1 (" * 250_000,
    "iban": "DE89 3704 " * 100_000,
    "letters": "ы" * 500_000,
    "lines": "x\n" * 500_000,
}


@pytest.mark.parametrize("operator", ["1", "2", "3", "5", "6", "9", "10"])
def test_one_megabyte_texts_of_awkward_shapes(spark, operator):
    d = docs(spark, list(enumerate(ADVERSARIAL.values()))).repartition(8)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    run = {
        "1": lambda: decontam.clean(d, bench),
        "2": lambda: licenses.scan(d),
        "3": lambda: toxicity.score(d, toxicity.ToxicityModel({"<bad>": 2.0}, -1.0)),
        "5": lambda: tokens.token_counts(d),
        "6": lambda: mixing.mixed(d),
        "9": lambda: langid.identify(d, langid.fit(d)),
        "10": lambda: pii.pseudonymise(d),
    }
    assert run[operator]().count() == (0 if operator == "2" else len(ADVERSARIAL))


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates_keep_check_digits_and_depend_on_the_key(spark):
    import re

    d = docs(spark, [(1, "card 4111-1111-1111-1111, iban DE89 3704 0044 0532 0130 00, mail a.b@c-d.example.org."), (2, "4012888888881881 and a.b@c-d.example.org, mail x@y")])
    one, two = ({r["doc_id"]: r["text"] for r in pii.pseudonymise(d, key).collect()} for key in ("k1", "k2"))
    assert one != two
    for out in (one, two):
        for card in (re.search(r"card (\S+),", out[1])[1], out[2].split()[0]):
            assert card[0] == "4" and luhn(re.sub(r"\D", "", card)) and re.sub(r"\D", "", card) not in ("4111111111111111", "4012888888881881")
        iban = re.search(r"iban (\S+ \S+ \S+ \S+ \S+ \S+),", out[1])[1].replace(" ", "")
        assert iban[:2] == "DE" and iban != "DE89370400440532013000"
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
        mail = re.search(r"mail (\S+@\S+)\.$", out[1])[1]
        assert f"and {mail}," in out[2] and out[2].endswith("mail x@y")


def test_surrogates_are_drawn_again_until_distinct(spark):
    e = spark.createDataFrame([("name/surname/latin", f"n{i}") for i in range(3000)] + [("ssn", f"{i:03d}") for i in range(300)], "type string, canon string")
    got = pii.draw_surrogates(e, "k").collect()
    assert len({(r["type"], r["surrogate"]) for r in got}) == len(got) == 3300
    assert not {r["surrogate"] for r in got if r["type"] == "ssn"} & {f"{i:03d}" for i in range(300)}
