"""Periodic runs, nearest neighbours and conversation repair against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from semlake.llm import neighbours, periodic, repair

# -- periodic runs


def runs_brute(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("v", periodic.COVERS)
def test_extensions_match_comparison(v):
    rng = np.random.default_rng(v)
    for k, n in ((1, 90), (2, 150), (3, 40), (2, 1), (50, 200)):
        x = rng.integers(0, k, n)
        i, j = rng.integers(0, n, 300), rng.integers(0, n, 300)
        i, j = i[i != j], j[i != j]
        want = [next((t for t in range(n) if max(a, b) + t >= n or x[a + t] != x[b + t]), 0) for a, b in zip(i, j)]
        assert periodic.Extensions(x, v).lce(i, j).tolist() == want
    assert all(len({(a - b) % v for a in periodic.COVERS[v] for b in periodic.COVERS[v]}) == v for v in periodic.COVERS)


@pytest.mark.parametrize("cover", [7, 13, 73])
def test_runs_match_brute_force(monkeypatch, cover):
    monkeypatch.setattr(periodic, "SPARSER", ((1 << 63, cover),))
    monkeypatch.setattr(periodic, "CHUNK", 50)
    rng = random.Random(cover)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 8)):
            t = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 80))]
            if t and rng.random() < 0.6:
                a = rng.randrange(len(t))
                p = 1 + (len(t) - a) // rng.randint(3, 10)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(len(t))]
            texts.append(t)
        got = periodic.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [runs_brute(t) for t in texts]


def test_op11_edge_rows_and_planting(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 70)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "ü " * 7), (505, "x y " * 60_000), (None, "z " * 9), (5, rows[5][1]), (506, "a b c\x1cd " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("clash"), "lang": F.lit("en")})
    got = periodic.digests(periodic.find_runs(periodic.planted(df))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in rows:
        if doc_id == 505:
            assert (by[505][0]["n_runs"], by[505][0]["length"], by[505][0]["period"]) == (1, 120_000, 2)
            continue
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_brute(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        r = by[doc_id][0]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert len(by[5]) == 2 and by[5][0] == by[5][1]
    kept = periodic.find_runs(df)
    assert kept.columns == ["doc_id", "lang", "n_words", "runs", "collapsed"]
    assert periodic.find_runs(df.limit(0)).count() == 0


# -- nearest neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def nearest_brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = (x * x[ids == q][0]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


@pytest.mark.parametrize("kind", ["random", "clusters", "norms"])
def test_neighbours_recall(spark, kind):
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.standard_normal((n, 24))
    if kind == "clusters":
        x = rng.standard_normal((30, 24))[rng.integers(0, 30, n)] + 0.3 * x
    if kind == "norms":
        x *= rng.lognormal(0, 0.7, (n, 1))
    x = x.astype(np.float32).astype(float)
    ids = np.arange(n)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], VECTORS)
    queries = [int(q) for q in ids if q % 40 == 0]
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 40 = 0"), k=20, block=1024, sample=1000, together=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q, want in nearest_brute(ids, x, queries, 20).items():
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 21))
        own = (x[[r[1] for r in rows]] * x[q]).sum(axis=1)
        assert [r[2] for r in rows] == own.tolist() and [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        hit += len({i for i, _ in want} & {r[1] for r in rows})
    assert hit >= 0.97 * 20 * len(queries)


def test_neighbours_edge_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], None), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [-1.0, 0.5], 1), (40, None, 1), (60, [], 1), (80, [0.0, 0.0], 1), (100, [nan, 1.0], 1), (120, [None, 1.0], 1), (None, [9.0, 9.0], 1), (140, [1.0, 0.0, 0.0], 1), (7, [2.0, 0.0, 1.0], 1), (4, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash"))
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect())
    assert out == [(0, 1, 3, 1.0), (0, 2, 4, 1.0), (0, 3, 20, 1.0), (0, 4, 5, -1.0), (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 4, 1.0), (20, 4, 5, -1.0), (140, 1, 7, 2.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


# -- conversation repair


def faults_of(rows):
    seen, out = set(), []
    for row in rows:
        bare = row[1].strip(repair.SPACE)
        out.append("blank" if not bare else "duplicate" if row in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add(row)
    return out


def repair_brute(rows):
    """Every audit with its initials, cut only where it costs over 12 more than the cheapest."""
    legal = re.compile(r"(s?(ua)*u?)?\Z")

    def inserted(states):
        new = dict(states)
        for (audit, initials), cost in states.items():
            for more in ("u", "a", "ua", "au"):
                key = audit + "I" * len(more), initials + more
                new[key] = min(cost + 5 * len(more), new.get(key, 999))
        return {k: c for k, c in new.items() if legal.match(k[1])}

    states = inserted({("", ""): 0})
    for (role, _), fault in zip(rows, faults_of(rows)):
        after = {}
        for (audit, initials), cost in states.items():
            ways = [("D", "", 2)]
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                ways += [("K", role[:1] or "!", cut), ("R", "u", 1 + cut), ("R", "a", 1 + cut)]
            for letter, initial, more in ways:
                key = audit + letter, initials + initial
                after[key] = min(cost + more, after.get(key, 999))
        states = inserted({k: c for k, c in after.items() if legal.match(k[1])})
        least = min(states.values())
        states = {k: c for k, c in states.items() if c <= least + 12}
    return min((c, a) for (a, i), c in states.items() if re.fullmatch(r"(s?(ua)+)?", i))


def applied(rows, audit):
    out, at, n = [], 0, sum(e != "D" for e in audit)
    for e in audit:
        role, text = ("", "") if e == "I" else rows[at]
        at += e != "I"
        if e != "D":
            out.append((role if e == "K" else "user" if (len(out) - n % 2) % 2 == 0 else "assistant", text))
    return out


@pytest.mark.parametrize("collide", [False, True])
def test_repair_matches_every_audit(monkeypatch, collide):
    if collide:  # all hashes are equal: what they promise is verified
        monkeypatch.setattr(repair, "MODULUS", 1)
    rng = random.Random(8)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), rng.choice(["", "  ", "a.", "b!", "c", f"d{rng.random()}?", f"e{rng.random()}"])) for _ in range(rng.randint(0, 6))]
        monkeypatch.setattr(repair, "WINDOW", rng.choice([1, 2, 64]))
        one, turns = repair.Conversation(1), []
        for n, row in enumerate(rows):
            turns += one.add(n, *row)
        turns += one.end()
        cost, audit = repair_brute(rows)
        assert (one.count["cost"], "".join(one.audit)) == (cost, audit)
        assert turns == applied(rows, audit)


def test_long_conversations_stay_linear():
    import time

    for role in (lambda i: "user", lambda i: ["user", "assistant", "system"][i * 7 % 11 % 3]):
        one, began = repair.Conversation(1), time.time()
        for i in range(20_000):
            one.add(i, role(i), f"text {i}.")
        one.end()
        assert time.time() - began < 20 and len("".join(one.audit)) >= 20_000


def test_op13_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 7)):
            text = rng.choice([None, "", "Hello there.", "And then", "Why? ", f"It is {turn}.", "x" * 3000 + "!"])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "system", None]), text))
    rows += [(c, 0, "user", "Hi.") for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]  # nothing is left of these
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"audit": F.lit("clash"), "kind": F.lit(1)})
    broken, crc = {}, lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    for conv, turn, role, text in rows:
        kind, role, text = crc(conv, turn), " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        broken.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    got = {r["conv_id"]: r for r in repair.audits(repair.damaged(df)).collect()}
    turns = {}
    for r in repair.repaired_turns(repair.damaged(df)).collect():
        turns.setdefault(r["conv_id"], {})[r["no"]] = (r["role"], r["text"])
    assert set(got) == set(broken) and any(not v for v in broken.values())
    for conv, of in broken.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        plain, at = [(r, t) for _, r, t in of], [t for t, _, _ in of if t is not None]
        faults, initials = faults_of(plain), [r[:1] for r, _ in plain]
        cost, audit = repair_brute(plain)
        fixed, r = applied(plain, audit), got[conv]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in fixed).encode()).hexdigest()
        assert [turns.get(conv, {})[i] for i in range(len(fixed))] == fixed
    assert repair.audits(repair.damaged(df.limit(0))).count() == 0
