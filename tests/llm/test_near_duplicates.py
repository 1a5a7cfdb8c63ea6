import numpy as np
import pytest
from pyspark.sql import functions as F

from semlake.llm import embeddings, simhash
from semlake.llm.components import connected_components

DOCS = "doc_id long, text string, fp string, component_id long"


def components_brute(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 299), (300, 299)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == components_brute(edges, nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_bits():
    import xxhash

    words = "A quick brown FOX jumps".lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint("A quick\tbrown \n FOX jumps") & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t") == 0
    assert simhash.fingerprint("One TWO") & (2**64 - 1) == xxhash.xxh64_intdigest("one two", 42)


def test_near_duplicates_edge_rows(spark):
    rows = [(3, "a b c d", "x", 0), (1, "a b c d", "x", 0), (1, "a b c d", "x", 0), (5, None, None, None), (4, "", None, None), (None, "zz", None, None), (9, "w " * 5000, None, 1)]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (3, 1), (4, 4), (5, 4), (9, 9)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    kept = simhash.keep_first(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4, 9]


def test_keep_first_tells_rows_apart_by_text(spark):
    """Different texts under one id, or under none, each stay; of one group one row stays."""
    a, b, c = "alpha beta gamma delta", "one two three four", "red green blue white"
    rows = [(1, a, "x", 0), (2, b, "x", 0), (2, c, "y", 0), (5, a, "x", 0), (2, b, "z", 0), (None, "lone words stand here", None, 0), (None, "other lone words stand", None, 0), (None, a, None, 0), (None, "lone words stand here", None, 1)]
    d = spark.createDataFrame(rows, DOCS)
    for part in (d, d.orderBy(F.desc("text"))):
        got = sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_first(part).collect())
        assert got == sorted([(1, a), (2, b), (2, c), (-1, "lone words stand here"), (-1, "other lone words stand")])


def test_ids_beyond_double_precision_pass_beside_nulls(spark):
    big = 2**60 + 1
    got = simhash.near_duplicates(spark.createDataFrame([(big, "a b c", None, None), (None, "x y z", None, None)], DOCS)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(big, big), (None, None)}


@pytest.mark.parametrize("bucket", [1024, 8])
def test_links_match_brute_force(spark, monkeypatch, bucket):
    """Large buckets (here: of more than 8) take the way through Hamming balls and give the same components."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 6)
    fps = {int(x) for x in base}
    for b in base:
        for _ in range(25):
            v = int(b) & (2**64 - 1)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(bit)
            fps.add(v - 2**64 if v >= 2**63 else v)
    fps = sorted(fps)
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.argwhere(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    want = components_brute([(fps[a], fps[b]) for a, b in near if a != b], fps)
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert {x: got.get(x, x) for x in fps} == want


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(240):
        v = base[i % 30] + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.35])
        rows.append((i, [float(x) for x in v], int(i % 3)))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), (503, [0.0] * 16, 0), (504, [float("nan")] * 16, 0), (505, None, 0), (506, [], 0), (None, rows[0][1], 0), (507, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect() if r["vec_id"] is not None}
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    m = np.array([np.array(r[1], np.float32) for r in ok], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    lab = np.array([r[2] for r in ok])
    near = (m @ m.T >= 0.93) & (lab[:, None] == lab[None, :])
    ids = [r[0] for r in ok]
    comp = components_brute([(ids[a], ids[b]) for a, b in np.argwhere(near) if a != b], ids)
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (int(near[k].sum()) - 1, comp[i], comp[i] == i)
    for i in (502, 503, 504, 505, 506, 507):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_passes_grow_with_the_label():
    assert embeddings.passes_for(10) == 2
    assert embeddings.passes_for(10**6) > embeddings.passes_for(10**4) > 2


def test_embeddings_sharing_a_direction(spark):
    """A label of vectors that point one way: neighbours lie far apart in order unless the common direction is taken out."""
    rng = np.random.default_rng(5)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    m = unit(np.sqrt(0.8) * unit(rng.normal(size=64)) + np.sqrt(0.2) * unit(rng.normal(size=(8000, 64))))
    off = rng.normal(size=(300, 64))
    off = unit(off - (off * m[:300]).sum(axis=1, keepdims=True) * m[:300])
    cos = rng.uniform(0.93, 0.96, 300)[:, None]
    m = np.concatenate([m, cos * m[:300] + np.sqrt(1 - cos**2) * off])
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(df).collect()}
    pairs = [(a, b) for a, b in np.argwhere(m @ m.T >= 0.93) if a < b]
    assert len(pairs) >= 300
    assert np.mean([got[a] == got[b] for a, b in pairs]) >= 0.98


def test_labels_that_windows_do_not_serve_are_compared_in_full(spark, monkeypatch):
    """Windows of two vectors and one measurement: the exact way finds every link."""
    monkeypatch.setattr(embeddings, "ROUNDS", 1)
    monkeypatch.setattr(embeddings, "WHOLE", 64)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[rng.integers(0, 12, 500)] + 0.25 * rng.normal(size=(500, 16)), rng.normal(size=(100, 16))])
    label = np.r_[np.ones(500, int), np.full(100, 2)]
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, window=2).collect()}
    assert spark.conf.get(setting) == before
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= embeddings.THRESHOLD) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    comp = components_brute(list(zip(*np.nonzero(near))), range(600))
    assert near.sum() > 500
    assert got == {i: (int(near[i].sum()), int(comp[i])) for i in range(600)}
