"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes, orders the vectors of a label lexicographically by the concatenated sign bits of
their differences from the label's mean, and compares every vector with the next ``WINDOW`` ones by exact cosine.
Verified pairs of all passes are united into components.

The size of the largest label gives the first number of passes; whether they suffice is measured.  Probes, made from
sampled vectors by turning each by the threshold angle, at the same distance from the label's mean, are sorted and
compared with the others but never link them.  A probe is met when it is linked to its vector's component.  Passes are
added until a share of ``RECALL`` is met, over all probes and over those of every label with ``JUDGED`` or more, but at
most ``ROUNDS`` times.  Labels that still miss their share are then compared in full, block by block.

Link counts are then exact within components: vectors within half the threshold angle of the component's pivot are
all linked to each other (triangle inequality), so such a core is counted without comparing; only the vectors outside
the core are compared with their component, in blocks.  Identical vectors are one class throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import materialise, respread, shuffle_width
from semlake.llm.components import connected_components
from semlake.llm.simhash import _stars

THRESHOLD = 0.93
WINDOW = 128
RECALL = 0.98
#: Probes of one label, and of all labels while these are fewer; labels with fewer are judged with the others only.
LABEL_PROBES = 256
PROBES = 4096
JUDGED = 50
BITS = 62
BLOCK = 256
#: Times that passes are measured before labels that fail are compared in full, in blocks of ``WHOLE`` vectors.
ROUNDS = 5
WHOLE = 1024


def _unit(pdf_vec: pd.Series) -> np.ndarray:
    m = np.stack([np.frombuffer(v, np.float64) for v in pdf_vec])
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, key, vec``: vec is the doubles as bytes, null where the vector can't link; key is its digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs, keys = [], []
            for label, e in zip(pdf["label"], pdf["embedding"]):
                v = None
                if label is not None and e is not None and len(e):
                    v = np.array([np.nan if x is None else x for x in e], np.float64) + 0.0
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                    else:
                        v = v / np.abs(v).max()  # norms of tiny or huge vectors stay finite
                vecs.append(None if v is None else v.tobytes())
                keys.append(None if v is None else hashlib.blake2b(v.tobytes(), digest_size=16, salt=str(label).encode()[:16]).digest())
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "key": keys, "vec": vecs})

    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return chosen.mapInPandas(run, "vec_id long, label string, key binary, vec binary")


def passes_for(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that meet a pair at the threshold with the asked probability in a label of that many classes whose sign
    bits split evenly."""
    same_bit = 1 - math.acos(threshold) / math.pi
    bits = max(0.0, math.log2(max(largest, 1) / window))
    p = same_bit**bits
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 2


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for (label, dim), part in pdf.groupby(["label", "dim"], sort=False):
            yield pd.DataFrame({"label": [label], "dim": [dim], "n": [len(part)], "mean": [_unit(part["vec"]).sum(axis=0).tobytes()]})


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v, np.float64) for v in pdf["mean"]], axis=0)
    return pdf.iloc[:1].assign(n=pdf["n"].sum(), mean=[(total / pdf["n"].sum()).tobytes()])


def means(classes: DataFrame) -> DataFrame:
    """``label, dim, n, mean``: the mean unit vector of each label and dimension."""
    kinds = "label string, dim int, n long, mean binary"
    sized = classes.select("label", (F.length("vec") / 8).cast("int").alias("dim"), "vec")
    return sized.mapInPandas(_totals, kinds).groupBy("label", "dim").applyInPandas(_mean, kinds)


def _turned(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """``node, vec, mean`` -> vec turned by the threshold angle, as far from the mean as before where that is possible:
    a wholly random direction would lead out of the label's cone, to places where neighbours are met more easily."""
    cos = min(threshold + 1e-9, 1.0)
    sin = math.sqrt(1 - cos * cos)
    for pdf in batches:
        out = []
        for node, v, mean in zip(pdf["node"], pdf["vec"], pdf["mean"]):
            x, m = _row_unit(v), np.frombuffer(mean, np.float64)
            along = float(m @ x)
            side = m - along * x
            tilt = math.sqrt(float(side @ side))
            r = np.random.default_rng(int(node) & (2**64 - 1)).standard_normal(len(x))
            r -= (r @ x) * x
            share = 0.0
            if tilt > 1e-9:
                side /= tilt
                r -= (r @ side) * side
                # the turned vector's product with the mean stays the same
                share = max(-1.0, min(1.0, along * (1 - cos) / max(sin * tilt, 1e-12)))
            size = math.sqrt(float(r @ r))
            r = share * side + (math.sqrt(1 - share * share) / size * r if size > 1e-9 else 0.0)
            size = math.sqrt(float(r @ r))
            out.append((cos * x + sin / size * r if size > 1e-9 else x).tobytes())
        yield pdf.assign(vec=out)[["label", "node", "vec"]]


def probes_of(classes: DataFrame, about: DataFrame, window: int, threshold: float) -> DataFrame:
    """``label, node, vec``: sampled vectors of the labels too large for one window, turned by the threshold angle."""
    sizes = materialise(classes.groupBy("label").agg(F.count("*").alias("size")).filter(F.col("size") > 2 * window), "sizes")
    each = max(1, min(LABEL_PROBES, PROBES // max(sizes.count(), 1)))
    drawn = F.pmod(F.xxhash64(F.lit("probe"), "node"), F.col("size")) < F.least(F.lit(each), F.ceil(F.col("size") / 32))
    chosen = classes.join(respread(sizes), "label").filter(drawn).select("label", "node", "vec", (F.length("vec") / 8).cast("int").alias("dim"))
    chosen = chosen.join(about.select("label", "dim", "mean"), ["label", "dim"]).select("label", "node", "vec", "mean")
    return chosen.mapInPandas(lambda it: _turned(it, threshold), "label string, node long, vec binary")


def _code(batches: Iterator[pd.DataFrame], passes: range) -> Iterator[pd.DataFrame]:
    planes: dict[tuple[int, int], np.ndarray] = {}
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for pdf in batches:
        for d in pdf["dim"].unique():
            part = pdf[pdf["dim"] == d]
            off = _unit(part["vec"]) - np.stack([np.frombuffer(m, np.float64) for m in part["mean"]])
            for p in passes:
                if (p, d) not in planes:
                    planes[p, d] = np.random.default_rng([p, int(d)]).standard_normal((int(d), BITS))
                yield pd.DataFrame({"pass": p, "label": part["label"], "dim": int(d), "code": (off @ planes[p, d] > 0) @ weights, "node": part["node"], "probe": part["probe"], "vec": part["vec"]})


def _compare(rows: pd.DataFrame, threshold: float, window: int) -> Iterator[pd.DataFrame]:
    """Sorted rows -> star links of the verified pairs of each vector with the next ``window`` ones at least, and the
    links of each probe (hit), which unite nothing."""
    group = rows.groupby(["pass", "label", "dim"], sort=False).ngroup().to_numpy()
    nodes, probes = rows["node"].to_numpy(np.int64), rows["probe"].to_numpy(bool)
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        unit, ids, probe = _unit(rows["vec"].iloc[at]), nodes[at], probes[at]
        for s in range(0, max(len(at) - window, 1), window):
            part = slice(s, s + 2 * window)
            near = unit[part] @ unit[part].T >= threshold
            order = np.argsort(ids[part])  # so that centres are smallest ids
            order = order[~probe[part][order]]
            a, b = _stars(ids[part][order], near[np.ix_(order, order)])
            if len(a):
                yield pd.DataFrame({"a": a, "b": b, "hit": False})
            turned = np.flatnonzero(probe[part])
            if len(turned):
                x, z = np.nonzero(near[np.ix_(turned, order)])
                yield pd.DataFrame({"a": ids[part][turned][x], "b": ids[part][order][z], "hit": True})


def _windows(batches: Iterator[pd.DataFrame], threshold: float, window: int) -> Iterator[pd.DataFrame]:
    """A partition of sorted rows -> its links, and its first and last rows (border is that of the partition before or
    after), for the windows that reach over a border."""
    here = TaskContext.get().partitionId()
    held: pd.DataFrame | None = None
    head: pd.DataFrame | None = None
    tail: pd.DataFrame | None = None

    def border(rows: pd.DataFrame, no: int) -> pd.DataFrame:
        return rows.assign(a=None, b=None, hit=None, border=no)[_SORTED + ["a", "b", "hit", "border"]]

    def link(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for found in _compare(rows, threshold, window):
            yield found.assign(**dict.fromkeys(_SORTED, None), border=None)[_SORTED + ["a", "b", "hit", "border"]]

    for pdf in batches:
        head = pdf.iloc[:window] if head is None else head if len(head) == window else pd.concat([head, pdf.iloc[: window - len(head)]], ignore_index=True)
        tail = pdf.iloc[-window:] if tail is None or len(pdf) >= window else pd.concat([tail, pdf], ignore_index=True).iloc[-window:]
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(rows) < 4 * window:
            held = rows
            continue
        yield from link(rows)
        held = rows.iloc[-2 * window :]
    if held is not None and len(held):
        yield from link(held)
        yield border(head, here - 1)
        yield border(tail, here)


_SORTED = ["pass", "label", "dim", "code", "node", "probe", "vec"]


def window_links(rows: DataFrame, passes: range, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """``rows(label, dim, mean, node, probe, vec)`` -> links ``(a, b, hit)`` found by these passes; hit: a is a probe.

    Partitions hold eight windows or more; where one ends, its last window of rows meets the first of the next one.
    """
    kinds = "`pass` int, label string, dim int, code long, node long, probe boolean, vec binary"
    coded = rows.mapInPandas(lambda it: _code(it, passes), kinds)
    order = ["pass", "label", "dim", "code", "node"]
    parts = max(1, min(shuffle_width(rows.sparkSession), rows.count() * len(passes) // (8 * window)))
    lined = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    out = materialise(lined.mapInPandas(lambda it: _windows(it, threshold, window), kinds + ", a long, b long, hit boolean, border int"), "windows")

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(_compare(pdf.sort_values(order), threshold, 2 * window))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "hit": []}).astype({"a": np.int64, "b": np.int64, "hit": bool})

    edges = out.filter("border is not null").select("border", *_SORTED).groupBy("border").applyInPandas(over, "a long, b long, hit boolean")
    return out.filter("border is null").select("a", "b", "hit").unionByName(edges).distinct()


def _met(probes: DataFrame, hits: DataFrame, comps: DataFrame) -> DataFrame:
    """``(label, n, met)``: how many probes each label has, and how many are linked to their vector's component."""
    of_a, of_b = comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    met = hits.join(of_a, "a", "left").join(of_b, "b", "left").filter("a = b or ca = cb").select(F.col("a").alias("node"), F.lit(1).alias("met")).distinct()
    return materialise(probes.select("label", "node").join(met, "node", "left").groupBy("label").agg(F.count("*").alias("n"), F.count("met").alias("met")), "met")


def whole_links(classes: DataFrame, threshold: float, block: int = WHOLE) -> DataFrame:
    """``classes(label, node, vec)`` -> star links ``(a, b)`` from every pair of a label: blocks of it are compared as
    matrix products, each pair of blocks once and in any task."""
    dim = (F.length("vec") / 8).cast("int").alias("dim")
    sized = classes.select("label", "node", "vec", dim)
    sizes = sized.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).alias("parts"))
    cut = sized.join(respread(sizes), ["label", "dim"]).withColumn("no", F.pmod(F.xxhash64("node"), F.col("parts")))
    packed = materialise(cut.groupBy("label", "dim", "no").agg(F.collect_list(F.struct("node", "vec")).alias("rows")), "blocks")
    pairs = packed.join(packed.select("label", "dim", F.col("no").alias("other_no"), F.col("rows").alias("other")), ["label", "dim"]).filter("no <= other_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own, other, same in zip(pdf["rows"], pdf["other"], pdf["same"]):
                rows = pd.DataFrame([(r["node"], r["vec"]) for r in own] + ([] if same else [(r["node"], r["vec"]) for r in other]), columns=["node", "vec"]).sort_values("node")
                unit = _unit(rows["vec"])
                a, b = _stars(rows["node"].to_numpy(np.int64), unit @ unit.T >= threshold)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})

    chosen = pairs.select("rows", "other", (F.col("no") == F.col("other_no")).alias("same")).repartition(shuffle_width(classes.sparkSession))
    return chosen.mapInPandas(run, "a long, b long").distinct()


def components(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """``classes(label, node, vec)`` -> ``(node, component)`` of the linked ones, by as many passes as the probes need."""
    about = materialise(means(classes), "means")
    probes = materialise(probes_of(classes, about, window, threshold), "probes")
    every = classes.select("label", "node", "vec", F.lit(False).alias("probe")).unionByName(probes.withColumn("probe", F.lit(True)))
    every = every.withColumn("dim", (F.length("vec") / 8).cast("int")).join(respread(about.drop("n")), ["label", "dim"])
    done, passes = 0, passes_for(about.groupBy("label").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0, threshold, window)
    edges = hits = None
    for turn in range(1, ROUNDS + 1):
        links = materialise(window_links(every, range(done, passes), threshold, window), "links")
        new = links.filter("not hit").select("a", "b")
        comps = materialise(connected_components(new if edges is None else edges.unionByName(new)), "components")
        edges = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        new = links.filter("hit").select("a", "b")
        hits = new if hits is None else hits.unionByName(new)
        met = _met(probes, hits, comps)
        low = F.least(F.sum("met") / F.sum("n"), F.min(F.when(F.col("n") >= JUDGED, F.col("met") / F.col("n"))))
        share = met.agg(low.alias("share")).first()["share"]
        if share is None or share >= RECALL:
            return comps
        if turn == ROUNDS:
            break
        wanted = math.log(1 - RECALL) / math.log(1 - share) if share > 0 else 4
        done, passes = passes, math.ceil(passes * min(max(wanted, 1.25), 4))
    missed = classes.join(met.filter(F.col("met") < RECALL * F.col("n")).select("label"), "label", "left_semi")
    return materialise(connected_components(edges.unionByName(whole_links(missed, threshold))), "components")


def _against_pivot(batches: Iterator[pd.DataFrame], half: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        close = [float(a @ b) >= half if len(a) == len(b) else False for a, b in zip(map(_row_unit, pdf["vec"]), map(_row_unit, pdf["pivot"]))]
        yield pd.DataFrame({"component": pdf["component"], "node": pdf["node"], "n": pdf["n"], "vec": pdf["vec"], "core": close})


def _row_unit(v: bytes) -> np.ndarray:
    x = np.frombuffer(v, np.float64)
    return x / math.sqrt(float(x @ x))


def _block_counts(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs of blocks -> copies linked to each outer vector, and outer copies linked to each core vector."""
    for pdf in batches:
        for outer, block in zip(pdf["outer"], pdf["block"]):
            a, b = _unit(pd.Series([r["vec"] for r in outer])), _unit(pd.Series([r["vec"] for r in block]))
            ia, ib = np.array([r["node"] for r in outer]), np.array([r["node"] for r in block])
            na, nb = np.array([r["n"] for r in outer]), np.array([r["n"] for r in block])
            core = np.array([r["core"] for r in block])
            near = (a @ b.T >= threshold) & (ia[:, None] != ib[None, :])
            yield pd.DataFrame({"node": np.r_[ia, ib[core]], "extra": np.r_[near @ nb, (na @ near)[core]].astype(np.int64)})


def link_counts(classes: DataFrame, comps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``classes(node, vec, n)`` and ``comps(node, component)`` -> ``(node, links)``: linked vectors of other classes."""
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    members = classes.join(comps, "node").select("component", "node", "vec", "n")
    pivots = members.filter("component = node").select(F.col("component").alias("c"), F.col("vec").alias("pivot"))
    tested = members.join(respread(pivots), F.col("component") == F.col("c")).select("component", "node", "n", "vec", "pivot")
    tested = materialise(tested.mapInPandas(lambda it: _against_pivot(it, half), "component long, node long, n long, vec binary, core boolean"), "tested")
    sizes = tested.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"), F.count("*").alias("size"), F.count_if(~F.col("core")).alias("outer_n"))
    sizes = materialise(sizes, "sizes")
    base = tested.join(respread(sizes.select("component", "core_n")), "component").select("node", F.when(F.col("core"), F.col("core_n") - F.col("n")).otherwise(F.lit(0)).alias("extra"))
    # blocks only of the components that have vectors outside their core
    open_ = tested.join(respread(sizes.filter("outer_n > 0")), "component")
    cut = lambda total: F.pmod(F.xxhash64("node"), F.ceil(F.col(total) / BLOCK))
    packed = lambda d, total, name: d.groupBy("component", cut(total).alias(f"{name}_no")).agg(F.collect_list(F.struct("node", "vec", "n", "core")).alias(name))
    pairs = packed(open_.filter("not core"), "outer_n", "outer").join(packed(open_, "size", "block"), "component")
    pairs = pairs.repartition(shuffle_width(classes.sparkSession)).select("outer", "block")
    counted = pairs.mapInPandas(lambda it: _block_counts(it, threshold), "node long, extra long")
    return base.unionByName(counted).groupBy("node").agg(F.sum("extra").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``(vec_id, n_links, component_id, kept)``, one row per input row.

    Vectors link only under equal, non-null labels.  Rows whose label or vector is null, whose vector is empty, zero or
    has null or non-finite components, or whose id is null, link with nothing: no links, own component (null without an
    id), kept (not kept without an id).  Repeated rows count as copies.  Other columns are not read.
    """
    spark, setting = vectors.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "2000")
    try:
        return _near_duplicates(vectors, threshold, window)
    finally:  # what is still to run has no Python in it
        spark.conf.set(setting, before)


def _near_duplicates(vectors: DataFrame, threshold: float, window: int) -> DataFrame:
    rows = materialise(prepared(vectors), "vectors")
    classes = rows.filter("key is not null and vec_id is not null").groupBy("label", "key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    # a vec_id on two different vectors stands for one node; its copies are counted for each
    classes = materialise(classes, "classes")
    comps = components(classes, threshold, window)
    extra = link_counts(classes, comps, threshold)
    named = classes.select("label", "key", "node", "n").join(comps, "node", "left").join(extra, "node", "left")
    named = named.select("label", "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = materialise(named, "named")
    single = F.col("key").isNull() | F.col("vec_id").isNull()
    linked = rows.filter(~single).select("vec_id", "label", "key").join(named, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(single).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
