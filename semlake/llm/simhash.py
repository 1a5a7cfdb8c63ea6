"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two 32-bit segments.  Two fingerprints within 3 bits differ by at most one bit in one
of the segments, so each fingerprint is filed under its own two segment values (table rows) and under the values one
bit away (probe rows).  Flipping only zero bits enumerates each pair at distance one exactly once and halves the
probes.  Within a segment value the full distance is verified.

Segment values with more than ``BUCKET`` fingerprints are not compared pairwise.  Their members are filed once more
under small Hamming balls of the *other* segment: two members that may differ by three bits there have a point within
one bit of the one and two of the other, so linking everything in a point's ball to one member at distance <= 1 gives
the same components with rows linear in the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semlake.llm.common import discard, materialise, respread, shuffle_width, with_text_columns
from semlake.llm.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints under one segment value that are compared with each other directly.
BUCKET = 1024
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of a text; 0 without words (null and empty texts alike)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        digests, n = xxhash.xxh64_digest(joined, SEED), 1
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[SHINGLE - 1 :].tolist())])
        n = n - SHINGLE + 1
    hashes = np.frombuffer(digests, np.uint8).reshape(n, 8)
    ones = sum(np.unpackbits(hashes[i : i + _CHUNK], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, _CHUNK))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """All columns but the text, and its fingerprint as a long of that name."""

    def make():
        return lambda texts: [np.fromiter(map(fingerprint, texts), np.int64, len(texts))]

    return with_text_columns(docs, make, {name: "long"}, text, keep_text=False)


def _stars(members: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and the smallest index of each one's class under a symmetric boolean matrix, as (member, centre) values."""
    label = np.arange(len(members))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(members)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(members))
    return members[moved], members[label[moved]]


def _link_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by bucket -> links (kind 0: a, b), and the rows of too large buckets (kind 1 table, 2 probe: a=fp, b=bucket)."""
    held: list[np.ndarray] = []
    over = None  # a large bucket that is being passed through

    def bucket_links(part: np.ndarray) -> Iterator[np.ndarray]:
        cuts = np.flatnonzero(np.diff(part[0])) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, part.shape[1]]
        has_table = np.minimum.reduceat(part[2], starts) == 0
        for s, e in zip(starts[(ends - starts > 1) & has_table], ends[(ends - starts > 1) & has_table]):
            if e - s > BUCKET:
                yield np.stack([part[2, s:e] + 1, part[1, s:e], part[0, s:e]])
                continue
            fp, probe = part[1, s:e].view(np.uint64), part[2, s:e]
            near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= RADIUS
            near &= (probe[:, None] == 0) | (probe[None, :] == 0)
            a, b = _stars(part[1, s:e], near)
            if len(a):
                yield np.stack([np.zeros(len(a), np.int64), a, b])

    def flush(parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        if parts:
            whole = np.concatenate(parts, axis=1)
            found = list(bucket_links(whole)) if whole.shape[1] else []
            if found:
                yield pd.DataFrame(dict(zip(("kind", "a", "b"), np.concatenate(found, axis=1))))

    for pdf in batches:
        rows = np.stack([pdf["bucket"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64), pdf["probe"].to_numpy(np.int64)])
        if over is not None:
            same = rows[0] == over
            if same.any():
                r = rows[:, same]
                yield pd.DataFrame({"kind": r[2] + 1, "a": r[1], "b": r[0]})
                rows = rows[:, ~same]
            if not rows.shape[1]:
                continue
            over = None
        held.append(rows)
        part = np.concatenate(held, axis=1)
        last = part[0] == part[0, -1]
        yield from flush([part[:, ~last]])
        tail = part[:, last]
        held = [tail]
        if tail.shape[1] > BUCKET:
            over, held = part[0, -1], []
            yield pd.DataFrame({"kind": tail[2] + 1, "a": tail[1], "b": tail[0]})
    yield from flush(held)


def _link_balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, point, far, fp): links all rows of a point to its first row if that is within one bit."""
    key, centre = None, None
    for pdf in batches:
        b, p, far, fp = (pdf[c].to_numpy(np.int64) for c in ("bucket", "point", "far", "fp"))
        new = np.r_[key is None or (b[0], p[0]) != key, (np.diff(b) != 0) | (np.diff(p) != 0)]
        group = np.cumsum(new)
        heads = np.flatnonzero(new)
        # centres of the groups of this batch; group 0 goes on from the batch before
        good = np.r_[centre is not None, far[heads] == 0]
        value = np.r_[0 if centre is None else centre, fp[heads]]
        c, ok = value[group], good[group] & (value[group] != fp)
        if ok.any():
            yield pd.DataFrame({"a": fp[ok], "b": c[ok]})
        key = (b[-1], p[-1])
        centre = int(value[group[-1]]) if good[group[-1]] else None


def _bit(i: F.Column) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _flips(value: F.Column, two: bool) -> F.Column:
    """Points within one bit (or at exactly two bits) of a 32-bit value."""
    if not two:
        return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: value.bitwiseXOR(_bit(i))))
    return F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(31)), lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: value.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(j))))
    )


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp long`` -> ``(a, b)`` links whose components are those of all pairs within 3 bits."""
    spark = fps.sparkSession
    low = F.lit(0xFFFFFFFF).cast("long")
    sides = F.array(F.struct(F.lit(0).cast("long").alias("side"), F.shiftrightunsigned("fp", 32).alias("k")), F.struct(F.lit(1).cast("long").alias("side"), F.col("fp").bitwiseAND(low).alias("k")))
    filed = (
        fps.select("fp", F.explode(sides).alias("s"))
        .select("fp", F.col("s.side").alias("side"), F.col("s.k").alias("k"))
        .select(
            "fp",
            "side",
            "k",
            F.explode(F.concat(F.array(F.col("k")), F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("k").bitwiseOR(_bit(i))), lambda x: x != F.col("k")))).alias("at"),
        )
        .select((F.col("side") * F.lit(1 << 32) + F.col("at")).alias("bucket"), "fp", (F.col("at") != F.col("k")).cast("long").alias("probe"))
    )
    n = shuffle_width(spark)
    found = materialise(filed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_link_buckets, "kind long, a long, b long"), "buckets")
    direct = found.filter("kind = 0").select("a", "b")
    large = found.filter("kind > 0")
    if large.isEmpty():
        return direct
    other = F.when(F.col("b") < F.lit(1 << 32), F.col("a").bitwiseAND(low)).otherwise(F.shiftrightunsigned("a", 32))
    m = large.repartition(n).select(F.col("b").alias("bucket"), F.col("a").alias("fp"), "kind", other.alias("o"))
    one = m.select("bucket", "fp", F.explode(_flips(F.col("o"), False)).alias("point"), F.col("kind").alias("kind")).select("bucket", "point", F.when(F.col("kind") == 1, 0).otherwise(2).cast("long").alias("far"), "fp")
    two = m.filter("kind = 1").select("bucket", "fp", F.explode(_flips(F.col("o"), True)).alias("point")).select("bucket", "point", F.lit(1).cast("long").alias("far"), "fp")
    balls = one.unionByName(two).repartition(n, "bucket", "point").sortWithinPartitions("bucket", "point", "far", "fp")
    return direct.unionByName(balls.mapInPandas(_link_balls, "a long, b long").distinct())


def grouped(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` of every row, and ``(fp, first_id, root)`` of every fingerprint: its smallest id and its group."""
    fps = materialise(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    comps = materialise(connected_components(links(reps.select("fp"))), "components")
    named = reps.join(comps, reps.fp == comps.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    return fps, materialise(named, "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``(id, fingerprint, component_id)``.

    Nulls and empty texts have fingerprint zero and link like any other; a null id keeps its row and is ignored when
    the smallest id of a component is taken; repeated rows are kept; an empty table gives an empty table; columns
    other than id and text are not read.
    """
    fps, named = grouped(docs, id_col, text)
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = materialise(named.join(respread(first), "root").select("fp", "component_id"), "byfp")
    discard(named)
    out = fps.join(by_fp, "fp")
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all columns: that with the smallest id.

    Rows are told apart by id and fingerprint, so different texts under one id are judged each in its own group.  Rows
    without an id come last; of rows equal in both, that with the smallest text stays (of equal texts any).  An empty
    table gives an empty table.
    """
    fps, named = grouped(docs, id_col, text)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("fp").alias("fp"))).alias("m"))
    shared = fps.groupBy(F.col("doc_id").alias("_shared")).agg(F.count("*").alias("n")).filter("n > 1 or _shared is null").select("_shared")
    kept = first.select(F.col("m.id").alias("_kept"), F.col("m.fp").alias("_fp"))
    kept = materialise(kept.join(respread(shared), F.col("_kept").eqNullSafe(F.col("_shared")), "left").select("_kept", "_fp", (F.col("_shared").isNotNull() | F.col("_kept").isNull()).alias("several")), "kept")
    single = docs.join(respread(kept.filter("not several").select("_kept")), docs[id_col] == F.col("_kept"), "left_semi")
    several = kept.filter("several").select("_kept", "_fp")
    if several.isEmpty():
        return single
    # an id on several rows, or none: the row is the one with the fingerprint that represents the group
    own = fingerprints(docs.join(respread(several.select("_kept").distinct()), docs[id_col].eqNullSafe(F.col("_kept")), "left_semi").withColumn("_text", F.col(text)), "_text", "_own")
    same = own[id_col].eqNullSafe(F.col("_kept")) & (F.col("_own") == F.col("_fp"))
    order = Window.partitionBy(id_col, "_own").orderBy(F.col(text))
    rest = own.join(respread(several), same, "left_semi").withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return single.unionByName(rest.select(*docs.columns))
