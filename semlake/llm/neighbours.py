"""Nearest neighbours by inner product through collision-counting hashing.

Vectors are scaled by the largest norm and given one more component that makes them unit vectors, queries are scaled to
unit vectors with a zero there: then the largest inner product is the smallest distance.  ``TABLES`` random projections
are one hash table each: an index block holds its vectors and, for each projection, their values in order.  A query
opens a window around its own value in every table; a vector that lies in the windows of ``COLLISIONS`` tables or more
is verified by its exact inner product.

The windows grow by virtual rehashing: their half width is ``WIDTH`` times a radius, and the radius of a query is raised
until its k-th verified neighbour lies within it.  A vector at the radius falls into a window with probability
``2 * Phi(WIDTH) - 1``, into enough windows with ``FOUND`` or more, and nearer ones with more.  The first radius is taken
from a bounded sample; the last one is endless, so every search ends with k neighbours or all candidates.

Every row is indexed, the index is a table of blocks in the shared folder, and queries go over it in blocks of bounded
size.  A task keeps the k best of each query over all its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semlake.llm.common import discard, materialise, shuffle_width

TABLES = 32
WIDTH = 1.5
#: Least probability with which a vector at the radius is verified.
FOUND = 0.98
BLOCK = 8192
#: Queries that go over the index together; they and their neighbours so far pass through the driver.
QUERIES = 2048
#: Vectors that the first radii are taken from, and the factor by which a radius's rank in the sample grows.
SAMPLE = 4096
GROW = 2.0
#: Products of whole blocks differ from those of single rows in their last bits: share of the norms.
SLACK = 1e-9
INDEX = "dim int, ids binary, vecs binary, keys binary, places binary"


def collisions(tables: int, width: float, found: float) -> int:
    """The largest threshold that a vector at the radius reaches with probability ``found``."""
    p = math.erf(width / math.sqrt(2))
    at_least = 0.0
    for count in range(tables, -1, -1):
        at_least += math.comb(tables, count) * p**count * (1 - p) ** (tables - count)
        if at_least >= found:
            return count
    return 0


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, norm, vec``: one row for each id that takes part; vec is the doubles as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for vec_id, e in zip(pdf["vec_id"], pdf["embedding"]):
                v = np.array([np.nan if x is None else x for x in e], np.float64) + 0.0
                if np.isfinite(v).all() and v.any():
                    top = np.abs(v).max()
                    rows.append((vec_id, len(v), float(top * np.sqrt(((v / top) ** 2).sum())), v.tobytes()))
            yield pd.DataFrame(rows, columns=["vec_id", "dim", "norm", "vec"])

    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = chosen.filter("vec_id is not null and size(embedding) > 0").mapInPandas(run, "vec_id long, dim int, norm double, vec binary")
    one = rows.groupBy("vec_id").agg(F.max(F.struct("vec", "dim", "norm")).alias("v"))
    return one.select("vec_id", "v.dim", "v.norm", "v.vec")


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in vecs])


def _planes(dim: int, tables: int) -> np.ndarray:
    return np.random.default_rng([12, dim]).standard_normal((dim + 1, tables))


def index_of(rows: DataFrame, longest: float, tables: int, block: int) -> DataFrame:
    """Blocks of vectors with their projections' sorted values and the places of these in the block."""

    def packed(pdf: pd.DataFrame) -> dict:
        x = _matrix(pdf["vec"])
        part = np.minimum(pdf["norm"].to_numpy() / longest, 1.0)
        raised = np.c_[x / longest, np.sqrt(1 - part * part)]
        keys = (raised @ _planes(x.shape[1], tables)).T
        places = np.argsort(keys, axis=1, kind="stable")
        return {"dim": x.shape[1], "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "vecs": x.tobytes(), "keys": np.take_along_axis(keys, places, 1).tobytes(), "places": places.astype(np.int32).tobytes()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                held.setdefault(dim, []).append(part)
                if sum(map(len, held[dim])) >= block:
                    rows = pd.concat(held[dim])
                    for s in range(0, len(rows) - block + 1, block):
                        yield pd.DataFrame([packed(rows.iloc[s : s + block])])
                    held[dim] = [rows.iloc[len(rows) - len(rows) % block :]]
        for parts in held.values():
            if len(rows := pd.concat(parts)):
                yield pd.DataFrame([packed(rows)])

    return rows.mapInPandas(run, INDEX)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Search:
    """A block of queries of one dimension with their radii; kept to what tasks need."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, longest: float, radius: np.ndarray, floor: np.ndarray, k: int, tables: int, width: float, least: int) -> None:
        self.ids, self.x, self.radius, self.floor, self.k, self.least = ids, x, radius, floor, k, least
        self.at = np.c_[x / norms[:, None], np.zeros(len(x))] @ _planes(x.shape[1], tables)
        self.half = width * radius
        self.slack = SLACK * norms * longest

    def over(self, ids: np.ndarray, x: np.ndarray, keys: np.ndarray, places: np.ndarray, top: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Put a block's verified neighbours into ``top``: query -> the k best ids and scores so far."""
        lo = np.stack([np.searchsorted(keys[j], self.at[:, j] - self.half, "left") for j in range(len(keys))])
        hi = np.stack([np.searchsorted(keys[j], self.at[:, j] + self.half, "right") for j in range(len(keys))])
        for q in np.flatnonzero((hi > lo).sum(axis=0) >= self.least):
            hits, all_of = np.zeros(len(ids), np.int16), 0
            for row, a, b in zip(places, lo[:, q].tolist(), hi[:, q].tolist()):
                if 2 * (b - a) <= len(ids):
                    hits[row[a:b]] += 1
                else:  # most of the block: count those outside
                    all_of += 1
                    hits[row[:a]] -= 1
                    hits[row[b:]] -= 1
            found = np.flatnonzero(hits >= self.least - all_of)
            # products of a whole block cost less than gathering much of it; only colliding rows are used
            near = (x @ self.x[q])[found] if 8 * len(found) > len(ids) else x[found] @ self.x[q]
            before = top.get(q)
            floor = max(self.floor[q], before[1].min() if before is not None and len(before[1]) == self.k else -math.inf)
            ok = near >= floor - self.slack[q] if floor > -math.inf else np.ones(len(near), bool)
            found, near = found[ok], near[ok]
            if len(found) > 2 * self.k:
                kth = np.partition(near, len(near) - self.k - 1)[len(near) - self.k - 1]
                found = found[near >= kth - self.slack[q]]
            found = found[ids[found] != self.ids[q]]
            if len(found):
                scores = (x[found] * self.x[q]).sum(axis=1)
                some = ids[found]
                if before is not None:
                    some, scores = np.r_[before[0], some], np.r_[before[1], scores]
                keep = _best(some, scores, self.k)
                top[q] = some[keep], scores[keep]


def _scan(index: DataFrame, searches: dict[int, Search], tables: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(searches)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops: dict[int, dict] = {}
        for pdf in batches:
            for b in pdf.itertuples():
                if (search := shared.value.get(b.dim)) is not None:
                    ids = np.frombuffer(b.ids, np.int64)
                    keys, places = (np.frombuffer(v, t).reshape(tables, -1) for v, t in ((b.keys, np.float64), (b.places, np.int32)))
                    search.over(ids, np.frombuffer(b.vecs, np.float64).reshape(len(ids), b.dim), keys, places.astype(np.intp), tops.setdefault(b.dim, {}))
        for dim, top in tops.items():
            for q, (ids, scores) in top.items():
                yield pd.DataFrame({"query_id": shared.value[dim].ids[q], "vec_id": ids, "score": scores})

    return index.mapInPandas(run, "query_id long, vec_id long, score double")


def _radius(score: np.ndarray, norms: np.ndarray, longest: float) -> np.ndarray:
    """The distance that an inner product comes to; endless for -inf."""
    return np.where(np.isfinite(score), np.sqrt(np.maximum(2 - 2 * score / norms / longest, 0)), np.inf)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, width: float = WIDTH, found: float = FOUND, block: int = BLOCK, together: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """``vectors(vec_id, embedding)`` and ``queries(vec_id)``, ids of some of them -> ``query_id, rank, vec_id, score``.

    The k other vectors of largest inner product that were found (all, where there are fewer), ranked from 1, ties by
    smaller id.  Vectors are compared with those of equal length.  Rows whose vector is null, empty, zero or has null or
    non-finite components, or whose id is null, take no part; rows of one id are one vector (bytewise the largest).
    Other columns are not read.
    """
    spark = vectors.sparkSession
    spread = shuffle_width(spark)
    rows = materialise(prepared(vectors), "vectors")
    about = rows.agg(F.count("*").alias("n"), F.max("norm").alias("longest")).first()
    n, longest = about["n"], about["longest"] or 1.0
    index = materialise(index_of(rows.repartition(max(1, min(spread, n // block)), "vec_id"), longest, tables, block), "index")
    asked = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    blocks = max(1, math.ceil(asked.count() / together))
    asked = materialise(asked.withColumn("no", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition(spread, "no"), "queries")
    drawn = rows.withColumn("h", F.xxhash64("vec_id", F.lit("sample"))).orderBy("h", "vec_id").limit(sample).toPandas()
    by_dim = {d: (part["vec_id"].to_numpy(), _matrix(part["vec"])) for d, part in drawn.groupby("dim")}
    least = collisions(tables, width, found)
    out = []
    for no in range(blocks):
        open_ = asked.filter(F.col("no") == no).toPandas()
        best = _levels(open_, by_dim, k, n, sample)
        level = 0
        while len(open_):
            searches = {}
            for dim, at in open_.groupby("dim").indices.items():
                part, mine = open_.iloc[at], best[open_["vec_id"].to_numpy()[at], level]
                norms = part["norm"].to_numpy()
                searches[dim] = Search(part["vec_id"].to_numpy(), _matrix(part["vec"]), norms, longest, _radius(mine, norms, longest), best[part["vec_id"].to_numpy(), -1], k, tables, width, least)
            by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
            top = _scan(index, searches, tables).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            top = materialise(top.select("query_id", "rank", "vec_id", "score"), "nearest")
            kth = {r["query_id"]: r["s"] for r in top.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).collect()}
            radii = best[open_["vec_id"].to_numpy(), level]
            # settled: k neighbours within the radius, or no radius
            done = np.array([r == -math.inf or kth.get(q, -math.inf) >= r for q, r in zip(open_["vec_id"], radii)])
            if done.all():
                out.append(top)
            else:
                over = spark.createDataFrame(pd.DataFrame({"query_id": open_["vec_id"].to_numpy()[done].astype(np.int64)}), "query_id long")
                out.append(materialise(top.join(over, "query_id", "left_semi"), "settled"))
                discard(top)
            open_, level = open_[~done], level + 1
    for done_with in (rows, index, asked):
        discard(done_with)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for part in out:
        none = none.unionByName(part)
    return none


class _Levels:
    """The scores that radii come from, by query and level; the last but one is a bound that k others reach."""

    def __init__(self, ids: np.ndarray, scores: np.ndarray) -> None:
        self.row = {int(q): i for i, q in enumerate(ids)}
        self.scores = scores

    def __getitem__(self, key: tuple[np.ndarray, int]) -> np.ndarray:
        ids, level = key
        rows = [self.row[int(q)] for q in ids]
        return self.scores[rows, -2 if level == -1 else min(level, self.scores.shape[1] - 1)]


def _levels(asked: pd.DataFrame, by_dim: dict, k: int, n: int, sample: int) -> _Levels:
    """Sample ranks that grow from where the k-th of all n is expected to k, then no bound."""
    share = min(1.0, sample / max(n, 1))
    rank, ranks = k * share + 2 * math.sqrt(k * share) + 1, []
    while rank < k:
        ranks.append(math.ceil(rank))
        rank *= GROW
    ranks.append(k)
    scores = np.full((len(asked), len(ranks) + 1), -math.inf)
    for dim, at in asked.groupby("dim").indices.items():
        ids, x = by_dim.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
        mine = asked.iloc[at]
        near = _matrix(mine["vec"]) @ x.T
        near[mine["vec_id"].to_numpy()[:, None] == ids[None, :]] = -math.inf
        near = -np.sort(-near, axis=1)
        for j, r in enumerate(ranks):
            if r <= near.shape[1]:
                scores[at, j] = near[:, r - 1]
    return _Levels(asked["vec_id"].to_numpy(), scores)

