"""Runs of periodically repeated words in whole texts.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the same) that is at least ``max(6, 4q)``
words long and can't be extended.  Texts are taken in Arrow batches; a batch is one array of word numbers in which every
text is closed by a number of its own, so that no stretch reaches over a border.

*Grid.*  The first ``length - q`` words of a run equal the words ``q`` further on.  These are ``3q`` or more, so one of
the points ``1, 1 + 3q, 1 + 6q, ...`` lies among them: all periods together have a harmonic sum of points, ``n ln n / 3``.
Points around which fewer than five words repeat are no part of a run; texts without other points are left out.

*Extension.*  From a grid point a run reaches as far as the longest common extensions (LCE) of the words at ``i`` and
``i + q`` forwards and backwards.  Only the suffixes at positions whose residue lies in a difference cover are sorted
(by doubling, over names of whole blocks).  For any two positions a few steps lead to two sampled ones at once; those
words are compared, and the rest is a minimum over the sorted suffixes' common prefixes, from a sparse table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import bounded_batches

# fixed values: perfect difference sets, modulus -> residues; every difference occurs once
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}
#: Words up to which a modulus serves: larger arrays take sparser samples, so that the sparse tables stay small.
SPARSER = ((1 << 20, 13), (1 << 22, 31), (1 << 63, 73))
#: Shortest run, and least words in periods.
LEAST, PERIODS = 6, 4
#: Extensions computed at once.
CHUNK = 1 << 18
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Extensions:
    """Longest common extensions of an integer array: ``lce(i, j)`` is the number of equal items from i and j on."""

    def __init__(self, x: np.ndarray, v: int) -> None:
        """``x`` holds numbers from 0 on; v is the modulus of a cover."""
        self.v, self.n = v, len(x)
        # numbers of their own behind the end: nothing equals them
        self.x = np.concatenate([x, x.max(initial=0) + 1 + np.arange(2 * v)]).astype(np.int64)
        cover = np.array(COVERS[v])
        inside = np.isin(np.arange(v), cover)
        far = np.arange(v)[:, None, None] + np.arange(v)[None, None, :]
        both = inside[far % v] & inside[far.transpose(1, 0, 2) % v]
        self.shift = both.argmax(axis=2)  # least steps to two sampled positions, by both residues
        per_class = [np.arange(d, self.n, v) for d in cover]
        starts = np.cumsum([0, *(len(p) for p in per_class)])
        self.start_of = np.zeros(v, np.int64)
        self.start_of[cover] = starts[:-1]
        self._sort(np.concatenate(per_class), np.repeat(starts[1:], [len(p) for p in per_class]))

    def _sort(self, pos: np.ndarray, end: np.ndarray) -> None:
        """Ranks of the sampled suffixes and the common prefixes of neighbours; the sample after s is s + 1, in its class."""
        m = len(pos)
        bits = max(int(self.x.max()).bit_length(), 1)
        width = max(63 // bits, 1)  # words packed in a number
        keys = []
        for t in range(0, self.v, width):
            key = np.zeros(m, np.int64)
            for u in range(t, min(t + width, self.v)):
                key = (key << bits) | self.x[pos + u]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        levels, h, at = [rank.astype(np.int32)], 1, np.arange(m)
        while m and rank.max() < m - 1:
            inner = at + h < end
            after = np.zeros(m, np.int64)
            after[inner] = rank[at[inner] + h] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1]
            levels.append(rank.astype(np.int32))
            h *= 2
        self.rank = rank
        order = np.empty(m, np.int64)
        order[rank] = at
        a, b = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            ends = [np.where(s < m, end[np.minimum(s, m - 1)], 0) for s in (order[:-1], order[1:])]
            here = (a < ends[0]) & (b < ends[1])
            same = np.zeros(len(a), bool)
            same[here] = levels[k][a[here]] == levels[k][b[here]]
            a[same] += 1 << k
            b[same] += 1 << k
            lcp[same] += self.v << k
        i, j = pos[order[:-1]] + lcp, pos[order[1:]] + lcp
        open_ = np.maximum(i, j) < self.n
        for _ in range(self.v):
            at_ = np.flatnonzero(open_)
            same = self.x[i[at_]] == self.x[j[at_]]
            open_[at_[~same]] = False
            for y in (i, j, lcp):
                y[at_[same]] += 1
            open_ &= np.maximum(i, j) < self.n
        self.table = [lcp.astype(np.int32)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, w = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-w], last[w:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions must differ pair by pair."""
        d = self.shift[i % self.v, j % self.v]
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for t in range(int(d.max(initial=0))):
            live = live[(d[live] > t) & (out[live] == t)]
            live = live[self.x[i[live] + t] == self.x[j[live] + t]]
            out[live] += 1
        a, b = i + d, j + d
        live = np.flatnonzero((out == d) & (np.maximum(a, b) < self.n))
        ra, rb = (self.rank[self.start_of[y[live] % self.v] + y[live] // self.v] for y in (a, b))
        lo, width = np.minimum(ra, rb), np.abs(ra - rb)
        level = np.frexp(width)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.table[k]
            out[live[at]] += np.minimum(t[lo[at]], t[lo[at] + width[at] - (1 << k)])
        return out


def _grid(x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and their periods around which enough words repeat; ``reach[q - 1]`` is where the texts that are long
    enough for period q end (longer texts come first).  Blocks hold whole periods, of about ``CHUNK`` points."""
    every = np.arange(1, len(reach) + 1)
    each = -(-(reach - every - 1) // ((PERIODS - 1) * every))
    upto = np.cumsum(each)
    first = 0
    while first < len(every):
        before = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, before + CHUNK, "right")), first + 1)
        q = np.repeat(every[first:last], each[first:last])
        k = np.arange(len(q)) - np.repeat(upto[first:last] - each[first:last] - before, each[first:last])
        i = 1 + (PERIODS - 1) * q * k
        at = np.flatnonzero(x[i] == x[i + q])
        i, q, first = i[at], q[at], last
        beside = np.zeros(len(i), np.int64)  # equal words besides the point's own; four are needed for any period
        for way in (1, -1):
            live = np.arange(len(i))
            for t in range(1, 5):
                live = live[x[i[live] + way * t] == x[i[live] + q[live] + way * t]]
                beside[live] += 1
        at = np.flatnonzero(beside >= 4)
        if len(at):
            yield i[at], q[at]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Word numbers of each text -> its runs as rows ``start, length, period``, by start, then period."""
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    by_size = sorted((k for k in range(len(texts)) if len(texts[k]) >= LEAST), key=lambda k: -len(texts[k]))
    if not by_size:
        return out
    x, starts = _joined([texts[k] for k in by_size])
    sizes = np.array([len(texts[k]) for k in by_size])
    found = list(_grid(x, _reach(starts, sizes)))
    if not found:
        return out
    points, periods = (np.concatenate(part) for part in zip(*found))
    # only texts that have points are sorted
    of = np.searchsorted(starts, points, "right") - 1
    used = np.unique(of)
    x, again = _joined([texts[by_size[k]] for k in used])
    points = points - starts[of] + again[np.searchsorted(used, of)]
    v = next(v for most, v in SPARSER if len(x) <= most)
    ahead, behind, n = Extensions(x, v), Extensions(x[::-1], v), len(x)
    kept = []
    for c in range(0, len(points), CHUNK):
        i, q = points[c : c + CHUNK], periods[c : c + CHUNK]
        back = behind.lce(n - i, n - i - q)
        length = back + ahead.lce(i, i + q) + q
        ok = length >= np.maximum(LEAST, PERIODS * q)
        kept.append(np.unique(np.stack([(i - back)[ok], length[ok], q[ok]], axis=1), axis=0))
    rows = np.unique(np.concatenate(kept), axis=0)
    # multiples of a run's period have the same extent: the first row of an extent has the smallest period
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = np.searchsorted(again, rows[:, 0], "right") - 1
    rows[:, 0] -= again[text]
    for k, part in zip(*_split(text, rows)):
        out[by_size[used[k]]] = part
    return out


def _split(key: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(key):
        return [], []
    cuts = np.flatnonzero(np.diff(key)) + 1
    return key[np.r_[0, cuts]].tolist(), np.split(rows, cuts)


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array, with a number of its own before each text and at the end, and the start of each text in it."""
    sizes = np.array([len(t) for t in texts])
    starts = 1 + np.cumsum(np.r_[0, sizes[:-1] + 1])
    x = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    top = max(int(t.max()) for t in texts) + 1
    x[starts - 1] = top + np.arange(len(texts))
    x[-1] = top + len(texts)
    for s, t in zip(starts.tolist(), texts):
        x[s : s + len(t)] = t
    return x, starts


def _reach(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each period that any text is long enough for, the end of the last such text (sizes fall)."""
    q = np.arange(1, max(int(sizes[0]) // PERIODS, 1) + 1)
    texts = np.searchsorted(-sizes, -np.maximum(LEAST, PERIODS * q), "right")
    return (starts + sizes)[texts - 1]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run contains after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words`` long, ``runs`` (array of start, length, period; by start, then
    period) and ``collapsed`` string, the text without repetitions.

    Words are what ASCII white space parts.  A null or empty text has no words, no runs and an empty ``collapsed``; rows
    with null ids, repeated rows and empty tables are taken as they are.  Columns named like a result are replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed")]
    chosen = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text"), f"n_words long, runs {RUNS}, collapsed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = defaultdict(count().__next__)
            words = [(t or "").encode().split() for t in b.column(len(kept)).to_pylist()]
            runs = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words])
            rows = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
            ends = pa.array(np.cumsum([0, *(len(r) for r in runs)]), pa.int32())
            inner = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(_RUNS.value_type))
            made = [pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(ends, inner), pa.array([collapsed(w, r).decode() for w, r in zip(words, runs)], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *made], names=[*kept, "n_words", "runs", "collapsed"])

    return chosen.mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with periods planted in a tenth of the texts, by a hash of the id; a null id plants nothing.

    With h = crc32(doc_id), g = floor(h / 10), n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), every word i
    from a on becomes word a + (i - a) % p.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    split = split.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    split = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    split = split.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    copies = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    woven = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(copies, F.lit(1), rest))
    return split.select("doc_id", F.when(F.col("n") > 0, F.concat_ws(" ", woven)).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """``doc_id`` and what its runs come to: number, the run of greatest length / period, hashes of runs and text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs are ordered, so the first of equal exponents stays; compared as whole numbers
    best = F.aggregate("runs", none, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

