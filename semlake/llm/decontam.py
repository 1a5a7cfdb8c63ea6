"""Benchmark decontamination by template windows.

Texts become units with typed placeholders: numbers with their scale words, units of measure after a number, and names.
A run of capitalised words is one name, whatever its length; a capitalised word that opens a sentence or line may be a word or
the first of a name, so there are two readings of a text beside the plain one of its lower-case words.  Windows of five
units of the benchmark items are hashed in each reading and form the build side of a map-side hash join, a sorted array
that a document's windows probe.  The hits of an item are aligned by position; an item is found where its windows cover
at least 0.8 of its words.  A value of the item stands for one value of the document, the most frequent one; windows
that say otherwise don't count, and on a tie none with that value does.  Windows of slots alone count beside others on
the same diagonal.  So a question asked anew with other numbers and names is caught, and a text that merely has the
same shape is not.

An item of fewer than five words is found where it is a whole sentence or line; one with fewer than two words that are
no slots only where it is the whole text, word for word.

The benchmark is broadcast in blocks of bounded size, one scan of the documents for each block.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import bounded_batches

WINDOW = 5
COVERAGE = 0.8
#: Words that are no slots which the template windows of one occurrence must have together.
MIN_LITERAL = 2
#: Insertions and deletions between neighbouring hits of one occurrence, in words.
DRIFT = 3
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 8_000_000
CACHE = 400_000
#: Characters of the texts that are taken together, so that array operations are few; a NUL parts them.
GROUP_CHARS = 1 << 16
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n\0]")
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces ton tons ml l liter liters litre litres gallon gallons square cubic "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "degree degrees mph kmh volt volts watt watts stunde stunden tag tage woche wochen jahr jahre meter mètre mètres heure heures jour jours an ans metro metros hora horas día días año años".split()
)
SPELT = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
TITLES = frozenset("mr mrs ms dr prof st herr frau".split())
_WORD, _CAPITAL, _NUMBER, _STOP, _UNIT, _SPELT, _LINE, _TITLE, _PER, _PART = range(10)
#: Kinds of slots: none, name, number, unit.
_NAME, _NUM, _MEASURE = 1, 2, 3
_SLOT = np.array([0, 0x4E414D45 << 8, 0x4E554D42 << 8, 0x554E4954 << 8], np.int64)
#: A window's hash is a polynomial in an odd number modulo 2^64, taken from sums over all units.
_MIX = 0x9E3779B97F4A7C15
_BACK = pow(_MIX, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(0, np.uint64)] * 2
#: The readings: lower-case words, openers as words, openers as names.
PLAIN, WORDS, NAMES = range(3)

_indexes: dict[str, Index] = {}


class _Codes(dict):
    """Token -> hash of its lower-case form with its kind in the low four bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        low = token.lower()
        if token[0].isdigit():
            kind = _NUMBER
        elif low in SPELT:
            kind = _SPELT
        elif token in ".!?":
            kind = _STOP
        elif token == "\n":
            kind = _LINE
        elif token == "\0":
            kind = _PART
        elif low in UNITS:
            kind = _UNIT
        elif low == "per":
            kind = _PER
        elif token[0].isupper():
            kind = _TITLE if low in TITLES else _CAPITAL
        else:
            kind = _WORD
        code = self[token] = (xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) >> 5) << 4 | kind
        return code


def _before(flags: np.ndarray) -> np.ndarray:
    """The flags of the element before each one; none before the first."""
    out = np.zeros(len(flags), bool)
    out[1:] = flags[:-1]
    return out


def _power_table(n: int) -> list[np.ndarray]:
    """Powers of the number and of its inverse, up to n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MIX, _BACK)):
            steps = np.full(max(n, 1 << 15), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _counts(flags: np.ndarray, size: int) -> np.ndarray:
    """The number of set flags in each window."""
    sums = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=sums[1:])
    return sums[size:] - sums[:-size]


class Reading:
    """Units of a text: the words [start, end) of each, its kind of slot (0: none) and its code."""

    def __init__(self, literal: np.ndarray, slot: np.ndarray, merged: np.ndarray | None = None):
        self.start = np.arange(len(literal)) if merged is None else np.flatnonzero(~merged)
        self.end = np.empty_like(self.start)
        self.end[:-1], self.end[-1:] = self.start[1:], len(literal)
        self.slot, self.code = slot, literal
        if merged is not None:
            self.slot = slot[self.start]
            self.code = np.where(self.slot == 0, literal[self.start], _SLOT[self.slot])

    def __len__(self) -> int:
        return len(self.start)


class Canonical:
    """The words of some texts in their three readings, with the places where sentences and lines begin and end."""

    def __init__(self, texts: list[str | None], codes: _Codes):
        tokens = TOKEN.findall("\0".join([t.replace("\0", " ") if t else "" for t in texts]))
        raw = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
        kind = raw & 15
        stop = (kind == _STOP) & ~_before(kind == _TITLE)
        part = kind == _PART
        line = (kind == _LINE) | part
        at = np.flatnonzero(~(line | (kind == _STOP)))
        self.tokens, self.at, self.text = tokens, at, np.cumsum(part)[at]
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))  # words of text i: bounds[i] to bounds[i + 1]
        breaks = np.cumsum(stop | line)[at]
        kind, literal = kind[at], raw[at] & ~15
        opens, ends = np.ones(len(at), bool), np.ones(len(at), bool)
        opens[1:] = ends[:-1] = breaks[1:] != breaks[:-1]
        self.begins, self.ends = opens, ends
        capital = (kind == _CAPITAL) | (kind == _TITLE)
        number = (kind == _NUMBER) | (kind == _SPELT)
        unit = kind == _UNIT
        measure = unit & _before(number) & ~opens
        if measure.any():
            after = unit.copy()
            after[:-1] |= (kind == _PER)[:-1] & unit[1:] & ~opens[1:]
            for _ in range(3):
                measure |= after & _before(measure) & ~opens
        name = capital & ~opens
        self.opener = capital & opens
        slot = name * _NAME + number * _NUM + measure * _MEASURE
        within = ~opens & ((measure & _before(measure)) | ((kind == _SPELT) & _before(number)))
        self.readings = (
            Reading(literal, np.zeros(len(at), np.int64)),
            Reading(literal, slot, within | (name & _before(name))),
            Reading(literal, slot + self.opener * _NAME, within | (name & _before(capital))),
        )

    def value(self, reading: int, i: int) -> str:
        r = self.readings[reading]
        return " ".join([self.tokens[k].lower() for k in self.at[r.start[i] : r.end[i]]])

    def windows(self, reading: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of a reading; template windows hold a slot and a literal, those of the last
        reading an opener (the others are windows of the readings before)."""
        r = self.readings[reading]
        n = len(r) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power, back = _power_table(len(r))
        sums = np.zeros(len(r) + 1, np.uint64)
        np.cumsum(r.code.view(np.uint64) * back[: len(r)], out=sums[1:])
        good = self.text[r.start[:n]] == self.text[r.start[size - 1 :]]
        if reading > PLAIN:
            slots = _counts(r.slot > 0, size)
            good &= slots < size
            good &= (slots if reading == WORDS else _counts(self.opener[r.start], size)) > 0
        at = np.flatnonzero(good)
        h = (sums[at + size] - sums[at]) * power[at]
        h ^= np.uint64((size * 2 + (reading > PLAIN)) * _BACK & (1 << 64) - 1)
        h ^= h >> np.uint64(31)
        h *= np.uint64(_MIX)
        return at, h

    def slots_alone(self, size: int) -> list[int]:
        """Places of the windows of the last reading in which every unit is a slot, which no hash stands for."""
        slot = self.readings[NAMES].slot
        return [k for k in range(len(slot) - size + 1) if (slot[k : k + size] > 0).all()]


class Index:
    """The windows of a block of benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str | None]]):
        codes = _Codes()
        known = [(i, c) for i, t in items if len((c := Canonical([t], codes)).at)]
        self.ids, self.items = [i for i, _ in known], [c for _, c in known]
        self.words = np.array([len(c.at) for c in self.items], np.int64)
        self.sizes = [[min(WINDOW, len(r)) for r in c.readings] for c in self.items]
        self.bare = [c.slots_alone(s[NAMES]) if len(c.at) >= WINDOW else [] for c, s in zip(self.items, self.sizes)]
        self.bare_words = np.array([sum(int(c.readings[NAMES].end[k + s[NAMES] - 1] - c.readings[NAMES].start[k]) for k in b) for c, s, b in zip(self.items, self.sizes, self.bare)], np.int64)
        rows = []
        for n, (c, sizes) in enumerate(zip(self.items, self.sizes)):
            for reading in (PLAIN, WORDS, NAMES):
                at, h = c.windows(reading, sizes[reading])
                r = c.readings[reading]
                place = np.stack([np.full(len(at), n), np.full(len(at), reading), at, r.start[at], r.end[at + sizes[reading] - 1]])
                rows.append((h, place.astype(np.int32)))
        hashes = np.concatenate([h for h, _ in rows]) if rows else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.places = (np.concatenate([p for _, p in rows], axis=1) if rows else np.zeros((5, 0), np.int32))[:, order]
        self.probes = sorted({(r, s[r]) for s in self.sizes for r in (PLAIN, WORDS, NAMES)})
        bits = max(16, min(26, len(hashes).bit_length() + 6))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.hashes >> self.shift] = True

    def _hits(self, doc: Canonical) -> np.ndarray:
        """Columns (item, item's reading, unit, first word, end word, document's reading, unit, word, text)."""
        out = []
        for reading, size in self.probes:
            at, h = doc.windows(reading, size)
            some = np.flatnonzero(self.filter[h >> self.shift])
            if not len(some):
                continue
            low, high = np.searchsorted(self.hashes, h[some]), np.searchsorted(self.hashes, h[some], "right")
            n = high - low
            if not n.any():
                continue
            own = np.repeat(at[some], n)
            place = self.places[:, np.repeat(low - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            word = doc.readings[reading].start[own]
            out.append(np.concatenate([place, np.stack([np.full(len(own), reading), own, word, doc.text[word]])]))
        return np.concatenate(out, axis=1) if out else np.zeros((9, 0), np.int64)

    def search(self, texts: list[str | None], codes: _Codes) -> Iterator[tuple[int, int, float, bool, int]]:
        """(place of the text, item, coverage, whether slots differ, number of slots that were met as such) of the items
        found in some texts."""
        first, size = 0, 0
        for last, text in enumerate(texts, 1):
            size += len(text or "")
            if size > GROUP_CHARS or last == len(texts):
                for k, *found in self._search(Canonical(texts[first:last], codes)):
                    yield first + k, *found
                first, size = last, 0

    def _search(self, doc: Canonical) -> Iterator[tuple[int, int, float, bool, int]]:
        hits = self._hits(doc)
        if not hits.shape[1]:
            return
        # what the windows of an item can cover at best, before anything is looked at in detail
        pair = hits[8] * len(self.items) + hits[0]
        windows = np.unique(np.concatenate([pair[None], hits[1:5]]), axis=1)
        pairs, at = np.unique(windows[0], return_inverse=True)
        which, item = np.divmod(pairs, len(self.items))
        most = np.bincount(at, windows[4] - windows[3], len(pairs)) + self.bare_words[item]
        for p in np.flatnonzero(most >= COVERAGE * self.words[item]):
            n = item[p]
            mine = hits[1:8, pair == pairs[p]]
            best = self._whole(doc, which[p], n, mine) if self.words[n] < WINDOW else self._best(doc, which[p], n, mine)
            if best and best[0] >= COVERAGE:
                yield int(which[p]), self.ids[n], *best

    def _whole(self, doc: Canonical, which: int, n: int, hits: np.ndarray) -> tuple[float, bool, int] | None:
        """A short item that is a whole sentence or line of the document, or all of it."""
        own, best = self.items[n], None
        for reading, _, _, _, dreading, unit, word in hits.T.tolist():
            r = doc.readings[dreading]
            end = int(r.end[unit + self.sizes[n][reading] - 1])
            literal = int((own.readings[WORDS].slot == 0).sum())
            all_of_it = word == doc.bounds[which] and end == doc.bounds[which + 1]
            if literal < MIN_LITERAL and not (all_of_it and reading == PLAIN) or not (doc.begins[word] and doc.ends[end - 1]):
                continue
            got = self._covered(doc, which, n, [(word, reading, 0, dreading, unit)], [])
            best = got if best is None or got > best else best
        return best

    def _best(self, doc: Canonical, which: int, n: int, hits: np.ndarray) -> tuple[float, bool, int] | None:
        own, best = self.items[n], None
        # the diagonal of a window: its word in the document less its word in the item
        diagonal = hits[6] - hits[2]
        order = np.lexsort((hits[1], diagonal))
        hits, diagonal = hits[:, order], diagonal[order]
        cuts = np.flatnonzero(np.diff(diagonal) > DRIFT) + 1
        for part, diag in zip(np.split(hits, cuts, axis=1), np.split(diagonal, cuts)):
            span = np.unique(part[:4], axis=1)
            if (span[3] - span[2]).sum() + self.bare_words[n] < COVERAGE * self.words[n]:
                continue
            rows = list(zip(diag.tolist(), part[0].tolist(), part[1].tolist(), part[4].tolist(), part[5].tolist()))
            # doubtful windows may contradict firm ones: each wider set counts only where it covers more
            size = self.sizes[n][WORDS]
            firm = [x for x in rows if x[1] == PLAIN or x[1] == WORDS and x[3] == WORDS and (own.readings[WORDS].slot[x[2] : x[2] + size] == 0).sum() >= MIN_LITERAL]
            words = [x for x in rows if x[1] == PLAIN or x[1] == WORDS and x[3] == WORDS]
            bare = self.bare[n]
            tries = [(firm, [])] + [(words, bare)] * (bool(bare) or words != firm) + [(rows, bare)] * (rows != words)
            for got in [self._covered(doc, which, n, *t) for t in tries]:
                best = got if best is None or got[0] > best[0] else best
        return best

    def _covered(self, doc: Canonical, which: int, n: int, rows: list[tuple[int, int, int, int, int]], bare: list[int]) -> tuple[float, bool, int]:
        """Coverage by rows (diagonal, item's reading, unit, document's reading, unit), with the pairs of slot values."""
        own, sizes = self.items[n], self.sizes[n]
        span = lambda reading, k: range(own.readings[reading].start[k], own.readings[reading].end[k + sizes[reading] - 1])
        literal = {w for _, reading, k, _, _ in rows if reading == PLAIN for w in span(PLAIN, k)}
        windows = [(reading, k, dreading, u) for _, reading, k, dreading, u in rows if reading > PLAIN]
        if bare:
            mine, other, size = own.readings[NAMES], doc.readings[NAMES], sizes[NAMES]
            for d in {x[0] for x in rows}:
                for k in bare:
                    u = int(np.searchsorted(other.start, d + mine.start[k]))
                    inside = u + size <= len(other) and doc.bounds[which] <= other.start[u] == d + mine.start[k] and other.end[u + size - 1] <= doc.bounds[which + 1]
                    if inside and np.array_equal(mine.slot[k : k + size], other.slot[u : u + size]):
                        windows.append((NAMES, k, NAMES, u))
        pairs = {}  # window -> its slots: (kind, item's value), document's value, document's word
        for reading, k, dreading, u in windows:
            mine, other = own.readings[reading], doc.readings[dreading]
            pairs[reading, k, dreading, u] = [((int(mine.slot[k + j]), own.value(reading, k + j)), doc.value(dreading, u + j), (int(mine.start[k + j]), int(mine.end[k + j]), int(other.start[u + j]))) for j in range(sizes[reading]) if mine.slot[k + j]]
        counts: dict[tuple[int, str], Counter] = defaultdict(Counter)
        for value, word, _ in {x for p in pairs.values() for x in p}:
            counts[value][word] += 1
        stands = {}  # value of the item -> the one of the document it stands for
        for value, words in counts.items():
            (word, times), *rest = words.most_common(2)
            stands[value] = word if not rest or rest[0][1] < times else None
        good = [w for w, p in pairs.items() if all(stands[value] == word for value, word, _ in p)]
        firm = literal | {int(own.readings[r].start[k + j]) for r, k, _, _ in good for j in range(sizes[r]) if not own.readings[r].slot[k + j]}
        if len(firm) < min(MIN_LITERAL, len(own.at)):
            good = []
        covered = literal | {w for r, k, _, _ in good for w in span(r, k)}
        named = {(value, word, bool(own.opener[p[0]])) for w in good for value, word, p in pairs[w] if not literal.issuperset(range(p[0], p[1]))}
        slots = {(value, word) for value, word, opener in named if not opener or value[1] != word}
        return len(covered) / len(own.at), any(value[1] != word for value, word in slots), len(slots)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size; a block holds at least one item."""
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def _index(name: str, block: list[tuple[int, str]]) -> Index:
    """The index of a block, built once by each Python worker."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(block)
    return _indexes[name]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, coverage, reparameterised, n_slots)``, one row for each document row and item found in it.

    Null and empty texts hold nothing; items with a null text or id, or without a word, are skipped; repeated document
    rows give repeated result rows, and so do repeated items; a null doc_id is kept; without documents or items the
    result is empty; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, coverage double, reparameterised boolean, n_slots int"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, codes = _index(*shared.value), _Codes()
            for b in batches:
                found = list(index.search(b.column(1).to_pylist(), codes))
                if found:
                    at, *made = zip(*found)
                    kinds = (pa.int64(), pa.float64(), pa.bool_(), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *map(pa.array, made, kinds)], names=["doc_id", "item_id", "coverage", "reparameterised", "n_slots"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all columns.

    Null and empty texts stay, and so do repeated rows, rows without an id and, where there is no item, all rows; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema, text = docs.schema, docs.columns.index("text")
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, codes = _index(*shared.value), _Codes()
            for b in batches:
                kept = np.ones(b.num_rows, bool)
                kept[[k for k, *_ in index.search(b.column(text).cast(pa.string()).to_pylist(), codes)]] = False
                yield b.filter(pa.array(kept))

        docs = docs.mapInArrow(run, schema)
    return docs
