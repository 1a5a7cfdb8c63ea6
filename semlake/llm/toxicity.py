"""Counterfactually regularised toxicity classifier over word and word-stem presence.

Fitting: labelled texts (a bounded sample, copies once) -> features with their counts by label, counted by Spark ->
the most telling features -> logistic regression in numpy on the driver.  For every sentence with an identity term
there are twins with the term swapped for the others of its group; the loss adds the squared difference of the two
logits for each, so that a term that merely keeps bad company gets no weight.  A sentence and its twin differ in few
features, so Spark counts the distinct differences and the driver gets these.  Scoring is map-only over whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import bounded_batches, crc_mod, materialise, with_text_columns

#: Bounds: labelled rows used for fitting (about), features kept.
TRAIN_ROWS = 20_000
FEATURES = 4096
#: A feature must occur in so many distinct toxic training texts.
MIN_TOXIC = 3
STEMS = range(3, 9)
PENALTY = 4.0
RIDGE = 2e-3
EPOCHS = 300
CACHE = 300_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Identity terms by group; a term is swapped for the others of its group.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("female", "male"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frau", "mann"),
    ("femme", "homme"),
    ("mujer", "hombre"),
    ("muslime", "christen", "juden"),
    ("musulman", "chrétien", "juif"),
    ("musulmán", "cristiano", "judío"),
)


def stems(word: str) -> list[str]:
    """Features of one lower-case word: itself and its beginnings."""
    return [f"<{word}>", *(f"<{word[:k]}" for k in STEMS if len(word) > k)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(text: str | None) -> set[str]:
    return {f for w in words_of(text) for f in stems(w)}


def swaps(terms: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    return {t: tuple(o for o in group if o != t) for group in terms for t in group}


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function text -> probability, with a cache of the words seen."""
        weights, bias, cache = self.weights, self.bias, {}

        def score(text: str | None) -> float:
            found: set[str] = set()
            for w in words_of(text):
                hit = cache.get(w)
                if hit is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    hit = cache[w] = tuple(f for f in stems(w) if f in weights)
                if hit:
                    found.update(hit)
            z = bias + math.fsum(weights[f] for f in found)
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return score


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with labels -> features with the numbers of toxic and clean texts, summed by batch."""
    for pdf in batches:
        n: dict[str, list[int]] = {}
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            for f in features_of(text):
                n.setdefault(f, [0, 0])[int(toxic)] += 1
        yield pd.DataFrame({"f": list(n), "toxic": [x[1] for x in n.values()], "clean": [x[0] for x in n.values()]})


def _rows(batches: Iterator[pd.DataFrame], place: dict[str, int]) -> Iterator[pd.DataFrame]:
    """Texts -> the places of their kept features."""
    for pdf in batches:
        yield pd.DataFrame({"toxic": pdf["toxic"], "own": [sorted({place[f] for f in features_of(t) if f in place}) for t in pdf["text"]]})


def _twins(batches: Iterator[pd.DataFrame], place: dict[str, int], other: dict[str, tuple[str, ...]]) -> Iterator[pd.DataFrame]:
    """Texts -> for every sentence with an identity term and every swap of it, the features that go and that come.

    Equal differences are summed, so their number is bounded by the terms and the words that share their beginnings.
    """
    n: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            for sentence in SENTENCE.split((text or "").lower()):
                words = words_of(sentence)
                for w in words & other.keys():
                    rest = {f for v in words - {w} for f in stems(v)}
                    for o in other[w]:
                        gone, come = ({place[f] for f in stems(x) if f in place and f not in rest} for x in (w, o))
                        if gone != come:
                            n[tuple(sorted(gone - come)), tuple(sorted(come - gone))] += 1
    if n:
        yield pd.DataFrame({"gone": [list(k[0]) for k in n], "come": [list(k[1]) for k in n], "n": list(n.values())})


def _fit(rows: list[tuple[int, list[int]]], twins: list[tuple[list[int], list[int], int]], n_features: int, penalty: float) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with Adam on log loss + ridge + penalty * (z - z_twin)^2, a term for every twin."""
    y = np.array([r[0] for r in rows], np.float64)
    lens = np.array([len(r[1]) for r in rows])
    doc, col = np.repeat(np.arange(len(rows)), lens), np.array([c for r in rows for c in r[1]], np.int64)
    of, pc, ps = (np.array(x) for x in zip(*[(i, c, sign) for i, (gone, come, _) in enumerate(twins) for sign, side in ((1.0, gone), (-1.0, come)) for c in side])) if twins else (None, None, None)
    times = np.array([n for _, _, n in twins], np.float64)
    w, b = np.zeros(n_features), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, EPOCHS + 1):
        z = b + np.bincount(doc, w[col], len(rows))
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.bincount(col, r[doc], n_features) + RIDGE / math.sqrt(len(y)) * w
        if twins:
            d = times * np.bincount(of, ps * w[pc], len(twins))
            g += penalty * 2 / len(y) * np.bincount(pc, ps * d[of], n_features)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, train_rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> ToxicityModel:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)`` outside the held-out fold (crc32 mod 5 = 0).

    Null labels and ids are not used; of several labels of a document, and of copies of a text, the highest counts.
    With no labels, or none of a class, the model gives every text the smoothed share of toxic ones.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter("toxic is not null and doc_id is not null").filter(crc_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    share = min(1.0, train_rows / max(n, 1))
    # about train_rows rows of 12 bytes, whatever the size of the labels: small enough to broadcast
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    # copies once: a digest groups them, so that no text is a shuffle key
    texts = materialise(texts, "labelled").groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic")
    texts = materialise(texts, "training")
    n_toxic = F.sum("toxic").alias("toxic")
    totals = texts.agg(n_toxic, F.count("*").alias("n")).first()
    toxic, clean = int(totals["toxic"] or 0), totals["n"] - int(totals["toxic"] or 0)
    bias = math.log((toxic + 1) / (clean + 1))
    if not toxic or not clean:
        return ToxicityModel({}, bias)
    counts = texts.mapInPandas(_count, "f string, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    gain = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt((F.col("clean") + F.col("toxic") + 1) / (clean + toxic))
    best = counts.filter(F.col("toxic") >= MIN_TOXIC).filter(gain > 0).orderBy(gain.desc(), "f").limit(FEATURES).select("f")
    place = {r["f"]: i for i, r in enumerate(best.collect())}
    if not place:
        return ToxicityModel({}, bias)
    other = swaps(identity_terms)
    rows = texts.mapInPandas(lambda it: _rows(it, place), "toxic int, own array<int>").collect()
    twins = texts.mapInPandas(lambda it: _twins(it, place, other), "gone array<int>, come array<int>, n long").groupBy("gone", "come").agg(F.sum("n").alias("n")).orderBy("gone", "come").collect()
    w, b = _fit([(r["toxic"], r["own"]) for r in rows], [(r["gone"], r["come"], r["n"]) for r in twins], len(place), penalty)
    return ToxicityModel({f: float(w[i]) for f, i in place.items()}, float(b))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` with ``score double``, in the place of a column of that name.

    Null and empty texts get the model's base rate; repeated rows and rows without an id are scored like any other; an
    empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        one = shared.value.scorer()
        return lambda texts: [np.fromiter(map(one, texts), np.float64, len(texts))]

    return with_text_columns(docs, make, {"score": "double"})


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    Labels, language, source and id are no inputs of a score.  Null ids are held in no fold (held_out null).
    """
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text", (crc_mod("doc_id", 5) == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
