"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its words' character n-grams (hashed), as in fastText.  The model is trained
by stochastic gradient descent in numpy on a bounded sample of texts and pieces of them; one part of the sample sets the
temperature and the score under which a prediction is marked as rejected.  Since the model is linear after the lookup,
a word's summed logits are cached per worker, and scoring is a map over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import bounded_batches, crc_mod, shuffle_width, with_text_columns

#: Bound: texts in the training sample (about).
TRAIN_ROWS = 4000
BUCKETS = 1 << 15
DIM = 16
NGRAMS = (1, 2, 3)
EPOCHS = 8
BATCH = 64
RATE = 0.5
CACHE = 300_000
#: Share of right predictions of the calibration part that the rejection score leaves in.
KEEP = 0.995
WORD = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
#: Pieces of a training text that are learned as texts of their own, so that short texts are met; words in a piece.
PIECES, PIECE_WORDS = 3, 40
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case.  The quick pattern takes fractions, Roman numerals and the like for letters."""
    low = (text or "").lower()
    words = WORD.findall(low)
    return words if all(map(str.isalpha, words)) else LETTERS.findall(low)


def subwords(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in NGRAMS for i in range(len(w) - n + 1)]


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # logits of each bucket: embedding times output matrix
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    cache: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.cache = {}
        self.sums = np.zeros((1024, len(self.langs) + 1))

    def _place(self, word: str) -> int:
        at = len(self.cache)
        if at == len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        ids = subwords(word)
        self.sums[at, :-1] = self.table[ids].sum(axis=0)
        self.sums[at, -1] = len(ids)
        self.cache[word] = at
        return at

    def logits(self, text: str | None) -> np.ndarray | None:
        """Logits of a text, None if it has no letter."""
        words = words_of(text)
        if not words:
            return None
        if len(self.cache) > CACHE:
            self._reset()
        total, cache = np.zeros(len(self.langs) + 1), self.cache
        for i in range(0, len(words), 50_000):
            at = [cache[w] if w in cache else self._place(w) for w in words[i : i + 50_000]]
            total += self.sums[at].sum(axis=0)
        return total[:-1] / total[-1] + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if self.langs else None
        if z is None:
            return UNKNOWN, 0.0, True
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.reject_below)


def _bag(words: list[str], known: dict[str, np.ndarray]) -> tuple[bytes, bytes]:
    """The subwords of some words and their numbers, as bytes: at most as many as there are buckets."""
    if len(known) > CACHE:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = np.array(subwords(w), np.int32)
    ids, times = np.unique(np.concatenate([known[w] for w in words]), return_counts=True)
    return ids.tobytes(), times.astype(np.int32).tobytes()


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts -> the bag of each whole text, and those of pieces of it, at places drawn from its digest."""
    known: dict[str, np.ndarray] = {}
    for pdf in batches:
        rows = []
        for digest, text, lang in zip(pdf["digest"], pdf["text"], pdf["lang"]):
            words = words_of(text)
            if not words:
                continue
            rows.append((digest, lang, True, *_bag(words, known)))
            for k in range(PIECES if len(words) > PIECE_WORDS else 0):
                at = zlib.crc32(f"{digest}{k}".encode()) % len(words)
                rows.append((digest, lang, False, *_bag(words[at : at + 1 + at % PIECE_WORDS], known)))
        if rows:
            yield pd.DataFrame(rows, columns=["digest", "lang", "whole", "ids", "times"])


class _Batch:
    """Bags in a row: their subwords and shares end to end, with the place of each bag."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.shares = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])[:, None]
        sizes = np.array([len(b[0]) for b in bags])
        self.starts, self.owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(bags)), sizes)

    def mean(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.ids] * self.shares, self.starts, axis=0)


def _sgd(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    emb, out, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, n_langs)), np.zeros(n_langs)
    out += rng.normal(0, 0.1, out.shape)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            batch = _Batch([bags[k] for k in part])
            hidden = batch.mean(emb)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            back = p @ out.T
            out -= rate * hidden.T @ p / len(part) * 8
            bias -= rate * p.mean(axis=0)
            step = rate * 4 * batch.shares * back[batch.owner]
            for d in range(DIM):
                emb[:, d] -= np.bincount(batch.ids, step[:, d], BUCKETS)
    return emb @ out, bias


def fit(docs: DataFrame, fold: int = 2, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on ``docs(doc_id, text, lang)`` outside the held-out fold (crc32 mod 4 = ``fold``).

    Rows with a null text, language or id, and texts without a letter, are not used.  Copies count once, with the
    language that most of them have (on a tie the first in order).  Without any row the model knows no language.  The
    driver gets the bags of subwords of the sampled texts, not the texts.
    """
    bounded_batches(docs.sparkSession)
    usable = docs.filter("lang is not null and doc_id is not null and text is not null").filter(crc_mod("doc_id", 4) != fold)
    n = usable.select("doc_id").count()
    share = min(1.0, train_rows / max(n, 1))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    # copies are grouped by digest, so that no text is a shuffle key
    by_lang = picked.groupBy(F.sha2("text", 256).alias("digest"), "lang").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    once = by_lang.groupBy("digest").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("lang").cast("string").alias("lang"))).alias("m"), F.first("text").alias("text"))
    spread = once.select("digest", "text", F.col("m.lang").alias("lang")).repartition(shuffle_width(docs.sparkSession))
    made = spread.mapInPandas(_bags, "digest string, lang string, whole boolean, ids binary, times binary")
    rows = made.orderBy("digest", F.desc("whole"), F.hash("ids")).collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    known = {lang: i for i, lang in enumerate(langs)}
    bags = [(np.frombuffer(r["ids"], np.int32).astype(np.int64), (t := np.frombuffer(r["times"], np.int32)) / t.sum()) for r in rows]
    target = np.array([known[r["lang"]] for r in rows])
    # a fifth of the texts, by digest, calibrates; the others train, with their pieces
    aside = np.array([int(r["digest"][:8], 16) % 5 == 0 for r in rows]) if len(rows) >= 50 else np.zeros(len(rows), bool)
    train = np.flatnonzero(~aside)
    table, bias = _sgd([bags[i] for i in train], target[train], len(langs))
    model = LanguageModel(langs, table, bias)
    whole = np.array([r["whole"] for r in rows])
    calibration = np.flatnonzero(whole & aside) if (whole & aside).any() else np.flatnonzero(whole)
    z = _Batch([bags[i] for i in calibration]).mean(table) + bias
    y = target[calibration]

    def loss(t: float) -> float:
        s = (z - z.max(axis=1, keepdims=True)) / t
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

    model.temperature = min(np.geomspace(0.05, 20, 80), key=loss)
    s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    top, right = (s / s.sum(axis=1, keepdims=True)).max(axis=1), z.argmax(axis=1) == y
    model.reject_below = float(np.quantile(top[right], 1 - KEEP)) if right.any() else 0.0
    return model


def identify(docs: DataFrame, model: LanguageModel, fold: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``, one row per input row.

    ``und`` with score 0 for null texts and texts without a letter.  ``rejected`` marks predictions under the calibrated
    score; they keep their best language.  Language, source and id are no inputs of a prediction.  Null ids are held in
    no fold (held_out null); repeated rows stay; an empty table gives an empty table; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: zip(*map(m.predict, texts))

    rows = docs.select("doc_id", (crc_mod("doc_id", 4) == fold).alias("held_out"), "text")
    return with_text_columns(rows, make, {"lang_pred": "string", "score": "double", "rejected": "boolean"}, keep_text=False)
