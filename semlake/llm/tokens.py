"""Exact token counts of a byte-level BPE vocabulary by a map-side two-tier lookup.

Texts are cut into pre-tokens, whose token counts add up.  Tier one is a compact table of the pre-tokens that a bounded
sample of the corpus shows to be frequent and of the vocabulary's whole words; it is built once and broadcast.
Tier two is a cache in each Python worker, filled by the tokenizer for the misses and emptied at a fixed size.  No
pre-token is ever shuffled, and the tables only save time: every count equals the library's.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.common import bounded_batches, with_text_columns

#: How byte-level BPE vocabularies of this family cut text before merging (a fixed value of the format).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bounds: documents sampled for the frequency table (about), entries it takes from them, entries of a worker's cache.
SAMPLE_DOCS = 2000
TABLE = 50_000
CACHE = 400_000

_workers: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceCounter:
    """Token counts of texts, with the two tables; one per Python worker."""

    def __init__(self, spec: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        pre = conf.get("pre_tokenizer") or {}
        if conf.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level vocabularies without normaliser and prefix space are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in conf["added_tokens"]):
            raise ValueError("added tokens that strip or bind to words are not supported")
        self.encode = Tokenizer.from_str(spec).encode_batch
        specials = sorted((t["content"] for t in conf["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.split = regex.compile(PRE_TOKEN).findall
        self.frequent = frequent
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Special strings in the text, and the stretches between them."""
        if self.special is None or not self.special.search(text):
            return 0, [text]
        return len(self.special.findall(text)), self.special.split(text)

    def count(self, texts: list[str]) -> list[int]:
        totals, cut = [], []
        for text in texts:
            n, pieces = self.pieces(text)
            totals.append(n)
            cut.append([t for p in pieces for t in self.split(p)])
        one, two = self.frequent, self.cache
        missing = list({t for words in cut for t in words if t not in one and t not in two})
        if len(two) + len(missing) > CACHE:
            two.clear()
            missing = list({t for words in cut for t in words if t not in one})
        for i in range(0, len(missing), 4096):
            part = missing[i : i + 4096]
            two.update(zip(part, (len(e) for e in self.encode(part, add_special_tokens=False))))
        both = {**two, **one} if len(two) < 1000 else None
        for i, words in enumerate(cut):
            totals[i] += sum([both[t] for t in words]) if both else sum([one[t] if t in one else two[t] for t in words])
        return totals


def _counter(key: str, spec: str, frequent: dict[str, int]) -> PieceCounter:
    if key not in _workers:
        _workers.clear()
        _workers[key] = PieceCounter(spec, frequent)
    return _workers[key]


def vocabulary_words(spec: str) -> list[str]:
    """The vocabulary's entries that are pre-tokens of their own (bounded by the vocabulary)."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    split = regex.compile(PRE_TOKEN).fullmatch
    words = (t.decode([i]) for i in t.get_vocab(with_added_tokens=False).values())
    return [w for w in words if w and "\ufffd" not in w and split(w)]


def frequent_lengths(texts: DataFrame, spec: str, sample_docs: int = SAMPLE_DOCS, table: int = TABLE) -> dict[str, int]:
    """Token counts of frequent pre-tokens: the vocabulary's whole words, and the ``table`` most frequent ones of a
    sample of about ``sample_docs`` texts, which is spread over the corpus by the id's hash and counted by Spark."""
    total = texts.count()
    every = max(1, total // sample_docs)
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = PieceCounter(spec, {}), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                for piece in c.pieces(text)[1]:
                    n.update(c.split(piece))
            if len(n) > 8 * table:
                n = Counter(dict(n.most_common(4 * table)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    counts = sample.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
    words = {r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(table).collect()}.union(vocabulary_words(spec))
    words = sorted(words)
    return dict(zip(words, map(len, PieceCounter(spec, {}).encode(words, add_special_tokens=False))))


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    A null text counts as empty: no bytes, no tokens.  Special strings inside a text count as the library has them by
    default, as one token.  Repeated rows stay, null ids stay, an empty table gives an empty table, other columns are
    not read.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path or default_path(), encoding="utf-8") as f:
        spec = f.read()
    rows = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, spec, frequent_lengths(rows, spec)))

    def make():
        counter = _counter(*shared.value)
        return lambda texts: [counter.count([t or "" for t in texts])]

    sized = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = with_text_columns(sized, make, {"n_tokens": "long"}, keep_text=False)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
