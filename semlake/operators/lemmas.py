"""Lemmas of words from tables: a dictionary, and endings for the words that it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.sources.scratch import stored

LONGEST_ENDING = 12


def lemma_map(words: DataFrame, known: DataFrame, endings: DataFrame) -> DataFrame:
    """Distinct ``words(term)`` -> ``(term, lemma)``.

    ``known(word, lemma)`` comes first (of a word's lemmas the least); else the longest of ``endings(ending, put)`` that
    the word has, and is longer than, gives way to ``put``; else the word stays.  Every ending of an unknown word is
    looked up by one join.  Rules are few and are sent to every task; words compress so well that their files look small,
    so they are merged, never broadcast.
    """
    sure = known.groupBy("word").agg(F.min("lemma").alias("lemma"))
    first = stored(words.select("term").distinct().join(sure.hint("merge"), F.col("term") == F.col("word"), "left").select("term", "lemma"), "words")
    open_ = first.filter("lemma is null").select("term", F.explode(F.sequence(F.lit(1), F.least(F.length("term") - 1, F.lit(LONGEST_ENDING)))).alias("n")).filter("n > 0 and n < length(term)")
    tails = open_.select("term", "n", F.expr("right(term, n)").alias("ending"))
    rules = endings.groupBy("ending").agg(F.min("put").alias("put"))
    cut = tails.join(F.broadcast(rules), "ending").groupBy("term").agg(F.max_by(F.struct("n", "put"), "n").alias("r"))
    made = cut.select("term", F.concat(F.expr("left(term, length(term) - r.n)"), "r.put").alias("made"))
    return first.hint("merge").join(made, "term", "left").select("term", F.coalesce("lemma", "made", "term").alias("lemma"))


def lemmatised(postings: DataFrame, known: DataFrame, endings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``postings(key, term, tf)`` -> the same by lemma: only distinct words are looked up, and the map is joined back."""
    of = lemma_map(postings.select("term"), known, endings)
    return postings.join(of.hint("merge"), "term").groupBy(key, F.col("lemma").alias("term")).agg(F.sum("tf").alias("tf"))
