"""Mixing to target weights by iterative proportional fitting.

Documents are summed to cells of (source, language, topic).  A cell's probability is ``min(1, product of a factor for
its value in each dimension)``; raking sets the factors of one dimension at a time so that the expected tokens of each of
its values are its target's.  The bound is part of the raking: what full cells can't give, the others of the value give,
and the other dimensions follow.  Documents are then kept by these probabilities under a keyed hash of their id.

Targets can ask for more than there is: if a value would need more tokens than it has, or raking doesn't meet all
targets, the budget is lowered, so that shares are met with fewer tokens.  Targets that contradict each other or the
empty cells at any budget are reported: ``targets_met`` is false, and :func:`marginals` has what was reached.

The cells are counted by Spark.  Up to ``ARRAY_CELLS`` of them are raked in arrays; more by joins with factor tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from semlake.llm.common import materialise, respread

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 300
#: Largest difference of an expected share from its target that counts as met.
TOLERANCE = 1e-5
#: Budgets tried before targets are reported as not met, and the step between them.
BUDGETS, LOWER = 12, 0.75
#: Factors stay below this, so that products of contradicting ones stay finite.
LARGEST = 1e60
#: Cells up to which they are raked in arrays of the driver and their probabilities broadcast; the result is the same.
ARRAY_CELLS = 100_000
#: Share of all tokens to keep.
BUDGET = 0.5
SEED = "mix-1"


def shape_topic(text: str = "text") -> Column:
    """A topic from the shape of a text, for tables without one: none, tabular, symbols, long or short prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.length(F.trim(t)) == 0, "none").when(t.contains(" | "), "tabular").when(t.rlike(r"[#$%&*]{3}"), "symbols").when(F.length(t) > 2000, "long").otherwise("short")


def n_tokens(text: str = "text") -> Column:
    """Words of a text: what weights count."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def _shares(cells: DataFrame, dim: str, given: dict[str, float] | None, power: float = 0.5) -> DataFrame:
    """``(dim, tokens, share)`` of the values that occur: the given targets, scaled over these, or tokens to a power."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens"))
    if given:
        wanted = cells.sparkSession.createDataFrame(pd.DataFrame({dim: list(given), "raw": [float(v) for v in given.values()]}), f"{dim} string, raw double")
        sums = sums.join(wanted, dim, "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    else:
        sums = sums.withColumn("raw", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(power))).otherwise(0.0))
    sums = materialise(sums, f"target-{dim}")
    scale = sums.agg(F.sum("raw")).first()[0] or 1.0
    return sums.select(dim, "tokens", (F.col("raw") / F.lit(scale)).alias("share"))


def _factor(goal, full, open_, every, old, where):  # noqa: ANN001, ANN202  arrays or columns
    """The next factor of a value: the Newton step for ``full + factor * open = goal``.  Expected tokens are a concave
    function of the factor, so steps from below stay below; a step from too far above starts again at the tangent of 0."""
    return where((open_ > 0) & (goal > full), (goal - full) / where(open_ > 0, open_, 1.0), where((open_ > 0) | (full > goal), goal / where(every > 0, every, 1.0), where(every > 0, old, 0.0)))


def _in_arrays(cells: pd.DataFrame, shares: dict[str, pd.DataFrame], goal: float) -> tuple[pd.DataFrame, float]:
    tokens = cells["tokens"].to_numpy(float)
    code, goals = {}, {}
    for d, t in shares.items():
        code[d] = pd.Index(t[d]).get_indexer(cells[d])
        goals[d] = t["share"].to_numpy() * goal
    factors = {d: np.ones(len(t)) for d, t in shares.items()}
    off = math.inf
    for _ in range(ROUNDS):
        off = 0.0
        for d in shares:
            rest = math.prod([factors[e][code[e]] for e in shares if e != d], start=np.ones(len(tokens)))
            capped = factors[d][code[d]] * rest >= 1
            full, open_, every = (np.bincount(code[d], v, len(goals[d])) for v in (tokens * capped, tokens * rest * ~capped, tokens * rest))
            off = max(off, float(np.abs(full + factors[d] * open_ - goals[d]).max(initial=0)) / goal)
            factors[d] = np.minimum(_factor(goals[d], full, open_, every, factors[d], np.where), LARGEST)
        if off < TOLERANCE:
            break
    p = np.minimum(1.0, math.prod([factors[d][code[d]] for d in shares], start=np.ones(len(tokens))))
    return cells.assign(probability=np.where(tokens > 0, p, 0.0)), off


def _by_joins(cells: DataFrame, shares: dict[str, DataFrame], goal: float) -> tuple[DataFrame, float]:
    factors = {d: t.select(d, "share", F.lit(1.0).alias(f"f_{d}")) for d, t in shares.items()}

    def joined() -> DataFrame:
        out = cells
        for d, f in factors.items():
            out = out.join(f.select(d, f"f_{d}"), d)
        return out

    off = math.inf
    for _ in range(ROUNDS):
        gaps = []
        for d in shares:
            rest = math.prod([F.col(f"f_{e}") for e in shares if e != d], start=F.lit(1.0))
            capped, aim = F.col(f"f_{d}") * rest >= 1, F.col("share") * F.lit(goal)
            mass = F.col("tokens") * rest
            sums = joined().groupBy(d).agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).cast("double").alias("full"), F.sum(F.when(capped, 0.0).otherwise(mass)).alias("open"), F.sum(mass).alias("every"))
            step = factors[d].join(sums, d)
            new = _factor(aim, F.col("full"), F.col("open"), F.col("every"), F.col(f"f_{d}"), lambda c, x, y: F.when(c, x).otherwise(y))
            step = materialise(step.select(d, "share", F.least(new, F.lit(LARGEST)).alias("new"), F.abs(F.col("full") + F.col(f"f_{d}") * F.col("open") - aim).alias("gap")), "factors")
            factors[d] = step.select(d, "share", F.col("new").alias(f"f_{d}"))
            gaps.append(step.agg(F.max("gap")).first()[0] or 0.0)
        off = max(gaps) / goal
        if off < TOLERANCE:
            break
    p = F.least(F.lit(1.0), math.prod([F.col(f"f_{d}") for d in factors], start=F.lit(1.0)))
    return joined().select(*cells.columns, F.when(F.col("tokens") > 0, p).otherwise(0.0).alias("probability")), off


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | None], budget: float, array_cells: int = ARRAY_CELLS) -> DataFrame:
    """``cells(dims..., tokens, docs)`` -> the same with ``probability``, ``weight`` (the cell's share of the expected
    tokens) and ``targets_met``.

    Targets are scaled over the values that occur; values without one get nothing.
    """
    shares = {d: _shares(cells, d, t) for d, t in targets.items()}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    few = cells.limit(array_cells + 1).count() <= array_cells
    # no value can give more than it has
    for t in shares.values():
        most = t.filter("share > 0").agg(F.min(F.col("tokens") / F.col("share"))).first()[0]
        budget = min(budget, most / total) if most is not None and total else budget
    local = cells.toPandas() if few else None
    at_hand = {d: t.toPandas() for d, t in shares.items()} if few else shares
    met = False
    for _ in range(BUDGETS):
        goal = budget * total or 1.0
        raked, off = _in_arrays(local, at_hand, goal) if few else _by_joins(cells, at_hand, goal)
        met = off < TOLERANCE or not total
        if met:
            break
        budget *= LOWER
    out = cells.sparkSession.createDataFrame(raked, StructType([*cells.schema, StructField("probability", DoubleType())])) if few else raked
    out = materialise(out, "raked")
    kept = out.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 1.0
    return out.withColumns({"weight": F.col("tokens") * F.col("probability") / F.lit(kept), "targets_met": F.lit(met)})


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: str = SEED, topic: Column | None = None, array_cells: int = ARRAY_CELLS) -> DataFrame:
    """All columns of ``docs`` with ``topic, n_tokens, weight, probability, sampled, targets_met``.

    ``weight`` is the share of the expected tokens that the document's cell gives, ``probability`` that of each document
    in it, ``sampled`` the draw: a hash of seed and id under the probability, the same in every run and for repeated
    rows; ``targets_met`` tells whether every marginal of the expected tokens is its target.  Null dimensions are a value
    of their own (``?``); texts without a token have probability 0 in cells without any token and that of their cell
    otherwise.  Columns of the input named like a result column are replaced; any others, whatever their names, stay.
    """
    made = ("n_tokens", "weight", "probability", "sampled", "topic", "targets_met")
    kept = [c for c in docs.columns if c not in made]
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic if topic is not None else shape_topic()}
    # input and cell columns live in structs of their own, so that no name can clash
    base = docs.select(F.struct(*kept).alias("d"), F.struct(*(F.coalesce(c.cast("string"), F.lit("?")).alias(k) for k, c in dims.items())).alias("c"), n_tokens().alias("n_tokens"))
    cells = materialise(base.groupBy("c").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).select("c.*", "tokens", "docs"), "cells")
    raked = rake(cells, {d: (targets or {}).get(d) for d in DIMENSIONS}, budget, array_cells)
    rates = raked.select(F.struct(*DIMENSIONS).alias("c"), F.struct("weight", "probability", "targets_met").alias("r"))
    few = raked.limit(array_cells + 1).count() <= array_cells
    out = base.join(F.broadcast(rates) if few else respread(rates), "c", "left")
    text = F.col("d")["text"] if "text" in kept else F.lit("")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("d")["doc_id"].cast("string"), F.md5(F.coalesce(text, F.lit("")))))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return out.select("d.*", F.col("c")["topic"].alias("topic"), "n_tokens", F.col("r")["weight"].alias("weight"), F.col("r")["probability"].alias("probability"), (draw < F.col("r")["probability"]).alias("sampled"), F.col("r")["targets_met"].alias("targets_met"))


def marginals(out: DataFrame, dim: str) -> DataFrame:
    """``(dim, share)``: the share of the expected tokens that each value of a dimension has in a mixed table."""
    sums = out.groupBy(F.coalesce(F.col(dim).cast("string"), F.lit("?")).alias(dim)).agg(F.sum(F.col("probability") * F.col("n_tokens")).alias("tokens"))
    total = sums.agg(F.sum("tokens")).first()[0] or 1.0
    return sums.select(dim, (F.col("tokens") / F.lit(total)).alias("share"))


def expected_tokens(out: DataFrame) -> float:
    return out.agg(F.sum(F.col("probability") * F.col("n_tokens"))).first()[0] or math.nan
