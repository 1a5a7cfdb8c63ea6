"""Connected components over an edge table, by alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each round is two joins against per-node minima;
the minima are aggregated map-side first and the joins are splittable by AQE, so a node with a third of all edges does
not land in one task.  Rounds are cut by tables in the shared folder; nothing is gathered on the driver but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semlake.llm.common import discard, materialise, respread


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)``, in any direction, repeats and loops allowed -> ``(node, component)``.

    Only nodes with an edge to another node appear; ``component`` is the smallest node id reachable.  Rows with a null
    end are ignored; an empty table gives an empty table.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = materialise(e, "edges")
    seen = _checksum(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("m"))
        large = e.join(respread(low), e.u == F.col("x")).select("v", F.col("m").alias("u")).distinct()
        large = materialise(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(respread(least), "v")
            .select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
            .select("e.v", "e.u")
            .filter("v != u")
            .distinct()
        )
        nxt = materialise(small, "small")
        now = _checksum(nxt)
        discard(large)
        discard(e)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
