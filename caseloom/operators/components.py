"""Connected components of an edge table by randomised contraction.

Every round each vertex points at the neighbour (or itself) that a hash of this
round ranks first, and edges move to the vertices pointed at.  The hash makes
the expected number of vertices fall by a constant factor even on long paths,
so rounds are logarithmic.  Only aggregates and equi-joins are used; a hub's
rows are pre-aggregated before the shuffle, and its join can be split by AQE.
Every round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.scratch import save


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node id reachable from node.

    edges: two columns of one integral type.  Self-loops, repeats and nulls are
    ignored; a node without another neighbour is not in the result.  An empty
    table gives an empty result.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    live = save(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") < F.col("b")))
        .distinct(),
        "edges",
    )
    moves: list[DataFrame] = []
    while not live.isEmpty():
        salt = F.lit(len(moves))
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(live.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", salt).alias("h"), F.col("v").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("u", salt).alias("h"), F.col("u").alias("id"))
        move = save(first.select("u", F.least(own, F.col("m"))["id"].alias("p")), "moves")
        moves.append(move)
        left = live.join(move.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
        full = left.join(move.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        live = save(full.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a <> b").distinct(), "edges")
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = moves[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for move in moves[1:]:
        at = at.join(move.select(F.col("u").alias("root"), F.col("p").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    at = save(at, "labels")
    names = at.groupBy("root").agg(F.min("node").alias("component"))
    return at.join(names, "root").select("node", "component")
