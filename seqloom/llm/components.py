"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import checkpointed, forget, without_shuffle_files

MAX_ROUNDS = 60
#: A node with more than this part of all edges is joined by broadcast; there are at most so many such nodes.
HOT = 200


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b) that isn't itself a root.

    The root of a component is its smallest node.  Each round joins the neighbours of a node to
    its smallest neighbour, from both sides in turn, so trees flatten in a logarithmic
    number of rounds.  Only aggregates and joins of the edge list are used; rounds are cut by
    checkpoints, and the driver sees counts alone.  Edges of a hub are not brought to one task.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = checkpointed(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        star, n = _state(pairs)
        if star:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * n).where("b > a")
        large = checkpointed(large.select(F.col("b").alias("a"), F.least("m", F.col("a")).alias("b")).distinct())
        forget(pairs)
        small = _with_least(large, 2 * n)
        # Every neighbour is joined to the least one, and so is the node itself.
        joined = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = large.groupBy("a").agg(F.min("b").alias("b"))
        pairs = checkpointed(joined.union(own).distinct())
        forget(large)
    raise RuntimeError("components did not settle")


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges``, at most ``total``, with ``m``, the least ``b`` of each ``a``.

    At most ``HOT`` nodes can have more than a part in ``HOT`` of the edges; these are broadcast.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hot = F.broadcast(least.where(F.col("n") * HOT > total).select("a", "m"))
    rest = least.where(F.col("n") * HOT <= total).select("a", "m")
    ordinary = edges.join(hot.select("a"), "a", "left_anti").join(rest, "a")
    return edges.join(hot, "a").union(ordinary)


def _state(pairs: DataFrame) -> tuple[bool, int]:
    """Whether each node has one parent and no parent has a parent, and the number of pairs."""
    seen = pairs.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        pairs.select(F.col("b"), F.lit(0), F.lit(1)).distinct()
    )
    nodes = seen.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    odd = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    with without_shuffle_files(pairs.sparkSession):
        found = nodes.agg(F.max(odd).alias("odd"), F.sum("up").alias("n")).first()
    return not found["odd"], found["n"] or 0
