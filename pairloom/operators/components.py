"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans import tables


def _distinct(df: DataFrame) -> DataFrame:
    return df.select("u", "v").where("u <> v").distinct()


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
    return _distinct(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it are tied to the least of them; edges run from the higher to the lower end."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return _distinct(tied.unionByName(least.select("u", F.col("low").alias("v"))))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that an edge touches; the component is its least node.

    Null ends and loops: an edge with a null end is no edge, a node with only a loop is its own component.
    Stars replace the edges round by round, each round as a table, until every node hangs on its
    component's least node. Raises RuntimeError if max_rounds don't do.
    """
    whole = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = whole.select(F.col("u").alias("node")).union(whole.select("v")).distinct()
    now = tables.written(_distinct(whole), "stars")
    mark = F.xxhash64("u", "v")
    state = None
    for _ in range(max_rounds):
        after = tables.written(_small(_large(now)), "stars")
        found = after.agg(F.count("*"), F.bit_xor(mark), F.sum(F.pmod(mark, F.lit(1 << 40)))).first()
        tables.dropped(now)
        now = after
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
