"""Connected components as a loop over edge tables that are written to the shared folder after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.storage import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a long, b long); nodes have equal roots exactly if a path joins them.

    In each round every node points to the neighbour (or itself) that a hash seeded by the round puts first, edges are drawn anew
    between what their ends point to, and loops go. Such contraction keeps components (a node's edge to its
    target becomes the edge from the target to the target's target) and, as the order is drawn anew, shrinks chains and
    stars alike by a constant factor. Hot nodes are summed in the tasks before the shuffle and joined back by joins that adaptive
    execution can split. Loops and nulls in `edges` are dropped. No link reaches the driver. Each round's tables go with the next.
    """
    e = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    m = None
    for r in range(10_000):
        if e.isEmpty():
            break
        order = lambda c, r=r: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("to"))
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        p = materialize(both.groupBy("u").agg(F.min(order("v")).alias("best")).select("u", F.least("best", order("u"))["to"].alias("p")), "cc-parents")
        before, last = m, e
        m = p.select(F.col("u").alias("node"), F.col("p").alias("root")) if m is None else m.join(p, m["root"] == p["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
        m = materialize(m, "cc-roots")
        a, b = p.toDF("a", "pa"), p.toDF("b", "pb")
        e = materialize(e.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        discard(before, last, p)
    else:
        raise RuntimeError("components: rounds are used up with edges left")
    if m is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    discard(e)
    return m
