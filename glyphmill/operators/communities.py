"""Communities of a graph by greedy gain of modularity, on a graph that is contracted in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.ranges import running_sum
from glyphmill.operators.storage import discard, materialize


def _draw(round_number: int, node: str) -> Column:
    """A number that looks random, another for each round and node."""
    return F.crc32(F.concat(F.lit(f"{round_number}:"), F.col(node).cast("string")).cast("binary"))


def _links(edges: DataFrame, weight: str | None) -> DataFrame:
    """(a, b, w), a < b: the weight between two nodes in either direction; without weights, distinct edges count one for both directions together."""
    ends = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    pairs = edges.where("src <> dst")
    if weight is None:
        return pairs.select(*ends).distinct().withColumn("w", F.lit(1.0))
    return pairs.where(F.col(weight) > 0).select(*ends, F.col(weight).cast("double").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").union(links.select("b", "a", "w"))


def _strength(links: DataFrame) -> DataFrame:
    return _both(links).groupBy("u").agg(F.sum("w").alias("d"))


def gains(links: DataFrame, strength: DataFrame, total: float) -> DataFrame:
    """u, v, w, the strengths du and dv, and half of what Q gains if u and v are one: w / total - du * dv / total^2; each link in both directions."""
    at = lambda x: strength.select(F.col("u").alias(x), F.col("d").alias(f"d{x}"))
    gain = F.col("w") / total - (F.col("du") / total) * (F.col("dv") / total)
    return _both(links).join(at("u"), "u").join(at("v"), "v").withColumn("gain", gain)


def _merges(open_links: DataFrame, links: DataFrame, total: float, number: int) -> DataFrame:
    """(u, v): u joins v. Each community names the partner with the largest gain, equal ones by a draw. Of two that name each other the one that
    more have named (then the stronger, then the one with the smaller id) takes in, the other joins; the rest take in or join by a coin, and who joins does
    so where its partner takes in. So the best pair of all is one after the round, and a star is one round's work.

    Of those that would join one partner, in the order of their gains, as many do as raise Q most together: each adds its own gain, its links to
    those before it, and what their strengths take off. Both sums over those before are running sums, dealt by ranges."""
    named = open_links.groupBy("u").agg(F.max(F.struct("gain", _draw(number, "v").alias("h"), F.col("v"), F.col("du").alias("d"), F.col("dv"))).alias("best")).select("u", "best.*").drop("h")
    named = materialize(named, "partners")
    votes = named.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    of = lambda x: votes.select(F.col("v").alias(x), F.col("n").alias(f"n{x}"))
    back = named.select(F.col("u").alias("v"), F.col("v").alias("u"), F.lit(True).alias("mutual"))
    first = F.struct(F.coalesce("nu", F.lit(0)), F.col("d"), -F.col("u")) > F.struct(F.coalesce("nv", F.lit(0)), F.col("dv"), -F.col("v"))
    roles = named.join(of("u"), "u", "left").join(of("v"), "v", "left").join(back, ["u", "v"], "left")
    roles = materialize(roles.select("u", "v", "gain", "d", F.when(F.col("mutual"), first).otherwise(_draw(number, "u") % 2 == 0).alias("takes")), "roles")
    open_to = roles.where("takes").select(F.col("u").alias("v"))
    order = [F.desc("gain"), F.col("u")]
    joining = running_sum(roles.where("not takes").join(open_to, "v").select("u", "v", "gain", "d"), ["v"], order, "d", "before")
    joining = materialize(joining, "joining")
    end = lambda x: joining.select(F.col("u").alias(x), F.col("v").alias(f"v{x}"), F.struct(-F.col("gain"), F.col("u")).alias(f"at{x}"))
    among = links.join(end("a"), "a").join(end("b"), "b").where("va = vb").groupBy(F.greatest("ata", "atb")["u"].alias("u")).agg(F.sum("w").alias("inner"))
    adds = F.col("gain") + F.coalesce("inner", F.lit(0.0)) / total - (F.col("d") / total) * (F.col("before") / total)
    summed = materialize(running_sum(joining.join(among, "u", "left").select("u", "v", "gain", adds.alias("adds")), ["v"], order, "adds", "earlier"), "joining-sums")
    top = F.max(F.struct(F.round((F.col("earlier") + F.col("adds")) * 1e12), -F.col("gain"), F.col("u"))).alias("top")
    last = summed.groupBy("v").agg(top).select("v", F.struct(F.col("top.col2"), F.col("top.u")).alias("last"))
    kept = materialize(summed.join(last, "v").where(F.struct(-F.col("gain"), F.col("u")) <= F.col("last")).select("u", "v"), "merges")
    discard(named, roles, joining, summed)
    return kept


def modularity(links: DataFrame, strength: DataFrame, total: float) -> float:
    """Q of the partition whose communities are the nodes of a contracted graph."""
    cut = links.agg(F.sum("w").alias("w")).first()["w"] or 0.0
    squares = strength.agg(F.sum((F.col("d") / total) * (F.col("d") / total)).alias("s")).first()["s"] or 0.0
    return 1 - 2 * cut / total - squares


def greedy_communities(edges: DataFrame, *, weight: str | None = None, history: list[float] | None = None) -> DataFrame:
    """(node, community, size) for each node of `edges` (src long, dst long); a community is known by its smallest node.

    Edges have no direction; loops and nulls are dropped; without `weight` each pair that is joined counts 1. In each round communities are merged in
    disjoint groups that each raise the modularity Q, on the graph of communities of the round before, until no two joined communities
    would raise it. `history` gets Q at the start and after each round. Nothing but these numbers reaches the driver, and each round's
    tables, written to the shared folder, replace the last one's. An empty graph has no communities.
    """
    links = materialize(_links(edges, weight), "links")
    strength = materialize(_strength(links), "strength")
    places = materialize(strength.select(F.col("u").alias("node"), F.col("u").alias("at")), "communities")
    total = strength.agg(F.sum("d").alias("d")).first()["d"] or 0.0
    number = 0
    while total:
        if history is not None:
            history.append(modularity(links, strength, total))
        open_links = materialize(gains(links, strength, total).where("gain > 0"), "gains")
        if open_links.isEmpty():
            discard(open_links)
            break
        merges = _merges(open_links, links, total, number)
        old, number = (links, strength, places, open_links, merges), number + 1
        to = lambda df, x, m=merges: df.join(m.select(F.col("u").alias(x), F.col("v").alias("__to")), x, "left").withColumn(x, F.coalesce("__to", x)).drop("__to")
        moved = to(to(links, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
        links = materialize(moved.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
        strength = materialize(to(strength, "u").groupBy("u").agg(F.sum("d").alias("d")), "strength")
        places = materialize(to(places, "at"), "communities")
        discard(*old)
    names = places.groupBy("at").agg(F.min("node").alias("community"), F.count(F.lit(1)).alias("size"))
    return places.join(names, "at").select("node", "community", "size")


def open_merges(edges: DataFrame, parts: DataFrame, *, weight: str | None = None) -> DataFrame:
    """One row on a partition (node, community) of a graph: nodes, modularity, and the pairs of communities that would raise it as one."""
    links = materialize(_links(edges, weight), "links")
    own = materialize(_strength(links), "strength")
    total = own.agg(F.sum("d").alias("d")).first()["d"] or 1.0
    of = lambda x: parts.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))
    strength = own.join(of("u"), "u").groupBy(F.col("cu").alias("u")).agg(F.sum("d").alias("d"))
    between, strength = materialize(between, "between"), materialize(strength, "community-strength")
    row = parts.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("community").alias("communities"))
    pairs = gains(between, strength, total).where("gain > 1e-12 and u < v").agg(F.count(F.lit(1)).alias("open_pairs"))
    return row.crossJoin(pairs).withColumn("modularity", F.lit(modularity(between, strength, total)))  # one row each
