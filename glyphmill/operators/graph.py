"""Graph and spectral operators over edge tables (src long, dst long)."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators.spectral import singular_vectors as singular_vectors
from glyphmill.operators.storage import discard, materialize
from glyphmill.operators.tfidf import numbered


def densify(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with node numbers 0..n-1, nodes (node, id)), numbered by ascending id."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    nodes = materialize(numbered(ids, "id", name="node").select("node", "id"), "nodes")
    a, b = nodes.toDF("s", "src"), nodes.toDF("d", "dst")
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")), nodes


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree of distinct edges; nodes without one kind have 0."""
    e = edges.distinct()
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    rows = d.select(F.lit("in").alias("kind"), F.col("in_degree").alias("degree")).union(d.select(F.lit("out"), "out_degree"))
    return rows.groupBy("kind", "degree").agg(F.count(F.lit(1)).alias("nodes"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.distinct().groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("successors"))


def conductance(edges: DataFrame, members: DataFrame) -> DataFrame:
    """members (set_id, node): cut / min(volume inside, volume outside), with edges that leave or enter as cut and out-degrees as volume.

    Null where a side has no volume. Each edge is looked up once for each end, never once per set."""
    e = edges.distinct()
    total = e.agg(F.count(F.lit(1)).alias("total"))
    a, b = members.select(F.col("set_id").alias("sa"), F.col("node").alias("src")), members.select(F.col("set_id").alias("sb"), F.col("node").alias("dst"))
    out = e.join(a, "src").select("src", "dst", F.col("sa").alias("set_id"))
    inside = out.join(b.withColumnRenamed("sb", "set_id"), ["set_id", "dst"]).groupBy("set_id").agg(F.count(F.lit(1)).alias("inner"))
    leaving = out.groupBy("set_id").agg(F.count(F.lit(1)).alias("volume"))
    entering = e.join(b, "dst").groupBy(F.col("sb").alias("set_id")).agg(F.count(F.lit(1)).alias("entering"))
    rows = members.select("set_id").distinct().join(leaving, "set_id", "left").join(entering, "set_id", "left").join(inside, "set_id", "left").fillna(0).crossJoin(F.broadcast(total))  # one row
    cut = F.col("volume") + F.col("entering") - 2 * F.col("inner")
    return rows.select("set_id", cut.alias("cut"), "volume", F.round(F.try_divide(cut, F.least("volume", F.col("total") - F.col("volume"))), 9).alias("conductance"))


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Directed modularity of a given partition (node, part): sum over parts of inner / m - out * in / m^2."""
    e = edges.distinct()
    both = e.join(parts.toDF("src", "ps"), "src").join(parts.toDF("dst", "pd"), "dst")
    rows = both.select(F.col("ps").alias("part"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("ps") == F.col("pd")).cast("int").alias("w")).union(both.select("pd", F.lit(0), F.lit(1), F.lit(0)))
    per = rows.groupBy("part").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("w").alias("w"))
    return per.agg(F.sum("w").alias("w"), F.sum(F.col("o") * F.col("i")).alias("oi"), F.sum("o").alias("m")).select(F.round(F.col("w") / F.col("m") - F.col("oi") / (F.col("m") * F.col("m")), 9).alias("modularity"))


def gaussian_entropy(points: DataFrame, *by: str) -> DataFrame:
    """|ln((2 pi e)^2 det) / 2| of the sample covariance of (x, y); infinite where it is singular or undefined."""
    got = points.groupBy(*by).agg(F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"), F.count(F.lit(1)).alias("n"))
    det = F.col("vx") * F.col("vy") - F.col("c") * F.col("c")
    value = F.when(det > 1e-15 * F.col("vx") * F.col("vy"), F.round(F.abs(0.5 * F.log(F.lit(float((2 * np.pi * np.e) ** 2)) * det)), 6)).otherwise(F.lit(float("inf")))
    return got.select(*by, "n", value.alias("entropy"))


def off_axes(points: DataFrame, cutoff: float = 1e-2) -> DataFrame:
    return points.where((F.abs("x") > cutoff) & (F.abs("y") > cutoff))


def spokes(edges: DataFrame, u: DataFrame, *, cutoff: float = 1e-2, max_conductance: float = 0.93) -> DataFrame:
    """(axis, node): per axis, the set grown from the node of largest |u| by the neighbour of largest |u|.

    Neighbours of |u| <= cutoff are skipped; growth ends before the set's conductance falls below `max_conductance`. An axis is one
    task, which holds the axis's nodes of |u| > cutoff and the edges between them: columns of u have length 1, so these nodes are fewer
    than 1 / cutoff^2. All other edges count in the nodes' degrees only."""
    e = materialize(edges.distinct(), "spoke-edges")
    total = e.count()
    top = u.groupBy("axis").agg(F.max(F.struct(F.abs("u").alias("s"), -F.col("node"))).alias("top"))
    seeds = top.select("axis", (-F.col("top")["col2"]).alias("seed"))
    loud = u.join(F.broadcast(seeds), "axis").where((F.abs("u") > cutoff) | (F.col("node") == F.col("seed")))  # a row for each axis
    loud = materialize(loud.select("axis", "node", F.abs("u").alias("score")), "spoke-nodes")
    inner = e.join(loud.select("axis", F.col("node").alias("src")), "src").join(loud.select("axis", F.col("node").alias("dst")), ["axis", "dst"])
    inner = inner.groupBy("axis", F.col("src").alias("node")).agg(F.collect_list("dst").alias("successors"))
    rows = loud.join(degrees(e), "node", "left").join(inner, ["axis", "node"], "left").fillna(0, ["in_degree", "out_degree"])

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        score = dict(zip(group["node"], group["score"], strict=True))
        out_degree, in_degree = (dict(zip(group["node"], group[c], strict=True)) for c in ("out_degree", "in_degree"))
        out: dict[int, set[int]] = {}
        into: dict[int, set[int]] = {}
        for v, successors in zip(group["node"], group["successors"], strict=True):
            out[v] = set() if successors is None else set(successors.tolist())
            for w in out[v]:
                into.setdefault(w, set()).add(v)
        seed = max(sorted(score), key=lambda v: score[v])
        spoke, seen, heap = {seed}, {seed}, []
        volume, inner = out_degree[seed], int(seed in out[seed])
        entering = in_degree[seed]

        def offer(node: int) -> None:
            for v in sorted(out[node]):
                if v not in seen:
                    seen.add(v)
                    heapq.heappush(heap, (-score[v], -v))

        offer(seed)
        while heap:
            s, v = heapq.heappop(heap)
            v = -v
            if -s <= cutoff:
                continue
            grown = inner + len(out[v] & spoke) + len(into.get(v, set()) & spoke) + int(v in out[v])
            vol, ent = volume + out_degree[v], entering + in_degree[v]
            least = min(vol, total - vol)
            if not least or (vol + ent - 2 * grown) / least < max_conductance:
                break
            spoke.add(v)
            volume, entering, inner = vol, ent, grown
            offer(v)
        return pd.DataFrame({"axis": int(group["axis"].iloc[0]), "node": sorted(spoke)})

    return rows.groupBy("axis").applyInPandas(grow, "axis int, node long")


def axis_pairs(u: DataFrame, found: DataFrame, *, cutoff: float = 1e-2, min_entropy: float = 5.0) -> DataFrame:
    """Per pair of axes: points off both axes, and for either axis the entropy of its spoke's points and whether it is kept."""
    axes = u.select("axis").distinct()
    pairs = axes.toDF("x_axis").crossJoin(axes.toDF("y_axis"))  # a few axes
    x, y = u.toDF("node", "x_axis", "x"), u.toDF("node", "y_axis", "y")
    points = pairs.join(x, "x_axis").join(y, ["y_axis", "node"])
    counts = off_axes(points, cutoff).groupBy("x_axis", "y_axis").agg(F.count(F.lit(1)).alias("points"))
    own = points.join(found.withColumnRenamed("axis", "spoke_axis"), "node").where("spoke_axis = x_axis or spoke_axis = y_axis")
    entropy = gaussian_entropy(own, "x_axis", "y_axis", "spoke_axis")
    return entropy.join(counts, ["x_axis", "y_axis"], "left").fillna(0, ["points"]).withColumn("kept", F.col("entropy") >= min_entropy)


def spoke_axes(pairs: DataFrame, k: int) -> DataFrame:
    """Axes that show a spoke with all `k` axes, and axes that show one with an axis that doesn't."""
    shown = pairs.where("kept").select("x_axis", "y_axis").distinct()
    full = shown.groupBy("x_axis").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select(F.col("x_axis").alias("axis"))
    partly = shown.join(full, shown["x_axis"] == full["axis"], "left_anti").where("x_axis <> y_axis").select(F.col("y_axis").alias("axis"))
    return full.union(partly).distinct()


def svd_clusters(presence: DataFrame, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """presence (doc_id, phrase): (round, doc_id) of documents on the leading singular vector, found again after they are taken out.

    Without `rounds` it goes on until every document is placed; each round places one at least. The leading vector comes from power
    iteration by joins and sums, so no matrix is gathered. A phrase of one document has that document's value, so these phrases, most of
    all, are only counted; the others are numbers in the joins. Rows with a null are left out."""
    presence = materialize(presence.dropna(subset=["doc_id", "phrase"]).select("doc_id", "phrase").distinct(), "presence")
    ids = materialize(presence.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase", F.monotonically_increasing_id().alias("p")), "phrase-ids")
    linked = materialize(presence.join(ids, "phrase").select("doc_id", "p"), "linked")
    counts = presence.select("doc_id", F.lit(1).alias("n"), F.lit(1).alias("own")).union(linked.select("doc_id", F.lit(0), F.lit(-1)))
    docs = materialize(counts.groupBy("doc_id").agg(F.sum("n").cast("double").alias("n"), F.sum("own").alias("own")), "documents")
    discard(presence, ids)
    out = None
    for r in range(rounds) if rounds is not None else itertools.count():
        if docs.isEmpty():
            break
        u = docs.select("doc_id", "own", F.col("n").alias("u"))
        for _ in range(8):
            v, before = materialize(linked.join(u.select("doc_id", "u"), "doc_id").groupBy("p").agg(F.sum("u").alias("v")), "power"), u
            top = v.select("v").union(u.where("own > 0").select("u")).agg(F.max(F.abs("v"))).first()[0]
            shared = linked.join(v, "p").groupBy("doc_id").agg(F.sum("v").alias("s"))
            u = u.join(shared, "doc_id", "left").select("doc_id", "own", ((F.coalesce("s", F.lit(0.0)) + F.col("own") * F.col("u")) / top).alias("u"))
            u = materialize(u, "power")
            discard(v, before)
        found = materialize(_scaled(u, "u").where(F.col("u") > tolerance ** 0.5).select(F.lit(r).alias("round"), "doc_id"), "placed")
        out = found if out is None else out.union(found)
        old = docs, linked, u
        docs, linked = (materialize(x.join(found.select("doc_id"), "doc_id", "left_anti"), "rest") for x in (docs, linked))
        discard(*old)
    return out if out is not None else docs.select(F.lit(0).alias("round"), "doc_id").limit(0)


def _scaled(df: DataFrame, c: str) -> DataFrame:
    top = df.agg(F.max(F.abs(c)).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(c, F.col(c) / F.col("__top")).drop("__top")  # one row


def _draw(seed: int, salt: int, *of: str) -> Column:
    """A number below 2^32 that is drawn for each row by its values in `of`: the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), F.lit(salt), *of)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def random_edges(spark: SparkSession, nodes: int, edges: int, seed: int = 7) -> DataFrame:
    """A uniform graph of about `edges` distinct edges without loops, drawn by the edge's number."""
    return spark.range(edges).select((_draw(seed, 1, "id") % nodes).alias("src"), (_draw(seed, 2, "id") % nodes).alias("dst")).where("src <> dst").distinct()


def complete_edges(spark: SparkSession, nodes: int) -> DataFrame:
    """All pairs src < dst, as one sequence per source."""
    return spark.range(nodes - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(nodes - 1))).alias("dst"))


def bipartite_edges(spark: SparkSession, left: int, right: int) -> DataFrame:
    return spark.range(left).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(left).cast("long"), F.lit(left + right - 1).cast("long"))).alias("dst"))


#: Rows, columns and density of the planted blocks, and of the block of noise.
BLOCKS = ((50, 100, 0.75), (100, 150, 0.7), (100, 50, 0.8))
NOISE = (150, 100, 0.1)
CAMOUFLAGE = 0.005


def dense_blocks(spark: SparkSession, noise: bool = True, camouflage: bool = True, seed: int = 11) -> DataFrame:
    """Planted dense blocks on the diagonal, with optional noise block and camouflage edges between all sources and targets."""
    blocks = [*BLOCKS, *([NOISE] if noise else [])]
    n_src, n_dst = sum(b[0] for b in blocks), sum(b[1] for b in blocks)
    chance = lambda salt: _draw(seed, salt, "src", "dst") / 2.0**32
    out, a, b = [], 0, n_src
    for i, (r, c, p) in enumerate(blocks):
        cells = spark.range(a, a + r).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(b).cast("long"), F.lit(b + c - 1).cast("long"))).alias("dst"))
        out.append(cells.where(chance(i) < p))
        a, b = a + r, b + c
    if camouflage:
        out.append(bipartite_edges(spark, n_src, n_dst).where(chance(99) < CAMOUFLAGE))
    edges = out[0]
    for more in out[1:]:
        edges = edges.union(more)
    return edges.distinct()


def mutation_chains(spark: SparkSession, *, length: int = 50, steps: int = 100, chains: int = 1, share: float = 0.1, vocabulary: int = 1000, seed: int = 3) -> DataFrame:
    """(doc_id, chain, step, date, text): each text changes random words of the one before; all chains start from one text; one a day."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chain in batch["id"]:
                words = [f"w{i}" for i in np.random.default_rng(seed).integers(0, vocabulary, length)]
                rng = np.random.default_rng([seed, int(chain)])
                rows = []
                for step in range(steps):
                    rows.append((int(chain) * steps + step, int(chain), step, pd.Timestamp("2010-01-01") + pd.Timedelta(days=step), " ".join(words)))
                    for _ in range(int(rng.integers(0, int(np.ceil(share * length))))):
                        words[int(rng.integers(0, length))] = f"w{rng.integers(0, vocabulary)}"
                yield pd.DataFrame(rows, columns=["doc_id", "chain", "step", "date", "text"])

    return spark.range(chains).mapInPandas(walk, "doc_id long, chain long, step int, date timestamp, text string")


def merged_intervals(rows: DataFrame, *by: str) -> DataFrame:
    """rows (by, lo, hi): overlapping or adjacent integer intervals of a group become one."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("new", F.when(reach >= F.col("lo") - 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("merged")).drop("island")
