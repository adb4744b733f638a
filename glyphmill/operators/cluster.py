"""Clusters: components of the graph that links documents to their phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.components import components
from glyphmill.operators.storage import materialize


def shared_edges(top: DataFrame) -> DataFrame:
    """(doc_id, phrase) of phrases that at least two documents have among their best; others can't link anything."""
    edges = top.select("doc_id", "phrase").distinct()
    return edges.join(edges.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("phrase"), "phrase")


def document_links(edges: DataFrame) -> DataFrame:
    """(a, b): each document with the smallest one that shares a phrase. Linear in the edges, and its components are those of the bipartite graph."""
    hub = edges.groupBy("phrase").agg(F.min("doc_id").alias("a"))
    return edges.join(hub, "phrase").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def clusters(docs: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, cluster (the smallest doc_id of the component), size, for all of `docs`."""
    roots = components(links)
    smallest = roots.groupBy("root").agg(F.min("node").alias("cluster"), F.count(F.lit(1)).alias("size"))
    found = roots.join(smallest, "root").select(F.col("node").alias("doc_id"), "cluster", "size")
    every = docs.select("doc_id").join(materialize(found, "clusters"), "doc_id", "left")
    return every.select("doc_id", F.coalesce("cluster", "doc_id").alias("cluster"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))


def complete_clusters(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster, complete): whether each two documents of a cluster share a phrase. edges (doc_id, phrase), distinct, with few phrases a document
    (at most 20); found (doc_id, cluster, size). Clusters without any edge are left out.

    Pairs are never listed. The documents that share a phrase with one are those of the union of its phrases' documents, whose number follows from
    those of the documents that hold each subset of its phrases, added and taken off by turns (inclusion and exclusion). So a document is as
    many rows as its phrases have subsets, whatever the cluster's size. Phrases that all documents of a cluster hold, or only one, decide before
    that, as does a document whose phrases have too few documents: only what these leave open is looked at by subsets.
    """
    held = edges.join(found, "doc_id").select("cluster", "size", "doc_id", "phrase")
    per = held.groupBy("cluster", "phrase").agg(F.count(F.lit(1)).alias("k"))
    counted = materialize(held.join(per, ["cluster", "phrase"]), "cluster-phrases")
    reach = counted.groupBy("cluster", "doc_id").agg(F.max("size").alias("size"), F.max("k").alias("most"), F.sum(F.col("k") - 1).alias("reach"))
    whole = F.max("most") == F.max("size")
    known = reach.groupBy("cluster").agg(F.when(whole, True).when((F.min("reach") < F.max("size") - 1) | (F.count(F.lit(1)) < F.max("size")), False).alias("complete"))
    known = materialize(known, "known-clusters")
    open_rows = counted.where("k > 1").join(known.where("complete is null").select("cluster"), "cluster")
    sets = open_rows.groupBy("cluster", "size", "doc_id").agg(F.sort_array(F.collect_list("phrase")).alias("p"))  # a document's own phrases
    number = F.explode(F.expr("sequence(1, shiftleft(1, size(p)) - 1)"))
    subset = F.expr("filter(p, (x, i) -> (shiftright(m, i) & 1) = 1)")
    subsets = sets.select("cluster", "size", "doc_id", "p", number.alias("m")).select("cluster", "size", "doc_id", subset.alias("s"))
    subsets = materialize(subsets.select("cluster", "size", "doc_id", F.unhex(F.md5(F.array_join("s", "\n").cast("binary"))).alias("h"), (F.size("s") % 2 * 2 - 1).alias("sign")), "phrase-subsets")
    holding = subsets.groupBy("cluster", "h").agg(F.count(F.lit(1)).alias("n"))
    near = subsets.join(holding, ["cluster", "h"]).groupBy("cluster", "size", "doc_id").agg(F.sum(F.col("sign") * F.col("n")).alias("near"))  # itself included
    decided = near.groupBy("cluster").agg((F.min("near") == F.max("size")).alias("complete"))
    return known.where("complete is not null").union(decided)


def labels(found: DataFrame, min_docs: int) -> DataFrame:
    """The cluster of each document, null where it has fewer than `min_docs`."""
    return found.select("doc_id", F.when(F.col("size") >= min_docs, F.col("cluster")).alias("label"))


def merge_batch(known: DataFrame, edges: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add a batch's (doc_id, phrase) edges to the `known` labels (doc_id, cluster) and earlier `edges`.

    Only labels that the batch touches change: phrases lead from new documents to clusters, and components are taken of these
    alone. Returns (all labels, all edges, the labels of documents whose cluster the batch made or changed)."""
    old = edges.join(batch.select("phrase").distinct(), "phrase", "left_semi").join(known, "doc_id").select("phrase", F.col("cluster").alias("doc_id"))
    links = document_links(old.union(batch.select("phrase", "doc_id")).distinct())
    roots = components(links)
    smallest = roots.groupBy("root").agg(F.min("node").alias("new"))
    moved = materialize(roots.join(smallest, "root").select(F.col("node").alias("cluster"), "new"), "moved")
    fresh = known.select("doc_id", "cluster", F.lit(True).alias("old")).union(batch.select("doc_id", F.col("doc_id").alias("cluster"), F.lit(False)).distinct())
    joined = materialize(fresh.join(moved, "cluster", "left").select("doc_id", F.coalesce("new", "cluster").alias("cluster"), (F.col("new").isNotNull() | ~F.col("old")).alias("touched")), "merged")
    return joined.select("doc_id", "cluster"), materialize(edges.unionByName(batch.select(*edges.columns)), "edges"), joined.where("touched").select("doc_id", "cluster")


def best_first(found: DataFrame, docs: DataFrame, min_docs: int = 2) -> DataFrame:
    """Members of clusters with their texts, largest cluster first."""
    return found.where(F.col("size") >= min_docs).join(docs.select("doc_id", "text"), "doc_id").orderBy(F.desc("size"), "cluster", "doc_id")


def propagate_labels(rows: DataFrame, max_size: int = 2000) -> DataFrame:
    """rows (doc_id, cluster, label): within clusters of fewer than `max_size`, label becomes the largest; clusters without any label 1 become null."""
    stats = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max("label").alias("best"), F.sum("label").alias("total"))
    out = rows.select("doc_id", "cluster", "label").join(stats, "cluster")
    return out.select("doc_id", F.when(F.col("total") > 0, F.col("cluster")).alias("cluster"), F.when(F.col("size") < max_size, F.col("best")).otherwise(F.col("label")).alias("label"))
