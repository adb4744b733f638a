"""Chains of documents through hash buckets with bounded memory. Each bucket is a state of its own: here as a replay, in streaming.live as a stream.

A phrase falls in one bucket of each function. A bucket holds, for each of at most `capacity` phrases, the last document that
brought it. A document that arrives meets the one that the bucket holds for its phrase and supersedes it, so superseded entries
go before all others; beyond the capacity the phrase that was brought longest ago goes. No state spans buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.components import components
from glyphmill.operators.lsh import bucket
from glyphmill.operators.storage import materialize

MET = "doc_id long, p long, met long, phrases int"


def arrivals(top: DataFrame, functions: int, buckets: int) -> DataFrame:
    """(fn, bucket, doc_id, k, p, phrases): a row for each phrase of a document and function; k is the phrase's place among the document's, p its hash.

    `top` has (doc_id, phrase); repeated rows count once, rows with a null are dropped, other columns are not looked at. Phrases are
    known by 64-bit hashes (n phrases: about n^2 / 2^65 collisions, which join two chains)."""
    lists = top.dropna(subset=["doc_id", "phrase"]).groupBy("doc_id").agg(F.sort_array(F.collect_set("phrase")).alias("all"))
    each = lists.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("all").alias("phrases"), F.posexplode("all").alias("k", "phrase"))
    rows = each.withColumn("fn", F.explode(F.sequence(F.lit(0), F.lit(functions - 1))))
    return rows.select("fn", bucket(F.col("fn"), F.col("phrase"), buckets).alias("bucket"), "doc_id", "k", F.xxhash64("phrase").alias("p"), "phrases")


def bring(held: dict[int, int], p: int, doc: int, capacity: int) -> int | None:
    """The document that met `doc` in a bucket, `held` by phrase in order of arrival, which is brought up to date."""
    met = held.pop(p, None)
    held[p] = doc
    if len(held) > capacity:
        del held[next(iter(held))]
    return met


def meetings(rows: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, p, met, phrases): a row for each arrival that meets a document in its bucket, the arrivals in order of (doc_id, k).

    Arrivals are dealt by ranges of (bucket, doc_id), so a bucket with most of the rows is many tasks. A task replays its range in batches.
    Only its first bucket can have begun in an earlier range, and only its last goes on in a later one: for these it writes what its first
    `capacity` phrases still have to meet, and what the bucket holds in the end, at most 2 x capacity rows, and these are joined up."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["fn", "bucket", "doc_id", "k"]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["kind", "fn", "bucket", "part", "seq", "doc_id", "p", "met", "phrases"]
        part, now, first, held = TaskContext.get().partitionId(), None, None, {}
        for batch in batches:
            out = []
            for fn, b, doc, p, of in zip(*(batch[c].tolist() for c in ("fn", "bucket", "doc_id", "p", "phrases"))):
                if (fn, b) != now:
                    now, held = (fn, b), {}
                    first = first or now
                early = now == first and len(held) < capacity
                met = bring(held, p, doc, capacity)
                if met is not None:
                    out.append((0, fn, b, part, 0, doc, p, met, of))
                elif early:
                    out.append((1, fn, b, part, len(held), doc, p, doc, of))
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([(2, *now, part, i, doc, p, doc, 0) for i, (p, doc) in enumerate(held.items())], columns=names)

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        held, out = {}, []
        for _, rows in group.groupby("part", sort=True):
            rows = rows.sort_values(["kind", "seq"])
            for doc, p, of in rows.loc[rows["kind"] == 1, ["doc_id", "p", "phrases"]].itertuples(index=False):
                met = bring(held, p, doc, capacity)
                if met is not None:
                    out.append((doc, p, met, of))
            left = {p: doc for doc, p in rows.loc[rows["kind"] == 2, ["doc_id", "p"]].itertuples(index=False)}
            older = [(p, doc) for p, doc in held.items() if p not in left]
            held = dict(older[max(0, len(older) - (capacity - len(left))):]) | left
        return pd.DataFrame(out, columns=["doc_id", "p", "met", "phrases"])

    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = materialize(dealt.mapInPandas(replay, "kind int, fn int, bucket long, part int, seq int, " + MET), "meetings")
    return found.where("kind = 0").select("doc_id", "p", "met", "phrases").union(found.where("kind > 0").groupBy("fn", "bucket").applyInPandas(joined, MET))


def chains(met: DataFrame, functions: int) -> DataFrame:
    """(doc_id, predecessor, shared, kind): duplicate if all phrases of the document met the predecessor in at least half of the functions,
    chain if one met it in more than half, other pairs are left out; shared: phrases that met it in at least half."""
    n = F.col("n")
    each = met.groupBy("doc_id", "met", "p").agg(F.count(F.lit(1)).alias("n"), F.max("phrases").alias("phrases"))
    pairs = each.groupBy("doc_id", F.col("met").alias("predecessor")).agg(F.count(F.when(2 * n >= functions, 1)).alias("shared"), F.count(F.when(2 * n > functions, 1)).alias("over"), F.max("phrases").alias("phrases"))
    kind = F.when(F.col("shared") == F.col("phrases"), "duplicate").when(F.col("over") > 0, "chain")
    return pairs.select("doc_id", "predecessor", "shared", kind.alias("kind")).where("kind is not null")


def chain_labels(links: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, component) of all ids of `docs`: the smallest document that chains lead to, in either direction."""
    found = materialize(components(links.select(F.col("doc_id").alias("a"), F.col("predecessor").alias("b"))), "chain-roots")
    named = found.join(found.groupBy("root").agg(F.min("node").alias("component")), "root").select(F.col("node").alias("doc_id"), "component")
    return docs.select("doc_id").dropna().distinct().join(named, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
