import hashlib
import random
import re
import time
from collections import Counter, defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import text
from glyphmill.operators import lsh, tfidf
from glyphmill.plans import queries


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((.*?)\), ", df._jdf.queryExecution().executedPlan().toString())


def top_rows(spark):
    rng = random.Random(2)
    rows = [(d, f"p{rng.randrange(60)}") for d in range(50) for _ in range(6)] + [(None, "p1")]
    return rows, spark.createDataFrame(rows, "doc_id long, phrase string")


def places(spark, phrases, functions, buckets):
    df = spark.createDataFrame([(p,) for p in sorted(phrases)], "phrase string").crossJoin(spark.range(functions).select(F.col("id").cast("int").alias("fn")))
    return {(r.phrase, r.fn): r.b for r in df.select("phrase", "fn", lsh.bucket(F.col("fn"), F.col("phrase"), buckets).alias("b")).collect()}


def test_occupancy_sums_before_the_shuffle(spark):
    rows, top = top_rows(spark)
    at, want = places(spark, {p for _, p in rows}, 8, 16), defaultdict(set)
    for d, p in set(rows):
        for f in range(8):
            want[f, at[p, f]].add((d, p))
    got = lsh.occupancy(top, 8, 16)
    assert {tuple(r) for r in got.collect()} == {(f, b, len({p for _, p in s}), len(s)) for (f, b), s in want.items()}
    assert not [e for e in exchanges(got) if "bucket" in e and ("phrase" in e or "doc_id" in e)]


def test_shared_buckets_shuffle_no_buckets(spark):
    rows, top = top_rows(spark)
    at, held = places(spark, {p for _, p in rows}, 8, 16), defaultdict(set)
    for d, p in rows:
        if d is not None:
            for f in range(8):
                held[f, at[p, f]].add(d)
    want = Counter((d, hub) for d, hub, _ in {(d, min(s), f) for (f, _), s in held.items() for d in s if d != min(s)})
    got = lsh.shared_buckets(top, 8, 16)
    assert {(r.doc_id, r.hub): r.n for r in got.collect()} == dict(want)
    assert not [e for e in exchanges(got) if "bucket" in e or "fn" in e]


def chained(docs, functions, buckets, capacity, skip):
    """By definition: buckets as queues, each place looked up by itself."""
    tables, marked, rows, n = defaultdict(deque), set(), [], 0
    for doc, found in sorted(docs.items()):
        places = {p: [(f, int(hashlib.md5(f"{f}:{p}".encode()).hexdigest()[:8], 16) % buckets) for f in range(functions)] for p in found}
        hits = {}
        for p in found:
            for at in places[p]:
                for c in tables[at]:
                    if not (skip and c in marked):
                        hits.setdefault(c, Counter())[p] += 1
        same = next((c for c in hits if all(k >= functions / 2 for k in hits[c].values())), None)
        if same is not None:
            rows.append((doc, same, "duplicate", []))
            continue
        linked = [c for c in hits if any(k >= functions / 2 if skip else k > functions / 2 for k in hits[c].values())]
        marked.update(linked)
        rows.append((doc, n, "chain", linked))
        for p in found:
            for at in places[p]:
                held = deque(c for c in tables[at] if c not in marked)
                if len(held) >= capacity:
                    held.popleft()
                tables[at] = held
                held.append(n)
        n += 1
    return rows


def test_chains_equal_queues(spark):
    rng = random.Random(5)
    docs = {d: [f"p{rng.randrange(8 + d // 2)}" for _ in range(rng.randrange(1, 6))] for d in range(300)}  # some list a phrase twice
    top = spark.createDataFrame([(d, r, p) for d, found in docs.items() for r, p in enumerate(found)], "doc_id long, rank int, phrase string")
    kinds = Counter()
    for functions, buckets, capacity, skip in ((8, 4, 3, False), (8, 4, 3, True), (7, 50, 10, False), (16, 300, 4, True), (16, 70_000, 4, False)):
        want = chained(docs, functions, buckets, capacity, skip)
        got = lsh.chain_clusters(top, functions=functions, buckets=buckets, capacity=capacity, skip_marked=skip).collect()
        assert [(r.doc_id, r.cluster_id, r.kind, list(r.predecessors)) for r in got] == want
        kinds.update((kind, len(before) > 1) for _, _, kind, before in want)
    assert len(kinds) == 3


def test_chains_of_a_thousand_documents_take_seconds():
    rng = random.Random(7)
    docs = {d: [f"p{rng.randrange(3000)}" for _ in range(10)] for d in range(1000)}
    state, place = lsh.Buckets(128, 20, 100, False), lsh._placed(128, 20)
    batch = pa.RecordBatch.from_arrays([pa.array(list(docs)), pa.array(list(docs.values()))], ["doc_id", "phrases"])
    rows = [r for b in place([batch]) for r in b.to_pylist()]
    began = time.process_time()
    for r in rows:
        state.arrive(np.frombuffer(r["places"], np.uint16).reshape(-1, 128), np.array(r["times"]))
    assert time.process_time() - began < 20  # place by place it is 128,000 steps a document


def test_second_variant_shuffles_no_table_of_phrases(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(lsh, "chain_clusters", lambda top, **settings: top)
    top = queries.lsh_chain_clusters_v2(spark, sf)
    assert not [keys for keys in exchanges(top) if "phrase" in keys]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.words2(text.clean_ascii("text")).alias("w"))
    n, tf = docs.count(), tfidf.term_frequency(tfidf.grams(docs, 5, 5))
    weighted = tfidf.static_weights(tf, tfidf.pruned_vocabulary(tfidf.document_frequency(tf), F.lit(n)), n).withColumn("weight", F.round("weight", 9))
    own = Window.partitionBy("doc_id")
    ranked = weighted.withColumn("rank", F.row_number().over(own.orderBy(F.desc("weight"), F.desc("phrase")))).withColumn("k", F.count(F.lit(1)).over(own))
    want = {tuple(r) for r in ranked.where("rank <= floor(k / 5)").select("doc_id", "rank", "phrase").collect()}
    got = [tuple(r) for r in top.collect()]
    assert want and len(got) == len(want) and set(got) == want
