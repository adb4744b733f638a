"""Bucket chains: replay against a plain walk, hot buckets over many tasks, the live form against the replay, gauges."""

import json
import random
import time
from collections import Counter, defaultdict

import pytest

from glyphmill.operators import buckets
from glyphmill.operators.storage import materialize
from glyphmill.streaming import live

KIND = "doc_id long, phrase string"


def plain(rows, functions, of, capacity):
    """Meetings by one walk over lists, as (doc_id, phrase, met) with counts."""
    import hashlib

    tables, out = defaultdict(list), Counter()
    for doc, phrase in sorted(set(rows)):
        for f in range(functions):
            held = tables[f, int(hashlib.md5(f"{f}:{phrase}".encode()).hexdigest()[:8], 16) % of]
            out.update((doc, phrase, d) for d, p in held if p == phrase)
            held[:] = [*[e for e in held if e[1] != phrase], (doc, phrase)][-capacity:]
    return out


def mixed(seed, docs=120, hot=True):
    rng = random.Random(seed)
    rows = [(d, f"p{rng.randrange(60)}") for d in range(docs) for _ in range(rng.randrange(6))]
    return rows + [(d, "hot") for d in range(0, docs, 3) if hot]


def replayed(spark, rows, functions, of, capacity):
    top = spark.createDataFrame(rows, KIND)
    names = {r.h: r.phrase for r in top.selectExpr("xxhash64(phrase) AS h", "phrase").distinct().collect()}
    return Counter((r.doc_id, names[r.p], r.met) for r in buckets.meetings(buckets.arrivals(top, functions, of), capacity).collect())


@pytest.mark.parametrize(("of", "capacity"), [(1, 1), (1, 5), (1, 40), (1, 1000), (3, 4), (50, 2)])
def test_replay_equals_a_plain_walk(spark, of, capacity):
    """With one bucket a function, ranges cut buckets, so what is joined up between tasks counts."""
    rows = mixed(of * 1000 + capacity)
    assert replayed(spark, rows, 2, of, capacity) == plain(rows, 2, of, capacity)


def test_one_bucket_over_all_tasks(spark):
    rows = mixed(7, docs=400)
    for capacity in (3, 30, 80):
        assert replayed(spark, rows, 1, 1, capacity) == plain(rows, 1, 1, capacity)


def test_edges(spark):
    empty = spark.createDataFrame([], KIND)
    assert buckets.chains(buckets.meetings(buckets.arrivals(empty, 4, 9), 5), 4).count() == 0
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None), (2, "a"), (3, "é" * 5000), (4, "é" * 5000), (4, "z")]
    top = spark.createDataFrame(rows, KIND).selectExpr("doc_id", "phrase", "1 AS fn", "2 AS bucket", "3 AS p", "4 AS n")
    got = buckets.chains(buckets.meetings(buckets.arrivals(top, 4, 9), 5), 4)
    assert {tuple(r) for r in got.select("doc_id", "predecessor", "shared", "kind").collect()} == {(2, 1, 1, "duplicate"), (4, 3, 1, "chain")}
    labels = buckets.chain_labels(got, spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9, 9, None)], "doc_id long"))
    assert {r.doc_id: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9}
    assert labels.count() == 5


def test_live_equals_replay_and_reports_gauges(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, lines = mixed(3, docs=60), []
    arrived = buckets.arrivals(spark.createDataFrame(rows, KIND), 4, 6)
    for i in range(3):
        arrived.where(f"doc_id div 20 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        time.sleep(1.1)  # files are taken by their time
    log = live.ProgressLog(lines.append)
    spark.streams.addListener(log)
    grown = live.GrowingChains(4, spark.createDataFrame([], "doc_id long, cluster long"))
    seen = Counter()

    def take(batch, number):
        once = materialize(batch, "met")
        seen.update((r.doc_id, r.p, r.met) for r in once.collect())
        grown.add(once, number)

    try:
        stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = live.bucket_meetings(stream, 3).writeStream.queryName("bucketed").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        until = time.time() + 20
        while time.time() < until and sum(json.loads(x).get("gauges", {}).get("buckets", {}).get("arrivals") or 0 for x in list(lines)) < len(set(rows)) * 4:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
        spark.conf.set(provider, before)
    met = buckets.meetings(arrived, 3)
    assert seen == Counter((r.doc_id, r.p, r.met) for r in met.collect())
    gauges = [g for x in lines if (g := json.loads(x).get("gauges", {}).get("buckets"))]
    assert sum(g["arrivals"] for g in gauges) == len(set(rows)) * 4
    assert sum(g["met"] for g in gauges) == sum(seen.values())
    assert max(g["fullest"] or 0 for g in gauges) == 3
    want = buckets.chain_labels(buckets.chains(met, 4), spark.range(60).withColumnRenamed("id", "doc_id"))
    labels = {r.doc_id: r.cluster for r in grown.labels.collect()}
    assert len(labels) > 20
    assert {i: i for i in range(60)} | labels == {r.doc_id: r.component for r in want.collect()}
