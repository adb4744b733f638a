"""Frequencies by event time: a stream with disorder against the sorted replay."""

import random
from datetime import datetime, timedelta

from glyphmill.operators import tfidf
from glyphmill.streaming import live


def test_disordered_stream_equals_sorted_replay(spark, tmp_path):
    """Files bring documents up to 40 minutes late; df is that of their own time."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    docs = [(i, start + timedelta(minutes=3 * i, microseconds=i)) for i in range(60)] + [(100, start + timedelta(minutes=30)), (101, start + timedelta(minutes=30))]
    rows = [(p, ts, i, 1 + len(p) % 2) for i, ts in docs for p in ("all", *rng.sample(["a", "bb", "c", "dd"], 2))]
    arrival = {i: ts + timedelta(minutes=rng.randrange(40)) for i, ts in docs}
    rows.sort(key=lambda r: arrival[r[2]])
    kind = "phrase string, ts timestamp, doc_id long, tf long"
    parts = [rows[:70], [*rows[70:140], (None, start, 7, 1), ("all", None, 7, 1)], rows[140:], [("end", start + timedelta(days=9), 999, 1)]]
    try:
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = live.frequency_in_time(stream).writeStream.format("memory").queryName("in_time").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
        for i, part in enumerate(parts):
            spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
            q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.set(provider, before)
    got = {(r.doc_id, r.phrase): (r.tf, r.df) for r in spark.table("in_time").collect()}
    order = tfidf.numbered(spark.createDataFrame(docs, "doc_id long, ts timestamp"), "ts", "doc_id").select("doc_id", "seq")
    replay = tfidf.running_frequency(spark.createDataFrame(rows, kind).join(order, "doc_id"))
    want = {(r.doc_id, r.phrase): (r.tf, r.df) for r in replay.collect()}
    assert got == want
    assert [got[i, "all"][1] for i, _ in sorted(docs, key=lambda d: (d[1], d[0]))] == list(range(1, 63))
