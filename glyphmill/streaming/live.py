"""Structured Streaming forms: document frequency as documents arrive, windows over events, and clusters that grow by batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glyphmill.operators import buckets
from glyphmill.operators.cluster import merge_batch
from glyphmill.operators.components import components
from glyphmill.operators.storage import discard, materialize


def arriving_frequency(tf: DataFrame) -> DataFrame:
    """A stream of (phrase, seq, doc_id, tf) with df: documents seen so far that hold the phrase. State is one number per phrase."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        rows["df"] = range(seen + 1, seen + 1 + len(rows))
        state.update((seen + len(rows),))
        yield rows[["phrase", "seq", "doc_id", "tf", "df"]]

    return tf.groupBy("phrase").applyInPandasWithState(count, "phrase string, seq long, doc_id long, tf long, df long", "df long", "append", GroupStateTimeout.NoTimeout)


class InTime(StatefulProcessor):
    """A phrase's documents wait until the watermark has passed their time, and are counted in the order of (ts, doc_id) then.

    A timer stands at the earliest waiting time only. What waits is bounded by what arrives within the watermark's delay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, doc_id long, tf long")
        self.seen = handle.getValueState("seen", "n long")

    def wait(self, first: int, now: int) -> None:
        self.handle.registerTimer(max(-(-first // 1000), now + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        self.waiting.appendList(list(zip(new["us"].tolist(), new["doc_id"].tolist(), new["tf"].tolist(), strict=True)))
        self.wait(int(new["us"].min()), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] <= now * 1000]
        left = rows[len(due):]
        seen = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((seen + len(due),))
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.wait(left[0][0], now)
        out = [(key[0], *r, seen + i) for i, r in enumerate(due, 1)]
        yield pd.DataFrame(out, columns=["phrase", "us", "doc_id", "tf", "df"])

    def close(self) -> None:
        pass


def frequency_in_time(tf: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (phrase, ts, doc_id, tf) with df: documents that hold the phrase up to this one's time, whenever it arrives within `late`.

    Rows come out once the watermark has passed their time; rows that arrive later than `late`, or have no time or phrase, are dropped. It
    needs the RocksDB state store."""
    rows = tf.select("phrase", "ts", F.unix_micros("ts").alias("us"), F.col("doc_id").cast("long").alias("doc_id"), F.col("tf").cast("long").alias("tf")).dropna()
    out = rows.withWatermark("ts", late).groupBy("phrase").transformWithStateInPandas(InTime(), "phrase string, us long, doc_id long, tf long, df long", "Append", "EventTime")
    return out.select("phrase", F.timestamp_micros("us").alias("ts"), "doc_id", "tf", "df")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than `late` are dropped by the watermark when the input is a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Bucket(StatefulProcessor):
    """A bucket of operators.buckets as state: the phrases that it holds and their last documents, oldest first, at most `capacity`."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", "phrases array<long>, docs array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = dict(zip(*self.state.get(), strict=True)) if self.state.exists() else {}
        new = pd.concat(list(rows)).sort_values(["doc_id", "k"])
        out = []
        for doc, p, of in zip(new["doc_id"].tolist(), new["p"].tolist(), new["phrases"].tolist(), strict=True):
            met = buckets.bring(held, p, doc, self.capacity)
            out.append((doc, p, met, of, len(held)))
        self.state.update((list(held), list(held.values())))
        frame = pd.DataFrame(out, columns=["doc_id", "p", "met", "phrases", "held"])
        yield frame.astype({"met": "Int64"})

    def close(self) -> None:
        pass


def bucket_meetings(arrivals: DataFrame, capacity: int) -> DataFrame:
    """A stream of buckets.arrivals as a stream of what buckets.meetings gives, in the order of micro-batches and, within one, of doc_id.

    The state is one bounded list for each bucket (it needs the RocksDB state store). The running query reports the gauges `fullest`, `arrivals` and
    `met` under the name `buckets` with each micro-batch, in the pass that it makes anyway; ProgressLog hands them on."""
    out = arrivals.groupBy("fn", "bucket").transformWithStateInPandas(Bucket(capacity), buckets.MET + ", held int", "Append", "None")
    gauged = out.observe("buckets", F.max("held").alias("fullest"), F.count(F.lit(1)).alias("arrivals"), F.count("met").alias("met"))
    return gauged.where("met is not null").select("doc_id", "p", "met", "phrases")


class GrowingClusters:
    """Labels that micro-batches of (doc_id, phrase) edges extend; `changed` has the labels that the last batch touched."""

    def __init__(self, labels: DataFrame, edges: DataFrame, on_change: Callable[[DataFrame, int], None] | None = None):
        self.labels, self.edges, self.changed, self.on_change = labels, edges, labels.limit(0), on_change

    def add(self, batch: DataFrame, number: int = 0) -> None:
        self.labels, self.edges, self.changed = merge_batch(self.labels, self.edges, batch.select("doc_id", "phrase").distinct())
        if self.on_change:
            self.on_change(self.changed, number)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class GrowingChains:
    """Labels (doc_id, cluster) of linked documents that micro-batches of bucket_meetings extend; a cluster is named by its smallest document.

    A micro-batch is written once before it is used, as each use of a stateful one repeats its pass and its gauges. Components are taken
    of the clusters that its links touch, never of all."""

    def __init__(self, functions: int, labels: DataFrame):
        self.functions, self.labels = functions, labels

    def add(self, batch: DataFrame, number: int = 0) -> None:
        links = materialize(buckets.chains(batch, self.functions).select("doc_id", "predecessor"), "links")
        ends = links.select("doc_id").union(links.select("predecessor")).distinct()
        new = ends.join(self.labels, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("cluster"))
        known = materialize(self.labels.union(new), "labels")
        a, b = known.toDF("doc_id", "a"), known.toDF("predecessor", "b")
        roots = materialize(components(links.join(a, "doc_id").join(b, "predecessor").select("a", "b")), "roots")
        moved = roots.join(roots.groupBy("root").agg(F.min("node").alias("new")), "root").select(F.col("node").alias("cluster"), "new")
        before = self.labels
        self.labels = materialize(known.join(moved, "cluster", "left").select("doc_id", F.coalesce("new", "cluster").alias("cluster")), "labels")
        discard(before, links, known, roots)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ProgressLog(StreamingQueryListener):
    """Hands `write` a line of JSON for each micro-batch of a session's streams: name, batch, rows, milliseconds by phase, and observed gauges."""

    def __init__(self, write: Callable[[str], object]):
        self.write = write

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.write(json.dumps({"name": p.name, "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "ms": dict(p.durationMs), "gauges": {k: v.asDict() for k, v in p.observedMetrics.items()}}))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.write(json.dumps({"name": event.name, "started": event.timestamp}))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.write(json.dumps({"ended": str(event.id), "error": event.exception}))
