"""Importance resampling towards a target: the documents that read most like it, by an exact histogram of integer scores.

Hashed n-gram features are counted over all documents and over the target's texts; an array of integer gains, one a bucket, scores whole
batches of texts. The draw needs no sort of all documents: scores are integers of a bounded range, so their histogram, summed from the top, tells
the cutoff and how many documents stand above each score; within a score that survives, documents are numbered by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import runs
from glyphmill.llm.common import byte_slices, discard, materialize, one

SCORES = 1 << 20
"""More than the integers that a score can take: gains are within 1000 * ln(2^53) of 0, noise between -3,137 and 22,874."""
_SLAB = 8_000_000


def _words(column: pa.Array) -> runs.Runs:
    """Runs of digits, a-z (texts are lowered) and all that is not ASCII."""
    data, ends = runs.lowered(column)
    return runs.find(data, ends, ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128))


def _features(found: runs.Runs, max_n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every run of 1 to `max_n` words of a text, the words joined by one space, an n at a time."""
    rows, at, crc = found.row, np.arange(len(found.row)), found.crc32()
    yield rows, crc.astype(np.int64) % buckets
    for n in range(2, max_n + 1):
        longer = at + n - 1 < len(rows)
        longer[longer] = rows[at[longer] + n - 1] == rows[at[longer]]
        at, crc = at[longer], crc[longer]  # where runs of n words start, and the crc32 of their first n - 1
        space = runs.Runs(np.array([32], np.uint8), np.zeros(len(at), np.int64), np.ones(len(at), np.int64), at)
        crc = found.take(at + n - 1).crc32(space.crc32(crc))
        yield rows[at], crc.astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, *, text: str, max_n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task adds its own up; `buckets` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in byte_slices(batch, 0, _SLAB):
                for _, bucket in _features(_words(part.column(0)), max_n, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = one(texts, text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's log ratio of target to source, add-one smoothed, in thousandths, rounded down."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + float(n)) / ((a + 1.0) * (t + float(n))))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _noise(h: np.ndarray) -> np.ndarray:
    return np.array([math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h.tolist()], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, *, id: str, text: str, max_n: int, min_words: int, seed: int) -> DataFrame:
    """doc_id, n_features, weight, score, and whether the document has `min_words` words, for each row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(gain)  # one number a bucket
    ident = F.col(f"`{id}`")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    source = docs.select(F.col(f"`{text}`").alias("text"), ident.alias("doc_id"), h.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for part in byte_slices(batch, 0, _SLAB):
                found, k = _words(part.column(0)), part.num_rows
                n, total = np.zeros(k, np.int64), np.zeros(k, np.int64)
                for row, bucket in _features(found, max_n, len(gain)):
                    n += np.bincount(row, minlength=k)
                    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
                    if len(at):
                        total[row[at]] += np.add.reduceat(gain[bucket], at)  # rows come in order
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                enough = np.bincount(found.row, minlength=k) >= min_words
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n), pa.array(weight), pa.array(weight + _noise(part.column(2).to_numpy())), pa.array(enough)], ["doc_id", "n_features", "weight", "score", "enough"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_features long, weight long, score long, enough boolean")


def _numbered(drawn: DataFrame) -> DataFrame:
    """row_number() by doc_id within each score, without a task that holds a score: rows are dealt by ranges of (score, doc_id), numbered in
    each range, and the sizes of a score's earlier ranges added. Rows that are equal in all of this are dealt by their place, which tells them apart."""
    n = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["score", F.col("doc_id").isNull(), "doc_id", "n_features", "place"]
    dealt = materialize(drawn.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "drawn")
    sizes = dealt.groupBy("score", "range").agg(F.count(F.lit(1)).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("score").orderBy("range"))
    before = sizes.select(F.col("score").alias("s"), F.col("range").alias("r"), (upto - F.col("size")).alias("before"))
    own = F.row_number().over(Window.partitionBy("score", "range").orderBy(*order[1:]))
    numbered = dealt.withColumn("own", own)
    return numbered.join(before, (F.col("score") == F.col("s")) & (F.col("range") == F.col("r"))).withColumn("number", F.col("before") + F.col("own"))


def draw(rows: DataFrame, percent: int) -> DataFrame:
    """`rows` (written; doc_id, n_features, weight, score, enough) with rank: 1, 2, 3 ... by score, equal scores by id (null last), for floor(percent * N / 100) of
    the N rows with enough words; null for the others."""
    spark = rows.sparkSession
    found = rows.where("enough").groupBy("score").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("score", ascending=False)  # at most SCORES rows
    if len(found) > SCORES:
        raise ValueError("scores are out of range")
    size = found["n"].to_numpy(np.int64)
    above = np.cumsum(size) - size  # documents with a greater score
    wanted = percent * int(size.sum()) // 100
    alive = above < wanted
    columns = ["doc_id", "n_features", "weight", "score"]
    if not alive.any():
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    cutoff = int(found["score"].to_numpy()[alive][-1])
    offsets = spark.createDataFrame(list(zip(found["score"].to_numpy()[alive].tolist(), above[alive].tolist(), strict=True)), "s2 long, above long")
    survives: Column = F.col("enough") & (F.col("score") >= cutoff)
    numbered = _numbered(rows.where(survives)).join(F.broadcast(offsets), F.col("score") == F.col("s2"))
    rank = F.col("above") + F.col("number")
    return numbered.select(*columns, F.when(rank <= wanted, rank).alias("rank")).union(rows.where(~survives).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, *, id: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of `docs`; rank is null for those that are not drawn.

    Null and empty texts have no features and weight 0; a null id counts as empty text in the hash and comes last among equal scores. Repeated
    rows count and are ranked each. Texts of any length are taken whole. Other columns are ignored. Without a target all gains come
    from the documents alone; an empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, text=text, max_n=max_n, buckets=buckets), bucket_counts(target, text=target_text, max_n=max_n, buckets=buckets))
    rows = materialize(scored(docs, gain, id=id, text=text, max_n=max_n, min_words=min_words, seed=seed), "scored")
    return draw(rows, percent)


ORACLE = r"""
WITH crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
named AS (SELECT word, hex(encode(word)) AS bytes FROM (SELECT word FROM d UNION SELECT word FROM b)),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(bytes) // 2), lambda i: ('0x' || bytes[2 * i + 1 : 2 * i + 2])::BIGINT)),
                                        lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket FROM named, crc),
s AS (SELECT bucket, count(*) AS n FROM d JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE
                                          / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g
         FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS total FROM d JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h
      FROM documents LEFT JOIN w USING (doc_id)),
g AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM g WHERE n_features >= 20)
SELECT g.doc_id, g.n_features::BIGINT AS n_features, g.weight, g.score, r.rank::BIGINT AS rank
FROM g LEFT JOIN r ON r.doc_id = g.doc_id AND r.rank <= (SELECT 10 * count(*) // 100 FROM g WHERE n_features >= 20)
"""
