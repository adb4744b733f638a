"""Phrase weights: static, running and mini-batch TF-IDF, and the most distinctive phrases of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.storage import materialize

SEQ_BUCKET = 65536


def numbered(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """`df` with a 0-based position in the order of `order`, without a window over all rows: range partitions are numbered each by
    itself, and the sizes of the partitions before are added."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(before, "__part").withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before", "__n")


def located(docs: DataFrame, *by: str) -> DataFrame:
    """The rows with all rows of a key in one partition (by default of a doc_id), so that what documents are turned into is counted by key
    where it arises: documents are shuffled once, and their phrases, many times as large, are not."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(by or ("doc_id",)))


def grams(docs: DataFrame, low: int, high: int, *keep: str) -> DataFrame:
    """One row per occurrence of a run of `low` to `high` words of the array w, joined by a space: doc_id, the columns in `keep`, n, phrase.

    Words are exploded and looked up from their places, which stays in generated code. Outer explodes keep Spark from
    making the array twice to filter out empty ones."""
    word = lambda j: F.get("w", F.col("__at") + j)
    runs = F.array(*[F.when(F.col("__at") + n <= F.size("w"), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *map(word, range(n))).alias("phrase"))) for n in range(low, high + 1)])
    places = docs.select("doc_id", *keep, "w", F.posexplode_outer("w").alias("__at", "__word")).where("__word is not null")
    return places.select("doc_id", *keep, F.explode_outer(runs).alias("__run")).where("__run is not null").select("doc_id", *keep, "__run.n", "__run.phrase")


def phrases(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """One row per occurrence of a word: doc_id, the columns in `keep`, phrase."""
    return docs.select("doc_id", *keep, F.explode_outer(words).alias("phrase")).where("phrase is not null")


def term_frequency(occurrences: DataFrame, *keys: str) -> DataFrame:
    return occurrences.groupBy(*(keys or ("doc_id",)), "phrase").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """tf has one row per document and phrase, so no distinct is needed."""
    return tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))


def pruned_vocabulary(df: DataFrame, n_docs: Column, min_df: int = 2, max_share: float = 0.8) -> DataFrame:
    return df.where((F.col("df") >= min_df) & (F.col("df") <= max_share * n_docs))


def weighed(counted: DataFrame, n_docs: int, sublinear: bool = True) -> DataFrame:
    """Rows with tf and df, with the weight (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), or tf itself in place of its logarithm."""
    return counted.withColumn("weight", (1 + F.log("tf") if sublinear else F.col("tf")) * (F.log((F.lit(1) + n_docs) / (1 + F.col("df"))) + 1))


def static_weights(tf: DataFrame, df: DataFrame, n_docs: int, sublinear: bool = True) -> DataFrame:
    """tf with df and the weight of each phrase."""
    return weighed(tf.join(df, "phrase"), n_docs, sublinear)


def top_phrases(weighted: DataFrame, k: int, score: str = "weight", *, digits: int = 9) -> DataFrame:
    """The k best of each document, with their rank; equal scores by phrase, descending. Scores are rounded first, so that ties stay ties."""
    rounded = weighted.withColumn(score, F.round(score, digits))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(score), F.desc("phrase")))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


def running_frequency(tf: DataFrame) -> DataFrame:
    """tf (doc_id, seq, phrase, tf) with df: documents up to this one that hold the phrase.

    Counted within buckets of positions, plus the sum of earlier buckets, so a frequent phrase is no single window partition."""
    rows = tf.withColumn("bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    per_bucket = rows.groupBy("phrase", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = per_bucket.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("phrase").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("phrase", "bucket").orderBy("seq"))
    return rows.withColumn("inside", inside).join(before, ["phrase", "bucket"]).withColumn("df", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def batch_number(seq: Column, n: int) -> Column:
    """Batch 0 holds the first 3 * ceil(n / 10) rows, each later one ceil(n / 10)."""
    t = max(1, -(-n // 10))
    return F.when(seq < 3 * t, 0).otherwise(1 + F.floor((seq - 3 * t) / t)).cast("long")


def batch_frequency(tf: DataFrame, n: int) -> DataFrame:
    """tf (doc_id, seq, phrase, tf) with df: documents of this batch and earlier ones that hold the phrase."""
    rows = tf.withColumn("batch", batch_number(F.col("seq"), n))
    per = rows.groupBy("phrase", "batch").agg(F.count(F.lit(1)).alias("n"))
    upto = per.withColumn("df", F.sum("n").over(Window.partitionBy("phrase").orderBy("batch"))).drop("n")
    return rows.join(upto, ["phrase", "batch"])


def running_score(rows: DataFrame) -> DataFrame:
    """tf * ln((N + 1) / df) with the 0-based position N, in all regimes; it may be negative when df looks ahead."""
    return rows.withColumn("score", F.round(F.col("tf") * F.log((F.col("seq") + 1) / F.col("df")), 6))


def top_running(scored: DataFrame, k: int, dedupe: bool = False) -> DataFrame:
    """The k best (score, phrase) of each document. A phrase that occurs tf times takes up to tf places, unless `dedupe`;
    each phrase comes out once, with the first place it takes."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc("phrase"))
    taken = F.lit(1) if dedupe else F.col("tf")
    before = F.coalesce(F.sum(taken).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return scored.withColumn("place", before + 1).where(F.col("place") <= k)


def prefix_by_length(weighted: DataFrame, n_tokens: DataFrame) -> DataFrame:
    """Best phrases as long as the characters of the second to the last one taken stay below the document's number of tokens."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc("phrase"))
    ranked = weighted.withColumn("rank", F.row_number().over(order)).withColumn("length", F.when(F.col("rank") == 1, 0).otherwise(F.length("phrase")))
    ranked = ranked.withColumn("before", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(n_tokens, "doc_id").where((F.col("rank") == 1) | (F.col("before") < F.col("n_tokens"))).select("doc_id", "rank", "phrase")
