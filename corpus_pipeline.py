"""The corpus pipeline: documents to token ids, in stages that are each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import byte_bpe, jaccard_join, langid, line_dedup, mixing
from glyphmill.llm.common import fresh_path, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language is less certain than this is rejected.
MIN_SCORE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no text, no letters) and those whose language is uncertain; the rest stay as they are."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, keep=COLUMNS)
    # without any labelled row nothing can be learnt, and nothing is rejected for it
    return _documents(found.where(F.lit(not model.languages) | ((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines of windows that occurred before; documents that lose all their lines go."""
    found = line_dedup.line_dedup(docs, keep=("lang", "source"))
    kept = found.where("n_removed = 0 or text <> ''")
    return _documents(kept.withColumn("n_chars", F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays: that with the smallest doc_id (null last), then the smallest hash of its text.

    Rows that repeat both id and text are one row then. Documents without words have no component and all stay.
    """
    found = materialize(jaccard_join.jaccard_components(docs, detail=True), "near-duplicates")
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "times")
    first = rows.where("root is not null").groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash", "first.times")
    blank = rows.where("root is null").select("doc_id", "text_hash", F.lit(1).alias("times"))
    kept = materialize(first.union(blank).toDF("kept_id", "kept_hash", "times").distinct(), "near-duplicates-kept")
    of = lambda k: docs.join(k, docs["doc_id"].eqNullSafe(k["kept_id"]) & (F.xxhash64(docs["text"]) == k["kept_hash"]), "left_semi")
    repeated = of(kept.where("times > 1"))
    return _documents(of(kept.where("times = 1"))).union(_documents(repeated.dropDuplicates(["doc_id", "text"])))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as many times as the words that the mix takes hold it whole, to the nearest number; 0 times: it goes."""
    found = mixing.mix(docs, keep=("text", "lang", "source", "n_chars"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return _documents(found.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the hashes of the ids and of the decoded bytes."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, keep=("lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("jaccard_join", near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Naive Bayes and byte-pair encoding have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
