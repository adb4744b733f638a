"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up hashed n-gram counts by language in the tasks and sums them by a shuffle of bounded size; the matrix of log
probabilities (languages x buckets) is broadcast, and batches of texts are scored sparsely: of all texts' n-grams one after another
the rows that they hold are gathered, and summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_slices, one, worker_state


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # buckets x languages, float32
    prior: np.ndarray
    orders: tuple[int, ...]


def _letters() -> np.ndarray:
    """For every code point whether it is a letter (Unicode category L*)."""
    held = worker_state()
    if "letters" not in held:
        held["letters"] = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return held["letters"]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _buckets(points: np.ndarray, n: int, size: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each position (of len - n + 1)."""
    h = np.full(max(0, len(points) - n + 1), 2654435761 * n, np.uint64)
    for i in range(n):
        h = (h ^ points[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)


def _windows(text: str, orders: tuple[int, ...], size: int, step: int = 500_000) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the whole text, a bounded number at a time."""
    points = _points(text.lower())
    for n in orders:
        for at in range(0, max(1, len(points)), step):
            yield _buckets(points[at : at + step + n - 1], n, size)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = 3000, buckets: int = 1 << 16, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.1, max_languages: int = 256) -> Model:
    """Fit on the rows of `docs` whose text and language are not null.

    `per_language` bounds the expected number of rows of each language; beyond it a language's rows are thinned by a hash
    of the id, evenly over the whole table. Without any row the model has no language. The model of languages x buckets reaches the driver
    and every worker, so more than `max_languages` languages are an error.
    """
    rows = one(docs, id, text, lang).toDF("id", "text", "lang").where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), orders)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    sample = rows.where((F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1_000_000)) / 1e6) < share[F.col("lang")]).select(number[F.col("lang")].alias("k"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for b in _windows(value, orders, buckets):
                    sums[k] += np.bincount(b, minlength=buckets)
        k, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k * buckets + b, pa.int64()), pa.array(sums[k, b], pa.int64())], ["cell", "n"])

    cells = sample.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most languages x buckets
    matrix = np.full(len(languages) * buckets, smoothing)
    matrix[cells["cell"].to_numpy()] += cells["n"].to_numpy()
    matrix = matrix.reshape(len(languages), buckets)
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True))
    seen = np.array([counts[k] for k in languages], float)
    return Model(languages, np.ascontiguousarray(matrix.T, np.float32), np.log(seen / seen.sum()), orders)


def score_texts(model: Model, texts: list[str | None], held: int = 300_000) -> tuple[list[str], list[float]]:
    """Language and posterior probability of each text, `und` and 0 without letters (or for null, or without any language learnt).

    About `held` n-grams are looked up at a time, of as many texts as have them; longer texts take several turns."""
    letters, size = _letters(), len(model.log_probability)
    known = [bool(t and model.languages and letters[_points(t)].any()) for t in texts]
    total = np.tile(model.prior, (len(texts), 1))
    waiting: list[np.ndarray] = []
    of: list[int] = []

    def add_up() -> None:
        if waiting:
            starts = np.cumsum([0, *(len(b) for b in waiting[:-1])])
            np.add.at(total, of, np.add.reduceat(model.log_probability[np.concatenate(waiting)], starts, axis=0, dtype=np.float64))
            waiting.clear()
            of.clear()

    n = 0
    for i, value in enumerate(texts):
        for b in _windows(value, model.orders, size) if known[i] else ():
            if len(b):
                waiting.append(b)
                of.append(i)
                n += len(b)
                if n >= held:
                    add_up()
                    n = 0
    add_up()
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    best = total.argmax(axis=1)  # the first of equals, in code-point order
    top = total[np.arange(len(texts)), best]
    score = 1 / np.exp(total - top[:, None]).sum(axis=1)
    return [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known, strict=True)], [s if k else 0.0 for s, k in zip(score.tolist(), known, strict=True)]


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, lang_pred and score for every row; only the text is looked at. Rows are independent of each other."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # languages x buckets x 4 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 0):
                names, scores = score_texts(sent.value, part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    source = docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{k}`") for k in keep])
    return source.mapInArrow(run, ", ".join([*(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep), "lang_pred string", "score double"]))


def held_out(id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5 (a null id is not held out)."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
