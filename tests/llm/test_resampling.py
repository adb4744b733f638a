import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_n):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    """The contract, document by document: tuples of doc_id, n_features, weight, score, rank."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, max_n)[1]))
    for text in target:
        t.update(map(bucket, features(text, max_n)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out, eligible = [], []
    for i, text in rows:
        words, found = features(text, max_n)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= min_words:
            eligible.append(out[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for k, r in enumerate(eligible[: percent * len(eligible) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    words = [w + str(k) for k in range(40) for w in ("The", "é", "日本", "x")]
    cut = [" ", ", ", "\x00", "_", "\n"]
    return [(i, "".join(rng.choice(words) + rng.choice(cut) for _ in range(rng.choice((0, 5, 19, 20, 40))))) for i in range(n)]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("max_n,percent", [(1, 10), (3, 37)])
def test_equals_brute_force(spark, max_n, percent):
    rows, target = texts(1, 300), [None, "", "the1 the2 X3 X3 日本4", "x" * 300]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n, percent=percent)
    assert result(found) == brute(rows, target, max_n=max_n, percent=percent)


def test_ties_repeats_nulls_and_clashes(spark):
    """Equal rows, and equal scores by repeated ids, over the cutoff; null ids last."""
    text = "w " * 25
    rows = [(7, text)] * 40 + [(None, text)] * 40 + [(8, text + "w")] * 10 + [(9, None), (10, ""), (None, None), (11, "w " * 19), (12, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name in ("h", "score", "rank", "range", "place", "s", "n"):
        df = df.withColumn(name, F.lit("clash"))
    target = spark.createDataFrame([("w",)], "text string")
    for percent in (10, 50, 100, 0):
        assert result(resampling.resample(df, target, percent=percent)) == brute(rows, ["w"], percent=percent)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame(texts(2, 30), "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert result(resampling.resample(docs, target)) == brute(texts(2, 30), [])
    assert result(resampling.resample(docs.limit(0), target)) == []
