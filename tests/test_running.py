import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import running, storage, tfidf
from glyphmill.plans import queries


def written_rows(spark, monkeypatch, run):
    """Rows of all tables that a query writes on its way."""
    paths, fresh = [], storage.fresh_path
    monkeypatch.setattr(storage, "fresh_path", lambda s, name: paths.append(fresh(s, name)) or paths[-1])
    monkeypatch.setattr(running, "discard", lambda *frames: None)
    run()
    return sum(spark.read.parquet(p).count() for p in paths)


@pytest.mark.parametrize("name", ["running_tfidf_normal", "running_tfidf_stream", "running_tfidf_batch", "stream_df_replay"])
def test_no_table_of_phrases_is_written(spark, monkeypatch, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = docs.select(F.size(queries.text.words2(queries.text.clean_ascii("text"))).alias("n")).agg(F.sum("n")).first()[0]
    rows = written_rows(spark, monkeypatch, lambda: getattr(queries, name)(spark, "/root/testdata/sf0.001").count())
    assert 0 < rows < words / 5


def test_frequencies_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["", None, "a b"]
    ids = rng.sample(range(-100, 1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)
    of = running.packed(docs, F.split(F.coalesce("text", F.lit("")), " "), 3)
    counts = []
    for i in sorted(range(len(ids)), key=ids.__getitem__):
        w = (texts[i] or "").split()
        counts.append((ids[i], Counter(" ".join(w[j : j + 3]) for j in range(len(w) - 2))))
    held, batch = defaultdict(list), running.batches(np.arange(len(ids)), len(ids)).tolist()
    for seq, (_, c) in enumerate(counts):
        for p in c:
            held[p].append(seq)
    counted = {"normal": lambda s, t: True, "stream": lambda s, t: t <= s, "batch": lambda s, t: batch[t] <= batch[s]}
    for mode, sees in counted.items():
        want = {(d, s, p, n, sum(sees(s, t) for t in held[p])) for s, (d, c) in enumerate(counts) for p, n in c.items()}
        assert {tuple(r) for r in running.frequencies(of, mode, None, running.batches).collect()} == {r for r in want if r[4] > 1}
        rows = spark.createDataFrame(sorted(want), "doc_id long, seq long, phrase string, tf long, df long")
        best = lambda df: {tuple(r) for r in tfidf.top_running(tfidf.running_score(df), 4).select("doc_id", "place", "phrase", "tf", "df", "score").collect()}
        assert best(running.frequencies(of, mode, 4, running.batches)) == best(rows)


def test_slabs_hold_what_was_packed(spark):
    docs = spark.createDataFrame([(3, "a b c"), (1, "a b c d")], "doc_id long, text string")
    rows = running.packed(docs, F.split("text", " "), 3).slabs.orderBy("first").collect()
    assert [d for r in rows for d in r["ids"]] == [1, 3] and sum(r["n_words"] for r in rows) == 7
    assert [x for r in rows for x in r["rooms"]] == [0, 0]
