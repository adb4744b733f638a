import math
import random
import types
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import distinctive, tfidf

SCHEMA = "doc_id long, text string, phrase string"


def plain(rows, n, k=10, low=3, high=5):
    """{doc_id: the k best (weight, phrase)}, from a table of all phrases."""
    tf = defaultdict(Counter)
    for doc, text, *_ in rows:
        w = (text or "").encode().split()
        tf[doc].update(b" ".join(w[i : i + m]) for m in range(low, high + 1) for i in range(len(w) - m + 1))
    df = Counter(p for found in tf.values() for p in found)
    weight = lambda t, d: round((1 + math.log(t)) * (math.log((1 + n) / (1 + d)) + 1), 9)
    return {d: sorted(((weight(t, df[p]), p.decode(), t, df[p]) for p, t in found.items()), reverse=True)[:k] for d, found in tf.items() if found}


def ranked(docs, n, **kw):
    found = distinctive.candidates(docs, F.col("text"), n, **kw)
    weighted = tfidf.weighed(found, n)
    out = defaultdict(list)
    for r in tfidf.top_phrases(weighted, kw.get("k", 10)).orderBy("doc_id", "rank").collect():
        out[r.doc_id].append((r.weight, r.phrase, r.tf, r.df))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for doc in want:
        assert [x[1:] for x in got[doc]] == [x[1:] for x in want[doc]], doc
        assert [x[0] for x in got[doc]] == pytest.approx([x[0] for x in want[doc]], abs=2e-9)


@pytest.mark.parametrize("seed, words", [(1, 4), (2, 40), (3, 2000)])
def test_best_phrases_equal_those_of_a_table_of_phrases(spark, monkeypatch, seed, words):
    monkeypatch.setattr(distinctive, "SLAB_BYTES", 300)
    rng = random.Random(seed)
    names = ["é" * 3, "a", "a\x01", "ab", "ü1", "x" * 70, "x" * 64 + "y", *(f"w{i}" for i in range(words))]
    texts = [" \t"[i % 2].join(rng.choices(names, k=rng.choice([0, 2, 3, 4, 5, 30, 120]))) for i in range(120)]
    texts += texts[:30] + [t + " a a a a a b" for t in texts[30:60]] + [None, "", " ", "a b", "a b c"]
    rows = [(i if i % 37 else None, t, "clash") for i, t in enumerate(texts)] + [(5, texts[5], "again"), (5, "a a", "again"), (7, None, None)]
    close(ranked(spark.createDataFrame(rows, SCHEMA).repartition(5), len(rows)), plain(rows, len(rows)))


def test_a_hot_phrase_a_long_text_and_other_lengths(spark):
    rows = [(i, "the same phrase everywhere " + (f"own{i} " * 4 if i % 3 else ""), None) for i in range(500)]
    rows.append((1000, " ".join(f"t{i % 5000}" for i in range(200_000)), None))
    close(ranked(spark.createDataFrame(rows, SCHEMA), len(rows), k=3, low=2, high=4), plain(rows, len(rows), 3, 2, 4))


def test_no_documents_and_none_with_phrases(spark):
    assert ranked(spark.createDataFrame([], SCHEMA), 0) == {}
    assert ranked(spark.createDataFrame([(1, None, None), (2, "", None), (3, "one two", None)], SCHEMA), 3) == {}


def test_only_what_may_matter_is_sorted(monkeypatch):
    """Phrases with tf and df 1 are cut by their first words before any sort; the result stays that of all phrases."""
    rng = random.Random(8)
    texts = [[" ".join(rng.choice(["ab", "b", "cde", "d"]) + str(rng.randrange(400)) for _ in range(rng.randrange(0, 900))).encode()] for _ in range(12)] + [[b"a b c a b c a b c"], [b""]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.binary()))], ["doc_id", "texts"])
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    row = next(distinctive._packed_slabs(iter([batch]))).to_pylist()[0]
    slab = distinctive.Slab(row, 3, 5)
    totals = np.array([rng.choice([1, 1, 1, 2]) for _ in np.unique(slab.cells(40))])
    asked = slab.asked(40, totals)
    keys = np.unique(slab.questions(asked)[0])
    counts = np.array([rng.randrange(1, 5) for _ in keys])
    df = {}
    for n, at in slab.place.items():
        for p, key, open_ in zip(at.tolist(), slab.hash[n], asked[n], strict=True):
            phrase = b" ".join(slab.data.tobytes()[slab.start[j] : slab.end[j]] for j in range(p, p + n))
            df.setdefault(int(slab.doc[p]), []).append((phrase, int(counts[np.searchsorted(keys, key)]) if open_ else 1))
    order = lambda rows: sorted(((round((1 + math.log(t)) * (math.log(101 / (1 + f)) + 1), 9), p, t, f) for p, t, f in rows), reverse=True)[:10]
    want = {d: order([(p, n, f) for (p, f), n in Counter(rows).items()]) for d, rows in df.items()}
    sorted_rows, upto = [], distinctive._upto
    monkeypatch.setattr(distinctive, "_upto", lambda group, *rest: sorted_rows.append(len(group)) or upto(group, *rest))
    got = defaultdict(list)
    for d, *rest in zip(*slab.best(10, 100, asked, counts), strict=True):
        got[d].append(rest)
    assert {d: order(rows) for d, rows in got.items()} == want
    assert max(sorted_rows) < sum(map(len, df.values())) * 0.8


def repeated_texts():
    rng = random.Random(9)
    draw = lambda n: [rng.choice(["é", "bb", "c", f"x{rng.randrange(40)}"]) for _ in range(n)]
    passages = [draw(12) for _ in range(6)]
    rows = [(d, " ".join(draw(rng.randrange(8)) + rng.choice(passages) + draw(rng.randrange(8))), None) for d in range(60)]
    return [*rows, (3, "one id twice c c c", None), (None, rows[0][1], None), (99, None, None), (100, "c", None)]


def test_shared_phrases_are_named_once_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(distinctive, "SLAB_BYTES", 200)
    rows, df = repeated_texts(), Counter()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for doc in {d for d, *_ in rows}:
        df.update({p for d, t, _ in rows if d == doc for w in [(t or "").split()] for m in (3, 4, 5) for p in (" ".join(w[i : i + m]) for i in range(len(w) - m + 1))})
    got = distinctive.shared(docs, F.col("text"))
    assert sorted(map(tuple, got.collect())) == sorted((p, n) for p, n in df.items() if n > 1)
    from glyphmill.plans import queries

    assert "phrase" not in "".join(line for line in queries.doc_freq_static(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString().splitlines() if "Exchange" in line)


def test_filling_phrases_are_those_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(distinctive, "SLAB_BYTES", 200)
    docs = spark.createDataFrame(repeated_texts(), SCHEMA).repartition(3)
    n, room = docs.count(), (F.length("text") % 53).cast("int")
    tokens = docs.select("doc_id", room.alias("n_tokens"))
    tf = tfidf.term_frequency(tfidf.grams(docs.select("doc_id", F.split("text", " ").alias("w")), 2, 3))
    df = tfidf.pruned_vocabulary(tfidf.document_frequency(tf), F.lit(n))
    rank = lambda w: sorted(map(tuple, tfidf.prefix_by_length(w.withColumn("weight", F.round("weight", 9)), tokens).collect()))
    found = distinctive.filling(docs, F.col("text"), n, room)
    weighted = tfidf.static_weights(tf, df, n, sublinear=False)
    assert rank(tfidf.weighed(found, n, sublinear=False)) == rank(weighted)
    assert found.count() < weighted.count() / 2
