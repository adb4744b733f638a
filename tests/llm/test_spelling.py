import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import runs, spelling


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, min_length=7, min_count=2, ratio=10, divisor=31):
    """The contract, word by word."""
    counts = {}
    for i, text in rows:
        word = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                word += c.lower() if c.isascii() else c
            elif word:
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                if h % divisor == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                counts[word] = counts.get(word, 0) + 1
                word = ""
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: [v for v in counts if distance_one(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in counts if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= ratio * counts[w]}
    root = {}
    for w in counts:
        r = w
        while r in form:
            r = form[r]
        root[w] = r
    return {(w, form.get(w), root[w], n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def invented(seed, n=400, letters="abé"):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(5, 10))) for _ in range(150)] + ["a" * k for k in range(5, 14)]
    weights = [rng.choice((1, 1, 3, 40)) for _ in words]
    cut = [" ", ", ", "1", "\n", "—", " Ā"]
    return [(i, "".join(w.title() + rng.choice(cut) for w in rng.choices(words, weights, k=rng.randint(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("seed,cells,ratio", [(1, 300_000, 10), (2, 40, 2)])
def test_equals_brute_force_with_tries_that_are_dealt_again(spark, seed, cells, ratio):
    rows = invented(seed)
    found = result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), cells=cells, ratio=ratio))
    assert found == brute(rows, ratio=ratio)
    assert any(r[1] for r in found)


def test_roots_of_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w3"), ("y", "z")]
    found = {tuple(r) for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert found == {(f"w{i}", "w11") for i in range(11)} | {("x", "w11"), ("y", "z")}


def test_short_words_pair_too(spark):
    rows = invented(3, n=60, letters="ab")
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    assert result(spelling.spelling_variants(df, min_length=1, cells=10)) == brute(rows, min_length=1)


def test_odd_rows(spark):
    long = "ab" * 3_000
    rows = [(None, "spelling spelling"), (None, None), (5, ""), (6, "1 2 — ...\x00"), (7, long + " " + long + "c " + long), (8, long + "c"), (9, "ÀÉÎõü÷× " * 3), (9, "ÀÉÎõü÷× " * 3)]
    rows += [(i, "spelling") for i in range(20, 65)] + [(i, "speling") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(spelling.spelling_variants(df)) == want
    assert any(r[:3] == ("speling", "spelling", "spelling") for r in want)
    clashing = df
    for name in ("word", "n", "level", "prefix", "form", "root", "best"):
        clashing = clashing.withColumn(name, F.lit("clash"))
    assert result(spelling.spelling_variants(clashing, cells=1000)) == want
    assert result(spelling.spelling_variants(df.limit(0))) == set()
    named = df.select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("body"))
    assert result(spelling.spelling_variants(named, id="key", text="body")) == brute([(None if i is None else f"d{i}", t) for i, t in rows])


def test_many_tries_in_one_go():
    """Pairs are found within groups only, once each, whatever the groups' middles share."""
    rng = random.Random(4)
    rows = sorted({(g, "".join(rng.choices("abc", k=rng.choice((3, 4))))) for g in range(6) for _ in range(60)})
    group = np.array([g for g, _ in rows])
    middles = [m for _, m in rows]
    a, b = spelling.near_pairs(group, middles, np.full(len(rows), 3), np.zeros(len(rows), bool))
    found = [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and min(len(middles[i]), len(middles[j])) == 3 and distance_one(middles[i], middles[j])}
    assert len(found) == len(set(found)) and {(max(p), min(p)) for p in found} == want


def test_runs_of_bytes():
    import pyarrow as pa

    texts = [None, "", "Ab c", "é" * 50, "x" * 200 + " y", " ", "end"]
    data, ends = runs.lowered(pa.array(["skipped", *texts]).slice(1))
    found = runs.words(data, ends)
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").lower().split()]
    assert [(r, found.bytes_of(k).decode()) for k, r in enumerate(found.row.tolist())] == want
    assert found.strings().to_pylist() == [w for _, w in want]
    assert found.crc32().tolist() == [zlib.crc32(w.encode()) for _, w in want]
    assert found.crc32(np.uint32(zlib.crc32(b"7:"))).tolist() == [zlib.crc32(b"7:" + w.encode()) for _, w in want]
    assert len(set(found.hash64().tolist())) == len(set(want))
    assert runs.find(*runs.lowered(pa.array([], pa.string())), np.zeros(0, bool)).start.tolist() == []
