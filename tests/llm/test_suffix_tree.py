import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import suffix_tree

END = object()


def tokens(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [END]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Brute:
    """The model from its definition, in dicts."""

    def __init__(self, rows, min_count, divergence, prior):
        self.prior = prior
        training = [tokens(t) for i, t in rows if not held(i)]
        self.next = defaultdict(Counter)
        for words in training:
            for k, w in enumerate(words):
                for depth in range(min(k, 2) + 1):
                    self.next[tuple(words[k - depth : k])][w] += 1
        self.c = self.next[()]
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.tree = set()
        for context, after in self.next.items():
            n = sum(after.values())
            if context and n >= min_count and (len(context) == 1 or sum(self.next[context[1:]].values()) >= min_count):
                gain = sum(c * math.log((c - 1 + prior * self.p(s, context[1:])) / (n - 1 + prior) / self.p(s, context[1:])) for s, c in after.items())
                if gain >= divergence * n:
                    self.tree |= {context, context[1:]} - {()}

    def p(self, s, context):
        if not context:
            return (self.c[s] + 1) / (self.n + self.v + 1)
        after = self.next.get(context, Counter())
        return (after[s] + self.prior * self.p(s, context[1:])) / (sum(after.values()) + self.prior)

    def row(self, i, text):
        words, base, score = tokens(text), 0.0, 0.0
        for k, s in enumerate(words):
            context = next((x for x in (tuple(words[max(0, k - 2) : k]), tuple(words[max(0, k - 1) : k])) if x in self.tree), ())
            base += math.log10(self.p(s, ()))
            score += math.log10(self.p(s, context))
        return (i, held(i), len(words), sum(s in self.c for s in words), self.n, base, score)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)


def same(found, want):
    want = sorted(want, key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def chains(seed, n):
    """Words that depend on the last one or two."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice("abcdefg")]
        for _ in range(rng.randint(0, 40)):
            x = words[-1]
            words.append("c" if words[-2:] == ["a", "b"] else "b" if x == "a" and rng.random() < 0.8 else rng.choice(["a", "b", "d", "É", "f", f"rare{rng.randint(0, 500)}"]))
        out.append((i, " \n".join(words).upper() if i % 3 else " ".join(words)))
    return out


@pytest.mark.parametrize("slab_bytes,part_tokens", [(16_000_000, 2_000_000), (900, 1500)])
def test_equals_brute_force_and_beats_the_base(spark, slab_bytes, part_tokens):
    rows = chains(1, 400)
    model = Brute(rows, 20, 0.02, 10.0)
    assert {len(c) for c in model.tree} == {1, 2} and len(model.tree) < sum(1 for c in model.next if c)
    for context in list(model.tree)[:5]:
        assert math.isclose(sum(model.p(s, context) for s in model.c) + model.p("unknown", context), 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = result(suffix_tree.suffix_tree_scores(df, min_count=20, prior=10.0, slab_bytes=slab_bytes, part_tokens=part_tokens))
    same(found, [model.row(i, t) for i, t in rows])
    out = [r for r in found if r[1]]
    assert out and sum(r[6] for r in out) > sum(r[5] for r in out) + 50


def test_odd_rows(spark):
    rows = [(None, "a b"), (None, None), (1, ""), (2, " \t\n"), (3, "x " * 60_000 + "y"), (4, "z" * 100_000), (4, "z" * 100_000), (5, "日本 é\x00 |"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("slab", "id", "name", "ids", "held", "n", "kind", "part", "keys", "contexts"):
        df = df.withColumn(name, F.lit("clash"))
    for slab_bytes in (16_000_000, 50):
        same(result(suffix_tree.suffix_tree_scores(df, slab_bytes=slab_bytes)), [Brute(rows, 64, 0.02, 64.0).row(i, t) for i, t in rows])
    assert result(suffix_tree.suffix_tree_scores(df.limit(0))) == []


def test_without_training_rows(spark):
    ids = [i for i in range(200) if held(i)][:5]
    rows = [(i, "a b a b") for i in ids]
    found = result(suffix_tree.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string")))
    same(found, [(i, True, 5, 0, 0, 0.0, 0.0) for i in ids])


def test_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (suffix_tree._unpack_sorted(suffix_tree._pack_sorted(keys)) == keys).all()
        assert (suffix_tree._unpack(suffix_tree._pack(keys), np.uint64) == keys).all()
