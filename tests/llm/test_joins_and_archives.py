import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import jaccard_join, vector_join, warc
from glyphmill.llm.common import fresh_path


def clash(df):
    for name in ("row_key", "n", "key", "payload", "first", "rep", "raw", "root", "sig", "copies", "h"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(ids, links):
    parent = list(range(len(ids)))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    best = {}
    for i, v in enumerate(ids):
        r = find(parent, i)
        best[r] = v if best.get(r) is None else best[r] if v is None else min(v, best[r])
    return [best[find(parent, i)] for i in range(len(ids))]


def test_chain_skips_magic_in_payloads():
    inner = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    record = lambda body: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    data = record(inner + inner) + record(b"") + record(b"WARC/1.0\r\n no header") + record(b"x")
    offsets, successors, _ = warc.candidates(data)
    kept = warc.reachable(offsets, successors)
    assert len(offsets) == 7 and kept.sum() == 4
    at, want = 0, []
    while at < len(data):
        want.append(at)
        at = int(successors[list(offsets).index(at)])
    assert offsets[kept].tolist() == want
    assert warc.reachable(*warc.candidates(b"junk" + data)[:2]).sum() == 0
    assert warc.reachable(np.empty(0, np.int64), np.empty(0, np.int64)).tolist() == []


def test_false_magic_takes_linear_time():
    import time

    began = time.time()
    for junk in (b"WARC/1.1\r\n" * 100_000, b"\r\n\r\nWARC/1.1\r\nContent-Length: 5" * 100_000, b"xWARC/1.0\r\nx" * 100_000):
        data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % (len(junk) + 4) + b"\r\n\r\n" + junk + b"\r\n\r\n"
        assert [r[4] for r in warc.records(data)] == [len(junk)]
    assert time.time() - began < 20


def test_warc_round_trip_and_edges(spark):
    evil = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    html = ["a", None, "", "b", "a", evil, evil, "é🙂\r\n\r\nx", "y" * 300_000, "a", "\x00\x01"]
    rows = [(i * 3, f"http://x/{i}" if i % 4 else None, h) for i, h in enumerate(html)] + [(None, "http://n\r\nWARC/1.1", "a"), (0, "u", "a")]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"))
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        again = i is None or i > first[h or ""]
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None, True))
    got = warc.round_trip(df, records_per_file=3).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    cut = warc.round_trip(df, records_per_file=3, large=2).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok").collect()
    assert sorted(map(repr, map(tuple, cut))) == sorted(map(repr, want))
    assert warc.round_trip(df.limit(0)).collect() == []
    assert all(r.record_type == "response" for r in warc.round_trip(df, min_payload=1_000_000).collect())


def test_archives_start_with_a_record(spark):
    path = fresh_path(spark, "archives")
    warc.write_warc(spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], "page_id long, url string, html string"), path)
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).collect():
        assert bytes(row.content).startswith(b"WARC/1.1\r\n") and bytes(row.content).endswith(b"\r\n\r\n")


def shingle_set(text, width=5):
    words = (text or "").encode().translate(jaccard_join.LOWER).split()
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_jaccard(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return list(zip([i for i, _ in rows], map(len, sets), brute_components([i for i, _ in rows], links), strict=True))


def test_jaccard_components_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts = [None, "", " \n", "One two", "one  TWO", "a b c d e", "a b c d e f", "x " * 5000]
    for length in (4, 5, 6, 8, 9, 12, 20, 33, 60, 150, 400):
        for _ in range(3):
            base = [word() for _ in range(length)]
            texts.append(" ".join(base))
            for _ in range(8):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, length // 15))):
                    copy[rng.randrange(len(copy))] = word()
                if rng.random() < 0.5:
                    copy = copy[rng.randint(0, length // 5) :] + [word() for _ in range(rng.randint(0, length // 8))]
                texts.append(" ".join(copy).title() if rng.random() < 0.2 else " ".join(copy))
    passage = " ".join(word() for _ in range(60))
    texts += [" ".join([*(word() for _ in range(30)), passage, *(word() for _ in range(rng.randint(0, 12)))]) for _ in range(120)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(3, "one two"), (None, "a b c d e"), (None, "only here in a row without any id"), rows[0]]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = jaccard_join.jaccard_components(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_jaccard(rows)))


def test_jaccard_pairs_of_near_copies_with_a_sentence_of_a_third(spark):
    rng = random.Random(21)
    words = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        base, sentence = words(70), words(20)
        texts += [" ".join(base), " ".join(base + sentence), " ".join(words(50) + sentence)]
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_jaccard(rows))
    assert sum(r.doc_id != r.component_id for r in got) == 60


def test_jaccard_does_not_depend_on_the_order_of_signatures(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = f"v{rng.randint(0, 99)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(brute_jaccard(rows))
    assert sorted(map(tuple, jaccard_join.jaccard_components(df).collect())) == want
    assert sorted(map(tuple, jaccard_join.jaccard_components(df, hot_size=1).collect())) == want
    assert jaccard_join.jaccard_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 15, 16, 21, 31, 32, 100, 500])
def test_similar_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        extra = rng.integers(0, 2**63, rng.integers(0, n // 2 + 1)).astype(np.uint64)
        b = np.unique(np.r_[a[rng.random(len(a)) > rng.random() * 0.2], extra])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 75 * (len(a) + len(b) - common) and len(b):
            hot = np.sort(rng.choice(a, min(len(a), 5), replace=False))
            for h in (np.empty(0, np.uint64), hot, a):
                assert np.intersect1d(jaccard_join.signatures(a, h, 75), jaccard_join.signatures(b, h, 75)).size


@pytest.mark.parametrize("percent", [50, 60, 75, 90, 100])
def test_similar_sets_of_any_size_share_a_signature_at_any_similarity(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 70), *rng.integers(70, 300, 30).tolist()]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            gone = int(rng.integers(0, n - -(-n * percent // 100) + 1))
            new = int(rng.integers(0, (n - gone) * 100 // percent - n + 1))
            b = np.unique(np.r_[rng.permutation(a)[: n - gone], rng.integers(0, 2**63, new).astype(np.uint64)])
            hot = np.unique(np.r_[a[rng.random(n) < rng.random()], b[rng.random(len(b)) < rng.random()]])
            assert np.intersect1d(jaccard_join.signatures(a, hot, percent), jaccard_join.signatures(b, hot, percent)).size


def test_groups_cross_batches():
    import pyarrow as pa

    rng = random.Random(6)
    rows = sorted((rng.randint(0, 12), rng.randint(0, 3)) for _ in range(60)) + [(99, 1)] * 5 + [(100, 1)] * 3 + [(100, 2)]
    keys = {}
    for s, k in rows:
        keys.setdefault(s, set()).add(k)
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows[i : i + size]], pa.int64()), pa.array([k for _, k in rows[i : i + size]], pa.int64())], ["sig", "key"]) for i in range(0, len(rows), size)]
        out = [r for b in jaccard_join._groups(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["sig"], r["key"]) for r in out if r["key"] is not None) == [(s, k) for s in sorted(keys) if len(keys[s]) > 1 for k in sorted(keys[s])]
        ends = {r["sig"]: (r["n"], r["print"]) for r in out if r["key"] is None}
        assert {s: n for s, (n, _) in ends.items()} == {s: len(k) for s, k in keys.items() if len(k) > 1}
        assert all((ends[s] == ends[t]) == (keys[s] == keys[t]) for s in ends for t in ends)


def test_folded_parities_never_rule_out_similar_sets():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    for n in (10, 200, 300, 1000, 9000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 10 :], rng.integers(0, 2**63, n // 8).astype(np.uint64)])
        far = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        bits = jaccard_join.Parities(pa.array([jaccard_join.parity(s) for s in (a, b, far)]))
        sizes = np.array([len(a), len(b), len(far)])
        assert jaccard_join._plausible_pairs(sizes, bits, np.array([0, 0]), sizes, bits, np.array([1, 2]), 75).tolist() == [True, n <= 10 and False]


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    from glyphmill.operators import storage

    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    texts = [f"one two three four five six seven eight nine ten {i // 2}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(jaccard_join.jaccard_components(df).collect()) == 20
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"jaccard-sets", "jaccard-placed"}


def brute_vectors(rows, least=0.95):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        x /= np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= least]
    counts = [sum(i in pair for pair in links) for i in range(len(rows))]
    comps = brute_components([i for i, _ in rows], links)
    return [(i, n, c, i == c) for (i, _), n, c in zip(rows, counts, comps, strict=True)]


@pytest.mark.parametrize("cell_size", [4, 40, 4096])
def test_vector_components_equal_brute_force(spark, cell_size):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 8))
    rows = []
    for i in range(260):
        v = centers[i % 12] + rng.normal(size=8) * (0.05 if i % 3 else 0.35)
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 2, 0.5])]))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, [0.0] * 8), (1004, [float("nan")] * 8), (1005, [1.0, None, *[0.0] * 6]), (1006, []), (1007, [float("inf")] + [0.0] * 7), (1008, [1.0, 2.0]), (1009, [2.0, 4.0]), (1010, [1e300] * 8), (1011, [1e-300] * 8)]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vector_join.vector_components(df, cell_size=cell_size).collect()
    assert sorted(map(tuple, got)) == sorted(brute_vectors(rows))


def test_vector_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_join.vector_components(empty).collect() == []
    only = spark.createDataFrame([(5, None), (None, [1.0]), (5, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(repr, map(tuple, vector_join.vector_components(only).collect())))
    assert got == sorted(map(repr, [(5, 0, 5, True), (None, 1, 5, False), (5, 1, 5, True)]))


def test_frequent_shingles_are_searched_for_by_their_leading_bits_only(monkeypatch):
    rng = np.random.default_rng(8)
    hot = np.sort(rng.integers(0, 2**64, 2000, np.uint64))
    s = np.unique(np.r_[rng.integers(0, 2**64, 5000, np.uint64), hot[::7], hot[:50] ^ np.uint64(1)])
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v: searched.append(len(v)) or search(a, v))
    found = jaccard_join._frequent(s, hot, jaccard_join._filter(hot))
    assert found.tolist() == np.isin(s, hot).tolist() and 300 < sum(searched) < 600
    assert jaccard_join.signatures(s, hot, 75).tolist() == jaccard_join.signatures(s, hot, 75, jaccard_join._filter(hot)).tolist()


def test_shingles_are_distinct_and_sorted():
    for text in (b"a b c d e a b c d e a b", b"a", b"", None, b"x " * 40, b"q w e r t y"):
        s = jaccard_join.shingles(text)
        assert s.tolist() == sorted(set(s.tolist()))
        assert len(s) == {12: 5, 1: 1, 0: 0, 40: 1, 6: 2}[len((text or b"").split())]
