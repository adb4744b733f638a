import numpy as np
from pyspark.sql import functions as F

from glyphmill.operators import graph, spectral
from glyphmill.plans import queries


def matrix(edges, n):
    a = np.zeros((n, n))
    for s, d in {tuple(r) for r in edges.collect()}:
        a[s, d] = 1
    return a


def held_to(a, k, sigma, u):
    values = [r.sigma for r in sigma.orderBy("axis").collect()]
    np.testing.assert_allclose(values, np.linalg.svd(a, compute_uv=False)[: len(values)], rtol=1e-7, atol=1e-7)
    x = np.zeros((len(a), len(values)))
    for r in u.collect():
        x[r.node, r.axis] = r.u
    np.testing.assert_allclose(x.T @ x, np.eye(len(values)), atol=1e-9)
    np.testing.assert_allclose(a @ (a.T @ x), x * np.square(values), atol=1e-6 * values[0] ** 2)
    assert {r.node for r in u.collect()} == set(np.flatnonzero(a.any(axis=1)).tolist())
    return values


def test_blocks_equal_the_dense_matrix_and_send_no_vectors_to_the_driver(spark):
    edges = graph.random_edges(spark, 300, 900).cache()
    a = matrix(edges, 300)
    whole = held_to(a, 4, *graph.singular_vectors(edges, 4))
    blocks = held_to(a, 4, *spectral.singular_vectors(edges, 4, dense=0, size=64))
    assert len(whole) == len(blocks) == 4


def test_copies_of_a_graph_have_equal_values(spark):
    one = graph.random_edges(spark, 20, 150)
    edges = one.crossJoin(spark.range(12)).select((F.col("src") + 20 * F.col("id")).alias("src"), (F.col("dst") + 20 * F.col("id")).alias("dst"))
    values = held_to(matrix(edges, 240), 5, *spectral.singular_vectors(edges, 5, dense=0, size=64))
    assert max(values) - min(values) < 1e-6


def test_no_edges(spark):
    sigma, u = graph.singular_vectors(spark.createDataFrame([], "src long, dst long"), 3)
    assert sigma.count() == u.count() == 0


def test_phrases_of_one_document_are_counted_not_joined(spark, monkeypatch):
    rows = [(d, f"g{d // 5}-{j}") for d in range(20) for j in range(1 + d // 5)] + [(d, f"own{d}-{j}") for d in range(22) for j in range(d % 7)] + [(None, "x"), (3, None)]
    docs, phrases = sorted({d for d, p in rows if d is not None and p}), sorted({p for d, p in rows if d is not None and p})
    a, want, r = np.array([[(d, p) in rows for p in phrases] for d in docs], float), {}, 0
    while len(want) < len(docs):
        left = [i for i, d in enumerate(docs) if d not in want]
        m = a[left][:, a[left].any(axis=0)]
        v = np.ones(m.shape[1])
        for _ in range(8):
            v = m.T @ (m @ v)
            v /= v.max()
        u = m @ v
        want |= {docs[i]: r for i, x in zip(left, u / u.max(), strict=True) if x > 1e-3}
        r += 1
    sizes, write = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: sizes.setdefault(name, df.count()) and None or write(df, name))
    got = graph.svd_clusters(spark.createDataFrame(rows, "doc_id long, phrase string")).collect()
    assert {x.doc_id: x.round for x in got} == want and len(got) == len(docs)
    assert sizes["linked"] == sum(1 + d // 5 for d in range(20))


def test_suppliers_are_linked_by_any_two_lines_of_an_order(spark, monkeypatch):
    lines = [(1, 1, 10), (1, 2, 20), (1, 4, 30), (1, 5, 10), (2, 7, 40), (2, 3, 50), (3, 1, 60), (None, 1, 70), (None, 2, 80), (4, 1, None), (4, 2, 90)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long")
    monkeypatch.setattr(queries, "table", lambda spark, d, name: rows)
    want = {(s, t) for o, m, s in lines for p, n, t in lines if o is not None and o == p and m < n and None not in (s, t) and s != t}
    got = [tuple(r) for r in queries._order_graph(spark, "").collect()]
    assert len(got) == len(want) and set(got) == want
    ids = sorted({i for edge in want for i in edge})
    assert {(ids[r.src], ids[r.dst]) for r in queries._supplier_sample(spark, "").collect()} == want
