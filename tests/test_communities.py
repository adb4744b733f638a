import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import communities
from glyphmill.operators.ranges import running_sum


def graph(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long" + (", w long" if edges and len(edges[0]) == 3 else ""))


def weights(edges):
    out = defaultdict(float)
    for a, b, *w in edges:
        if a != b:
            key = min(a, b), max(a, b)
            out[key] = out[key] + w[0] if w else 1.0
    return out


def q(links, part):
    """Modularity from its definition."""
    total, strength, inner = 2 * sum(links.values()), defaultdict(float), 0.0
    for (a, b), w in links.items():
        strength[part[a]] += w
        strength[part[b]] += w
        inner += w * (part[a] == part[b])
    return 2 * inner / total - sum((d / total) ** 2 for d in strength.values())


def plain(links):
    """The same rounds in dicts: (community of each node, Q by round)."""
    nodes = sorted({n for p in links for n in p})
    at, total, number, history = {n: n for n in nodes}, 2 * sum(links.values()), 0, []
    draw = lambda n: zlib.crc32(f"{number}:{n}".encode())
    while True:
        history.append(q(links, at))
        d, w = defaultdict(float), defaultdict(float)
        for (a, b), x in links.items():
            d[at[a]] += x
            d[at[b]] += x
            if at[a] != at[b]:
                w[at[a], at[b]] += x
                w[at[b], at[a]] += x
        gain = {(u, v): x / total - (d[u] / total) * (d[v] / total) for (u, v), x in w.items()}
        best = {}
        for (u, v), g in gain.items():
            if g > 0 and (u not in best or (g, draw(v), v) > best[u]):
                best[u] = (g, draw(v), v)
        if not best:
            break
        votes = Counter(v for _, _, v in best.values())
        takes = {}
        for u, (_, _, v) in best.items():
            takes[u] = (votes[u], d[u], -u) > (votes[v], d[v], -v) if best[v][2] == u else draw(u) % 2 == 0
        joining = defaultdict(list)
        for u, (g, _, v) in sorted(best.items(), key=lambda x: (-x[1][0], x[0])):
            if not takes[u] and takes[v]:
                joining[v].append((u, g))
        to = {}
        for v, us in joining.items():
            sums = []
            for i, (u, g) in enumerate(us):
                more = sum(w.get((u, x), 0.0) / total - (d[u] / total) * (d[x] / total) for x, _ in us[:i])
                sums.append((sums[-1] if sums else 0.0) + g + more)
            last = max(range(len(sums)), key=lambda i: (round(sums[i] * 1e12), i))
            to |= {u: v for u, _ in us[: last + 1]}
        at, number = {n: to.get(c, c) for n, c in at.items()}, number + 1
    name = {c: min(n for n in nodes if at[n] == c) for c in set(at.values())}
    return {n: name[c] for n, c in at.items()}, history


def cliques(k, n):
    """k cliques of n nodes, one edge from each to the next."""
    return [(i * n + a, i * n + b) for i in range(k) for a in range(n) for b in range(a)] + [(i * n, (i + 1) * n + 1) for i in range(k - 1)]


def test_equals_plain_rounds_and_never_falls(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 25), rng.randint(0, 25), rng.randint(1, 4)) for _ in range(60)]
    history = []
    found = {r.node: r.community for r in communities.greedy_communities(graph(spark, edges), weight="w", history=history).collect()}
    want, steps = plain(weights(edges))
    assert found == want
    assert history == pytest.approx(steps) and all(a < b for a, b in itertools.pairwise(history)) and len(history) > 2
    row = communities.open_merges(graph(spark, edges), spark.createDataFrame(list(found.items()), "node long, community long"), weight="w").first()
    assert row.open_pairs == 0 and row.nodes == len(found) and row.modularity == pytest.approx(history[-1])


def test_finds_cliques(spark):
    found = communities.greedy_communities(graph(spark, cliques(2, 6)))
    assert {(r.node, r.community, r.size) for r in found.collect()} == {(i, i // 6 * 6, 6) for i in range(12)}


def test_small_graphs_against_every_partition():
    """The rounds in dicts, which Spark's equal: near the best of all partitions, and the best on clear-cut graphs."""

    def partitions(nodes):
        if not nodes:
            yield {}
            return
        for rest in partitions(nodes[1:]):
            for c in {*rest.values(), nodes[0]}:
                yield rest | {nodes[0]: c}

    rng = random.Random(5)
    for _ in range(25):
        links = weights([(a, b) for a in range(7) for b in range(a) if rng.random() < 0.4] or [(0, 1)])
        part, history = plain(links)
        best = max(q(links, p) for p in partitions(sorted({n for e in links for n in e})))
        assert best - 0.2 <= history[-1] <= best + 1e-12
    links = weights(cliques(2, 4))
    assert q(links, plain(links)[0]) == pytest.approx(max(q(links, p) for p in partitions(list(range(8)))))


def test_stars_paths_and_odd_graphs(spark):
    """A star of many leaves and a long path take few rounds; loops, repeats, nulls and no edges at all."""
    star, path = [(0, i) for i in range(1, 40)], [(1000 + i, 1001 + i) for i in range(16)]
    for edges in (star, path):
        history = []
        found = communities.greedy_communities(graph(spark, edges), history=history).collect()
        assert {r.node: r.community for r in found} == plain(weights(edges))[0] and len(history) <= 12
    odd = graph(spark, [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None)]).withColumn("a", F.lit("clash")).withColumn("w", F.lit("clash"))
    assert {tuple(r) for r in communities.greedy_communities(odd).collect()} == {(1, 1, 2), (2, 1, 2)}
    assert communities.greedy_communities(odd.limit(0)).collect() == []


def test_running_sum(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", i, rng.randint(-3, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, x long").repartition(5)
    found = {(r.k, r.i): r.s for r in running_sum(df, ["k"], [F.desc("i")], "x", "s").collect()}
    sums, want = defaultdict(int), {}
    for k, i, x in sorted(rows, key=lambda r: -r[1]):
        want[k, i] = sums[k]
        sums[k] += x
    assert found == want
