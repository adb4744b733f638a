import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import coding, text
from glyphmill.operators import cluster, graph, lsh, metrics, templates, tfidf, timeseries
from glyphmill.operators.components import components
from glyphmill.operators.storage import fresh_path
from glyphmill.plans import queries
from glyphmill.sources import readers
from glyphmill.streaming import live


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first().out


def test_log_star_and_gamma_goldens(spark):
    xs = [0, 1, 2, 3, 4, 5, 8, 9, 16, 17, 2**29, 2**31, 2**39, 2**39 + 1]
    got = {r.x: (r.a, r.g) for r in spark.createDataFrame([(x,) for x in xs], "x long").select("x", coding.log_star(F.col("x")).alias("a"), coding.gamma(F.col("x")).alias("g")).collect()}
    assert [got[x][0] for x in xs[:10]] == [0, 1, 3, 5, 5, 7, 7, 9, 9, 11]
    assert all(got[x][0] == coding.log_star_int(x) for x in xs)
    assert (got[1][1], got[2][1], got[17][1], got[0][1]) == ("1", "010", "000010001", "1")


LINE = "Hello my name is Catalina|Hello my name is C|1,Hello my name is ,2,[A-Za-z].*"


def test_template_codec_golden():
    texts, parts = coding.parse_template(LINE)
    codec = coding.TemplateCodec()
    assert len(codec.template(parts)) == 358 and len(codec.encode(texts, parts)) == 488 and codec.cost_bytes(texts, parts) == 61
    assert codec.decode(codec.encode(texts, parts)) == (parts, [["Catalina"], ["C"]], texts)


@given(st.lists(st.text(st.characters(min_codepoint=1, max_codepoint=2000), max_size=20), max_size=4))
@settings(max_examples=50, deadline=None)
def test_codec_round_trip(fillings):
    codec = coding.TemplateCodec(offset=1, escape=True)
    texts = ["a.b" + f for f in fillings]
    parts = [(1, "a.b"), (2, "(?s:.*)")]
    assert codec.decode(codec.encode(texts, parts)) == (parts, [[f] for f in fillings], texts)


def test_cleaning_dialects(spark):
    assert one(spark, text.clean_ascii("t"), t="a1b <x>c</x> é d") == "ab c  d"
    assert one(spark, text.clean_ascii("t"), t="<a\rb>x") == "x"
    assert one(spark, text.clean_page("t"), t="<p>x&nbsp;y</p><br") == " xy r"
    assert one(spark, text.words_no_punctuation(F.col("t")), t="Don't stop,  NOW! ") == ["dont", "stop", "now"]
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(text.clean_ascii("t")).first()[0] == "" and df.select(text.words_nonspace(F.col("t"))).first()[0] == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 9])
def test_ngram_counts(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = spark.createDataFrame([(words,)], "w array<string>").select(text.ngrams(F.col("w"), 2, 4)).first()[0]
    assert len(got) == sum(max(0, n - k + 1) for k in (2, 3, 4))


def test_running_scores_golden(spark):
    tf = spark.createDataFrame([(0, 0, "a", 1), (0, 0, "b", 1), (1, 1, "a", 1), (1, 1, "c", 1), (2, 2, "a", 1), (2, 2, "b", 2)], "doc_id long, seq long, phrase string, tf long")
    stream = {(r.doc_id, r.phrase): r.score for r in tfidf.running_score(tfidf.running_frequency(tf)).collect()}
    assert stream == {(0, "a"): 0, (0, "b"): 0, (1, "a"): 0, (1, "c"): 0.693147, (2, "a"): 0, (2, "b"): 0.81093}
    normal = {(r.doc_id, r.phrase): r.score for r in tfidf.running_score(tf.join(tfidf.document_frequency(tf), "phrase")).collect()}
    assert normal[0, "a"] == -1.098612 and normal[0, "b"] == -0.693147 and normal[1, "a"] == -0.405465


def test_repeated_phrase_takes_places(spark):
    rows = spark.createDataFrame([(0, "b", 3, 2.0), (0, "a", 1, 1.0), (0, "z", 1, 0.5)], "doc_id long, phrase string, tf long, score double")
    assert [r.phrase for r in tfidf.top_running(rows, 4).orderBy("place").collect()] == ["b", "a"]
    assert [r.phrase for r in tfidf.top_running(rows, 3, dedupe=True).orderBy("place").collect()] == ["b", "a", "z"]


@pytest.mark.parametrize(("n", "sizes"), [(11, [6, 2, 2, 1]), (20, [6, *[2] * 7]), (25, [9, 3, 3, 3, 3, 3, 1]), (1, [1])])
def test_batch_sizes(spark, n, sizes):
    got = spark.range(n).groupBy(tfidf.batch_number(F.col("id"), n).alias("b")).count().orderBy("b").collect()
    assert [r["count"] for r in got] == sizes


def test_numbering_is_global(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v long").repartition(5)
    assert all(r.v == r.seq for r in tfidf.numbered(df, "v").collect())


@pytest.mark.parametrize("partitions", ["1", "8", "64"])
def test_components_of_chains_stars_and_rings(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(5000, 5000)]
        got = components(spark.createDataFrame(edges, "a long, b long")).groupBy("root").agg(F.min("node").alias("m"), F.count("*").alias("n")).collect()
        assert sorted((r.m, r.n) for r in got) == [(0, 301), (1000, 200), (2000, 7)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


CLIQUES = [(a, b) for g in (range(4), range(4, 8)) for a in g for b in g if a != b]


def test_conductance_golden(spark):
    edges = spark.createDataFrame(CLIQUES, "src long, dst long")
    sets = spark.createDataFrame([(n, v) for n in (1, 2, 3, 4) for v in range(n)], "set_id long, node long")
    got = {r.set_id: r.conductance for r in graph.conductance(edges, sets).collect()}
    assert got == {1: 2.0, 2: pytest.approx(1.333333333), 3: pytest.approx(0.666666667), 4: 0.0}


def test_singular_values_and_spokes(spark):
    edges = spark.createDataFrame(CLIQUES, "src long, dst long")
    sigma, u = graph.singular_vectors(edges, 3)
    assert [round(r.sigma, 6) for r in sigma.orderBy("axis").collect()] == [3.0, 3.0, 1.0]
    found = graph.spokes(edges, u).groupBy("axis").count().collect()
    assert all(r["count"] <= 2 for r in found)


def grown_spokes(edges, u, cutoff=1e-2, least=0.93):
    """By definition: conductance of all edges anew at each step, on the whole graph."""
    found = set()
    for axis in {a for a, _, _ in u}:
        score = {n: abs(x) for a, n, x in u if a == axis}
        seed = max(sorted(score), key=lambda v: score[v])
        spoke, done = {seed}, {seed}
        while near := {b for a, b in edges if a in spoke and b not in done and score.get(b, 0.0) > cutoff}:
            v = max(near, key=lambda n: (score[n], n))
            done.add(v)
            grown = spoke | {v}
            cut = sum((a in grown) != (b in grown) for a, b in edges)
            volume = sum(a in grown for a, _ in edges)
            small = min(volume, len(edges) - volume)
            if not small or cut / small < least:
                break
            spoke = grown
        found |= {(axis, n) for n in spoke}
    return found


def test_spokes_equal_brute_force(spark):
    blocks = graph.densify(graph.dense_blocks(spark).where("src % 6 = 0 and dst % 6 = 0"))[0].cache()
    for edges in (blocks, queries._supplier_sample(spark, "/root/testdata/sf0.01")):
        u = spark.createDataFrame(graph.singular_vectors(edges, 9)[1].collect()).selectExpr("node", "int(axis) axis", "u")
        for cutoff in (1e-2, 0.08, 2.0):
            want = grown_spokes({tuple(r) for r in edges.collect()}, [(r.axis, r.node, r.u) for r in u.collect()], cutoff)
            assert {tuple(r) for r in graph.spokes(edges, u, cutoff=cutoff).collect()} == want


def test_spoke_queries_read_the_table(spark):
    sf = "/root/testdata/sf0.001"
    edges = queries._supplier_sample(spark, sf)
    u = [(r.axis, r.node, r.u) for r in graph.singular_vectors(edges, 9)[1].collect()]
    assert {tuple(r) for r in queries.spokes(spark, sf).collect()} == grown_spokes({tuple(r) for r in edges.collect()}, u)
    pairs = queries.spoke_pairs(spark, sf).collect()
    assert pairs and max(r.points for r in pairs) <= edges.selectExpr("max(greatest(src, dst)) + 1 n").first().n
    assert {r.axis for r in queries.spoke_axes(spark, sf).collect()} <= {r.x_axis for r in pairs} | {r.y_axis for r in pairs}


def test_svd_clusters_place_every_document(spark):
    sizes = [60, 12, 3, 1]  # separate groups of documents with the same phrases
    rows = [(100 * g + i, f"p{g}-{j}") for g, n in enumerate(sizes) for i in range(n) for j in range(n)]
    got = {r.doc_id: r.round for r in graph.svd_clusters(spark.createDataFrame(rows, "doc_id long, phrase string")).collect()}
    assert got == {doc: doc // 100 for doc, _ in rows}


def test_bigram_svd_clusters_place_every_turn(spark):
    sf = "/root/testdata/sf0.001"
    want = sorted({r.doc_id for r in queries.boundary_bigrams(spark, sf).collect()})
    got = queries.bigram_svd_clusters(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == want


def test_cluster_report_has_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    n = {r.doc_id: r.n for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "length(text) n").collect()}
    got = queries.cluster_report(spark, sf).selectExpr("cluster", "length(latex) n").collect()
    assert max(n[r.cluster] for r in got) > 80 and all(r.n > n[r.cluster] for r in got)


def test_entropy_golden(spark):
    v = [0, 1e-4, 1e-3, 1e-2, 1e-1]
    points = spark.createDataFrame([(1, float(x), float(y)) for x in v for y in v], "g int, x double, y double")
    assert graph.gaussian_entropy(points, "g").first().entropy == pytest.approx(3.60609598, abs=1e-5)
    flat = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0)], "g int, x double, y double")
    assert graph.gaussian_entropy(flat, "g").first().entropy == math.inf
    grid = spark.createDataFrame([(x, y) for x in (-0.02, -0.001, 0.0, 0.5) for y in (-0.02, 0.001, 0.5)], "x double, y double")
    assert graph.off_axes(grid).count() == 4


def scores(spark, t, p):
    rows = spark.createDataFrame([("v", str(a), str(b)) for a, b in zip(t, p, strict=True)], "view string, t string, p string")
    return metrics.clustering_scores(rows).first()


def test_cluster_scores(spark):
    same = scores(spark, [1, 1, 2, 2], [5, 5, 7, 7])
    assert (same.ari, same.homogeneity, same.nmi) == (1, 1, 1)
    one_cluster = scores(spark, [1, 1, 2, 2], [1, 1, 1, 1])
    assert (one_cluster.ari, one_cluster.homogeneity, one_cluster.nmi) == (0, 0, 0)
    a, b = scores(spark, [1, 1, 2, 3, 3], [1, 2, 2, 3, 3]), scores(spark, [1, 2, 2, 3, 3], [1, 1, 2, 3, 3])
    assert a.ari == b.ari and a.nmi == b.nmi


def test_merged_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 4, 5), (1, 2, 2), (1, 8, 9), (2, 1, 1)], "g int, lo int, hi int")
    assert sorted((r.g, r.lo, r.hi, r.merged) for r in graph.merged_intervals(rows, "g").collect()) == [(1, 0, 5, 3), (1, 8, 9, 1), (2, 1, 1, 1)]


def test_alignment_projects_to_the_sequence():
    rng = np.random.default_rng(1)
    g = templates.WordGraph.chain(list("abcdefgh"))
    for _ in range(60):
        words = np.array([x for x in "abcdefgh" if rng.random() > 0.2] + list(rng.choice(list("xyz"), rng.integers(0, 3))), dtype=object)
        if not len(words):
            continue
        path = templates.align(words, g)
        assert [j for j, _ in path if j is not None] == list(range(len(words)))
        nodes = [v for _, v in path if v is not None]
        assert all(b in g.out[a] for a, b in zip(nodes, nodes[1:], strict=False))
        templates.merge(g, words, path)
        place = {v: i for i, v in enumerate(g.order)}
        assert all(place[a] < place[b] for a in range(len(g.words)) for b in g.out[a])


def test_consensus_is_the_heaviest_supported_path():
    g = templates.WordGraph.chain(list("abcd"), 3)
    templates.merge(g, *(lambda w: (w, templates.align(w, g)))(np.array(list("abxd"), dtype=object)))
    assert templates.consensus(g, 0).words == list("abcd") and templates.consensus(g, 1).words == list("abcd")
    assert templates.consensus(g, 3).words == ["a", "b"] and templates.consensus(g, 4).words == []


def test_a_slot_is_kept_where_it_saves_bits():
    frame = list("abcdefghijklmnop")
    docs = {i: np.array(frame[:8] + [f"{i}{j}" for j in range(i % 3 + 1)] + frame[8:], dtype=object) for i in range(6)}
    found = templates.Cluster(docs, dict.fromkeys(docs, 2), 12)
    chain = templates.WordGraph.chain(frame)
    plain = found.total(list(docs), chain)
    found.mark_slots(list(docs), chain)
    assert chain.slots == {7} and not chain.start_slot and found.total(list(docs), chain) < plain
    runs = templates.strange_runs(docs[2], chain, templates.align(docs[2], chain))
    assert runs == {7: 3} and templates.strange_runs(np.array(["x", "a"], dtype=object), templates.WordGraph.chain(["a"]), [(0, None), (1, 0)]) == {-1: 1}
    chain = templates.WordGraph.chain(frame * 40)  # a place among so many words costs more than one odd word is worth
    long = {0: np.array(frame * 40, dtype=object), 1: np.array([*(frame * 40)[:3], "odd", *(frame * 40)[3:]], dtype=object)}
    other = templates.Cluster(long, dict.fromkeys(long, 1), 2)
    least = min(other.total(list(long), chain), other.total(list(long), templates.WordGraph(**{**vars(chain), "slots": {2}})))
    other.mark_slots(list(long), chain)
    assert other.total(list(long), chain) == least


def test_copies_are_aligned_once_and_cost_as_often_as_they_stand(spark):
    docs = [(i, "the same words in every one of these texts again") for i in range(40)] + [(90, "the same words in some one of these texts again")]
    members = spark.createDataFrame([(0, i) for i, _ in docs], "cluster long, doc_id long")
    words = templates.prepared(members, spark.createDataFrame(docs, "doc_id long, text string"))
    assert templates.distinct_texts(words).count() == 2
    rows = templates.mine_templates(words).collect()
    assert sorted(r.doc_id for r in rows) == [*range(40), 90] and {r.template_no for r in rows} == {1} and {r.docs for r in rows} == {41}
    alone = templates.Cluster({0: np.array(docs[0][1].split(), dtype=object)}, {0: 40}, 4).mine()
    assert alone[1] == 40 * (templates.log_star(10) + 10 * 4 + 1) and alone[2] < alone[1]


def test_consensus_is_the_best_of_all_supports():
    """Against each support one by one, and the cost of mining against its description written out."""
    rng = random.Random(8)
    for _ in range(12):
        frame = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(4, 12))]
        docs = {d: np.array([w if rng.random() < 0.8 else f"x{rng.randint(0, 3)}" for w in frame if rng.random() < 0.9] or ["w"], dtype=object) for d in range(7)}
        copies = {d: rng.randint(1, 4) for d in docs}
        cluster = templates.Cluster(docs, copies, 6)
        members, graph = cluster.group(sorted(docs))
        every = [templates.consensus(graph, s) for s in range(cluster.count(members))]
        least = min((cluster.total(members, c) for c in every if c.words), default=None)
        best = cluster.best_consensus(members, graph)
        assert (cluster.total(members, best) if best.words else None) == least
        found, initial, final = cluster.mine()
        assert initial == sum(n * (cluster.alone(d) + 1) for d, n in copies.items()) and final <= initial and (final < initial) == bool(found)


def test_complete_clusters_against_all_pairs(spark):
    rng = random.Random(6)
    held = {(0, d, p) for d, ps in enumerate(("ab", "bc", "ca")) for p in ps}  # linked by three phrases, none of them common to all
    held |= {(1, 10 + d, p) for d, ps in enumerate(("x", "x", "xy", "y")) for p in ps} | {(2, 20 + d, "z") for d in range(5)}
    held |= {(c, 100 * c + d, p) for c in range(3, 40) for d in range(rng.choice((3, 4, 6))) for p in rng.sample("abcdef", rng.choice((2, 3, 4)))}
    plane = [(0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5)]  # seven points, any two on a line
    held |= {(50, 5000 + d, f"l{k}") for k, line in enumerate(plane) for d in line}
    clusters = {c: {d for x, d, _ in held if x == c} for c, _, _ in held}
    of = {d: {p for _, x, p in held if x == d} for _, d, _ in held}
    want = {c: all(of[a] & of[b] for a in ds for b in ds) for c, ds in clusters.items()}
    edges = spark.createDataFrame([(d, p) for _, d, p in held], "doc_id long, phrase string")
    found = spark.createDataFrame([(d, c, len(ds)) for c, ds in clusters.items() for d in ds], "doc_id long, cluster long, size long")
    assert {tuple(r) for r in cluster.complete_clusters(edges, found).collect()} == set(want.items())
    assert want[0] and want[50] and want[2] and not want[1] and 5 < sum(want.values()) < len(want) - 5


def test_templates_of_near_copies(spark):
    frame = "the quick {} fox jumps over the lazy dog and runs through the dark green forest to its den".split()
    docs = [(i, " ".join(w.format(c) for w in frame)) for i, c in enumerate(["brown", "red", "grey", "old", "young", "tired"])] + [(9, "nothing like the others at all here my friend"), (10, "")]
    members = spark.createDataFrame([(0, i) for i, _ in docs], "cluster long, doc_id long")
    mined = templates.mine_templates(templates.prepared(members, spark.createDataFrame(docs, "doc_id long, text string")))
    rows = {r.doc_id: r for r in mined.collect()}
    assert 10 not in rows and rows[9].template_no == 0 and all(rows[i].template_no == 1 for i in range(6))
    rate = templates.compression_rates(mined).first()
    assert 0 < rate.rate <= 1 and rate.docs == 7
    assert "<span" in templates.to_html(mined).first().html


def test_chain_clusters(spark):
    top = spark.createDataFrame([(0, 1, "p"), (0, 2, "q"), (1, 1, "p"), (1, 2, "q"), (2, 1, "p"), (2, 2, "r"), (3, 1, "z")], "doc_id long, rank int, phrase string")
    got = {r.doc_id: (r.cluster_id, r.kind, list(r.predecessors)) for r in lsh.chain_clusters(top, buckets=100_000).collect()}
    assert got[0] == (0, "chain", []) and got[1] == (0, "duplicate", []) and got[3][1] == "chain" and got[2][:2] in ((0, "duplicate"), (1, "chain"))


def test_series(spark):
    series = spark.createDataFrame([("a", 10), ("b", 50), ("c", 55)], "bucket string, n long")
    assert [r.bucket for r in timeseries.jumps(series).collect()] == ["b"]
    assert [(r.n, r.next) for r in timeseries.lag_pairs(series).orderBy("n").collect()] == [(10, 50), (50, 55)]
    assert timeseries.spectrum(series).where("k = 0").first().re == 115
    d = spark.createDataFrame([("Sun 11 Dec 2016 03:05 PM",), ("junk",)], "s string").select(timeseries.posting_date(F.col("s")).alias("t")).collect()
    assert str(d[0].t) == "2016-12-11 15:05:00" and d[1].t is None


def test_roles_and_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text('ad_id,u_Description,PostingDate\n1,"a, b\nc",5\n2,x\ry,6\n')
    got = readers.read_documents(spark, str(tmp_path / "d.csv")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, "a, b\nc"), (2, "x\ry")]
    with pytest.raises(ValueError):
        readers.resolve_roles(spark.range(1).withColumnRenamed("id", "nothing"))
    (tmp_path / "e.txt").write_text("1 2\n2 3\n1 2\nbad\n")
    assert sorted(map(tuple, readers.read_edges(spark, str(tmp_path / "e.txt")).collect())) == [(1, 2), (2, 3)]
    (tmp_path / "t.txt").write_text(LINE + "\n")
    row = readers.read_templates(spark, str(tmp_path / "t.txt")).first()
    assert list(row.texts) == LINE.split("|")[:2] and [tuple(p) for p in row.parts] == [(1, "Hello my name is "), (2, "[A-Za-z].*")]
    (tmp_path / "l.txt").write_text("a b\n\nc\n")
    assert [list(r.words) for r in readers.read_lines(spark, str(tmp_path / "l.txt")).orderBy("doc_id").collect()] == [["a", "b"], [], ["c"]]
    phones = spark.createDataFrame([("1;2; ",), (None,)], "p string")
    assert [list(r.p) for r in readers.multi_valued(phones, "p", "#").collect()] == [["#1", "#2"], []]
    labelled = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, label long")
    readers.write_labels(labelled, str(tmp_path / "out"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "out/labelled")).count() == 1


def test_csv_round_trip_and_empty_tables(spark, tmp_path):
    rows = [(1, 'say "so", then'), (2, " spaces "), (3, "two\nlines"), (4, "carriage\rreturn"), (5, ""), (6, None), (7, "back\\slash"), (None, "no id"), (1, "again")]
    kind = "doc_id long, text string, label long"
    labelled = spark.createDataFrame([(*r, 1 if i % 2 else None) for i, r in enumerate(rows)], kind)
    readers.write_labels(labelled, str(tmp_path / "out"))
    back = readers.read_documents(spark, str(tmp_path / "out/full"), schema=kind)
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, labelled.collect())))
    assert readers.read_documents(spark, str(tmp_path / "out/labelled"), schema=kind).count() == 4
    readers.write_labels(labelled.limit(0), str(tmp_path / "none"))
    assert readers.read_documents(spark, str(tmp_path / "none/full"), schema=kind).count() == 0


def test_lines_of_many_files_keep_their_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("short\n")
    (tmp_path / "b.txt").write_text("".join(f"line {i} of the longer file\n" for i in range(50)))
    (tmp_path / "c.txt").write_text("last\n")
    got = [r.words for r in readers.read_lines(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got[0] == ["short"] and [w[1] for w in got[1:51]] == [str(i) for i in range(50)] and got[51] == ["last"]


def test_stored_graph_and_log(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    readers.write_graph(edges, str(tmp_path / "g"), spark.range(9, 10).toDF("node"))
    nodes, back = readers.read_graph(spark, str(tmp_path / "g"))
    assert sorted(r.node for r in nodes.collect()) == [1, 2, 3, 9] and sorted(map(tuple, back.collect())) == [(1, 2), (2, 3)]
    for score in (0.5, 0.75):
        readers.append_log(spark.createDataFrame([(score,)], "nmi double"), str(tmp_path / "log"), run="sweep")
    assert sorted((r.run, r.nmi) for r in spark.read.json(str(tmp_path / "log")).collect()) == [("sweep", 0.5), ("sweep", 0.75)]


def test_local_alignment_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = (list(rng.choice(list("abcd"), rng.integers(1, 12))) for _ in range(2))
        score = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                hit = score[i - 1, j - 1] + (templates.MATCH if a[i - 1] == b[j - 1] else templates.MISMATCH)
                score[i, j] = max(0, hit, score[i - 1, j] + templates.GAP, score[i, j - 1] + templates.GAP)
        path = templates.align(np.array(b, dtype=object), templates.WordGraph.chain(a), local=True)
        worth = sum(templates.GAP if j is None or v is None else templates.MATCH if a[v] == b[j] else templates.MISMATCH for j, v in path)
        assert worth == score.max()
        for run in ([j for j, _ in path if j is not None], [v for _, v in path if v is not None]):
            assert run == list(range(run[0], run[0] + len(run))) if run else not path
    assert templates.align(np.array([], dtype=object), templates.WordGraph.chain(["a"]), local=True) == []


def test_documents_of_templates_are_split_and_readable(spark):
    import io
    import zipfile
    from xml.etree import ElementTree

    row = lambda d: (1, d, 1, [{"code": 0, "word": "a<b"}, {"code": 1, "word": "&\x01"}])
    mined = spark.createDataFrame([row(d) for d in range(5)] + [(1, 9, 0, [])], "cluster long, doc_id long, template_no int, codes array<struct<code:int,word:string>>")
    got = templates.to_docx(mined, per_file=2).orderBy("part").collect()
    texts = []
    for r in got:
        xml = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(r.docx)).read("word/document.xml"))
        texts.append(["".join(p.itertext()) for p in xml.iter() if p.tag.endswith("}p")])
    assert [len(t) for t in texts] == [2, 2, 1] and {x for t in texts for x in t} == {"a<b & "}


def test_chain_components_equal_a_union_of_sets(spark):
    rows = [(10, 0, "chain", []), (11, 1, "chain", [0]), (12, 2, "chain", []), (13, 1, "duplicate", []), (14, 3, "chain", [2, 1]), (15, 4, "chain", []), (16, 4, "duplicate", [])]
    kind = "doc_id long, cluster_id long, kind string, predecessors array<long>"
    got = {r.doc_id: r.component for r in lsh.chain_components(spark.createDataFrame(rows, kind)).collect()}
    assert got == {10: 10, 11: 10, 12: 10, 13: 10, 14: 10, 15: 15, 16: 15}
    assert lsh.chain_components(spark.createDataFrame([], kind)).count() == 0


def test_progress_is_logged(spark, tmp_path):
    import json
    import time

    lines: list[str] = []
    log = live.ProgressLog(lines.append)
    spark.streams.addListener(log)
    try:
        spark.createDataFrame([(1,), (2,)], "x long").write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("x long").parquet(str(tmp_path / "in"))
        stream.writeStream.queryName("logged").foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        until = time.time() + 20
        while time.time() < until and not any(json.loads(x).get("rows") == 2 for x in list(lines)):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert any(json.loads(x).get("rows") == 2 and json.loads(x)["name"] == "logged" for x in lines)


def test_live_frequency_equals_replay(spark, tmp_path):
    rows = spark.createDataFrame([(d, d, p, 1) for d in range(6) for p in ("a", "b", "c")[: 1 + d % 3]], "doc_id long, seq long, phrase string, tf long")
    for i in range(3):
        rows.where(f"seq div 2 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = live.arriving_frequency(stream).writeStream.format("memory").queryName("live_df").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    seen = {}
    for r in spark.table("live_df").collect():
        seen.setdefault(r.phrase, []).append(r.df)
    assert {p: sorted(v) for p, v in seen.items()} == {"a": [1, 2, 3, 4, 5, 6], "b": [1, 2, 3, 4], "c": [1, 2]}


def test_growing_clusters(spark):
    edges = [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "a"), (4, "b"), (9, "z")]
    grown = live.GrowingClusters(spark.createDataFrame([], "doc_id long, cluster long"), spark.createDataFrame([], "doc_id long, phrase string"))
    for part in (edges[:4], edges[4:]):
        grown.add(spark.createDataFrame(part, "doc_id long, phrase string"))
    assert {r.doc_id: r.cluster for r in grown.labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9}
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    links = cluster.document_links(cluster.shared_edges(spark.createDataFrame(edges, "doc_id long, phrase string")))
    assert {r.doc_id: r.cluster for r in cluster.clusters(docs, links).collect() if r.size > 1} == {i: 0 for i in range(5)}


def test_shared_folder_is_the_named_one(spark):
    assert fresh_path(spark, "x").startswith(("file://", "/"))


def test_registry_has_oracles_for_registered_names():
    from glyphmill.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.oracle_sql()) > 60
