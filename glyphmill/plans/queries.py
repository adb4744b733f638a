"""Queries over the driver's tables: one function for each registered name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import coding, text
from glyphmill.operators import buckets, cluster, communities, distinctive, graph, lsh, metrics, running, templates, tfidf, timeseries
from glyphmill.operators.components import components
from glyphmill.operators.reuse import reused
from glyphmill.operators.storage import fresh_path, materialize
from glyphmill.sources import readers
from glyphmill.streaming import live

T = DataFrame
S = SparkSession


def table(spark: S, d: str, name: str) -> T:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: S, d: str) -> T:
    """doc_id and text, with all rows of an id in one partition."""
    return tfidf.located(table(spark, d, "documents").select("doc_id", "text"))


# --- text


def clean_text_ascii(spark: S, d: str) -> T:
    return table(spark, d, "documents").select("doc_id", text.clean_ascii("text").alias("cleaned"))


def clean_text_html(spark: S, d: str) -> T:
    return table(spark, d, "pages").select("page_id", text.clean_page("html").alias("cleaned"))


def title_text(spark: S, d: str) -> T:
    return table(spark, d, "documents").select("doc_id", text.with_title("source", "text").alias("joined"))


def tokens_word2(spark: S, d: str) -> T:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.words2(text.clean_ascii("text"))).alias("pos", "token"))


def tokens_ws(spark: S, d: str) -> T:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.words_nonspace(F.col("text"))).alias("pos", "token"))


def tokens_nopunct(spark: S, d: str) -> T:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.words_no_punctuation(F.col("text"))).alias("pos", "token"))


def token_counts_by_tokenizer(spark: S, d: str) -> T:
    c = text.clean_ascii("text")
    return table(spark, d, "documents").select("doc_id", F.size(text.words_and_marks(c)).cast("long").alias("n_marks"), F.size(text.words2(c, False)).cast("long").alias("n_words"))


def ngram_counts_3_5(spark: S, d: str) -> T:
    docs = _documents(spark, d).select("doc_id", text.words_nonspace(F.col("text")).alias("w"))
    return tfidf.grams(docs, 3, 5).groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("grams"), F.countDistinct("phrase").alias("distinct_grams"))


def stopword_bigrams(spark: S, d: str) -> T:
    docs = _documents(spark, d).select("doc_id", text.without_stop_words(text.words2(text.clean_ascii("text"), False)).alias("w"))
    return tfidf.term_frequency(tfidf.grams(docs, 2, 2)).where("tf > 1")


def boundary_bigrams(spark: S, d: str) -> T:
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    docs = tfidf.located(turns).select("doc_id", text.with_bounds(text.words_nonspace(F.col("text"))).alias("w"))
    return tfidf.grams(docs, 2, 2).select("doc_id", "phrase").distinct()


def kth_occurrence_pairs(spark: S, d: str) -> T:
    """Tokens of a turn and of the next turn, paired by their number of occurrence."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.words_nonspace(F.col("text"))).alias("pos", "token"))
    w = Window.partitionBy("conv_id", "turn", "token").orderBy("pos")
    marked = turns.withColumn("k", F.row_number().over(w))
    a = marked.select("conv_id", "turn", "token", "k", F.col("pos").alias("pos_a"))
    b = marked.select("conv_id", (F.col("turn") - 1).alias("turn"), "token", "k", F.col("pos").alias("pos_b"))
    return a.join(b, ["conv_id", "turn", "token", "k"])


# --- phrase weights and clusters


def doc_freq_static(spark: S, d: str) -> T:
    return distinctive.shared(table(spark, d, "documents"), text.clean_page("text"), low=3, high=5)


def vocab_pruned(spark: S, d: str) -> T:
    docs = _documents(spark, d).select("doc_id", text.words2(text.clean_ascii("text")).alias("w"))
    tf = tfidf.term_frequency(tfidf.phrases(docs, F.col("w")))
    return tfidf.pruned_vocabulary(tfidf.document_frequency(tf), F.lit(table(spark, d, "documents").count()))


def l2_norms(spark: S, d: str) -> T:
    docs = _documents(spark, d).select("doc_id", text.words2(text.clean_ascii("text")).alias("w"))
    tf = tfidf.term_frequency(tfidf.phrases(docs, F.col("w")))
    weighted = tfidf.static_weights(tf, tfidf.document_frequency(tf), table(spark, d, "documents").count(), sublinear=False)
    return weighted.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


def coarse_top_phrases(spark: S, d: str) -> T:
    docs = table(spark, d, "documents")
    n = docs.count()
    found = distinctive.candidates(docs, text.clean_page("text"), n, k=10, low=3, high=5)
    return tfidf.top_phrases(tfidf.weighed(found, n), 10).select("doc_id", "rank", "phrase", "weight")


def _coarse(spark: S, d: str) -> T:
    top = materialize(coarse_top_phrases(spark, d), "top-phrases")
    return materialize(cluster.clusters(table(spark, d, "documents"), cluster.document_links(cluster.shared_edges(top))), "coarse")


def coarse_edges(spark: S, d: str) -> T:
    return cluster.shared_edges(coarse_top_phrases(spark, d))


def coarse_clusters(spark: S, d: str) -> T:
    return _coarse(spark, d)


def coarse_cluster_sizes(spark: S, d: str) -> T:
    return _coarse(spark, d).where("size >= 2").groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"))


def coarse_labels(spark: S, d: str) -> T:
    return cluster.labels(_coarse(spark, d), 2).dropna(subset=["label"])


def cluster_dump(spark: S, d: str) -> T:
    return cluster.best_first(_coarse(spark, d), table(spark, d, "documents")).select("cluster", "size", "doc_id", "text")


def component_stats(spark: S, d: str) -> T:
    sizes = _coarse(spark, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"))
    return sizes.groupBy("docs").agg(F.count(F.lit(1)).alias("components"))


def _packed_grams(spark: S, d: str) -> running.Packed:
    """5-grams of the documents, in order of doc_id."""
    return running.packed(table(spark, d, "documents").select("doc_id", "text"), text.words2(text.clean_ascii("text")), 5)


def _ranked(grams: running.Packed, mode: str, k: int) -> T:
    rows = running.frequencies(grams, mode, k, running.batches)
    return tfidf.top_running(tfidf.running_score(rows), k).select("doc_id", "place", "phrase", "tf", "df", "score")


def _running(spark: S, d: str, mode: str) -> T:
    grams = _packed_grams(spark, d)
    found = _ranked(grams, mode, 5)
    grams.discard()
    return found


def running_tfidf_normal(spark: S, d: str) -> T:
    return _running(spark, d, "normal")


def running_tfidf_stream(spark: S, d: str) -> T:
    return _running(spark, d, "stream")


def running_tfidf_batch(spark: S, d: str) -> T:
    return _running(spark, d, "batch")


def stream_df_replay(spark: S, d: str) -> T:
    grams = _packed_grams(spark, d)
    found = running.frequencies(grams, "stream").select("doc_id", "phrase", "tf", "df")
    grams.discard()
    return found


def _running_clusters(spark: S, d: str, ranked: T) -> T:
    top = materialize(ranked.select("doc_id", "phrase"), "running-top")
    return cluster.clusters(table(spark, d, "documents"), cluster.document_links(cluster.shared_edges(top)))


def running_clusters_stream(spark: S, d: str) -> T:
    return cluster.labels(_running_clusters(spark, d, _running(spark, d, "stream")), 2).dropna(subset=["label"])


def _truth(spark: S, d: str) -> T:
    """Groups of exact copies of at least two documents as true labels."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("t"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(groups, "h", "left").select("doc_id", F.col("t").alias("truth"))


def mode_comparison(spark: S, d: str) -> T:
    truth, grams, out = materialize(_truth(spark, d), "truth"), _packed_grams(spark, d), None
    for mode in running.MODES:
        found = cluster.labels(_running_clusters(spark, d, _ranked(grams, mode, 5)), 2).join(truth, "doc_id")
        one = metrics.clustering_scores(metrics.noise_views(found, "truth", "label")).withColumn("mode", F.lit(mode))
        out = one if out is None else out.union(one)
    grams.discard()
    return out


def num_phrases_sweep(spark: S, d: str) -> T:
    """Clusters of at least two documents for the best 1 to 10 phrases; phrases are ranked once."""
    grams = _packed_grams(spark, d)
    top = materialize(_ranked(grams, "stream", 10), "sweep")
    grams.discard()
    out = None
    for k in range(1, 11):
        links = cluster.document_links(cluster.shared_edges(top.where(F.col("place") <= k)))
        sizes = components(links).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        one = sizes.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("docs"))
        out = one if out is None else out.union(one)
    return out


def phrase_prefix_by_length(spark: S, d: str) -> T:
    docs = table(spark, d, "documents").select("doc_id", text.clean_ascii("text").alias("c"))
    tokens = docs.select("doc_id", F.size(text.words_and_marks(F.col("c"))).alias("n_tokens"))
    n = docs.count()
    words = F.array_join(text.without_stop_words(text.words2(F.col("c"), False)), " ")
    found = distinctive.filling(docs, words, n, F.size(text.words_and_marks(F.col("c"))))
    weighted = tfidf.weighed(found, n, sublinear=False).withColumn("weight", F.round("weight", 9))
    return tfidf.prefix_by_length(weighted, tokens).withColumn("rank", F.col("rank").cast("long"))


def batch_sizes(spark: S, d: str) -> T:
    docs = table(spark, d, "documents").select("doc_id")
    return tfidf.numbered(docs, "doc_id").groupBy(tfidf.batch_number(F.col("seq"), docs.count()).alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def exact_copy_clusters(spark: S, d: str) -> T:
    return _truth(spark, d).dropna(subset=["truth"])


# --- scores


def _labelled(spark: S, d: str) -> T:
    """doc_id, cluster, size and label (toxic; 0 where unlabelled)."""
    found = _coarse(spark, d)
    return found.join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left").select("doc_id", "cluster", "size", F.coalesce(1 - F.col("quality"), F.lit(0)).alias("label"))


def label_propagation(spark: S, d: str) -> T:
    return cluster.propagate_labels(_labelled(spark, d).where("size >= 2"))


def confusion_matrix(spark: S, d: str) -> T:
    return metrics.confusion(_labelled(spark, d).withColumn("pred", F.when(F.col("size") >= 2, 1).otherwise(0)), "label", "pred")


def label_rewrite(spark: S, d: str) -> T:
    rows = table(spark, d, "labels")
    flagged = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return rows.select("doc_id", flagged.alias("is_flagged"), F.when(flagged == 1, F.col("doc_id")).otherwise(F.lit(-1)).alias("flag_id"))


def clustering_scores(spark: S, d: str) -> T:
    found = cluster.labels(_coarse(spark, d), 2).join(_truth(spark, d), "doc_id")
    return metrics.clustering_scores(metrics.noise_views(found, "truth", "label"))


def precision_curve(spark: S, d: str) -> T:
    per = _labelled(spark, d).where("size >= 2").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("label").alias("hits"))
    return metrics.precision_curve(per, F.desc("size"), "cluster")


def precision_at_compression(spark: S, d: str) -> T:
    rows = materialize(_labelled(spark, d).where("size >= 2"), "labelled")
    mined = materialize(_mined(spark, d, rows), "mined")
    rates = templates.compression_rates(mined).select("cluster", "rate")
    hits = mined.where("template_no > 0").join(rows.select("doc_id", "label"), "doc_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("label").alias("hits"))
    return metrics.precision_curve(hits.join(rates, "cluster"), F.desc("rate"), "cluster")


def cluster_quality(spark: S, d: str) -> T:
    """Mean Jaccard similarity of a cluster's first text with its other texts, on white-space tokens."""
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(text.words_nonspace(F.col("text"))).alias("w"))
    found = _coarse(spark, d).where("size >= 2 and doc_id <> cluster")
    pairs = found.join(docs, "doc_id").join(docs.select(F.col("doc_id").alias("cluster"), F.col("w").alias("first")), "cluster")
    return pairs.groupBy("cluster").agg(F.round(F.avg(text.jaccard(F.col("w"), F.col("first"))), 9).alias("quality"), F.count(F.lit(1)).alias("edges"))


# --- coding


def log_star_lengths(spark: S, d: str) -> T:
    return table(spark, d, "documents").select("doc_id", coding.log_star(F.col("n_chars")).alias("bits"))


def gamma_codes(spark: S, d: str) -> T:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", coding.gamma(F.col("l_partkey")).alias("code"))


def gamma_text_bits(spark: S, d: str) -> T:
    return table(spark, d, "part").select("p_partkey", coding.text_bits(F.col("p_name")).cast("long").alias("bits"))


def sequence_cost_by_cluster(spark: S, d: str) -> T:
    words = templates.prepared(_coarse(spark, d).where("size >= 2"), table(spark, d, "documents"))
    costed = words.crossJoin(F.broadcast(templates.vocabulary_cost(words)))  # one row
    return costed.groupBy("cluster").agg(F.sum(coding.sequence_cost(F.size("words").cast("long"), F.col("word_cost")) + 1).alias("initial_cost"), F.count(F.lit(1)).alias("docs"))


def wildcard_fillings(spark: S, d: str) -> T:
    """What the wildcard of the template `Customer#` + digits matches."""
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract("c_name", "^(Customer#)([0-9]*)", 2).alias("filling"))


# --- time series


def counts_by_day(spark: S, d: str) -> T:
    return timeseries.counts(table(spark, d, "events"), "day")


def counts_by_month(spark: S, d: str) -> T:
    return timeseries.counts(table(spark, d, "events"), "month")


def counts_by_year(spark: S, d: str) -> T:
    return timeseries.counts(table(spark, d, "orders"), "year", "o_orderdate")


def count_jumps(spark: S, d: str) -> T:
    return timeseries.jumps(timeseries.counts(table(spark, d, "events"), "day"))


def count_lag_pairs(spark: S, d: str) -> T:
    return timeseries.lag_pairs(timeseries.counts(table(spark, d, "events"), "day"))


def count_spectrum(spark: S, d: str) -> T:
    return timeseries.spectrum(timeseries.counts(table(spark, d, "events"), "day"))


def top_values(spark: S, d: str) -> T:
    return timeseries.top_values(table(spark, d, "lineitem"), "l_suppkey")


def date_range_sample(spark: S, d: str) -> T:
    return table(spark, d, "orders").where(timeseries.in_month(F.col("o_orderdate"), 1996, 12)).select("o_orderkey", "o_orderdate")


def id_semi_join(spark: S, d: str) -> T:
    flagged = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(flagged, "doc_id", "left_semi")


def prefix_groups(spark: S, d: str) -> T:
    rows = table(spark, d, "documents").where(F.col("source").startswith("src1"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def city_vs_population(spark: S, d: str) -> T:
    per = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    size = table(spark, d, "nation").select("n_name", (1000 * (F.col("n_nationkey") + 1)).alias("size")).where("size < 20000")
    return timeseries.log_log(per, size, "n_name")


def city_misses(spark: S, d: str) -> T:
    per = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    size = table(spark, d, "nation").select("n_name", (1000 * (F.col("n_nationkey") + 1)).alias("size")).where("size < 20000")
    return timeseries.missing(per, size, "n_name")


def merge_intervals(spark: S, d: str) -> T:
    rows = table(spark, d, "lineitem").select("l_suppkey", F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).alias("lo"), (F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")) + F.col("l_quantity").cast("int") % 5).alias("hi"))
    return graph.merged_intervals(rows, "l_suppkey")


# --- graphs


def _supply(spark: S, d: str) -> T:
    """Supplier to part, in disjoint ranges of ids."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst")).distinct()


def edge_list_dense(spark: S, d: str) -> T:
    return graph.densify(_supply(spark, d))[0]


def degree_distribution(spark: S, d: str) -> T:
    return graph.degree_histogram(_supply(spark, d))


def successor_lists(spark: S, d: str) -> T:
    return graph.adjacency(_supply(spark, d)).select("src", F.size("successors").cast("long").alias("n"), F.array_join(F.transform("successors", lambda x: x.cast("string")), ",").alias("successors"))


def _nation_sets(spark: S, d: str) -> T:
    return table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("set_id"), F.col("s_suppkey").alias("node"))


def _customer_graph(spark: S, d: str) -> T:
    """Supplier to supplier, where they have neighbouring lines of an order and the first has the lower line number."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("dst"))
    return li.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("src"), "dst").where("src <> dst").distinct()


def edge_conductance(spark: S, d: str) -> T:
    return graph.conductance(_customer_graph(spark, d), _nation_sets(spark, d))


def modularity_q(spark: S, d: str) -> T:
    parts = _nation_sets(spark, d).select("node", F.col("set_id").alias("part"))
    return graph.modularity(_customer_graph(spark, d), parts)


def greedy_communities(spark: S, d: str) -> T:
    """Communities of suppliers that orders join, by greedy gain of modularity."""
    return communities.greedy_communities(materialize(_customer_graph(spark, d), "supplier-links"))


def greedy_communities_check(spark: S, d: str) -> T:
    """What must hold of them: every node has a community, no two that are joined would raise the modularity as one, and it is above that of single nodes."""
    edges = materialize(_customer_graph(spark, d), "supplier-links")
    history: list[float] = []
    found = materialize(communities.greedy_communities(edges, history=history), "found-communities")
    row = communities.open_merges(edges, found)
    rising = all(a < b for a, b in zip(history, history[1:], strict=False))
    return row.select("nodes", "open_pairs", (F.lit(rising) & (F.abs(F.col("modularity") - history[-1]) < 1e-9)).alias("modularity_rises"))


def complete_components(spark: S, d: str) -> T:
    """Per coarse cluster of at least three: documents, those of its most common phrase, and whether each two documents share a phrase."""
    top = materialize(coarse_top_phrases(spark, d), "top-phrases")
    edges = materialize(cluster.shared_edges(top), "shared-edges")
    found = materialize(cluster.clusters(table(spark, d, "documents"), cluster.document_links(edges)).where("size >= 3"), "coarse")
    per = edges.join(found, "doc_id").groupBy("cluster", "phrase").agg(F.count(F.lit(1)).alias("k"))
    whole = per.groupBy("cluster").agg(F.max("k").alias("k")).join(found.select("cluster", "size").distinct(), "cluster")
    done = cluster.complete_clusters(edges, found)
    return whole.join(done, "cluster", "left").select("cluster", "size", F.col("k").alias("largest_phrase"), F.coalesce("complete", F.lit(False)).alias("complete"))


def phones_per_component(spark: S, d: str) -> T:
    """Personal numbers per component: documents of a cluster that hold a phone-like number, and clusters with many."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("text").rlike(r"\+[0-9]"), F.lit(1)).alias("phone"))
    return _coarse(spark, d).join(docs, "doc_id").groupBy("cluster").agg(F.count("phone").alias("phones")).where("phones > 0").withColumn("suspicious", F.col("phones") > 100)


def _points(spark: S, d: str) -> T:
    e = table(spark, d, "embeddings")
    return e.select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


def gaussian_entropy(spark: S, d: str) -> T:
    return graph.gaussian_entropy(_points(spark, d), "label")


def off_axis_points(spark: S, d: str) -> T:
    return graph.off_axes(_points(spark, d), 0.05).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def singular_values(spark: S, d: str) -> T:
    return graph.singular_vectors(_supplier_sample(spark, d), 9)[0]


def _order_graph(spark: S, d: str) -> T:
    """Supplier to supplier, where an order has both and the first has the lower line number, whatever lines lie between."""
    li = table(spark, d, "lineitem").where("l_orderkey is not null").repartition("l_orderkey")
    of = li.groupBy("l_orderkey", F.col("l_suppkey").alias("src")).agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"))
    to = of.select("l_orderkey", F.col("src").alias("dst"), F.col("last").alias("after"))
    return of.join(to, "l_orderkey").where("src <> dst and first < after").select("src", "dst").distinct()


def _supplier_sample(spark: S, d: str) -> T:
    return materialize(graph.densify(_order_graph(spark, d))[0], "supplier-graph")


def spokes(spark: S, d: str) -> T:
    edges = _supplier_sample(spark, d)
    return graph.spokes(edges, materialize(graph.singular_vectors(edges, 9)[1], "u"))


def spoke_pairs(spark: S, d: str) -> T:
    edges = _supplier_sample(spark, d)
    u = materialize(graph.singular_vectors(edges, 9)[1], "u")
    return graph.axis_pairs(u, graph.spokes(edges, u))


def spoke_axes(spark: S, d: str) -> T:
    return graph.spoke_axes(spoke_pairs(spark, d), 9)


def bigram_svd_clusters(spark: S, d: str) -> T:
    return graph.svd_clusters(boundary_bigrams(spark, d))


def generated_complete(spark: S, d: str) -> T:
    return graph.complete_edges(spark, 40)


def generated_bipartite(spark: S, d: str) -> T:
    return graph.bipartite_edges(spark, 20, 30)


def generated_random(spark: S, d: str) -> T:
    return graph.random_edges(spark, 1000, 5000)


def generated_blocks(spark: S, d: str) -> T:
    return graph.dense_blocks(spark)


def generated_chains(spark: S, d: str) -> T:
    return graph.mutation_chains(spark, chains=4, steps=25)


# --- templates and hashing


def _mined(spark: S, d: str, members: T) -> T:
    return templates.mine_templates(templates.prepared(members, table(spark, d, "documents")))


def template_mining(spark: S, d: str) -> T:
    return _mined(spark, d, _coarse(spark, d).where("size >= 2")).where("template_no > 0").select("cluster", "template_no", "doc_id", "codes")


def template_slots(spark: S, d: str) -> T:
    mined = _mined(spark, d, _coarse(spark, d).where("size >= 2")).where("template_no > 0")
    return mined.groupBy("cluster", "template_no").agg(F.first("template").alias("t"), F.first("start_slot").alias("start_slot"), F.count(F.lit(1)).alias("docs")).select("cluster", "template_no", "docs", "start_slot", F.size("t").alias("words"), F.size(F.filter("t", lambda x: x["slot"])).alias("slots"))


def compression_rate(spark: S, d: str) -> T:
    return templates.compression_rates(_mined(spark, d, _coarse(spark, d).where("size >= 2")))


def template_html(spark: S, d: str) -> T:
    return templates.to_html(_mined(spark, d, _coarse(spark, d).where("size >= 2")))


def lsh_chain_clusters(spark: S, d: str) -> T:
    return lsh.chain_clusters(coarse_top_phrases(spark, d))


def lsh_shared_buckets(spark: S, d: str) -> T:
    return lsh.shared_buckets(coarse_top_phrases(spark, d), 128, 4096)


def lsh_bucket_occupancy(spark: S, d: str) -> T:
    return lsh.occupancy(coarse_top_phrases(spark, d), 128, 256)


def lsh_chain_components(spark: S, d: str) -> T:
    return lsh.chain_components(lsh_chain_clusters(spark, d))


def lsh_parameter_sweep(spark: S, d: str) -> T:
    return lsh.parameter_sweep(coarse_top_phrases(spark, d), [(16, 256), (16, 4096), (64, 256), (64, 4096)])


def _bucket_chains(spark: S, d: str, of: int, capacity: int) -> T:
    top = materialize(coarse_top_phrases(spark, d).select("doc_id", "phrase"), "top-phrases")
    return buckets.chains(buckets.meetings(buckets.arrivals(top, 16, of), capacity), 16)


def bucket_chains(spark: S, d: str) -> T:
    """Documents and the predecessors that they met in 400 buckets of 100 phrases for each function."""
    return _bucket_chains(spark, d, 400, 100)


def bucket_chains_small(spark: S, d: str) -> T:
    """The second variant: one bucket of 10 phrases for each function and 100 documents."""
    return _bucket_chains(spark, d, max(1, table(spark, d, "documents").count() // 100), 10)


def bucket_chain_components(spark: S, d: str) -> T:
    return buckets.chain_labels(bucket_chains(spark, d), table(spark, d, "documents"))


# --- sources and sinks: written to the shared folder, and what reading gives


def source_csv(spark: S, d: str) -> T:
    """Documents as CSV under other names, which are found by their roles."""
    path = fresh_path(spark, "csv")
    readers.write_csv(table(spark, d, "documents").select(F.col("source").alias("title"), F.col("text").alias("u_Description"), F.col("doc_id").alias("ad_id")), path)
    return readers.read_documents(spark, path, schema="title string, u_Description string, ad_id long")


def source_roles(spark: S, d: str) -> T:
    return readers.resolve_roles(table(spark, d, "conversations"), doc_id="conv_id")


def source_edge_list(spark: S, d: str) -> T:
    path = fresh_path(spark, "edge-list")
    graph = _customer_graph(spark, d).select(F.concat_ws(" ", "src", "dst").alias("value"))
    graph.union(spark.createDataFrame([("# a line that is no edge",)], "value string")).write.text(path)
    return readers.read_edges(spark, path)


def source_graph(spark: S, d: str) -> T:
    """Nodes of a stored graph with the edges that leave them."""
    path = fresh_path(spark, "graph")
    readers.write_graph(graph.densify(_customer_graph(spark, d))[0], path)
    nodes, edges = readers.read_graph(spark, path)
    return nodes.join(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node", "left").fillna(0, ["n"])


def _line_file(spark: S, d: str) -> T:
    path = fresh_path(spark, "lines")
    turns = table(spark, d, "conversations").orderBy("conv_id", "turn", "text")
    turns.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ").alias("value")).write.text(path)
    return readers.read_lines(spark, path)


def source_lines(spark: S, d: str) -> T:
    return _line_file(spark, d).select("doc_id", F.array_join("words", " ").alias("line"))


def source_line_bigrams(spark: S, d: str) -> T:
    grams = _line_file(spark, d).select(F.explode(text.ngrams(text.with_bounds(F.col("words")), 2, 2)).alias("phrase"))
    return grams.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def source_templates(spark: S, d: str) -> T:
    """Parts as lines of a template file: two texts, then kinds and patterns."""
    path = fresh_path(spark, "template-file")
    table(spark, d, "part").select(F.concat_ws("|", "p_partkey", "p_name", F.concat_ws(",", F.lit(1), "p_brand", "p_size", "p_type")).alias("value")).write.text(path)
    kinds, patterns = F.transform("parts", lambda p: p["kind"].cast("string")), F.transform("parts", lambda p: p["pattern"])
    return readers.read_templates(spark, path).select(F.array_join("texts", "|").alias("texts"), F.array_join(kinds, ",").alias("kinds"), F.array_join(patterns, ",").alias("patterns"))


def source_ids(spark: S, d: str) -> T:
    """Documents whose id a file lists."""
    path = fresh_path(spark, "ids")
    table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("value")).write.text(path)
    return table(spark, d, "documents").join(readers.read_ids(spark, path), "doc_id", "left_semi").select("doc_id", "lang")


def sink_labels(spark: S, d: str) -> T:
    """Texts with their cluster, from the file of all and the file of those that have one."""
    path = fresh_path(spark, "labels")
    labelled = cluster.labels(_coarse(spark, d), 2)
    readers.write_labels(table(spark, d, "documents").select("doc_id", "text").join(labelled, "doc_id"), path)
    read = lambda part: readers.read_documents(spark, f"{path}/{part}", fmt="csv", schema="doc_id long, text string, label long").withColumn("part", F.lit(part))
    return read("full").unionByName(read("labelled"))


def sink_template_tables(spark: S, d: str) -> T:
    """Rates and members by template, read back from the results tree."""
    path = fresh_path(spark, "results")
    readers.write_templates(materialize(_mined(spark, d, _coarse(spark, d).where("size >= 2")), "mined"), path)
    rates = spark.read.option("header", True).schema("cluster long, initial_cost long, final_cost long, templates int, docs long, rate double").csv(f"{path}/compression_rate")
    pages = spark.read.parquet(f"{path}/templates").groupBy("cluster").agg(F.count(F.lit(1)).alias("pages"))
    return rates.join(pages, "cluster", "left").fillna(0, ["pages"])


def template_docx(spark: S, d: str) -> T:
    return templates.to_docx(_mined(spark, d, _coarse(spark, d).where("size >= 2")))


# --- streaming forms over tables


def events_tumbling(spark: S, d: str) -> T:
    return live.tumbling(table(spark, d, "events"))


def events_sessions(spark: S, d: str) -> T:
    return live.sessions(table(spark, d, "events"))


def _events_in_time(spark: S, d: str) -> T:
    """Words of an event's type and properties, with its position in time."""
    rows = table(spark, d, "events").where("ts is not null").select("event_id", "ts", F.concat_ws(" ", "event_type", "props").alias("text"))
    rows = tfidf.numbered(rows, "ts", "event_id").select("event_id", "seq", F.explode(text.words_nonspace(F.col("text"))).alias("phrase"))
    return rows.groupBy("event_id", "seq", "phrase").agg(F.count(F.lit(1)).alias("tf"))


def running_tfidf_in_time(spark: S, d: str) -> T:
    """Scores of each event's words against the events before it in time."""
    return tfidf.running_score(tfidf.running_frequency(_events_in_time(spark, d))).select("event_id", "phrase", "tf", "df", "score")


def incremental_clusters(spark: S, d: str) -> T:
    """Clusters after the documents came in three batches; equal to those of one pass."""
    edges = materialize(coarse_top_phrases(spark, d).select("doc_id", "phrase").distinct(), "edges")
    grown = live.GrowingClusters(spark.createDataFrame([], "doc_id long, cluster long"), spark.createDataFrame([], "doc_id long, phrase string"))
    for i in range(3):
        grown.add(edges.where(F.pmod("doc_id", F.lit(3)) == i), i)
    return grown.labels


# --- reports and small filters


def min_ngrams(spark: S, d: str) -> T:
    """Turns with at least five bigrams."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.ngrams(text.words_nonspace(F.col("text")), 2, 2).alias("g")).dropna(subset=["g"])
    return rows.where(F.size("g") >= 5).select("conv_id", "turn", F.size("g").cast("long").alias("grams"))


def vocabulary(spark: S, d: str) -> T:
    words = table(spark, d, "documents").select(text.words_no_punctuation(F.col("text")).alias("words"))
    return templates.vocabulary_cost(words)


def mixed_terms(spark: S, d: str) -> T:
    """Bag of a turn's words and of its role as a marked term: phrases and other values compete in one space."""
    rows = table(spark, d, "conversations").select("conv_id", F.concat(text.words_nonspace(F.col("text")), F.array(F.concat(F.lit("#"), "role"))).alias("w"))
    return rows.select("conv_id", F.explode("w").alias("term")).groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def adjacent_turn_jaccard(spark: S, d: str) -> T:
    """Edges from a turn to the next, joined with the texts of both ends."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(text.words_nonspace(F.col("text"))).alias("w"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return turns.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.jaccard(F.col("w"), F.col("v")), 9).alias("similarity"))


def highlighted_phrases(spark: S, d: str) -> T:
    """Character intervals of the cleaned text that a document's best phrases cover, merged where they meet; each phrase's
    occurrences are taken from the left, without overlaps."""
    top = coarse_top_phrases(spark, d).select("doc_id", "phrase")
    docs = table(spark, d, "documents").select("doc_id", text.clean_page("text").alias("c"))
    between = text.split_at(F.col("c"), F.col("phrase"))
    parts = top.join(docs, "doc_id").select("doc_id", "phrase", F.size(between).alias("parts"), F.posexplode(between).alias("k", "part"))
    n = F.length("phrase")
    upto = F.sum(F.length("part")).over(Window.partitionBy("doc_id", "phrase").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    spans = parts.withColumn("lo", (upto + F.col("k") * n + 1).cast("int")).where(F.col("k") < F.col("parts") - 1)
    return graph.merged_intervals(spans.select("doc_id", "lo", (F.col("lo") + n - 1).alias("hi")), "doc_id")


def bigram_presence(spark: S, d: str) -> T:
    """How many documents hold each boundary bigram, of those that more than one holds."""
    return boundary_bigrams(spark, d).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cluster_report(spark: S, d: str) -> T:
    docs = table(spark, d, "documents")
    return readers.latex_rows(_coarse(spark, d).where("size >= 2 and doc_id = cluster").join(docs.select("doc_id", "text"), "doc_id").select("cluster", "size", "text"))


def alignment_graphs(spark: S, d: str) -> T:
    return templates.alignment_graph(templates.prepared(_coarse(spark, d).where("size >= 2"), table(spark, d, "documents")))


def alignment_drawings(spark: S, d: str) -> T:
    return templates.drawing(alignment_graphs(spark, d))


def lsh_chain_clusters_v2(spark: S, d: str) -> T:
    """The second variant: superseded clusters are skipped, buckets are smaller, phrases are the best fifth of 5-grams."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = docs.count()
    words = F.array_join(text.words2(text.clean_ascii("text")), " ")
    shared = distinctive.filling(docs, words, n, F.lit((1 << 63) - 1), low=5, high=5)  # there is room for all
    weighted = tfidf.weighed(shared, n).withColumn("weight", F.round("weight", 9))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc("phrase")))
    top = weighted.withColumn("rank", rank).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).where(F.col("rank") <= F.floor(F.col("k") / 5)).select("doc_id", "rank", "phrase")
    return lsh.chain_clusters(top, buckets=max(1, n // 100), capacity=10, skip_marked=True)


def sink_reused_stage(spark: S, d: str) -> T:
    """Words and documents by source, published by the first call and read by the second."""
    words = table(spark, d, "documents").select("source", F.size(text.words_nonspace(F.col("text"))).cast("long").alias("n"))
    stage = words.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"))
    reused(stage, "words-by-source", inputs=[f"{d}/documents.parquet"])
    return reused(stage, "words-by-source", inputs=[f"{d}/documents.parquet"])
