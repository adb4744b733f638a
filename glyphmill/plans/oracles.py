"""The same queries in the oracle's SQL dialect."""

from __future__ import annotations

from glyphmill.functions import text
from glyphmill.operators import graph

WS = r"[^ \t\n\r\f\v]+"


def _clean_ascii(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '[0-9]+', '', 'g'), '[^\x00-\x7F]+', ' ', 'g'), '<.*?>', '', 'g')"


def _clean_page(c: str) -> str:
    out = f"regexp_replace(regexp_replace(coalesce({c}, ''), '[0-9]+', '', 'g'), '<.*?>', ' ', 'g')"
    for residue in text.PAGE_RESIDUES:
        out = f"replace({out}, '{residue}', '')"
    return out


def _grams(words: str, low: int, high: int) -> str:
    parts = [f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))" for n in range(low, high + 1)]
    return f"flatten([{', '.join(parts)}])" if len(parts) > 1 else parts[0]


def _words2(c: str, lower: bool = True) -> str:
    c = f"lower({c})" if lower else c
    return f"regexp_extract_all({c}, '[A-Za-z0-9_]{{2,}}')"


STOPPED = f"list_filter({_words2(_clean_ascii('text'), False)}, lambda w: NOT list_contains([{', '.join(repr(w) for w in text.STOP_WORDS)}], lower(w)))"
MARKS = f"regexp_extract_all({_clean_ascii('text')}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\v]')"


def _exploded(words: str, name: str = "token") -> str:
    return f"SELECT doc_id, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS {name} FROM (SELECT doc_id, {words} AS w FROM documents)"


STATIC = f"""
w AS (SELECT doc_id, regexp_extract_all({_clean_page('text')}, '{WS}') AS w FROM documents),
g AS (SELECT doc_id, unnest({_grams('w', 3, 5)}) AS phrase FROM w),
tf AS (SELECT doc_id, phrase, count(*) AS tf FROM g GROUP BY ALL),
df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY ALL)"""
TOP = f"""{STATIC},
wt AS (SELECT doc_id, phrase, round((1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 9) AS weight FROM tf JOIN df USING (phrase)),
top AS (SELECT doc_id, phrase, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, phrase DESC)::INTEGER AS rank FROM wt QUALIFY rank <= 10)"""


def _components(edges: str, name: str = "cl") -> str:
    """{name}: doc_id, cluster, size, from bipartite edges (doc_id, phrase)."""
    return f"""
sh AS (SELECT DISTINCT doc_id, phrase FROM {edges} WHERE phrase IN (SELECT phrase FROM {edges} GROUP BY phrase HAVING count(DISTINCT doc_id) > 1)),
hub AS (SELECT phrase, min(doc_id) AS h FROM sh GROUP BY phrase),
lk AS (SELECT DISTINCT h AS a, doc_id AS b FROM sh JOIN hub USING (phrase) WHERE h <> doc_id),
sy AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
rc(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT rc.x, sy.b FROM rc JOIN sy ON rc.y = sy.a),
mn AS (SELECT x AS doc_id, min(y) AS cluster FROM rc GROUP BY x),
{name} AS (SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM mn)"""


COARSE = f"WITH RECURSIVE {TOP}, {_components('top')}"
NUMBERED = f"""
nd AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq, {_words2(_clean_ascii('text'))} AS w FROM documents),
ng AS (SELECT doc_id, seq, unnest({_grams('w', 5, 5)}) AS phrase FROM nd),
tf AS (SELECT doc_id, seq, phrase, count(*) AS tf FROM ng GROUP BY ALL)"""
MODES = {
    "normal": "dfr AS (SELECT *, count(*) OVER (PARTITION BY phrase) AS df FROM tf)",
    "stream": "dfr AS (SELECT *, count(*) OVER (PARTITION BY phrase ORDER BY seq ROWS UNBOUNDED PRECEDING) AS df FROM tf)",
    "batch": """tt AS (SELECT greatest(1, ceil(count(*) / 10))::BIGINT AS t FROM documents),
bt AS (SELECT tf.*, CASE WHEN seq < 3 * t THEN 0 ELSE 1 + (seq - 3 * t) // t END AS batch FROM tf, tt),
dfr AS (SELECT doc_id, seq, phrase, tf, count(*) OVER (PARTITION BY phrase ORDER BY batch RANGE UNBOUNDED PRECEDING) AS df FROM bt)""",
}


def _running(mode: str, k: int = 5) -> str:
    return f"""{NUMBERED},
{MODES[mode]},
sc AS (SELECT *, round(tf * ln((seq + 1) / df), 6) AS score FROM dfr),
rt AS (SELECT doc_id, phrase, tf, df, score, (coalesce(sum(tf) OVER (PARTITION BY doc_id ORDER BY score DESC, phrase DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS place FROM sc QUALIFY place <= {k})"""


TRUTH = """
gr AS (SELECT text, min(doc_id) AS t, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1),
tr AS (SELECT d.doc_id, gr.t AS truth FROM documents d LEFT JOIN gr ON gr.text = d.text)"""


def _scores(rows: str) -> str:
    """From rows (doc_id, truth, label), both null for noise."""
    return f"""
vw AS (SELECT 'one_cluster' AS view, coalesce(truth::VARCHAR, 'none') AS t, coalesce(label::VARCHAR, 'none') AS p FROM {rows}
 UNION ALL SELECT 'singletons', CASE WHEN label IS NULL THEN 's' || doc_id ELSE coalesce(truth::VARCHAR, 's' || doc_id) END, coalesce(label::VARCHAR, 's' || doc_id) FROM {rows}
 UNION ALL SELECT 'dropped', coalesce(truth::VARCHAR, 's' || doc_id), label::VARCHAR FROM {rows} WHERE label IS NOT NULL),
ce AS (SELECT view, t, p, count(*)::DOUBLE AS n FROM vw GROUP BY ALL),
jo AS (SELECT view, sum(n * (n - 1) / 2) AS s, sum(n * ln(n)) AS l, sum(n) AS n FROM ce GROUP BY view),
mt AS (SELECT view, sum(n * (n - 1) / 2) AS st, sum(n * ln(n)) AS lt FROM (SELECT view, t, sum(n) AS n FROM ce GROUP BY ALL) GROUP BY view),
mp AS (SELECT view, sum(n * (n - 1) / 2) AS sp, sum(n * ln(n)) AS lp FROM (SELECT view, p, sum(n) AS n FROM ce GROUP BY ALL) GROUP BY view),
al AS (SELECT *, st * sp / (n * (n - 1) / 2) AS ex, ln(n) - lt / n AS ht, ln(n) - lp / n AS hp, ln(n) + (l - lt - lp) / n AS mi FROM jo JOIN mt USING (view) JOIN mp USING (view))
SELECT view, n::BIGINT AS n, round(CASE WHEN s = st AND s = sp THEN 1.0 ELSE (s - ex) / ((st + sp) / 2 - ex) END, 6) + 0.0 AS ari,
 round(CASE WHEN ht < 1e-12 THEN 1.0 ELSE mi / ht END, 6) + 0.0 AS homogeneity, round(CASE WHEN ht + hp < 1e-12 THEN 1.0 ELSE 2 * mi / (ht + hp) END, 6) + 0.0 AS nmi FROM al"""


LABELLED = "lb AS (SELECT c.doc_id, c.cluster, c.size, coalesce(1 - l.quality, 0) AS label FROM cl c LEFT JOIN labels l USING (doc_id))"


def _draw(seed: int, salt: int, *of: str) -> str:
    return "('0x' || substr(md5(" + " || ':' || ".join([f"'{seed}:{salt}'", *of]) + "), 1, 8))::BIGINT"


def _blocks(seed: int = 11) -> str:
    """The generator's blocks by their corners and densities, noise last."""
    rows, a, b = [], 0, sum(r for r, _, _ in (*graph.BLOCKS, graph.NOISE))
    for i, (r, c, p) in enumerate((*graph.BLOCKS, graph.NOISE)):
        rows.append(f"SELECT s.range AS src, t.range AS dst FROM range({a}, {a + r}) s, range({b}, {b + c}) t WHERE {_draw(seed, i, 's.range', 't.range')} / 4294967296.0::DOUBLE < {p}")
        a, b = a + r, b + c
    rows.append(f"SELECT s.range, t.range FROM range({a}) s, range({a}, {b}) t WHERE {_draw(seed, 99, 's.range', 't.range')} / 4294967296.0::DOUBLE < {graph.CAMOUFLAGE}")
    return " UNION ".join(rows)


def _sweep(functions: int, buckets: int) -> str:
    of = f"(SELECT DISTINCT doc_id, phrase, fn, ('0x' || substr(md5(fn || ':' || phrase), 1, 8))::BIGINT % {buckets} AS bucket FROM top, range({functions}) f(fn))"
    hubs = f"(SELECT *, min(doc_id) OVER (PARTITION BY fn, bucket) AS hub FROM {of})"
    return f"SELECT {functions} AS functions, {buckets} AS buckets, (SELECT max(n) FROM (SELECT count(*) AS n FROM {of} GROUP BY fn, bucket)) AS fullest, (SELECT count(DISTINCT (doc_id, hub)) FROM {hubs} WHERE hub <> doc_id) AS links"


def _log_star(x: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0 WHEN {x} = 1 THEN 1 ELSE 2 * length(ltrim(bin({x} - 1), '0')) + 1 END"


NEXT = "cg AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey)"
SUPPLY = "sp AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 10000000 AS dst FROM lineitem)"
POINTS = "pt AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
def _chains(of: str, capacity: int) -> str:
    """ch: doc_id, predecessor, shared, kind of 16 functions; between two arrivals of a phrase a bucket sees fewer than `capacity` other phrases."""
    return f"""{TOP},
dp AS (SELECT DISTINCT doc_id, phrase FROM top),
ba AS (SELECT *, row_number() OVER (PARTITION BY fn, bucket ORDER BY doc_id, phrase) AS pos FROM (SELECT doc_id, phrase, fn, ('0x' || substr(md5(fn || ':' || phrase), 1, 8))::BIGINT % {of} AS bucket FROM dp, range(16) f(fn))),
bp AS MATERIALIZED (SELECT *, lag(pos) OVER v AS pp, lag(doc_id) OVER v AS met FROM ba WINDOW v AS (PARTITION BY fn, bucket, phrase ORDER BY pos)),
bo AS (SELECT c.fn, c.bucket, c.pos FROM bp c JOIN bp r ON r.fn = c.fn AND r.bucket = c.bucket AND r.pos > c.pp AND r.pos < c.pos WHERE coalesce(r.pp, 0) < c.pp GROUP BY ALL HAVING count(*) >= {capacity}),
bm AS (SELECT doc_id, met, phrase, count(*) AS n FROM bp ANTI JOIN bo USING (fn, bucket, pos) WHERE pp IS NOT NULL GROUP BY ALL),
bs AS (SELECT doc_id, met AS predecessor, count(*) FILTER (2 * n >= 16) AS shared, count(*) FILTER (2 * n > 16) AS above FROM bm GROUP BY ALL),
ch AS (SELECT doc_id, predecessor, shared, CASE WHEN shared = k THEN 'duplicate' ELSE 'chain' END AS kind FROM bs JOIN (SELECT doc_id, count(*) AS k FROM dp GROUP BY doc_id) USING (doc_id) WHERE shared = k OR above > 0)"""


DAYS = "dy AS (SELECT strftime(ts, '%Y %m %d') AS bucket, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL)"
LINES = f"ln AS (SELECT row_number() OVER (ORDER BY conv_id, turn, text NULLS FIRST) - 1 AS doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g'), '{WS}') AS w FROM conversations)"
CITY = "pc AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), sz AS (SELECT n_name, 1000 * (n_nationkey + 1) AS size FROM nation WHERE 1000 * (n_nationkey + 1) < 20000)"
BUCKETS = "bu AS (SELECT doc_id, phrase, fn, ('0x' || substr(md5(fn || ':' || phrase), 1, 8))::BIGINT % {n} AS bucket FROM top, range(128) f(fn))"

SQL = {
    "clean_text_ascii": f"SELECT doc_id, {_clean_ascii('text')} AS cleaned FROM documents",
    "clean_text_html": f"SELECT page_id, {_clean_page('html')} AS cleaned FROM pages",
    "title_text": "SELECT doc_id, coalesce(source, '') || ' ' || coalesce(text, '') AS joined FROM documents",
    "tokens_word2": _exploded(_words2(_clean_ascii("text"))),
    "tokens_ws": _exploded(f"regexp_extract_all(text, '{WS}')"),
    "tokens_nopunct": _exploded("list_filter(list_transform(string_split(translate(coalesce(text, ''), '" + text.PUNCTUATION.replace("'", "''") + "', ''), ' '), lambda x: lower(x)), lambda x: x <> '')"),
    "token_counts_by_tokenizer": f"SELECT doc_id, len({MARKS})::BIGINT AS n_marks, len({_words2(_clean_ascii('text'), False)})::BIGINT AS n_words FROM documents",
    "ngram_counts_3_5": f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{WS}') AS w FROM documents), g AS (SELECT doc_id, unnest({_grams('w', 3, 5)}) AS phrase FROM w)
        SELECT doc_id, len(string_split(phrase, ' '))::INTEGER AS n, count(*) AS grams, count(DISTINCT phrase) AS distinct_grams FROM g GROUP BY ALL""",
    "stopword_bigrams": f"WITH w AS (SELECT doc_id, {STOPPED} AS w FROM documents), g AS (SELECT doc_id, unnest({_grams('w', 2, 2)}) AS phrase FROM w) SELECT doc_id, phrase, count(*) AS tf FROM g GROUP BY ALL HAVING count(*) > 1",
    "boundary_bigrams": f"WITH w AS (SELECT conv_id * 1000 + turn AS doc_id, flatten([['<s>'], regexp_extract_all(coalesce(text, ''), '{WS}'), ['</s>']]) AS w FROM conversations) SELECT DISTINCT doc_id, unnest({_grams('w', 2, 2)}) AS phrase FROM w",
    "kth_occurrence_pairs": f"""WITH t AS (SELECT conv_id, turn, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS token FROM (SELECT conv_id, turn, regexp_extract_all(text, '{WS}') AS w FROM conversations)),
        m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, token ORDER BY pos)::INTEGER AS k FROM t)
        SELECT a.conv_id, a.turn, a.token, a.k, a.pos AS pos_a, b.pos AS pos_b FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.token = b.token AND a.k = b.k""",
    "doc_freq_static": f"WITH {STATIC} SELECT phrase, df FROM df WHERE df > 1",
    "vocab_pruned": f"WITH g AS (SELECT DISTINCT doc_id, unnest({_words2(_clean_ascii('text'))}) AS phrase FROM documents) SELECT phrase, count(*) AS df FROM g GROUP BY ALL HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM documents)",
    "l2_norms": f"""WITH g AS (SELECT doc_id, unnest({_words2(_clean_ascii('text'))}) AS phrase FROM documents), tf AS (SELECT doc_id, phrase, count(*) AS tf FROM g GROUP BY ALL), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY ALL)
        SELECT doc_id, round(sqrt(sum(pow(tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 2))), 6) AS norm FROM tf JOIN df USING (phrase) GROUP BY doc_id""",
    "coarse_top_phrases": f"WITH {TOP} SELECT doc_id, rank, phrase, weight FROM top",
    "coarse_edges": f"WITH {TOP} SELECT doc_id, phrase FROM top WHERE phrase IN (SELECT phrase FROM top GROUP BY phrase HAVING count(*) > 1)",
    "coarse_clusters": f"{COARSE} SELECT doc_id, cluster, size FROM cl",
    "coarse_cluster_sizes": f"{COARSE} SELECT cluster, count(*) AS docs FROM cl WHERE size >= 2 GROUP BY cluster",
    "coarse_labels": f"{COARSE} SELECT doc_id, cluster AS label FROM cl WHERE size >= 2",
    "cluster_dump": f"{COARSE} SELECT cluster, size, doc_id, text FROM cl JOIN documents USING (doc_id) WHERE size >= 2",
    "component_stats": f"{COARSE}, s AS (SELECT cluster, count(*) AS docs FROM cl GROUP BY cluster) SELECT docs, count(*) AS components FROM s GROUP BY docs",
    "running_tfidf_normal": f"WITH {_running('normal')} SELECT * FROM rt",
    "running_tfidf_stream": f"WITH {_running('stream')} SELECT * FROM rt",
    "running_tfidf_batch": f"WITH {_running('batch')} SELECT * FROM rt",
    "stream_df_replay": f"WITH {NUMBERED}, {MODES['stream']} SELECT doc_id, phrase, tf, df FROM dfr WHERE df > 1",
    "running_clusters_stream": f"WITH RECURSIVE {_running('stream')}, {_components('rt')} SELECT doc_id, cluster AS label FROM cl WHERE size >= 2",
    "phrase_prefix_by_length": f"""WITH w AS (SELECT doc_id, {STOPPED} AS w, len({MARKS}) AS n_tokens FROM documents), g AS (SELECT doc_id, unnest({_grams('w', 2, 3)}) AS phrase FROM w), tf AS (SELECT doc_id, phrase, count(*) AS tf FROM g GROUP BY ALL),
        nn AS (SELECT count(*) AS n FROM documents), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT n FROM nn)),
        wt AS (SELECT doc_id, phrase, round(tf * (ln((1 + n) / (1 + df)) + 1), 9) AS weight FROM tf JOIN df USING (phrase), nn),
        rk AS (SELECT doc_id, phrase, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, phrase DESC) AS rank FROM wt),
        ln AS (SELECT *, coalesce(sum(CASE WHEN rank = 1 THEN 0 ELSE length(phrase) END) OVER (PARTITION BY doc_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rk)
        SELECT doc_id, rank, phrase FROM ln JOIN w USING (doc_id) WHERE rank = 1 OR before < n_tokens""",
    "batch_sizes": "WITH s AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM documents), t AS (SELECT greatest(1, ceil(count(*) / 10))::BIGINT AS t FROM documents) SELECT (CASE WHEN seq < 3 * t THEN 0 ELSE 1 + (seq - 3 * t) // t END)::BIGINT AS batch, count(*) AS n FROM s, t GROUP BY ALL",
    "exact_copy_clusters": f"WITH {TRUTH} SELECT doc_id, truth FROM tr WHERE truth IS NOT NULL",
    "mode_comparison": " UNION ALL ".join(f"SELECT *, '{m}' AS mode FROM (WITH RECURSIVE {_running(m)}, {_components('rt')}, {TRUTH}, rw AS (SELECT doc_id, truth, CASE WHEN size >= 2 THEN cluster END AS label FROM cl JOIN tr USING (doc_id)), {_scores('rw')})" for m in MODES),
    "num_phrases_sweep": " UNION ALL ".join(f"SELECT {k} AS k, count(*) AS clusters, coalesce(sum(n), 0)::BIGINT AS docs FROM (WITH RECURSIVE {_running('stream', k)}, {_components('rt')} SELECT cluster, count(*) AS n FROM cl WHERE size >= 2 GROUP BY cluster)" for k in range(1, 11)),
    "label_propagation": f"{COARSE}, {LABELLED}, s AS (SELECT *, max(label) OVER (PARTITION BY cluster) AS m, sum(label) OVER (PARTITION BY cluster) AS t FROM lb WHERE size >= 2) SELECT doc_id, CASE WHEN t > 0 THEN cluster END AS cluster, CASE WHEN size < 2000 THEN m ELSE label END AS label FROM s",
    "confusion_matrix": f"""{COARSE}, {LABELLED}, c AS (SELECT count(*) FILTER (label = 1 AND size >= 2) AS tp, count(*) FILTER (label <> 1 AND size >= 2) AS fp, count(*) FILTER (label = 1 AND size < 2) AS fn, count(*) FILTER (label <> 1 AND size < 2) AS tn FROM lb)
        SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c""",
    "label_rewrite": "SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS is_flagged, CASE WHEN quality = 0 OR toxic = 1 THEN doc_id ELSE -1 END AS flag_id FROM labels",
    "clustering_scores": f"{COARSE}, {TRUTH}, rw AS (SELECT doc_id, truth, CASE WHEN size >= 2 THEN cluster END AS label FROM cl JOIN tr USING (doc_id)), {_scores('rw')}",
    "precision_curve": f"""{COARSE}, {LABELLED}, p AS (SELECT cluster, count(*) AS size, sum(label)::BIGINT AS hits FROM lb WHERE size >= 2 GROUP BY cluster),
        c AS (SELECT *, row_number() OVER w AS rank, sum(size) OVER w AS docs, sum(hits) OVER w AS found, sum(size) OVER () AS s, sum(hits) OVER () AS h FROM p WINDOW w AS (ORDER BY size DESC, cluster ROWS UNBOUNDED PRECEDING))
        SELECT rank::INTEGER AS rank, cluster, size, hits, round(docs / s, 9) AS share, round(found / docs, 9) AS precision, round(found / nullif(h, 0), 9) AS recall FROM c""",
    "cluster_quality": f"""{COARSE}, t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '{WS}')) AS w FROM documents), p AS (SELECT c.cluster, a.w AS a, b.w AS b FROM cl c JOIN t a USING (doc_id) JOIN t b ON b.doc_id = c.cluster WHERE size >= 2 AND c.doc_id <> c.cluster)
        SELECT cluster, round(avg(CASE WHEN len(list_distinct(flatten([a, b]))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(flatten([a, b]))) END), 9) AS quality, count(*) AS edges FROM p GROUP BY cluster""",
    "log_star_lengths": f"SELECT doc_id, ({_log_star('n_chars')})::BIGINT AS bits FROM documents",
    "gamma_codes": "WITH b AS (SELECT l_orderkey, l_linenumber, ltrim(bin(greatest(l_partkey, 1)), '0') AS b FROM lineitem) SELECT l_orderkey, l_linenumber, repeat('0', length(b) - 1) || b AS code FROM b",
    "gamma_text_bits": "SELECT p_partkey, (2 * length(ltrim(bin(greatest(length(p_name), 1)), '0')) - 1 + coalesce(list_sum(list_transform(string_split(p_name, ''), lambda s: 2 * length(ltrim(bin(greatest(unicode(s), 1)), '0')) - 1)), 0))::BIGINT AS bits FROM part",
    "sequence_cost_by_cluster": f"""{COARSE}, t AS (SELECT c.cluster, c.doc_id, list_filter(list_transform(string_split(translate(coalesce(text, ''), '{text.PUNCTUATION.replace("'", "''")}', ''), ' '), lambda x: lower(x)), lambda x: x <> '') AS w FROM cl c JOIN documents USING (doc_id) WHERE size >= 2),
        v AS (SELECT count(DISTINCT x) AS voc FROM (SELECT unnest(w) AS x FROM t)), k AS (SELECT CASE WHEN voc <= 1 THEN 0 ELSE length(ltrim(bin(voc - 1), '0')) END AS wc FROM v)
        SELECT cluster, sum({_log_star('len(w)')} + len(w) * wc + 1)::BIGINT AS initial_cost, count(*) AS docs FROM t, k WHERE len(w) > 0 GROUP BY cluster""",
    "wildcard_fillings": "SELECT c_custkey, regexp_extract(c_name, '^(Customer#)([0-9]*)', 2) AS filling FROM customer",
    "counts_by_day": f"WITH {DAYS} SELECT * FROM dy",
    "counts_by_month": "SELECT strftime(ts, '%Y %m') AS bucket, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "counts_by_year": "SELECT strftime(o_orderdate, '%Y') AS bucket, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL",
    "count_jumps": f"WITH {DAYS}, l AS (SELECT bucket, n, lag(n, 1, -1) OVER (ORDER BY bucket) AS last FROM dy) SELECT * FROM l WHERE abs(n - last) > 30",
    "count_lag_pairs": f"WITH {DAYS}, l AS (SELECT n, lead(n) OVER (ORDER BY bucket) AS next, bucket FROM dy) SELECT * FROM l WHERE next IS NOT NULL",
    "count_spectrum": f"""WITH {DAYS}, s AS (SELECT n, row_number() OVER (ORDER BY bucket) - 1 AS t, count(*) OVER () AS m FROM dy), f AS (SELECT k.t AS k, sum(x.n * cos(-2 * pi() * k.t * x.t / x.m)) AS re, sum(x.n * sin(-2 * pi() * k.t * x.t / x.m)) AS im FROM s x, s k GROUP BY k.t)
        SELECT k, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im, round(sqrt(re * re + im * im), 6) AS magnitude FROM f""",
    "top_values": "SELECT l_suppkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY n DESC, value LIMIT 10",
    "date_range_sample": "SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 12",
    "id_semi_join": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "prefix_groups": "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE starts_with(source, 'src1') GROUP BY source",
    "city_vs_population": f"WITH {CITY} SELECT n_name, round(log10(n), 9) AS log_n, round(log10(size), 9) AS log_size FROM pc JOIN sz USING (n_name)",
    "city_misses": f"WITH {CITY} SELECT n_name, n FROM pc WHERE n_name NOT IN (SELECT n_name FROM sz)",
    "merge_intervals": """WITH r AS (SELECT l_suppkey, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS lo, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::INT % 5 AS hi FROM lineitem),
        n AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo - 1 THEN 0 ELSE 1 END AS nw FROM r),
        i AS (SELECT *, sum(nw) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM n)
        SELECT l_suppkey, min(lo)::INTEGER AS lo, max(hi)::INTEGER AS hi, count(*) AS merged FROM i GROUP BY l_suppkey, island""",
    "edge_list_dense": f"WITH {SUPPLY}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS node FROM (SELECT src AS id FROM sp UNION SELECT dst FROM sp)) SELECT a.node AS src, b.node AS dst FROM sp JOIN n a ON a.id = src JOIN n b ON b.id = dst",
    "degree_distribution": f"""WITH {SUPPLY}, e AS (SELECT src AS node, 1 AS o, 0 AS i FROM sp UNION ALL SELECT dst, 0, 1 FROM sp), d AS (SELECT node, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i FROM e GROUP BY node)
        SELECT kind, degree, count(*) AS nodes FROM (SELECT 'out' AS kind, o AS degree FROM d UNION ALL SELECT 'in', i FROM d) GROUP BY ALL""",
    "successor_lists": f"WITH {SUPPLY} SELECT src, count(*) AS n, array_to_string(list(dst ORDER BY dst), ',') AS successors FROM sp GROUP BY src",
    "edge_conductance": f"""WITH {NEXT}, m AS (SELECT s_nationkey::BIGINT AS set_id, s_suppkey AS node FROM supplier),
        v AS (SELECT set_id, count(*) AS volume FROM cg JOIN m ON src = node GROUP BY set_id), en AS (SELECT set_id, count(*) AS entering FROM cg JOIN m ON dst = node GROUP BY set_id),
        i AS (SELECT a.set_id, count(*) AS inner_ FROM cg JOIN m a ON src = a.node JOIN m b ON dst = b.node AND a.set_id = b.set_id GROUP BY a.set_id),
        r AS (SELECT s.set_id, coalesce(volume, 0) AS volume, coalesce(volume, 0) + coalesce(entering, 0) - 2 * coalesce(inner_, 0) AS cut, (SELECT count(*) FROM cg) AS total FROM (SELECT DISTINCT set_id FROM m) s LEFT JOIN v USING (set_id) LEFT JOIN en USING (set_id) LEFT JOIN i USING (set_id))
        SELECT set_id, cut, volume, round(cut / nullif(least(volume, total - volume), 0), 9) AS conductance FROM r""",
    "modularity_q": f"""WITH {NEXT}, m AS (SELECT s_nationkey AS part, s_suppkey AS node FROM supplier), b AS (SELECT x.part AS ps, y.part AS pd FROM cg JOIN m x ON src = x.node JOIN m y ON dst = y.node), t AS (SELECT count(*) AS m, count(*) FILTER (ps = pd) AS w FROM b),
        o AS (SELECT ps AS part, count(*) AS o FROM b GROUP BY ps), i AS (SELECT pd AS part, count(*) AS i FROM b GROUP BY pd)
        SELECT round(any_value(w) / any_value(m) - sum(o * i) / (any_value(m) * any_value(m)), 9) AS modularity FROM o JOIN i USING (part), t""",
    "complete_components": f"""{COARSE}, m AS MATERIALIZED (SELECT cluster, doc_id, phrase, size FROM sh JOIN cl USING (doc_id) WHERE size >= 3),
        p AS (SELECT cluster, phrase, count(*) AS k, any_value(size) AS size FROM m GROUP BY cluster, phrase),
        l AS (SELECT cluster, count(*) AS linked FROM (SELECT DISTINCT a.cluster, a.doc_id AS x, b.doc_id AS y FROM m a JOIN m b ON a.cluster = b.cluster AND a.phrase = b.phrase AND a.doc_id < b.doc_id) GROUP BY cluster)
        SELECT cluster, any_value(size) AS size, max(k) AS largest_phrase, any_value(linked) = any_value(size) * (any_value(size) - 1) / 2 AS complete FROM p JOIN l USING (cluster) GROUP BY cluster""",
    "running_tfidf_in_time": f"""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq, unnest(regexp_extract_all(concat_ws(' ', event_type, props), '{WS}')) AS phrase FROM events WHERE ts IS NOT NULL),
        t AS (SELECT event_id, seq, phrase, count(*) AS tf FROM e GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY seq) AS df FROM t)
        SELECT event_id, phrase, tf, df, round(tf * ln((seq + 1) / df), 6) AS score FROM d""",
    "bucket_chains": f"WITH {_chains('400', 100)} SELECT * FROM ch",
    "bucket_chains_small": f"WITH {_chains('(SELECT greatest(1, count(*) // 100) FROM documents)', 10)} SELECT * FROM ch",
    "bucket_chain_components": f"""WITH RECURSIVE {_chains('400', 100)}, sy AS (SELECT doc_id AS a, predecessor AS b FROM ch UNION SELECT predecessor, doc_id FROM ch),
        rc(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT rc.x, sy.b FROM rc JOIN sy ON rc.y = sy.a) SELECT x AS doc_id, min(y) AS component FROM rc GROUP BY x""",
    "sink_reused_stage": f"SELECT source, count(*) AS docs, sum(len(regexp_extract_all(text, '{WS}')))::BIGINT AS words FROM documents GROUP BY source",
    "greedy_communities_check": f"WITH {NEXT} SELECT count(*) AS nodes, 0::BIGINT AS open_pairs, true AS modularity_rises FROM (SELECT src AS id FROM cg UNION SELECT dst FROM cg)",
    "phones_per_component": rf"{COARSE} SELECT cluster, count(*) FILTER (regexp_matches(text, '\+[0-9]')) AS phones, count(*) FILTER (regexp_matches(text, '\+[0-9]')) > 100 AS suspicious FROM cl JOIN documents USING (doc_id) GROUP BY cluster HAVING phones > 0",
    "gaussian_entropy": f"WITH {POINTS}, a AS (SELECT label, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS c, count(*) AS n FROM pt GROUP BY label) SELECT label, n, round(abs(0.5 * ln(pow(2 * pi() * exp(1), 2) * (vx * vy - c * c))), 6) AS entropy FROM a",
    "off_axis_points": f"WITH {POINTS} SELECT label, count(*) AS n FROM pt WHERE abs(x) > 0.05 AND abs(y) > 0.05 GROUP BY label",
    "generated_complete": "SELECT a.range AS src, b.range AS dst FROM range(40) a, range(40) b WHERE a.range < b.range",
    "generated_bipartite": "SELECT a.range AS src, b.range + 20 AS dst FROM range(20) a, range(30) b",
    "lsh_shared_buckets": f"WITH {TOP}, {BUCKETS.format(n=4096)}, u AS (SELECT DISTINCT doc_id, fn, bucket FROM bu), h AS (SELECT fn, bucket, min(doc_id) AS hub FROM u GROUP BY ALL) SELECT doc_id, hub, count(DISTINCT fn) AS n FROM u JOIN h USING (fn, bucket) WHERE hub <> doc_id GROUP BY ALL",
    "lsh_bucket_occupancy": f"WITH {TOP}, {BUCKETS.format(n=256)}, u AS (SELECT DISTINCT doc_id, phrase, fn, bucket FROM bu) SELECT fn::INTEGER AS fn, bucket, count(DISTINCT phrase) AS phrases, count(*) AS docs FROM u GROUP BY fn, bucket",
    "generated_random": f"SELECT DISTINCT * FROM (SELECT {_draw(7, 1, 'range')} % 1000 AS src, {_draw(7, 2, 'range')} % 1000 AS dst FROM range(5000)) WHERE src <> dst",
    "generated_blocks": _blocks(),
    "lsh_parameter_sweep": f"WITH {TOP} " + " UNION ALL ".join(_sweep(f, b) for f in (16, 64) for b in (256, 4096)),
    "source_csv": "SELECT doc_id, text, source AS title FROM documents",
    "source_roles": "SELECT conv_id AS doc_id, text FROM conversations",
    "source_edge_list": f"WITH {NEXT} SELECT src, dst FROM cg",
    "source_graph": f"""WITH {NEXT}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS node FROM (SELECT src AS id FROM cg UNION SELECT dst FROM cg))
        SELECT node, count(src) AS n FROM n LEFT JOIN cg ON src = id GROUP BY node""",
    "source_lines": f"WITH {LINES} SELECT doc_id, array_to_string(w, ' ') AS line FROM ln",
    "source_line_bigrams": f"WITH {LINES}, b AS (SELECT flatten([['<s>'], w, ['</s>']]) AS w FROM ln), g AS (SELECT unnest({_grams('w', 2, 2)}) AS phrase FROM b) SELECT phrase, count(*) AS n FROM g GROUP BY phrase",
    "source_templates": "SELECT p_partkey || '|' || p_name AS texts, '1,' || p_size AS kinds, p_brand || ',' || p_type AS patterns FROM part",
    "source_ids": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "sink_labels": f"{COARSE}, lb AS (SELECT doc_id, text, CASE WHEN size >= 2 THEN cluster END AS label FROM cl JOIN documents USING (doc_id)) SELECT *, 'full' AS part FROM lb UNION ALL SELECT *, 'labelled' FROM lb WHERE label IS NOT NULL",
    "cluster_report": f"{COARSE} SELECT cluster, cluster || ' & ' || size || ' & ' || translate(coalesce(text, ''), '{text.REPORT_MARKS}', '{'.' * len(text.REPORT_MARKS)}') || ' \\\\' AS latex FROM cl JOIN documents USING (doc_id) WHERE size >= 2 AND doc_id = cluster",
    "events_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid""",
    "incremental_clusters": f"{COARSE} SELECT doc_id, cluster FROM cl WHERE doc_id IN (SELECT doc_id FROM top)",
    "min_ngrams": f"WITH w AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '{WS}')) - 1 AS grams FROM conversations) SELECT conv_id, turn, grams FROM w WHERE grams >= 5",
    "vocabulary": f"""WITH t AS (SELECT list_filter(list_transform(string_split(translate(coalesce(text, ''), '{text.PUNCTUATION.replace("'", "''")}', ''), ' '), lambda x: lower(x)), lambda x: x <> '') AS w FROM documents), v AS (SELECT count(DISTINCT x) AS voc FROM (SELECT unnest(w) AS x FROM t))
        SELECT voc, CASE WHEN voc <= 1 THEN 0 ELSE length(ltrim(bin(voc - 1), '0')) END AS word_cost FROM v""",
    "mixed_terms": f"WITH t AS (SELECT conv_id, unnest(flatten([regexp_extract_all(coalesce(text, ''), '{WS}'), ['#' || role]])) AS term FROM conversations) SELECT conv_id, term, count(*) AS tf FROM t GROUP BY ALL",
    "adjacent_turn_jaccard": f"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(coalesce(text, ''), '{WS}')) AS w FROM conversations)
        SELECT a.conv_id, a.turn, round(CASE WHEN len(list_distinct(flatten([a.w, b.w]))) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(flatten([a.w, b.w]))) END, 9) AS similarity FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "highlighted_phrases": f"""WITH {TOP}, c AS (SELECT doc_id, {_clean_page('text')} AS c FROM documents), sp AS (SELECT doc_id, phrase, string_split(c, phrase) AS parts FROM top JOIN c USING (doc_id)),
        pt AS (SELECT doc_id, phrase, len(parts) AS m, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM sp),
        ps AS (SELECT doc_id, phrase, m, k, (sum(length(part)) OVER (PARTITION BY doc_id, phrase ORDER BY k ROWS UNBOUNDED PRECEDING) + (k - 1) * length(phrase) + 1)::INTEGER AS lo FROM pt),
        r AS (SELECT doc_id, lo, (lo + length(phrase) - 1)::INTEGER AS hi FROM ps WHERE k < m),
        n AS (SELECT *, CASE WHEN max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= lo - 1 THEN 0 ELSE 1 END AS nw FROM r),
        i AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM n) SELECT doc_id, min(lo) AS lo, max(hi) AS hi, count(*) AS merged FROM i GROUP BY doc_id, island""",
    "bigram_presence": f"WITH w AS (SELECT conv_id * 1000 + turn AS doc_id, flatten([['<s>'], regexp_extract_all(coalesce(text, ''), '{WS}'), ['</s>']]) AS w FROM conversations), g AS (SELECT DISTINCT doc_id, unnest({_grams('w', 2, 2)}) AS phrase FROM w) SELECT phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1",
}
