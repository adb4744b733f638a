import hashlib

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
from glyphmill.llm import byte_bpe, langid, line_dedup, mixing

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).columns == list(corpus_pipeline.COLUMNS), name


def test_run_equals_brute_force(spark):
    from test_joins_and_archives import brute_jaccard
    from test_text_operators import brute_lines

    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(table.where(~langid.held_out(F.col("doc_id"))))
    names, scores = langid.score_texts(model, [d["text"] for d in docs])
    docs = [d for d, n, s in zip(docs, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.MIN_SCORE]
    lines = {i: (t, gone) for i, t, _, gone in brute_lines([(d["doc_id"], d["text"]) for d in docs])}
    docs = [d | {"text": lines[d["doc_id"]][0]} for d in docs if lines[d["doc_id"]][0] != "" or not lines[d["doc_id"]][1]]
    first = {i for i, _, c in brute_jaccard([(d["doc_id"], d["text"]) for d in docs]) if i == c}
    docs = [d for d in docs if d["doc_id"] in first]
    mixed = mixing.mix(spark.createDataFrame([(d["doc_id"], d["source"], d["text"]) for d in docs], "doc_id long, source string, text string")).collect()
    times = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixed}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.MergeTable.load(P.path("byte_bpe_50k.tiktoken")).ranks, special_tokens={})
    want = sorted((d["doc_id"], library.encode_ordinary(d["text"]), hashlib.sha256(d["text"].encode()).hexdigest()) for d in docs for _ in range(times[d["doc_id"]]))
    got = sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len({g[0] for g in got}) > 100


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("root", F.lit("clash")).withColumn("times", F.lit("clash"))


def test_near_duplicates_keep_one_row_where_ids_repeat_or_are_null(spark):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    other, third = "quite another text of its own kind in every single word here", "and a third text that nothing else in the table is like"
    rows = [(5, near, "en", "a", 1), (5, near, "en", "a", 1), (7, near + " more", "en", "a", 1), (5, other, "en", "a", 1), (None, other, "en", "b", 1), (None, third, "en", "b", 1), (None, third, "en", "b", 1), (8, None, None, None, None), (9, "", "en", "c", 0), (9, " ", "en", "c", 0)]
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted([(False, 5, near), (False, 5, other), (True, 0, third), (False, 8, ""), (False, 9, ""), (False, 9, " ")])


def test_stages_take_empty_tables_nulls_and_clashing_names(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (None, "some words in no language", None, "s", 25), (2, "a\nb\nc", "xx", None, 5), (2, "a\nb\nc", "xx", None, 5)]
    for docs in (table(spark, rows), table(spark, rows).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() <= 3 * len(rows), name
        assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()


def test_registered_once_each():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {"op3_line_dedup", "op4_mixing", "op6_vector_join", "op7_jaccard_join", "op11_spelling", "op12_resampling"} <= set(__spark_entry__.oracle_sql())
    assert line_dedup.WINDOW == 3
