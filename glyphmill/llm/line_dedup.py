"""Line deduplication by overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines form a window, known by the MD5 of its text. Of equal windows anywhere in the table the first
one stays (by doc_id, nulls last, then by the text's MD5, then by position); a line that any later occurrence covers is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import null_key, one

WINDOW = 3
BLANK = " \t\n\r\x0b\x0c"


def line_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, text, n_lines, n_removed (and those in `keep`): one row per row of `docs`, the text without removed lines.

    Lines are what stands between newlines. Texts with fewer than three lines have no window and stay as they are; windows
    of blank lines only don't count. Null text stays null with 0 lines; empty text has one line. Rows that repeat id and text
    are the same occurrence, so neither removes the other's lines; equal texts under different ids lose all windows but
    the first one's. A document can lose all its lines (the text is then empty). An empty table gives an empty result.

    Only digests and positions are shuffled, beside one shuffle of the texts to the lines that they lose. A window that a
    third of the documents hold is summed in the tasks first; the join back to it is one that adaptive execution can split.
    """
    source = one(docs, id, text, *keep).withColumnsRenamed({id: "doc_id", text: "text"})
    h = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = source.withColumn("row_key", F.concat(null_key(F.col("doc_id")), F.when(F.col("text").isNull(), ":n:").otherwise(":t:"), h))
    lines = F.split("text", "\n", -1)
    marks = keyed.where("text is not null").select("row_key", F.col("doc_id").isNull().alias("last"), "doc_id", lines.alias("l")).where(F.size("l") >= WINDOW)
    window = lambda i: F.array_join(F.slice("l", i + 1, WINDOW), "\n")
    digest = F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), lambda i: F.when(F.translate(window(i), BLANK, "") != "", F.unhex(F.md5(window(i).cast("binary")))))
    windows = marks.select("row_key", "last", "doc_id", F.posexplode(digest).alias("pos", "digest")).where("digest is not null")
    place = F.struct("last", "doc_id", "row_key", "pos")
    first = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    later = windows.join(first, "digest").where((F.col("row_key") != F.col("first.row_key")) | (F.col("pos") != F.col("first.pos"))).select("row_key", "pos")
    covered = later.groupBy("row_key").agg(F.flatten(F.collect_set(F.sequence(F.col("pos"), F.col("pos") + WINDOW - 1))).alias("covered")).withColumn("covered", F.array_distinct("covered"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("l"))
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), "covered")
    joined = keyed.join(covered, "row_key", "left").withColumn("l", lines)
    pruned = F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("l", i)), "\n"))
    return joined.select("doc_id", pruned.alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"), *[F.col(f"`{k}`") for k in keep]).withColumn("n_removed", F.greatest(F.col("n_removed"), F.lit(0)))


ORACLE = r"""
WITH src AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(len(l) - 2)) AS pos, l FROM src WHERE len(l) >= 3),
k AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS win FROM w),
m AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM k
      WHERE translate(win, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> ''),
c AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS covered FROM m WHERE rn > 1 GROUP BY doc_id)
SELECT s.doc_id,
       CASE WHEN c.covered IS NULL THEN s.text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(len(s.l)), lambda i: NOT list_contains(c.covered, i)), lambda i: s.l[i + 1]), chr(10)), '') END AS text,
       coalesce(len(s.l), 0)::BIGINT AS n_lines, coalesce(len(c.covered), 0)::BIGINT AS n_removed
FROM src s LEFT JOIN c USING (doc_id)
"""
