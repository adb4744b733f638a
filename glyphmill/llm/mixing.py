"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Targets are found by filling up: all sources get weight x one common level, those that would pass `max_repeat` times their
size stop there. Blocks of equal word numbers go to the sources by highest quotients target / (2 k + 1), and a source's blocks
go to its shards by highest quotients of the shards' sizes, which gives each shard an integer quota. In a shard the documents
stand in seeded order, their words are cut into blocks, and the quota takes blocks from a seeded block onwards, around the end and
as many times over as it needs. So the words that each document gives follow from running sums, without a row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize, null_key, one

WORDS = r"[^\x20\x09-\x0D]+"


def hash32(c: Column) -> Column:
    """The first 32 bits of the MD5, as a long: the same in any engine."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long")


def highest_quotients(items: DataFrame, group: str, order: str, votes: str, seats: str) -> DataFrame:
    """`items` with a column quota: `seats` (equal within a group) apportioned to the group's items by Sainte-Laguë.

    Votes are at least 0; ties go to the first by `order`; groups without votes get nothing. Each item's quota lies within one of the
    bounds computed from a divisor that is at most half a seat per item off, so only a few quotients per item are ranked.
    """
    w = Window.partitionBy(group)
    share = F.col("__votes") / F.col("__total")
    bounds = (
        items.where(f"`{votes}` > 0")
        .withColumn("__votes", F.col(votes).cast("double"))
        .withColumn("__total", F.sum("__votes").over(w))
        .withColumn("__half", F.count(F.lit(1)).over(w) / 2)
        .withColumn("__low", F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("__half")) + 0.5) - 1).cast("long"))
        .withColumn("__high", (F.floor(share * (F.col(seats) + F.col("__half")) + 0.5) + 1).cast("long"))
        .withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    )
    bids = bounds.select(group, order, "__left", "__low", "__votes", F.explode(F.sequence("__low", "__high")).alias("__k"))
    ranked = bids.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.col("__votes") / (2 * F.col("__k") + 1)), order, "__k")))
    quotas = ranked.groupBy(group, order).agg((F.first("__low") + F.sum((F.col("__rank") <= F.col("__left")).cast("long"))).alias("quota"))
    return items.join(quotas, [group, order], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, block_words: int = 16, shard_docs: int = 500, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, size, source_size, target, taken (and those in `keep`), one row per row of `docs`.

    size: words of the text (null: 0). Sources in code-point order, null last as a source of its own, weigh `weights`, repeating.
    taken: words that the mix takes from the document, repeats counted, between 0 and `max_repeat` x size. Documents without
    words give none. Blocks hold `block_words` words. Rows that share an id stand next to each
    other, by size; identical rows are exchangeable. The result depends on ids, sources, sizes and the seed only.

    A source's documents are dealt to shards of about `shard_docs` by a hash, and its shards to groups, about as many as shards in a
    group, so no task holds a whole source, nor all its shards: blocks go to groups first, then to a group's shards.
    Sources are few. Sizes are written once, so the texts are read once.
    """
    keys = one(docs, id, source, text, *keep).select(F.col(f"`{id}`").alias("doc_id"), null_key(F.col(f"`{source}`")).alias("skey"), F.coalesce(F.regexp_count(f"`{text}`", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), *[F.col(f"`{k}`") for k in keep])
    sized = materialize(keys, "mix-sizes")
    sources = _targets(sized, weights, max_repeat)
    total = F.sum("source_size").over(Window.partitionBy("one"))
    blocks = sources.withColumn("one", F.lit(1)).withColumn("seats", F.floor(total / block_words + 0.5).cast("long"))
    n = F.ceil(F.col("n") / shard_docs)
    shared = highest_quotients(blocks, "one", "skey", "target", "seats").select("skey", "source_size", "target", F.col("quota").alias("seats"), F.ceil(F.sqrt(n)).cast("long").alias("groups"), F.ceil(n / F.ceil(F.sqrt(n))).cast("long").alias("each"))
    shared = materialize(shared, "mix-sources")
    r = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    dealt = sized.withColumn("r", r).join(shared, "skey").withColumn("shard", F.pmod(F.conv(F.substring("r", 1, 8), 16, 10).cast("long"), F.col("groups") * F.col("each")))
    shards = materialize(dealt.groupBy("skey", F.floor(F.col("shard") / F.col("each")).alias("group"), "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats")), "mix-shards")
    groups = highest_quotients(shards.groupBy("skey", "group").agg(F.sum("shard_size").alias("votes"), F.first("seats").alias("seats")), "skey", "group", "votes", "seats")
    own = shards.drop("seats").join(groups.select("skey", "group", F.col("quota").alias("seats")), ["skey", "group"]).withColumn("gkey", F.concat("skey", F.lit(":"), F.col("group").cast("string")))
    quotas = highest_quotients(own, "gkey", "shard", "shard_size", "seats").select("skey", "shard", "shard_size", "quota")
    placed = dealt.withColumn("hi", F.sum("size").over(Window.partitionBy("skey", "shard").orderBy("r", "size").rowsBetween(Window.unboundedPreceding, 0)))
    q = placed.join(materialize(quotas, "mix-quotas"), ["skey", "shard"])
    words = F.least(F.col("quota") * block_words, F.lit(max_repeat) * F.col("shard_size"))
    q = q.withColumn("words", words).withColumn("full", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long")).withColumn("rest", F.col("words") - F.col("full") * F.col("shard_size"))
    begin = F.pmod(hash32(F.concat(F.lit(seed + ":"), "skey", F.lit(":"), F.col("shard").cast("string"))), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words))) * block_words
    q = q.withColumn("a", begin.cast("long")).withColumn("lo", F.col("hi") - F.col("size"))
    part = lambda a, b: F.greatest(F.lit(0), F.least(F.col("hi"), b) - F.greatest(F.col("lo"), a))
    taken = F.col("full") * F.col("size") + part(F.col("a"), F.least(F.col("a") + F.col("rest"), F.col("shard_size"))) + part(F.lit(0), F.col("a") + F.col("rest") - F.col("shard_size"))
    return q.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"`{k}`") for k in keep])


def _targets(sized: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """Per source: n, source_size and target, one row each. The common level is the largest of the levels that the sources, in the
    order in which they reach their stop, would give if all before them had stopped."""
    every = Window.partitionBy("one")
    before = every.orderBy(F.col("cap") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    listed = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    listed = listed.withColumn("k", F.row_number().over(every.orderBy(F.desc(F.col("skey").startswith("v")), "skey")) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("cap", max_repeat * F.col("source_size"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = listed.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return filled.select("skey", "n", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _quotient_sql(items: str, group: str, order: str, votes: str, seats: str) -> str:
    return f"""
(WITH b AS (SELECT {group} AS g, {order} AS o, {votes}::DOUBLE AS v, {seats} AS n,
                   sum({votes}::DOUBLE) OVER (PARTITION BY {group}) AS t, count(*) OVER (PARTITION BY {group}) / 2 AS h
            FROM {items} WHERE {votes} > 0),
 lo AS (SELECT *, greatest(0, floor(v / t * (n - h) + 0.5) - 1)::BIGINT AS low, (floor(v / t * (n + h) + 0.5) + 1)::BIGINT AS high FROM b),
 le AS (SELECT *, n - sum(low) OVER (PARTITION BY g) AS seats_left FROM lo),
 bid AS (SELECT g, o, v, low, seats_left, unnest(generate_series(low, high)) AS k FROM le),
 rk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v / (2 * k + 1) DESC, o, k) AS rn FROM bid)
 SELECT g, o, (any_value(low) + sum((rn <= seats_left)::BIGINT))::BIGINT AS quota FROM rk GROUP BY g, o)"""


ORACLE = rf"""
WITH sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS skey,
                      coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                      md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS r FROM documents),
s1 AS (SELECT skey, sum(size)::BIGINT AS source_size, count(*) AS n, 1 AS one FROM sized GROUP BY skey),
s2 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey = 'n', skey) - 1) % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
       FROM s2 WINDOW w AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, least(cap::DOUBLE, max(level) OVER () * weight) AS target, sum(source_size) OVER () AS total FROM s3),
s6 AS (SELECT *, floor(total / 16 + 0.5)::BIGINT AS n_blocks FROM s4),
s7 AS {_quotient_sql("s6", "one", "skey", "target", "n_blocks")},
src AS (SELECT s6.*, coalesce(s7.quota, 0) AS seats, ceil(sqrt(ceil(n / 500)))::BIGINT AS groups, ceil(ceil(n / 500) / ceil(sqrt(ceil(n / 500))))::BIGINT AS each FROM s6 LEFT JOIN s7 ON s6.skey = s7.o),
dealt AS (SELECT d.*, src.source_size, src.target, src.seats, ('0x' || substr(r, 1, 8))::BIGINT % (src.groups * src.each) AS shard, src.each FROM sized d JOIN src USING (skey)),
sh0 AS (SELECT skey, shard // each AS grp, shard, sum(size)::BIGINT AS shard_size, any_value(seats) AS seats FROM dealt GROUP BY ALL),
gr AS (SELECT skey, grp, sum(shard_size)::BIGINT AS group_size, any_value(seats) AS seats FROM sh0 GROUP BY ALL),
gq AS {_quotient_sql("gr", "skey", "grp", "group_size", "seats")},
sh AS (SELECT skey, shard, shard_size, skey || ':' || sh0.grp AS gkey, coalesce(gq.quota, 0) AS seats FROM sh0 LEFT JOIN gq ON sh0.skey = gq.g AND sh0.grp = gq.o),
qt AS {_quotient_sql("sh", "gkey", "shard", "shard_size", "seats")},
sq AS (SELECT sh.*, least(coalesce(qt.quota, 0) * 16, 3 * sh.shard_size) AS words FROM sh LEFT JOIN qt ON sh.gkey = qt.g AND sh.shard = qt.o),
sa AS (SELECT skey, shard, shard_size, words, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS times,
              (('0x' || substr(md5('mix:' || skey || ':' || shard), 1, 8))::BIGINT % greatest(1, ceil(shard_size / 16)::BIGINT)) * 16 AS a FROM sq),
pl AS (SELECT *, sum(size) OVER (PARTITION BY skey, shard ORDER BY r, size ROWS UNBOUNDED PRECEDING) AS hi FROM dealt),
j AS (SELECT pl.*, hi - size AS lo, shard_size, times, words - times * shard_size AS rest, a FROM pl JOIN sa USING (skey, shard))
SELECT doc_id, size, source_size, target,
       (times * size + greatest(0, least(hi, least(a + rest, shard_size)) - greatest(lo, a)) + greatest(0, least(hi, a + rest - shard_size) - lo))::BIGINT AS taken
FROM j
"""
