"""Exact near-duplicate join of embeddings: a metric range join over pivot cells.

On unit vectors a cosine of c or more is a distance of r = sqrt(2 - 2c) or less. Each vector lives in the cell of its nearest
pivot; it also visits each cell that the triangle inequality can't rule out: cell j only if d(v, p_j) <= R_j + r, where R_j is
the largest distance of a resident from its pivot, and if the vector lies within r of the plane between its own pivot and p_j, which each
resident of cell j within r of it would have to lie beyond: (d(v, p_j)^2 - d(v, p_home)^2) / (2 d(p_home, p_j)) <= r. Of two cells only one
direction is needed.
Cells are cut into blocks of bounded size, and each block joins its residents with a stream of visitors, in double precision.

No pairs leave a block: it gives the number of links of each vector, and edges of a spanning forest for the components. In high
dimensions without clusters the bounds rule out little, and the work is that of comparing all blocks; the result is exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import discard, materialize, one
from glyphmill.operators.components import components

BLOCK = 4096  # residents of a block; a vector is sent once to each block that it may have links in
SLACK = 1e-7  # rounding of distances; only ever adds visits


@dataclass
class Cells:
    """Pivots of vectors of one length, with the radius and the number of blocks of each cell."""

    pivots: np.ndarray
    first_unit: np.ndarray
    blocks: np.ndarray
    radius: np.ndarray
    apart: np.ndarray  # distances of pivots from each other


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, 128 bits of hash and components as doubles; hashes and components are null for vectors that link with nothing."""
    import xxhash

    for batch in batches:
        lists = batch.column(1)
        flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # null is not a number; -0.0 and 0.0 are equal
        edges = lists.offsets.to_numpy()
        high, low, raws = [], [], []
        for a, b, there in zip(edges[:-1].tolist(), edges[1:].tolist(), lists.is_valid().to_pylist(), strict=True):
            x = flat[a:b]
            if there and len(x) and np.isfinite(x).all() and x.any():
                raws.append(x.tobytes())
                h = xxhash.xxh3_128_digest(raws[-1])
                high.append(int.from_bytes(h[:8], "big", signed=True))
                low.append(int.from_bytes(h[8:], "big", signed=True))
            else:
                for column in (high, low, raws):
                    column.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(raws, pa.binary())], ["vec_id", "high", "low", "raw"])


def _unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), float).reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _mixed(key: np.ndarray) -> np.ndarray:
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, row numbers, unit vectors) for each vector length in the batch."""
    raws = batch.column(column).to_pylist()
    sizes = np.array([len(r) // 8 for r in raws])
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, _unit([raws[i] for i in at])


def vector_components(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", min_cosine: float = 0.95, cell_size: int = BLOCK, max_pivots: int = 1024) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept: one row per row of `vectors`.

    n_links counts other rows with a cosine of `min_cosine` or more, copies included; component_id is the smallest vec_id reachable by
    links. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths with
    each other. Equal vectors (by 128 bits of hash) are one node, known by its number, that counts as many rows. A null id is smallest only if all of its component's are.
    At most `max_pivots` pivots, chosen by a hash of the vectors, are broadcast. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    source = one(vectors, id, embedding).toDF("vec_id", "embedding")
    kind = source.schema["vec_id"].dataType.simpleString()
    rows = source.mapInArrow(_rows, f"vec_id {kind}, high long, low long, raw binary")
    distinct = rows.where("high is not null").groupBy("high", "low").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
    nodes = materialize(distinct.withColumn("key", F.monotonically_increasing_id()), "vector-nodes")  # numbers stay as written
    ids = materialize(rows.select("vec_id", "high", "low").join(nodes.select("high", "low", "key"), ["high", "low"], "left").select("vec_id", "key"), "vector-ids")
    radius = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    cells = _cells(nodes, cell_size, max_pivots)
    sent = spark.sparkContext.broadcast(cells)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch, 2):
                c = sent.value[d]
                far = _distances(x, c.pivots)
                home = far.argmin(axis=1)
                near = far[np.arange(len(x)), home]
                key = batch.column(0).to_numpy()[at]
                block = _mixed(key) % c.blocks[home].astype(np.uint64)
                unit = c.first_unit[home] + block.astype(np.int64)
                apart = c.apart[home]
                beyond = far * far - (near * near)[:, None] <= 2 * apart * (radius + SLACK) + SLACK
                visit = (far <= c.radius + radius + SLACK) & (beyond | (apart < 1e-6))
                visit[np.arange(len(x)), home] = True
                who, cell = np.nonzero(visit)
                reps = c.blocks[cell]
                who, to = np.repeat(who, reps), np.repeat(c.first_unit[cell], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                own = unit[who]
                go = (to != own) & (((to + own) % 2 == 1) == (own < to))  # each two blocks meet once, evenly dealt
                who, to = who[go], to[go]
                take, target, role = np.r_[np.arange(len(x)), who], np.r_[unit, to], np.r_[np.zeros(len(x), np.int8), np.ones(len(who), np.int8)]
                for s in range(0, len(take), 20_000):
                    rows = pa.array(at[take[s : s + 20_000]])
                    yield pa.RecordBatch.from_arrays([pa.array(target[s : s + 20_000]), pa.array(role[s : s + 20_000]), *(batch.column(i).take(rows) for i in range(3))], ["unit", "role", "key", "copies", "raw"])

    routed = nodes.select("key", "copies", "raw").mapInArrow(route, "unit long, role tinyint, key long, copies long, raw binary")
    dealt = routed.repartition("unit").sortWithinPartitions("unit", "role")
    found = materialize(dealt.mapInArrow(lambda b: _join(b, min_cosine), "a long, b long, n long"), "vector-links")
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    placed = materialize(nodes.select("key", "rep", "copies").join(links, "key", "left").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")), "vector-placed")
    discard(found, roots, nodes)
    smallest = placed.groupBy("root").agg(F.min("rep").alias("smallest"))
    by_key = placed.join(smallest, "root").select("key", "n_links", "smallest")
    out = ids.join(by_key, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("smallest")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _cells(nodes: DataFrame, cell_size: int, max_pivots: int) -> dict[int, Cells]:
    """Pivots by length, and what a pass over all vectors finds of their cells."""
    spark = nodes.sparkSession
    lengths = {r["d"]: r["n"] for r in nodes.groupBy((F.octet_length("raw") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for d, n in lengths.items():
        sample = nodes.where(F.octet_length("raw") == 8 * d).orderBy(F.xxhash64(F.lit("pivot"), "key"), "key").limit(max(1, min(max_pivots, n // cell_size))).select("raw").collect()
        pivots[d] = _unit([bytes(r["raw"]) for r in sample])
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in _by_length(batch, 0):
                far = _distances(x, sent.value[d])
                home = far.argmin(axis=1)
                cells, counts = np.unique(home, return_counts=True)
                reach = [float(far[home == c, c].max()) for c in cells]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), d, np.int32)), pa.array(cells.astype(np.int32)), pa.array(reach), pa.array(counts.astype(np.int64))], ["d", "cell", "r", "n"])

    found = nodes.select("raw").mapInArrow(assign, "d int, cell int, r double, n long").groupBy("d", "cell").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect()  # one row per pivot
    out, unit = {}, 0
    for d, p in sorted(pivots.items()):
        blocks, reach = np.ones(len(p), np.int64), np.zeros(len(p))
        for row in found:
            if row["d"] == d:
                blocks[row["cell"]], reach[row["cell"]] = -(-row["n"] // cell_size), row["r"]
        out[d] = Cells(p, unit + np.cumsum(blocks) - blocks, blocks, reach, _distances(p, p))
        unit += int(blocks.sum())
    return out


class _Block:
    """The residents of a block, how many links each has, and which of them are known to be connected."""

    def __init__(self, keys: np.ndarray, copies: np.ndarray, x: np.ndarray):
        self.keys, self.copies, self.x = keys, copies, x
        self.links, self.root = np.zeros(len(keys), np.int64), np.arange(len(keys))

    def _unite(self, groups: np.ndarray, members: np.ndarray) -> None:
        """members that share a group (ascending) get one root."""
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        roots = self.root[members]
        low = np.repeat(np.minimum.reduceat(roots, starts), np.diff(np.r_[starts, len(groups)]))
        for a, b in set(zip(roots[low != roots].tolist(), low[low != roots].tolist(), strict=True)):
            while self.root[a] != a:
                a = self.root[a]
            while self.root[b] != b:
                b = self.root[b]
            self.root[max(a, b)] = min(a, b)
        while (flat := self.root[self.root]).tolist() != self.root.tolist():
            self.root = flat

    def meet(self, keys: np.ndarray, copies: np.ndarray, x: np.ndarray, least: float, own_from: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts links with `x`; returns each visitor's links, and edges (visitor, resident). own_from: `x` are residents from that one on."""
        hit = x @ self.x.T >= least
        if own_from is not None:
            hit[np.arange(len(x)), own_from + np.arange(len(x))] = False
        v, h = np.nonzero(hit)
        if not len(v):
            return np.zeros(len(x), np.int64), keys[:0], keys[:0]
        counts = np.bincount(v, weights=self.copies[h], minlength=len(x)).astype(np.int64)
        if own_from is None:
            self.links += np.bincount(h, weights=copies[v], minlength=len(self.keys)).astype(np.int64)
            self._unite(v, h)
            first = np.r_[True, v[1:] != v[:-1]]
            return counts, keys[v[first]], self.keys[h[first]]
        self._unite(*_sorted(np.r_[v, v], np.r_[h, own_from + v]))
        self.links[own_from : own_from + len(x)] += counts
        return counts, keys[:0], keys[:0]


def _sorted(groups: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(groups, kind="stable")
    return groups[order], members[order]


def _join(batches: Iterator[pa.RecordBatch], least: float, step: int = 2048) -> Iterator[pa.RecordBatch]:
    """Rows (key, null, links) and (a, b, null) of blocks, each of whose residents come before its visitors."""
    block, unit, residents = None, None, []

    def close() -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(block.links)
        yield _out(block.keys[some], None, block.links[some])
        tied = np.flatnonzero(block.root != np.arange(len(block.keys)))
        yield _out(block.keys[tied], block.keys[block.root[tied]], None)

    def opened() -> _Block:
        keys, copies, raws = (np.concatenate([r[0] for r in residents]), np.concatenate([r[1] for r in residents]), [x for r in residents for x in r[2]])
        made = _Block(keys, copies, _unit(raws))
        for s in range(0, len(keys), step):
            made.meet(keys[s : s + step], copies[s : s + step], made.x[s : s + step], least, s)
        return made

    for batch in batches:
        units, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((units[1:] != units[:-1]) | (roles[1:] != roles[:-1])) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(units)], strict=True):
            if e == s:
                continue
            if units[s] != unit:
                if residents and block is None:
                    block = opened()
                if block is not None:
                    yield from close()
                block, unit, residents = None, units[s], []
            keys, copies, raws = batch.column(2).to_numpy()[s:e], batch.column(3).to_numpy()[s:e], batch.column(4).slice(s, e - s).to_pylist()
            if roles[s] == 0:
                residents.append((keys, copies, raws))
                continue
            if block is None:
                if not residents:
                    continue  # a cell without residents
                block = opened()
            for t in range(0, e - s, step):
                counts, a, b = block.meet(keys[t : t + step], copies[t : t + step], _unit(raws[t : t + step]), least)
                some = np.flatnonzero(counts)
                if len(some):
                    yield _out(keys[t : t + step][some], None, counts[some])
                    yield _out(a, b, None)
    if residents and block is None:
        block = opened()
    if block is not None:
        yield from close()


def _out(a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None) -> pa.RecordBatch:
    empty = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), empty if b is None else pa.array(b, pa.int64()), empty if n is None else pa.array(n, pa.int64())], ["a", "b", "n"])


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)
"""
