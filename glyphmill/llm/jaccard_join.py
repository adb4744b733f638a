"""Jaccard join of documents on word shingles by PartEnum signatures.

The sizes of sets fall into bands of a factor two. For each band the feature domain is partitioned by a hash, and the signatures of
a set are its projections onto subsets of the partitions: onto subsets of two in the bands of small sets (PAIRED), onto single ones in
the bands above, where the subsets of two would number the square of the differences that are allowed. Two sets of sizes x and y
with a Jaccard similarity of t or more differ in at most k = (1 - t) / (1 + t) * (x + y) features, so in at most k partitions. So in any order
of projections that is the same for all sets, the first j that two such sets share are among the first k + j non-empty ones of
either, if either has that many: then they share at least j. Only subsets of these are written. A set with fewer non-empty partitions also writes
each partition by itself, the empty ones included, which covers two such sets, as there are more than k partitions. The order puts projections that consist
of very frequent shingles last, so that passages that many documents share bring few documents together.

Equal sets are one node from the start, and of signatures that the same sets share one is kept. Then, twice, each set is checked against at
most two others: in each of its signatures' groups the sets stand by how much they share with others, and a set's likeliest
partners are the one that is most often the first of its groups and the one that most often stands before it, the set itself and
its component left out. What is connected then needs no more checks, and the last round checks all
pairs that share a signature and still lie in different components, in blocks of bounded size. All checks are exact, on whole sets;
texts of sets whose pairs hang together go to one place once, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import byte_slices, discard, materialize, one
from glyphmill.operators.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BITS = (256, 8192)  # the least and the greatest width of a parity
PAIRED = range(2, 5)  # bands whose signatures are of two partitions: sets of 4 to 31 features
BLOCK = 256
FAMILY = 256  # sets, and
FIRST = 8
LOAD = 2_000_000  # features of one block of sets that are checked together
BITMAP = 1 << 26  # bits: 8 MB
_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    y = x >> _U(30)  # the one array that is made, beside one for each of the later shifts
    y ^= x
    y *= _U(0xBF58476D1CE4E5B9)
    y ^= y >> _U(27)
    y *= _U(0x94D049BB133111EB)
    y ^= y >> _U(31)
    return y


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of the whole text as sorted 64-bit hashes; fewer words than `width` are one shingle, no words none."""
    import xxhash

    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, _U)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = len(h) - width + 1
    total = h[:n] * _MULTIPLIERS[0]
    for i in range(1, width):
        total = _mixed(total)
        total += h[i : i + n] * _MULTIPLIERS[i % 8]
    total = _mixed(total)
    total.sort()  # numpy's unique() hashes first, which takes four times as long
    return total[np.r_[True, total[1:] != total[:-1]]]


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for the set; n distinct sets have about n^2 / 2^65 collisions."""
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), _U).astype(np.int64))


def parity(s: np.ndarray) -> bytes:
    """How many features fall on each of some places, modulo 2: two sets' parities differ in no more places than the sets in features.

    There are about as many places as features, a power of two of them; the parity of half as many is the two halves' sum."""
    places = min(max(1 << (len(s) - 1).bit_length(), BITS[0]), BITS[1])
    return np.packbits(np.bincount((s >> _U(40)).astype(np.int64) % places, minlength=places).astype(np.uint8) & 1).tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def partitions(band: int, percent: int) -> int:
    """So many that a set of the band has, but for rare cases, enough non-empty ones; more than similar sets can differ in."""
    largest = 2 ** (band + 1) - 1
    differ = (100 - percent) * (largest + largest * 100 // percent) // (100 + percent)
    return max(64 if band in PAIRED else 16, int(0.85 * 2**band), differ + 1)


def _filter(hot: np.ndarray) -> np.ndarray:
    """Which of 2^20 leading bits the shingles of `hot` have, by the places from 2^44 on."""
    out = np.zeros(1 << 20, bool)
    out[hot >> _U(44)] = True
    return out


def _frequent(s: np.ndarray, hot: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of `s` are in the sorted `hot`, which is searched for those only whose leading bits it has."""
    out = bits[s >> _U(44)]
    maybe = s[out]
    out[out] = hot[np.minimum(np.searchsorted(hot, maybe), len(hot) - 1)] == maybe
    return out


def signatures(s: np.ndarray, hot: np.ndarray, percent: int, bits: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set in its own band and, if smaller sets of the band below can be similar enough, in that one.

    `bits` is _filter(hot), made once by those who have many sets."""
    n = len(s)
    if not n:
        return np.empty(0, _U)
    band = n.bit_length() - 1
    largest = n * 100 // percent  # sizes of similar sets: from n * percent / 100 to this
    often = _frequent(s, hot, _filter(hot) if bits is None else bits) if len(hot) else None
    value = _mixed(s ^ _MULTIPLIERS[5])
    out = [_signatures(value, often, band, percent, (100 - percent) * (n + largest) // (100 + percent))]
    if n * percent < 100 * 2**band and band:
        out.append(_signatures(value, often, band - 1, percent, (100 - percent) * (n + 2**band - 1) // (100 + percent)))
    return np.concatenate(out)


def _signatures(value: np.ndarray, often: np.ndarray | None, band: int, percent: int, k: int) -> np.ndarray:
    total = partitions(band, percent)
    part = ((value >> _U(33)) % _U(total)).astype(np.uint16 if total < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")  # by radix where there are 16 bits
    part = part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    sums, index = np.add.reduceat(value[order], starts), part[starts].astype(np.int64)
    if often is not None and often.any():
        last = np.logical_and.reduceat(often[order], starts)
        first = np.r_[np.flatnonzero(~last), np.flatnonzero(last)]
        sums, index = sums[first], index[first]
    single = _mixed(sums + _mixed((index.astype(_U) + _U(1)) * _MULTIPLIERS[6] + _U(band)))
    size = 2 if band in PAIRED else 1
    if size == 2:
        i, j = np.triu_indices(min(len(single), k + 2), 1)
        out = _mixed(single[i] + single[j] + _MULTIPLIERS[4])
    else:
        out = single[: k + 1]
    if len(single) < k + size:
        empty = np.setdiff1d(np.arange(total), index).astype(_U)
        out = np.concatenate([out, single if size == 2 else single[:0], _mixed((empty + _U(1)) * _MULTIPLIERS[7] + _U(band))])
    return out


def _describe(width: int) -> Callable:
    """doc_id, text_hash, n, key, bits of each document, and shingles that are frequent within a batch, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n", "key", "bits", "hot"]
        for batch in batches:
            for part in byte_slices(batch, 1, 32_000_000):
                sets = [shingles(t, width) for t in part.column(1).cast(pa.binary()).to_pylist()]
                n = len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([parity(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.int64())], names)
                every = np.sort(np.concatenate(sets))
                starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
                seen, counts = every[starts], np.diff(np.r_[starts, len(every)])
                often = np.flatnonzero(counts >= max(4, n // 2500))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(often), part.column(0).type), *[pa.nulls(len(often), pa.int64())] * 2, pa.array(seen[often].astype(np.int64)), pa.nulls(len(often), pa.binary()), pa.array(counts[often].astype(np.int64))], names)

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, key), those of signatures with more than one distinct key, once each, and a row without a key for each
    such signature, with the number of keys and the sum of their hashes modulo 2 by place.

    One row of state goes from batch to batch, however large a group is; a group's first row is written with its second."""

    def rows(sig, key, n=None, both=None) -> pa.RecordBatch:
        size = len(sig)
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.nulls(size, pa.int64()) if key is None else pa.array(key, pa.int64()), pa.nulls(size, pa.int64()) if n is None else pa.array(n, pa.int64()), pa.nulls(size, pa.int64()) if both is None else pa.array(both, pa.int64())], ["sig", "key", "n", "print"])

    held = None  # signature, last key, number of keys, print
    for batch in batches:
        sig, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        fresh = np.r_[held is None or sig[0] != held[0] or key[0] != held[1], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
        sig, key = sig[fresh], key[fresh]
        if not len(sig):
            continue
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        here = np.diff(np.r_[starts, len(sig)])
        n, both = here.copy(), np.bitwise_xor.reduceat(_mixed(key.view(_U)), starts).view(np.int64)
        if held is not None and sig[0] == held[0]:
            if held[2] == 1:
                yield rows([held[0]], [held[1]])
            n[0] += held[2]
            both[0] ^= held[3]
        elif held is not None and held[2] > 1:
            yield rows([held[0]], None, [held[2]], [held[3]])
        write = np.repeat(n > 1, here)
        yield rows(sig[write], key[write])
        done = n[:-1] > 1
        yield rows(sig[starts[:-1]][done], None, n[:-1][done], both[:-1][done])
        held = sig[-1], key[-1], n[-1], both[-1]
    if held is not None and held[2] > 1:
        yield rows([held[0]], None, [held[2]], [held[3]])


def _plausible(n1, n2, bits1: np.ndarray, bits2: np.ndarray, percent: int) -> np.ndarray:
    """False only where sizes or parities rule the similarity out."""
    differ = np.bitwise_count(bits1 ^ bits2).sum(axis=-1)
    return (np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent) & (differ * (100 + percent) <= (100 - percent) * (n1 + n2))


class Parities:
    """The parities of some rows, by width; narrower forms are made where they are asked for."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        self.words = np.array([len(b) // 8 for b in raw], np.int64)
        self.at, self.rows = np.zeros(len(raw), np.int64), {}
        for w in np.unique(self.words).tolist():
            of = np.flatnonzero(self.words == w)
            self.at[of] = np.arange(len(of))
            self.rows[w] = np.frombuffer(b"".join([raw[i] for i in of.tolist()]), _U).reshape(-1, w)

    def of(self, index: np.ndarray, words: int) -> np.ndarray:
        """The rows at `index`, which have `words` words or more each, in so many."""
        out = np.empty((len(index), words), _U)
        for w in np.unique(self.words[index]).tolist():
            here = np.flatnonzero(self.words[index] == w)
            out[here] = _folded(self.rows[w][self.at[index[here]]], words)
        return out


def _plausible_pairs(n: np.ndarray, bits: Parities, i: np.ndarray, m: np.ndarray, others: Parities, j: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of row i (sizes n) and row j (sizes m) which are plausible."""
    keep = np.minimum(n[i], m[j]) * 100 >= np.maximum(n[i], m[j]) * percent
    common = np.minimum(bits.words[i], others.words[j])
    for w in np.unique(common[keep]).tolist():
        at = np.flatnonzero(keep & (common == w))
        keep[at] = _plausible(n[i[at]], m[j[at]], bits.of(i[at], w), others.of(j[at], w), percent)
    return keep


def jaccard_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75, hot_size: int = 1 << 17, rounds: int = 2, detail: bool = False) -> DataFrame:
    """Columns doc_id, n_shingles, component_id: one row per row of `docs`. With `detail` also root, a number that only the rows of one
    component have, null without words, and text_hash, Spark's xxhash64 of the text: ids may repeat, so they need not tell rows apart.

    Documents link when 100 * |A and B| >= `percent` * |A or B| over their sets of `width`-word shingles; component_id is the smallest
    doc_id reachable by links. Equal sets link, whatever their texts' case and spacing. Documents without words (null, empty or
    blank text) link with nothing and are their own component. Rows that share an id are nodes of their own with that id; null ids
    are never the smallest unless all of a component's are null. Texts of any length are taken whole. At most `hot_size` frequent
    shingles (summed over all documents) are broadcast; they change the order of signatures, and `rounds` the order of checks, never the
    result. `percent` is at least 50, so that similar sets lie in the same band or in neighbouring ones.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    source = one(docs, id, text).toDF("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    described = materialize(source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_describe(width), f"doc_id {kind}, text_hash long, n long, key long, bits binary, hot long"), "jaccard-sets")
    info = described.where("hot is null").drop("hot")
    nodes = materialize(info.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies")), "jaccard-nodes")
    members = _shared(source, described, nodes, width, percent, hot_size)
    roots, tested, edges = None, [], []
    for last in [False] * rounds + [True]:
        rows = _across(members, roots)
        new, *read = _rest(rows, nodes, percent) if last else (_proposed(rows),)
        if tested:
            new = new.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
        if not last:
            new = new.groupBy("kind", "of").agg(F.max_by(F.struct("a", "b"), F.struct("weight", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        new = materialize(new, "jaccard-pairs")
        discard(rows, *read)
        tested.append(new)
        if new.isEmpty():
            break
        edges.append(_verified(source, nodes, _likely(nodes, new, percent), _by_family if last else _by_center, width, percent))
        discard(roots)
        roots = components(reduce(DataFrame.union, edges))
    discard(members, *tested, *edges)
    own = nodes.select("key", "rep")
    placed = materialize((own.join(roots.select(F.col("node").alias("key"), "root"), "key", "left") if roots else own.withColumn("root", F.col("key"))).withColumn("root", F.coalesce("root", "key")), "jaccard-placed")
    discard(nodes, roots)
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_key = placed.join(smallest, "root").select("key", "root", "component_id")
    out = info.join(by_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *["root", "text_hash"] * detail)


def _shared(source: DataFrame, described: DataFrame, nodes: DataFrame, width: int, percent: int, hot_size: int) -> DataFrame:
    """(sig, key, weight) of the signatures that more than one set has; of those that the same sets have one, with their number as weight.

    Limits here change the order of signatures, and who writes those of many equal documents, but not what is found."""
    spark = source.sparkSession
    often = described.where("hot is not null").groupBy("key").agg(F.sum("hot").alias("hot")).where("hot >= 32").orderBy(F.desc("hot"), "key").limit(hot_size).collect()
    frequent = np.sort(np.array([r["key"] for r in often], np.int64).astype(_U))
    hot = spark.sparkContext.broadcast((frequent, _filter(frequent)))
    copied = nodes.where("copies > 20 and rep is not null").orderBy(F.desc("copies"), "key").limit(hot_size).select("key", F.col("rep").cast("string").alias("rep")).collect()
    reps = spark.sparkContext.broadcast({r["key"]: r["rep"] for r in copied})  # large groups of copies: only one writes signatures

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                sigs, keys, sizes = [], [], []
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    s = shingles(value, width)
                    if len(s):
                        key = set_key(s)
                        if reps.value.get(key, str(doc)) == str(doc):
                            sigs.append(signatures(s, hot.value[0], percent, hot.value[1]))
                            keys.append(key)
                            sizes.append(len(sigs[-1]))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), sizes))], ["sig", "key"])

    rows = source.mapInArrow(write, "sig long, key long")
    found = materialize(rows.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_groups, "sig long, key long, n long, print long"), "jaccard-shared")
    chosen = found.where("key is null").groupBy("n", "print").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("weight")).select("sig", "weight")
    members = materialize(found.where("key is not null").select("sig", "key").join(chosen, "sig"), "jaccard-members")
    discard(found)
    return members


def _across(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(sig, key, weight, root) of the signatures whose sets lie in more than one component so far."""
    if roots is None:
        return members.withColumn("root", F.col("key"))
    rows = materialize(members.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "jaccard-rooted")
    mixed = rows.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sig")
    out = materialize(rows.join(mixed, "sig", "left_semi"), "jaccard-across")
    discard(rows)
    return out


def _proposed(rows: DataFrame) -> DataFrame:
    """(a, b, kind, of, weight): for set `of` partners in other components, a < b, with the number of signatures that propose the pair.

    In each group the sets stand by the number of signatures that they share with others, the greatest first. A set's
    partners are the first of its group (kind 0) and the one before it (kind 1); where that lies in its own component, the nearest before it,
    or first of the group, that does not."""
    strength = rows.groupBy("key").agg(F.sum("weight").alias("strength"))
    sorted_rows = rows.join(strength, "key").select("sig", "key", "weight", "root", (-F.col("strength")).alias("place")).repartition("sig").sortWithinPartitions("sig", "place", "key")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the open group: the first set and the first of another component, the last set and the last of another component
        sig = first = other = last = before = None
        for batch in batches:
            out = []
            for s, key, weight, root in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != sig:
                    sig, first, other, last, before = s, (key, root), None, (key, root), None
                    continue
                partners = [p if p[1] != root else q for p, q in ((first, other), (last, before))]
                for kind, p in enumerate(partners):
                    if p is not None and (not kind or p != partners[0]):
                        out.append((min(key, p[0]), max(key, p[0]), kind, key, weight))
                if other is None and root != first[1]:
                    other = (key, root)
                if root != last[1]:
                    before = last
                last = (key, root)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["a", "b", "kind", "of", "weight"])

    found = sorted_rows.mapInArrow(propose, "a long, b long, kind int, of long, weight long")
    return found.groupBy("a", "b", "kind", "of").agg(F.sum("weight").alias("weight"))


def _likely(nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, n1, n2) of those pairs that sizes and parities do not rule out, with the sizes."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.arange(batch.num_rows)
                keep = _plausible_pairs(batch.column(2).to_numpy(), Parities(batch.column(4)), at, batch.column(3).to_numpy(), Parities(batch.column(5)), at, percent)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in range(4)], ["a", "b", "n1", "n2"])

    a, b = nodes.select(F.col("key").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1")), nodes.select(F.col("key").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    return materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "n1", "n2", "bits1", "bits2").mapInArrow(sift, "a long, b long, n1 long, n2 long"), "jaccard-likely")


def _blocks(sizes: DataFrame, by: str) -> DataFrame:
    """(`by`, blocks) of the groups of (`by`, n) that need more than one block of FAMILY sets or LOAD features."""
    blocks = F.ceil(F.greatest(F.sum("n") / LOAD, F.count(F.lit(1)) / FAMILY)).cast("int")
    return materialize(sizes.groupBy(by).agg(blocks.alias("blocks")).where("blocks > 1"), "jaccard-blocks")


def _by_center(likely: DataFrame) -> tuple[DataFrame, ...]:
    """(a, b, g): pairs with the same a come together, in blocks of b; and the tables that this reads."""
    blocks = _blocks(likely.select("a", F.col("n2").alias("n")), "a")
    found = likely.join(blocks, "a", "left")
    return found.select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1)))).alias("g")), blocks


def _by_family(likely: DataFrame) -> tuple[DataFrame, ...]:
    """(a, b, g): each set belongs to the one of its partners and itself that has most partners; pairs of the same two of these
    come together, in blocks of a and of b; and the tables that this reads."""
    both = likely.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("n1").alias("n")).union(likely.select("b", "a", "n2"))
    degree = materialize(both.groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.first("n").alias("n")), "jaccard-degrees")
    best = both.join(degree.select(F.col("u").alias("v"), "d"), "v").groupBy("u").agg(F.max(F.struct("d", "v")).alias("best"))
    family = F.greatest("best", F.struct("d", F.col("u").alias("v")))["v"]
    placed = materialize(degree.join(best, "u").select("u", "n", family.alias("family")), "jaccard-families")
    blocks = _blocks(placed.select("family", "n"), "family")
    cells = materialize(placed.join(blocks, "family", "left").select("u", F.xxhash64("family", F.pmod(F.xxhash64("u"), F.coalesce("blocks", F.lit(1)))).alias("cell")), "jaccard-cells")
    found = likely.join(cells.toDF("a", "cell1"), "a").join(cells.toDF("b", "cell2"), "b")
    return found.select("a", "b", F.xxhash64(F.least("cell1", "cell2"), F.greatest("cell1", "cell2")).alias("g")), degree, placed, blocks, cells


def _verified(source: DataFrame, nodes: DataFrame, likely: DataFrame, place: Callable, width: int, percent: int) -> DataFrame:
    """Of the `likely` pairs those (a, b) whose sets are similar enough, checked on the whole texts of one document each.

    `place` gives each pair a group g. Each text goes once to each group that has pairs of it, compressed, and its shingles are made there.
    """
    found, *read = place(likely)
    placed = materialize(found, "jaccard-placed-pairs")
    discard(likely, *read)
    sets = materialize(placed.select("g", F.col("a").alias("key")).union(placed.select("g", "b")).distinct(), "jaccard-sent")
    needed = materialize(sets.select("key").distinct().join(nodes.select("key", "rep"), "key"), "jaccard-needed")
    texts = _texts(source, needed, width)
    sent = sets.join(texts, "key").select("g", F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "packed")
    rows = sent.union(placed.select("g", "a", "b", F.lit(None).cast("binary")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for group in sorted_groups(batches, ("g",)):
            sets = {}
            for key, packed in zip(group["a"].to_pylist(), group["packed"], strict=True):
                if packed.is_valid and key not in sets:
                    sets[key] = shingles(unpack(packed.as_buffer()), width)
            pairs = group.filter(group["b"].is_valid())
            a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
            keep = np.empty(len(a), bool)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                x, y = sets[x], sets[y]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    edges = materialize(rows.repartition("g").sortWithinPartitions("g").mapInArrow(check, "a long, b long"), "jaccard-edges")
    discard(placed, sets, needed)
    return edges


def _bitmap(places: DataFrame) -> np.ndarray:
    """BITMAP bits, those at the `places` (p long) set; put together by row of 32,768 bits in the tasks."""
    bits = np.zeros((BITMAP // 32768, 4096), np.uint8)
    for r in places.groupBy(F.floor(F.col("p") / 32768).alias("row")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect():
        bits[r["row"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits.reshape(-1)


def _marked(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _texts(source: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(key, packed): at least the texts of the `needed` (key, rep), compressed; rows that repeat both may come more than once.

    Two bitmaps, of the ids' hashes and of the keys, of BITMAP bits each whatever the size of the tables, keep most other texts from
    being shingled or shuffled; where they are crowded, more texts pass, and the join by key still finds the right ones."""
    spark = source.sparkSession
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("null"))), F.lit(BITMAP))
    bitmaps = spark.sparkContext.broadcast((_bitmap(needed.select(place("rep").alias("p"))), _bitmap(needed.select(F.pmod("key", F.lit(BITMAP)).alias("p")))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            batch = batch.filter(pa.array(_marked(bitmaps.value[0], batch.column(0).to_numpy())))
            for part in byte_slices(batch, 1):
                keys, packed = [], []
                for value in part.column(1).cast(pa.binary()).to_pylist():
                    s = shingles(value, width)
                    if len(s):
                        key = set_key(s)
                        if _marked(bitmaps.value[1], np.array([key % BITMAP]))[0]:
                            keys.append(key)
                            packed.append(pack(value))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["key", "packed"])

    return source.select(place("doc_id").alias("p"), "text").mapInArrow(gather, "key long, packed binary")


def _rest(rows: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a < b) of keys that share a signature of `rows`, lie in different components, and may be similar enough; and the
    table that this reads.

    Of each signature's sets, those outside the signature's largest component go to all of the signature's blocks, the rest to
    one block each, so pairs within the largest component are never looked at. Sets carry the FIRST smallest of their signatures
    here: a pair that has a smaller one of these in common is written there, and not again.
    """
    parts = rows.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("sig").agg(F.max_by("root", F.struct("n", "root")).alias("big"), F.sum("n").alias("n"), F.max("n").alias("n_big"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    mixed = mixed.select("sig", "big", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("n_big")) / BLOCK).cast("int").alias("outer"))
    found = materialize(rows.select("sig", "key", "root").join(mixed, "sig"), "jaccard-mixed")
    h = F.xxhash64("key")
    home = found.select("sig", F.pmod(h, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("other"), "key", "root", F.lit(True).alias("home"))
    away = found.where("root <> big").select("sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(h, F.col("outer")).cast("int").alias("other"), "key", "root", F.lit(False).alias("home"))
    none = F.array_repeat(F.lit(2**63 - 1), FIRST)  # less than no signature
    firsts = found.groupBy("key").agg(F.slice(F.concat(F.sort_array(F.collect_list("sig")), none), 1, FIRST).alias("firsts"))
    sent = home.union(away).join(nodes.select("key", "n", "bits").join(firsts, "key"), "key").select("sig", "block", "other", "key", "root", "home", "n", "bits", "firsts")
    pairs = sent.repartition("sig", "block", "other").sortWithinPartitions("sig", "block", "other").mapInArrow(_block_pairs(percent), "a long, b long")
    return pairs.distinct(), found


def _block_pairs(percent: int) -> Callable:
    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, root, n, home = (t.column(c).to_numpy() for c in ("key", "root", "n", "home"))
        bits = Parities(t.column("bits"))
        firsts = t.column("firsts").combine_chunks().flatten().to_numpy().reshape(-1, FIRST)
        sig = t.column("sig")[0].as_py()
        home = home.astype(bool)
        i, j = np.flatnonzero(home), np.flatnonzero(~home)
        a, b = [], []
        for x in j.tolist():
            y = i[(root[i] != root[x]) & (key[i] != key[x]) & (np.minimum(n[i], n[x]) * 100 >= np.maximum(n[i], n[x]) * percent)]
            before = firsts[x][firsts[x] < sig]
            y = y[~np.isin(firsts[y], before).any(axis=1)] if len(y) and len(before) else y
            y = y[_plausible_pairs(n, bits, y, n, bits, np.full(len(y), x), percent)] if len(y) else y
            a.append(np.minimum(key[y], key[x]))
            b.append(np.maximum(key[y], key[x]))
        empty = [np.empty(0, np.int64)]
        return np.concatenate(a or empty), np.concatenate(b or empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ("sig", "block", "other")):
            a, b = pairs(group)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """The groups of rows that are equal in `names`, of batches sorted by them; one group is held at a time, beside a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        edge = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            edge |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[s] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN []::VARCHAR[] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""
